"""Queries on payload formats; the payloads are built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..sources import payloads as S
from .register import query


def payloads(t):
    item = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("reference"))
    # payloads of a bounded size: fifty suppliers' numbers at most
    groups = t.supplier.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 50)).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("list"))
    k = F.col("s_nationkey") % 4
    body = F.when(k == 0, F.col("list")).when(k == 1, F.concat(F.lit('{"items":'), "list", F.lit("}"))).when(k == 2, F.concat(F.lit('{"features":'), "list", F.lit("}"))).otherwise(F.lit('{"other":1}'))
    return groups.select("s_nationkey", body.alias("body"))


@query("a1_json_payload", "SELECT s_nationkey, CAST(s_suppkey AS VARCHAR) AS id, s_name AS reference FROM supplier WHERE s_nationkey % 4 <> 3")
def a1(t):
    return S.json_items(payloads(t)).select("s_nationkey", "item.id", "item.reference")


@query("a2_feature_collection", "SELECT pt_id, CASE WHEN pt_id % 3 = 2 THEN NULL ELSE east END AS x, CASE WHEN pt_id % 3 = 2 THEN NULL ELSE north END AS y, location_precision AS p FROM gpt", "gpt")
def a2(t):
    k = F.col("pt_id") % 3
    geometry = F.when(k == 0, F.to_json(F.struct(F.col("east").alias("x"), F.col("north").alias("y")))).when(k == 1, F.concat(F.lit('{"coordinates":['), "east", F.lit(","), "north", F.lit("]}"))).otherwise(F.lit("{}"))
    body = F.concat(F.lit('{"features":[{"properties":{"p":"'), "location_precision", F.lit('"},"geometry":'), geometry, F.lit("}]}"))
    rows = S.feature_fields(S.json_items(t.gpt.select("pt_id", body.alias("body"))))
    return rows.select("pt_id", "x", "y", F.col("fields")["p"].alias("p"))


@query("a3_feed", "SELECT s_suppkey AS k, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'https://a.example/' || s_suppkey ELSE 'https://b.example/' || s_suppkey END AS link, CASE WHEN s_suppkey % 2 = 0 THEN 'xml-entry-1' ELSE 'https://b.example/' || s_suppkey END AS entry_id FROM supplier")
def a3(t):
    k = F.col("s_suppkey").cast("string")
    atom = F.concat(F.lit('<feed><entry><title>'), "s_name", F.lit('</title><link rel="x" href="https://a.example/'), k, F.lit('"/></entry></feed>'))
    rss = F.concat(F.lit("<rss><item><title><![CDATA["), "s_name", F.lit("]]></title><guid>https://b.example/"), k, F.lit("</guid></item></rss>"))
    rows = t.supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, atom).otherwise(rss).alias("body"))
    return S.feed_items(rows).select("k", "title", "link", "entry_id")


@query("a4_sitemap", """SELECT source, loc FROM (SELECT s_nationkey AS source, 'https://a.example/' || s_suppkey AS loc FROM supplier UNION SELECT n_nationkey, 'https://n.example/' || n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
QUALIFY row_number() OVER (PARTITION BY source ORDER BY loc) <= 80""")
def a4(t):
    loc = lambda tag, x: F.concat(F.lit(f"<{tag}><loc> "), x, F.lit(f" </loc></{tag}>"))
    chunk = F.floor(F.col("s_suppkey") / 50)
    urls = t.supplier.groupBy("s_nationkey", chunk).agg(F.array_join(F.collect_list(loc("url", F.concat(F.lit("https://a.example/"), F.col("s_suppkey").cast("string")))), "").alias("u"))
    key = F.col("s_nationkey").cast("string")
    main = urls.select(F.col("s_nationkey").alias("source"), F.concat(F.lit("main-"), key).alias("url"), F.concat(F.lit("<urlset>"), "u", loc("sitemap", F.concat(F.lit("nested-"), key)), F.lit("</urlset>")).alias("body"))
    nested = urls.select(F.lit(None).cast("int").alias("source"), F.concat(F.lit("nested-"), key).alias("url"), loc("url", F.concat(F.lit("https://n.example/"), key)).alias("body")).distinct()
    return S.sitemap_urls(main.unionByName(nested))


def listing(t):
    """Listing pages of ten suppliers each: page, ok (it could be read), html."""
    page = F.floor(F.col("s_suppkey") / 10)
    rubric = F.when((F.col("s_suppkey") % 3 == 0) | (page == 8), "Konkurse").otherwise("Baugesuche")
    title = F.concat(F.lit("Gesuch "), (F.col("s_suppkey") % 37).cast("string"))
    block = F.concat(F.lit('<article class="entry"><b class="rubric">'), rubric, F.lit('</b><i class="title"> '), title, F.lit(' </i><u class="place">'), "s_name", F.lit("</u></article>"))
    rows = t.supplier.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))).alias("s"))  # ten at most
    return rows.select("page", (F.col("page") % 7 != 3).alias("ok"), F.array_join(F.transform("s", lambda x: x["b"]), "").alias("html"))


LISTED = """e AS (SELECT floor(s_suppkey / 10.0)::BIGINT AS page, s_suppkey AS k, 'Gesuch ' || s_suppkey % 37 AS title, s_name AS place, s_suppkey % 3 <> 0 AND floor(s_suppkey / 10.0) <> 8 AS entry FROM supplier),
g AS (SELECT page, page % 7 <> 3 AS ok, count(*) FILTER (entry) AS n FROM e GROUP BY 1), stop AS (SELECT min(page) AS page FROM g WHERE ok AND n = 0),
seen AS (SELECT e.* FROM e JOIN g USING (page), stop WHERE ok AND entry AND (stop.page IS NULL OR e.page < stop.page)),
firsts AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY title ORDER BY page, k) = 1)"""


@query("a6_gazette_listing", "SELECT floor(s_suppkey / 10.0)::BIGINT AS page, 'Gesuch ' || s_suppkey % 37 AS title, s_name AS place FROM supplier WHERE s_suppkey % 3 <> 0 AND floor(s_suppkey / 10.0) <> 8")
def a6(t):
    return S.gazette_entries(listing(t)).select("page", "title", "place")


@query("a7_paged_archive", f"WITH {LISTED} SELECT title, page, place FROM firsts")
def a7(t):
    return S.archive_scan(listing(t), "title").select("title", "page", "place")


@query("a8_backfill_counters", f"""WITH {LISTED}, s AS (SELECT g.* FROM g, stop WHERE stop.page IS NULL OR g.page <= stop.page)
SELECT (SELECT count(*) FROM s) AS pages, (SELECT count(*) FROM s WHERE NOT ok) AS failed, (SELECT count(*) FROM seen) AS raw, (SELECT count(*) FROM firsts) AS imported,
 (SELECT count(*) FROM seen) - (SELECT count(*) FROM firsts) AS skipped, (SELECT min(page) FROM seen) AS first_page, (SELECT max(page) FROM seen) AS last_page""")
def a8(t):
    return S.archive_report(listing(t), "title")


@query("a10_table_grid", "SELECT floor(s_suppkey / 50.0)::BIGINT AS part, s_nationkey AS page, 'N' || s_suppkey AS number, s_name AS owner, 'x & y' AS project FROM supplier WHERE s_nationkey % 3 <> 0")
def a10(t):
    row = F.concat(F.lit("<tr><td>N"), F.col("s_suppkey").cast("string"), F.lit("</td><td>x &amp; y</td><td>"), "s_name", F.lit("</td></tr><tr><td>kurz</td><td> </td></tr>"))
    head = F.when(F.col("s_nationkey") % 3 == 0, "<tr><th>Datum</th><th>Anlass</th><th>Ort</th></tr>").otherwise("<tr><th>Baugesuch Nr.</th><th>Bauvorhaben</th><th>Bauherrschaft</th></tr>")
    chunk = F.floor(F.col("s_suppkey") / 50).alias("part")
    pages = t.supplier.groupBy("s_nationkey", chunk, head.alias("head")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    pages = pages.select(F.struct("part", "s_nationkey").alias("page_id"), F.concat(F.lit("<table>"), "head", "rows", F.lit("</table>")).alias("html"))
    return P.permit_rows(pages).select("page_id.part", F.col("page_id.s_nationkey").alias("page"), "number", "owner", "project")


@query("c6_detail_text", "SELECT s_suppkey AS k, 'Name: ' || s_name || ' Nr: ' || s_suppkey AS text FROM supplier")
def c6(t):
    html = F.concat(F.lit("<table><tr><td>Name</td><td>"), "s_name", F.lit("</td></tr><tr><td>Nr</td><td>"), F.col("s_suppkey").cast("string"), F.lit("</td></tr></table>"))
    pairs = F.transform(F.filter(P.table_rows(html), lambda r: F.size(r) == 2), lambda r: F.concat(r[0], F.lit(": "), r[1]))
    return t.supplier.select(F.col("s_suppkey").alias("k"), F.array_join(F.array_distinct(pairs), " ").alias("text"))


BLOCKS = [  # by line: texts of blocks, and the (owner, project, address) that they give
    ("Kopf Bauherrschaft: X %k Bauvorhaben: Garage Bauplatz: Weg %k Auflage bis morgen", [("X %k", "Garage", "Weg %k")]),
    ("Bauherr: A Bauobjekt: Dach Standort: Gasse 2 Gesuchstellerin: B %k Bauprojekt: Stall Lage: Rain 3, Parzelle 4", [("A", "Dach", "Gasse 2"), ("B %k", "Stall", "Rain 3,")]),
    ("Bauherrschaft: X zurückgezogen Bauvorhaben: Haus Bauplatz: Weg 1", []),
    ("Bauherrschaft: X Bauvorhaben: Haus", []),
    ("Bauvorhaben: Haus Bauplatz: Weg 1", []),
    ("Bauherrschaft: X Bauvorhaben: Anbau Bauplatz: Weg 5 Bauherrschaft: Y verschoben Bauvorhaben: Haus Bauplatz: Weg 6", [("X", "Anbau", "Weg 5")]),
]
BLOCK_ROWS = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in r) + ")" for i, (_, rows) in enumerate(BLOCKS) for r in rows)


@query("a11_labelled_blocks", f"SELECT o_orderkey, replace(a, '%k', o_orderkey::VARCHAR) AS owner, b AS project, replace(c, '%k', o_orderkey::VARCHAR) AS address FROM orders JOIN (VALUES {BLOCK_ROWS}) v(i, a, b, c) ON i = o_orderkey % {len(BLOCKS)}")
def a11(t):
    text = T.pick(F.col("o_orderkey"), [x for x, _ in BLOCKS])
    return S.labelled_blocks(t.orders.select("o_orderkey", text.alias("text"))).select("o_orderkey", "owner", "project", "address")


FRAMES = '<iframe width="1" srcdoc="Baugesuch %k"></iframe><iframe src="/baugesuche"></iframe><iframe src="https://other.example.org/baugesuche"></iframe><iframe src="/plan.pdf"></iframe><iframe src="/kontakt#x"></iframe><iframe src="/baugesuche"></iframe><iframe src="/news-detail/7-baugesuch"></iframe>'


@query("a12_frames", """SELECT a.page_id, 0 AS pos, NULL AS src, 'Baugesuch ' || a.page_id AS body FROM site a WHERE a.place = 0
UNION ALL SELECT a.page_id, 1, b.url, b.html FROM site a JOIN site b ON b.site = a.site AND b.place = 1 WHERE a.place = 0 AND contains(lower(b.html), 'baugesuche')""", "site")
def a12(t):
    starts = t.site.filter("place = 0").select("page_id", "url", F.replace(F.lit(FRAMES), F.lit("%k"), F.col("page_id").cast("string")).alias("html"))
    return S.frames(starts, t.site)


METADATA = """<script type="application/ld+json">{"@type":"Event","name":"Page %k","url":"https://a.example","x":"y","location":{"address":{"streetAddress":"Weg %k","note":"z"}},"keywords":["a","b %k"],"description":""}</script>
<script type="application/ld+json">{bad</script><meta itemprop="datePublished" content="2024-01-%k"><span class="x" itemprop="identifier">N %k</span><a itemprop="name">https://a.example/x</a><b itemprop="color">red</b>"""


@query("a13_structured_metadata", """SELECT page_id, key, replace(value, '%k', page_id::VARCHAR) AS value FROM pages,
(VALUES ('name', 'Page %k'), ('streetaddress', 'Weg %k'), ('keywords', 'a'), ('keywords', 'b %k'), ('datepublished', '2024-01-%k'), ('identifier', 'N %k')) v(key, value) WHERE page_id % 2 = 0""")
def a13(t):
    block = F.when(F.col("page_id") % 2 == 0, F.replace(F.lit(METADATA), F.lit("%k"), F.col("page_id").cast("string"))).otherwise(F.lit('<script type="application/ld+json">{bad</script>'))
    return S.structured_metadata(t.pages.select("page_id", F.concat("html", block).alias("html")))


@query("c9_packed_split", "SELECT municipality_id, count(*) AS n, min(source_id) AS low FROM cat_link GROUP BY 1", "cat_link")
def c9(t):
    packed = t.cat_link.groupBy("municipality_id").agg(F.array_join(F.collect_list(F.concat_ws("||", F.col("source_id").cast("string"), "relation_type")), "§§").alias("p"))
    parts = F.transform(F.split("p", "§§"), lambda g: F.struct(F.split(g, r"\|\|")[0].cast("long").alias("id"), F.split(g, r"\|\|")[1].alias("kind")))
    return packed.select("municipality_id", F.size(parts).cast("long").alias("n"), F.array_min(F.transform(parts, lambda s: s["id"])).alias("low"))
