"""Queries on stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import duck as D
from ..functions import text as T
from ..operators import catalog as C
from ..operators import discovery as X
from ..operators import pages as P
from ..operators import worklist as W
from ..sources import payloads as S
from .register import query

WORDS = ["the", "und", "les"]
LINKS = f"""raw AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1, 'is') AS hs, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2, 'is') AS ts FROM pages),
un AS (SELECT page_id, url, unnest(hs) AS href, unnest(ts) AS inner_html, unnest(range(len(hs))) AS pos FROM raw),
links AS (SELECT page_id, url, CAST(pos AS INTEGER) AS pos, href, {D.strip_html('inner_html')} AS label FROM un)"""
SCORE = " + ".join(f"(CASE WHEN contains(lower(href), '{w}') THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(label), '{w}') THEN 3 ELSE 0 END)" for w in WORDS)
SCORED = LINKS + f", scored AS (SELECT *, {SCORE} - (CASE WHEN length(href) > 30 THEN 1 ELSE 0 END) AS score FROM links WHERE NOT regexp_matches(href, '^[a-z]+://'))"


@query("i30_anchors", f"WITH {LINKS} SELECT page_id, pos, href, label FROM links")
def i30(t):
    return P.anchors(t.pages).drop("url")


#: tags and the value of their class
TAGS = [('<a class="x%k" href=y>', "x%k"), ("<a CLASS = 'b c'>", "b c"), ("<a id=1 class=z%k>", "z%k"), ("<a>", ""), ('<a class="">', ""), ('<a class="a&amp;b&#252;">', "a&bü")]


@query("i29_attributes", f"SELECT page_id, {D.pick('page_id', [v for _, v in TAGS])} AS value FROM pages")
def i29_attributes(t):
    return t.pages.select("page_id", T.attribute(T.pick(F.col("page_id"), [v for v, _ in TAGS]), "class").alias("value"))


@query("i8_html_text", f"SELECT page_id, {D.strip_html('html')} AS text FROM pages")
def i8(t):
    return t.pages.select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("a14_page_title", "SELECT page_id, " + D.strip_html("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')") + " AS title FROM pages")
def a14_title(t):
    return t.pages.select("page_id", P.title(F.col("html")).alias("title"))


METAS = """<meta name="description" content="Seite %k &amp; mehr"><meta charset="utf-8"><meta property="og:title" content="nie"><meta data-x="1" property='article:published_time' content='2024-01-02T%k'><meta name="keywords" content="nie">"""


@query("a14_page_metadata", "SELECT page_id, trim(" + D.strip_html("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')") + " || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' Seite ' || page_id || ' & mehr 2024-01-02T' || page_id END) AS text FROM pages")
def a14(t):
    metas = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.replace(F.lit(METAS), F.lit("%k"), F.col("page_id").cast("string")))
    return t.pages.select("page_id", P.metadata_text(F.concat("html", metas)).alias("text"))


@query("i29_attributes", "SELECT page_id, regexp_extract(html, '<html[^>]*?lang=\"([^\"]*)\"', 1, 'is') AS lang FROM pages")
def i29(t):
    return t.pages.select("page_id", F.regexp_extract("html", r'(?is)<html[^>]*?lang="([^"]*)"', 1).alias("lang"))


KINDS = [  # address, explicit type, and the type of the source
    ("https://a.example/x.pdf?y=1", "manual", "manual"), ("https://a.example/%k.pdf", None, "pdf"), ("https://a.example/feed", "", "xml"), ("https://a.example/items", "html", "html"),
    ("https://a.example/items", None, "json"), ("https://kanton.amtsblatt.ch/suche", "html", "gazette"), ("https://gis.example/arcgis/rest/services/a/MapServer/3", "html", "feature-service"),
    ("https://a.example/plan.PDF#1", "html", "pdf"), ("https://a.example/data.json", "html", "json"), ("https://a.example/x", "CSV ", "csv"), ("https://a.example/sitemap.xml", "html", "xml"), (None, None, "json"),
]


@query("a15_source_type", f"SELECT page_id, {D.pick('page_id', [k for *_, k in KINDS])} AS kind FROM pages")
def a15(t):
    return t.pages.select("page_id", C.source_type(T.pick(F.col("page_id"), [u for u, *_ in KINDS]), T.pick(F.col("page_id"), [e for _, e, _ in KINDS])).alias("kind"))


@query("d13_url_shape", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'pdf' WHEN regexp_matches(lower(url), '/(detail|id|item)[/=-]?[0-9]+') THEN 'detail' WHEN regexp_matches(lower(url), '/(list|archive|news|page)') THEN 'listing' ELSE 'page' END AS shape FROM pages")
def d13(t):
    return t.pages.select("page_id", C.url_shape(F.col("url")).alias("shape"))


ADDRESSES = [("https://a.example/%k", True), ("http://192.168.1.4/x", False), ("http://localhost:8080/", False), ("ftp://a.example/x", False), ("https://[::1]/x", False), ("http://10.0.0.%k/", False), ("http://172.20.1.1/", False),
  ("http://172.32.1.1/", True), ("https://intern.local/", False), ("HTTPS://A.EXAMPLE/x?y=%k", True), ("mailto:a@b.example", False), ("", False), (None, False), ("http://169.254.1.1/", False), ("https://localhost.example/", True)]


@query("d14_public_urls", f"SELECT page_id, {D.pick('page_id', [ok for _, ok in ADDRESSES])} AS ok FROM pages")
def d14(t):
    return t.pages.select("page_id", F.coalesce(C.is_public_url(T.pick(F.col("page_id"), [u for u, _ in ADDRESSES])), F.lit(False)).alias("ok"))


#: links on https://A.ch/x/y/z?q=1 and where they lead; %k stands for a number
HREFS = [
    ("../b%k", "https://a.ch/x/b%k"), ("../../../c", "https://a.ch/c"), ("./d/./e/", "https://a.ch/x/y/d/e/"), ("//cdn.ch/p%k#top", "https://cdn.ch/p%k"), ("mailto:a@b.ch", None), ("javascript:void(0)", None), ("tel:+41", None), ("#top", None), ("", None), ("  ", None),
    ("?page=%k", "https://a.ch/x/y/z?page=%k"), ("HTTP://B.ch", "http://b.ch/"), ("http://b.ch/u/v/u/v/w", "http://b.ch/u/v/w"), ("/s/t/s/t/", "https://a.ch/s/t/"), ("/s/s/%k", "https://a.ch/s/s/%k"), ("a&amp;b%k", "https://a.ch/x/y/a&b%k"), ("/q r", "https://a.ch/q%20r"), ("..", "https://a.ch/x/"), (None, None), ("/f?u=../g#h", "https://a.ch/f?u=../g"),
]


@query("i22_resolve_urls", f"WITH {LINKS}, one AS (SELECT page_id, pos, {D.resolve('url', 'href')} AS target FROM links) SELECT * FROM one UNION ALL SELECT -1 - page_id, 0, {D.pick('page_id', [x for _, x in HREFS])} FROM pages")
def i22(t):
    """Addresses of the links of all pages, and of links of every other form."""
    href = F.element_at(F.array(*(F.lit(h) for h, _ in HREFS)), (F.col("page_id") % len(HREFS) + 1).cast("int"))
    cases = t.pages.select((-1 - F.col("page_id")).alias("page_id"), F.lit(0).alias("pos"), F.lit("https://A.ch/x/y/z?q=1").alias("url"), F.replace(href, F.lit("%k"), F.col("page_id").cast("string")).alias("href"))
    return P.anchors(t.pages).select("page_id", "pos", "url", "href").unionByName(cases).select("page_id", "pos", P.resolve(F.col("url"), F.col("href")).alias("target"))


@query("g1_keep_first", f"WITH {LINKS} SELECT page_id, pos, href FROM links QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1")
def g1(t):
    return W.first_per_key(P.anchors(t.pages), ["href"], ["page_id", "pos"]).select("page_id", "pos", "href")


@query("h6_group_limit", f"WITH {LINKS} SELECT page_id, pos FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3")
def h6(t):
    return W.first_per_key(P.anchors(t.pages), ["page_id"], ["pos"], 3).select("page_id", "pos")


@query("g5_best_score", f"WITH {SCORED} SELECT href, score, page_id FROM scored QUALIFY row_number() OVER (PARTITION BY href ORDER BY score DESC, page_id, pos) = 1")
def g5(t):
    return P.best_per_target(P.link_scores(P.anchors(t.pages), WORDS), "href").select("href", "score", "page_id")


@query("g3_argmax", f"WITH {SCORED} SELECT page_id, href, score FROM scored QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1")
def g3(t):
    return W.first_per_key(P.link_scores(P.anchors(t.pages), WORDS), ["page_id"], [F.desc("score"), "pos"]).select("page_id", "href", "score")


TWO = f"""{SCORED}, short AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) <= 12), content AS (SELECT href AS target, least(count(DISTINCT page_id), 9) AS content_score FROM links GROUP BY 1)
SELECT page_id, href, score + coalesce(content_score, 0) AS total FROM short LEFT JOIN content ON target = href WHERE score + coalesce(content_score, 0) >= 8 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score + coalesce(content_score, 0) DESC, pos) = 1"""


def two(t):
    links = P.anchors(t.pages)
    content = links.groupBy(F.col("href").alias("target")).agg(F.least(F.count_distinct("page_id"), F.lit(9)).alias("content_score"))
    return P.two_stage(P.link_scores(links, WORDS).withColumn("target", F.col("href")), "page_id", content).select("page_id", "href", "total")


query("g4_two_stage_ranking", "WITH " + TWO)(two)
PATH = "lower(url_decode(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^#]*)', 1)))"
DISCOVER = f"""cut AS (SELECT page_id, url, unnest(string_split(regexp_replace(regexp_replace(html, '(<(?:p|li|article|section|tr)(?:\\s[^>]*)?>)', chr(1) || '\\1', 'gi'), '(</(?:p|li|article|section|tr)>)', '\\1' || chr(1), 'gi'), chr(1))) AS piece FROM site WHERE place = 0),
an AS (SELECT page_id, url, {D.strip_html('piece')} AS context, unnest(regexp_extract_all(piece, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1, 'is')) AS href, unnest(regexp_extract_all(piece, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2, 'is')) AS label FROM cut),
tg AS (SELECT page_id, url, lower(context) AS context, lower(label) AS label, {D.resolve('url', 'href')} AS target FROM an),
tp AS (SELECT *, {PATH.format('target')} AS path, lower(concat_ws(' ', label, context)) AS near FROM tg WHERE regexp_extract(target, '^[A-Za-z]+://([^/?#]+)', 1) = regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)),
ls AS (SELECT page_id, target, max({D.score(X.LINK_RULES)}) AS score FROM tp WHERE NOT regexp_matches(label, '{X.WRONG_TOPIC}') AND NOT regexp_matches(path, '{X.WRONG_TOPIC}') GROUP BY 1, 2 HAVING score > 0),
pg AS (SELECT url, {PATH.format('url')} AS path, lower({D.strip_html(D.content_region('html'))}) AS text, len(regexp_extract_all(lower(html), '<a\\s[^>]*>[^<]*(?:baugesuch|baupublikation)', 0, 's')) AS linked FROM site),
pb AS (SELECT *, concat_ws(' ', path, text) AS both_ FROM pg),
cs AS (SELECT url AS target, {D.score([("both_" if c == "both" else c, r) for c, r in X.CONTENT_RULES])} + (CASE WHEN len(regexp_extract_all(text, 'baugesuch|baupublikation')) >= 2 THEN 3 ELSE 0 END)
 + (CASE WHEN len(regexp_extract_all(both_, 'baugesuch|baupublikation')) >= 3 THEN 5 ELSE 0 END) + (CASE WHEN linked >= 2 THEN 8 ELSE 0 END) AS content_score FROM pb
 WHERE regexp_matches(text, '{X.PUBLICATION}') OR (regexp_matches(path, '{X.PUBLICATION}') AND (linked > 0 OR regexp_matches(text, '{X.CONCRETE}') OR regexp_matches(text, '{X.LISTING}')))),
disc AS (SELECT page_id, target, score + content_score AS total FROM ls JOIN cs USING (target) WHERE score + content_score >= 8 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score + content_score DESC, target) = 1)"""


def discovered(t):
    return X.discover(t.site.filter("place = 0"), t.site)


@query("j18_discovery", f"WITH {DISCOVER} SELECT page_id, target, CAST(total AS INTEGER) AS total FROM disc", "site")
def j18(t):
    return discovered(t).withColumn("total", F.col("total").cast("int"))


def audit_sql() -> str:
    hit = [(name, n, f"regexp_matches({'both_' if c == 'both' else c}, '{p}')" + (f" AND NOT regexp_matches(text, '{u}')" if u else "")) for name, n, c, p, u in X.AUDIT_RULES]
    hit.append(("several", 5, "len(regexp_extract_all(both_, 'baugesuch|baupublikation')) >= 2"))
    points = " + ".join(f"(CASE WHEN {c} THEN {n} ELSE 0 END)" for _, n, c in hit)
    names = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, _, c in hit)
    title = D.strip_html("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")
    return f"""WITH {DISCOVER}, au AS (SELECT page_id, http_status, {PATH.format('url')} AS path, lower(concat_ws(' ', {title}, {D.strip_html('html')})) AS text FROM site),
ab AS (SELECT *, concat_ws(' ', path, text) AS both_ FROM au), ac AS (SELECT page_id, http_status, path, {points} AS score, coalesce(array_to_string([x FOR x IN [{names}] IF x IS NOT NULL], ','), '') AS signals FROM ab)
SELECT page_id, score, signals, CASE WHEN page_id % 24 = 7 AND http_status <> 200 THEN 'ok-external-verified' WHEN page_id IN (SELECT page_id FROM disc) THEN 'ok-discovered' WHEN http_status IN (401, 403) THEN 'protected-or-login'
 WHEN http_status <> 200 THEN 'needs-review-unreachable' WHEN score >= 22 THEN 'ok-direct' WHEN score >= 12 AND contains(signals, 'text-publication') THEN 'ok-direct-low' WHEN regexp_matches(path, 'publikation') THEN 'ok-official-publication-list'
 WHEN contains(signals, 'protected') THEN 'protected-or-login' ELSE 'needs-review-weak-signal' END AS status,
 CAST(CASE WHEN page_id % 24 = 7 AND http_status <> 200 THEN 84 WHEN page_id IN (SELECT page_id FROM disc) THEN CASE WHEN http_status = 200 THEN 90 ELSE 86 END WHEN http_status IN (401, 403) THEN 78 WHEN http_status <> 200 THEN 35 WHEN score >= 22 THEN 96
 WHEN score >= 12 AND contains(signals, 'text-publication') THEN 88 WHEN regexp_matches(path, 'publikation') THEN 82 WHEN contains(signals, 'protected') THEN 76 ELSE greatest(45, least(72, 45 + score)) END AS INTEGER) AS confidence FROM ac"""


@query("j19_source_audit", audit_sql(), "site")
def j19(t):
    verified = t.site.filter("page_id % 24 = 7").select("page_id")
    return X.audit(t.site.select("page_id", "url", "html", "http_status"), discovered(t), verified)


NPG_LINKS = LINKS.replace("FROM pages", "FROM npg")
STRATEGY = f"""{NPG_LINKS}, st AS (SELECT page_id, 0 AS strategy, 'Garage ' || page_id AS title, 'Weg ' || page_id AS address FROM npg WHERE page_id % 6 = 0 UNION ALL SELECT page_id, 0, 'Dach', 'Gasse 2' FROM npg WHERE page_id % 6 = 0
 UNION ALL SELECT page_id, 1, label, '' FROM links WHERE label <> '' UNION ALL SELECT page_id, 2, 'Stall', 'Weg ' || page_id FROM npg WHERE page_id % 6 = 1 UNION ALL SELECT page_id, 2, 'Pergola', 'Gasse 4' FROM npg WHERE page_id % 6 = 1),
whole AS (SELECT page_id, 3, {D.strip_html("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")}, '' FROM npg WHERE page_id NOT IN (SELECT page_id FROM st))"""


def strategy_rows(pages):
    """Records of a page by the first strategy that gives any: labelled blocks, anchors, rows of a permit table."""
    found = S.labelled_blocks(pages.select("page_id", T.strip_html(F.col("html")).alias("text")))
    blocks = found.select("page_id", F.lit(0).alias("strategy"), F.col("project").alias("title"), "address")
    links = P.anchors(pages).filter("label <> ''").select("page_id", F.lit(1).alias("strategy"), F.col("label").alias("title"), F.lit("").alias("address"))
    grid = P.permit_rows(pages).select("page_id", F.lit(2).alias("strategy"), F.col("project").alias("title"), "address")
    rows = blocks.unionByName(links).unionByName(grid)
    return rows.join(rows.groupBy("page_id").agg(F.min("strategy").alias("strategy")), ["page_id", "strategy"])


@query("a5_page_strategies", f"WITH {STRATEGY} SELECT * FROM st UNION ALL SELECT * FROM whole", "npg")
def a5(t):
    """Records of every page; a page without any gives itself."""
    rows = strategy_rows(t.npg)
    whole = t.npg.join(rows.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(3).alias("strategy"), P.title(F.col("html")).alias("title"), F.lit("").alias("address"))
    return rows.unionByName(whole)


FURNITURE = "<header><p>Kopf</p></header><nav class=x><a href=\"/\">Start</a></nav>"
REGIONS = [("{f}<main><p>Haupt %k</p></main><footer>Fuss</footer>", "Haupt %k"), ("{f}<article>A %k</article><p>x</p><article>B</article>", "A %k B"), ("{f}<p>Rest %k</p><aside>Rand</aside><form>Feld</form>", "Rest %k")]


@query("i9_content_region", f"SELECT page_id, {D.strip_html(D.content_region('html'))} AS text FROM pages UNION ALL SELECT -1 - page_id, {D.pick('page_id', [x for _, x in REGIONS])} FROM pages")
def i9(t):
    cases = t.pages.select((-1 - F.col("page_id")).alias("page_id"), T.pick(F.col("page_id"), [h.replace("{f}", FURNITURE) for h, _ in REGIONS]).alias("html"))
    return t.pages.select("page_id", "html").unionByName(cases).select("page_id", T.strip_html(P.content_region(F.col("html"))).alias("text"))


@query("e14_detail_enrichment", f"WITH {LINKS}, d AS (SELECT href, min(label) AS detail FROM links WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, pos, coalesce(nullif(detail, ''), label) AS title FROM links LEFT JOIN d USING (href) WHERE page_id % 2 = 1")
def e14(t):
    links = P.anchors(t.pages)
    detail = links.filter("page_id % 2 = 0").groupBy("href").agg(F.min("label").alias("detail"))
    return links.filter("page_id % 2 = 1").join(detail, "href", "left").select("page_id", "pos", F.coalesce(F.nullif("detail", F.lit("")), "label").alias("title"))


FEED = "<rss><item><title>a</title></item><item><title>b %k</title></item></rss>"


@query("a16_dispatch", f"""WITH {STRATEGY}, {DISCOVER}, k AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'xml' ELSE 'html' END AS kind FROM npg),
n AS (SELECT page_id, CASE WHEN kind = 'xml' THEN CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END ELSE (SELECT count(*) FROM st WHERE st.page_id = k.page_id) END AS items, kind FROM k)
SELECT n.page_id, CASE WHEN items > 0 THEN items WHEN d.page_id IS NOT NULL THEN 1 ELSE 0 END AS items, CASE WHEN items > 0 THEN kind WHEN d.page_id IS NOT NULL THEN 'discovered' ELSE 'none' END AS reader FROM n LEFT JOIN disc d USING (page_id)""", "npg", "site")
def a16(t):
    """Items by the reader of the source type; a source whose reader gave nothing falls back to its discovered page, else counts 0."""
    feed = F.when(F.col("page_id") % 10 == 0, F.replace(F.lit(FEED), F.lit("%k"), F.col("page_id").cast("string")))
    kinds = t.npg.select("page_id", "url", F.coalesce(feed, "html").alias("html"), F.when(F.col("page_id") % 5 == 0, "xml").otherwise("html").alias("kind"))
    counted = lambda rows, reader: rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("items")).withColumn("reader", F.lit(reader))
    html = counted(strategy_rows(kinds.filter("kind = 'html'")), "html")
    xml = counted(S.feed_items(kinds.filter("kind = 'xml'").select("page_id", F.col("html").alias("body"))), "xml")
    read = html.unionByName(xml)
    missing = kinds.select("page_id").join(read, "page_id", "left_anti")
    found = missing.join(discovered(t).select("page_id", F.lit(1).cast("long").alias("one")), "page_id", "left")
    return read.unionByName(found.select("page_id", F.coalesce("one", F.lit(0)).alias("items"), F.when(F.col("one").isNull(), "none").otherwise("discovered").alias("reader")))
