"""Records from JSON payloads, feature collections, feeds and sitemaps held in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<id:string,reference:string,municipality:string,attributes:map<string,string>,properties:map<string,string>,geometry:struct<x:double,y:double,coordinates:array<double>>>"


def json_items(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of a payload that is an array, or an object with items or features; others give none."""
    root = F.from_json(body, f"array<{ITEM}>")
    wrapped = F.from_json(body, f"struct<items:array<{ITEM}>,features:array<{ITEM}>>")
    is_array = F.ltrim(body).startswith("[")
    items = F.when(is_array, root).otherwise(F.coalesce(wrapped["items"], wrapped["features"]))
    return payloads.select(*[c for c in payloads.columns if c != body], F.posexplode(items).alias("pos", "item"))


def feature_fields(items: DataFrame) -> DataFrame:
    """Attributes of a feature (attributes, else properties) and its point where both numbers are finite."""
    g = F.col("item.geometry")
    x = F.coalesce(g["x"], F.try_element_at(g["coordinates"], F.lit(1)))
    y = F.coalesce(g["y"], F.try_element_at(g["coordinates"], F.lit(2)))
    fine = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return items.withColumns({"fields": F.coalesce("item.attributes", "item.properties"), "x": F.when(fine, x), "y": F.when(fine, y)})


def _tag(block: Column, *names: str) -> Column:
    """The first of the tags that has text; CDATA is unwrapped."""
    def text(n):
        raw = F.regexp_extract(block, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1)
        return F.nullif(F.trim(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))

    return F.coalesce(*(text(n) for n in names), F.lit(""))


def feed_items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Atom entries where there are any, else RSS items: title, link, published, entry_id."""
    entries = F.regexp_extract_all(body, F.lit(r"(?is)(<entry[\s>].*?</entry>)"), F.lit(1))
    items = F.regexp_extract_all(body, F.lit(r"(?is)(<item[\s>].*?</item>)"), F.lit(1))
    rows = feeds.select(*[c for c in feeds.columns if c != body], F.posexplode(F.when(F.size(entries) > 0, entries).otherwise(items)).alias("pos", "block"))
    b = F.col("block")
    href = F.nullif(F.regexp_extract(b, r'(?is)<link[^>]*href="([^"]*)"', 1), F.lit(""))
    enclosure = F.nullif(F.regexp_extract(b, r'(?is)<enclosure[^>]*url="([^"]*)"', 1), F.lit(""))
    link = F.coalesce(href, F.nullif(_tag(b, "link", "guid"), F.lit("")), enclosure, F.lit(""))
    entry_id = F.coalesce(F.nullif(_tag(b, "guid", "id"), F.lit("")), F.concat(F.lit("xml-entry-"), (F.col("pos") + 1).cast("string")))
    return rows.select(*[c for c in rows.columns if c != "block"], _tag(b, "title").alias("title"), link.alias("link"), _tag(b, "pubDate", "updated", "published").alias("published"), entry_id.alias("entry_id"))


def sitemap_urls(maps: DataFrame, most: int = 80) -> DataFrame:
    """source, loc of the url sets of a source and of one nested level, distinct, the first `most` by address (the
    feature's own limit).

    maps: source, url, body.
    """
    from ..operators.worklist import first_per_key

    locs = lambda tag: F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}>\s*<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    top = maps.filter("url is not null").select("source", F.explode(locs("sitemap")).alias("url"))
    direct = maps.filter("source is not null").select("source", F.explode(locs("url")).alias("loc"))
    nested = top.join(maps.filter("source is null").drop("source"), "url").select("source", F.explode(locs("url")).alias("loc"))
    return first_per_key(direct.unionByName(nested).distinct(), ["source"], ["loc"], most)


def gazette_entries(pages: DataFrame, html: str = "html", marker: str = '<article class="entry">', rubric: str = "Baugesuche") -> DataFrame:
    """Blocks of a listing page that belong to the permit rubric: title, office, place, date."""
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.split(F.col(html), marker)).alias("pos", "block")).filter("pos > 0")
    field = lambda c: F.trim(F.regexp_extract("block", rf'(?is)class="{c}"[^>]*>(.*?)<', 1))
    return rows.filter(field("rubric") == rubric).select(*[c for c in rows.columns if c != "block"], field("title").alias("title"), field("office").alias("office"), field("place").alias("place"), field("date").alias("date"))


def archive_scan(pages: DataFrame, reference: str) -> DataFrame:
    """Entries of an archive's pages (page, ok, html) up to the first page that was read and has none; pages that could
    not be read are passed over. Of entries with one reference the first stays."""
    from ..operators.worklist import first_per_key

    return first_per_key(_before_end(pages)[1], [reference], ["page", "pos"])


def _before_end(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages up to the end, the end included, and the entries of those that were read."""
    entries = gazette_entries(pages.filter("ok"))
    empty = pages.filter("ok").join(entries.select("page"), "page", "left_anti")
    end = F.broadcast(empty.agg(F.min("page").alias("_end")))  # one row
    within = F.col("_end").isNull() | (F.col("page") <= F.col("_end"))
    cut = lambda rows: rows.crossJoin(end).filter(within).drop("_end")
    return cut(pages), cut(entries)


def archive_report(pages: DataFrame, reference: str) -> DataFrame:
    """One row about a scan: pages, failed, raw entries, imported, skipped (repeated references), first and last page."""
    seen, entries = _before_end(pages)
    one = seen.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("ok")).alias("failed"))
    per = entries.groupBy(reference).agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("low"), F.max("page").alias("high"))
    two = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("imported"), F.min("low").alias("first_page"), F.max("high").alias("last_page"))
    return one.crossJoin(two).withColumn("skipped", F.col("raw") - F.col("imported"))  # one row each


#: fixed values: labels that begin the parts of a notice
OWNER = "Bauherrschaft|Bauherrin|Bauherr|Gesuchstellerin|Gesuchsteller"
OBJECT = "Bauobjekt|Bauvorhaben|Bauprojekt"
PLACE = "Bauplatz|Baustelle|Bauort|Standort|Lage"


def labelled_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per block that starts at an owner label and has object and place; withdrawn ones go. Adds pos, block,
    owner, project and address."""
    rows = pages.select(*[c for c in pages.columns if c != text], F.posexplode(F.split(F.col(text), rf"(?=\b(?:{OWNER})\s*:)")).alias("pos", "block"))
    b = F.col("block")
    value = lambda label: F.trim(F.regexp_extract(b, rf"(?s)\b(?:{label})\s*:\s*(.*?)\s*(?=\b(?:{OBJECT}|{PLACE}|Parzelle|Auflage)\b|$)", 1))
    ok = b.rlike(rf"^(?:{OWNER})\s*:") & b.rlike(rf"\b(?:{OBJECT})\s*:") & b.rlike(rf"\b(?:{PLACE})\s*:") & ~b.rlike("(?i)zurückgezogen|verschoben")
    return rows.filter(ok).withColumns({"owner": value(OWNER), "project": value(OBJECT), "address": value(PLACE)})


#: fixed values: what a trusted frame's address or an embedded page mentions
FRAME_PATH = r"(?i)\b(baugesuch|baugesuche|baubewilligung|publikation|auflage|amtlich|ebau|diba)\b"
FRAME_TEXT = r"(?i)\b(baugesuche?|baupublikation|bauherrschaft|bauvorhaben|bauplatz)\b"


def frames(pages: DataFrame, stored: DataFrame, most: int = 3) -> DataFrame:
    """page_id, pos, src, body of embedded frames: inline bodies, and the stored pages (url, html) under trusted addresses.

    An address is trusted on the page's own host, or on another .ch host if it looks official; no documents. The first
    `most` frames of a page count, and of these the ones whose body looks like a permit text.
    """
    from ..operators.pages import resolve
    from ..operators.worklist import first_per_key

    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<iframe\s([^>]*)>"), F.lit(1))).alias("pos", "attributes")
    rows = pages.select("page_id", "url", found)
    value = lambda name: F.nullif(F.regexp_extract("attributes", rf'(?is)(?:^|\s){name}="([^"]*)"', 1), F.lit(""))
    rows = rows.select("page_id", "url", "pos", value("srcdoc").alias("inline"), resolve(F.col("url"), value("src")).alias("src"))
    origin = lambda c: F.lower(F.regexp_extract(c, "^([A-Za-z]+://[^/?#]+)", 1))
    official = origin(F.col("src")).rlike(r"\.ch$") & F.col("src").rlike(FRAME_PATH)
    trusted = ((origin(F.col("src")) == origin(F.col("url"))) | official) & ~F.col("src").rlike(r"(?i)\.pdf($|[?#])")
    inline = rows.filter("inline is not null").select("page_id", "pos", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("src"), "inline")
    linked = rows.filter(F.coalesce(trusted, F.lit(False))).groupBy("page_id", "src").agg(F.min("pos").alias("pos"))
    linked = linked.select("page_id", "pos", F.lit(1).alias("kind"), "src", F.lit(None).cast("string").alias("inline"))
    first = first_per_key(inline.unionByName(linked), ["page_id"], ["pos", "kind"], most)
    bodies = stored.select(F.col("url").alias("src"), F.col("html").alias("stored"))
    out = first.join(bodies, "src", "left").withColumn("body", F.coalesce("inline", "stored"))
    return out.filter(F.col("body").rlike(FRAME_TEXT)).select("page_id", "pos", "src", "body")


#: fixed values: keys of structured metadata that tell of a notice, in lower case
METADATA_KEYS = """headline name description articlebody text streetaddress postalcode addresslocality addressregion addresscountry
location contentlocation datepublished datecreated startdate enddate validthrough identifier keywords""".split()


def structured_metadata(pages: DataFrame, html: str = "html", keys: list[str] | None = None, depth: int = 5) -> DataFrame:
    """page_id, key, value of the listed keys in a page's JSON-LD blocks, down to `depth` levels, and of its itemprop fields.

    Blocks that do not parse give none; values that are addresses of pages are left out.
    """
    keys = keys or METADATA_KEYS
    scripts = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1)))
    level = pages.select("page_id", scripts.alias("j")).select("page_id", F.lit("").alias("key"), F.col("j").alias("value"))
    found = None
    for _ in range(depth):
        v = F.trim("value")
        fields = F.map_entries(F.from_json(v, "map<string,string>"))
        items = F.transform(F.from_json(v, "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
        inner = F.when(v.startswith("{"), fields).when(v.startswith("["), items)
        level = level.select("page_id", F.col("key").alias("above"), F.explode(inner).alias("e"))
        level = level.select("page_id", F.coalesce(F.lower("e.key"), "above").alias("key"), F.col("e.value").alias("value"))
        plain = level.filter(~F.trim("value").rlike(r"^[\[{]"))
        found = plain if found is None else found.unionByName(plain)
    prop = r'(?is)<[a-z0-9]+\s[^>]*?itemprop="([^"]*)"'
    meta = F.arrays_zip(F.regexp_extract_all(html, F.lit(prop + r'[^>]*?content="([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(prop + r'[^>]*?content="([^"]*)"'), F.lit(2)).alias("v"))
    text = F.arrays_zip(F.regexp_extract_all(html, F.lit(prop + r"[^>]*>([^<]+)<"), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(prop + r"[^>]*>([^<]+)<"), F.lit(2)).alias("v"))
    props = pages.select("page_id", F.explode(F.concat(meta, text)).alias("e")).select("page_id", F.lower("e.k").alias("key"), F.trim("e.v").alias("value"))
    return found.unionByName(props).filter(F.col("key").isin(*keys) & (F.col("value") != "") & ~F.col("value").rlike("^https?://"))
