"""Stored web pages: text, links, scored links, best page per source, audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .worklist import first_per_key

def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once for each row, however many filters and scores ask for them.

    A filter on a plain column is moved below it and works the column out again for each use; it does not move below an
    explode that makes what it asks for.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return rows.select(*(c for c in rows.columns if c not in columns), made).select("*", "_once.*").drop("_once")


#: the attributes and the inside of a link
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, href and link text of every anchor with an address in document order; href in any quotes or none."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("inner"))
    named = F.filter(F.transform(found, lambda a: F.struct(T.attribute(a["tag"], "href").alias("href"), a["inner"].alias("inner"))), lambda a: a["href"] != "")
    rows = pages.select("page_id", "url", F.posexplode(named).alias("pos", "a"))
    return rows.select("page_id", "url", "pos", F.col("a.href").alias("href"), T.strip_html(F.col("a.inner")).alias("label"))


#: fixed values: tags that begin and end a block of their own, in the order in which equally long blocks win
BLOCK_TAGS = ["p", "li", "article", "section", "tr"]


def enclosing_block(html: str, at: int) -> str:
    """The shortest stretch around a place from the last opening of a block tag before it to the first end after it."""
    best = ""
    for tag in BLOCK_TAGS:
        start, end = html.rfind(f"<{tag}", 0, at + len(tag) + 1), html.find(f"</{tag}>", at)
        if start >= 0 and end >= 0 and (not best or end + len(tag) + 3 - start < len(best)):
            best = html[start : end + len(tag) + 3]
    return best


def anchors_in_context(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, block, href, label and the text of the smallest block around each link; its own text without one.

    block is where the link begins. Blocks need positions in the text, which columns do not give: a page is one row of
    an Arrow batch and leaves the task as its links.
    """
    import re

    anchor = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.I | re.S)

    def each(frames):
        for f in frames:
            rows = [(i, u, m.start(), m[1], m[2], enclosing_block(h, m.start()) or m[0]) for i, u, h in zip(f["page_id"], f["url"], f["html"]) if h for m in anchor.finditer(h)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "block", "tag", "inner", "piece"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.col(html).alias("html")).mapInPandas(each, f"page_id {kind}, url string, block long, tag string, inner string, piece string")
    rows = rows.select("page_id", "url", "block", T.attribute(F.col("tag"), "href").alias("href"), T.strip_html(F.col("inner")).alias("label"), T.strip_html(F.col("piece")).alias("context"))
    return rows.filter("href <> ''")


def collapse_repeated(segments: Column) -> Column:
    """Path segments without the second copy where the first two or more stand twice in a row."""
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(segments) / 2).cast("int"))), lambda n: (n >= 2) & (F.slice(segments, F.lit(1), n) == F.slice(segments, n + 1, n)))
    n = F.try_element_at(same, F.lit(1))
    return F.when(n.isNull(), segments).otherwise(F.concat(F.slice(segments, F.lit(1), n), F.slice(segments, 2 * n + 1, F.size(segments))))


def resolve(base: Column, href: Column) -> Column:
    """The absolute web address of a link on a page, or null: blank, a place on the page itself, another scheme.

    . and .. are resolved, a repeated beginning of the path goes, as does the fragment; the host is in lower case.
    """
    site = lambda x: F.regexp_extract(x, r"^(?i)(https?://[^/?#]+)", 1)
    path_of = lambda x: F.regexp_extract(x, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    query_of = lambda x: F.regexp_extract(x, r"(\?[^#]*)", 1)

    def tidy(parts):
        ends = F.element_at(parts, -1).isin("", ".", "..")
        step = lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s.isin("", "."), out).otherwise(F.concat(out, F.array(s)))
        kept = T.bound(F.aggregate(parts, F.array().cast("array<string>"), step), collapse_repeated)
        return T.bound(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(ends & (F.size(k) > 0), "/").otherwise("")))

    def full(p):
        link, scheme, at, base = (p[c] for c in ("link", "scheme", "at", "base"))
        own = F.regexp_extract(link, r"^([^?]*)", 1)
        folder = F.regexp_extract(F.concat(path_of(base), F.when(path_of(base) == "", "/").otherwise("")), r"^(.*/)", 1)
        path = F.when(at.isNotNull(), path_of(at)).when(own == "", path_of(base)).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
        query = F.when(at.isNull() & (link == ""), query_of(base)).otherwise(query_of(link))
        root = F.lower(site(F.coalesce(at, base)))
        web = (link != "") & ((scheme == "") | scheme.isin("http", "https")) & (root != "")
        return F.when(web, F.concat(root, T.bound(F.split(F.replace(path, F.lit(" "), F.lit("%20")), "/"), tidy), query))

    def parts(link):
        scheme = F.lower(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        at = F.when(scheme != "", link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), link))
        return T.bound(F.struct(link.alias("link"), scheme.alias("scheme"), at.alias("at"), base.alias("base")), full)

    # a link that is blank or begins with its fragment is nothing without it
    return T.bound(F.regexp_replace(F.trim(T.decode_entities(F.coalesce(href, F.lit("")))), "#.*$", ""), parts)


def title(html: Column) -> Column:
    return T.collapse(T.decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def content_region(html: Column) -> Column:
    """Without page furniture; the main region, else all articles, else what is left."""
    for tag in ("header", "footer", "nav", "aside", "form"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    main = F.nullif(F.regexp_extract(html, "(?is)<main[^>]*>(.*?)</main>", 1), F.lit(""))
    articles = F.nullif(F.array_join(F.regexp_extract_all(html, F.lit("(?is)<article[^>]*>(.*?)</article>"), F.lit(1)), " "), F.lit(""))
    return F.coalesce(main, articles, html)


def table_rows(html: Column) -> Column:
    """Rows of all tables as arrays of cell texts that are not empty."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: T.strip_html(c)), lambda c: c != "")
    return F.transform(rows, cells)


#: what a table's header must mention; and the names of the columns that a record takes
PERMIT_HEADER = r"(?i)\b(baugesuch\s*nr|bauherrschaft|bauvorhaben|auflage)\b"
GRID_COLUMNS = {"number": "baugesuch nr", "owner": "bauherrschaft", "project": "bauvorhaben", "address": "bauplatz", "period": "auflage"}


def permit_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, cells and a record (number, owner, project, address, period) of the rows with three cells or more
    below a header that names permits. A field is the cell under the header cell that begins with its name."""
    rows = F.filter(table_rows(F.col(html)), lambda r: F.size(r) > 0)
    held = pages.select("page_id", rows.alias("rows")).withColumn("head", F.transform(F.try_element_at("rows", F.lit(1)), lambda c: T.base(c)))
    found = held.filter(F.array_join("head", " ").rlike(PERMIT_HEADER)).select("page_id", "head", F.posexplode("rows").alias("pos", "cells"))
    found = found.filter((F.col("pos") > 0) & (F.size("cells") >= 3))

    def cell(name):
        at = F.array_position(F.transform("head", lambda h: h.startswith(name)), True)
        return F.coalesce(F.when(at > 0, F.try_element_at("cells", F.greatest(at, F.lit(1)).cast("int"))), F.lit(""))

    return found.select("page_id", "pos", "cells", *(cell(label).alias(f) for f, label in GRID_COLUMNS.items()))


def link_scores(links: DataFrame, words: list[str]) -> DataFrame:
    """Score of every link: words in its path, in its text, same host, and how short its path is."""
    path, label = F.lower("href"), F.lower("label")
    score = F.lit(0)
    for w in words:
        score = score + F.when(F.contains(path, F.lit(w)), 4).otherwise(0) + F.when(F.contains(label, F.lit(w)), 3).otherwise(0)
    outside = F.col("href").rlike("^[a-z]+://") & (F.lower(F.try_parse_url("href", F.lit("HOST"))) != F.lower(F.try_parse_url("url", F.lit("HOST"))))
    return links.withColumn("score", score - F.when(F.length("href") > 30, 1).otherwise(0)).filter(~F.coalesce(outside, F.lit(False)))


def best_per_target(scored: DataFrame, key: str = "target") -> DataFrame:
    """The best score of every target, with the page that gave it; the first page wins ties."""
    return first_per_key(scored, [key], [F.desc("score"), "page_id", "pos"])


def two_stage(candidates: DataFrame, group: str, content: DataFrame, first: int = 12, accept: int = 8) -> DataFrame:
    """The top `first` of a group by cheap score, rescored with content; the best that reaches `accept`."""
    short = first_per_key(candidates, [group], [F.desc("score"), "pos"], first)
    rated = short.join(content, "target", "left").withColumn("total", F.col("score") + F.coalesce("content_score", F.lit(0)))
    return first_per_key(rated.filter(F.col("total") >= accept), [group], [F.desc("total"), "pos"])


#: fixed values: meta fields that say what a page is about
META = r"(?is)<meta\s[^>]*?(?:name|property)\s*=\s*[\"'](?:description|og:description|twitter:description|article:published_time)[\"'][^>]*?content\s*=\s*[\"']([^\"']*)[\"'][^>]*>"


def metadata_text(html: Column) -> Column:
    """Title, descriptions and published time of a page, as one text."""
    metas = F.transform(F.regexp_extract_all(html, F.lit(META), F.lit(1)), lambda c: T.decode_entities(c))
    return T.collapse(F.concat_ws(" ", title(html), F.array_join(metas, " ")))
