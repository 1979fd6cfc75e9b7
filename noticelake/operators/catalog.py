"""The source catalog: joined listings, shared sources, coverage reports, building it from flat settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalog(municipalities: DataFrame, links: DataFrame, sources: DataFrame, quality: DataFrame) -> DataFrame:
    """Every municipality with its primary source, number of supplemental sources, their names, and rating."""
    primary = links.filter("relation_type = 'primary'").select("municipality_id", "source_id").join(sources, "source_id")
    primary = primary.select("municipality_id", F.col("name").alias("primary_name"), "source_kind", "canonical_url")
    extra = links.filter("relation_type = 'supplemental'").join(sources, "source_id").groupBy("municipality_id").agg(
        F.count_distinct("source_id").alias("supplements"), F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("supplement_names")
    )
    out = municipalities.join(primary, "municipality_id", "left").join(extra, "municipality_id", "left").join(quality, "municipality_id", "left")
    return out.withColumns({"supplements": F.coalesce("supplements", F.lit(0)), "supplement_names": F.coalesce("supplement_names", F.lit(""))})


def shared_sources(links: DataFrame, sources: DataFrame, least: int = 2) -> DataFrame:
    """Sources that serve several municipalities, the most used first."""
    used = links.join(sources, "source_id").groupBy("source_id", "name").agg(F.count_distinct("municipality_id").alias("municipalities"))
    return used.filter(F.col("municipalities") >= least).orderBy(F.desc("municipalities"), "name")


def rating_report(quality: DataFrame) -> DataFrame:
    return quality.agg(*(F.count_if(F.col("rating") == r).alias(f"rating_{r.lower()}") for r in "ABCD"), F.count_if("uncertain").alias("uncertain"), F.count(F.lit(1)).alias("total"))


def source_type(url: Column, explicit: Column) -> Column:
    """Type of a source by its address and the type that was given."""
    u, e = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    return (
        F.when(e == "manual", "manual")
        .when(u.rlike(r"^https?://([^/]*\.)?amtsblatt\."), "gazette")
        .when(u.rlike(r"/(feature|map)server(/|$|\?)"), "feature-service")
        .when(u.rlike(r"\.pdf($|[?#])"), "pdf")
        .when(u.rlike(r"\.(xml|rss|atom)($|[?#])|/(feed|rss|sitemap)[^/]*$"), "xml")
        .when((e != "") & (e != "html"), e)
        .when(u.rlike(r"\.json($|[?#])"), "json")
        .when(e != "", e)
        .otherwise("json")
    )


def is_public_url(url: Column) -> Column:
    """http(s) only; no local, private or literal IPv6 hosts."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    private = host.rlike(r"^(localhost$|127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)") | host.rlike(r"\.(local|internal|localhost)$") | host.startswith("[")
    return scheme.isin("http", "https") & (host != "") & ~private


def url_shape(url: Column) -> Column:
    u = F.lower(url)
    return F.when(u.rlike(r"\.pdf($|[?#])"), "pdf").when(u.rlike(r"/(detail|id|item)[/=-]?[0-9]+"), "detail").when(u.rlike(r"/(list|archive|news|page)"), "listing").otherwise("page")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, "^([A-Za-z]+://[^/]+)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def upsert_dimension(old: DataFrame, new: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """New values win on equal keys, but for the columns of keep, which stay as they were."""
    o, n = old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns)), new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns))
    joined = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    return joined.select(*((F.coalesce(f"o_{c}", f"n_{c}") if c in keep else F.coalesce(f"n_{c}", f"o_{c}")).alias(c) for c in old.columns))


def guarded_delete(parents: DataFrame, key: str, wanted: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The wanted parents with the number of children of each kind and whether they go."""
    out = wanted.select(key)
    for name, (child, fk) in children.items():
        n = child.groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    blocked = sum((F.col(n) for n in children), F.lit(0))
    return parents.select(key).join(out, key).withColumn("deleted", blocked == 0)
