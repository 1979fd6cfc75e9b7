"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: target share of the mix times the mix's size, over the source's
own size. Each document draws its number of copies from a Poisson distribution with that mean by inverting
its cumulative distribution at a uniform number hashed from the seed and the document. Copies are dealt to a
global order by a second hash. All of it is column expressions; only the table of sources is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize

#: up to this mean exp(-rate) is a normal double and the distribution is held from 0 on
MOST_RATE = 500.0
#: a caller's own repetition above this is an error, whatever the table's size
MOST_REPETITION = 500.0


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_start(rate: Column) -> Column:
    """The number of copies that the first entry of poisson_cdf(rate) stands for: what is below has less than 2^-52."""
    return F.when(rate > MOST_RATE, F.floor(rate - 10 * F.sqrt(rate) - 25)).otherwise(F.lit(0)).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= s), P(X <= s + 1), ... from s = poisson_start(rate) until the rest is below 2^-52.

    Above MOST_RATE exp(-rate) would vanish: terms are taken relative to the first one and divided by their sum.
    """
    start = poisson_start(rate)
    terms = F.sequence(start + 1, (rate + 10 * F.sqrt(rate) + 25).cast("int"))
    p0 = F.when(rate > MOST_RATE, F.lit(1.0)).otherwise(F.exp(-rate))
    first = F.struct(p0.alias("p"), F.array(p0).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    def scaled(acc):
        return F.when(rate > MOST_RATE, F.transform(acc["cdf"], lambda c: c / F.element_at(acc["cdf"], -1))).otherwise(acc["cdf"])

    return F.aggregate(terms, first, step, scaled)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    repetition: float = 1.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Returns the columns of docs plus copy_no (from 1) and shuffle_key, globally ordered by shuffle_key.

    weights: target share of each source, in any unit; sources that it lacks get none. Without weights a
    source's share is its number of rows to the power temperature (1 keeps the natural mix). The mix holds
    repetition times the input's rows on average. A null source counts as a source named "". Rows with a
    null id draw as if their id were "". Repeated rows draw alike; empty and very long texts are carried along as they
    are. A source's rate has no limit, as it grows with the table; a repetition above 500 raises an error. An empty
    table gives an empty table. Columns of docs named copy_no or shuffle_key are replaced.

    The table of sources is written out before the join, so that Spark knows its size: it is broadcast while it is
    small (spark.sql.autoBroadcastJoinThreshold), else merged with the rows by source, where adaptive execution splits
    a source that holds very many of them.
    """
    if repetition > MOST_REPETITION:
        raise ValueError(f"repetition above {MOST_REPETITION:g}")
    src = F.coalesce(F.col(source_col), F.lit(""))
    sizes = docs.groupBy(src.alias("_src")).agg(F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        share = F.pow(F.col("_rows").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, w in sorted(weights.items()):
            share = F.when(F.col("_src") == name, F.lit(float(w))).otherwise(share)
    sizes = sizes.withColumn("_share", share)
    total = sizes.agg(F.sum("_share").alias("_shares"), F.sum("_rows").alias("_all"))
    rate = F.coalesce(F.col("_share") / F.col("_shares") * F.col("_all") * float(repetition) / F.col("_rows"), F.lit(0.0))
    rate = F.coalesce(F.col("_share") / F.col("_shares") * F.col("_all") * float(repetition) / F.col("_rows"), F.lit(0.0))
    rates = sizes.join(F.broadcast(total)).select("_src", rate.alias("_rate"))  # total is one row
    rate = F.col("_rate")
    rates = materialize(rates.select("_src", poisson_start(rate).alias("_from"), poisson_cdf(rate).alias("_cdf")), "mix-rates")
    columns = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    docs_by_src = docs.select(src.alias("_src"), F.col(id_col).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    joined = docs_by_src.join(rates, "_src")  # rates is a written table: Spark knows its size and joins accordingly
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    drawn = joined.withColumn("_u", hashed_uniform(F.lit(str(seed)), key))
    copies = F.col("_from") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    return (
        drawn.withColumn("_n", copies)
        .filter("_n > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, F.col("copy_no").cast("string"))))
        .select("_row.*", "copy_no", "shuffle_key")
        .repartitionByRange("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op6(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


OP6_SQL = """
WITH sizes AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
total AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS shares, sum(n) AS n_all FROM sizes),
rates AS (SELECT src, pow(n::DOUBLE, 0.5) / shares * n_all * 1.0 / n AS rate FROM sizes, total),
cdfs AS (
  SELECT src, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf
  FROM rates, range(0, CAST(2000 AS BIGINT)) r(k) WHERE k <= rate + 10 * sqrt(rate) + 25),
lists AS (SELECT src, list(cdf ORDER BY k) AS cdf FROM cdfs GROUP BY src),
drawn AS (
  SELECT d.*, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN lists l ON coalesce(d.source, '') = l.src)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no,
  md5('7-order:' || doc_id || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM drawn WHERE n > 0)
"""
