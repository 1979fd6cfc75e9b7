"""Learned rules: signatures, similarity, folding decisions into confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["municipality_key", "address_signature", "project_signature"]
FIRST_CONFIDENCE, NEW_STATUS, STEP, MOST, LEAST = 0.82, 0.72, 0.04, 0.98, 0.35
MINIMUM, CONFIDENT = 0.45, 0.52


def clamp(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(0.82)).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), x)))


def similarity(address: Column, rule_address: Column, project: Column, rule_project: Column, confidence: Column) -> Column:
    """0.2 plus the address and project parts, at most 1, times the rule's confidence."""
    both = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    a = F.when(both(address, rule_address), F.when(address == rule_address, F.lit(0.45)).otherwise(T.token_overlap(address, rule_address) * 0.35)).otherwise(F.lit(0.0))
    p = F.when(both(project, rule_project), F.when(project == rule_project, F.lit(0.25)).otherwise(T.token_overlap(project, rule_project) * 0.2)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.2) + a + p) * clamp(confidence)


def fold_rules(decisions: DataFrame, order: list[str]) -> DataFrame:
    """One rule per signature from its decisions in order: an equal status raises the confidence, another resets it.

    The fold needs a signature's decisions in order; a decision's run of equal statuses is numbered by windows, so
    no group is held whole: confidence = start of the run plus a step for each decision in it.
    """
    w = Window.partitionBy(*KEY).orderBy(*order)
    rows = decisions.withColumn("_new", F.coalesce((F.lag("protection_status").over(w) != F.col("protection_status")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_n", F.row_number().over(w))
    run = rows.groupBy(*KEY, "_run").agg(F.count(F.lit(1)).alias("_len"), F.first("protection_status").alias("protection_status"))
    last = run.groupBy(*KEY).agg(F.sum("_len").alias("match_count"), F.max(F.struct("_run", "_len", "protection_status")).alias("s"))
    start = F.when(F.col("s._run") == 0, F.lit(FIRST_CONFIDENCE)).otherwise(F.lit(NEW_STATUS))
    confidence = F.round(F.least(F.lit(MOST), start + STEP * (F.col("s._len") - 1)), 4)
    return last.select(*KEY, F.col("s.protection_status").alias("protection_status"), "match_count", confidence.alias("confidence"))


def top_rules(rules: DataFrame, n: int = 25) -> DataFrame:
    w = Window.partitionBy("municipality_key").orderBy(F.desc("confidence"), F.desc("match_count"), *KEY[1:])
    return rules.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def best_rule(items: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """The best of the municipality's top rules for every item, where it scores MINIMUM or more.

    Items with the same three signatures have the same best rule, so each combination is scored once.
    """
    top = top_rules(rules).select("municipality_key", F.col("address_signature").alias("ra"), F.col("project_signature").alias("rp"), "protection_status", "confidence")
    kinds = items.select(*KEY).distinct()
    score = similarity(F.col("address_signature"), F.col("ra"), F.col("project_signature"), F.col("rp"), F.col("confidence"))
    scored = kinds.join(top, "municipality_key").withColumn("score", F.round(score, 6)).filter(F.col("score") >= MINIMUM)
    best = scored.groupBy(*KEY).agg(F.min(F.struct(F.negative("score").alias("low"), "ra", "rp", "protection_status", "score")).alias("s"))
    return items.select(id_col, *KEY).join(best, KEY).select(id_col, "s.ra", "s.rp", "s.protection_status", "s.score")


def apply_rules(items: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """Verdict per item: the rule's when it is sure enough, else a manual review; none without a rule."""
    best = best_rule(items, rules, id_col)
    sure = (F.col("score") >= CONFIDENT) & (F.col("protection_status") != "manual-review")
    verdict = F.when(F.col("score").isNull(), F.lit(None).cast("string")).when(sure, F.col("protection_status")).otherwise("manual-review")
    return items.select(id_col).join(best, id_col, "left").select(id_col, verdict.alias("verdict"), F.round(F.col("score") * 100).cast("int").alias("percent"))
