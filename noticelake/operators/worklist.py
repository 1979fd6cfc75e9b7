"""Filters, orders, counters and windows of the worklist and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REVIEW = ["unclear", "ambiguous", "ambiguous-review", "conflict-review", "missing-publication", "import-review"]
PROTECTED = ["protected-point", "protected-zone", "combined-hit"]
CLOSED = ["cleared", "archived"]


def contains_folded(columns: list[str], needle: str) -> Column:
    """Whether a column holds the needle; only A-Z is folded."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.translate(F.coalesce(F.col(c), F.lit("")), UPPER, LOWER), F.translate(F.lit(needle.strip()), UPPER, LOWER))
    return found


def search(df: DataFrame, needle: str | None = None, columns: list[str] = (), **equal: str) -> DataFrame:
    if needle:
        df = df.filter(contains_folded(list(columns), needle))
    for c, v in equal.items():
        if v:
            df = df.filter(F.col(c) == v)
    return df


def is_active_status(c: str = "reconciliation_status") -> Column:
    return ~F.coalesce(F.col(c), F.lit("")).isin(REVIEW)


def is_active(reference: Column, days: int = 31) -> Column:
    """Active status, not archived, deadline or publication known, published at most `days` ago."""
    return is_active_status() & (F.col("workflow_status") != "archived") & F.col("publication_date").isNotNull() & (F.datediff(reference, F.col("publication_date")) <= days)


def protection_rank() -> Column:
    s = F.col("protection_status")
    return F.when(s == "manual-review", 0).when(s == "combined-hit", 1).when(s == "protected-point", 2).when(s == "protected-zone", 3).otherwise(4)


def closed_rank() -> Column:
    return F.when(F.col("workflow_status").isin(CLOSED), 1).otherwise(0)


def worklist_order() -> list[Column]:
    return [protection_rank(), closed_rank(), F.asc("deadline_date"), F.desc("publication_date"), F.asc("municipality"), F.asc("id")]


def urgent(df: DataFrame, most: int = 5) -> DataFrame:
    """The most pressing open records: protection, missing deadlines last, earliest deadline, id."""
    rows = df.filter(~F.col("workflow_status").isin(CLOSED) & is_active_status())
    return rows.orderBy(protection_rank(), F.col("deadline_date").isNull(), "deadline_date", "id").limit(most)


def counters(df: DataFrame, reference: Column) -> DataFrame:
    due = F.datediff("deadline_date", reference)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("protection_status").isin(PROTECTED) & is_active_status()).alias("relevant"),
        F.count_if(((F.col("protection_status") == "manual-review") | F.col("ambiguous_address")) & is_active_status()).alias("manual_review"),
        F.count_if(~F.col("workflow_status").isin(CLOSED) & is_active_status() & due.between(0, 7)).alias("due_soon"),
    )


def next_open(df: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Each open record with the next one of its owner; after the last comes the first."""
    w = Window.partitionBy(owner).orderBy(*order)
    return df.withColumn("next_id", F.coalesce(F.lead("id").over(w), F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def workflow_steps() -> Column:
    """Four steps with the state done, current or pending."""
    rank = F.when(F.col("workflow_status") == "new", 1).when(F.col("workflow_status") == "under-review", 2).when(F.col("workflow_status") == "cleared", 3).otherwise(4)
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i < rank, "done").when(i == rank, "current").otherwise("pending"))


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1, rank_col: str = "_rank") -> DataFrame:
    """The first n rows of every key in the given order; order is part of the meaning."""
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank_col) <= n)
    return ranked.drop(rank_col) if rank_col == "_rank" else ranked


def rebase_dates(df: DataFrame, columns: list[str], newest_of: str, reference: Column, days: int = 2) -> DataFrame:
    """Shifts all dates so that the newest is `days` before the reference."""
    top = df.agg(F.max(newest_of).alias("_top"))
    shift = F.datediff(F.date_sub(reference, days), F.col("_top"))
    return df.join(F.broadcast(top)).withColumns({c: F.date_add(c, shift) for c in columns}).drop("_top")


def archive_expired(df: DataFrame, reference: Column, days: int = 31) -> DataFrame:
    gone = F.coalesce((F.date_add("publication_date", days) < reference) & ~F.col("workflow_status").isin(CLOSED), F.lit(False))
    return df.withColumns({"archived_at": F.when(gone, reference), "workflow_status": F.when(gone, F.lit("archived")).otherwise(F.col("workflow_status"))})


def is_touched() -> Column:
    """Work of the team on a record."""
    return (F.col("workflow_status") != "new") | (F.col("assignee") != "") | (F.col("note") != "")


def prune_stale(stored: DataFrame, keep: DataFrame, commented: DataFrame) -> DataFrame:
    """Untouched, uncommented rows of the keep-list's sources whose reference it lacks go; returns what stays."""
    sources = keep.select("source").distinct().withColumn("_in", F.lit(True))
    refs = keep.select("source", F.trim("source_reference").alias("source_reference")).filter("source_reference <> ''").distinct().withColumn("_kept", F.lit(True))
    marked = stored.join(sources, "source", "left").join(refs, ["source", "source_reference"], "left").join(commented.select("id").distinct().withColumn("_c", F.lit(True)), "id", "left")
    gone = F.col("_in").isNotNull() & F.col("_kept").isNull() & F.col("_c").isNull() & ~is_touched()
    return marked.filter(~gone).select(*stored.columns)


def prune_untouched(stored: DataFrame, delivered: DataFrame, configs: DataFrame, commented: DataFrame) -> DataFrame:
    """What stays of stored after sources that prune left rows out.

    configs: source, municipality, prune. Rows go only of a source and municipality that prune and of which rows were
    delivered; a source that gave nothing keeps all its rows. Of these go the untouched and uncommented ones whose
    reference was not delivered. Blank municipalities and references stand for none.
    """
    place = ["source", "municipality"]
    plain = lambda df, *c: df.select(*(F.trim(F.coalesce(x, F.lit(""))).alias(x) for x in c)).distinct()
    came = plain(delivered, *place, "source_reference").join(plain(configs.filter("prune"), *place), place, "left_semi").filter("source <> '' and municipality <> ''")
    marks = [
        (came.select(*place).distinct().withColumn("_in", F.lit(True)), place),
        (came.filter("source_reference <> ''").withColumn("_kept", F.lit(True)), [*place, "source_reference"]),
        (commented.select("id").distinct().withColumn("_said", F.lit(True)), ["id"]),
    ]
    rows = stored
    for facts, key in marks:
        rows = rows.join(facts, key, "left")
    gone = F.col("_in").isNotNull() & F.col("_kept").isNull() & F.col("_said").isNull() & ~F.coalesce(is_touched(), F.lit(False))
    return rows.filter(~gone).select(*stored.columns)


def patch(base: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Given fields replace, missing ones keep, unknown keys are ignored."""
    p = patches.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    out = base.join(p, key, "left")
    return out.withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns}).drop(*(f"_p_{c}" for c in columns))


def run_metrics(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """raw, imported, updated, merged and error of every source; a source with an error has imported nothing."""
    counts = [F.count_if(F.col("outcome") == o).alias(name) for o, name in (("insert", "imported"), ("update", "updated"), ("merge", "merged"))]
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("raw"), *counts).join(errors, "source", "left")
    return n.select("source", "raw", *(F.when(F.col("error").isNull(), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("imported", "updated", "merged")), "error")


def locale_place(rows: DataFrame, name: str, group: list[str]) -> DataFrame:
    """group, name and place of the different names of each group in the order of the language (de)."""
    names = rows.select(*group, name).distinct()
    order = Window.partitionBy(*group).orderBy(F.expr(f"collate({name}, 'de')"))
    return names.withColumn("place", F.row_number().over(order))
