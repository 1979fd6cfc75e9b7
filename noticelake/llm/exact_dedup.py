"""Exact deduplication with a log-structured merge index.

Each task fills a bounded memtable of digests. A full memtable is flushed as a sorted run: one row per digest with its
smallest and largest identifier and its row count. Runs are Parquet files in the shared folder. Compaction deals the
sorted runs out by ranges of digests, merges them in order and keeps smallest (and largest) identifiers.

Digests that occur more than once get a Bloom filter of a bounded size. A second pass over the texts asks it: a row
that it denies is unique and is done, without a shuffle of its text. The others are verified byte by byte, once per
task and digest before the shuffle; texts that share a digest but differ are told apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, load, materialize, work_path

RUN_SCHEMA = "digest binary, min_id long, max_id long, n long"
#: bits of the filter for each repeated digest, and the most it may have; a full filter lets more texts through to the
#: verification, which stays exact
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


def _flush(table: dict) -> pa.RecordBatch:
    keys = sorted(table)
    rows = [table[k] for k in keys]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))],
        ["digest", "min_id", "max_id", "n"],
    )


def memtable_runs(docs: DataFrame, id_col: str, text_col: str, memtable_rows: int, digest_bytes: int) -> DataFrame:
    """Sorted runs of (digest, smallest id, largest id, rows), at most memtable_rows digests each."""

    def fill(batches):
        table: dict[bytes, list] = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer() if text.is_valid else b""
                digest = hashlib.sha256(data or b"").digest()[:digest_bytes]
                row = table.get(digest)
                if row is None:
                    if len(table) >= memtable_rows:
                        yield _flush(table)
                        table = {}
                    table[digest] = [i, i, 1]
                else:
                    if i is not None:
                        row[0] = i if row[0] is None else min(row[0], i)
                        row[1] = i if row[1] is None else max(row[1], i)
                    row[2] += 1
        if table:
            yield _flush(table)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(fill, RUN_SCHEMA)


def compact(runs: DataFrame) -> DataFrame:
    """One row per digest over all runs: smallest and largest identifier, rows.

    The runs are dealt by ranges of digests and merged in order; the aggregate after that is a linear pass, as its
    input is sorted by digest already.
    """
    merged = runs.repartitionByRange("digest").sortWithinPartitions("digest")
    return merged.groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """Bits of the filter that stand for each digest: one row of four."""
    words = np.frombuffer(b"".join(d.ljust(32, b"\0") for d in digests), "<u8").reshape(-1, 4)
    return (words % np.uint64(bits)).astype(np.int64)


def hit_filter(hits: DataFrame) -> np.ndarray:
    """Bloom filter, as bytes, of the digests in hits. Tasks set the bits; at most MOST_FILTER_BITS / 64 words reach the driver."""
    bits = 1 << 16
    while bits < min(FILTER_BITS * hits.count(), MOST_FILTER_BITS):
        bits *= 2

    def run(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_pylist(), bits))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    words = hits.select("digest").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("value").to_numpy()
    return out.view(np.uint8)


def split_by_filter(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """(id, sha, digest, t) of every row; digest and t are null where the filter denies the row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(hit_filter(hits))  # at most MOST_FILTER_BITS

    def run(batches):
        bits = len(held.value) * 8
        for batch in batches:
            texts = [(t.as_buffer() if t.is_valid else None) or b"" for t in batch.column(1)]
            full = [hashlib.sha256(t) for t in texts]
            digests = [d.digest()[:digest_bytes] for d in full]
            at = _places(digests, bits)
            likely = (held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d.hexdigest() for d in full], pa.string()),
                    pa.array([d if ok else None for d, ok in zip(digests, likely, strict=True)], pa.binary()),
                    pa.array([bytes(t) if ok else None for t, ok in zip(texts, likely, strict=True)], pa.binary()),
                ],
                names=["_id", "_sha", "digest", "_t"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "_id long, _sha string, digest binary, _t binary")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 200_000, digest_bytes: int = 32
) -> DataFrame:
    """Groups rows whose texts are byte-for-byte equal and marks the one that stays.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256. keep is "smallest"
    or "largest" identifier. digest_bytes below 32 shortens the index's digests (tests use it to force
    collisions); the result does not depend on it.

    Null texts count as empty texts. A null identifier never wins against another; a group with null
    identifiers only keeps them all. Rows that repeat the winning identifier are all kept; one identifier on
    different texts belongs to the group of each. Whole texts are compared; a batch of texts is the most that a
    task holds. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = work_path(spark, "lsm-runs")
    memtable_runs(docs, id_col, text_col, memtable_rows, digest_bytes).write.parquet(path)
    wins = F.col("min_id") if keep == "smallest" else F.col("max_id")
    index = compact(spark.read.schema(RUN_SCHEMA).parquet(path))
    hits = materialize(index.filter("n > 1").select("digest", wins.alias("_keep"), F.col("n").alias("_n")), "lsm-hits")
    rows = materialize(split_by_filter(docs, hits, id_col, text_col, digest_bytes), "lsm-rows")

    # byte verification: equal smallest and largest text of a digest means that all its texts are equal
    checked = rows.filter("digest is not null").groupBy("digest").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    verdict = materialize(hits.join(checked.select("digest", (F.col("_lo") == F.col("_hi")).alias("_same")), "digest"), "lsm-verdict")
    unique = rows.filter("digest is null").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_sha")
    found = join_spread(rows.filter("digest is not null").select("_id", "_sha", "digest"), verdict, "digest", "_n", ["_id", "_sha"], "left")
    # no verdict: the filter let a unique row through
    sure = found.filter("_same is null or _same").select(
        "_id", F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"), "_sha"
    )
    # texts under one digest that differ: group these by the text itself
    mixed = rows.filter("digest is not null").join(verdict.filter("not _same").select("digest"), "digest", "left_semi")
    by_text = mixed.groupBy("_t").agg((F.min if keep == "smallest" else F.max)("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    told_apart = mixed.join(by_text, "_t").select("_id", "_keep", "_n", "_sha")
    return unique.unionByName(sure).unionByName(told_apart).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op10(spark, sf_dir):
    return exact_dedup(load(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
