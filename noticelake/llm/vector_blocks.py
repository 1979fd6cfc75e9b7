"""Integer vectors, and a set of queries held against all rows in blocks.

Queries are dealt into blocks and rows into stripes by a hash; each pair of a block and a stripe is one task. It keeps
its block of queries, a bounded number of values, and reads the rows of its stripe batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: values of a block's queries; rows of a stripe; entries of a matrix of scores
QUERY_VALUES, STRIPE, SCORES = 1 << 21, 1 << 20, 1 << 22


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, label_col: str | None = None) -> DataFrame:
    """Distinct rows id, h (a hash of v), v = floor(scale * x) of each component x taken as double, and label if named.

    Rows without an identifier, a vector or (if named) a label, and vectors with null or non-finite components are out.
    """
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    label = [F.col(label_col).alias("label")] if label_col else []
    ok = ok & F.col(label_col).isNotNull() if label_col else ok
    v = F.transform(vector_col, lambda x: F.floor(scale * x.cast("double")))
    whole = vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), *label, v.alias("v"))
    return whole.withColumn("h", F.xxhash64("v")).distinct()


def first_of_equals(rows: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """The `keep` rows with the smallest ids of those with equal vectors and equal columns `by`.

    They score alike, so no more of them can be among a query's first ones. The window's limit is applied in each task
    before rows are shuffled, so that a vector with very many copies meets as a few rows of each task.
    """
    w = Window.partitionBy("h", "v", *by).orderBy("id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


@dataclass
class Extent:
    """Counts and bounds that the layout depends on."""

    rows: int
    dims: int
    largest: int

    @classmethod
    def of(cls, rows: DataFrame) -> Extent:
        got = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
        e = cls(got[0], max(got[1] or 0, 1), got[2] or 0)
        if e.dims * e.largest**2 >= 1 << 61:
            raise OverflowError(f"components up to {e.largest} in {e.dims} dimensions: inner products may not fit a long")
        return e


def meet(queries: DataFrame, rows: DataFrame, n_queries: int, extent: Extent, order: list[str], work: Callable, schema: str) -> DataFrame:
    """Holds queries against all rows: work(table of a block's queries) returns an object with feed(batch) and end().

    Both frames have id and h; their other columns go to the task, null where a frame lacks them. Rows of a stripe come
    in the order of the columns `order`. At most a block of queries and a batch of rows are held by a task.
    """
    blocks = max(1, -(-n_queries * extent.dims // QUERY_VALUES))
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    stripes = max(-(-extent.rows // STRIPE), min(-(-tasks // blocks), -(-extent.rows // 512)), 1)
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    of = lambda seed, n: F.pmod(F.xxhash64("id", "h", F.lit(seed)), F.lit(n)).cast("int")
    asked = queries.withColumns({"_block": of(0, blocks), "_stripe": F.explode(number(stripes)), "_kind": F.lit(0)})
    held = rows.withColumns({"_block": F.explode(number(blocks)), "_stripe": of(1, stripes), "_kind": F.lit(1)})
    both = asked.unionByName(held, allowMissingColumns=True).withColumn("_part", F.col("_block") * stripes + F.col("_stripe")).drop("_block", "_stripe")

    def each(batches):
        asked, task = [], None
        for batch in batches:
            n = batch.num_rows - int(np.count_nonzero(batch.column("_kind").to_numpy()))
            if n:
                asked.append(batch.slice(0, n))
            if n < batch.num_rows and asked:
                task = task or work(pa.Table.from_batches(asked))
                task.feed(batch.slice(n))
        if task:
            yield from task.end()

    return both.repartitionById(blocks * stripes, "_part").sortWithinPartitions("_kind", *order).mapInArrow(each, schema)


def matrix(column, dims: int) -> np.ndarray:
    """A list column as rows of dims integers; shorter lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def norms(a: np.ndarray) -> float:
    return float(np.sqrt((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: no partial sum exceeds the product of the norms, which picks the type."""
    most = norms(a) * norms(b) * 1.001
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def pieces(queries: int, rows: int):
    """Ranges of queries whose scores with so many rows make at most SCORES entries."""
    step = max(1, SCORES // max(rows, 1))
    return [(k, min(k + step, queries)) for k in range(0, queries, step)]
