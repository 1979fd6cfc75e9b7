"""Exact top-k search by a vector-approximation file.

Each component is quantised to one of 2^bits cells whose edges are quantiles of a bounded sample; the packed cell
numbers are the approximation file. Cells are ranges of integers, so the inner product of a query with any vector of a
row's cells lies between two bounds. The scan reads cells only: a task keeps each query's k best lower bounds and the
rows whose upper bound may still beat the k-th; the same is then done over all tasks. Exact vectors of the rows left
are read in the order of their bounds, a few for each query at a time, until no unread bound reaches the k-th score.

Values outside the sample's range widen the bounds of their row alone; the result is exact for any edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, load, materialize
from .vector_blocks import Extent, first_of_equals, inner, integer_vectors, matrix, meet, pieces

#: bits of a cell number; rows that the cells' edges are taken from
BITS, SAMPLE_ROWS = 6, 100_000
#: exact vectors read for a query in the first round, and how much further each next round reads
FIRST, FURTHER = 2, 4

LEAST = np.iinfo(np.int64).min


class Cells:
    """Edges of the cells of each dimension: cell c holds the integers from edge c up to before edge c+1."""

    def __init__(self, edges: np.ndarray, bits: int) -> None:
        self.edges, self.bits = edges, bits
        self.dims, self.cells = edges.shape[0], edges.shape[1] - 1
        self.middle2 = edges[:, :-1] + edges[:, 1:] - 1  # twice the middle, twice the reach: integers
        self.reach2 = np.maximum(edges[:, 1:] - 1 - edges[:, :-1], 0)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed cell numbers of each row, and by how much its components leave the range of the cells at most."""
        cells = np.stack([np.searchsorted(self.edges[d, 1:-1], v[:, d], side="right") for d in range(self.dims)], axis=1)
        out = np.maximum(self.edges[:, 0] - v, v - (self.edges[:, -1] - 1)).max(axis=1, initial=0)
        bits = (cells[:, :, None] >> np.arange(self.bits - 1, -1, -1)) & 1
        return np.packbits(bits.reshape(len(v), -1).astype(np.uint8), axis=1), np.maximum(out, 0)

    def decode(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the middles and twice the reaches of the cells of each row."""
        bits = np.unpackbits(packed, axis=1)[:, : self.dims * self.bits].reshape(len(packed), self.dims, self.bits)
        cells = (bits << np.arange(self.bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.int64)
        at = np.arange(self.dims) * self.cells + cells
        return self.middle2.ravel()[at], self.reach2.ravel()[at]


def cell_edges(rows: DataFrame, extent: Extent, bits: int, sample_rows: int) -> np.ndarray:
    """Edges from about sample_rows rows, chosen by a hash of the identifier: quantiles of each dimension."""
    n, cells = extent.rows, 1 << bits
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < sample_rows) if n > sample_rows else rows
    one = sample.select(F.posexplode("v").alias("d", "x"))
    cuts = one.groupBy("d").agg(F.percentile_approx("x", [k / cells for k in range(cells + 1)], F.lit(10_000)).alias("cuts"))
    edges = np.zeros((extent.dims, cells + 1), np.int64)
    for d, at in cuts.collect():  # a row for each dimension
        edges[d] = at
    edges[:, -1] += 1
    return edges


def approximation_file(rows: DataFrame, cells: Cells) -> DataFrame:
    """id, h, code (packed cell numbers), excess (how far components leave the cells) of each row."""

    def each(batches):
        for b in batches:
            code, out = cells.encode(matrix(b.column("v"), cells.dims))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(out)], ["id", "h", "code", "excess"])

    return rows.select("id", "h", "v").mapInArrow(each, "id long, h long, code binary, excess long")


class Scan:
    """Holds a block of queries against cells. Bounds are doubled; later rows, with larger ids, lose ties."""

    def __init__(self, queries: pa.Table, cells: Cells, k: int, places: int) -> None:
        self.cells, self.k, self.places = cells, k, places
        self.v, self.ids, self.h = matrix(queries.column("v"), cells.dims), queries.column("id").to_numpy(), queries.column("h").to_numpy()
        self.size, self.best, self.seen, self.left = np.abs(self.v), np.full((len(self.v), k), LEAST), 0, []

    def feed(self, batch: pa.RecordBatch) -> None:
        packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        middle, reach = self.cells.decode(packed)
        ids, h, excess = (batch.column(c).to_numpy() for c in ("id", "h", "excess"))
        late = (self.places - 1 - self.seen - np.arange(len(ids))) if self.places > 1 else 0
        for a, b in pieces(len(self.v), len(ids)):
            mid = inner(self.v[a:b], middle)
            far = inner(self.size[a:b], reach) + 2 * self.size[a:b].sum(axis=1)[:, None] * excess
            low, high = (mid - far) * self.places + late, (mid + far) * self.places + late
            own = self.ids[a:b, None] == ids
            low[own] = high[own] = LEAST
            top = np.partition(low, -self.k, axis=1)[:, -self.k :] if low.shape[1] > self.k else low
            self.best[a:b] = np.partition(np.concatenate([self.best[a:b], top], axis=1), -self.k, axis=1)[:, -self.k :]
            q, r = np.nonzero((high >= self.best[a:b].min(axis=1)[:, None]) & ~own)
            self.left.append((q + a, ids[r], h[r], (mid + far)[q, r], (mid - far)[q, r], high[q, r]))
        self.seen += len(ids)
        if sum(len(x[0]) for x in self.left) > 1 << 21:
            self.left = [self._left()]

    def _left(self) -> tuple[np.ndarray, ...]:
        all_ = [np.concatenate(x) for x in zip(*self.left, strict=True)]
        still = all_[-1] >= self.best.min(axis=1)[all_[0]]
        return tuple(x[still] for x in all_)

    def end(self):
        q, ids, h, upper, lower, _ = self._left()
        names = ["query_id", "query_h", "id", "h", "upper2", "lower2"]
        table = pa.Table.from_arrays([pa.array(x) for x in (self.ids[q], self.h[q], ids, h, upper, lower)], names)
        yield from table.to_batches(max_chunksize=100_000)


BOUNDS = "query_id long, query_h long, id long, h long, upper2 long, lower2 long"
QUERY = ["query_id", "query_h"]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k other rows with the highest inner product, ties to the smaller vec_id.

    Components are floor(scale * x) with x as double; is_query is a condition on the column `id`. bits (1 to 8) is the
    size of a cell number, sample_rows the number of rows, about, that the cells' edges are taken from.

    Rows without an identifier or a vector and vectors with null or non-finite components take no part. Equal rows count
    once; one identifier on several vectors is a row of each, none of which is a candidate of the others. Vectors of
    different lengths are compared as if filled up with zeros. With fewer than k candidates all are returned; an empty
    table gives no rows; extra columns are ignored. Where a product could exceed a long, an OverflowError is raised.
    """
    rows = materialize(integer_vectors(vectors, id_col, vector_col, scale), "va-rows")
    queries = rows.filter(is_query)
    extent, n_queries = Extent.of(rows), queries.count()
    candidates = materialize(first_of_equals(rows, k + 1, []), "va-exact")
    cells = Cells(cell_edges(candidates, extent, bits, sample_rows), bits)
    file = materialize(approximation_file(candidates, cells), "va-file")
    # room for the order of rows below the bounds, where both fit a long
    places = extent.rows + 1 if 16 * extent.dims * extent.largest**2 * (extent.rows + 1) < 1 << 62 else 1
    bounds = meet(queries, file, n_queries, extent, ["id"], lambda q: Scan(q, cells, k, places), BOUNDS)

    # the k-th best lower bound of each query over all tasks; a row that cannot beat it goes
    by_lower = Window.partitionBy(*QUERY).orderBy(F.desc("lower2"), "id", "h")
    by_upper = Window.partitionBy(*QUERY).orderBy(F.desc("upper2"), "id", "h")
    whole = by_lower.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = bounds.withColumns({"low_k": F.nth_value("lower2", k).over(whole), "id_k": F.nth_value("id", k).over(whole)})
    bounds = materialize(beats(bounds, "upper2").withColumn("place", F.row_number().over(by_upper)).drop("lower2", "low_k", "id_k"), "va-bounds")

    by_score = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "id", "h")
    done, known, rest, until = [rows, candidates, file, bounds], None, bounds, FIRST * k
    while True:
        now = rest.filter(F.col("place") <= until)
        exact = now.join(candidates.select("id", "h", "v"), ["id", "h"]).join(queries.select(F.col("id").alias("query_id"), F.col("h").alias("query_h"), F.col("v").alias("w")), QUERY)
        product = F.aggregate(F.zip_with("v", "w", lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
        read = exact.select(*QUERY, "id", "h", product.alias("score"))
        ranked = (known.unionByName(read) if known else read).withColumn("rank", F.row_number().over(by_score))
        best = materialize(ranked.filter(F.col("rank") <= k), "va-best")
        kth = best.filter(F.col("rank") == k).select(*QUERY, (2 * F.col("score")).alias("low_k"), F.col("id").alias("id_k"))
        rest = materialize(beats(rest.filter(F.col("place") > until).join(kth, QUERY, "left"), "upper2").drop("low_k", "id_k"), "va-rest")
        if rest.isEmpty():
            break
        done += [best, rest]
        known, until = best.drop("rank"), until * FURTHER
    for table in [*done, rest]:
        discard(table)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def beats(bounds: DataFrame, upper: str) -> DataFrame:
    """Rows whose bound may still come before the k-th known one (low_k, id_k); with fewer than k known ones, all."""
    return bounds.filter(F.col("low_k").isNull() | (F.col(upper) > F.col("low_k")) | ((F.col(upper) == F.col("low_k")) & (F.col("id") <= F.col("id_k"))))


def op12(spark, sf_dir):
    return top_k(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


#: distinct rows of whole components, and the rule for which rows take part
WHOLE_SQL = """SELECT DISTINCT vec_id, {label} list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {also}"""
PRODUCT_SQL = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])), 0)::BIGINT"

OP12_SQL = f"""
WITH whole AS ({WHOLE_SQL.format(label="", also="")}),
scored AS (
  SELECT q.vec_id AS query_id, q.v AS w, c.vec_id, {PRODUCT_SQL.format(a="q.v", b="c.v")} AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""
