"""Hard negatives by slots: an anchor's positives cut its scores into slots, and each slot keeps its best rows.

A positive's hard negatives score at most as high as it does and at least a given share of that. The windows of an
anchor's positives overlap, but their upper limits cut the scores into disjoint slots. Every task keeps the k best rows
of each anchor and slot, and these are combined over the tasks. Slots in falling order put one after another from a
positive's own slot on are all rows up to its limit, best first: the first k of them that reach its lower limit
answer it. So one pass over the rows serves all windows, and k rows of each slot are all that is ever kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, load, materialize
from .exact_topk import PRODUCT_SQL, WHOLE_SQL
from .vector_blocks import Extent, first_of_equals, inner, integer_vectors, matrix, meet, pieces

ANCHOR = ["anchor_id", "anchor_h"]


def first_of_groups(group: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of each group that come first by falling score, then rising order."""
    by = np.lexsort((order, -score, group))
    g = group[by]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return by[place < k]


class Kept:
    """The k best rows of each group seen so far."""

    def __init__(self, groups: int, k: int) -> None:
        self.k, self.rows = k, [np.zeros(0, np.int64) for _ in range(3)]  # group, score, id
        self.least = np.full(groups, np.iinfo(np.int64).min)  # no row below it can be among its group's best

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.least[group]
        rows = [np.concatenate([old, new[may]]) for old, new in zip(self.rows, (group, score, ids), strict=True)]
        first = first_of_groups(*rows, self.k)
        self.rows = [x[first] for x in rows]
        group, score = self.rows[:2]
        full = np.flatnonzero(np.diff(np.searchsorted(group, np.arange(len(self.least) + 1))) == self.k)
        self.least[full] = score[np.searchsorted(group, full) + self.k - 1]


class Anchors:
    """A block of anchors: what both passes share."""

    def __init__(self, queries: pa.Table, dims: int) -> None:
        self.dims, self.v = dims, matrix(queries.column("v"), dims)
        self.ids, self.h, self.labels = (queries.column(c).to_numpy() for c in ("id", "h", "label"))

    def scored(self, batch: pa.RecordBatch, anchors: np.ndarray):
        """Ranges of anchors and their scores with the rows of a batch."""
        rows = matrix(batch.column("v"), self.dims)
        for a, b in pieces(len(anchors), len(rows)):
            yield anchors[a:b], inner(self.v[anchors[a:b]], rows)

    def out(self, kept: Kept, names: list[str], of_group: list[np.ndarray]):
        group, score, ids = kept.rows
        table = pa.Table.from_arrays([pa.array(x) for x in (*(c[group] for c in of_group), ids, score)], [*names, "id", "score"])
        yield from table.to_batches(max_chunksize=100_000)


class Positives(Anchors):
    """Best rows of an anchor's own label. Rows come by label, so that a batch meets the anchors of few labels."""

    def __init__(self, queries: pa.Table, dims: int, k: int) -> None:
        super().__init__(queries, dims)
        self.kept = Kept(len(self.ids), k)

    def feed(self, batch: pa.RecordBatch) -> None:
        labels, ids = batch.column("label").to_numpy(), batch.column("id").to_numpy()
        for label in np.unique(labels):
            a, b = np.searchsorted(labels, (label, label), "left")[0], np.searchsorted(labels, label, "right")
            for anchors, scores in self.scored(batch.slice(a, b - a), np.flatnonzero(self.labels == label)):
                own = self.ids[anchors][:, None] == ids[a:b]
                q, r = np.nonzero((scores >= self.kept.least[anchors][:, None]) & ~own)
                self.kept.add(anchors[q], scores[q, r], ids[a:b][r])

    def end(self):
        yield from self.out(self.kept, ANCHOR, [self.ids, self.h])


class Slots(Anchors):
    """Best rows of other labels in each slot. Slot j holds scores up to limit j and above limit j+1."""

    def __init__(self, queries: pa.Table, dims: int, k: int, low: int, high: int) -> None:
        super().__init__(queries, dims)
        lists = queries.column("limits").to_pylist()  # falling, none below zero
        self.n = max(map(len, lists))
        none = np.iinfo(np.int64).min
        self.limits = np.array([x + [none] * (self.n - len(x)) for x in lists], np.int64)
        self.top = self.limits[:, 0]
        # the lowest score that any window of the anchor takes: low * limit <= 100 * score
        self.bottom = np.array([-(-low * x[-1] // high) for x in lists], np.int64)
        self.kept = Kept(len(self.ids) * self.n, k)

    def feed(self, batch: pa.RecordBatch) -> None:
        labels, ids = batch.column("label").to_numpy(), batch.column("id").to_numpy()
        for anchors, scores in self.scored(batch, np.arange(len(self.ids))):
            a, b = anchors[0], anchors[-1] + 1
            inside = (scores <= self.top[a:b, None]) & (scores >= self.bottom[a:b, None]) & (self.labels[a:b, None] != labels)
            q, r = np.nonzero(inside)
            score = scores[q, r]
            slot = (self.limits[q + a] >= score[:, None]).sum(axis=1) - 1
            self.kept.add((q + a) * self.n + slot, score, ids[r])

    def end(self):
        slot = np.tile(np.arange(self.n), len(self.ids))
        yield from self.out(self.kept, [*ANCHOR, "slot"], [np.repeat(self.ids, self.n), np.repeat(self.h, self.n), slot])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x), scores are inner products, ties go to the smaller identifier; is_anchor is a
    condition on the column `id`. An anchor's positives are its first rows of the same label; the hard negatives of a
    positive are the first rows of other labels with low * positive <= high * negative <= high * positive.

    Rows without an identifier, a label or a vector and vectors with null or non-finite components take no part. Equal
    rows count once; one identifier on several vectors is a row of each. Vectors of different lengths are compared as if
    filled up with zeros. A positive with a negative score has no window. With too few rows all are returned; an empty
    table gives no rows; extra columns are ignored. Where a product could exceed a long, an OverflowError is raised.
    """
    rows = materialize(integer_vectors(vectors, id_col, vector_col, scale, label_col), "negatives-rows")
    anchors = rows.filter(is_anchor)
    extent, n = Extent.of(rows), anchors.count()
    # of equal vectors with equal labels, so many and the anchor itself are all that can be among the first
    few = materialize(first_of_equals(rows, max(positives + 1, negatives), ["label"]), "negatives-few")

    found = meet(anchors, few, n, extent, ["label", "id"], lambda q: Positives(q, extent.dims, positives), "anchor_id long, anchor_h long, id long, score long")
    best = Window.partitionBy(*ANCHOR).orderBy(F.desc("score"), "id")
    found = materialize(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives), "negatives-positives")
    own = found.groupBy(*ANCHOR).agg(
        F.sort_array(F.collect_list(F.struct("score", (-F.col("id")).alias("id"))), asc=False).alias("positives"),  # `positives` rows at most
        F.sort_array(F.collect_set(F.when(F.col("score") >= 0, F.col("score"))), asc=False).alias("limits"),
    )
    asked = anchors.select(F.col("id").alias("anchor_id"), F.col("h").alias("anchor_h"), "label", "v").join(own.filter(F.size("limits") > 0), ANCHOR)
    asked = materialize(asked, "negatives-anchors")

    slots = meet(
        asked.select(F.col("anchor_id").alias("id"), F.col("anchor_h").alias("h"), "label", "v", "limits"), few, n, extent, ["id"],
        lambda q: Slots(q, extent.dims, negatives, low, high), "anchor_id long, anchor_h long, slot long, id long, score long",
    )
    best = Window.partitionBy(*ANCHOR, "slot").orderBy(F.desc("score"), "id")
    kept = slots.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= negatives)
    # slots one after another, best rows first: `negatives` rows of each of at most `positives` slots
    falling = kept.groupBy(*ANCHOR).agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("lost"), "id"))).alias("slots"))
    each = asked.select(*ANCHOR, "limits", F.explode("positives").alias("p")).filter("p.score >= 0").join(falling, ANCHOR)
    slot = F.array_position("limits", F.col("p.score")) - 1
    merged = each.withColumn("slot", slot).withColumn("first", F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("slot")), 1, negatives))
    reached = F.filter("first", lambda s: low * F.col("p.score") <= high * -s["lost"])
    result = merged.select("anchor_id", (-F.col("p.id")).alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(reached).alias("rank", "s")).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("s.id").alias("negative_id"), "positive_score", (-F.col("s.lost")).alias("negative_score")
    )
    result = materialize(result, "negatives")
    for table in (rows, few, found, asked):
        discard(table)
    return result


def op11(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(vectors, F.col("id") % 100 == 0)


OP11_SQL = f"""
WITH whole AS ({WHOLE_SQL.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,", also="AND label IS NOT NULL")}),
scored AS (
  SELECT a.vec_id AS anchor_id, a.v AS w, c.vec_id, a.label = c.label AS alike, {PRODUCT_SQL.format(a="a.v", b="c.v")} AS score
  FROM whole a JOIN whole c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, w, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id, w ORDER BY score DESC, vec_id) <= 5),
negatives AS (SELECT anchor_id, w, vec_id AS negative_id, score AS negative_score FROM scored WHERE NOT alike)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, w, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank,
  negative_id, positive_score, negative_score
FROM positives JOIN negatives USING (anchor_id, w)
WHERE 80 * positive_score <= 100 * negative_score AND 100 * negative_score <= 100 * positive_score
QUALIFY rank <= 5
"""
