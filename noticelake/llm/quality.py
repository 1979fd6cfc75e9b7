"""Document quality by a factorisation machine.

A document is a sparse vector: its distinct hashed words (each 1/sqrt(number of distinct words)), structure
statistics and metadata of the text in quantile-free, squashed form. The machine adds a bias, linear weights and
low-rank interactions of all pairs, computed in linear time as half the difference of the square of sums and
the sum of squares. It is trained with Adagrad on a bounded, hash-ordered sample of labelled rows and scores
all rows in one pass.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordBuckets, chunks, fold_of, load, materialize, ragged

BUCKETS, RANK = 1 << 15, 8
#: most labelled rows that the machine is trained on
TRAIN_ROWS = 6_000
#: and most features that these may have together (8 bytes each on the driver); rows beyond it, by the hash's order, stay out
TRAIN_FEATURES = 6_000_000
EPOCHS, BATCH, RATE, SHRINK = 8, 128, 0.08, 1e-5
THRESHOLD = 0.3
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
STATS = 16


def structure(text: str, words: list[str]) -> list[float]:
    """Statistics of a text, each between 0 and 1."""
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    repeats = sum(1 for a, b in zip(words, words[1:]) if a == b)
    shingles = len(set(zip(words, words[1:], words[2:])))
    return [
        1.0,
        min(np.log1p(len(words)) / 12, 1.0),  # metadata: length in words and characters
        min(np.log1p(len(text)) / 15, 1.0),
        min(sum(map(len, words)) / n / 20, 1.0),
        len(counts) / n,
        counts.most_common(1)[0][1] / n if words else 0.0,
        repeats / n,
        shingles / max(n - 2, 1) if n > 2 else 1.0,
        sum(map(str.isupper, text)) / chars,
        sum(map(str.isdigit, text)) / chars,
        min(4 * len(SYMBOL.findall(text)) / chars, 1.0),
        min(10 * (text.count(".") + text.count("!") + text.count("?")) / n, 1.0),
        min(20 * text.count("!") / n, 1.0),
        min(20 * text.count("|") / n, 1.0),
        len(set(lines)) / m,
        min(n / m / 200, 1.0),
    ]


def features(texts: list[str | None], of: WordBuckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat feature numbers and values of the texts, and offsets: words first, then the statistics."""
    numbers, dense = [], []
    for t in texts:
        t = t or ""
        words = t.split()
        own = {of[w.lower()] for w in set(words)}
        numbers.append([*own, *range(BUCKETS, BUCKETS + STATS)])
        dense.append(structure(t, words))
    flat, offsets = ragged(numbers)
    n = np.diff(offsets)
    values = np.repeat(1 / np.sqrt(np.maximum(n - STATS, 1)), n)
    if len(texts):
        at = (offsets[1:, None] - STATS + np.arange(STATS)).ravel()
        values[at] = np.array(dense).ravel()
    return flat, values, offsets


class FactorisationMachine:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.w = np.zeros(BUCKETS + STATS)
        self.v = rng.normal(0, 0.02, (BUCKETS + STATS, RANK))

    def raw(self, flat, values, offsets, parts: bool = False):
        """w.x + 1/2 sum_f ((sum v_f x)^2 - sum (v_f x)^2)"""
        vx = self.v[flat] * values[:, None]
        starts = offsets[:-1]
        sums = np.add.reduceat(vx, starts)
        out = np.add.reduceat(self.w[flat] * values, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return (out, vx, sums) if parts else out

    def fit(self, flat, values, offsets, y, seed: int = 5) -> None:
        rng, n = np.random.default_rng(seed), len(y)
        gw, gv = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for k in range(0, n, BATCH):
                rows = order[k : k + BATCH]
                lengths = offsets[rows + 1] - offsets[rows]
                at = np.repeat(offsets[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
                f, x, off = flat[at], values[at], np.r_[0, np.cumsum(lengths)]
                raw, vx, sums = self.raw(f, x, off, parts=True)
                err = np.repeat((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * weight[rows] / len(rows), lengths)
                used, back = np.unique(f, return_inverse=True)
                dw = np.bincount(back, err * x) + SHRINK * self.w[used]
                dv_each = (err * x)[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
                dv = np.stack([np.bincount(back, dv_each[:, r]) for r in range(RANK)], 1) + SHRINK * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE / 4 * dv / np.sqrt(gv[used])

    def score(self, texts: list[str | None], of: WordBuckets) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts, of)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fits on at most `rows` labelled rows, the first by a hash of the id. They reach the driver as feature numbers,
    at most TRAIN_FEATURES of them."""
    y = labels.filter(F.col(label_col).isNotNull() & (fold_of(id_col, folds) != held_fold))
    y = y.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col).cast("int") > 0).cast("int")).alias("_y"))
    picked = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), "id")  # at most `rows` rows
    sample = sample.groupBy("id").agg(F.min("t").alias("t"), F.max("_y").alias("_y"))  # one text of an id that repeats

    def extract(batches):
        of = WordBuckets(BUCKETS)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            flat, values, offsets = features(texts, of)
            cut = offsets.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.ListArray.from_arrays(cut, pa.array(flat.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(values.astype(np.float32)))], names=["y", "h", "f", "x"]
            )

    rows_of = sample.select("t", "_y", F.xxhash64("id").alias("h")).mapInArrow(extract, "y int, h long, f array<int>, x array<float>")
    rows_of = materialize(rows_of, "quality-train")
    sizes = rows_of.select("h", F.size("f").alias("n")).toArrow().sort_by("h")  # at most `rows` pairs of numbers
    fits = int((np.cumsum(sizes.column("n").to_numpy()) <= TRAIN_FEATURES).sum())
    last = sizes.column("h")[fits - 1].as_py() if fits else -(1 << 63)
    table = rows_of.filter(F.col("h") <= last).orderBy("h").toArrow().combine_chunks()
    model = FactorisationMachine()
    if table.num_rows:
        f, x = (table.column(c).combine_chunks() for c in ("f", "x"))
        offsets = np.r_[0, np.cumsum([len(v) for v in f])].astype(np.int64)
        model.fit(f.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(float), offsets, table.column("y").to_numpy().astype(float))
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Returns id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.3).

    Rows whose crc32(id) modulo folds is held_fold are never learned from. Null and empty texts are scored by
    their statistics alone; very long texts are read whole. Null ids are scored and never learned from. Null labels are
    ignored, of several labels of one id the largest counts, and of several texts of one id the smallest is learned
    from; without labels the score is 0.5 and nearby. Repeated rows get equal scores. An empty table gives no rows.
    Only the text is used; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_fold, id_col, text_col, label_col))  # fixed size

    def run(batches):
        of = WordBuckets(BUCKETS)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held.value.score(texts[a:b], of))], names=["id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold_of("id", folds) == held_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op7(spark, sf_dir):
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
