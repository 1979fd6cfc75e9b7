"""Toxicity scores by maximum-scoring segments of token log-odds.

Training counts words, and the stems they start with, of toxic and of other labelled documents (a bounded sample, in one aggregate, into a
fixed number of hash buckets) and gives each bucket its log-odds under an informative Dirichlet prior. Words
whose log-odds do not stand out, and all words with negative ones, cost a fixed amount. Scoring reads a
document's words once and finds all maximal scoring segments in linear time. The chance of a segment score
in a clean text of that length follows an extreme-value law (Karlin and Altschul) whose parameters come from
the clean words' own score distribution; the segments that stand out are added up on that scale, and a
logistic curve fitted on the training rows turns the sum into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordBuckets, chunks, fold_of, load, materialize

#: a word also counts under its first characters, as many as these
STEMS = (4, 5, 6)
WORD = regex.compile(r"[\p{L}\p{N}]+")
BUCKETS = 1 << 20
#: mass of the prior, spread as the words of all training documents are
PRIOR = 5_000.0
#: standard errors by which a bucket's log-odds must stand out
SIGNIFICANT = 4.0
#: score of any other word
COST = -0.7
#: lattice that scores are put on for the extreme-value law
STEP = 0.05
#: most labelled rows, the first by a hash of the id, that the model is trained on; their ids are broadcast
TRAIN_ROWS = 30_000
#: score from which a document is predicted toxic
THRESHOLD = 0.3


def word_counts(labelled: DataFrame) -> DataFrame:
    """bucket, clean, toxic over all rows of (text, label); summed in each task before the shuffle."""

    def count(batches):
        of = Keys()
        held = {0: np.zeros(BUCKETS, np.int64), 1: np.zeros(BUCKETS, np.int64)}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall((text.as_py() or "").lower())
                if words:
                    np.add.at(held[label], [b for w in words for b in of[w]], 1)
        for label, n in held.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), label, np.int32)), pa.array(n[at])], ["bucket", "label", "n"])

    n = labelled.mapInArrow(count, "bucket int, label int, n long")
    return n.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).alias(name) for y, name in ((0, "clean"), (1, "toxic"))))


class Keys(dict):
    """Buckets of a word's keys. Remembers up to `most` words."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most, self.of = most, WordBuckets(BUCKETS, 1)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = tuple(self.of[k] for k in keys_of(word))
        return found


def log_odds_scores(clean: np.ndarray, toxic: np.ndarray, all_clean: float, all_toxic: float) -> np.ndarray:
    """Scores of buckets from their counts in clean and in toxic training documents and the sums of all counts."""
    prior = PRIOR * (clean + toxic) / max(all_clean + all_toxic, 1)
    t, c = toxic + prior, clean + prior
    delta = np.log(t / (all_toxic + PRIOR - t)) - np.log(c / (all_clean + PRIOR - c))
    stands_out = delta / np.sqrt(1 / t + 1 / c) >= SIGNIFICANT
    return np.where(stands_out, np.maximum(delta + COST, COST), COST)


def extreme_value_law(scores: np.ndarray, clean: np.ndarray, all_clean: float) -> tuple[float, float]:
    """lambda and log K of P(score >= s) ~ K n exp(-lambda s) for n words drawn as in clean documents.

    lambda solves E exp(lambda X) = 1 for a word's score X, put on a lattice of STEP. With S_k the sum of k scores,

        K = STEP exp(-2 sigma) / ((1 - exp(-lambda STEP)) E(X exp(lambda X))),
        sigma = sum over k of (E(exp(lambda S_k); S_k < 0) + P(S_k >= 0)) / k.
    """
    p = clean / max(all_clean, 1)
    pos = scores > 0
    rate = p[pos].sum()
    mean = (p[pos] * scores[pos]).sum() + (1 - rate) * COST
    if rate <= 0 or mean >= 0:
        return 1.0, float(np.log(1e-6))
    cost = round(COST / STEP)
    at = np.maximum(np.rint(scores[pos] / STEP).astype(int), 1)
    law = np.zeros(at.max() - cost + 1)  # chance of each score, from COST on
    np.add.at(law, at - cost, p[pos])
    law[0] += 1 - rate
    x = np.arange(len(law)) + cost
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        total = (law * np.exp(np.minimum(mid * STEP * x, 500))).sum()
        low, high = (low, mid) if total > 1 else (mid, high)
    lam = max(low, 1e-3)
    sums, sigma = np.ones(1), 0.0
    for k in range(1, 200):
        sums = np.convolve(sums, law)
        at = np.arange(len(sums)) + k * cost
        term = (np.where(at < 0, np.exp(lam * STEP * np.minimum(at, 0)), 1.0) * sums).sum() / k
        sigma += term
        if term < 1e-7:
            break
    tilted = (STEP * x * law * np.exp(lam * STEP * x)).sum()
    return lam, float(np.log(STEP) - 2 * sigma - np.log1p(-np.exp(-lam * STEP)) - np.log(tilted))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's linear scan.

    Runs of words with the same sign are added up first, as no maximal segment ends inside one. Each segment on the
    list knows the last one in front of it with a smaller sum to its left, so a search steps along these and never
    looks at a passed segment again.
    """
    if not len(scores) or not (scores > 0).any():
        return []
    sign = scores > 0
    starts = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    ends = np.r_[starts[1:], len(scores)]
    sums = np.add.reduceat(scores, starts)
    stack: list[tuple] = []  # start, end, sum before, sum through, place of the last with a smaller sum before
    total = 0.0
    for a, b, s in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if s <= 0:
            total += s
            continue
        first, before, through = a, total, total + s
        total += s
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= through:
                stack.append((first, b, before, through, j))
                break
            first, before, last = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = last
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def keys_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]


class WordScores(dict):
    """Score of a lower-case word: the best of its keys'. Remembers up to `most` words."""

    def __init__(self, scores: np.ndarray, most: int = 300_000) -> None:
        super().__init__()
        self.scores, self.most, self.of = scores, most, WordBuckets(BUCKETS, 1)

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = best = float(max(self.scores[self.of[k]] for k in keys_of(word)))
        return best


class SegmentModel:
    """Bucket scores, the extreme-value law and the logistic curve."""

    def __init__(self, scores: np.ndarray, lam: float, log_k: float, slope: float = 1.0, offset: float = 0.0) -> None:
        self.scores, self.lam, self.log_k, self.slope, self.offset = scores.astype(np.float32), lam, log_k, slope, offset

    def passages(self, text: str, of: WordScores) -> list[tuple[int, int, float]]:
        """Significant passages: first and last character, and minus the log of the number expected by chance."""
        spans = [m.span() for m in WORD.finditer(text)]
        found = self.segments(np.array([of[text[a:b].lower()] for a, b in spans]))
        return [(spans[a][0], spans[b - 1][1], e) for a, b, e in found]

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        expected = np.log(max(len(scores), 1)) + self.log_k
        rated = ((a, b, self.lam * s - expected) for a, b, s in maximal_segments(scores))
        return [x for x in rated if x[2] > 0]

    def evidence(self, text: str, of: WordScores) -> float:
        """Sum over the passages that stand out; negative, by how many chance would give, where none does."""
        scores = np.array([of[w] for w in WORD.findall(text.lower())])
        found = self.segments(scores)
        return sum(e for _, _, e in found) if found else -max(0.0, np.log(max(len(scores), 1)) + self.log_k) / 10

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak prior."""
    if not len(x) or y.min() == y.max():
        return 0.0, -3.0 if not len(y) or not y[0] else 3.0
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def train(
    docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS
) -> SegmentModel:
    """Learns from at most `rows` labels outside the held fold; only those documents are kept, without a shuffle."""
    y = labels.filter(F.col(label_col).isNotNull() & (fold_of(id_col, folds) != held_fold))
    y = y.groupBy(id_col).agg(F.max((F.col(label_col).cast("int") > 0).cast("int")).alias("_y"))
    picked = y.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id")  # at most `rows` rows
    labelled = labelled.groupBy("id").agg(F.min("text").alias("text"), F.max("_y").alias("label"))  # one text of an id that repeats
    labelled = materialize(labelled, "toxic-train")
    counts = materialize(word_counts(labelled.select("text", "label")), "toxic-counts")  # at most BUCKETS rows
    all_clean, all_toxic = (float(x or 0) for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    b, clean, toxic = (c.to_numpy() for c in counts.filter("toxic > 0").toArrow().columns)  # the others score COST
    scores = np.full(BUCKETS, COST)
    law = (1.0, float(np.log(1e-6)))
    if len(b) and all_clean:
        scores[b] = log_odds_scores(clean, toxic, all_clean, all_toxic)
        law = extreme_value_law(scores[b], clean, all_clean)
    model = SegmentModel(scores, *law)
    points = apply_model(labelled, model, "text", lambda m, e: e, ["label"]).toArrow()
    model.slope, model.offset = fit_logistic(points.column(1).to_numpy().astype(float), points.column(0).to_numpy().astype(float))
    return model


def apply_model(rows: DataFrame, model: SegmentModel, text_col: str, to_score, keep: list[str]) -> DataFrame:
    """The columns keep and a score for every row."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # fixed size: one float for each bucket

    def run(batches):
        m = held.value
        of = WordScores(m.scores)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(texts):
                e = np.array([m.evidence(t or "", of) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(to_score(m, e), pa.float64())], names=[*keep, "score"])

    picked = rows.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{schema}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, held_out, score (0 to 1), predicted (1 if score >= 0.3) of every row of docs.

    Rows whose crc32(id) modulo folds is held_fold are never learned from. Null labels are ignored, of several labels
    of one id the largest counts, and of several texts of one id the smallest is learned from; labels without a
    document are ignored. Null and empty texts get the score of a text without words; very long texts are read whole,
    in linear time. Rows with a null id are scored and never learned from. Without labels of both classes every score
    is that of the class that is there (or clean). An empty table gives no rows. Extra columns, also those named as
    inner ones, are ignored.
    """
    model = train(docs, labels, folds, held_fold, id_col, text_col)
    scored = apply_model(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), model, text_col, lambda m, e: m.probability(e), [id_col])
    return scored.select(
        id_col,
        F.coalesce(fold_of(id_col, folds) == held_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; learns as score_toxicity does, and treats
    nulls, empty, long and repeated texts and clashing labels alike. An empty table gives an empty table."""
    model = train(docs, labels, folds, held_fold, id_col, text_col)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)  # fixed size

    def run(batches):
        m = held.value
        of = WordScores(m.scores)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            evidence = np.array([m.evidence(t or "", of) for t in texts], float)
            yield batch.filter(pa.array(m.probability(evidence) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir):
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
