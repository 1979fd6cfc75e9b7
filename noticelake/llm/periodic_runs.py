"""Runs: stretches of words that repeat with a period, by longest common extensions over a difference cover.

The texts of a batch stand one after another as numbers of words, each followed by a number of its own, so that nothing
extends from one text into the next. Only suffixes at positions of a difference cover modulo 73 (the powers of two, nine
of 73) are sorted: first word by word for as many words as the modulus, then by doubling with the ranks of the sampled
suffixes that far ahead. How far two positions agree is found by comparing at most 72 words to the next pair of
positions that are both in the cover, and a minimum over the common prefixes between their ranks (sparse table).

For each period p the positions of a grid with a step of about 1.5 p are compared with those p ahead. A run of four
periods holds a grid point from which at least half of it still lies ahead; the grid's first point in the run tells its
end by one extension and its start by a binary search over extensions. All periods together make a harmonic sum of
grid points. There is no shuffle: a text is worked on where it is read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, load

#: modulus of the cover; every difference modulo it is one of two cover elements
MODULUS = 73
COVER = np.array(sorted(pow(2, k, MODULUS) for k in range(9)))
#: place of a residue in the cover, or -1
PLACE = np.full(MODULUS, -1)
PLACE[COVER] = np.arange(len(COVER))
#: the least shift that takes two residues into the cover
_AHEAD = PLACE[(np.arange(MODULUS)[:, None] + np.arange(MODULUS)) % MODULUS] >= 0
SHIFT = (_AHEAD[:, None, :] & _AHEAD[None, :, :]).argmax(axis=2)
#: grid points that are looked at together
POINTS = 1 << 20

#: runs from this length on are remembered while longer periods are tried
LONG_RUN = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Extensions:
    """How far two positions of an array of numbers agree. The last number occurs once."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        places = (np.arange(-(-len(x) // MODULUS))[:, None] * MODULUS + COVER).ravel()
        self.at = places[places < len(x)]
        order, ranks = self._sorted()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        common = np.zeros(len(order), np.int32)
        common[1:] = self._prefixes(order[:-1], order[1:], ranks)
        self.least = [common]
        while 2 << (k := len(self.least) - 1) <= len(common):
            self.least.append(np.minimum(self.least[k][: -(1 << k)], self.least[k][1 << k :]))

    def _sorted(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sampled suffixes in order, and their ranks by their first 73, 146, 292 ... words."""
        x, at = self.x, self.at
        order, head = np.arange(len(at)), np.zeros(len(at), np.int64)
        tied, depth, ranks = np.arange(len(at)), 0, []
        while depth < MODULUS or len(tied):
            own = order[tied]
            # who is tied after so many words has not met the end of its text yet, so nothing is read past the end
            key = x[at[own] + depth] if depth < MODULUS else ranks[-1][own + len(COVER) * (depth // MODULUS)]
            key = head[tied] * len(x) + key
            by = np.argsort(key, kind="stable")
            order[tied], key = own[by], key[by]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            head[tied] = np.maximum.accumulate(np.where(first, tied, 0))
            alone = first & np.append(first[1:], True)
            tied = tied[~alone]
            depth = depth + 1 if depth < MODULUS else 2 * depth
            if depth >= MODULUS:
                ranks.append(np.empty(len(at), np.int64))
                ranks[-1][order] = head
            elif not len(tied):
                depth = MODULUS
        return order, ranks

    def _prefixes(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of pairs of sampled suffixes."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero(ranks[k][a] == ranks[k][b])
            found[same] += MODULUS << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        more = self._compared(self.at[a], self.at[b], np.full(len(a), MODULUS))
        return found + more

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, at most so many."""
        found, left, t = most.copy(), np.flatnonzero(most > 0), 0
        while len(left):
            same = self.x[i[left] + t] == self.x[j[left] + t]
            found[left[~same]] = t
            t += 1
            left = left[same]
            left = left[most[left] > t]
        return found

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j (another position) on."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        found = self._compared(i, j, shift)
        met = np.flatnonzero(found == shift)
        if len(met):
            a, b = (self.rank[(p // MODULUS) * len(COVER) + PLACE[p % MODULUS]] for p in (i[met] + shift[met], j[met] + shift[met]))
            low, high = np.minimum(a, b) + 1, np.maximum(a, b)
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            for k in np.unique(level):
                here = level == k
                row = self.least[k]
                found[met[here]] += np.minimum(row[low[here]], row[high[here] - (1 << int(k)) + 1])
        return found


def least_length(period: np.ndarray) -> np.ndarray:
    return np.maximum(6, 4 * period)


def grid(lengths: np.ndarray, offsets: np.ndarray):
    """Pairs (grid point, period) of texts that stand longest first, in blocks of about POINTS."""
    periods = np.arange(1, (int(lengths[0]) if len(lengths) else 0) // 4 + 1)
    if not len(periods) or lengths[0] < 6:
        return
    held = np.searchsorted(-lengths, -least_length(periods), side="right")  # texts that can hold a run of this period
    ends = offsets[held] - periods
    step = np.maximum(1, (least_length(periods) - periods) // 2)
    sizes = np.maximum(0, -(-ends // step))
    block = np.cumsum(sizes) // POINTS
    for cut in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(block)) + 1):
        n = sizes[cut]
        p, s = np.repeat(periods[cut], n), np.repeat(step[cut], n)
        yield (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * s, p, s


def runs_of(x: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts that stand longest first, by start, then period."""
    ahead, found = None, []
    period, end = np.ones(len(x), np.int64), np.zeros(len(x), np.int64)  # of a long run found before that holds the place
    for i, p, s in grid(lengths, offsets):
        # within a run, pairs a multiple of its period apart would find it again
        met = np.flatnonzero((x[i] == x[i + p]) & ((i + p >= end[i]) | (p % period[i] != 0)))
        if not len(met):
            continue
        ahead = ahead or Extensions(x)
        i, p, s = i[met], p[met], s[met]
        far = ahead.of(i, i + p)
        need = least_length(p) - p
        i, p, s, far, need = (v[far >= need - (s - 1)] for v in (i, p, s, far, need))
        before = np.maximum(i - s, 0)
        i, p, s, far, need = (v[(i < s) | (ahead.of(before, before + p) < s)] for v in (i, p, s, far, need))
        low, high = np.maximum(i - s + 1, 0), i.copy()  # the run starts in here
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            reaches = ahead.of(mid, mid + p[open_]) >= i[open_] - mid
            high[open_[reaches]] = mid[reaches]
            low[open_[~reaches]] = mid[~reaches] + 1
        long = i - low + far >= need
        found.append(np.stack([low, i - low + far + p, p], axis=1)[long])
        for a, n, q in found[-1][found[-1][:, 1] >= LONG_RUN]:
            if end[a] < a + n or q % period[a]:
                period[a : a + n], end[a : a + n] = q, a + n
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # a stretch is also found with the multiples of its smallest period
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(texts: list[bytes | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text, and its words without the repetitions, joined by one space."""
    words = [(t or b"").split() for t in texts]  # bytes split at space and \x09-\x0D
    by = sorted(range(len(words)), key=lambda k: -len(words[k]))
    lengths = np.array([len(words[k]) for k in by], np.int64)
    offsets = np.zeros(len(by) + 1, np.int64)
    np.cumsum(lengths + 1, out=offsets[1:])
    x = numbered(words, by, offsets)
    rows = runs_of(x, lengths, offsets)
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    keep = np.cumsum(edge)[:-1] == 0
    text_of = np.searchsorted(offsets, rows[:, 0], side="right") - 1
    cuts = np.searchsorted(text_of, np.arange(len(by) + 1))
    runs, kept = [None] * len(by), [None] * len(by)
    for n, k in enumerate(by):
        own = rows[cuts[n] : cuts[n + 1]]
        runs[k] = own - [offsets[n], 0, 0]
        kept[k] = b" ".join(compress(words[k], keep[offsets[n] :]) if len(own) else words[k])
    return runs, kept


def numbered(words: list[list[bytes]], by: list[int], offsets: np.ndarray) -> np.ndarray:
    """Numbers of the words, equal for equal words and below the array's length; a number of its own ends each text."""
    total = int(offsets[-1])
    number: dict[bytes, int] = {}
    x = np.empty(total, np.int64)
    for n, k in enumerate(by):
        a, b = int(offsets[n]), int(offsets[n + 1]) - 1
        x[a:b] = np.fromiter(map(number.setdefault, words[k], range(a, b)), np.int64, b - a)
        x[b] = b
    return x


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, runs (start, length, period in words, by start, then period) and collapsed of every row.

    Words are what stands between white space (space, \\x09-\\x0D). A run is a stretch of words with smallest period q,
    at least max(6, 4 q) long, that cannot be extended on either side. collapsed holds the words joined by one space,
    without those that any run contains after its first period.

    A null text counts as empty; empty texts have no runs and collapse to the empty text; null and repeated identifiers
    keep their rows; whole texts of any length are taken; an empty table gives no rows; extra columns are left out.
    """

    def each(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                runs, kept = collapse(texts[a:b])
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                stops = np.zeros(len(runs) + 1, np.int32)
                np.cumsum([len(r) for r in runs], out=stops[1:])
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.ListArray.from_arrays(stops, parts), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, runs {RUNS}, collapsed string")
    return found.select(F.col("id").alias(id_col), "runs", "collapsed")


def with_echoes(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text of op13: one in ten documents repeats some of its words to its end.

    h is the crc32 of the identifier; where h % 10 = 0, words from a = g % n on are words a .. a+p-1 over and over,
    with g = h / 10 and p = 1 + (n-a) / (3 + g%8). A null identifier leaves the text as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def echoed(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        cycle = F.slice(words, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    # the one-element array binds the words, so that they are split once
    bound = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, echoed(w)).otherwise(F.lit(""))), 1)
    return F.when((h % 10 == 0) & F.col(text_col).isNotNull(), bound).otherwise(F.col(text_col))


def op13(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", with_echoes().alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return (
        periodic_runs(docs)
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
        .select(
            "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
            F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
        )
    )
