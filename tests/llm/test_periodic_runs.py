"""Runs of words against a plain search of all periods, and the query against a plain version of its contract."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from noticelake.llm import periodic_runs as R

from .test_operators import docs


def brute(words):
    """(start, length, period): every period tried at every place; the smallest period of a stretch counts."""
    smallest, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            b = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > b and i - b + p >= max(6, 4 * p):
                smallest.setdefault((b, i - b + p), p)
            i += 1
    return sorted(((b, n, p) for (b, n), p in smallest.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for b, n, p in runs for k in range(b + p, b + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def made(rng, n, letters):
    w = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:letters]) for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_the_cover_meets_every_difference():
    assert {(a - b) % R.MODULUS for a in R.COVER.tolist() for b in R.COVER.tolist()} == set(range(R.MODULUS))
    for i in range(R.MODULUS):
        for j in range(R.MODULUS):
            s = R.SHIFT[i, j]
            assert (i + s) % R.MODULUS in R.COVER and (j + s) % R.MODULUS in R.COVER


def test_extensions_equal_plain_comparison():
    rng = random.Random(4)
    for letters, n in ((1, 400), (2, 900), (3, 500), (9, 300)):
        x = np.array([rng.randrange(letters) for _ in range(n)] * 2 + [2 * n], np.int64)
        ahead = R.Extensions(x)
        order = [x[ahead.at[k] :].tolist() for k in np.argsort(ahead.rank)]
        assert order == sorted(order)
        pairs = [(rng.randrange(len(x)), rng.randrange(len(x))) for _ in range(400)]
        pairs = [(i, j) for i, j in pairs if i != j]
        got = ahead.of(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        for (i, j), n_got in zip(pairs, got.tolist()):
            n_want = 0
            while max(i, j) + n_want < len(x) and x[i + n_want] == x[j + n_want]:
                n_want += 1
            assert n_got == n_want


def test_runs_equal_plain_search():
    rng = random.Random(1)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            texts.append(" ".join(made(rng, rng.choice([0, 3, 5, 6, 10, 40, 200, 700]), rng.choice([1, 2, 2, 3, 5, 26]))).encode())
            if rng.random() < 0.3:
                texts.append(texts[-1])
        runs, kept = R.collapse(texts)
        for t, r, k in zip(texts, runs, kept):
            want = brute(t.split())
            assert [tuple(x) for x in r.tolist()] == want
            assert k == collapsed(t.split(), want)


def test_points_in_several_blocks(monkeypatch):
    monkeypatch.setattr(R, "POINTS", 50)
    rng = random.Random(8)
    texts = [" ".join(made(rng, 500, 2)).encode() for _ in range(5)] + [b"a " * 700, b"a b " * 300]
    for t, r in zip(texts, R.collapse(texts)[0]):
        assert [tuple(x) for x in r.tolist()] == brute(t.split())


def test_long_texts_take_bounded_work():
    for words, want in (([b"a"] * 400_000, (0, 400_000, 1)), ([b"%d" % (i % 30_011) for i in range(400_000)], (0, 400_000, 30_011))):
        assert [tuple(x) for x in R.collapse([b" ".join(words)])[0][0].tolist()] == [want]


def plain_query(i, text):
    words = (text or "").encode().split()
    n = len(words)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{b},{n},{p}\n" for b, n, p in runs)
    return (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None, "a a a a a a a"), (None, None), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "x"), (5, "a b c\x1cd " * 9), (5, "a b c\x1cd " * 9), (6, "é " * 3000)]
    rows += [(i, rng.choice(" \n\t").join(made(rng, rng.choice([1, 2, 6, 30, 300]), rng.choice([1, 2, 4, 26])))) for i in range(7, 400)]
    rows.append((999, " ".join(made(rng, 3000, 26))))
    data = docs(spark, [(i, t, "s") for i, t in rows]).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "words": F.lit(2)})
    data.write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_query(*r)) for r in rows)
    data.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert R.op13(spark, f"{tmp_path}/none").count() == 0
