"""Each operator against brute force or the library, with nulls, empty and long texts, ties, repeats and clashing columns."""

import gzip
import hashlib
import math
import random
import re
import subprocess
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import bpe_trie, embed_dedup, exact_dedup, minhash, mixing, quality, suffix_dedup, token_counts, toxicity, warc
from noticelake.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, source string, _id long, _d string, key long, id string, t string, u int, copy_no int, score string, _y int, _src string, label string"


def docs(spark, rows, partitions=3):
    full = [(i, t, s, 1, "x", 2, "y", "z", 3, 4, "s", 5, "q", "l") for i, t, s in rows]
    return spark.createDataFrame(full, DOC).repartition(partitions)


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Über", "été", "ß"]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "one two"), (5, "one"), (None, "one"), (None, None)]
    for i in range(6, 40):
        w = base[:]
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(40, " ".join(base)), (41, " ".join(base)), (42, (" ".join(base)).upper()), (42, (" ".join(base)).upper())]
    rows += [(50 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(20)]
    rows.append((90, " ".join(rng.choice(words) for _ in range(60_000))))
    return [(i, t, rng.choice(["a", "a", "a", "b", None])) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return texts()


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        for digest_bytes, memtable in ((32, 5), (1, 1000)):
            got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep, digest_bytes=digest_bytes, memtable_rows=memtable).collect()
            want = []
            for i, t, _ in rows:
                ids = [x for x in groups[t or ""] if x is not None]
                k = pick(ids) if ids else None
                want.append((i, k, len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def brute_repeats(rows, n=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + n] for _, b in data for s in range(len(b) - n + 1))
    out = []
    for i, b in data:
        hit = np.zeros(len(b) + 1, int)
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                hit[s : s + n] = 1
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = int((np.diff(np.r_[0, hit]) == 1).sum())
        out.append((i, len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("per_part", [20_000, 3])
def test_suffix_dedup(spark, per_part):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd efgh") for _ in range(3000))
    data = [(None, "q" * 250), (1, None), (2, ""), (3, "a" * 199), (4, "ab" * 200), (4, "ab" * 200), (5, base[:200]), (6, "\0" * 300)]
    for i in range(10, 70):
        a = rng.randrange(2600)
        w = list(base[a : a + rng.randrange(150, 600)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "é"
        data.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(300))) + "".join(w) + rng.choice("uv") * rng.randrange(9)))
    got = suffix_dedup.suffix_dedup(docs(spark, [(i, t, "s") for i, t in data]), per_part=per_part).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(data)
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0


def test_blind_trie_orders_like_sorted():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(300)]
    trie = suffix_dedup.BlindTrie()
    for i, w in enumerate(words):
        trie.insert(w, i)
    assert [words[i] for i in trie.order()] == sorted(words)


FUZZ = "aàéßç İΣσς\t\n\x0b\x1c\x85 '’stLLvedmr09٣½Ⅷ中あ😀👍🏽.,!?-<|>endoftx"


def fuzz():
    rng = random.Random(2)
    return ["".join(rng.choice(FUZZ) for _ in range(rng.randrange(60))) for _ in range(3000)] + [
        "", "<|endoftext|>a<|endoftext|><|startoftext|>B<|", "a" * 500, "the" * 300, "x" * 70_000, "Don't WE'LL 'S", " " * 50,
    ]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = fuzz()
    got = {r[0]: tuple(r[1:]) for r in token_counts.count_tokens(docs(spark, [(i, x, "s") for i, x in enumerate(data)] + [(-1, None, "s")]), P.path("byte_bpe_50k.json")).collect()}
    n = [len(e.ids) for e in t.encode_batch(data, add_special_tokens=False)]
    assert got == {i: (len(x.encode()), n[i], n[i] > 1024) for i, x in enumerate(data)} | {-1: (0, 0, False)}
    assert token_counts.count_tokens(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    assert [tuple(r) for r in token_counts.count_tokens(docs(spark, [(1, "a b", "s")] * 3 + [(None, "a b", "s")]), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()] == [(None, 3, 2, False)] + [(1, 3, 2, False)] * 3


def test_bpe_codec(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    data = fuzz()
    out = bpe_trie.encode_decode(docs(spark, [(i, x, "s") for i, x in enumerate(data)] + [(-1, None, "s")]), P.path("word_bpe_49k.json"), with_texts=True)
    got = {r[0]: (r["n_tokens"], r["ids"], r["decoded"], r["ids_sha256"]) for r in out.collect()}
    assert got.pop(-1)[:3] == (0, [], "")
    for i, e in enumerate(t.encode_batch(data, add_special_tokens=False)):
        sha = hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i] == (len(e.ids), e.ids, t.decode(e.ids, skip_special_tokens=False), sha), data[i]


def test_bpe_codec_on_repeated_rows_and_empty_tables(spark):
    path = P.path("word_bpe_49k.json")
    got = [tuple(r) for r in bpe_trie.encode_decode(docs(spark, [(1, "a b", "s")] * 3 + [(None, "a b", "s")]), path).collect()]
    assert len({r[1:] for r in got}) == 1 and sorted(str(r[0]) for r in got) == ["1", "1", "1", "None"]
    assert bpe_trie.encode_decode(docs(spark, []), path).count() == 0


def brute_segments(s):
    """The best segment, then what lies on both sides of it."""
    sums = np.r_[0, np.cumsum(s)]

    def within(lo, hi):
        best = max(((sums[b] - sums[a], -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return [*within(lo, a), (a, b, best[0]), *within(b, hi)]

    return within(0, len(s))


def test_ruzzo_tompa_segments():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(size=rng.integers(0, 25))
        got, want = toxicity.maximal_segments(s), brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_long_inputs_take_linear_time():
    def seconds(f, x):
        least = 9.0
        for _ in range(3):
            start = time.perf_counter()
            f(x)
            least = min(least, time.perf_counter() - start)
        return least

    for n in (40_000, 80_000):  # toxic words between clean runs
        one, two = (np.tile(np.r_[2.0, np.full(4, -0.7)], k) for k in (n, 2 * n))
        assert seconds(toxicity.maximal_segments, two) < 2.6 * seconds(toxicity.maximal_segments, one) + 0.05
    table, rng = token_counts.MergeTable(P.path("byte_bpe_50k.json")), random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    count = lambda w: token_counts.count_long(w, table)
    assert seconds(count, word) < 2.6 * seconds(count, word[:500_000]) + 0.5


def test_extreme_value_law_against_simulation():
    scores, clean, n = np.array([3.0, -0.7, 1.5]), np.array([10, 900, 40]), 20_000
    lam, log_k = toxicity.extreme_value_law(scores, clean, clean.sum())
    rng, best = np.random.default_rng(1), []
    for _ in range(300):
        sums = np.cumsum(rng.choice(scores, n, p=clean / clean.sum()))
        best.append((sums - np.minimum.accumulate(np.r_[0, sums[:-1]])).max())
    for q in (0.25, 0.5, 0.75, 0.9):
        assert np.exp(-np.exp(log_k - lam * np.quantile(best, q)) * n) == pytest.approx(q, abs=0.12)


def test_toxicity_scores_against_brute_force(spark):
    data = [(i, t, y) for i, t, y in labelled(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data] + [(7, "another text of a known id"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data] + [(11, 1 - int(data[11][2]))], "doc_id long, toxic int")
    truth = {i: int(y) for i, _, y in data} | {11: 1}
    text = {i: min([t] + ["another text of a known id"] * (i == 7)) for i, t, _ in data}
    train = [i for i in truth if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {0: Counter(), 1: Counter()}
    for i in train:
        for w in re.findall(r"[a-z0-9]+", text[i]):
            counts[truth[i]].update(zlib.crc32(k.encode()) % toxicity.BUCKETS for k in toxicity.keys_of(w))
    n = {y: sum(c.values()) for y, c in counts.items()}
    score = {}
    for b in counts[1]:
        prior = toxicity.PRIOR * (counts[0][b] + counts[1][b]) / (n[0] + n[1])
        t, c = counts[1][b] + prior, counts[0][b] + prior
        delta = math.log(t / (n[1] + toxicity.PRIOR - t)) - math.log(c / (n[0] + toxicity.PRIOR - c))
        score[b] = max(delta + toxicity.COST, toxicity.COST) if delta / math.sqrt(1 / t + 1 / c) >= toxicity.SIGNIFICANT else toxicity.COST
    known = np.array(sorted(score))
    lam, log_k = toxicity.extreme_value_law(np.array([score[b] for b in known]), np.array([counts[0][b] for b in known]), n[0])

    def evidence(t):
        words = re.findall(r"[a-z0-9]+", t or "")
        s = [max(score.get(zlib.crc32(k.encode()) % toxicity.BUCKETS, toxicity.COST) for k in toxicity.keys_of(w)) for w in words]
        expected = math.log(max(len(words), 1)) + log_k
        rated = [lam * v - expected for _, _, v in brute_segments(np.array(s)) if lam * v > expected]
        return sum(rated) if rated else -max(0.0, expected) / 10

    slope, offset = toxicity.fit_logistic(np.array([evidence(text[i]) for i in train]), np.array([float(truth[i]) for i in train]))
    want = sorted((str(i), round(1 / (1 + math.exp(-slope * evidence(t) - offset)), 4)) for i, t in [*((i, t) for i, t, _ in data), (7, "another text of a known id"), (None, None)])
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in toxicity.score_toxicity(d, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-3)


def labelled(n=600):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        bad = rng.random() < 0.3
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scumbag", "vermins"]))
        out.append((i, " ".join(w), bad))
    return out


def test_toxicity(spark):
    data = labelled()
    d = docs(spark, [(i, t, "s") for i, t, _ in data] + [(None, "idiot", "s"), (5000, None, "s"), (5001, "", "s"), (5002, "idiot " * 50_000, "s")])
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in data] + [(0, 1, None), (9999, 1, 1), (1, 1, int(data[1][2]))], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(d, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    held = [(got[i].score, y) for i, _, y in data if got[i].held_out]
    assert 80 < len(held) < 220 and sum((s >= 0.3) == y for s, y in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score < 0.3 and got[5002].predicted == 1 and 0 <= got[None].score <= 1
    assert toxicity.score_toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.score_toxicity(d, labels.filter("false")).filter("score > 0.3").count() == 0
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_quality(spark):
    rng = random.Random(4)
    data = [(i, t if i % 3 else " ".join(rng.choice(["buy", "now", "$$$"]) for _ in range(40)), bool(i % 3)) for i, t, _ in labelled(500)]
    d = docs(spark, [(i, t, "s") for i, t, _ in data] + [(None, "x", "s"), (5000, None, "s"), (5001, "", "s"), (5002, "word1 " * 50_000, "s")])
    labels = spark.createDataFrame([(i, int(y), 0) for i, _, y in data] + [(0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(d, labels).collect()}
    held = [(got[i].score, y) for i, _, y in data if got[i].held_out]
    assert len(held) > 50 and sum((s >= 0.3) == y for s, y in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score and all(0 <= r.score <= 1 for r in got.values())
    clash = labels.union(spark.createDataFrame([(i, 1 - int(y), 0) for i, _, y in data[:40]], "doc_id long, quality int, toxic int"))
    again = [sorted(map(str, quality.score_quality(d.repartition(n), clash.repartition(n)).select("doc_id", F.round("score", 6)).collect())) for n in (1, 5)]
    assert again[0] == again[1]
    twice = quality.score_quality(d.union(d), labels).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("score").alias("k")).collect()
    assert all((r.n, r.k) == (2, 1) for r in twice)
    assert quality.score_quality(docs(spark, []), labels).count() == 0
    assert quality.score_quality(d, labels.filter("false")).count() == len(data) + 4


def test_factorisation_identity():
    m = quality.FactorisationMachine()
    flat, values, offsets = np.array([1, 5, 9, 2, 5]), np.array([0.5, 1.0, 2.0, 1.0, 3.0]), np.array([0, 3, 5])
    for k, got in enumerate(m.raw(flat, values, offsets)):
        f, x = flat[offsets[k] : offsets[k + 1]], values[offsets[k] : offsets[k + 1]]
        pairs = sum((m.v[f[a]] @ m.v[f[b]]) * x[a] * x[b] for a in range(len(f)) for b in range(a + 1, len(f)))
        assert got == pytest.approx(m.w[f] @ x + pairs)


def test_warc(spark, tmp_path):
    big, rng = "é" * 700, random.Random(9)
    noise = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(50_000))
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "u\r\nX: y", "small"), (6, "http://d", None), (7, "", ""), (8, "n", noise), (9, "n2", noise), (None, "x", big)]
    pages = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "page_id long, url string, html string, _first int, _digest string, _payload int").repartition(2)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "").encode() == p]
        first = max(same, default=None)
        again = len(p) >= 1000 and len(same) > 1 and i is not None and i != first
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, warc.warc_round_trip(pages).collect()))) == sorted(map(str, want))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path)
    for step in (64, 1000, 1 << 20):  # ranges that cut records and magics anywhere
        got = warc.read_warc(spark, path, step).select("record_id", "payload").collect()
        assert sorted(r[0] for r in got) == sorted(f"urn:page:{'' if r[0] is None else r[0]}" for r in rows)
        assert {r[0]: bytes(r[1]) for r in got}["urn:page:9"] == noise.encode()
    files = sorted((tmp_path / "warc").glob("part-*.warc.gz"))
    assert len(files) == len(list((tmp_path / "warc").glob("part-*")))
    members = b"".join(subprocess.run(["gzip", "-dc", str(p)], capture_output=True, check=True).stdout for p in files)
    assert members.count(b"WARC/1.1\r\n") == members.count(b"\r\nWARC-Date: 20") == len(rows)


def test_warc_ranges_have_tasks_of_their_own(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record("response", f"http://{i}", i, None, "x", bytes(50)) for i in range(300)))
    records = warc.read_warc(spark, f"file://{tmp_path}", 1000)
    used = records.groupBy(F.spark_partition_id()).count().count()
    assert records.count() == 300 and used > 20


def test_warc_large_records_and_repeated_ids(spark, tmp_path):
    large = "x" * (17 << 20)
    pages = spark.createDataFrame([(1, "u", large), (1, "u", "é" * 900), (2, "v", "é" * 900), (2, "v", "é" * 900)], "page_id long, url string, html string").repartition(1)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w", 1 << 20).select("record_id", "record_type", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [("urn:page:1", "response", len(large)), ("urn:page:1", "revisit", 1800), ("urn:page:2", "response", 1800), ("urn:page:2", "response", 1800)]
    file = next((tmp_path / "w").glob("part-*.warc.gz"))
    assert subprocess.run(["gzip", "-dc", str(file)], capture_output=True, check=True).stdout.count(b"WARC/1.1\r\n") == 4


def test_warc_reads_foreign_archives(spark, tmp_path):
    one = warc.record("response", "http://a", 1, None, "x", b"hello")
    fake = gzip.compress(b"not a record") + b"\x1f\x8b\x08junk"
    (tmp_path / "a.warc.gz").write_bytes(one + fake + one.replace(b"zz", b"zz") + b"\x1f\x8b")
    assert warc.read_warc(spark, f"file://{tmp_path}", 50).count() == 2


def test_mixing(spark, rows):
    d = docs(spark, rows)
    out = mixing.mix(d, weights={"a": 1.0, "b": 3.0}, repetition=4.0, seed=11)
    assert out.columns == [*[c for c in d.columns if c != "copy_no"], "copy_no", "shuffle_key"]
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7), weights={"a": 1.0, "b": 3.0}, repetition=4.0, seed=11).collect()))
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    assert all(r.source in ("a", "b") for r in got)
    sizes = Counter(s for _, _, s in rows)
    n, per = len(rows), Counter(r.source for r in got)
    for s, w in (("a", 0.25), ("b", 0.75)):
        mean = 4.0 * n * w
        assert abs(per[s] - mean) < 6 * mean**0.5 + sizes[s]
    lam, draws = 2.5, 20_000
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(lam))).first()[0]
    assert cdf[-1] == pytest.approx(1) and cdf[1] == pytest.approx(np.exp(-lam) * (1 + lam))
    u = spark.range(draws).select(F.size(F.filter(mixing.poisson_cdf(F.lit(lam)), lambda c: c <= mixing.hashed_uniform(F.col("id").cast("string")))).alias("n"))
    assert u.agg(F.avg("n")).first()[0] == pytest.approx(lam, abs=0.06)
    assert mixing.mix(docs(spark, [])).count() == 0
    with pytest.raises(Exception, match="500"):
        mixing.mix(d, repetition=1e6).count()


def test_mixing_joins_alike(spark, rows):
    d = docs(spark, rows)
    few, threshold = sorted(map(str, mixing.mix(d).collect())), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a large table of sources
    try:
        assert sorted(map(str, mixing.mix(d).collect())) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_mixing_rare_source_of_a_large_table(spark, tmp_path):
    """One row of a rare source gets a mean of about 630: equal to the SQL; and the exact draw where the mean is 20,000."""
    import duckdb

    d = spark.range(400_001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") > 0, "web").alias("source"), F.lit(1).alias("n_chars"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op6(spark, str(tmp_path))
    digest = out.groupBy("source").agg(F.count(F.lit(1)), F.sum("doc_id"), F.sum("copy_no"), F.min("shuffle_key"), F.max("shuffle_key"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT source, count(*), sum(doc_id), sum(copy_no), min(shuffle_key), max(shuffle_key) FROM ({mixing.OP6_SQL}) GROUP BY 1").fetchall()
    assert sorted(map(str, (tuple(r) for r in digest.collect()))) == sorted(map(str, want))
    assert next(r[1] for r in want if r[0] is None) > 500

    few = d.filter("doc_id < 20000")
    got = mixing.mix(few, weights={"": 1.0}).agg(F.count(F.lit(1)), F.max("copy_no")).first()
    u, n, low = int(hashlib.md5(b"7:0").hexdigest()[:13], 16) / 2**52, 0, 0.0
    while (low := low + math.exp(n * math.log(20000.0) - 20000.0 - math.lgamma(n + 1))) <= u:
        n += 1
    assert tuple(got) == (n, n)


def brute_near(rows, k, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in rows:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80)])
def test_near_dedup(spark, rows, k, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    got = minhash.near_dedup(docs(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    want = brute_near([(i, t) for i, t, _ in rows if i is not None], k, percent)
    assert {tuple(r) for r in got if r[0] is not None} == {(i, *v) for i, v in want.items()}
    assert all(r.kept and r.component_id is None for r in got if r[0] is None)
    assert minhash.near_dedup(docs(spark, [])).count() == 0


def test_one_id_on_different_texts(spark):
    """Rows are told apart by their texts: no link is lost and no unique text goes."""
    rng = random.Random(12)
    a, b, c = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c + " z"), (0, c), (0, "quite another text")]
    got = minhash.near_dedup(docs(spark, [(i, t, "s") for i, t in rows]), 4, 80, with_sha=True).collect()
    of = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
    comps = {(r.doc_id, of[r.text_sha256]): (r.component_id, r.kept) for r in got}
    assert comps == {(1, a): (1, True), (1, b): (1, True), (2, a + " x"): (1, False), (3, b + " y"): (1, False), (4, c): (0, False), (4, c + " z"): (0, False), (0, c): (0, True), (0, "quite another text"): (0, True)}

    data = [(42, "same text"), (50, "same text"), (42, "a quite different one")]
    got = {(r.doc_id, r.kept, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, [(i, t, "s") for i, t in data]), keep="largest").collect()}
    assert got == {(42, False, 2), (50, True, 2), (42, True, 1)}

    x, y = [1.0, 0.1, 0.0], [0.0, 0.1, 1.0]
    vectors = spark.createDataFrame([(1, x, 0), (1, y, 0), (2, [1.0, 0.11, 0.0], 0), (3, [0.0, 0.11, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embed_dedup.near_vectors(vectors).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_exact_dedup_with_a_full_filter(spark, rows, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "_places", lambda digests, bits: np.zeros((len(digests), 4), np.int64))
    assert sorted(map(str, exact_dedup.exact_dedup(docs(spark, rows)).collect())) == want


def test_multikey_quicksort_orders_like_lexsort():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2000):
        group, words = np.sort(rng.integers(0, n // 20 + 1, n)), rng.integers(0, 4, (n, 4)).astype(np.uint64)
        order, tied = suffix_dedup.multikey_quicksort(group, words)
        want = np.lexsort((*words.T[::-1], group))
        assert (words[order] == words[want]).all() and (group[order] == group[want]).all()
        same = (words[order][1:] == words[order][:-1]).all(1) & (group[order][1:] == group[order][:-1])
        assert ((np.diff(tied) == 0) == same).all()


def test_long_unbroken_text(spark):
    """A text of a million characters without a break, in every operator on texts."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    d = spark.createDataFrame([(1, long), (2, long + "q"), (3, "short text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, P.path("byte_bpe_50k.json")).collect()}
    assert got == {1: len(t.encode(long).ids), 2: len(t.encode(long + "q").ids), 3: 2}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in bpe_trie.encode_decode(d, P.path("word_bpe_49k.json")).collect()}[1] == len(t.encode(long, add_special_tokens=False).ids)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(d).collect()} == {1: (1_000_000, 1), 2: (1_000_000, 1), 3: (0, 0)}
    assert toxicity.score_toxicity(d, labels).count() == quality.score_quality(d, labels).count() == 3
    assert minhash.near_dedup(d).filter("kept").count() == exact_dedup.exact_dedup(d).filter("kept").count() == 3


def test_index_brings_all_near_signatures_together():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 16, minhash.POSITIONS)
    for _ in range(300):
        b = a.copy()
        b[rng.choice(minhash.POSITIONS, minhash.DISTANCE, replace=False)] += 1
        assert any((a[k] == b[k]).all() for k in minhash.KEPT)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    comp = {x: x for e in edges for x in e}
    find = lambda x: x if comp[x] == x else find(comp[x])
    import sys

    sys.setrecursionlimit(5000)
    for a, b in edges:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert got == {x: find(x) for x in comp if x in got} and set(comp) - set(got) <= loops
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base, rows = rng.normal(size=(12, 16)), []
    for i in range(400):
        v = base[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 2.0)
        rows.append((i, v.tolist(), int(i % 4 == 0)))
    rows += [(500, rows[1][1], rows[1][2]), (501, rows[1][1], rows[1][2]), (502, rows[1][1], 1 - rows[1][2]), (503, None, 1), (504, [0.0] * 16, 1), (505, [float("nan")] + [1.0] * 15, 1), (506, [None] + [1.0] * 15, 1), (507, [1.0] * 16, None), (508, [], 1), (509, [1.0, 2.0], 1), (None, rows[1][1], 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, rep string, comp int, u int").repartition(3)
    fine = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    comp, n = {i: i for i, *_ in rows if i is not None}, Counter()
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a, (i, x, y) in enumerate(fine):
        for j, z, w in fine[a + 1 :]:
            if y == w and len(x) == len(z) and x @ z / np.sqrt(x @ x) / np.sqrt(z @ z) >= 0.93:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    got = {r[0]: tuple(r[1:]) for r in embed_dedup.near_vectors(df).collect()}
    assert got.pop(None) == (0, None, True)
    want = {i: (n[i], find(i), find(i) == i) for i in comp}
    links = sum(n.values())
    assert sum(g[0] for g in got.values()) >= 0.9 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    size = Counter(c for _, c, _ in want.values())
    dense = [i for i in want if size[want[i][1]] > 2 * embed_dedup.NEIGHBOURS]  # enlarged, so no link is missing there
    assert len(dense) > 100 and all(got[i] == want[i] for i in dense)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("start", ["no link", "a chain"])
def test_near_vectors_audits_direct_links(spark, monkeypatch, start):
    """Groups too small for a full list: a start that finds nothing, or connects each group but misses most links."""
    rng, rows = np.random.default_rng(4), []
    for g in range(12):
        base = rng.normal(size=16)
        rows += [(10 * g + i, (base + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(6)]
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "ROUNDS", 2)

    def chain(reps, least, turn=0):  # of the classes, which have numbers of their own
        rep = {r.low: r.rep for r in reps.select("low", "rep").collect()}
        ends = [(rep[10 * g + i], rep[10 * g + i + 1]) for g in range(12) for i in range(5)] if start == "a chain" else []
        return spark.createDataFrame([(min(e), max(e), 0.99, 2) for e in ends], embed_dedup.PAIRS)

    monkeypatch.setattr(embed_dedup, "seed_links", chain)
    monkeypatch.setattr(embed_dedup, "local_joins", lambda lists, reps, turn, least: spark.createDataFrame([], embed_dedup.PAIRS))
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(i, 5, i - i % 10, i % 10 == 0) for i, *_ in rows]


def test_near_vectors_finds_rare_links(spark):
    """20,000 vectors of one label, 40 planted pairs: a sample sees next to none of the links. The same rows come from
    any partitioning."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x[1::2][:40] = x[::2][:40] + 0.385 * rng.normal(size=(40, 64)) * np.linalg.norm(x[::2][:40], axis=1)[:, None] / 8
    u = x[:80] / np.linalg.norm(x[:80], axis=1)[:, None]
    close = (u[::2] * u[1::2]).sum(1) >= 0.93
    assert 15 <= close.sum()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = []
    for parts in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(parts)
        got.append(sorted(map(tuple, embed_dedup.near_vectors(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1]
    found = sum(r[1] for r in got[0])
    assert 0.98 * 2 * close.sum() <= found <= 2 * close.sum()


def test_near_vectors_of_extreme_size(spark):
    rows = [(i, [s * 1.0, s * (1 + i / 1000), s * 0.5], 1) for i, s in enumerate((1e200, 1e200, 1e-200, 1e-200, 1e308, 1.0))] + [(9, [-1e200, 0.0, 1e200], 1)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(i, 5, 0, i == 0) for i in range(6)] + [(9, 0, 9, True)]
