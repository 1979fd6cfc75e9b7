"""The pipeline against plain versions of its stages."""

import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from noticelake.llm import mixing, toxicity  # noqa: E402

from .test_operators import brute_near, labelled  # noqa: E402


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    data = [(i, t + f" tail{i}", y) for i, t, y in labelled(300)]
    data += [(1000 + i, data[i][1], data[i][2]) for i in range(20)]  # copies
    data += [(2000 + i, data[i][1] + " more", data[i][2]) for i in range(20)]  # near copies
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in data] + [(3000, None, "en", "s0", 0), (3001, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in data], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/out{k}")
        now = spark.read.parquet(f"{sf}/out{k}")
        seen.append([tuple(r) for r in now.collect()])
    clean = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if not r.predicted}
    assert {r[0] for r in seen[0]} == clean
    last = {}
    for i, t, *_ in seen[0]:
        last[t or ""] = max(i, last.get(t or "", -1))
    assert {r[0] for r in seen[1]} == set(last.values())
    near = brute_near([(r[0], r[1]) for r in seen[1]], 5, 80)
    assert {r[0] for r in seen[2]} == {i for i, v in near.items() if v[2]}
    assert sorted(map(str, seen[3])) == sorted(str(tuple(r)[:5]) for r in mixing.mix(spark.read.parquet(f"{sf}/out2")).collect())
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = {r[0]: r[1] or "" for r in seen[3]}
    for i, n, ids, decoded in seen[4]:
        e = t.encode(text[i], add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest())
    assert sorted(tuple(r) for r in pipeline.run(spark, sf).collect()) == sorted(seen[4])


def test_one_id_on_different_texts(spark, tmp_path):
    data = [(42, "same text"), (50, "same text"), (42, "a quite different one"), (None, "same text"), (42, None), (43, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.exact(spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(50, "same text"), (42, "a quite different one"), (None, "same text"), (43, "")}
    words = " ".join(f"w{i}" for i in range(40))
    data = [(1, words), (1, "something else that nobody has written before"), (2, words + " more"), (2, "one more text of its own kind here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], docs.schema)
    assert {(r.doc_id, r.text) for r in pipeline.near(spark, docs, str(tmp_path)).collect()} == {(i, t) for i, t in data if t != words + " more"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
