"""Hard negatives and exact top-k against their SQL and against brute force, on hard rows and in many blocks."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import exact_topk, hard_negatives, vector_blocks

SF = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<float>, label int, id long, h int, v string, score long, rank int, slot int, code int"


def same(spark, query, sql, folder):
    got = query(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet{'' if folder == SF else '/*.parquet'}')")
    out = con.execute(sql)
    assert [c[0] for c in out.description] == got.columns
    want = sorted(out.fetchall())
    assert sorted(map(tuple, got.collect())) == want
    return want


QUERIES = [(hard_negatives.op11, hard_negatives.OP11_SQL), (exact_topk.op12, exact_topk.OP12_SQL)]


@pytest.mark.parametrize("query,sql", QUERIES)
def test_given_table(spark, query, sql):
    assert len(same(spark, query, sql, SF)) > 20


def hard_rows():
    rng = random.Random(7)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(None, [0.5, 1.0], 1), (1, None, 1), (2, [], 1), (3, [0.5, None, 1.0], 1), (4, [float("nan"), 1.0], 2), (5, [float("inf"), 1.0], 2), (100, [0.0] * 6, 1), (200, [-1.0] * 6, 1)]
    rows += [(300, near[0], 3), (300, near[0], 3), (350, [30.0, -2e4, 1.0], 2), (400, [], 0)]
    rows += [(i, near[0], rng.randrange(3)) for i in range(1000, 1400)]  # a group of copies
    for i in range(401, 900):
        v = [x + rng.gauss(0, rng.choice([0, 0.05, 0.5])) for x in rng.choice(near)]
        rows.append((i, v[: rng.choice([6, 6, 6, 4])], rng.choice([0, 1, 2, 3, 9, None])))
    rows += [rows[-1], rows[-2]]
    return [(*r, 7, 8, "x", 1, 2, 3, 4) for r in rows]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("query,sql", QUERIES)
def test_hard_rows(spark, tmp_path, monkeypatch, query, sql, small):
    if small:  # several blocks, stripes and pieces; cells' edges from few rows, so that values leave them
        monkeypatch.setattr(vector_blocks, "QUERY_VALUES", 24)
        monkeypatch.setattr(vector_blocks, "STRIPE", 300)
        monkeypatch.setattr(vector_blocks, "SCORES", 100)
        monkeypatch.setattr(exact_topk, "FIRST", 1)
        real = exact_topk.cell_edges
        monkeypatch.setattr(exact_topk, "cell_edges", lambda rows, extent, bits, n: real(rows, extent, bits, 40))
    data = spark.createDataFrame(hard_rows(), TABLE).repartition(5)
    data.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(same(spark, query, sql, str(tmp_path))) > 50
    if not small:
        data.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
        assert query(spark, f"{tmp_path}/none").count() == 0


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    v, q = rng.integers(-300, 300, (500, 12)), rng.integers(-300, 300, (40, 12))
    edges = np.sort(rng.integers(-200, 200, (12, 17)), axis=1)
    edges[:, -1] += 1
    cells = exact_topk.Cells(edges, 4)
    packed, excess = cells.encode(v)
    assert packed.shape == (500, 6)
    middle, reach = cells.decode(packed)
    far = np.abs(q) @ reach.T + 2 * np.abs(q).sum(axis=1)[:, None] * excess
    exact = 2 * q @ v.T
    assert (np.abs(exact - q @ middle.T) <= far).all()


def test_scores_beyond_a_long_are_refused(spark):
    rows = spark.createDataFrame([(50, [1e30, 1.0], 1), (51, [1e30, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(OverflowError):
        exact_topk.top_k(rows, F.col("id") % 50 == 0)


def test_inner_products_are_exact():
    rng = np.random.default_rng(5)
    for size in (10, 10**4, 10**6, 10**8):
        a, b = rng.integers(-size, size, (7, 20)), rng.integers(-size, size, (9, 20))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert vector_blocks.inner(a, b).tolist() == want
