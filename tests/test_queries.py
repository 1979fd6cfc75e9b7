"""Every registered query outside the llm subpackage against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from noticelake.plans import registry
from noticelake.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat().removesuffix("T00:00:00")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    want = [dict(zip(names, r, strict=True)) for r in out.fetchall()]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert sorted(str([plain(r[c]) for c in columns]) for r in rows) == sorted(str([plain(r[c]) for c in columns]) for r in want)


def test_entry(spark):
    import __spark_entry__

    assert {r[0] for r in __spark_entry__.entry(spark).collect()} <= {"none", "matched", "ambiguous"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


EMPTY = ["b4_audit_sink", "k5_online_learning", "k3_active_by_timer", "e21_gazetteer_tokens", "j11_location_ladder", "j1_import_in_order", "i39_assembled_polygons", "e16_point_in_assembled", "h1_worklist_order", "i22_resolve_urls", "j18_discovery"]


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0
