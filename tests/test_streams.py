"""Streaming jobs over several batches, a second run, and a batch that comes again."""

import datetime

import pytest
from pyspark.sql import functions as F

from noticelake.operators import learning
from noticelake.streaming import jobs

SCHEMA = "key string, n int, ts timestamp"


def day(d):
    return datetime.datetime(2024, 1, d)


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/in"


def test_ingest_merges_batches_and_runs(spark, folder, tmp_path):
    home = f"file://{tmp_path}/home"
    put(spark, folder, [("a", 1, day(1)), ("b", 1, day(5))])
    put(spark, folder, [("a", 2, day(2)), ("c", 1, day(1))])
    put(spark, folder, [("b", 2, day(3))])  # late: the older row does not win
    run = lambda: {tuple(r) for r in jobs.ingest(jobs.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1), "key", "ts", home, 4).collect()}
    want = {("a", 2, day(2)), ("b", 1, day(5)), ("c", 1, day(1))}
    assert run() == want
    assert run() == want  # nothing new
    put(spark, folder, [("c", 9, day(9)), ("a", 2, day(2))])
    assert run() == {("a", 2, day(2)), ("b", 1, day(5)), ("c", 9, day(9))}
    again = spark.createDataFrame([("c", 9, day(9)), ("a", 1, day(1))], SCHEMA)
    jobs.merge_into(f"{home}/table", "key", "ts", 4)(again, 0)  # a batch that was done before
    assert run() == {("a", 2, day(2)), ("b", 1, day(5)), ("c", 9, day(9))}


def test_repeats_are_suppressed_across_runs(spark, folder, tmp_path):
    home = f"file://{tmp_path}/home"
    run = lambda: sorted((r.key, r.n) for r in jobs.suppress_repeats(jobs.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1), "key", "ts", "31 days", home).collect())
    put(spark, folder, [("a", 1, day(1)), ("b", 1, day(2))])
    put(spark, folder, [("a", 2, day(3))])
    assert run() == [("a", 1), ("b", 1)]
    put(spark, folder, [("b", 3, day(4)), ("c", 1, day(4))])
    assert run() == [("a", 1), ("b", 1), ("c", 1)]


def test_late_rows_and_notifications(spark, folder, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    put(spark, folder, [("a", 1, day(1)), ("b", 1, day(19))])
    put(spark, folder, [("c", 1, day(25)), ("d", 1, None)])
    active, late = jobs.split_late(jobs.file_stream(spark, folder, schema, 1), "ts", "2024-01-20", 10, f"file://{tmp_path}/late")
    assert {tuple(r) for r in active.collect()} == {("b", 1, day(19)), ("c", 1, None), ("d", 1, None)} and [r.key for r in late.collect()] == ["a"]
    home = f"file://{tmp_path}/notes"
    run = lambda: [r.key for r in jobs.notifications(jobs.file_stream(spark, folder, schema, 1), F.col("key") != "b", ["ts", "key"], 2, home).collect()]
    assert run() == ["c", "a"]
    put(spark, folder, [("e", 1, day(30)), ("b", 1, day(31))])
    assert run() == ["e", "c"] and run() == ["e", "c"]
    kept = spark.read.schema(schema.add("batch", "long")).parquet(f"{home}/newest").groupBy("batch").count().collect()
    assert len(kept) == 3 and all(r["count"] <= 2 for r in kept)  # what a batch reads of those before it


def test_rules_are_learned_online(spark, folder, tmp_path):
    schema = "municipality_key string, address_signature string, project_signature string, protection_status string, n int"
    rows = [("m", f"a{k}", "p", ["zone", "point"][(i * k) // 7 % 2], i) for i in range(30) for k in range(4)]
    home = f"file://{tmp_path}/home"
    run = lambda: sorted(map(tuple, jobs.learn_online(jobs.file_stream(spark, folder, spark.createDataFrame([], schema).schema, 1), learning.KEY, "protection_status", ["n"], home).collect()))
    for a in (0, 8, 9):
        put(spark, folder, [r for r in rows if a <= r[-1] < {0: 8, 8: 9, 9: 20}[a]], schema)
    first = learning.fold_rules(spark.createDataFrame([r for r in rows if r[-1] < 20], schema), ["n"]).select(*learning.KEY, "protection_status", "match_count", "confidence")
    assert run() == sorted(map(tuple, first.collect()))
    put(spark, folder, [r for r in rows if r[-1] >= 20], schema)  # a second run goes on with the state
    every = learning.fold_rules(spark.createDataFrame(rows, schema), ["n"]).select(*learning.KEY, "protection_status", "match_count", "confidence")
    assert run() == sorted(map(tuple, every.collect()))


def test_records_expire_without_a_new_row(spark, folder, tmp_path):
    schema, home = spark.createDataFrame([], SCHEMA).schema, f"file://{tmp_path}/home"
    month = lambda m, d: datetime.datetime(2024, m, d)

    def run():
        changes, late = jobs.expire_active(lambda: jobs.file_stream(spark, folder, schema, 1), "key", "ts", 31, home)
        return sorted((r.key, r.ts, r.change) for r in changes.collect()), sorted((r.key, r.ts) for r in late.collect())

    put(spark, folder, [("a", 1, month(1, 1)), ("b", 1, month(1, 1)), ("a", 2, month(1, 10))])
    put(spark, folder, [("b", 2, month(1, 25))])
    changes, late = run()
    assert changes == [("a", month(1, 10), "active"), ("b", month(1, 1), "active"), ("b", month(1, 25), "active")] and late == []
    put(spark, folder, [("c", 1, month(2, 20))])  # no row of a: its time is over; b's is not
    put(spark, folder, [("a", 3, month(1, 5)), ("d", 1, month(2, 1))])  # a comes too late, d does not
    changes, late = run()
    assert ("a", month(1, 10), "expired") in changes and ("d", month(2, 1), "active") in changes and not [c for c in changes if c[0] == "b" and c[2] == "expired"]
    assert late == [("a", month(1, 5))] and ("a", month(1, 5), "active") not in changes
    put(spark, folder, [("a", 4, month(2, 25)), ("e", 1, month(4, 1))])  # a comes back, then all but e expire
    changes, late = run()
    last = {}
    for key, ts, change in changes:
        last[key] = max(last.get(key, (ts, change)), (ts, change))
    assert {k: v[1] for k, v in last.items()} == {"a": "expired", "b": "expired", "c": "expired", "d": "expired", "e": "active"}
    assert run() == (changes, late)
