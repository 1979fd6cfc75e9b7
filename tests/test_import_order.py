"""Imports one record after another, and running values, against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noticelake.operators import linkage, running

from .test_functions import record


def plain_import(stored, incoming):
    """One record after another: (outcome, target, match status) of each."""
    base = {"source_kind": "municipality", "publication_date": "2026-01-05", "parcel": "", "address": "", "project_type": "", "workflow_status": "new"}
    full = lambda r: base | {"source_reference": r["rec_id"]} | r
    table, of, out = {}, {}, {}
    for r in sorted(map(full, stored), key=lambda r: r["rec_id"]):
        table[r["rec_id"]] = r
        of.setdefault((r["source_kind"], r["source_reference"]), r["rec_id"])

    def linked(a, b):
        same = lambda *fields: all(a[f] and a[f] == b[f] for f in fields)
        open_ = not (a["publication_date"] and b["publication_date"])
        kinds = "import" not in (a["source_kind"], b["source_kind"]) and not a["source_kind"] == b["source_kind"] == "authority"
        return kinds and b["workflow_status"] != "archived" and (same("publication_date", "parcel") or same("publication_date", "address") or open_ and (same("parcel", "project_type") or same("address", "project_type")))

    for r in sorted(map(full, incoming), key=lambda r: r["rec_id"]):
        ref = (r["source_kind"], r["source_reference"])
        if ref in of:
            host = table[of[ref]]
            table[of[ref]] = r | {k: host[k] for k in ("rec_id", "source_kind", "source_reference", "workflow_status")}
            out[r["rec_id"]] = ("update", of[ref], "matched")
            continue
        found = [i for i, b in table.items() if linked(r, b)]
        if len(found) == 1:
            of[ref] = found[0]
            out[r["rec_id"]] = ("merge", found[0], "matched")
        else:
            of[ref] = r["rec_id"]
            table[r["rec_id"]] = r | {"workflow_status": "new"}
            out[r["rec_id"]] = ("insert", r["rec_id"], "ambiguous" if found else "matched")
    return out


def got(spark, stored, incoming):
    # records of the linkage have a town each; references are given or the record's own id
    return {r.rec_id: (r.outcome, r.target_id, r.match_status) for r in linkage.import_in_order(record(spark, stored), record(spark, incoming)).collect()}


def test_later_records_see_earlier_ones(spark):
    stored = [{"rec_id": "s1", "source_kind": "authority", "parcel": "1"}, {"rec_id": "s2", "source_reference": "r2", "parcel": "2"}]
    incoming = [
        {"rec_id": "t1", "parcel": "9"}, {"rec_id": "t2", "parcel": "9"},  # the second finds the first
        {"rec_id": "t3", "source_reference": "r2", "parcel": "3"}, {"rec_id": "t4", "parcel": "2"},  # the update took parcel 2 away
        {"rec_id": "t5", "parcel": "3"},  # and brought parcel 3
        {"rec_id": "t6", "source_reference": "r6", "parcel": "1"}, {"rec_id": "t7", "source_reference": "r6", "parcel": "5"}, {"rec_id": "t8", "parcel": "1"}, {"rec_id": "t9", "parcel": "5"},  # an update of the host
        {"rec_id": "u1", "source_kind": "import", "parcel": "9"},
    ]
    want = {
        "t1": ("insert", "t1", "matched"), "t2": ("merge", "t1", "matched"), "t3": ("update", "s2", "matched"), "t4": ("insert", "t4", "matched"), "t5": ("merge", "s2", "matched"),
        "t6": ("merge", "s1", "matched"), "t7": ("update", "s1", "matched"), "t8": ("insert", "t8", "matched"), "t9": ("merge", "s1", "matched"), "u1": ("insert", "u1", "matched"),
    }
    assert plain_import(stored, incoming) == want == got(spark, stored, incoming)
    assert linkage.import_in_order(record(spark, stored), record(spark, incoming).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_import_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)

    def made(prefix, n):
        return [{
            "rec_id": f"{prefix}{i:04}", "source_kind": rng.choice(["authority", "municipality", "municipality", "import"]), "source_reference": f"r{rng.randrange(120)}" if prefix == "t" else f"r{i * 7}", "parcel": rng.choice(["", str(rng.randrange(40))]),
            "address": rng.choice(["", f"weg {rng.randrange(40)}"]), "project_type": rng.choice(["", "haus", "stall"]), "publication_date": rng.choice(["", "2026-01-05", "2026-01-06", "2026-01-07"]), "workflow_status": rng.choice(["new", "new", "archived"]) if prefix == "s" else "new",
        } for i in range(n)]

    stored, incoming = made("s", 40), made("t", 160)
    want = plain_import(stored, incoming)
    assert got(spark, stored, incoming) == want
    assert len({o for o, _, _ in want.values()}) == 3 and "ambiguous" in {m for *_, m in want.values()}


def test_running_values(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 20}", rng.randrange(10**6), rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(5)
    got = running.running(df, ["g"], [F.desc("t"), F.col("v")], {"s": ("sum", F.col("v")), "x": ("xor", F.col("v"))}).collect()
    later = running.running(df, ["g"], [F.desc("t"), F.col("v")], {"m": ("max", F.col("v"))}, own=False).collect()
    groups = defaultdict(list)
    for g, t, v in rows:
        groups[g].append((-t, v))
    want, want_later = [], []
    for g, own in groups.items():
        s = x = 0
        m = None
        for t, v in sorted(own):
            want_later.append((g, -t, v, m))
            s, x, m = s + v, x ^ v, v if m is None else max(m, v)
            want.append((g, -t, v, s, x))
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(str, map(tuple, later))) == sorted(map(str, want_later))
    placed = running.place(df, ["g"], [F.asc("t"), F.asc("v")]).groupBy("g").agg(F.max("place").alias("n"), F.count_distinct("place").alias("d"), F.count(F.lit(1)).alias("c")).collect()
    assert all(r.n == r.d == r.c for r in placed) and len(placed) == len(groups)


def test_records_that_share_no_key_leave_the_merge(spark):
    cols = "rec_id string, source_kind string, workflow_status string, municipality string, publication_date string, parcel string, address string, project_type string, touched boolean, created_at string"
    alone = [(f"z{i}", "municipality", "new", "Aarau", "2026-01-01", f"Parzelle {i}", f"Weg {i}", "Haus", False, None) for i in range(40)]
    near = [(i, k, "new", "Aarau", p, "Parzelle 99", "", "Stall", False, None) for i, k, p in (("a", "authority", "2026-02-01"), ("b", "municipality", ""), ("c", "import", ""))]
    apart = [(i, "municipality", "new", "Baden", p, "Parzelle 7", "", "Stall", False, None) for i, p in (("d", "2026-02-01"), ("e", "2026-03-01"))]  # both dated: neither rule holds
    rows = spark.createDataFrame(alone + near + apart, cols)
    keyed = linkage.keyed(rows.filter("source_kind <> 'import'"), "rec_id")
    assert sorted(r.id for r in linkage.sharing(keyed).collect()) == ["a", "b"]
    assert [tuple(r) for r in linkage.merge_duplicates(rows).collect()] == [("b", "a")]
