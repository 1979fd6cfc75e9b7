"""Contract cases of the text, date, linkage, spatial and learning rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from noticelake.functions import dates, text
from noticelake.operators import learning, linkage, spatial, worklist


def one(spark, expr_of, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr_of(F.col("x"))).first()[0]


def evidence(spark, rows):
    cols = "grp string, rec_id string, source_kind string, match_status string, municipality string, publication_date string, deadline_date string, parcel string, address string, project_type string, observed_at string"
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize(
    ("given", "want"),
    [("Aarau (AG)", "aarau"), (" Brugg  AG ", "brugg"), ("Zürich", "zurich"), (None, ""), ("", ""), ("Lupfig-Dorf", "lupfig dorf")],
)
def test_municipality(spark, given, want):
    assert one(spark, text.municipality, given) == want


@pytest.mark.parametrize(("given", "want"), [("Parzelle Nr. 12", "12"), ("Parz. 4a", "4a"), ("GB 7", "7"), (None, ""), ("Grundstück 9", "9")])
def test_parcel(spark, given, want):
    assert one(spark, text.parcel, given) == want


def test_address(spark):
    assert one(spark, text.address, "Bahnhofstraße 3") == "bahnhofstra e 3"
    assert one(spark, text.address, "Bahnhofstrasse  3,") == "bahnhofstr 3"


@pytest.mark.parametrize(
    ("given", "want"),
    [("2024-02-29", "2024-02-29"), ("29.2.2024", "2024-02-29"), ("Montag, 3. März 2025", "2025-03-03"), ("31.2.2024", None), ("", None), (None, None), ("morgen", None)],
)
def test_date(spark, given, want):
    assert one(spark, dates.normalize, given) == (datetime.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize(
    ("given", "first", "last"),
    [
        ("vom 3.5. bis 2.6.2026", "2026-05-03", "2026-06-02"), ("20.12. - 18.1.2026", "2025-12-20", "2026-01-18"), ("nichts", None, None), (None, None, None), ("vom 1.2.2026 bis 3.3.", "2026-02-01", "2026-03-03"),
        ("Auflage vom 3. März bis 2. April 2024", "2024-03-03", "2024-04-02"), ("vom Freitag, 5. Juni 2026, bis Montag, 6. Juli 2026", "2026-06-05", "2026-07-06"),
        ("12. Dezember – 11. Januar 2025", "2024-12-12", "2025-01-11"), ("3. marz 2025 — 4. april 2025", "2025-03-03", "2025-04-04"), ("vom 31.2.2026 bis 3.3.2026", None, None), ("vom 3.5. bis 2.6.", None, None),
        ("vom 1.1.2020 bis 2.2.2020, jetzt 3.3.2020 - 4.4.2020", "2020-03-03", "2020-04-04"), ("20.12.2026 - 18.1.2026", "2026-12-20", "2026-01-18"),
    ],
)
def test_date_range(spark, given, first, last):
    got = dates.with_range(spark.createDataFrame([(given,)], "x string"), "x", "a", "b").select(F.col("a").cast("string"), F.col("b").cast("string")).first()
    assert tuple(got) == (first, last)


def test_status_table(spark):
    base = ("ok", "Aarau", "2026-01-05", "2026-02-05", "12", "Weg 1", "Haus", "t")
    def e(g, n, kind, **over):
        v = dict(zip(["match_status", "municipality", "publication_date", "deadline_date", "parcel", "address", "project_type", "observed_at"], base)) | over
        return (g, f"{g}{n}", kind, *(v[k] for k in ["match_status", "municipality", "publication_date", "deadline_date", "parcel", "address", "project_type", "observed_at"]))

    rows = [
        e("confirmed", 1, "authority"), e("confirmed", 2, "municipality"), e("town", 1, "municipality"), e("import", 1, "import"),
        e("conflict", 1, "authority"), e("conflict", 2, "municipality", parcel="13"), e("nopub", 1, "municipality", publication_date=""),
        e("unsure", 1, "authority"), e("unsure", 2, "municipality", match_status="ambiguous"),
        e("fill", 1, "authority", parcel=""), e("fill", 2, "municipality", parcel="77", publication_date=""),
    ]
    got = {r.grp: r.reconciliation_status for r in linkage.group_status(evidence(spark, rows), "grp").collect()}
    assert got == {"confirmed": "authority-confirmed", "town": "municipality-only", "import": "import-review", "conflict": "conflict-review", "nopub": "missing-publication", "unsure": "ambiguous-review", "fill": "authority-confirmed"}
    gold = {r.grp: r for r in linkage.golden_record(evidence(spark, rows), "grp", ["observed_at", "rec_id"]).collect()}
    assert gold["fill"].parcel == "77" and gold["conflict"].parcel == "12" and gold["nopub"].publication_date == ""


def test_link_rules(spark):
    cols = "rec_id string, municipality string, publication_date string, parcel string, address string, project_type string"
    inc = spark.createDataFrame([("a", "Aarau", "2026-01-05", "12", "", ""), ("b", "Aarau", "", "12", "", "Haus"), ("c", "Aarau", "2026-01-05", "", "", ""), ("d", "Brugg", "", "", "Weg 1", "Bau")], cols)
    cand = spark.createDataFrame([("x", "Aarau (AG)", "2026-01-05", "Parzelle 12", "Weg 1", "haus"), ("y", "Brugg", "2026-03-01", "", "Weg 1", "Bau"), ("z", "Brugg", "2026-03-01", "", "Weg 1", "Bau")], cols)
    pairs = linkage.link_pairs(inc, cand)
    assert {tuple(r) for r in pairs.collect()} == {("a", "x", 0), ("b", "x", 2), ("d", "y", 3), ("d", "z", 3)}
    status = linkage.link_status(inc.withColumn("source_kind", F.lit("municipality")), cand.withColumn("source_kind", F.lit("authority")))
    got = {r.incoming_id: (r.link_status, r.matched_id) for r in status.collect()}
    assert got == {"a": ("matched", "x"), "b": ("matched", "x"), "c": ("none", None), "d": ("ambiguous", None)}


def test_polygon_with_hole(spark):
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rings = [ring((0, 0), (0, 10), (10, 10), (10, 0), (0, 0)), ring((2, 2), (8, 2), (8, 8), (2, 8), (2, 2))]
    points = [(1.0, 1.0, True), (5.0, 5.0, False), (11.0, 5.0, False), (9.0, 5.0, True)]
    df = spark.createDataFrame([(rings, x, y, w) for x, y, w in points], "r array<array<struct<x:double,y:double>>>, x double, y double, w boolean")
    assert all(r[0] == r[1] for r in df.select(spatial.inside(F.col("r"), F.col("x"), F.col("y")), "w").collect())


def test_retention_boundary(spark):
    df = spark.createDataFrame([("a", "2026-05-01", "new"), ("b", "2026-04-30", "new"), ("c", "2026-01-01", "cleared"), ("d", None, "new")], "id string, p string, workflow_status string").withColumn("publication_date", F.to_date("p"))
    got = {r.id: r.workflow_status for r in worklist.archive_expired(df, F.lit("2026-06-01").cast("date")).collect()}
    assert got == {"a": "new", "b": "archived", "c": "cleared", "d": "new"}


def test_confidence_steps(spark):
    rows = [(1, "zone"), (2, "zone"), (3, "point"), (4, "point"), *((i, "point") for i in range(5, 20))]
    df = spark.createDataFrame([("m", "a", "p", s, i) for i, s in rows], "municipality_key string, address_signature string, project_signature string, protection_status string, n int")
    fold = lambda n: learning.fold_rules(df.filter(F.col("n") <= n), ["n"]).first()
    assert (fold(1).confidence, fold(2).confidence, fold(3).confidence, fold(4).confidence, fold(19).confidence) == (0.82, 0.86, 0.72, 0.76, 0.98)
    assert fold(19).match_count == 19


def test_regex_cost(spark):
    import time

    from noticelake.operators import extract

    long = "Bauherrschaft: " + "a " * 100_000
    t = time.time()
    spark.createDataFrame([(long,)], "body string").transform(extract.fields).collect()
    assert time.time() - t < 20


RECORD = "rec_id string, source_kind string, source_reference string, municipality string, publication_date string, deadline_date string, parcel string, address string, project_type string, workflow_status string, assignee string, note string, created_at string"


def record(spark, rows):
    base = {"source_kind": "municipality", "municipality": "Aarau", "publication_date": "2026-01-05", "deadline_date": "", "parcel": "", "address": "", "project_type": "", "workflow_status": "new", "assignee": "", "note": "", "created_at": "2026-01-01"}
    names = [c.split()[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple((base | {"source_reference": r["rec_id"]} | r)[n] for n in names) for r in rows], RECORD)


def test_import_upsert_keeps_the_teams_work(spark):
    stored = record(spark, [
        {"rec_id": "s1", "source_kind": "authority", "parcel": "12", "workflow_status": "under-review", "assignee": "team", "note": "seen"},
        {"rec_id": "s2", "source_reference": "r2", "address": "Weg 1", "workflow_status": "cleared", "note": "done"},
        {"rec_id": "s3", "source_kind": "authority", "parcel": "30"}, {"rec_id": "s4", "source_kind": "authority", "parcel": "30"},
    ])
    incoming = record(spark, [
        {"rec_id": "i1", "source_reference": "r2", "address": "Weg 2"},  # known reference
        {"rec_id": "i2", "parcel": "Parzelle 12"},  # one candidate
        {"rec_id": "i3", "parcel": "30"},  # two candidates
        {"rec_id": "i4", "source_reference": "new", "address": "Gasse 1"}, {"rec_id": "i5", "source_reference": "new", "address": "Gasse 2"},
        {"rec_id": "i6", "source_kind": "import", "parcel": "12"},
    ])
    outcomes = linkage.import_outcomes(stored, incoming).cache()
    got = {r.rec_id: (r.outcome, r.target_id, r.match_status) for r in outcomes.collect()}
    assert got == {"i1": ("update", "s2", "matched"), "i2": ("merge", "s1", "matched"), "i3": ("insert", "i3", "ambiguous"), "i4": ("insert", "i4", "matched"), "i5": ("update", "i4", "matched"), "i6": ("insert", "i6", "matched")}
    table = {r.rec_id: r for r in linkage.import_upsert(stored, incoming, outcomes, F.lit("2026-02-02")).collect()}
    assert set(table) == {"s1", "s2", "s3", "s4", "i3", "i4", "i6"}
    assert {i: r.change_type for i, r in table.items()} == {"s1": None, "s2": "updated", "s3": None, "s4": None, "i3": "imported", "i4": "imported", "i6": "imported"}
    assert (table["s2"].address, table["s2"].workflow_status, table["s2"].note, table["s2"].created_at) == ("Weg 2", "cleared", "done", "2026-01-01")
    assert table["i4"].address == "Gasse 2" and table["s1"].assignee == "team" and table["s1"].last_sync_at is None and table["s2"].last_sync_at == "2026-02-02"
    evidence = {tuple(r) for r in linkage.import_evidence(incoming, outcomes).collect()}
    assert evidence == {("s2", "municipality", "r2", "matched"), ("s1", "municipality", "i2", "matched"), ("i3", "municipality", "i3", "ambiguous"), ("i4", "municipality", "new", "matched"), ("i6", "import", "i6", "matched")}


def test_duplicate_merge_chooses_hosts(spark):
    rows = record(spark, [
        {"rec_id": "a", "source_kind": "authority", "parcel": "1"}, {"rec_id": "b", "parcel": "1"},  # authority hosts
        {"rec_id": "c", "source_kind": "authority", "parcel": "2"}, {"rec_id": "d", "parcel": "2", "note": "x"},  # the touched one hosts
        {"rec_id": "e", "source_kind": "authority", "parcel": "3", "note": "x"}, {"rec_id": "f", "parcel": "3", "note": "x"},  # both touched
        {"rec_id": "g", "address": "Weg 4", "created_at": "2026-01-02"}, {"rec_id": "h", "address": "Weg 4"},  # the older one hosts
        {"rec_id": "i", "source_kind": "import", "parcel": "1"}, {"rec_id": "j", "parcel": "6", "workflow_status": "archived"}, {"rec_id": "k", "source_kind": "authority", "parcel": "6"},
        {"rec_id": "l", "source_kind": "authority", "parcel": "7"}, {"rec_id": "m", "source_kind": "authority", "parcel": "7"}, {"rec_id": "n", "parcel": "7"},  # two candidates
    ])
    merged = linkage.merge_duplicates(rows.withColumn("touched", worklist.is_touched()))
    assert {tuple(r) for r in merged.collect()} == {("b", "a"), ("c", "d"), ("g", "h"), ("k", "j")}
    reads = spark.createDataFrame([("a", "u1"), ("b", "u1"), ("b", "u2"), ("n", "u1")], "rec_id string, user string")
    assert sorted(map(tuple, linkage.repoint(reads, merged, "rec_id", ["user"]).collect())) == [("a", "u1"), ("a", "u2"), ("n", "u1")]
    assert linkage.merge_duplicates(rows.limit(0).withColumn("touched", F.lit(False))).count() == 0


def test_duplicate_merge_against_brute_force(spark):
    """Random records: no pair that may merge is left, every merged record's host stays, and hosts hold what linked."""
    import random

    rng = random.Random(3)
    data = [{"rec_id": f"r{i:03}", "source_kind": rng.choice(["authority", "municipality", "municipality"]), "parcel": str(rng.randrange(200)), "address": f"Weg {rng.randrange(200)}", "created_at": f"2026-01-{rng.randrange(1, 28):02}", "note": rng.choice(["", "", "x"])} for i in range(150)]
    rows = record(spark, data).withColumn("touched", worklist.is_touched())
    host = {r.rec_id: r.host_id for r in linkage.merge_duplicates(rows).collect()}
    of = {d["rec_id"]: d for d in data}
    left = [d for d in data if d["rec_id"] not in host]
    assert len(host) > 10 and not set(host.values()) & set(host)
    for d in left:
        if d["source_kind"] == "authority":
            continue
        found = [c for c in left if c is not d and (c["parcel"] == d["parcel"] or c["address"] == d["address"])]
        assert len(found) != 1 or (found[0]["note"] and d["note"])
    assert not any(of[r]["note"] and of[h]["note"] for r, h in host.items() if not any(h == x for x in host))


def test_many_term_rules(spark):
    from noticelake.operators import extract

    rules = spark.createDataFrame([(i, f"term{i}.", None) for i in range(1500)], "rule_id int, include string, exclude string")
    docs = spark.createDataFrame([(i, f"a term{i * 7}. b") for i in range(200)], "doc_id int, text string")
    assert {(r.doc_id, r.rule_id) for r in extract.term_rules(docs, rules, "text").collect()} == {(i, i * 7) for i in range(200)}


@pytest.mark.parametrize(
    ("given", "want"),
    [("Neubau Mehrfamilienhaus mit Pergola", "gross"), ("Wärmepumpe beim Einfamilienhaus", "klein"), ("Umbau EFH", "mittel"), ("Abbruch Scheune", "nicht-klassiert"), ("Erweiterung SCHULHAUS", "gross"), ("Ladestation", "klein"), (None, "nicht-klassiert")],
)
def test_project_scale(spark, given, want):
    from noticelake.operators import extract

    assert one(spark, extract.project_scale, given) == want


@pytest.mark.parametrize(
    ("text", "url", "want"),
    [
        ("Suchergebnisse 1 bis 10", "https://a.ch/suche", True), ("Suchergebnisse", "https://a.ch/detail/12", False), ("Protokoll der Gemeindeversammlung", "", True),
        ("Protokoll zum Baugesuch", "", False), ("Mitteilungsblatt mit Baugesuch", "", True), ("Plangenehmigungsverfahren", "", True), ("Baugesuch Nr. 3", "https://a.ch/bno/x", True),
        ("Neubau Garage", "https://a.ch/baugesuche", False), ("", "https://a.ch/bno/", False), (None, None, False),
    ],
)
def test_off_topic(spark, text, url, want):
    from noticelake.operators import extract

    assert spark.createDataFrame([(text, url)], "t string, u string").select(extract.is_off_topic(F.col("t"), F.col("u"))).first()[0] is want


@pytest.mark.parametrize(("given", "want"), [('<p class="x">', True), ("data-id", True), ("%PDF-1.4", True), ("a\ufffdb\ufffd", True), ("a\ufffdb", False), ("Neubau", False), (None, False), ("/publikation", True)])
def test_markup_junk(spark, given, want):
    from noticelake.operators import extract

    assert one(spark, extract.markup_junk, given) is want


def test_source_rules(spark):
    from noticelake.operators import extract

    docs = spark.createDataFrame([(1, "s", "Der Hund"), (2, "s", "ein Hund und Copyright"), (3, "s", "Katze"), (4, "x", "Katze"), (5, None, "Katze"), (6, "s", None)], "id int, source string, text string")
    rules = spark.createDataFrame([("s", "hund| maus ", "copyright")], "source string, include string, exclude string")
    assert sorted(r.id for r in extract.source_rules(docs, rules, "text").collect()) == [1, 4, 5]


def test_keys_search_a_value_once(spark):
    from noticelake.functions import text

    rows = spark.createDataFrame([(" Alte\t Hauptstrasse -- 3 ", "Parz. Nr. GB 12/a", "Rück­bau,  Haus"), (None, None, None), ("Strasse_1", "nr nr nr 7", "")], "a string, p string, j string")
    keys = rows.select(text.address(F.col("a")).alias("a"), text.parcel(F.col("p")).alias("p"), text.project(F.col("j")).alias("j"))
    assert [tuple(r) for r in keys.collect()] == [("alte hauptstr 3", "12a", "ruck bau haus"), ("", "", ""), ("str 1", "7", "")]
    searches = lambda c: rows.select(c.alias("k"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(")
    assert searches(text.address(F.col("a"))) == searches(text.project(F.col("j"))) == 1


def test_ranges_are_read_once(spark):
    from noticelake.functions import dates

    rows = spark.createDataFrame([("Auflage vom 1. Februar bis 3. März 2024",), ("28.12. - 5.1.2025",), ("vom 31.2. bis 3.3.2024",), (None,)], "body string")
    found = dates.with_range(rows, "body", "p", "q").filter("p is not null or q is not null")
    assert sorted((str(r.p), str(r.q)) for r in found.collect()) == [("2024-02-01", "2024-03-03"), ("2024-12-28", "2025-01-05")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[–—-]") <= 2  # a filter on the ends does not search again; nullif names its value twice
