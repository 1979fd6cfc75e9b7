"""Evidence that is attached to records, and rows that go because their source left them out: single cases."""

from noticelake.operators import linkage, worklist

EVIDENCE = "app_id string, source_kind string, source_reference string, observed_at int"
ROW = "id int, source string, municipality string, source_reference string, workflow_status string, assignee string, note string"


def test_own_evidence_comes_first(spark):
    make = lambda *rows: spark.createDataFrame(rows, EVIDENCE)
    records = make(("a", "town", "1", 5), ("b", "town", "2", 5), ("c", "town", "3", 5), ("d", "town", "4", 5))
    old = make(("b", "town", "2", 1), ("a", "town", "4", 9), ("x", "paper", "p9", 1), ("c", "paper", "p3", 1))
    foreign = make(("a", "paper", "p1", 7), ("b", "paper", "p2", 7), ("a", "paper", "p3", 0), ("b", "paper", "p1", 6), ("d", "paper", "p4", 7), ("nobody", "paper", "p5", 7))
    got = {tuple(r) for r in linkage.attach_evidence(records, old, foreign).collect()}
    assert got == {
        ("a", "town", "1", 5), ("b", "town", "2", 1), ("d", "town", "4", 5), ("x", "paper", "p9", 1),  # own: new, there already, taken back; untouched
        ("a", "paper", "p1", 7), ("b", "paper", "p2", 7), ("a", "paper", "p3", 0), ("d", "paper", "p4", 7),  # foreign: the later one, moved from c
    }
    assert linkage.attach_evidence(records, old.limit(0), foreign.limit(0)).count() == 0


def test_prune_only_where_rows_came(spark):
    row = lambda i, town, ref, status="new", note="": (i, "web", town, ref, status, "", note)
    stored = spark.createDataFrame([row(1, "A", "r1"), row(2, "A", "r2"), row(3, "A", "r3", "open"), row(4, "A", "r4", "new", "x"), row(5, "A", "r5"), row(6, "B", "r6"), row(7, "C", "r7"), row(8, None, "r8"), row(9, "A", None), row(10, "D", "r1")], ROW)
    configs = spark.createDataFrame([("web", "A", True), ("web", "B", True), ("web", "C", False), ("web", "", True), ("web", "D", True)], "source string, municipality string, prune boolean")
    delivered = spark.createDataFrame([("web", "A", " r1 "), ("web", "C", "n"), ("web", None, "n"), ("web", "D", "")], "source string, municipality string, source_reference string")
    said = spark.createDataFrame([(5,), (5,)], "id int")
    left = worklist.prune_untouched(stored, delivered, configs, said)
    assert sorted(r.id for r in left.collect()) == [1, 3, 4, 5, 6, 7, 8] and left.columns == stored.columns
    assert worklist.prune_untouched(stored, delivered.limit(0), configs, said).count() == 10
