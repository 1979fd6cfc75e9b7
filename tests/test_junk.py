"""Which records the junk rules take away, on made-up tables with a record for every address of the query."""

import datetime

import duckdb
import pytest

from noticelake.plans import registry, texts

NAME, DAY = "d15_junk_rules", datetime.date(2024, 1, 2)
JUNK = {"Januar 2024", "März 2023", "Folgen Sie uns auf Facebook", "Gemeinderatsnachrichten", "Newsweg 3", "Aktuelles aus dem Dorf", "Adresse von Webseite prüfen", "Vernehmlassung %k"}
#: a part for each address whose number is divisible by 7, so that the address is unclear; parts divisible by 11 carry a note
PARTS = {a: next(7 * n for n in range(1, 100) if 7 * n % len(texts.ADDRESSES) == i) for i, a in enumerate(texts.ADDRESSES)}
NOTHING = PARTS["Adresse von Webseite prüfen"]
#: order, part, supplier, kind of the evidence: untouched ones, and such without an address that are commented, taken up, assigned, or of a clear address
UNTOUCHED = [(100 + i, p, 4, "A") for i, p in enumerate(PARTS.values())]
TOUCHED = [(200, NOTHING, 4, "A"), (200, 1, 4, "R"), (201, NOTHING, 5, "A"), (202, NOTHING, 20, "A"), (203, NOTHING + 11, 4, "A")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("junk")
    lines = UNTOUCHED + TOUCHED
    orders, parts, suppliers, _ = (sorted(set(c)) for c in zip(*lines, strict=True))
    tables = {
        "lineitem": ([(o, n, p, s, DAY, f, 10.0) for n, (o, p, s, f) in enumerate(lines)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_returnflag string, l_quantity double"),
        "orders": ([(o, "O") for o in orders], "o_orderkey long, o_orderstatus string"),
        "part": ([(p, "brass", "STEEL") for p in parts], "p_partkey long, p_name string, p_type string"),
        "supplier": ([(s, 1) for s in suppliers], "s_suppkey long, s_nationkey int"),
    }
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{t}.parquet")
    return path


def kept_by_sql(folder):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(r[0] for r in con.execute(registry.oracle_sql()[NAME]).fetchall())


def test_every_junk_address_goes(spark, folder):
    ids = [r[0] for r in registry.queries()[NAME](spark, str(folder)).collect()]
    kept = {int(i.split("-")[0]) for i in ids}
    gone = {a for i, a in enumerate(texts.ADDRESSES) if 100 + i not in kept}
    assert gone == JUNK
    assert len(ids) == len(UNTOUCHED) + len(TOUCHED) - len(JUNK)
    assert {o for o, *_ in TOUCHED} <= kept
    assert sorted(ids) == kept_by_sql(folder)
