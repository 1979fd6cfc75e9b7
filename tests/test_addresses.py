"""Cases of the address rules."""

import pytest
from pyspark.sql import functions as F

from noticelake.operators import addresses as A


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("x")).alias("v")).collect())]


SANITIZED = {
    "Hauptstrasse 15": "Hauptstrasse 15", ", Bahnhofstrasse 7,": "Bahnhofstrasse 7", "01.02.2026": "", "": "", None: "", "Mai 2026": "", "vom 1. Mai 2026 bis 3. Juni 2026": "", "Hauptstrasse 3 öffentliche Auflage vom 3.": "Hauptstrasse 3",
    "Bauherr: Meier, Kirchweg 4": "Kirchweg 4", "Parzelle Nr. 12, Dorfgasse 3": "Dorfgasse 3", "Parz. 77": "Parzelle 77", "Dorfgasse 3, 5000 Aarau": "Dorfgasse 3,", "Facebook": "", "Newsarchive": "", "Baugesuche": "", "Baugesuch Rainweg 2": "Baugesuch Rainweg 2",
    "Gemeindekanzlei": "Gemeindekanzlei", "Kanzlei": "", "Kanzlei Parzelle 5": "Parzelle 5", "Herunterladen": "", "BG 2024-12": "", "Gebäude Nr. 12a, Oberdorf 3": "Oberdorf 3", "Oberdorf 3 Zone W2": "Oberdorf 3", "???": "", "Erteilte Baubewilligungen": "",
}
TEXTS = {
    "Standort: Bahnhofstrasse 7 Bauherr: Muster": "Bahnhofstrasse 7", "Neubau an der Hauptstrasse 12 in Baden": "Hauptstrasse 12", "": "", None: "", "Bauplatz: Parzelle 12 Zone: W": "Parzelle 12", "Bauplatz: 12, Kirchweg 3 Bauobjekt: Haus": "Kirchweg 3",
    "Lage: Im Grund Frist: 3 Hauptstrasse 9": "Hauptstrasse 9", "Bauplatz: Parzelle Nr. 5, Rainweg 8a Frist: 30 Tage": "Rainweg 8a", "Keine Angaben": "", "Auf dem Oberen Berg 14 wird gebaut": "Oberen Berg 14", "Baustelle: Dorfplatz, BG 2024.12 Bauherr: X": "Dorfplatz",
}
TITLES = {"Baugesuch / Bahnhofstrasse 7": "Bahnhofstrasse 7", "": "", "Bahnhofstrasse 7 / Kirchweg 2 / Umbau": "Kirchweg 2", "Umbau": ""}
PAGES = {
    "https://a.ch/baugesuche/bg-2024-12-kirchweg-3.html": "Kirchweg 3", "https://a.ch/neubau_hauptstrasse_7b/4711": "Hauptstrasse 7b", "https://a.ch/": "", "kein": "", None: "", "https://a.ch/M%C3%BChleweg-2?x=1": "Mühleweg 2",
}
CHOICES = {("Parzelle 5", "Hauptstrasse 7"): "Hauptstrasse 7", ("", "Hauptstrasse 7"): "Hauptstrasse 7", ("Hauptstrasse 7", ""): "Hauptstrasse 7", ("Hauptstrasse 7", "Parzelle 5"): "Hauptstrasse 7", ("Hauptstrasse", "Oberdorf 3"): "Oberdorf 3", ("Kirchweg 3", "Kirchweg 3 / Rainweg 1"): "Kirchweg 3 / Rainweg 1", ("Kirchweg 3", "Rainweg 12"): "Kirchweg 3"}


@pytest.mark.parametrize(("f", "cases"), [(A.sanitize, SANITIZED), (A.from_text, TEXTS), (A.from_title, TITLES), (A.from_url, PAGES)], ids=["sanitize", "text", "title", "url"])
def test_cases(spark, f, cases):
    assert dict(zip(cases, column(spark, f, list(cases)), strict=True)) == cases


def test_choice_and_import(spark):
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(CHOICES)], "i int, a string, b string")
    got = {r.i: r.v for r in rows.select("i", A.best([F.col("a"), F.col("b")]).alias("v")).collect()}
    assert [got[i] for i in range(len(CHOICES))] == list(CHOICES.values())
    stored = {("hauptstrasse 15", ""): "Hauptstrasse 15", ("Hauptstrasse 15", None): "Hauptstrasse 15", ("", "1376"): "Parzelle 1376", ("Baugesuch-Nr 5", "1376"): "Parzelle 1376", ("Neubau Garage", ""): "", ("x" * 130, "7"): "Parzelle 7", ("Dorf 3a", "7"): "Dorf 3a"}
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(stored)], "i int, a string, p string")
    got = {r.i: r.v for r in rows.select("i", A.imported(F.col("a"), F.col("p")).alias("v")).collect()}
    assert [got[i] for i in range(len(stored))] == list(stored.values())
    one = spark.createDataFrame([("Bauplatz: Parzelle 12", "Umbau / Kirchweg 2", "https://a.ch/x"), (None, None, "https://a.ch/rainweg-4")], "t string, h string, u string")
    assert [r[0] for r in one.select(A.ladder(F.col("t"), F.col("h"), F.col("u"))).collect()] == ["Kirchweg 2", "Rainweg 4"]
