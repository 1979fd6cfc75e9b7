"""Cases of the rules for a project's name."""

import pytest
from pyspark.sql import functions as F

from noticelake.operators import projects as P

CASES = {  # text, fallback, address, page -> project
    ("Bauvorhaben: Neubau Mehrfamilienhaus Bauherr: Muster", "", "", ""): "Neubau Mehrfamilienhaus",
    ("Bauherr: Muster Bauobjekt: Anbau Balkon. Standort: Dorf 3", "", "", ""): "Anbau Balkon",
    ("Bauprojekt Carport, Rainweg 4 Frist: 3.4.2026", "", "Rainweg 4", ""): "Carport",
    ("Erteilte Baubewilligungen der Gemeinde", "", "", ""): "Nicht importieren",
    ("beliebiger text", "", "", ""): "Baugesuch",
    ("", "", "", ""): "Baugesuch",
    (None, None, None, None): "Baugesuch",
    ("beliebiger text", "Umbau Scheune", "", ""): "Umbau Scheune",
    ("beliebiger text", "01.02.2026", "", ""): "Baugesuch",
    ("beliebiger text", "2026-02-01", "", ""): "Baugesuch",
    ("beliebiger text", "Carport 2026", "", ""): "Carport 2026",
    ("beliebiger text", "News der Woche", "", ""): "Baugesuch",
    ("beliebiger text", "w" * 130, "", ""): "w" * 119 + "…",
    ("Gemeinde / Baugesuch 12 / Umbau Scheune / Dorf", "", "", ""): "Umbau Scheune",
    ("Gemeinde / Baugesuch 12", "", "", ""): "Baugesuch",
    ("Baugesuch / Download", "Sitzplatz", "", "https://a.ch/pool.html"): "Sitzplatz",
    ("Baugesuch, Meier Hans, Kirchweg 3", "Kirchweg 3", "Kirchweg 3", "https://a.ch/pool.html"): "Baugesuch",
    ("Meier Hans; Wintergarten - Frist bis 3.4.", "", "", ""): "Wintergarten",
    ("Meier Hans, Neubau Garage, Kirchweg 3, Baden", "", "Kirchweg 3", ""): "Neubau Garage",
    ("Meier Hans; Archiv", "", "", "https://a.ch/x/umbau-wohnhaus_3.pdf?y=1"): "umbau wohnhaus 3",
    ("Mitteilung", "Mitteilung", "", "https://a.ch/anbau%20stall/"): "anbau stall",
    ("Mitteilung", "Mitteilung", "", "kein/ort"): "Mitteilung",
    ("Mitteilung; Mai 2026", "", "", ""): "Baugesuch",
    ("Meier; Pool (ohne Profilierung), BG 2025-12", "", "", ""): "Pool",
    ("Meier; Dach (Süd), A+B-Weg 3 Ost", "", "A+B-Weg 3", ""): "Dach (Süd) Ost",
}


def test_project_names(spark):
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(CASES)], "i int, t string, f string, a string, u string")
    got = dict(map(tuple, rows.select("i", P.project_name(F.col("t"), F.col("f"), F.col("a"), F.col("u")).alias("p")).collect()))
    assert {k: got[i] for i, k in enumerate(CASES)} == CASES


@pytest.mark.parametrize(("project", "n"), [("", 0), (None, 0), ("Nicht importieren", 0), ("Baugesuch", 1), ("Neubau Halle", 2)])
def test_specificity(spark, project, n):
    assert spark.range(1).select(P.specificity(F.lit(project).cast("string"))).first()[0] == n
