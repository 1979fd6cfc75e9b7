"""Gazetteer matches and the ladder of a location repair, by cases and against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticelake.operators import gazetteer as G

ENTRY = "entry_id long, label string, detail string, origin string, x double, y double, rank int"


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("x")).alias("v")).collect())]


def test_tokens(spark):
    assert column(spark, G.loose, ["Küttigen (AG)", "Beinwil am See", None, "Böttstein", "St. Ursen"]) == ["kuettigen", "beinwilamsee", "", "boettstein", "stursen"]
    cases = {
        "Hauptstrasse 12": "hauptstrasse", "Bauplatz: Dorfstrasse": "dorfstrasse", "Seckistrasse": "seckistrasse", "Neubau": "", "": "", "Am Hof": "", "12345": "", "Winkelried, Oberer Weg": "winkelried",
        "Mühleweg (hinten)": "muehleweg", "Kirchgasse/Dorfgasse 1": "kirchgasse",
    }
    assert column(spark, G.street_token, list(cases)) == list(cases.values())
    cases = {"Hauptstrasse 12": True, "Hauptstrasse": False, "Hauptstrasse 12a": True, "Hauptstrasse 5000": False, "Weg, 3.4.2024": False, "Weg 3, am 3. Mai 2024": True, "": False}
    assert column(spark, G.has_house_number, list(cases)) == list(cases.values())
    cases = {"Parzelle 12": "12", "Parzellen Nrn. 7": "7", "Parzelle Nr. 1234567": "", "Weg 3": ""}
    assert column(spark, G.parcel_token, list(cases)) == list(cases.values())
    cases = {"Hauptstrasse 12": True, "Parzelle 7": True, "12a": False, "Haus Nr. 3": True, "Neubau Hauptstrasse 1": False, "Kanzlei": False, "Dorf": True, "Oben 7": True, "Adresse prüfen": False}
    assert column(spark, G.can_ask, list(cases)) == list(cases.values())


def test_matches_by_cases(spark):
    entries = spark.createDataFrame([
        (1, "Hauptstrasse 12 5000 Aarau", None, "address", 2645000.0, 1249000.0, 1), (2, "Dorfweg 3 5000 Aarau", None, None, 1250000.0, 2646000.0, 2), (3, "Aarau", None, "gg25", 2645001.0, 1249001.0, 0),
        (4, "Rombachweg 4 Rombach", "rombachweg 4 5022 rombach 4008 kuettigen ch ag", "address", 2645002.0, 1249002.0, 1), (5, "Seestrasse 1 Beinwil am See", None, "address", 2645003.0, 1249003.0, 1),
        (6, "Hofweg 1 Birrhard", None, "address", 2645004.0, 1249004.0, 1), (7, "Parzelle 77 Birr", None, "parcel", 2645005.0, 1249005.0, 1), (8, "Hauptstrasse 1 Aarau", None, "address", None, 1249005.0, 0),
        (9, "Hauptstrasse 9 5000 Aarau", None, "zipcode", 2645006.0, 1249006.0, 0), (10, "Rain 2 Birr", None, "address", 2645007.0, 1249007.0, 3), (11, "Hinterrain 2 Birr", None, "address", 2645008.0, 1249008.0, 1),
    ], ENTRY)
    cases = {
        ("Aarau", "Hauptstrasse 12"): (2645000.0, "precise"), ("Aarau", "Hauptstrasse"): (2645006.0, "approximate"), ("Aarau (AG)", "Dorfweg 3"): (2646000.0, "precise"), ("Zürich", "Hauptstrasse 12"): None,
        ("Küttigen", "Rombachweg 4"): (2645002.0, "precise"), ("Beinwil am See", "Seestrasse 1"): (2645003.0, "precise"), ("Birr", "Hofweg 1"): None, ("Birrhard", "Hofweg 1"): (2645004.0, "precise"),
        ("Birr", "Parzelle 77"): (2645005.0, "precise"), ("Birr", "Parzelle 7"): None, ("Birr", "Rain 2"): (2645007.0, "precise"), ("Aarau", "Umbau"): None, (None, "Hauptstrasse 12"): None, ("Aarau", None): None, ("", "Hauptstrasse 12"): None,
    }
    requests = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "id int, municipality string, address string")
    got = {r.id: (r.x, r.precision) for r in G.match_addresses(requests, entries, "id").collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}
    assert {r.id for r in G.match_addresses(requests, entries, "id", approximate=False).collect()} == {i for i, v in enumerate(cases.values()) if v and v[1] == "precise"}
    assert G.match_addresses(requests, entries.limit(0), "id").count() == 0 == G.match_addresses(requests.limit(0), entries, "id").count()


def loose(x):
    x = (x or "").lower().replace("(ag)", "")
    return re.sub("[^a-z0-9]", "", x.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue"))


def test_matches_against_a_plain_loop(spark):
    rng = random.Random(2)
    towns = ["Birr", "Birrhard", "Beinwil am See", "Küttigen", "Aarau", "Aarauhof", "Unterkulm", "Kulm"]
    streets = ["Hauptstrasse", "Alte Hauptstrasse", "Rain", "Oberer Rain", "Hofweg", "Neuhofweg", "Hof"]
    entries = [(i, f"{rng.choice(streets)} {rng.randrange(30)} {rng.choice(towns)}", rng.choice([None, rng.choice(towns).lower()]), rng.choice(["address", "gg25", None]), rng.choice([None, 2600000.0 + i, 2600000.0 + i]), 1200000.0, rng.randrange(20)) for i in range(400)]
    requests = [(i, rng.choice(towns), rng.choice([f"{rng.choice(streets)} {rng.randrange(30)}", rng.choice(streets), f"Parzelle {rng.randrange(30)}"])) for i in range(150)]
    want = {}
    for i, town, address in requests:
        town, best = loose(town), None
        parcel = address.split()[1] if address.startswith("Parzelle") else ""
        street = "" if parcel else max((loose(w) for w in address.split() if len(loose(w)) >= 4 and re.search("[a-z]", w)), key=lambda w: (bool(re.search("(strasse|weg|rain|hof)$", w)), len(w)), default="")
        for e, label, detail, origin, x, y, rank in entries:
            text = f"{label} {detail or ''}"
            tokens = [loose(w) for w in text.split()]
            fits = (town in tokens or len(town) >= 8 and town in loose(text)) and (parcel and parcel in [re.sub(r"\D", "", w) for w in text.split()] or street and (street in loose(text) if len(street) >= 6 else street in tokens))
            if x and fits:
                vague = origin == "gg25" or not (parcel or re.search(r"\d", address))
                best = min(best or (2,), (vague, rank, e, x))
        if best:
            want[i] = (best[3], "approximate" if best[0] else "precise")
    got = G.match_addresses(spark.createDataFrame(requests, "id int, municipality string, address string"), spark.createDataFrame(entries, ENTRY).repartition(3), "id")
    assert {r.id: (r.x, r.precision) for r in got.collect()} == want and len(want) > 40


def steps(spark, **texts):
    row = {"address": "", "parcel": "", "project_type": "", "description": "", "source_text": None} | texts
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    cols = [F.col(c) for c in ("address", "parcel", "project_type", "description")]
    c = G.ladder(cols, F.col("source_text") if row["source_text"] else None)
    return [(s.kind, list(s.queries), s.repair_address, s.repair_parcel) for s in df.select(c).first()[0]]


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        ({}, []),
        ({"parcel": "12"}, [("parcel", ["12"], "", "12")]),
        ({"address": "Adresse prüfen", "parcel": "12"}, [("parcel", ["12"], "Parzelle 12", "12")]),
        ({"address": "Adresse aus Amtsblatt prüfen", "description": "Parzellen Nrn. 12, 13 und 14"}, [("parcel-group", ["12", "13", "14"], "Parzellen 12, 13, 14", "12, 13, 14")]),
        ({"address": "Hauptstrasse 3, Zone W2"}, [("address", ["Hauptstrasse 3"], "Hauptstrasse 3", "")]),
        ({"address": "Hauptstrasse"}, [("weak-address", ["Hauptstrasse"], "Hauptstrasse", "")]),
        ({"project_type": "Anbau Standort: Dorfgasse 4 Zone: W", "address": "Adresse prüfen"}, [("address", ["Dorfgasse 4"], "Dorfgasse 4", "")]),
        ({"address": "Adresse prüfen", "source_text": "Bauherrschaft: X Bauplatz: Am Lindenplatz 7 Zone K2 Auflage vom"}, [("address", ["Am Lindenplatz 7"], "Am Lindenplatz 7", "")]),
        ({"address": "Adresse prüfen", "source_text": "Standort: Parzellen Nr. 5/6 Zone Frist 30 Parzelle 9"}, [("parcel-group", ["5", "6"], "Parzellen 5, 6", "5, 6"), ("address", ["Parzellen Nr. 5/6"], "Parzellen Nr. 5/6", "")]),
        ({"address": "Gemeinde Aarau"}, []),
    ],
)
def test_ladder(spark, texts, want):
    assert steps(spark, **texts) == want


def test_repair_takes_the_first_candidate_that_is_found(spark):
    parcels = spark.createDataFrame([(i, "", f"{n} 4001 {town} ch ag", "parcel", 2600000.0 + i, 1200000.0, 1) for i, (n, town) in enumerate([("12", "aarau"), ("13", "aarau"), ("14", "birr"), ("7", "kuettigen"), ("5", "aarau")])], ENTRY)
    addresses = spark.createDataFrame([(1, "Hauptstrasse 3 Aarau", None, "address", 2650000.0, 1250000.0, 1), (2, "Dorfgasse 4 Aarau", None, "address", 2650010.0, 1250000.0, 1)], ENTRY)
    rows = [
        (1, "Aarau", "Adresse prüfen", "", "", "Parzellen Nrn. 12 und 13", None),  # all parcels found
        (2, "Aarau", "Hauptstrasse 3", "", "", "Parzellen Nrn. 12 und 14", None),  # one is not: the address
        (3, "Aarau", "Hauptstrasse 99", "5", "", "", None),  # the parcel goes first
        (4, "Aarau", "Adresse prüfen", "", "", "", "Bauplatz: Dorfgasse 4 Zone W"),  # only the page tells
        (5, "Birr", "Hauptstrasse 3", "", "", "", None),  # another town
        (6, "Küttigen (AG)", "Adresse prüfen", "7", "", "", None),
        (7, None, None, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "id int, municipality string, address string, parcel string, project_type string, description string, source_text string")
    got = {r.id: (r.kind, r.query, r.x, r.precision, r.repair_address, r.repair_parcel) for r in G.repair_locations(records, addresses, parcels, "id").collect()}
    assert got == {
        1: ("parcel-group", "12, 13", 2600000.5, "precise", "Parzellen 12, 13", "12, 13"), 2: ("address", "Hauptstrasse 3", 2650000.0, "precise", "Hauptstrasse 3", ""), 3: ("parcel", "5", 2600004.0, "precise", "", "5"),
        4: ("address", "Dorfgasse 4", 2650010.0, "precise", "Dorfgasse 4", ""), 6: ("parcel", "7", 2600003.0, "precise", "Parzelle 7", "7"),
    }
    assert G.repair_locations(records.limit(0), addresses, parcels, "id").count() == 0


def test_verdicts_and_applied_repairs(spark):
    ring = [[{"x": float(x), "y": float(y)} for x, y in ((2600000, 1200000), (2600000, 1201000), (2601000, 1201000), (2601000, 1200000), (2600000, 1200000))]]
    areas = spark.createDataFrame([(1, 21, ring)], "area_id int, layer_id int, rings array<array<struct<x:double,y:double>>>")
    features = spark.createDataFrame([(1, 2650000.0, 1250000.0)], "feature_id int, fx double, fy double")
    point = lambda *ps: [{"query": str(i), "x": float(x), "y": float(y)} for i, (x, y) in enumerate(ps)]
    rows = [
        (1, "parcel-group", "", 2625000.0, 1225000.0, "precise", point((2600500, 1200500), (2650000, 1250000)), "Parzellen 1, 2", "1, 2"),  # a zone and a building
        (2, "parcel", "", 2600500.0, 1200500.0, "precise", point((2600500, 1200500)), "", "7"), (3, "weak-address", "", 2650200.0, 1250000.0, "approximate", point((2650200, 1250000)), "Weg", ""), (4, "address", "", 2700000.0, 1250000.0, "precise", point((2700000, 1250000)), "Weg 1", ""),
    ]
    repairs = spark.createDataFrame(rows, "id int, kind string, query string, x double, y double, precision string, points array<struct<query:string,x:double,y:double>>, repair_address string, repair_parcel string")
    verdicts = G.assess_repairs(repairs, areas, features, "id")
    assert {r.id: r.protection_status for r in verdicts.collect()} == {1: "combined-hit", 2: "protected-zone", 3: "manual-review", 4: "no-hit"}
    records = spark.createDataFrame([(i, "alt", "9", None, None, None, True, "manual-review") for i in range(1, 6)], "id int, address string, parcel string, east double, north double, location_precision string, ambiguous_address boolean, protection_status string")
    got = {r.id: tuple(r)[1:] for r in G.apply_repairs(records, verdicts, "id").collect()}
    assert got[1] == ("Parzellen 1, 2", "1, 2", 2625000.0, 1225000.0, "precise", False, "combined-hit") and got[2][:2] == ("alt", "7") and got[3][:2] == ("Weg", "9") and got[4][4:] == ("precise", False, "no-hit")
    assert got[5] == ("alt", "9", None, None, None, True, "manual-review")


def test_equal_entries_are_indexed_once(spark):
    rows = [(i, "Hauptstrasse 12 5000 Aarau", None, "address", 2645000.0 + i, 1249000.0, 90 - i % 9) for i in range(60)] + [(99, "Hauptstrasse 12 5000 Aarau", None, "zipcode", 2600000.0, 1249000.0, 0), (100, "Rain 1 Aarau", None, None, None, 1.0, 0)]
    entries = spark.createDataFrame(rows, ENTRY)
    texts = {(r.label, r.origin): r["first"].entry_id for r in G.first_entries(entries, F.col("label"), F.col("origin")).collect()}
    assert texts == {("Hauptstrasse 12 5000 Aarau", "address"): 8, ("Hauptstrasse 12 5000 Aarau", "zipcode"): 99}
    requests = spark.createDataFrame([(i, "Aarau", a) for i, a in enumerate(["Hauptstrasse 12"] * 3 + [None, "Rain 1"])], "id int, municipality string, address string")
    got = G.match_addresses(requests, entries, "id")
    assert sorted(map(tuple, got.collect())) == [(i, 2645008.0, 1249000.0, "precise") for i in range(3)]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # requests meet answers, not the entries' keys


def test_equal_records_are_located_once(spark):
    entries = spark.createDataFrame([(i, "Juchweg 4 Aarau", "12 4001 aarau", "address", 2645000.0 + i, 1249000.0, i % 7 + 1) for i in range(1, 30)], ENTRY)
    rows = [(i, "Aarau", "Juchweg 4", None if i % 2 else "", "", "", None) for i in range(6)] + [(9, "Aarau", "Adresse prüfen", "", "Parzelle 12", "", ""), (10, None, "Juchweg 4", "", "", "", "")]
    records = spark.createDataFrame(rows, "id int, municipality string, address string, parcel string, project_type string, description string, source_text string")
    got = G.repair_locations(records, entries, entries, "id")
    assert sorted((r.id, r.kind, r.x) for r in got.collect()) == [(i, "address", 2645007.0) for i in range(6)] + [(9, "parcel", 2645007.0)]
    assert "regexp" not in got._jdf.queryExecution().executedPlan().toString().lower()  # ladders are not built for each record


def test_equal_places_are_assessed_once(spark, monkeypatch):
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0))]
    areas = spark.createDataFrame([(1, 21, [ring])], "area_id int, layer_id int, rings array<array<struct<x:double,y:double>>>")
    features = spark.createDataFrame([(1, 5000.0, 5000.0)], "feature_id int, fx double, fy double")
    point = lambda x: {"query": "q", "x": x, "y": 5.0}
    repairs = spark.createDataFrame([(i, "precise", [point(5.0)] + [point(800.0)] * (i % 2)) for i in range(8)] + [(8, "approximate", [point(100.0)]), (9, "precise", [point(100.0)])], "id int, precision string, points array<struct<query:string,x:double,y:double>>")
    seen, assess = [], G.S.assess
    monkeypatch.setattr(G.S, "assess", lambda points, *a: seen.append(points.count()) or assess(points, *a))
    got = {r.id: r.protection_status for r in G.assess_repairs(repairs, areas, features, "id").collect()}
    assert got == {**{i: "protected-zone" for i in range(8)}, 8: "manual-review", 9: "no-hit"}
    assert seen == [4]
