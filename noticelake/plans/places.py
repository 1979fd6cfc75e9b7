"""Queries on the gazetteer and on the repair of locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import duck as D
from ..functions import text as T
from ..operators import addresses as A
from ..operators import gazetteer as G
from ..operators import projects as P
from ..sources.work import written
from .register import query
from .spatial import areas

#: towns as entries write them in their label and in their detail, and the streets of the entries
TOWNS = [("Birr", "birr ch ag"), ("Birrhard", "birrhard ch ag"), ("Beinwil am See", "beinwil am see ch ag"), ("Rombach", "rombach 4008 kuettigen ch ag"), ("Aarau", "aarau ch ag"), ("Kulm", "unterkulm ch ag"), ("Hof", "hof bei kulm")]
STREETS = ["Hauptstrasse", "Alte Hauptstrasse", "Rain", "Hinterrain", "Mühleweg", "Im Feld", "Seckistrasse", "Juchweg", "Neuhofgasse"]
ORIGINS = ["address", None, "gg25", "address", "zipcode"]
#: requests: a municipality and an address; %k stands for a number
ASKED_TOWNS = ["Birr", "Birrhard (AG)", "Beinwil am See", "Küttigen", "AARAU", "Unterkulm", "Kulm", "Zürich", None, "Hof"]
ASKED = ["Hauptstrasse %k", "Rain %k", "Mühleweg", "Parzelle %k", "Seckistrasse %ka", "Umbau Hauptstrasse %k", "Im Feld 3", "Juchweg beim Brunnen", "", None, "%k", "Neuhofgasse %k"]


def entries(t):
    """An entry for every part and town in which it is sold; the number in it may be a house's or a parcel's."""
    sold = t.lineitem.select("l_suppkey", "l_partkey").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    k, n = F.col("l_partkey"), F.col("s_nationkey")
    rows = written(sold.select(k, n).distinct(), "entries")
    town = lambda i: T.pick(n, [x[i] for x in TOWNS])
    return rows.select(
        (k * 100 + n).alias("entry_id"), F.concat_ws(" ", T.pick(k, STREETS), (k % 97 + 1).cast("string"), F.lit("5000"), town(0)).alias("label"),
        F.concat_ws(" ", (k % 97 + 1).cast("string"), F.lit("4001"), town(1)).alias("detail"), T.pick(k, ORIGINS).alias("origin"),
        F.when(k % 11 != 0, F.when(k % 2 == 0, k + 2600000).otherwise(n + 1200000)).cast("double").alias("x"), F.when(k % 2 == 0, n + 1200000).otherwise(k + 2600000).cast("double").alias("y"), (k % 50).cast("int").alias("rank"),
    )


def loose_sql(x):
    for sign, letters in (("(ag)", ""), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        x = f"replace({x if sign != '(ag)' else f'lower(coalesce({x}, {chr(39) * 2}))'}, '{sign}', '{letters}')"
    return f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"


ENTRIES = f"""kn AS (SELECT DISTINCT l_partkey AS k, s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
e0 AS (SELECT k * 100 + n AS entry_id, {D.pick('k', STREETS)} || ' ' || (k % 97 + 1) || ' 5000 ' || {D.pick('n', [x[0] for x in TOWNS])} AS label, (k % 97 + 1) || ' 4001 ' || {D.pick('n', [x[1] for x in TOWNS])} AS detail,
 {D.pick('k', ORIGINS)} AS origin, CASE WHEN k % 11 <> 0 THEN CAST(k + 2600000 AS DOUBLE) END AS x, CAST(n + 1200000 AS DOUBLE) AS y, k % 50 AS rank FROM kn),
e AS (SELECT *, coalesce(origin IN ('gg25', 'zipcode'), false) AS coarse, {loose_sql("label || ' ' || detail")} AS hay, list_transform(string_split(label || ' ' || detail, ' '), lambda w: {loose_sql('w')}) AS toks,
 list_transform(string_split(label || ' ' || detail, ' '), lambda w: regexp_replace(w, '[^0-9]', '', 'g')) AS nums FROM e0 WHERE x IS NOT NULL)"""
#: per request of ASKED: street token, whether a parcel is asked for, whether a number stands in it, whether it is asked for
PARTS = [("hauptstrasse", False, True, True), ("rain", False, True, True), ("muehleweg", False, False, True), ("", True, True, True), ("seckistrasse", False, True, True), ("hauptstrasse", False, True, False), ("feld", False, True, True), ("juchweg", False, False, True), ("", False, False, False), ("", False, False, False), ("", False, False, False), ("neuhofgasse", False, True, True)]


@query("e21_gazetteer_tokens", f"""WITH {ENTRIES}, r AS (SELECT o_orderkey AS id, {loose_sql(D.pick('o_orderkey', ASKED_TOWNS))} AS town, {D.pick('o_orderkey', [p[0] for p in PARTS])} AS street,
 CASE WHEN {D.pick('o_orderkey', [p[1] for p in PARTS])} THEN CAST(o_custkey % 97 AS VARCHAR) ELSE '' END AS parcel, {D.pick('o_orderkey', [p[2] for p in PARTS])} AS numbered, {D.pick('o_orderkey', [p[3] for p in PARTS])} AS able FROM orders),
u AS (SELECT DISTINCT town, street, parcel, numbered FROM r WHERE able AND town <> ''),
f AS (SELECT u.*, entry_id, rank, x, y, coarse OR NOT (parcel <> '' OR numbered) AS vague FROM u JOIN e ON (list_contains(toks, town) OR (length(town) >= 8 AND contains(hay, town)))
 AND ((parcel <> '' AND list_contains(nums, parcel)) OR (street <> '' AND (list_contains(toks, street) OR (length(street) >= 6 AND contains(hay, street)))))),
b AS (SELECT *, row_number() OVER (PARTITION BY town, street, parcel, numbered ORDER BY vague, rank, entry_id) AS n FROM f QUALIFY n = 1)
SELECT id, x, y, CASE WHEN vague THEN 'approximate' ELSE 'precise' END AS precision FROM r JOIN b USING (town, street, parcel, numbered) WHERE able""")
def e21_tokens(t):
    """The gazetteer's entry for the municipality and address of every order."""
    k = F.col("o_orderkey")
    address = F.replace(F.element_at(F.array(*(F.lit(x) for x in ASKED)), (k % len(ASKED) + 1).cast("int")), F.lit("%k"), (F.col("o_custkey") % 97).cast("string"))
    requests = t.orders.select(k.alias("id"), T.pick(k, ASKED_TOWNS).alias("municipality"), address.alias("address"))
    return G.match_addresses(requests, entries(t), "id")


#: a record's address, project and page, and the steps that its ladder takes: kind and numbers or streets; %k stands for
#: the record's number, %m for the next
REPAIRS = [
    ("Adresse prüfen", "Parzellen Nrn. %k und %m", None, [("parcel-group", ["%k", "%m"])]),
    ("Hauptstrasse %k", "Parzellen Nrn. %k, 99 und %m", None, [("parcel-group", ["%k", "99", "%m"]), ("address", ["Hauptstrasse"])]),
    ("Seckistrasse", "", None, [("weak-address", ["Seckistrasse"])]),
    ("Adresse prüfen", "Parzelle %k", "Bauplatz: Juchweg %k Zone W", [("parcel", ["%k"]), ("address", ["Juchweg"])]),
    ("Adresse prüfen", "", "Bauherr: X Standort: Juchweg %k Auflage", [("address", ["Juchweg"])]),
    ("Nirgendwo", "", None, []),
]
STEPS = ", ".join(f"({i}, {p}, '{kind}', {s!r})" for i, r in enumerate(REPAIRS) for p, (kind, s) in enumerate(r[3]))


@query("j11_location_ladder", f"""WITH {ENTRIES},
r AS (SELECT o_orderkey AS id, {loose_sql(D.pick('o_orderkey', [x or '' for x in ASKED_TOWNS]))} AS town, o_custkey % 97 AS k, o_orderkey % {len(REPAIRS)} AS c FROM orders),
s AS (SELECT id, town, place, kind, len(qs) AS asked, replace(replace(unnest(qs), '%k', CAST(k AS VARCHAR)), '%m', CAST(k + 1 AS VARCHAR)) AS q FROM r JOIN (VALUES {STEPS}) v(i, place, kind, qs) ON i = c WHERE town <> ''),
d AS (SELECT id, town, place, kind, count(DISTINCT q) OVER (PARTITION BY id, place) AS asked, q FROM (SELECT DISTINCT * FROM s)),
lots AS (SELECT id, place, q, x, y FROM (SELECT DISTINCT town, q FROM s WHERE kind IN ('parcel', 'parcel-group')) a JOIN e ON string_split(detail, ' ')[1] = q AND contains({loose_sql('detail')}, town) JOIN s USING (town, q)
 WHERE kind IN ('parcel', 'parcel-group') QUALIFY row_number() OVER (PARTITION BY id, place, q ORDER BY rank, entry_id) = 1),
streets AS (SELECT id, place, q, x, y, coarse OR kind = 'weak-address' AS vague FROM s JOIN e ON (list_contains(toks, town) OR (length(town) >= 8 AND contains(hay, town))) AND contains(hay, lower(q))
 WHERE kind IN ('address', 'weak-address') QUALIFY row_number() OVER (PARTITION BY id, place ORDER BY coarse OR kind = 'weak-address', rank, entry_id) = 1),
found AS (SELECT id, place, q, x, y, false AS vague FROM lots UNION ALL SELECT * FROM streets),
each AS (SELECT d.id, d.place, d.kind, avg(x) AS x, avg(y) AS y, bool_or(vague) AS vague FROM d JOIN found USING (id, place, q) GROUP BY 1, 2, 3, asked HAVING count(*) = asked)
SELECT id, kind, round(x, 3) AS x, round(y, 3) AS y, CASE WHEN vague THEN 'approximate' ELSE 'precise' END AS precision FROM each QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1""")
def j11_ladder(t):
    """Where each order's record is found: the first step of its ladder of which every part is in the gazetteer."""
    return repairs(t).select("id", "kind", "x", "y", "precision")


def repairs(t):
    k = F.col("o_orderkey")
    n = F.col("o_custkey") % 97

    def text(i):
        x = F.element_at(F.array(*(F.lit(r[i]) for r in REPAIRS)), (k % len(REPAIRS) + 1).cast("int"))
        return F.replace(F.replace(x, F.lit("%k"), n.cast("string")), F.lit("%m"), (n + 1).cast("string"))

    records = t.orders.select(k.alias("id"), T.pick(k, ASKED_TOWNS).alias("municipality"), text(0).alias("address"), F.lit("").alias("parcel"), text(1).alias("project_type"), F.lit("").alias("description"), text(2).alias("source_text"))
    found = entries(t)
    return G.repair_locations(records, found, found, "id")


@query("j11_repair_verdicts")
def j11_verdicts(t):
    """How many repaired records get which verdict, by kind: assessed at all their points."""
    verdicts = G.assess_repairs(repairs(t), areas(t), t.gbl, "id")
    return verdicts.groupBy("kind", "protection_status").agg(F.count(F.lit(1)).alias("n"))


#: notices by their text, title and page, and the address that their ladder finds; %k stands for a number
NOTICES = [
    ("Standort: Bahnhofstrasse %k Bauherr: Muster", "Umbau", "https://a.ch/x", "Bahnhofstrasse %k"),
    ("Bauplatz: Parzelle %k Zone: W", "Umbau / Kirchweg 2", "https://a.ch/x", "Kirchweg 2"),
    ("Bauplatz: Parzelle %k Zone: W", "Umbau", "https://a.ch/x", "Parzelle %k"),
    ("", "Bahnhofstrasse 7 / Kirchweg %k / Umbau", "", "Kirchweg %k"),
    ("Keine Angaben", "", "https://a.ch/neubau_hauptstrasse_%k/4711", "Hauptstrasse %k"),
    (None, None, None, ""),
    ("Lage: Im Grund Frist: 3 Hauptstrasse %k", "Rainweg 1", "https://a.ch/rainweg-2.html", "Hauptstrasse %k"),
    ("Baugesuch: Neubau an der Hauptstrasse %k in Baden", "", "", "Hauptstrasse %k"),
    ("Baustelle: Dorfplatz Bauherr: X", "Anbau / Oberdorf %k", "", "Oberdorf %k"),
]


@query("i15_address_ladder", f"SELECT o_orderkey, replace({D.pick('o_orderkey', [n[3].replace('%k', '%n') for n in NOTICES])}, '%n', CAST(o_custkey % 90 + 1 AS VARCHAR)) AS address FROM orders")
def i15_ladder(t):
    """The most specific address of text, title and page."""
    k = F.col("o_orderkey")
    part = lambda i: F.replace(F.element_at(F.array(*(F.lit(n[i]).cast("string") for n in NOTICES)), (k % len(NOTICES) + 1).cast("int")), F.lit("%k"), (F.col("o_custkey") % 90 + 1).cast("string"))
    return t.orders.select("o_orderkey", A.ladder(part(0), part(1), part(2)).alias("address"))


#: raw addresses and what is stored of them
RAW = [
    (", Bahnhofstrasse %k,", "Bahnhofstrasse %k"), ("01.02.2026", "Parzelle %k"), ("hauptstrasse %k", "Hauptstrasse %k"), ("Bauherr: Meier, Kirchweg 4", "Kirchweg 4"), ("Parzelle Nr. 12, Dorfgasse 3", "Dorfgasse 3"), ("Facebook", "Parzelle %k"),
    ("Kanzlei Parzelle 5", "Parzelle 5"), ("Kanzlei", "Parzelle %k"), ("Gebäude Nr. 12a, Oberdorf 3", "Oberdorf 3"), ("Neubau Garage", "Parzelle %k"), ("Herunterladen", "Parzelle %k"), ("Rain 3 öffentliche Auflage vom 1.", "Rain 3"), ("Mai 2026", "Parzelle %k"), (None, "Parzelle %k"),
]


@query("i13_address_rules", f"SELECT o_orderkey, {D.pick('o_orderkey', [v for _, v in RAW])} AS address FROM orders")
def i13_rules(t):
    """Addresses as they are stored: cut, refused or replaced by the parcel."""
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", A.imported(T.pick(k, [v for v, _ in RAW]), k.cast("string")).alias("address"))


#: notices: text, a name given for it, address, page, and the project and its specificity
PROJECTS = [
    ("Bauvorhaben: Neubau Haus %k Bauherr: Muster", "", "", "", "Neubau Haus %k", 2), ("Bauprojekt Carport %k, Rainweg 4 Frist: 3.4.2026", "", "Rainweg 4", "", "Carport %k", 2), ("Erteilte Baubewilligungen der Gemeinde", "", "", "", "Nicht importieren", 0),
    ("beliebiger Text", "Umbau Scheune %k", "", "", "Umbau Scheune %k", 2), ("beliebiger Text", "01.02.2026", "", "", "Baugesuch", 1), ("Gemeinde / Baugesuch 12 / Umbau Scheune / Dorf", "", "", "", "Umbau Scheune", 2), ("Baugesuch / Download", "Sitzplatz %k", "", "https://a.ch/pool.html", "Sitzplatz %k", 2),
    ("Baugesuch, Meier Hans, Kirchweg 3", "Kirchweg 3", "Kirchweg 3", "https://a.ch/pool.html", "Baugesuch", 1), ("Meier Hans; Wintergarten %k - Frist bis 3.4.", "", "", "", "Wintergarten %k", 2), ("Meier Hans, Neubau Garage, Kirchweg %k, Baden", "", "Kirchweg %k", "", "Neubau Garage", 2),
    ("Meier Hans; Archiv", "", "", "https://a.ch/x/umbau-wohnhaus_%k.pdf?y=1", "umbau wohnhaus %k", 2), ("Mitteilung", "News der Woche %k", "", "kein/ort", "Baugesuch", 1), ("", "", "", "", "Baugesuch", 1), (None, None, None, None, "Baugesuch", 1),
]


@query("i21_project_name", f"SELECT o_orderkey, {D.pick('o_orderkey', [c[4] for c in PROJECTS])} AS project, CAST({D.pick('o_orderkey', [str(c[5]) for c in PROJECTS])} AS INTEGER) AS specificity FROM orders")
def i21_name(t):
    """The project of a notice by label, parts of its title, page or the given name, and how much it says."""
    part = lambda i: T.pick(F.col("o_orderkey"), [c[i] for c in PROJECTS])
    named = t.orders.select("o_orderkey", P.project_name(part(0), part(1), part(2), part(3)).alias("project"))
    return named.withColumn("specificity", P.specificity(F.col("project")))


#: texts, all their parcels, and the first one in the gazette's ways of writing
PARCELS = [
    ("Parzelle Nr. 1376", "1376", "1376"), ("Parzellen Nrn. 3733, 3769 und 12", "3733,3769,12", "3733"), ("Parz. 11/12", "11,12", "11"), ("Parzellen: 155", "155", "155"), ("ohne", "", ""), (None, "", ""), ("Parzelle Hornussen Nr. 689", "689", "689"),
    ("Parzelle 5, 5000 Aarau", "5", "5"), ("Parzelle 5 und Parz. 5, Parzelle 7", "5,7", "5"), ("Kat.-Nr. 7", "", "7"), ("GB-Nr 9", "", "9"), ("GRUNDSTÜCK 276", "", "276"), ("Parzellen-Nr. 123", "123", "123"),
]


@query("i16_parcel_lists", f"SELECT o_orderkey, {D.pick('o_orderkey', [c[1] for c in PARCELS])} AS parcels, {D.pick('o_orderkey', [c[2] for c in PARCELS])} AS gazette FROM orders")
def i16_lists(t):
    """All parcels of a text, and its first one as a gazette writes it."""
    text = T.pick(F.col("o_orderkey"), [c[0] for c in PARCELS])
    return t.orders.select("o_orderkey", F.array_join(A.parcels(text), ",").alias("parcels"), A.gazette_parcel(text).alias("gazette"))
