"""Queries on notice texts and on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import duck as D
from ..functions import text as T
from ..operators import extract as X
from ..operators import pages as P
from .register import query

ROWS = """tx AS (SELECT txt_id, body, line_no, regexp_extract(body, 'Bauvorhaben:\\s*(.+?)\\s*Bauplatz', 1) AS project, regexp_extract(body, '(?i)(?:parzelle|parz\\.|gb)\\s*(?:nr\\.?)?\\s*(\\d+)', 1) AS parcel,
 regexp_extract(body, 'Bahnhofstrasse \\d+', 0) AS place, regexp_extract(body, 'vom (\\d+)\\.(\\d+)\\. bis (\\d+)\\.(\\d+)\\.(\\d{4})', ['d1', 'm1', 'd2', 'm2', 'y']) AS g FROM txt),
td AS (SELECT *, try_cast(g.y || '-' || lpad(g.m2, 2, '0') || '-' || lpad(g.d2, 2, '0') AS DATE) AS last_day FROM tx)"""


def q(name, body):
    return query(name, f"WITH {ROWS} {body}", "txt")


@q("i14_labelled_value", "SELECT txt_id, project FROM tx")
def i14(t):
    return X.fields(t.txt).select("txt_id", "project")


@q("i16_parcel_number", "SELECT txt_id, parcel FROM tx")
def i16(t):
    return t.txt.select("txt_id", X.parcel_number(F.col("body")).alias("parcel"))


@q("i15_address", "SELECT txt_id, place FROM tx")
def i15(t):
    return t.txt.select("txt_id", X.street_address(F.col("body")).alias("place"))


#: texts of a date range around a year, and its first and last day; %y and %n stand for the year and the next
RANGES = [
    ("vom 3.5. bis 2.6.%y", "%y-05-03", "%y-06-02"),
    ("20.12. – 18.1.%n", "%y-12-20", "%n-01-18"),
    ("Auflage vom 1.2.%y bis 3.3.", "%y-02-01", "%y-03-03"),
    ("Publikation vom 3. März bis 2. April %y", "%y-03-03", "%y-04-02"),
    ("vom Freitag, 5. Juni %y, bis Montag, 6. Juli %y", "%y-06-05", "%y-07-06"),
    ("12. Dezember - 11. Januar %n", "%y-12-12", "%n-01-11"),
    ("Samstag, 1. August %y — 31. August %y", "%y-08-01", "%y-08-31"),
    ("vom 30.2.%y bis 3.3.%y", None, None),
    ("vom 3.5. bis 2.6.", None, None),
    ("am 3.5.%y aufgelegt", None, None),
    ("3.5.%y - 2.6.%y statt vom 1.1.%y bis 2.2.%y", "%y-05-03", "%y-06-02"),
    ("20.12.%n - 18.1.%n", "%n-12-20", "%n-01-18"),
]
RANGE_SQL = ", ".join(f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in r[1:]) + ")" for i, r in enumerate(RANGES))


@query("i32_date_range", f"""WITH {ROWS}, cases AS (SELECT o_orderkey, o_orderkey % {len(RANGES)} AS k, CAST(2001 + o_orderkey % 90 AS VARCHAR) AS y, CAST(2002 + o_orderkey % 90 AS VARCHAR) AS nx FROM orders)
SELECT txt_id, last_day AS first_day, last_day FROM td UNION ALL
SELECT 'order-' || o_orderkey, CAST(replace(replace(a, '%y', y), '%n', nx) AS DATE), CAST(replace(replace(b, '%y', y), '%n', nx) AS DATE) FROM cases JOIN (VALUES {RANGE_SQL}) v(i, a, b) ON i = k""", "txt")
def i32(t):
    k = F.col("o_orderkey")
    year, later = ((k % 90 + n).cast("string") for n in (2001, 2002))
    body = F.element_at(F.array(*(F.lit(r[0]) for r in RANGES)), (k % len(RANGES) + 1).cast("int"))
    body = F.replace(F.replace(body, F.lit("%y"), year), F.lit("%n"), later)
    rows = t.txt.select("txt_id", "body").unionByName(t.orders.select(F.concat(F.lit("order-"), k.cast("string")).alias("txt_id"), body.alias("body")))
    return DT.with_range(rows, "body", "first_day", "last_day").select("txt_id", "first_day", "last_day")


@q("i33_import_dates", "SELECT txt_id, CASE WHEN last_day <= DATE '2015-01-01' THEN last_day END AS publication_date, last_day AS deadline_date FROM td")
def i33(t):
    none = F.lit(None).cast("date")
    return DT.import_dates(t.txt, none, none, "body", F.lit("2015-01-01").cast("date")).select("txt_id", "publication_date", "deadline_date")


@q("c2_record_builder", "SELECT upper(substr(sha1(concat_ws('|', place, parcel)), 1, 16)) AS reference, place AS address, parcel, project, last_day AS deadline_date, count(*) AS n FROM td WHERE place <> '' GROUP BY 1, 2, 3, 4, 5")
def c2(t):
    rows = X.fields(t.txt).filter("place <> ''")
    key = T.reference_id("", 16, F.col("place"), F.col("parcel"))
    return rows.groupBy(key.alias("reference"), F.col("place").alias("address"), "parcel", "project", "deadline_date").agg(F.count(F.lit(1)).alias("n"))


@q("c8_matching_text", "SELECT txt_id, concat_ws(' ', nullif(project, ''), nullif(place, ''), nullif(parcel, '')) AS context FROM tx")
def c8(t):
    return X.fields(t.txt).select("txt_id", F.concat_ws(" ", *(T.blank_to_null(F.col(c)) for c in ("project", "place", "parcel"))).alias("context"))


@q("d6_evidence_features", "SELECT txt_id, regexp_matches(body, '(?i)baugesuch') AS keyword, parcel <> '' AS parcel, place <> '' AS address FROM tx")
def d6(t):
    return t.txt.select("txt_id", X.relevance(F.col("body")).alias("f")).select("txt_id", "f.keyword", "f.parcel", "f.address")


@q("d7_relevance", "SELECT txt_id FROM tx WHERE line_no <> 3")
def d7(t):
    body = F.when(F.col("line_no") == 3, F.lit("Suche: keine Treffer")).otherwise(F.col("body"))
    return t.txt.withColumn("f", X.relevance(body)).filter(X.is_relevant(F.col("f"))).select("txt_id")


@q("d10_weak_address", "SELECT txt_id, CASE line_no % 4 WHEN 0 THEN false ELSE true END AS weak FROM tx")
def d10(t):
    a = F.when(F.col("line_no") % 4 == 0, X.street_address(F.col("body"))).when(F.col("line_no") % 4 == 1, F.lit("")).when(F.col("line_no") % 4 == 2, F.lit("Parzelle 12")).otherwise(F.lit("4711"))
    return t.txt.select("txt_id", X.weak_address(a).alias("weak"))


@q("d11_geocodable", "SELECT txt_id, line_no % 3 <> 1 AS ok FROM tx")
def d11(t):
    a = F.when(F.col("line_no") % 3 == 0, X.street_address(F.col("body"))).when(F.col("line_no") % 3 == 1, F.lit("Abbruch")).otherwise(F.concat(F.lit("Parzelle Nr. "), X.parcel_number(F.col("body"))))
    return t.txt.select("txt_id", X.geocodable(a).alias("ok"))


@q("f12_review_causes", "SELECT cause, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tx), 1)::DOUBLE AS percent FROM (SELECT CASE line_no % 4 WHEN 0 THEN 'has-coords' WHEN 1 THEN 'parcel-only' WHEN 2 THEN 'address-strong-no-coords' ELSE 'address-weak' END AS cause FROM tx) GROUP BY 1")
def f12(t):
    m = F.col("line_no") % 4
    a = F.when(m == 1, F.lit("")).when(m == 2, X.street_address(F.col("body"))).otherwise(F.lit("4711"))
    causes = t.txt.select(X.review_cause(a, X.parcel_number(F.col("body")), m == 0).alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    total = causes.agg(F.sum("n").alias("_all"))
    return causes.crossJoin(F.broadcast(total)).select("cause", "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("percent"))  # one row


@q("j10_field_repair", "SELECT txt_id, trim(place) AS address FROM tx WHERE line_no IN (1, 2)")
def j10(t):
    rows = X.fields(t.txt).withColumn("old", F.when(F.col("line_no") <= 2, F.concat(F.lit("  "), "place")).otherwise(F.col("place")))
    return rows.withColumn("address", T.collapse(F.col("old"))).filter(~F.col("old").eqNullSafe(F.col("address"))).select("txt_id", "address")


GAZ = "gaz AS (SELECT DISTINCT 'Town ' || CAST(s_nationkey AS VARCHAR) AS municipality, ps.k FROM supplier JOIN (SELECT DISTINCT l_partkey AS k, l_suppkey FROM lineitem WHERE l_linenumber <> 3) ps ON s_suppkey = ps.l_suppkey)"


def gazetteer(t, parcels: bool):
    """An entry with two spellings for every part and town in which it is sold, but on third lines."""
    sold = t.lineitem.filter("l_linenumber <> 3").select("l_suppkey", "l_partkey").distinct()
    places = sold.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("s_nationkey", "l_partkey").distinct()
    k = F.col("l_partkey").cast("string")
    labels = F.explode(F.array(F.concat(F.lit("Bahnhofstrasse "), k), F.concat(F.lit("Bahnhofstr "), k)))
    return places.select(
        F.concat(F.lit("Town "), F.col("s_nationkey").cast("string")).alias("municipality"), (F.concat(F.lit("Parzelle "), k) if parcels else F.lit("")).alias("parcel"), labels.alias("label"),
        (F.col("l_partkey") + 2600000).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("precise"), F.lit(1).alias("rank"),
    )


@query("e22_gazetteer_parcel", f"""WITH {GAZ} SELECT rec_id, CAST(2600000 + k AS DOUBLE) AS x, CASE WHEN parcel <> '' THEN 'parcel' ELSE 'address' END AS matched_by
FROM (SELECT *, regexp_extract(municipality, 'Town \\d+', 0) AS town, CAST(regexp_extract(address, '\\d+$', 0) AS BIGINT) AS no FROM rec) r JOIN gaz ON gaz.municipality = town AND gaz.k = no""", "rec")
def e22(t):
    return X.gazetteer_match(t.rec, gazetteer(t, True), "rec_id").select("rec_id", "x", "matched_by")


@query("i1_collapse", f"SELECT doc_id, {D.collapse('text')} AS text FROM documents")
def i1(t):
    return t.documents.select("doc_id", T.collapse(F.col("text")).alias("text"))


@query("i2_base", f"SELECT doc_id, {D.base('text')} AS text FROM documents")
def i2(t):
    return t.documents.select("doc_id", T.base(F.col("text")).alias("text"))


@query("i3_municipality", f"SELECT rec_id, {D.municipality('municipality')} AS m FROM rec", "rec")
def i3(t):
    return t.rec.select("rec_id", T.municipality(F.col("municipality")).alias("m"))


@query("i4_parcel", f"SELECT rec_id, {D.parcel('parcel')} AS p FROM rec", "rec")
def i4(t):
    return t.rec.select("rec_id", T.parcel(F.col("parcel")).alias("p"))


@query("i5_address_project", f"SELECT rec_id, {D.address('address')} AS a, {D.project('project_type')} AS p FROM rec", "rec")
def i5(t):
    return t.rec.select("rec_id", T.address(F.col("address")).alias("a"), T.project(F.col("project_type")).alias("p"))


@query("i18_shorten", f"SELECT doc_id, CASE WHEN length(c) > 120 THEN rtrim(substr(c, 1, 119)) || '...' ELSE c END AS s FROM (SELECT doc_id, {D.collapse('text')} AS c FROM documents)")
def i18(t):
    return t.documents.select("doc_id", T.shorten(F.col("text"), 120).alias("s"))


@query("i19_slug", "SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def i19(t):
    return t.nation.select("n_nationkey", T.slug(F.col("n_name")).alias("slug"))


NAMES = [("Kantonales Amtsblatt", "amtsblatt"), ("Gemeindeseite Aarau %k", "municipality"), ("ArcGIS Export", "import"), ("PDF-Auflage Bauverwaltung", "municipality"), ("", "import"),
  ("Amtsblatt der Gemeinde", "amtsblatt"), ("Kommunaler Anzeiger", "municipality"), ("JSON-Datensatz %k", "import"), ("Baugesuche %k", "municipality"), ("Vereinsblatt", "import"), ("Baupublikationen", "municipality"), ("Gemeinde-Portal", "municipality")]


@query("i26_source_kind", f"SELECT o_orderkey, {D.pick('o_orderkey', [k for _, k in NAMES])} AS kind FROM orders")
def i26(t):
    return t.orders.select("o_orderkey", T.source_kind(T.pick(F.col("o_orderkey"), [n for n, _ in NAMES])).alias("kind"))


PROJECTS = ["Mehrfamilienhaus mit Tiefgarage", "Wärmepumpe", "Umbau Garage", "Abbruch", "MFH", "Pergola beim EFH", "Neubau SCHULHAUS", "Strasse", "E-Ladestation", "Dachausbau", "Hotel mit Schwimmbecken", "Balkon", "Überbauung %k", "Fassadenanstrich", ""]


@query("i27_project_scale", f"""WITH x AS (SELECT p_partkey, concat_ws(' ', p_name, {D.pick('p_partkey', PROJECTS)}) AS d FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(d, '{X.LARGE_PROJECT.replace("(?iu)", "(?i)")}') THEN 'gross' WHEN regexp_matches(d, '{X.SMALL_PROJECT.replace("(?iu)", "(?i)")}') THEN 'klein'
 WHEN regexp_matches(d, '{X.MEDIUM_PROJECT.replace("(?iu)", "(?i)")}') THEN 'mittel' ELSE 'nicht-klassiert' END AS scale FROM x""")
def i27(t):
    return t.part.select("p_partkey", X.project_scale(F.col("p_name"), T.pick(F.col("p_partkey"), PROJECTS)).alias("scale"))


TRUTHS = [(" JA ", True), ("true", True), ("0", False), ("", False), ("1", True), ("YES", True), ("nein", False), (None, False), ("jaja", False), ("2", False), ("True\t", False)]


@query("i28_truthy", f"SELECT o_orderkey, {D.pick('o_orderkey', [f for _, f in TRUTHS])} AS flag FROM orders")
def i28(t):
    return t.orders.select("o_orderkey", T.truthy(T.pick(F.col("o_orderkey"), [v for v, _ in TRUTHS])).alias("flag"))


@query("i31_date_normalizer", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def i31(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    month = F.element_at(F.array(*(F.lit(m) for m in "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())), F.month(d))
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d.M.yyyy")).when(k == 2, F.concat(F.lit("Montag, "), F.dayofmonth(d), F.lit(". "), month, F.lit(" "), F.year(d))).otherwise(F.lit("31.02.2020"))
    return t.orders.select("o_orderkey", DT.normalize(text).alias("day"))


@query("c1_alias_coalesce", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'Parzelle ' || c_custkey END AS address FROM customer")
def c1(t):
    a = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.lit("  "))
    b = F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", T.first_filled(a, b, F.concat(F.lit("Parzelle "), F.col("c_custkey").cast("string"))).alias("address"))


@query("d5_term_rules", "SELECT doc_id, rule_id FROM documents d, (VALUES (1, 'the |and', 'xyzzy'), (2, '', 'the'), (3, 'une', NULL)) r(rule_id, i, e) WHERE (i = '' OR list_bool_or(list_transform(string_split(i, '|'), lambda x: contains(" + D.collapse("lower(text)") + ", trim(x))))) AND NOT coalesce(contains(" + D.collapse("lower(text)") + ", e), false)")
def d5(t):
    rules = t.spark.createDataFrame([(1, "the |and", "xyzzy"), (2, "", "the"), (3, "une", None)], "rule_id int, include string, exclude string")
    return X.term_rules(t.documents.select("doc_id", "text"), rules, "text").select("doc_id", "rule_id")


SOURCE_RULES = "SELECT source, CASE WHEN length(source) % 2 = 0 THEN 'the |und' WHEN source LIKE '%1%' THEN 'une' END AS include, CASE WHEN source LIKE '%2%' THEN 'copyright| license ' END AS exclude FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT LIKE '%3%')"


@query("l2_source_patterns", f"""WITH r AS ({SOURCE_RULES}), d AS (SELECT doc_id, source, {D.collapse("lower(text)")} AS t FROM documents)
SELECT doc_id FROM d LEFT JOIN r USING (source) WHERE (include IS NULL OR (include = 'the |und' AND (contains(t, 'the') OR contains(t, 'und'))) OR (include = 'une' AND contains(t, 'une')))
 AND NOT (exclude IS NOT NULL AND (contains(t, 'copyright') OR contains(t, 'license')))""")
def l2(t):
    t.documents.createOrReplaceTempView("documents")
    return X.source_rules(t.documents, t.spark.sql(SOURCE_RULES), "text").select("doc_id")


ADDRESSES = ["Bahnhofstrasse %k", "Januar 2024", "März 2023", "Folgen Sie uns auf Facebook", "Gemeinderatsnachrichten", "Newsweg 3", "Aktuelles aus dem Dorf", "Dorfgasse %k", "Adresse von Webseite prüfen", "", "Vernehmlassung %k"]
JUNK_RULES = [("address", p) for p in [*X.JUNK_ADDRESS, X.NO_ADDRESS]]
LIKES = " OR ".join(f"{c} LIKE '{p}'" for c, p in JUNK_RULES)


@query("d15_junk_rules", f"""WITH a AS (SELECT id, {D.pick('line', ADDRESSES)} AS address, workflow_status, assignee, note, ambiguous_address, source_reference FROM (SELECT *, CAST(regexp_extract(address, '[0-9]+$', 0) AS BIGINT) AS line FROM app)),
c AS (SELECT DISTINCT source_reference FROM rec WHERE source_kind = 'import' AND parcel = '')
SELECT id FROM a WHERE NOT (({LIKES}) AND workflow_status = 'new' AND assignee = '' AND note = '' AND ambiguous_address AND source_reference NOT IN (SELECT source_reference FROM c))""", "app", "rec")
def d15(t):
    line = F.regexp_extract("address", "[0-9]+$", 0).cast("long")
    rows = t.app.withColumn("address", T.pick(line, ADDRESSES))
    commented = t.rec.filter("source_kind = 'import' and parcel = ''").select("source_reference").distinct()
    comments = t.app.select("id", "source_reference").join(commented, "source_reference", "left_semi")
    return X.prune_junk(rows, JUNK_RULES, comments).select("id")


#: records by source, address, project, description, parcel and coordinates, whether the address is unclear, whether they are junk, and the source's address
JUNK = [
    ("Gemeinde-Webseite", "Adresse von Webseite prüfen", "Haus", "", "", "", False, True), ("Amtsblatt", "Adresse von Webseite prüfen", "Haus", "", "", "", True, False), ("Gemeinde-Webseite", "Adresse von Webseite prüfen", "Haus", "", "12", "", True, False),
    ("Gemeinde-Webseite", "März 2024", "Haus", None, None, None, True, True), ("Gemeinde-Webseite", "März 2024", "Haus", "", "", "", False, False), ("Gemeinde-Webseite", "Im März 2024", "Haus", "", "", "", True, True), ("Gemeinde-Webseite", "NEWS vom Dorf", "Haus", "", "", "", True, True),
    ("Gemeinde-Webseite", "Weg 1", "Neue Stadtteilziele", "", "", "", True, True), ("Gemeinde-Webseite", "Weg 1", "Haus", "Kurs Altlasten", "", "", True, True), ("Gemeinde-Webseite", "Weg 1", "News", "Facebook", "", "", True, False), ("Gemeinde-Webseite", "Förderprogramm", "", "", "", "1,2", True, False),
    ("Gemeinde-Webseite", "Einbürgerung Meier", "", "", "", "", True, True), (None, "Facebook", "", "", "", "", True, False), ("Gemeinde-Webseite", None, None, None, None, None, None, False),
    ("Gemeinde-Webseite", "Weg 1", "Haus", "", "12", "1,2", False, True, "https://a.example/_RTR/x"), ("Gemeinde-Webseite", "Weg 1", "Haus", "", "12", "", False, False, "https://a.example/bno"), ("Gemeinde-Webseite", "Weg 1", "Haus", "", "12", "", False, True, "https://a.example/bno7"), ("Amtsblatt", "Weg 1", "Haus", "", "", "", True, False, "https://a.example/suche"),
    ("Gemeinde-Webseite", "Ab Mitte März 2024", "Haus", "", "12", "", False, True), ("Gemeinde-Webseite", "vom 1.2. bis 3.4.", "Haus", "", "12", "", False, True), ("Gemeinde-Webseite", "Weg 2", "2", "", "12", "", False, True), ("Gemeinde-Webseite", "Weg 2", "22", "", "12", "", False, False),
    ("Gemeinde-Webseite", "Weg 2", "Archiv", "", "", "", False, True), ("Gemeinde-Webseite", "Weg 2", "Archivraum", "", "", "", False, False), ("Gemeinde-Webseite", "Ende März 2024", "Haus", "", "", "", False, False), ("Gemeinde-Webseite", "Erteilte Baubewilligungen 2024", "", "", "1", "", False, True),
]


@query("d15_junk_records", f"""WITH a AS (SELECT id, {D.pick('line', [j[7] for j in JUNK])} AS junk, workflow_status, assignee, note, source_reference FROM (SELECT *, CAST(regexp_extract(address, '[0-9]+$', 0) AS BIGINT) AS line FROM app))
SELECT id FROM a WHERE junk AND workflow_status = 'new' AND assignee = '' AND note = '' AND source_reference NOT IN (SELECT source_reference FROM rec WHERE source_kind = 'import' AND parcel = '')""", "app", "rec")
def d15_records(t):
    """Records of web pages that are no permits, among records of every kind."""
    line = F.regexp_extract("address", "[0-9]+$", 0).cast("long")
    case = lambda i: F.element_at(F.array(*(F.lit(j[i] if i < len(j) else "https://a.example/").cast("string") for j in JUNK)), (line % len(JUNK) + 1).cast("int"))
    names = ["source", "address", "project_type", "description", "parcel", "coordinates"]
    rows = t.app.withColumns({n: case(i) for i, n in enumerate(names)} | {"ambiguous_address": case(6).cast("boolean"), "source_url": case(8)})
    commented = t.rec.filter("source_kind = 'import' and parcel = ''").select("source_reference").distinct()
    return X.junk_records(rows, t.app.select("id", "source_reference").join(commented, "source_reference", "left_semi"))


RESTS = ["", "<br", "class=x", "data-id", "/publikation", "%PDF-1.4", "/FlateDecode", "a�b�", "a�b", "x = 'y'", "filter%5D", "tx_news", "data", "endobj", "box-box", "<3"]


@query("d16_markup_junk", f"""WITH x AS (SELECT doc_id, coalesce(text, '') || ' ' || {D.pick('doc_id', RESTS)} AS v FROM documents)
SELECT doc_id, regexp_matches(v, '(?i)<[a-z/!]|=\\s*["'']|\\bdata-[\\w-]+|%5[bd]|class=|box[\\s-]box|tx_[a-z_]+|filter%|/publikation') OR regexp_matches(v, '%PDF-|/FlateDecode|\\bendobj\\b|\\bendstream\\b') OR length(v) - length(replace(v, '�', '')) >= 2 AS junk FROM x""")
def d16(t):
    return t.documents.select("doc_id", X.markup_junk(F.concat_ws(" ", F.coalesce("text", F.lit("")), T.pick(F.col("doc_id"), RESTS))).alias("junk"))


TOPICS = [("", ""), ("Suchergebnisse %k", "https://a.example/suche"), ("Suchergebnisse %k", "https://a.example/detail/%k"), ("Protokoll der Gemeindeversammlung", ""), ("Protokoll zum Baugesuch %k", ""), ("Mitteilungsblatt mit Baugesuch", ""),
  ("Plangenehmigungsverfahren", ""), ("Neubau", "https://a.example/bno/%k"), ("Neubau Garage", "https://a.example/baugesuche"), ("Budget und Steuer", ""), ("Reglement", ""), ("Bauvorhaben nach Gestaltungsplan", ""), ("Baugesuch %k", "https://a.example/_rtr/reglemente/%k"), ("Baugesuch %k", "https://a.example/_rtr/reglementer")]
TOPIC_SQL = f"""(regexp_matches(b, '{X.SEARCH_RESULTS}') AND NOT regexp_matches(u, '(?i)/(detail|id|item)[/=-]?[0-9]+')) OR regexp_matches(u, '(?i)(regionalebauverwaltung\\.ch|/bauen/baubewilligungen/ebau-aargau|(?:^|[/_-])bno(?:[/_.-]|$)|nutzungsordnung)')
 OR regexp_matches(u, '{X.PUBLICATION_ROUTE}') OR regexp_matches(b, '{X.BULLETIN}') OR regexp_matches(b, '{X.OTHER_PROCEDURE}') OR (regexp_matches(b, '{X.OTHER_TOPIC}') AND NOT regexp_matches(b, '{X.PERMIT_SIGNAL}'))"""


@query("d9_off_topic", f"""WITH x AS (SELECT doc_id, {D.collapse(f"concat_ws(' ', {D.pick('doc_id', [a for a, _ in TOPICS])}, text)")} AS v, {D.pick('doc_id', [u for _, u in TOPICS])} AS u FROM documents), y AS (SELECT *, u || ' ' || v AS b FROM x)
SELECT doc_id, v <> '' AND ({TOPIC_SQL}) AS off_topic FROM y""")
def d9(t):
    text = F.concat_ws(" ", T.pick(F.col("doc_id"), [a for a, _ in TOPICS]), F.col("text"))
    return t.documents.select("doc_id", X.is_off_topic(text, T.pick(F.col("doc_id"), [u for _, u in TOPICS])).alias("off_topic"))


DATES = [(" 12.3.2024 ", True), ("2024", True), ("März 2024", True), ("Weg 12", False), ("12.3.2024 bis 13.3.2024", False), ("", False), ("3. 4. 2025", True), ("Parzelle 12", False), ("20245", False), ("Weg 3", False), ("im März 2024", False), ("Mai 1999", False)]


@query("d19_lone_date", f"SELECT o_orderkey, {D.pick('o_orderkey', [f for _, f in DATES])} AS lone FROM orders")
def d19(t):
    return t.orders.select("o_orderkey", X.lone_date(T.pick(F.col("o_orderkey"), [v for v, _ in DATES])).alias("lone"))


# jobs that chain the steps above


DATED = "DATE '2024-02-01' AS publication_date, DATE '2024-03-03' AS deadline_date"


@query("a9_document_records", f"SELECT txt_id, 'Dorfgasse ' || part AS place, p_name AS project, {DATED} FROM ntx WHERE line_no NOT IN (2, 3, 4, 5)", "ntx")
def a9(t):
    """Texts as records: a text without address or project, or without any date, gives none."""
    rows = X.fields(t.ntx).filter((F.col("body") != "") & (F.col("place") != "") & (F.col("project") != ""))
    rows = rows.filter(F.col("publication_date").isNotNull() | F.col("deadline_date").isNotNull())
    return rows.select("txt_id", "place", "project", "publication_date", "deadline_date")


@query("c11_gazette_record", """SELECT txt_id, CASE WHEN line_no IN (2) THEN 'Parzelle ' || part WHEN line_no = 5 THEN '' ELSE 'Dorfgasse ' || part END AS address, CASE WHEN line_no IN (3, 4, 5) THEN '' ELSE part END AS parcel,
 CASE WHEN line_no IN (4, 5) THEN 'Bauvorhaben' ELSE p_name END AS project, CASE WHEN line_no NOT IN (3, 5) THEN DATE '2024-03-03' END AS deadline_date, CASE WHEN line_no NOT IN (3, 5) THEN 'explicit' ELSE 'missing' END AS deadline_provenance,
 CASE WHEN line_no = 5 THEN 'manual-review' ELSE 'open' END AS verdict FROM ntx""", "ntx")
def c11(t):
    """Street, else parcel; project with a fallback; deadline with its provenance; a first verdict that a blank place keeps open for review."""
    rows = X.fields(t.ntx)
    address = T.first_filled(F.col("place"), F.when(F.col("parcel") != "", F.concat(F.lit("Parzelle "), "parcel")))
    provenance = F.when(F.col("deadline_date").isNotNull(), "explicit").otherwise("missing")
    verdict = F.when(address.isNull(), "manual-review").otherwise("open")
    return rows.select("txt_id", F.coalesce(address, F.lit("")).alias("address"), "parcel", T.first_filled(F.col("project"), F.lit("Bauvorhaben")).alias("project"), "deadline_date", provenance.alias("deadline_provenance"), verdict.alias("verdict"))


FEEDS = [("Baugesuch Nr. %k", True), ("Vereinsnachrichten vom 1.2.2024", False), ("Bauvorhaben Parzelle %k, Auflage ab 1.2.2024", True), ("Bauvorhaben ohne Ort", False), ("Bauvorhaben Bahnhofstrasse 3 vom 1.2.", True), ("Bahnhofstrasse 3, 1.2.2024", False), ("", False), ("Gesuch um Sitzplatz", True)]


@query("d8_feed_relevance", f"SELECT o_orderkey, {D.pick('o_orderkey', [f for _, f in FEEDS])} AS relevant FROM orders")
def d8(t):
    return t.orders.select("o_orderkey", X.is_relevant_feed(T.pick(F.col("o_orderkey"), [v for v, _ in FEEDS])).alias("relevant"))


@query("d12_detail_needed", "SELECT txt_id FROM ntx WHERE line_no IN (2, 3, 4, 5)", "ntx")
def d12(t):
    """Records whose page or document has to be read: place, parcel or deadline are missing, or the place is weak."""
    rows = X.fields(t.ntx)
    return rows.filter((F.col("place") == "") | (F.col("parcel") == "") | F.col("deadline_date").isNull() | X.weak_address(F.col("place"))).select("txt_id")


ENTITIES = [("A &amp; B &lt;%k&gt; &auml;", "A & B <%k> ä"), ("&amp;lt;", "&lt;"), ("&Uuml;ber&nbsp;%k", "Über %k"), ("&#39;x&apos;", "'x'"), ("&quot;%k&quot; &szlig;", '"%k" ß'), ("AT&T &unknown;", "AT&T &unknown;"), ("", ""), ("&#65;&#252;ber &#8211; &#x2013;&#X1F600;", "Aüber – –😀"), ("&#%k; &#0; &#55296; &#9999999; &#x; &#;", None), ("&amp;#65; &eacute;&egrave; &amp;nbsp;", "&#65; éè &nbsp;")]


#: a number that is a character, beside numbers that are none
NUMBERED = "coalesce({}, CASE WHEN o_orderkey BETWEEN 1 AND 55295 OR o_orderkey BETWEEN 57344 AND 1114111 THEN chr(o_orderkey::INTEGER) ELSE '&#' || o_orderkey || ';' END || ' &#0; &#55296; &#9999999; &#x; &#;')"


@query("i7_entities", f"SELECT o_orderkey, {NUMBERED.format(D.pick('o_orderkey', [v for _, v in ENTITIES]))} AS text FROM orders")
def i7(t):
    return t.orders.select("o_orderkey", T.decode_entities(T.pick(F.col("o_orderkey"), [v for v, _ in ENTITIES])).alias("text"))


RAW_ADDRESSES = [(' class="x"> Weg %k&nbsp; data-id=\'7\'', "Weg %k"), ("Gasse 2", "Gasse 2"), ('<span id="a">Rain %k</span>', "Rain %k"), ("", ""), ('style="color:red">', ""), ("M&uuml;hleweg  3", "Mühleweg 3")]


@query("i11_address_cleaner", f"SELECT o_orderkey, {D.pick('o_orderkey', [v for _, v in RAW_ADDRESSES])} AS address FROM orders")
def i11(t):
    return t.orders.select("o_orderkey", X.clean_address(T.pick(F.col("o_orderkey"), [v for v, _ in RAW_ADDRESSES])).alias("address"))


@q("i12_project_cleaner", "SELECT txt_id, project FROM tx")
def i12(t):
    raw = F.concat(F.lit("Bauvorhaben: "), T.labelled_value(F.col("body"), "Bauvorhaben", ["Bauplatz"]), F.lit(" Bauplatz: irgendwo"))
    clean = F.regexp_replace(F.regexp_replace(raw, r"^(?i)(bauvorhaben|projekt)\s*:\s*", ""), r"(?i)\s*(bauplatz|parzelle|auflage)\b.*$", "")
    return t.txt.select("txt_id", T.collapse(clean).alias("project"))


STREETS = [  # an address, what the sanitizer leaves, house number, street name, street token
    ("Bahnhofstrasse 12a", "Bahnhofstrasse 12a", "12a", "Bahnhofstrasse", "bahnhofstrasse"), ("12345", "", "", "", None), ("unbekannt", "", "", "", "unbekannt"), ("Parzelle 77", "", "", "", None), ("Im langen Winkelried, Oberer Weg 3", "Im langen Winkelried, Oberer Weg 3", "3", "Im langen Winkelried, Oberer Weg", "winkelried"),
    ("Neubau Kirchgasse %k", "Neubau Kirchgasse %k", "%k", "Neubau Kirchgasse", "kirchgasse"), ("", "", "", "", None), ("Standort Gemeinde Schweiz", "", "", "", None), ("Dorf 7", "Dorf 7", "7", "Dorf", "dorf"), ("Am Hof", "Am Hof", "", "", None), ("Grossackerstrasse beim Feuerwehrmagazin 5", "Grossackerstrasse beim Feuerwehrmagazin 5", "5", "Grossackerstrasse beim Feuerwehrmagazin", "grossackerstrasse"),
]


@query("i13_address_sanitizer", f"SELECT o_orderkey, {D.pick('o_orderkey', [s[1] for s in STREETS])} AS address FROM orders")
def i13(t):
    return t.orders.select("o_orderkey", X.sanitize_address(T.pick(F.col("o_orderkey"), [s[0] for s in STREETS])).alias("address"))


@query("i17_house_number", f"SELECT o_orderkey, {D.pick('o_orderkey', [s[2] for s in STREETS])} AS house_number, {D.pick('o_orderkey', [s[3] for s in STREETS])} AS street FROM orders")
def i17(t):
    a = X.sanitize_address(T.pick(F.col("o_orderkey"), [s[0] for s in STREETS]))
    return t.orders.select("o_orderkey", X.house_number(a).alias("house_number"), X.street_name(a).alias("street"))


@query("i20_street_token", f"SELECT o_orderkey, {D.pick('o_orderkey', [s[4] for s in STREETS])} AS token FROM orders")
def i20(t):
    return t.orders.select("o_orderkey", X.street_token(T.pick(F.col("o_orderkey"), [s[0] for s in STREETS])).alias("token"))


@q("i21_project_type", "SELECT txt_id, coalesce(nullif(project, ''), 'Bauvorhaben') AS project, CASE WHEN length(project) > 20 THEN 2 WHEN project <> '' THEN 1 ELSE 0 END AS specificity FROM tx")
def i21(t):
    p = X.fields(t.txt).select("txt_id", "project")
    return p.select("txt_id", T.first_filled(F.col("project"), F.lit("Bauvorhaben")).alias("project"), F.when(F.length("project") > 20, 2).when(F.col("project") != "", 1).otherwise(0).alias("specificity"))


@q("i34_context_dates", "SELECT txt_id, last_day AS publication_date FROM td")
def i34(t):
    first = F.regexp_extract("body", r"(?i)(?:publiziert|publikation|auflage)\D{0,12}(\d{1,2}\.\d{1,2}\.)", 1)
    year = F.regexp_extract("body", r"(\d{4})\s*$", 1)
    return t.txt.select("txt_id", DT.normalize(F.concat(first, year)).alias("publication_date"))


INSIDE = [("<section><p>eins <a href=\"/x\">L %k</a> zwei</p><p>ohne</p></section>", "eins L %k zwei"), ("<ul><li>a</li><li><b>b</b> <a href=\"/y\">M</a></li></ul>", "b M"), ("<article>vor <p>nichts</p> <a href=\"/z\">N %k</a> nach</article>", "vor nichts N %k nach"), ("<p>kein Link</p>", None), ("<tr><td>1</td><td><a href=\"/t\">T</a></td></tr>", "1 T"), ("<section>a <article>b <ul><li>c</li></ul> <a href='/u'>U %k</a> d <p>e</p></article> f</section>", "b c U %k d e"), ("<p>a <a href=/v>V</a></p><p>b</p>", "a V"), ("lose <a href=\"/w\">W %k</a> Ende", "W %k")]


@query("i10_enclosing_block", f"SELECT page_id, text FROM (SELECT page_id, {D.pick('page_id', [x for _, x in INSIDE])} AS text FROM pages) WHERE text IS NOT NULL")
def i10(t):
    """The text of the smallest block around each page's first link."""
    pages = t.pages.select("page_id", "url", T.pick(F.col("page_id"), [h for h, _ in INSIDE]).alias("html"))
    links = P.anchors_in_context(pages)
    return links.groupBy("page_id").agg(F.min_by("context", "block").alias("text"))


@query("j7_refinement", """SELECT txt_id, CASE WHEN line_no IN (2) THEN 'Parzelle ' || part WHEN line_no = 5 THEN '' ELSE 'Dorfgasse ' || part END AS address, CASE WHEN line_no IN (3, 4, 5) THEN '' ELSE part END AS parcel,
 CASE WHEN line_no NOT IN (3, 5) THEN DATE '2024-02-01' END AS publication_date, CASE WHEN line_no NOT IN (3, 5) THEN DATE '2024-03-03' END AS deadline_date,
 CASE WHEN line_no NOT IN (5) THEN CAST(2600000 + CAST(part AS BIGINT) AS DOUBLE) END AS x, CASE WHEN line_no = 6 THEN 'protected-zone' WHEN line_no = 5 THEN 'manual-review' ELSE 'no-hit' END AS verdict,
 CASE WHEN line_no = 5 THEN 'location unclear' ELSE 'refined' END AS note FROM ntx""", "ntx")
def j7(t):
    """Fills address, parcel, dates and coordinates of bare records from their texts."""
    k = F.col("p_partkey").cast("string")
    places = t.part.select(F.lit("Dorf").alias("municipality"), F.concat(F.lit("Parzelle "), k).alias("parcel"), F.concat(F.lit("Dorfgasse "), k).alias("label"), (F.col("p_partkey") + 2600000).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("precise"), F.lit(1).alias("rank"))
    bare = t.ntx.select("txt_id", "body", F.lit("Dorf").alias("municipality"), F.when(F.col("line_no") == 6, "protected-zone").otherwise("no-hit").alias("verdict"))
    return X.refine(bare, places, "txt_id").select("txt_id", "address", "parcel", "publication_date", "deadline_date", "x", "verdict", "note")


@query("e21_gazetteer_address", f"""WITH {GAZ} SELECT rec_id, CAST(2600000 + k AS DOUBLE) AS x FROM (SELECT *, regexp_extract(municipality, 'Town \\d+', 0) AS town, CAST(regexp_extract(address, '\\d+$', 0) AS BIGINT) AS no FROM rec WHERE parcel = '') r JOIN gaz ON gaz.municipality = town AND gaz.k = no""", "rec")
def e21(t):
    return X.gazetteer_match(t.rec.filter("parcel = ''"), gazetteer(t, False), "rec_id").select("rec_id", "x")


@query("e25_official_names", "SELECT c_custkey, n_name AS municipality FROM customer JOIN nation ON n_nationkey = c_nationkey")
def e25(t):
    place = F.concat(F.lit("Rathaus, "), "n_name", F.lit(", Kanton"))
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.posexplode(F.reverse(F.split(place, ", "))).alias("priority", "candidate"))
    names = t.nation.select(T.municipality(F.col("n_name")).alias("k"), F.col("n_name").alias("municipality"))
    hits = rows.withColumn("k", T.municipality(F.col("candidate"))).join(names, "k")
    return hits.groupBy("c_custkey").agg(F.min_by("municipality", "priority").alias("municipality"))


@query("j11_location_repair", f"""WITH {GAZ} SELECT rec_id, count(*) FILTER (k IS NOT NULL) = 1 AS resolved FROM (SELECT *, regexp_extract(municipality, 'Town \\d+', 0) AS town, CAST(regexp_extract(address, '\\d+$', 0) AS BIGINT) AS no FROM rec WHERE workflow_status = 'under-review') r LEFT JOIN gaz ON gaz.municipality = town AND gaz.k = no GROUP BY 1""", "rec")
def j11(t):
    rows = t.rec.filter("workflow_status = 'under-review'")
    found = e22(t).select("rec_id", F.lit(True).alias("hit"))
    return rows.select("rec_id").join(found, "rec_id", "left").select("rec_id", F.coalesce("hit", F.lit(False)).alias("resolved"))
