"""Queries on records: linkage, golden records, worklist, mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import duck as D
from ..functions import text as T
from ..operators import linkage as L
from ..operators import running as R
from ..operators import spatial as S
from ..operators import sync as Y
from ..operators import worklist as W
from .register import query

REF = "DATE '1996-06-15'"


def ref():
    return F.lit("1996-06-15").cast("date")


REVIEW = ", ".join(f"'{x}'" for x in W.REVIEW)
ACTIVE = f"coalesce(reconciliation_status, '') NOT IN ({REVIEW})"
RANK = "CASE protection_status WHEN 'manual-review' THEN 0 WHEN 'combined-hit' THEN 1 WHEN 'protected-point' THEN 2 WHEN 'protected-zone' THEN 3 ELSE 4 END"
CLOSED = "CASE WHEN workflow_status IN ('cleared', 'archived') THEN 1 ELSE 0 END"

KEYED = f"""keyed AS (SELECT *, nullif({D.municipality("municipality")}, '') AS m, nullif(trim(publication_date), '') AS pub,
  nullif({D.parcel("parcel")}, '') AS par, nullif({D.address("address")}, '') AS adr, nullif({D.project("project_type")}, '') AS prj FROM rec)"""
PAIRS = f"""WITH {KEYED},
inc AS (SELECT * FROM keyed WHERE source_kind = 'municipality' AND workflow_status <> 'archived' AND m IS NOT NULL),
cand AS (SELECT * FROM keyed WHERE source_kind = 'authority' AND workflow_status <> 'archived' AND m IS NOT NULL),
raw AS (
  SELECT i.rec_id AS incoming_id, c.rec_id AS candidate_id, 0 AS r FROM inc i JOIN cand c ON i.m = c.m AND i.pub = c.pub AND i.par = c.par
  UNION ALL SELECT i.rec_id, c.rec_id, 1 FROM inc i JOIN cand c ON i.m = c.m AND i.pub = c.pub AND i.adr = c.adr
  UNION ALL SELECT i.rec_id, c.rec_id, 2 FROM inc i JOIN cand c ON i.m = c.m AND i.par = c.par AND i.prj = c.prj AND (i.pub IS NULL OR c.pub IS NULL)
  UNION ALL SELECT i.rec_id, c.rec_id, 3 FROM inc i JOIN cand c ON i.m = c.m AND i.adr = c.adr AND i.prj = c.prj AND (i.pub IS NULL OR c.pub IS NULL)),
pairs AS (SELECT incoming_id, candidate_id, min(r) AS rule_rank FROM raw GROUP BY 1, 2)
"""


def open_kind(t, kind):
    return t.rec.filter((F.col("source_kind") == kind) & (F.col("workflow_status") != "archived"))


@query("e12_record_linkage", PAIRS + "SELECT incoming_id, candidate_id, rule_rank FROM pairs", "rec")
def e12(t):
    return L.link_pairs(open_kind(t, "municipality"), open_kind(t, "authority"))


STATUS_SQL = PAIRS + """, n AS (SELECT incoming_id, count(*) AS candidates, min(candidate_id) AS c, min(rule_rank) AS r FROM pairs GROUP BY 1)
SELECT i.rec_id AS incoming_id, CAST(least(coalesce(candidates, 0), 2) AS INTEGER) AS candidates, CASE WHEN candidates IS NULL THEN 'none' WHEN candidates = 1 THEN 'matched' ELSE 'ambiguous' END AS link_status,
  CASE WHEN candidates = 1 THEN c END AS matched_id,
  CASE WHEN candidates = 1 THEN ['publication+parcel', 'publication+address', 'parcel+project', 'address+project'][r + 1] END AS rule
FROM inc i LEFT JOIN n ON n.incoming_id = i.rec_id"""


@query("e13_link_cardinality", STATUS_SQL, "rec")
def e13(t):
    return L.link_status(open_kind(t, "municipality"), open_kind(t, "authority"))


def flagship(t):
    return e13(t).groupBy("link_status").agg(F.count(F.lit(1)).alias("records"))


query("flagship_link_status", PAIRS + """, n AS (SELECT incoming_id, count(*) AS c FROM pairs GROUP BY 1)
SELECT CASE WHEN c IS NULL THEN 'none' WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS link_status, count(*) AS records
FROM inc LEFT JOIN n ON n.incoming_id = inc.rec_id GROUP BY 1""", "rec")(flagship)


def with_match(t):
    return t.rec.withColumn("match_status", F.when(F.col("rec_id").endswith("7"), "ambiguous").otherwise("matched"))


EVID = f"""WITH {KEYED}, g AS (SELECT source_reference,
  bool_or(rec_id LIKE '%7') AS unsure, bool_or(source_kind = 'authority') AS has_a, bool_or(source_kind = 'municipality') AS has_m, bool_and(source_kind = 'import') AS only_i,
  count(*) AS evidences, count(DISTINCT m) AS cm, count(DISTINCT pub) AS cp, count(DISTINCT nullif(trim(deadline_date), '')) AS cd, count(DISTINCT par) AS cpar, count(DISTINCT adr) AS ca, count(DISTINCT prj) AS cpr
  FROM keyed GROUP BY 1),
c AS (SELECT *, list_filter([CASE WHEN cm > 1 THEN 'municipality' END, CASE WHEN cp > 1 THEN 'publication_date' END, CASE WHEN cd > 1 THEN 'deadline_date' END,
  CASE WHEN cpar > 1 THEN 'parcel' END, CASE WHEN ca > 1 THEN 'address' END, CASE WHEN cpr > 1 THEN 'project_type' END], lambda x: x IS NOT NULL) AS conf FROM g)
SELECT source_reference, evidences, CASE WHEN unsure THEN 'ambiguous-review' WHEN only_i THEN 'import-review' WHEN len(conf) > 0 THEN 'conflict-review' WHEN cp = 0 THEN 'missing-publication'
  WHEN has_a THEN 'authority-confirmed' WHEN has_m THEN 'municipality-only' ELSE 'import-review' END AS reconciliation_status, coalesce(array_to_string(conf, ','), '') AS conflicts FROM c"""


@query("f8_reconciliation_status", EVID, "rec")
def f8(t):
    return L.group_status(with_match(t), "source_reference")


@query("f9_conflict_fields", f"WITH s AS ({EVID.replace('WITH ', 'WITH ', 1)}) SELECT source_reference, conflicts FROM s WHERE conflicts <> ''", "rec")
def f9(t):
    return f8(t).filter("conflicts <> ''").select("source_reference", "conflicts")


ORDERED = "struct_pack(a := CASE source_kind WHEN 'authority' THEN 1 WHEN 'municipality' THEN 2 ELSE 3 END, b := observed_at, c := rec_id)"
GOLD = "SELECT source_reference, " + ", ".join(f"coalesce(arg_min(trim({f}), CASE WHEN trim({f}) <> '' THEN {ORDERED} END), '') AS {f}" for f in L.FIELDS) + " FROM rec GROUP BY 1"


@query("f10_golden_record", GOLD, "rec")
def f10(t):
    return L.golden_record(t.rec, "source_reference", ["observed_at", "rec_id"])


@query("f11_write_back", f"""WITH s AS ({EVID}), gold AS ({GOLD}) SELECT s.source_reference, s.reconciliation_status, gold.municipality,
  CASE WHEN gold.address = '' THEN gold.parcel ELSE gold.address END AS address, gold.publication_date FROM s JOIN gold USING (source_reference)""", "rec")
def f11(t):
    gold = f10(t)
    return f8(t).join(gold, "source_reference").select(
        "source_reference", "reconciliation_status", "municipality", T.first_filled(F.col("address"), F.col("parcel")).alias("address"), "publication_date"
    ).fillna("", ["address"])


@query("f2_count_by_source", "SELECT source, count(*) AS records FROM app GROUP BY 1", "app")
def f2(t):
    return t.app.groupBy("source").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "source")


@query("f1_dashboard_counters", f"""SELECT count(*) AS total, count(*) FILTER (protection_status IN ('protected-point', 'protected-zone', 'combined-hit') AND {ACTIVE}) AS relevant,
 count(*) FILTER ((protection_status = 'manual-review' OR ambiguous_address) AND {ACTIVE}) AS manual_review,
 count(*) FILTER (workflow_status NOT IN ('cleared', 'archived') AND {ACTIVE} AND deadline_date - {REF} BETWEEN 0 AND 7) AS due_soon FROM app""", "app")
def f1(t):
    return W.counters(t.app, ref())


@query("d1_worklist_filter", "SELECT id FROM app WHERE workflow_status = 'new' AND (lower(municipality) LIKE '%steel%' OR lower(project_type) LIKE '%steel%' OR lower(description) LIKE '%steel%' OR lower(address) LIKE '%steel%')", "app")
def d1(t):
    return W.search(t.app, " STEEL ", ["municipality", "address", "project_type", "description"], workflow_status="new").select("id")


@query("d2_active_status", f"SELECT coalesce(reconciliation_status, '') AS status, count(*) AS n FROM app WHERE {ACTIVE} GROUP BY 1", "app")
def d2(t):
    return t.app.filter(W.is_active_status()).groupBy(F.coalesce("reconciliation_status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("d3_active_records", f"SELECT id FROM app WHERE {ACTIVE} AND workflow_status <> 'archived' AND {REF} - publication_date <= 31", "app")
def d3(t):
    return t.app.filter(W.is_active(ref())).select("id")


@query("d4_tab_and_search", "SELECT id FROM app WHERE workflow_status IN ('new', 'under-review') AND municipality IN ('Town 1', 'Town 2') AND lower(concat_ws(' ', municipality, address, project_type, description, source, source_reference)) LIKE '%brass%'", "app")
def d4(t):
    text = F.lower(F.concat_ws(" ", "municipality", "address", "project_type", "description", "source", "source_reference"))
    return t.app.filter(F.col("workflow_status").isin("new", "under-review") & F.col("municipality").isin("Town 1", "Town 2") & F.contains(text, F.lit("brass"))).select("id")


@query("d17_inferred_deadline", "SELECT id, (assignee <> '' OR note <> '' OR workflow_status <> 'new') AS touched FROM app WHERE source_kind = 'authority' AND deadline_date - publication_date = 30", "app")
def d17(t):
    return t.app.filter("source_kind = 'authority'").filter(F.datediff("deadline_date", "publication_date") == 30).select("id", W.is_touched().alias("touched"))


@query("d18_team_touched", "SELECT a.id, (workflow_status <> 'new' OR assignee <> '' OR note <> '' OR coalesce(c.n, 0) > 0) AS touched FROM app a LEFT JOIN (SELECT source_reference AS r, count(*) AS n FROM rec WHERE source_kind = 'import' GROUP BY 1) c ON c.r = a.source_reference", "app", "rec")
def d18(t):
    comments = t.rec.filter("source_kind = 'import'").groupBy("source_reference").agg(F.count(F.lit(1)).alias("n"))
    return t.app.join(comments, "source_reference", "left").select("id", (W.is_touched() | (F.coalesce("n", F.lit(0)) > 0)).alias("touched"))


@query("d20_assessment_changed", "SELECT id FROM app WHERE [protection_status, note] IS DISTINCT FROM ['no-hit', assignee]", "app")
def d20(t):
    return t.app.filter(~F.struct(F.col("protection_status"), F.col("note").alias("n")).eqNullSafe(F.struct(F.lit("no-hit").alias("protection_status"), F.col("assignee").alias("n")))).select("id")


@query("h1_worklist_order", f"SELECT id, row_number() OVER (PARTITION BY source ORDER BY {RANK}, {CLOSED}, deadline_date ASC NULLS FIRST, publication_date DESC, municipality, id) AS place FROM app", "app")
def h1(t):
    return R.place(t.app, ["source"], W.worklist_order()).select("id", "place")


@query("h2_urgent", f"SELECT id, protection_status, deadline_date FROM app WHERE workflow_status NOT IN ('cleared', 'archived') AND {ACTIVE} ORDER BY {RANK}, deadline_date IS NULL, deadline_date, id LIMIT 5", "app")
def h2(t):
    return W.urgent(t.app).select("id", "protection_status", "deadline_date")


@query("h3_chosen_sort", f"SELECT id, row_number() OVER (PARTITION BY municipality ORDER BY coalesce(deadline_date - {REF}, 'infinity'::DOUBLE) DESC, id) AS place FROM app", "app")
def h3(t):
    days = F.coalesce(F.datediff("deadline_date", ref()).cast("double"), F.lit(float("inf")))
    return R.place(t.app.select("id", "municipality", days.alias("days")), ["municipality"], [F.desc("days"), F.asc("id")]).select("id", "place")


@query("h4_locale_sort", """SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY w COLLATE de) AS place
FROM (SELECT DISTINCT lang, regexp_extract(text, '[A-Za-zäöüÄÖÜ]+', 0) AS w FROM documents)""")
def h4(t):
    """First words of documents in the order of each language's readers: umlauts beside their base letters."""
    return W.locale_place(t.documents.select("lang", F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-zäöüÄÖÜ]+", 0).alias("w")), "w", ["lang"])


@query("h5_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def h5(t):
    return W.newest(t.events.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 100)


@query("g2_keep_newest", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def g2(t):
    return W.newest(t.events.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 40).select("event_id")


@query("g6_next_open", f"""WITH o AS (SELECT * FROM app WHERE workflow_status IN ('new', 'under-review'))
SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER (PARTITION BY municipality ORDER BY {RANK}, id)) AS next_id FROM o WINDOW w AS (PARTITION BY municipality ORDER BY {RANK}, id)""", "app")
def g6(t):
    rows = t.app.filter(F.col("workflow_status").isin("new", "under-review")).withColumn("rank", W.protection_rank())
    return W.next_open(rows, "municipality", ["rank", "id"]).select("id", "next_id")


@query("g7_rebase_dates", f"SELECT id, publication_date + CAST({REF} - 2 - (SELECT max(publication_date) FROM app) AS INTEGER) AS publication_date FROM app", "app")
def g7(t):
    return W.rebase_dates(t.app, ["publication_date"], "publication_date", ref()).select("id", "publication_date")


@query("g8_recent_split", f"SELECT CASE WHEN {REF} - publication_date <= 14 THEN 'recent' ELSE 'older' END AS part, count(*) AS n FROM app WHERE publication_date <= {REF} GROUP BY 1", "app")
def g8(t):
    rows = t.app.filter(F.col("publication_date") <= ref())
    return rows.groupBy(F.when(F.datediff(ref(), "publication_date") <= 14, "recent").otherwise("older").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("c12_workflow_steps", """SELECT id, list_transform([1, 2, 3, 4], lambda i: CASE WHEN i < r THEN 'done' WHEN i = r THEN 'current' ELSE 'pending' END) AS steps
FROM (SELECT id, CASE workflow_status WHEN 'new' THEN 1 WHEN 'under-review' THEN 2 WHEN 'cleared' THEN 3 ELSE 4 END AS r FROM app)""", "app")
def c12(t):
    return t.app.select("id", W.workflow_steps().alias("steps"))


@query("f18_tab_counts", f"SELECT municipality, count(*) AS n, count(*) FILTER (workflow_status = 'new') AS n_new, count(*) FILTER (protection_status = 'manual-review') AS n_review FROM app WHERE {ACTIVE} GROUP BY 1", "app")
def f18(t):
    return t.app.filter(W.is_active_status()).groupBy("municipality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("workflow_status") == "new").alias("n_new"), F.count_if(F.col("protection_status") == "manual-review").alias("n_review")
    )


@query("f13_repair_summary", "SELECT source_kind, protection_status, count(*) AS n FROM app GROUP BY 1, 2", "app")
def f13(t):
    return t.app.groupBy("source_kind", "protection_status").agg(F.count(F.lit(1)).alias("n"))


@query("f7_date_range", "SELECT max(ts) AS last_at, min(ts) AS first_at FROM events")
def f7(t):
    return t.events.agg(F.max("ts").alias("last_at"), F.min("ts").alias("first_at"))


@query("e15_identity_tiers", """WITH e AS (SELECT source_kind, source_reference, min(rec_id) AS id1 FROM rec WHERE source_kind = 'authority' GROUP BY 1, 2),
s AS (SELECT * FROM rec WHERE workflow_status = 'under-review'), s2 AS (SELECT source_reference, source_kind, min(rec_id) AS id2 FROM s GROUP BY 1, 2)
SELECT r.rec_id, coalesce(id1, id2, s.rec_id) AS target_id, CASE WHEN id1 IS NOT NULL THEN 1 WHEN id2 IS NOT NULL THEN 2 WHEN s.rec_id IS NOT NULL THEN 3 ELSE 0 END AS tier
FROM rec r LEFT JOIN e USING (source_kind, source_reference) LEFT JOIN s2 USING (source_reference, source_kind) LEFT JOIN s ON s.rec_id = r.rec_id AND s.source_reference = r.source_reference""", "rec")
def e15(t):
    return L.identity_tiers(t.rec.select("rec_id", "source_kind", "source_reference"), t.rec.filter("source_kind = 'authority'"), t.rec.filter("workflow_status = 'under-review'"))


@query("e11_unseen_queue", "SELECT count(*) AS waiting, min(source_reference) AS first_reference FROM rec WHERE source_kind = 'import' AND source_reference NOT IN (SELECT source_reference FROM app WHERE workflow_status = 'new')", "rec", "app")
def e11(t):
    queue = t.rec.filter("source_kind = 'import'").join(t.app.filter("workflow_status = 'new'").select("source_reference"), "source_reference", "left_anti")
    return queue.agg(F.count(F.lit(1)).alias("waiting"), F.min("source_reference").alias("first_reference"))


@query("j2_evidence_upsert", """SELECT rec_id, source_kind, source_reference FROM (SELECT *, row_number() OVER (PARTITION BY source_kind, source_reference ORDER BY observed_at DESC, rec_id DESC) AS r FROM rec) WHERE r = 1""", "rec")
def j2(t):
    cols = ["rec_id", "source_kind", "source_reference", "observed_at"]
    rows = t.rec.select(*cols)
    return L.upsert_evidence(rows.filter("rec_id < '3'"), rows.filter("rec_id >= '3'")).drop("observed_at")


def sync_run(t):
    """A run over seven sources whose payloads are the lines of an order each, in three spellings; one source is broken."""
    order = F.split("rec_id", "-")[0].cast("long")
    source = F.concat(F.lit("src-"), (order % 7).cast("string"))
    rows = t.rec.filter(INCOMING).withColumns({"source": source, "payload": order})
    plain = F.struct(F.col("source_reference").alias("reference"), "municipality", "address", "parcel", F.col("project_type").alias("projectType"), F.col("publication_date").alias("publicationDate"), F.col("deadline_date").alias("deadlineDate"))
    named = F.struct(F.struct(F.col("source_reference").alias("ID"), F.col("municipality").alias("GEMEINDE"), F.col("address").alias("ADRESSE"), F.col("parcel").alias("PARZELLE"), F.col("project_type").alias("TITEL"), F.col("publication_date").alias("publikation"), F.col("deadline_date").alias("frist")).alias("attributes"))
    items = rows.withColumn("item", F.when(order % 3 == 2, F.to_json(named)).otherwise(F.to_json(plain)))
    list_ = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("item")), ","), F.lit("]"))  # the lines of one order
    bodies = items.groupBy("source", "payload").agg(list_.alias("list"))
    k = F.col("payload") % 3
    body = F.when(k == 0, F.col("list")).when(k == 1, F.concat(F.lit('{"items": '), "list", F.lit("}"))).otherwise(F.concat(F.lit('{"features": '), "list", F.lit("}")))
    payloads = bodies.select("source", "payload", F.when(F.col("source") == "src-3", F.substring(body, 1, 20)).otherwise(body).alias("body"))
    sources = t.spark.range(7).select(F.concat(F.lit("src-"), F.col("id").cast("string")).alias("source"), F.lit("municipality").alias("source_kind"), (F.col("id") % 2 == 0).alias("prune"))
    stored = t.rec.filter(STORED).withColumns({"source": source, "assignee": F.lit(""), "note": F.when(F.col("parcel") == "", "seen").otherwise(""), "protection_status": F.lit("no-hit")})
    return Y.run(payloads, sources, stored, S.rectangle_rings(t.gar), t.gbl, ref())


@query("j21_sync_run")
def j21_run(t):
    """What a whole run reads, skips, imports, updates, merges and removes, for each source."""
    return sync_run(t).metrics


@query("j4_retention", f"SELECT id, CASE WHEN publication_date + 31 < {REF} AND workflow_status NOT IN ('cleared', 'archived') THEN 'archived' ELSE workflow_status END AS workflow_status, CASE WHEN publication_date + 31 < {REF} AND workflow_status NOT IN ('cleared', 'archived') THEN {REF} END AS archived_at FROM app", "app")
def j4(t):
    return W.archive_expired(t.app, ref()).select("id", "workflow_status", "archived_at")


@query("j3_stale_prune", """WITH keep AS (SELECT DISTINCT source, source_reference FROM app WHERE line_no = 1), c AS (SELECT DISTINCT id FROM app WHERE line_no = 2)
SELECT id FROM app a WHERE NOT (source IN (SELECT source FROM keep) AND NOT EXISTS (SELECT 1 FROM keep k WHERE k.source = a.source AND k.source_reference = a.source_reference)
 AND id NOT IN (SELECT id FROM c) AND workflow_status = 'new' AND assignee = '' AND note = '')""", "app")
def j3(t):
    return W.prune_stale(t.app, t.app.filter("line_no = 1"), t.app.filter("line_no = 2")).select("id")


@query("j3_prune_by_place", """WITH a AS (SELECT *, 'town-' || length(id) % 7 AS town FROM app), came AS (SELECT DISTINCT source, town, source_reference FROM a WHERE line_no = 1 AND length(id) % 7 <> 3), pr AS (SELECT DISTINCT source, town FROM came WHERE town <> 'town-5')
SELECT id FROM a WHERE NOT ((source, town) IN (SELECT (source, town) FROM pr) AND NOT EXISTS (SELECT 1 FROM came c WHERE c.source = a.source AND c.town = a.town AND c.source_reference = a.source_reference)
 AND line_no <> 2 AND workflow_status = 'new' AND coalesce(assignee, '') = '' AND coalesce(note, '') = '')""", "app")
def j3_place(t):
    """Six towns of seven deliver, and five of these prune."""
    rows = t.app.withColumn("municipality", F.concat(F.lit("town-"), (F.length("id") % 7).cast("string")))
    configs = rows.select("source", "municipality", (F.col("municipality") != "town-5").alias("prune")).distinct()
    return W.prune_untouched(rows, rows.filter("line_no = 1 and municipality <> 'town-3'"), configs, rows.filter("line_no = 2")).select("id")


EVIDENCE = "SELECT rec_id AS app_id, source_kind, source_reference, observed_at FROM rec WHERE rec_id < '6'"


@query("j2_attached_evidence", f"""WITH r AS ({EVIDENCE}), old AS (SELECT * FROM r WHERE rtrim(app_id) LIKE '%1'), f AS (SELECT app_id, 'import' AS source_kind, left(app_id, 2) AS source_reference, observed_at FROM r WHERE source_kind = 'municipality'),
own AS (SELECT * FROM r WHERE app_id IN (SELECT app_id FROM f) AND NOT EXISTS (SELECT 1 FROM old WHERE old.app_id = r.app_id AND old.source_kind = r.source_kind AND old.source_reference = r.source_reference)),
u AS (SELECT *, 0 AS turn FROM old UNION ALL SELECT *, 1 FROM own UNION ALL SELECT *, 2 FROM f)
SELECT app_id, source_kind, source_reference FROM u QUALIFY row_number() OVER (PARTITION BY source_kind, source_reference ORDER BY turn DESC, observed_at DESC NULLS LAST, app_id DESC) = 1""", "rec")
def j2_attached(t):
    """Imports speak for records of municipalities; one in ten records has its own evidence already."""
    rows = t.rec.filter("rec_id < '6'").select(F.col("rec_id").alias("app_id"), "source_kind", "source_reference", "observed_at")
    foreign = rows.filter("source_kind = 'municipality'").withColumns({"source_kind": F.lit("import"), "source_reference": F.substring("app_id", 1, 2)})
    return L.attach_evidence(rows, rows.filter("app_id like '%1'"), foreign).drop("observed_at")


@query("j22_patch_merge", "SELECT a.id, coalesce(p.note, a.note) AS note, CASE WHEN p.id IS NULL THEN a.assignee ELSE coalesce(p.assignee, a.assignee) END AS assignee FROM app a LEFT JOIN (SELECT id, CASE WHEN line_no = 3 THEN 'patched' END AS note, CASE WHEN line_no = 4 THEN 'me' END AS assignee FROM app WHERE line_no IN (3, 4)) p USING (id)", "app")
def j22(t):
    p = t.app.filter("line_no in (3, 4)").select("id", F.when(F.col("line_no") == 3, "patched").alias("note"), F.when(F.col("line_no") == 4, "me").alias("assignee"))
    return W.patch(t.app, p, "id", ["note", "assignee"]).select("id", "note", "assignee")


STORED, INCOMING = "source_kind = 'authority' OR (source_kind = 'municipality' AND rec_id < '3')", "source_kind = 'municipality' AND rec_id >= '3'"
J1 = f"""WITH {KEYED}, stored AS (SELECT * FROM keyed WHERE {STORED}), inc AS (SELECT * FROM keyed WHERE {INCOMING}),
known AS (SELECT source_kind, source_reference, min(rec_id) AS sid FROM stored GROUP BY 1, 2),
seen AS (SELECT i.*, k.sid, min(rec_id) OVER (PARTITION BY i.source_kind, i.source_reference) AS fid FROM inc i LEFT JOIN known k USING (source_kind, source_reference)),
op AS (SELECT * FROM seen WHERE sid IS NULL AND fid = rec_id AND m IS NOT NULL), cand AS (SELECT * FROM stored WHERE workflow_status <> 'archived' AND m IS NOT NULL),
raw AS (SELECT i.rec_id AS a, c.rec_id AS b FROM op i JOIN cand c ON i.m = c.m AND i.pub = c.pub AND i.par = c.par
 UNION SELECT i.rec_id, c.rec_id FROM op i JOIN cand c ON i.m = c.m AND i.pub = c.pub AND i.adr = c.adr
 UNION SELECT i.rec_id, c.rec_id FROM op i JOIN cand c ON i.m = c.m AND i.par = c.par AND i.prj = c.prj AND (i.pub IS NULL OR c.pub IS NULL)
 UNION SELECT i.rec_id, c.rec_id FROM op i JOIN cand c ON i.m = c.m AND i.adr = c.adr AND i.prj = c.prj AND (i.pub IS NULL OR c.pub IS NULL)),
n AS (SELECT a, count(*) AS n, min(b) AS b FROM raw GROUP BY 1),
o AS (SELECT s.*, CASE WHEN sid IS NOT NULL OR fid <> rec_id THEN 'update' WHEN n = 1 THEN 'merge' ELSE 'insert' END AS outcome,
 CASE WHEN sid IS NOT NULL OR fid <> rec_id THEN coalesce(sid, fid) WHEN n = 1 THEN b ELSE s.rec_id END AS target_id, n > 1 AND sid IS NULL AND fid = rec_id AS unsure FROM seen s LEFT JOIN n ON n.a = s.rec_id)"""
CONTENT = ["municipality", "address", "parcel", "publication_date", "deadline_date", "project_type"]


def imports(t):
    stored, incoming = t.rec.filter(STORED), t.rec.filter(INCOMING)
    return stored, incoming, L.import_outcomes(stored, incoming)


@query("j1_import_upsert", f"""{J1}, upd AS (SELECT target_id, arg_max(struct_pack({", ".join(f"{c} := {c}" for c in CONTENT)}), rec_id) AS s FROM o WHERE outcome = 'update' GROUP BY 1),
every AS (SELECT rec_id, source_kind, source_reference, workflow_status, {", ".join(CONTENT)}, NULL AS c FROM stored UNION ALL SELECT rec_id, source_kind, source_reference, workflow_status, {", ".join(CONTENT)}, 'imported' FROM o WHERE outcome = 'insert')
SELECT e.rec_id, source_kind, source_reference, workflow_status, coalesce(c, CASE WHEN u.s IS NOT NULL THEN 'updated' END) AS change_type,
 {", ".join(f"CASE WHEN u.s IS NULL THEN e.{c} ELSE u.s.{c} END AS {c}" for c in CONTENT)} FROM every e LEFT JOIN upd u ON u.target_id = e.rec_id""", "rec")
def j1(t):
    stored, incoming, outcomes = imports(t)
    cols = ["rec_id", "source_kind", "source_reference", "workflow_status", *CONTENT]
    return L.import_upsert(stored.select(*cols), incoming.select(*cols), outcomes, ref()).drop("last_sync_at")


@query("j1_import_evidence", f"""{J1} SELECT target_id AS rec_id, source_kind, source_reference, CASE WHEN unsure THEN 'ambiguous' ELSE 'matched' END AS match_status
FROM o QUALIFY row_number() OVER (PARTITION BY source_kind, source_reference ORDER BY rec_id) = 1""", "rec")
def j1_evidence(t):
    _, incoming, outcomes = imports(t)
    return L.import_evidence(incoming, outcomes)


@query("j1_import_in_order")
def j1_in_order(t):
    """Outcomes of the import where each record sees those before it; records that clash build chains."""
    stored, incoming = t.rec.filter(STORED), t.rec.filter(INCOMING)
    return L.import_in_order(stored, incoming)


@query("f17_run_metrics", f"{J1} SELECT outcome, count(*) AS n FROM o GROUP BY 1", "rec")
def f17(t):
    return imports(t)[2].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("j9_duplicate_merge")
def j9(t):
    """Records that are merged away and their hosts, over all records; one touched record in seven stands for the team's."""
    rows = t.rec.withColumns({"touched": (F.col("parcel") != "") & F.col("rec_id").endswith("7"), "created_at": F.col("observed_at")})
    return L.merge_duplicates(rows)


@query("j9_repointed_evidence")
def j9_repointed(t):
    """Evidence under the hosts after the merge: how much each has, references counted once."""
    evidence = t.rec.select("rec_id", "source_kind", "source_reference")
    moved = L.repoint(evidence, j9(t), "rec_id", ["source_kind", "source_reference"])
    return moved.groupBy("rec_id").agg(F.count(F.lit(1)).alias("evidences")).filter("evidences > 1")


@query("b5_notifications", "SELECT id, protection_status FROM app WHERE line_no <= 2 AND protection_status <> 'no-hit'", "app")
def b5(t):
    return t.app.filter("line_no <= 2").filter(F.col("protection_status") != "no-hit").select("id", "protection_status")


@query("b6_dashboard", f"SELECT (SELECT count(*) FROM app) AS total, (SELECT count(DISTINCT municipality) FROM app) AS towns, (SELECT list(id) FROM (SELECT id FROM app WHERE workflow_status NOT IN ('cleared', 'archived') AND {ACTIVE} ORDER BY {RANK}, deadline_date IS NULL, deadline_date, id LIMIT 5)) AS urgent", "app")
def b6(t):
    stats = t.app.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("municipality").alias("towns"))
    top = W.urgent(t.app).select(F.struct(W.protection_rank(), F.col("deadline_date").isNull(), "deadline_date", "id").alias("s"))
    return stats.crossJoin(top.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["id"]).alias("urgent")))  # one row each


@query("c3_import_defaults", "SELECT rec_id, CASE WHEN source_kind IN ('authority') THEN 'explicit' ELSE 'legacy-unknown' END AS provenance, CASE WHEN workflow_status IN ('new', 'under-review', 'cleared', 'archived') THEN workflow_status ELSE 'new' END AS workflow_status FROM rec", "rec")
def c3(t):
    given = F.when(F.col("source_kind") == "authority", "explicit").otherwise(F.col("source_kind"))
    provenance = F.when(given.isin("explicit", "derived-rule", "missing", "legacy-unknown"), given).otherwise("legacy-unknown")
    status = F.when(F.col("workflow_status").isin("new", "under-review", "cleared", "archived"), F.col("workflow_status")).otherwise("new")
    return t.rec.select("rec_id", provenance.alias("provenance"), status.alias("workflow_status"))


@query("c7_default_dates", "SELECT rec_id, coalesce(nullif(trim(publication_date), ''), nullif(trim(deadline_date), ''), '') AS publication_date FROM rec", "rec")
def c7(t):
    return t.rec.select("rec_id", F.coalesce(T.first_filled(F.col("publication_date"), F.col("deadline_date")), F.lit("")).alias("publication_date"))


@query("is1_union_sources", "SELECT source_kind, count(*) AS n FROM (SELECT * FROM rec WHERE source_kind = 'authority' UNION ALL SELECT * FROM rec WHERE source_kind <> 'authority') GROUP BY 1", "rec")
def is1(t):
    a, b = t.rec.filter("source_kind = 'authority'").drop("parcel"), t.rec.filter("source_kind <> 'authority'")
    return a.unionByName(b, allowMissingColumns=True).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"))


@query("is3_missing_references", "SELECT DISTINCT source_reference FROM app WHERE source_reference NOT IN (SELECT source_reference FROM rec WHERE source_kind = 'import')", "app", "rec")
def is3(t):
    return t.app.select("source_reference").distinct().join(t.rec.filter("source_kind = 'import'").select("source_reference"), "source_reference", "left_anti")


@query("i23_reference_id", "SELECT rec_id, 'AUTO-' || upper(substr(sha1(concat_ws('|', nullif(trim(municipality), ''), nullif(trim(parcel), ''), nullif(trim(publication_date), ''))), 1, 16)) AS reference FROM rec", "rec")
def i23(t):
    return t.rec.select("rec_id", T.reference_id("AUTO-", 16, F.col("municipality"), F.col("parcel"), F.col("publication_date")).alias("reference"))


@query("i25_note_append", "SELECT id, CASE WHEN contains(note, 'check') THEN note ELSE trim(concat_ws(' ', nullif(note, ''), 'check')) END AS note FROM app", "app")
def i25(t):
    return t.app.select("id", F.when(F.contains("note", F.lit("check")), F.col("note")).otherwise(F.concat_ws(" ", F.nullif("note", F.lit("")), F.lit("check"))).alias("note"))


@query("i25_notes", f"""SELECT id, trim(concat_ws(' ', n, CASE WHEN NOT contains(n, 'check') THEN 'check' END, CASE WHEN NOT contains(n, 'Nr. ' || id) THEN 'Nr. ' || id END)) AS appended,
 trim(concat_ws(' ', n, CASE WHEN publication_date IS NULL THEN replace('{T.NO_PLACE}', '{T.FORMER_CHECK}', '{T.CHECK}') END, CASE WHEN deadline_date IS NULL THEN replace('{T.NO_DEADLINE}', '{T.FORMER_CHECK}', '{T.CHECK}') END, '{T.CHECK}')) AS resolved
 FROM (SELECT *, {D.collapse('note')} AS n FROM app)""", "app")
def i25_notes(t):
    """Notes put behind a text that does not hold them, and a text without those that are settled."""
    notes = F.array(F.lit("check"), F.lit(None).cast("string"), F.lit(" check "), F.concat(F.lit("Nr.  "), F.col("id").cast("string")), F.lit(""))
    asked = F.concat_ws(" ", "note", F.lit(T.NO_PLACE), F.lit(T.NO_DEADLINE), F.lit(T.FORMER_CHECK))
    return t.app.select("id", T.append_notes(F.col("note"), notes).alias("appended"), T.without_resolved(asked, F.col("publication_date").isNotNull(), F.col("deadline_date").isNotNull()).alias("resolved"))


@query("i35_deadline_days", f"SELECT id, publication_date + 14 AS display_deadline, deadline_date - {REF} AS days, CASE WHEN deadline_date - {REF} <= 0 THEN 'over' WHEN deadline_date - {REF} <= 5 THEN 'soon' WHEN deadline_date IS NULL THEN 'none' ELSE 'later' END AS due FROM app", "app")
def i35(t):
    days = F.datediff("deadline_date", ref())
    due = F.when(days <= 0, "over").when(days <= 5, "soon").when(days.isNull(), "none").otherwise("later")
    return t.app.select("id", F.date_add("publication_date", 14).alias("display_deadline"), days.alias("days"), due.alias("due"))


@query("i36_invalid_deadline", "SELECT rec_id, CASE WHEN deadline_date <> '' AND publication_date <> '' AND deadline_date < publication_date THEN '' ELSE deadline_date END AS deadline_date FROM (SELECT rec_id, publication_date, CASE WHEN parcel = '' THEN '1990-01-01' ELSE deadline_date END AS deadline_date FROM rec)", "rec")
def i36(t):
    rows = t.rec.withColumn("deadline_date", F.when(F.col("parcel") == "", "1990-01-01").otherwise(F.col("deadline_date")))
    early = (F.col("deadline_date") != "") & (F.col("publication_date") != "") & (F.col("deadline_date") < F.col("publication_date"))
    return rows.select("rec_id", F.when(early, "").otherwise(F.col("deadline_date")).alias("deadline_date"))


@query("i44_quality_checks", """SELECT id, list_filter(['address', 'location', 'deadline', 'source'], lambda x: (x = 'address' AND length(address) < 18) OR (x = 'location' AND ambiguous_address) OR (x = 'deadline' AND deadline_date IS NULL) OR (x = 'source' AND source = 'src-0')) AS failed FROM app""", "app")
def i44(t):
    checks = F.array(
        F.struct(F.lit("address").alias("label"), (F.length("address") >= 18).alias("ok")),
        F.struct(F.lit("location").alias("label"), (~F.col("ambiguous_address")).alias("ok")),
        F.struct(F.lit("deadline").alias("label"), F.col("deadline_date").isNotNull().alias("ok")),
        F.struct(F.lit("source").alias("label"), (F.col("source") != "src-0").alias("ok")),
    )
    return t.app.select("id", F.transform(F.filter(checks, lambda c: ~c["ok"]), lambda c: c["label"]).alias("failed"))


DEFAULTS = {"combined-hit": "zone and building", "protected-point": "building", "protected-zone": "zone", "manual-review": "unclear"}


@query("i46_default_verdict", "SELECT protection_status, CASE protection_status WHEN 'combined-hit' THEN 'zone and building' WHEN 'protected-point' THEN 'building' WHEN 'protected-zone' THEN 'zone' WHEN 'manual-review' THEN 'unclear' ELSE 'none' END AS verdict, count(*) AS n FROM app GROUP BY 1, 2", "app")
def i46(t):
    lookup = F.create_map(*(F.lit(x) for kv in DEFAULTS.items() for x in kv))
    return t.app.withColumn("verdict", F.coalesce(lookup[F.col("protection_status")], F.lit("none"))).groupBy("protection_status", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("i24_status_alias", "SELECT o_orderstatus, CASE upper(o_orderstatus) WHEN 'F' THEN 'archived' WHEN 'P' THEN 'under-review' ELSE 'new' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def i24(t):
    alias = F.create_map(F.lit("F"), F.lit("archived"), F.lit("P"), F.lit("under-review"))
    return t.orders.withColumn("status", F.coalesce(alias[F.upper("o_orderstatus")], F.lit("new"))).groupBy("o_orderstatus", "status").agg(F.count(F.lit(1)).alias("n"))


@query("l1_stage_hooks", "SELECT protection_status, count(*) AS n FROM app WHERE workflow_status <> 'archived' GROUP BY 1", "app")
def l1(t):
    hooks = [lambda d: d.filter(F.col("workflow_status") != "archived"), lambda d: d.groupBy("protection_status").agg(F.count(F.lit(1)).alias("n"))]
    out = t.app
    for h in hooks:
        out = out.transform(h)
    return out


@query("c10_preferred_link", "SELECT id, CASE WHEN url LIKE '%.pdf' THEN regexp_replace(url, '/[^/?#]+\\.pdf.*$', '/') ELSE url END AS link FROM (SELECT id, CASE WHEN line_no = 1 THEN 'https://a.example/x/' || source || '.pdf' ELSE 'https://a.example/' || source END AS url FROM app)", "app")
def c10(t):
    own = F.when(F.col("line_no") == 1, F.concat(F.lit("https://a.example/x/"), "source", F.lit(".pdf")))
    url = F.coalesce(own, F.concat(F.lit("https://a.example/"), "source"))
    return t.app.select("id", F.regexp_replace(url, r"/[^/?#]+\.pdf.*$", "/").alias("link"))


@query("c4_read_enrichment", "SELECT a.id, r.r_name AS region, a.protection_status IN ('protected-point', 'protected-zone', 'combined-hit') AS is_protected FROM app a JOIN nation n ON a.municipality = 'Town ' || n.n_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey", "app")
def c4(t):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("Town "), F.col("n_nationkey").cast("string")).alias("municipality"), F.col("r_name").alias("region"))
    return t.app.join(dim, "municipality").select("id", "region", F.col("protection_status").isin(W.PROTECTED).alias("is_protected"))


@query("j21_sync_job", f"""{J1}, src AS (SELECT *, 'src-' || (CAST(regexp_extract(source_reference, '[0-9]+', 0) AS INTEGER) % 7) AS source, outcome AS oc FROM o),
bad AS (SELECT DISTINCT source FROM src WHERE source = 'src-3')
SELECT source, CAST(count(*) AS BIGINT) AS raw, CASE WHEN source = 'src-3' THEN 0 ELSE count(*) FILTER (oc = 'insert') END AS imported, CASE WHEN source = 'src-3' THEN 0 ELSE count(*) FILTER (oc = 'update') END AS updated,
 CASE WHEN source = 'src-3' THEN 0 ELSE count(*) FILTER (oc = 'merge') END AS merged, CASE WHEN source = 'src-3' THEN 'unreadable' END AS error FROM src GROUP BY source""", "rec")
def j21(t):
    """Metrics of a run for each source: a source that cannot be read gets a row with its error and stops no other."""
    number = F.regexp_extract("source_reference", "[0-9]+", 0).cast("int") % 7
    stored, incoming, outcomes = imports(t)
    rows = incoming.select("rec_id", F.concat(F.lit("src-"), number.cast("string")).alias("source")).join(outcomes, "rec_id")
    errors = rows.select("source").distinct().select("source", F.when(F.col("source") == "src-3", "unreadable").alias("error"))
    return W.run_metrics(rows, errors)
