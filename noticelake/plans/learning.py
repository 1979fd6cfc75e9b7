"""Queries on learned rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learning as L
from .register import query

FOLD = """f AS (SELECT *, CASE WHEN lag(protection_status) OVER w <> protection_status THEN 1 ELSE 0 END AS nw FROM lrn WINDOW w AS (PARTITION BY municipality_key, address_signature, project_signature ORDER BY decided_at, decision_id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY municipality_key, address_signature, project_signature ORDER BY decided_at, decision_id) AS run FROM f),
h AS (SELECT municipality_key, address_signature, project_signature, run, count(*) AS len, min(protection_status) AS protection_status FROM g GROUP BY ALL),
rules AS (SELECT municipality_key, address_signature, project_signature, CAST(sum(len) AS BIGINT) AS match_count, arg_max(protection_status, run) AS protection_status,
  round(least(0.98::DOUBLE, (CASE WHEN max(run) = 0 THEN 0.82 ELSE 0.72 END)::DOUBLE + 0.04::DOUBLE * (arg_max(len, run) - 1)), 4) AS confidence FROM h GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY municipality_key ORDER BY confidence DESC, match_count DESC, address_signature, project_signature) AS place FROM rules QUALIFY place <= 25)"""
OVERLAP = "CASE WHEN {a} = {b} THEN 1.0 ELSE len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' '))))::DOUBLE / greatest(len(list_distinct(string_split({a}, ' '))), len(list_distinct(string_split({b}, ' ')))) END"
BEST = f"""{FOLD}, items AS (SELECT decision_id, municipality_key, concat('bahnhofstr ', decision_id % 30) AS ia, project_signature AS ip FROM lrn),
sc AS (SELECT decision_id, address_signature AS ra, t.project_signature AS rp, protection_status,
  round(least(1.0, 0.2 + (CASE WHEN ia = address_signature THEN 0.45 ELSE {OVERLAP.format(a='ia', b='address_signature')} * 0.35 END) + (CASE WHEN ip = t.project_signature THEN 0.25 ELSE {OVERLAP.format(a='ip', b='t.project_signature')} * 0.2 END)) * least(0.98, greatest(0.35, confidence)), 6) AS score
  FROM items JOIN top t USING (municipality_key)),
best AS (SELECT * FROM sc WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, ra, rp) = 1)"""


def rules(t):
    return L.fold_rules(t.lrn, ["decided_at", "decision_id"])


def items(t):
    return t.lrn.select("decision_id", "municipality_key", F.concat(F.lit("bahnhofstr "), (F.col("decision_id") % 30).cast("string")).alias("address_signature"), "project_signature")


@query("j5_learning_upsert", f"WITH {FOLD} SELECT municipality_key, address_signature, project_signature, protection_status, match_count, confidence FROM rules", "lrn")
def j5(t):
    return rules(t)


@query("f3_top_rules", f"WITH {FOLD} SELECT municipality_key, address_signature, project_signature, place FROM top", "lrn")
def f3(t):
    return L.top_rules(rules(t)).select(*L.KEY, "place")


@query("f6_rule_summary", f"WITH {FOLD} SELECT count(*) AS n, CAST(sum(match_count) AS BIGINT) AS matches, round(avg(confidence), 6) AS mean, max(confidence) AS top FROM rules", "lrn")
def f6(t):
    return rules(t).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("confidence").alias("top"))


@query("e23_rule_similarity", f"WITH {BEST} SELECT decision_id, ra, rp, protection_status, score FROM best", "lrn")
def e23(t):
    return L.best_rule(items(t), rules(t), "decision_id")


@query("i37_similarity_score", f"WITH {BEST} SELECT decision_id, round(max(score), 6) AS score FROM sc GROUP BY 1", "lrn")
def i37(t):
    top = L.top_rules(rules(t)).select("municipality_key", F.col("address_signature").alias("ra"), F.col("project_signature").alias("rp"), "confidence")
    score = L.similarity(F.col("address_signature"), F.col("ra"), F.col("project_signature"), F.col("rp"), F.col("confidence"))
    kinds = items(t).select(*L.KEY).distinct().join(top, "municipality_key").groupBy(*L.KEY).agg(F.round(F.max(score), 6).alias("score"))
    return items(t).join(kinds, L.KEY).select("decision_id", "score")


@query("j6_rule_application", f"WITH {BEST} SELECT i.decision_id, CASE WHEN score IS NULL THEN NULL WHEN score >= 0.52 AND protection_status <> 'manual-review' THEN protection_status ELSE 'manual-review' END AS verdict, CAST(round(score * 100) AS INTEGER) AS percent FROM items i LEFT JOIN best USING (decision_id)", "lrn")
def j6(t):
    return L.apply_rules(items(t), rules(t), "decision_id")


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("i6_token_signature", f"""SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND x NOT IN ({STOP})))), 1, 8), ' ') AS signature FROM documents""")
def i6(t):
    return t.documents.select("doc_id", T.token_signature(F.col("text"), 8).alias("signature"))


TOKENS = r"list_distinct(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query("is4_token_overlap", f"""WITH d AS (SELECT doc_id, {TOKENS} AS s FROM documents)
SELECT a.doc_id, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / greatest(len(a.s), len(b.s)) END AS overlap FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def is4(t):
    """Shared tokens of every document with the one that follows it, whole texts."""
    a, b = t.documents.select("doc_id", "text"), t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", T.token_overlap(F.trim("text"), F.trim("other")).alias("overlap"))
