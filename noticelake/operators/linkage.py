"""Record linkage across sources, evidence groups, golden records and the duplicate merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import written
from .running import running

RULES = ["publication+parcel", "publication+address", "parcel+project", "address+project"]
#: sources in the order in which their values win
PRIORITY = ["authority", "municipality", "import"]
FIELDS = ["municipality", "publication_date", "deadline_date", "parcel", "address", "project_type"]


#: keys of each rule; the last two ask that a publication date is missing on one side at least
RULE_KEYS = [["k_pub", "k_parcel"], ["k_pub", "k_addr"], ["k_parcel", "k_proj"], ["k_addr", "k_proj"]]


def with_keys(records: DataFrame) -> DataFrame:
    """Adds the normalised match keys; null where a field is blank, so that blanks never match."""
    return records.withColumns({
        "k_mun": T.blank_to_null(T.municipality(F.col("municipality"))),
        "k_pub": T.blank_to_null(F.col("publication_date")),
        "k_parcel": T.blank_to_null(T.parcel(F.col("parcel"))),
        "k_addr": T.blank_to_null(T.address(F.col("address"))),
        "k_proj": T.blank_to_null(T.project(F.col("project_type"))),
    })


def keyed(records: DataFrame, id_col: str, more: list[str] = ()) -> DataFrame:
    """id and match keys of the records that have a municipality, written out: keys are made once for all rules."""
    cols = [F.col(id_col).alias("id"), *more, "k_mun", "k_pub", "k_parcel", "k_addr", "k_proj"]
    return written(with_keys(records).select(*cols).filter("k_mun is not null"), "keyed")


def _parts(left: DataFrame, right: DataFrame):
    """(rank, keys, left rows, right rows) of the equi-joins that make up the rules.

    The rules for a missing publication date split into: missing on the left, and missing on the right only.
    """
    for rank, keys in enumerate(RULE_KEYS):
        filled = " and ".join(f"{k} is not null" for k in keys)
        sides = [(None, None)] if rank < 2 else [("k_pub is null", None), ("k_pub is not null", "k_pub is null")]
        for l, r in sides:
            yield rank, ["k_mun", *keys], left.filter(f"{filled} and {l}" if l else filled), right.filter(f"{filled} and {r}" if r else filled)


def link_pairs(incoming: DataFrame, candidates: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(incoming_id, candidate_id, rule_rank): the first rule that each pair meets, by equi-joins on each rule's keys.

    All pairs are asked for here. Where only the number of candidates counts, link_status does without pairs.
    """
    left, right = keyed(incoming, id_col), keyed(candidates, id_col)
    every = None
    for rank, keys, a, b in _parts(left, right):
        pair = a.select(F.col("id").alias("incoming_id"), *keys).join(b.select(F.col("id").alias("candidate_id"), *keys), keys)
        pair = pair.select("incoming_id", "candidate_id", F.lit(rank).alias("rule_rank"))
        every = pair if every is None else every.unionByName(pair)
    return every.groupBy("incoming_id", "candidate_id").agg(F.min("rule_rank").alias("rule_rank"))


def first_candidates(incoming: DataFrame, candidates: DataFrame, own: bool = False) -> DataFrame:
    """(id, found, rank): up to two candidates of every keyed record that has any, and the first rule that gave one.

    incoming and candidates as keyed() gives them, with a column `kind`; kinds that may not be linked do not meet. Each
    key keeps its two smallest candidates of each kind (three where records may be their own candidates: own), cut down
    in each task before the shuffle, so a key that very many records share costs no more than any other.
    """
    most = 3 if own else 2
    every = None
    for rank, keys, a, b in _parts(incoming, candidates):
        w = Window.partitionBy(*keys, "kind").orderBy("id")
        few = b.select("id", "kind", *keys).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
        few = few.groupBy(*keys, F.col("kind").alias("their")).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most `most`
        met = a.select("id", "kind", *keys).join(few, keys).filter(can_reconcile(F.col("kind"), F.col("their")))
        met = met.select("id", F.lit(rank).alias("rank"), F.explode(F.filter("ids", lambda x: x != F.col("id"))).alias("candidate"))
        every = met if every is None else every.unionByName(met)
    first = every.groupBy("id", "candidate").agg(F.min("rank").alias("rank"))  # a few rows for each record
    return first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("candidate")), 1, 2).alias("found"), F.min("rank").alias("rank"))


def link_status(incoming: DataFrame, candidates: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """One row per incoming record: candidates (0, 1, or 2 for several), status none / matched / ambiguous, and the match
    and its rule where it is the only one. Both sides have a source_kind."""
    kind = F.col("source_kind").alias("kind")
    n = first_candidates(keyed(incoming, id_col, [kind]), keyed(candidates, id_col, [kind]))
    n = n.select(F.col("id").alias("incoming_id"), F.size("found").alias("candidates"), F.col("found")[0].alias("c"), "rank")
    only = F.col("candidates") == 1
    status = F.when(F.col("candidates").isNull(), "none").when(only, "matched").otherwise("ambiguous")
    rule = F.element_at(F.array(*(F.lit(r) for r in RULES)), F.col("rank") + 1)
    return incoming.select(F.col(id_col).alias("incoming_id")).join(n, "incoming_id", "left").select(
        "incoming_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), status.alias("link_status"), F.when(only, F.col("c")).alias("matched_id"), F.when(only, rule).alias("rule")
    )


def can_reconcile(incoming_kind: Column, candidate_kind: Column) -> Column:
    """Imports never link; two authority records never do."""
    return (incoming_kind != "import") & (candidate_kind != "import") & ~((incoming_kind == "authority") & (candidate_kind == "authority"))


def identity_tiers(incoming: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Exact identity: by (kind, reference) of the evidence, else by reference and kind of a record, else by id and reference.

    incoming: rec_id, source_kind, source_reference; evidence and stored likewise with target ids in rec_id.
    """
    pick = lambda df, keys, name: df.groupBy(*keys).agg(F.min("rec_id").alias(name))
    t1 = pick(evidence, ["source_kind", "source_reference"], "id1")
    t2 = pick(stored, ["source_reference", "source_kind"], "id2")
    t3 = stored.select("rec_id", "source_reference", F.col("rec_id").alias("id3")).dropDuplicates(["rec_id", "source_reference"])
    found = incoming.join(t1, ["source_kind", "source_reference"], "left").join(t2, ["source_reference", "source_kind"], "left").join(t3, ["rec_id", "source_reference"], "left")
    tier = F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2).when(F.col("id3").isNotNull(), 3).otherwise(0)
    return found.select("rec_id", F.coalesce("id1", "id2", "id3").alias("target_id"), tier.alias("tier"))


def field_keys() -> dict[str, Column]:
    return {
        "municipality": T.municipality(F.col("municipality")),
        "publication_date": F.trim("publication_date"),
        "deadline_date": F.trim("deadline_date"),
        "parcel": T.parcel(F.col("parcel")),
        "address": T.address(F.col("address")),
        "project_type": T.project(F.col("project_type")),
    }


def group_status(evidence: DataFrame, group_col: str) -> DataFrame:
    """Reconciliation status and conflicting fields of every evidence group.

    evidence: source_kind, match_status and the six fields. A field conflicts when the group holds two different
    filled values of it, that is, when the smallest and the largest differ.
    """
    keyed = evidence.withColumns({f"n_{f}": T.blank_to_null(c) for f, c in field_keys().items()})
    ends = [end(f"n_{f}").alias(f"{name}_{f}") for f in FIELDS for name, end in (("lo", F.min), ("hi", F.max))]
    g = keyed.groupBy(group_col).agg(
        F.bool_or(F.coalesce(F.col("match_status"), F.lit("")).isin("ambiguous", "unmatched")).alias("unsure"),
        F.bool_or(F.col("source_kind") == "authority").alias("has_authority"),
        F.bool_or(F.col("source_kind") == "municipality").alias("has_municipality"),
        F.bool_and(F.col("source_kind") == "import").alias("only_import"),
        F.count(F.lit(1)).alias("evidences"),
        *ends,
    )
    conflicts = F.array_compact(F.array(*(F.when(F.col(f"lo_{f}") < F.col(f"hi_{f}"), F.lit(f)) for f in FIELDS)))
    status = (
        F.when(F.col("unsure"), "ambiguous-review")
        .when(F.col("only_import"), "import-review")
        .when(F.size(conflicts) > 0, "conflict-review")
        .when(F.col("lo_publication_date").isNull(), "missing-publication")
        .when(F.col("has_authority"), "authority-confirmed")
        .when(F.col("has_municipality"), "municipality-only")
        .otherwise("import-review")
    )
    return g.select(group_col, "evidences", status.alias("reconciliation_status"), F.array_join(conflicts, ",").alias("conflicts"))


def golden_record(evidence: DataFrame, group_col: str, order: list[str]) -> DataFrame:
    """Per field the first filled value by source priority, then by `order`."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in PRIORITY[:2])), F.col("source_kind")), F.lit(0))
    rank = F.when(rank == 0, 3).otherwise(rank)
    by = F.struct(rank, *(F.col(c) for c in order))
    picked = [F.min_by(F.trim(f), F.when(F.trim(f) != "", by)).alias(f) for f in FIELDS]
    return evidence.groupBy(group_col).agg(*picked).select(group_col, *(F.coalesce(f, F.lit("")).alias(f) for f in FIELDS))


def upsert_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per (source_kind, source_reference) wins; later observation, then the larger id."""
    w = Window.partitionBy("source_kind", "source_reference").orderBy(F.desc("observed_at"), F.desc("rec_id"))
    return old.unionByName(new).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def attach_evidence(records: DataFrame, evidence: DataFrame, foreign: DataFrame) -> DataFrame:
    """Evidence after foreign evidence was attached to records. One row for each (source_kind, source_reference).

    records: app_id, source_kind, source_reference, observed_at; the others have the same columns, app_id being the
    record that they speak for. A record that gets foreign evidence and has none of its own source yet gets that first,
    so that its own values are not pushed aside; evidence under its kind and reference that spoke for another record
    then speaks for it. Own evidence goes before old, foreign before own; among foreign the later observation wins,
    then the larger app_id. Records that get nothing, and foreign rows of unknown records, change nothing.
    """
    key = ["source_kind", "source_reference"]
    known = foreign.join(records.select("app_id"), "app_id", "left_semi")
    has_own = evidence.select("app_id", *key).distinct()
    own = records.join(known.select("app_id").distinct(), "app_id", "left_semi").join(has_own, ["app_id", *key], "left_anti")
    turns = [df.select("app_id", *key, "observed_at", F.lit(turn).alias("turn")) for turn, df in enumerate((evidence, own, known))]
    every = turns[0].unionByName(turns[1]).unionByName(turns[2])
    last = every.groupBy(*key).agg(F.max(F.struct("turn", "observed_at", "app_id")).alias("s"))
    return last.select("s.app_id", *key, "s.observed_at")


def import_outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of every incoming record in order of rec_id: update, merge or insert.

    Same kind and reference as a stored or an earlier incoming record: update. Else exactly one stored record that may
    be linked: merge. Else insert (none, or several candidates). Columns: rec_id, outcome, target_id, match_status.
    Records of one batch find each other by reference alone, not by content.
    """
    known = stored.groupBy("source_kind", "source_reference").agg(F.min("rec_id").alias("stored_id"))
    first = incoming.groupBy("source_kind", "source_reference").agg(F.min("rec_id").alias("first_id"))
    reference = ["source_kind", "source_reference"]
    seen = written(incoming.join(known, reference, "left").join(first, reference), "seen")
    open_ = seen.filter("stored_id is null and first_id = rec_id and source_kind <> 'import'")
    candidates = stored.filter("workflow_status <> 'archived' and source_kind <> 'import'")
    kind = F.col("source_kind").alias("kind")
    found = first_candidates(keyed(open_, "rec_id", [kind]), keyed(candidates, "rec_id", [kind]))
    found = found.select(F.col("id").alias("rec_id"), F.size("found").alias("n"), F.col("found")[0].alias("cand"))
    out = seen.select("rec_id", "stored_id", "first_id").join(found, "rec_id", "left")
    # a later record of the same reference follows the first one
    update = F.col("stored_id").isNotNull() | (F.col("first_id") != F.col("rec_id"))
    outcome = F.when(update, "update").when(F.col("n") == 1, "merge").otherwise("insert")
    target = F.when(update, F.coalesce("stored_id", "first_id")).when(F.col("n") == 1, F.col("cand")).otherwise(F.col("rec_id"))
    match = F.when(~update & (F.col("n") > 1), "ambiguous").otherwise("matched")
    return out.select("rec_id", outcome.alias("outcome"), target.alias("target_id"), match.alias("match_status"))


#: how the candidates of a key are counted: by kind, and by whether their publication date is missing
CLASSES = [("authority", False), ("authority", True), ("municipality", False), ("municipality", True)]
_KEYS = "struct<m:string,pub:string,parcel:string,addr:string,proj:string>"


def _rule_keys(k: Column) -> Column:
    """One key for each rule that the record's fields allow."""
    sign = "\u0001"
    parts = [("0", "pub", "parcel"), ("1", "pub", "addr"), ("2", "parcel", "proj"), ("3", "addr", "proj")]
    filled = [F.when(k["m"].isNotNull() & k[a].isNotNull() & k[b].isNotNull(), F.concat_ws(sign, F.lit(r), k["m"], k[a], k[b])) for r, a, b in parts]
    return F.array_compact(F.array(*filled))


def _keyed_struct(records: DataFrame, *more: str) -> DataFrame:
    keys = F.struct(F.col("k_mun").alias("m"), F.col("k_pub").alias("pub"), F.col("k_parcel").alias("parcel"), F.col("k_addr").alias("addr"), F.col("k_proj").alias("proj"))
    return with_keys(records).select("rec_id", "source_kind", "source_reference", *more, keys.cast(_KEYS).alias("keys"))


def import_in_order(stored: DataFrame, incoming: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Outcomes of an import in which every record sees what those before it, by rec_id, have done to the table.

    As import_outcomes, but candidates of a record are the stored ones as the updates before it have left them, and the
    records that were inserted before it. A merge leaves its host as it is; later records of a merged reference update
    the host.

    All records are decided at once against the table that the outcomes of the last round make of it at each record's
    turn, until the outcomes stay. A record whose predecessors are right is right in the next round, so the result is
    that of one record after another, and the rounds are as many as the longest chain of records that depend on each
    other. For the table at each turn, a record's content counts from the turn that wrote it until the next that
    overwrites it: a running count over each match key tells how many candidates are there, and where it is one, a
    running xor of their hashes tells which. No pairs are built; a key of any size lies in several partitions.
    """
    old = written(_keyed_struct(stored, "workflow_status"), "import-stored")
    new = written(_keyed_struct(incoming), "import-incoming")
    reference = ["source_kind", "source_reference"]
    known = old.groupBy(*reference).agg(F.min("rec_id").alias("stored_id"))
    first = new.groupBy(*reference).agg(F.min("rec_id").alias("first_id"))
    seen = written(new.join(known, reference, "left").join(first, reference), "import-seen")
    asks = (F.col("stored_id").isNull()) & (F.col("first_id") == F.col("rec_id")) & (F.col("source_kind") != "import")
    open_ = seen.filter(asks)
    apps = old.select("rec_id", "source_kind", (F.col("workflow_status") != "archived").alias("active")).unionByName(new.select("rec_id", "source_kind", F.lit(True).alias("active")))
    apps = written(apps.filter("source_kind <> 'import'").select(F.col("rec_id").alias("app"), F.col("source_kind").alias("kind"), "active", F.xxhash64("rec_id").alias("x")), "import-apps")

    # nothing is decided yet: all are inserted
    guess = written(open_.select(F.col("rec_id").alias("first_id"), F.lit(0).alias("n"), F.col("rec_id").alias("target")), "import-guess")
    for _ in range(most_rounds):
        # who writes which record, and when; a record that is merged writes nothing
        wrote = seen.join(guess, "first_id", "left").withColumn("app", F.coalesce("stored_id", "target", "first_id"))
        wrote = wrote.filter((F.col("rec_id") != F.col("first_id")) | F.col("stored_id").isNotNull() | (F.col("app") == F.col("rec_id")))
        turns = old.select(F.col("rec_id").alias("app"), F.lit("").alias("turn"), "keys").unionByName(wrote.select("app", F.col("rec_id").alias("turn"), "keys"))
        turns = turns.join(apps.filter("active").drop("active"), "app")
        turns = running(turns, ["app"], [F.col("turn")], {"last": ("max", F.struct("turn", "keys"))}, own=False)
        event = lambda k, c: turns.filter(f"{k} is not null").select(F.explode(_rule_keys(F.col(k))).alias("key"), "turn", F.lit(1).alias("late"), F.lit(c).alias("c"), "x", "kind", F.col(f"{k}.pub").isNull().alias("no_pub"), F.lit(None).cast("string").alias("rec_id"))
        asked = open_.select(F.explode(_rule_keys(F.col("keys"))).alias("key"), F.col("rec_id").alias("turn"), F.lit(0).alias("late"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("x"), F.col("source_kind").alias("kind"), F.col("keys.pub").isNull().alias("no_pub"), "rec_id")
        both = event("keys", 1).unionByName(event("last.keys", -1)).unionByName(asked)
        of = lambda k, p, v, none: F.when((F.col("late") == 1) & (F.col("kind") == k) & (F.col("no_pub") == p), F.col(v)).otherwise(F.lit(none))
        values = {f"n{i}": ("sum", of(k, p, "c", 0)) for i, (k, p) in enumerate(CLASSES)} | {f"x{i}": ("xor", of(k, p, "x", 0).cast("long")) for i, (k, p) in enumerate(CLASSES)}
        met = running(both, ["key"], [F.col("turn"), F.col("late"), F.col("x"), F.col("c")], values).filter("rec_id is not null")
        # two authorities do not meet; the last two rules ask that one side lacks its publication date
        may = [(F.col("kind") != k if k == "authority" else F.lit(True)) & (F.lit(p) | F.col("no_pub") | F.substring("key", 1, 1).isin("0", "1")) for k, p in CLASSES]
        count = sum((F.when(m, F.col(f"n{i}")).otherwise(0) for i, m in enumerate(may)), F.lit(0))
        which = F.lit(0).cast("long")
        for i, m in enumerate(may):
            which = which.bitwiseXOR(F.when(m, F.col(f"x{i}")).otherwise(F.lit(0).cast("long")))
        met = met.select("rec_id", count.alias("n"), which.alias("x")).filter("n > 0").groupBy("rec_id")
        found = met.agg(F.max("n").alias("most"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        found = found.select("rec_id", F.when((F.col("most") > 1) | (F.col("lo") != F.col("hi")), 2).otherwise(1).alias("n"), F.col("lo").alias("x"))
        host = found.filter("n = 1").join(apps.select("x", F.col("app").alias("host")), "x").select("rec_id", "host")
        now = open_.select("rec_id").join(found.select("rec_id", "n"), "rec_id", "left").join(host, "rec_id", "left")
        now = now.select(F.col("rec_id").alias("first_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("host", "rec_id").alias("target"))
        now = written(now, "import-guess")
        if now.exceptAll(guess).isEmpty():
            break
        guess = now
    else:
        raise RuntimeError(f"outcomes still change after {most_rounds} rounds")
    rows = seen.join(guess, "first_id", "left")
    update = F.col("stored_id").isNotNull() | (F.col("first_id") != F.col("rec_id"))
    outcome = F.when(update, "update").when(F.col("n") == 1, "merge").otherwise("insert")
    return rows.select("rec_id", outcome.alias("outcome"), F.coalesce("stored_id", "target", "first_id").alias("target_id"), F.when(~update & (F.col("n") > 1), "ambiguous").otherwise("matched").alias("match_status"))


#: columns of a stored record that belong to the team's work and survive an import
KEPT = ["workflow_status", "assignee", "note", "created_at"]


def import_upsert(stored: DataFrame, incoming: DataFrame, outcomes: DataFrame, synced_at: Column) -> DataFrame:
    """The table after an import: stored records with the content of their last update, and the inserted ones.

    An update replaces all but the record's id, reference and KEPT; of several updates of one record the last by rec_id
    stays. A merge adds evidence to its host and leaves the record as it is. change_type is imported, updated or null
    (merges report no change); last_sync_at is set where something changed.
    """
    content = [c for c in stored.columns if c not in ("rec_id", "source_kind", "source_reference", *KEPT)]
    joined = incoming.join(outcomes.select("rec_id", "outcome", "target_id"), "rec_id")
    inserted = joined.filter("outcome = 'insert'").select(*stored.columns).withColumn("change_type", F.lit("imported"))
    rows = stored.withColumn("change_type", F.lit(None).cast("string")).unionByName(inserted)
    last = joined.filter("outcome = 'update'").groupBy(F.col("target_id").alias("rec_id"))
    last = last.agg(F.max(F.struct(F.col("rec_id").alias("_by"), *content)).alias("_new"))
    rows = rows.join(last, "rec_id", "left")
    fresh = F.col("_new").isNotNull()
    change = F.when(F.col("change_type").isNotNull(), F.col("change_type")).when(fresh, "updated")
    values = {c: F.when(fresh, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in content}
    values |= {"change_type": change, "last_sync_at": F.when(change.isNotNull(), synced_at)}
    return rows.withColumns(values).drop("_new")


def import_evidence(incoming: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(rec_id of the record, source_kind, source_reference, match_status) that the import adds; one for each reference."""
    rows = incoming.select("rec_id", "source_kind", "source_reference").join(outcomes, "rec_id")
    w = Window.partitionBy("source_kind", "source_reference").orderBy("rec_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("target_id").alias("rec_id"), "source_kind", "source_reference", "match_status")


def sharing(rows: DataFrame) -> DataFrame:
    """The keyed records that share the keys of a rule with another, where the rule can hold; no others ever form a pair.

    Keys are counted by their hashes: two keys under one hash keep records that nothing will come of, and lose none.
    Hashes are dealt out once, for the counting and for what is read from it.
    """
    def key(i, keys):
        filled = F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()
        return F.when(filled, F.struct(F.xxhash64(F.lit(i), "k_mun", *keys).alias("key"), (F.lit(i < 2) | F.col("k_pub").isNull()).alias("may")))

    able = rows.withColumn("who", F.xxhash64("id"))
    each = able.select("who", F.explode(F.array_compact(F.array(*(key(i, k) for i, k in enumerate(RULE_KEYS))))).alias("k")).select("who", "k.key", "k.may").repartition("key")
    many = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("may").alias("may")).filter("n > 1 and may").select("key")
    live = each.join(many.hint("merge"), "key", "left_semi").select("who").distinct()
    return able.join(written(live, "sharing").hint("merge"), "who", "left_semi").drop("who")


def merge_duplicates(records: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(rec_id, host_id) of the records that are merged away, to a fixpoint.

    records: rec_id, source_kind, workflow_status, touched, created_at and the match fields. A record that is not of
    the authority and has exactly one candidate (not archived, of a kind that it may be linked with) forms a pair with
    it. The host is the touched one, else the authority's, else the older; where both are touched nothing happens. A
    round carries out the pairs that come first, by a hash, for both of their records; what is left is matched again.
    Records that are no candidates (archived ones of other kinds than those that ask, imports) and those that share no
    rule's keys with another are left out from the start, as merging only takes records away.
    """
    kind = F.col("source_kind").alias("kind")
    every = records.filter("source_kind <> 'import' and not (source_kind = 'authority' and workflow_status = 'archived')")
    rows = keyed(every, "rec_id", [kind, "workflow_status", F.coalesce("touched", F.lit(False)).alias("touched"), F.col("created_at").cast("string").alias("made")])
    rows = written(sharing(rows), "unmerged")
    merged = None
    for _ in range(most_rounds):
        found = first_candidates(rows.filter("kind not in ('authority', 'import')"), rows.filter("workflow_status <> 'archived' and kind <> 'import'"), own=True)
        pairs = found.filter(F.size("found") == 1).select(F.col("id").alias("a"), F.col("found")[0].alias("b"))
        side = lambda n: rows.select(F.col("id").alias(n), F.struct((~F.col("touched")).alias("free"), (F.col("kind") != "authority").alias("plain"), F.coalesce("made", F.lit("~")).alias("made"), F.col("id").alias("id")).alias(f"s_{n}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter("s_a.free or s_b.free")
        pairs = pairs.select(F.least("s_a", "s_b")["id"].alias("host"), F.greatest("s_a", "s_b")["id"].alias("rec"))
        pairs = pairs.distinct().withColumn("turn", F.struct(F.xxhash64("host", "rec").alias("h"), "host", "rec"))
        ends = pairs.select(F.explode(F.array("host", "rec")).alias("id"), "turn").groupBy("id").agg(F.min("turn").alias("turn"))
        mine = lambda n: ends.select(F.col("id").alias(n), F.col("turn").alias(f"t_{n}"))
        go = pairs.join(mine("host"), "host").join(mine("rec"), "rec").filter("turn = t_host and turn = t_rec").select("rec", "host")
        go = written(go, "merge")
        if go.isEmpty():
            break
        rows = written(rows.join(go.select(F.col("rec").alias("id")), "id", "left_anti"), "unmerged")
        if merged is None:
            merged = go
        else:  # hosts that were merged away themselves hand on what they took over
            moved = merged.join(go.select(F.col("rec").alias("host"), F.col("host").alias("next")), "host", "left")
            merged = written(moved.select("rec", F.coalesce("next", "host").alias("host")).unionByName(go), "merged")
    else:
        raise RuntimeError("merge did not settle")
    return (merged if merged is not None else go).select(F.col("rec").alias("rec_id"), F.col("host").alias("host_id"))


def repoint(children: DataFrame, merged: DataFrame, key: str = "rec_id", unique: list[str] | None = None) -> DataFrame:
    """Children of merged records under their hosts; where `unique` columns are given, one of each stays."""
    rows = children.join(merged.select(F.col("rec_id").alias(key), "host_id"), key, "left")
    rows = rows.withColumn(key, F.coalesce("host_id", key)).select(children.columns)
    return rows.dropDuplicates([key, *unique]) if unique else rows
