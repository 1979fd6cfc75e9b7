"""Streaming queries over the driver tables as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..sources.work import work_path
from ..streaming import jobs as J
from .learning import FOLD
from .register import query


def event_files(t):
    """The folder with the events in four files, and their schema."""
    rows = t.events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    path = work_path(t.spark, "event-files")
    rows.repartition(4, "event_id").write.parquet(path)
    return path, rows.schema


def events(t):
    return J.file_stream(t.spark, *event_files(t), 1)  # a batch for each file


@query("k1_incremental_ingest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def k1(t):
    return J.ingest(events(t), "user_id", "ts").select("user_id", "event_id")


@query("k2_duplicate_suppression", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def k2(t):
    """The first event of each kind and user; later files repeat them."""
    rows = events(t).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return J.suppress_repeats(rows, "key", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("k3_late_records", "SELECT ts < TIMESTAMP '2024-01-20' - INTERVAL 10 DAY AS late, count(*) AS n FROM (SELECT CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN ts END AS ts FROM events) GROUP BY 1 HAVING late IS NOT NULL UNION ALL SELECT NULL, count(*) FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def k3(t):
    active, late = J.split_late(events(t), "ts", "2024-01-20", 10)
    rows = active.select(F.when(F.col("ts").isNotNull(), F.lit(False)).alias("late")).unionByName(late.select(F.lit(True).alias("late")))
    return rows.groupBy("late").agg(F.count(F.lit(1)).alias("n"))


@query("k3_active_by_timer", "SELECT user_id, max(date_trunc('milliseconds', ts)) AS ts FROM events GROUP BY 1 HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def k3_timer(t):
    """Users with an event in the last ten days of event time; timers take the others out of the state."""
    path = event_files(t)
    changes, _ = J.expire_active(lambda: J.file_stream(t.spark, *path, 1), "user_id", "ts", 10)
    last = changes.groupBy("user_id").agg(F.max(F.struct("ts", "change")).alias("s"))
    return last.filter("s.change = 'active'").select("user_id", "s.ts")


@query("k4_notifications", "SELECT event_id FROM events WHERE event_type <> (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 40")
def k4(t):
    first = t.events.agg(F.min("event_type")).first()[0]
    return J.notifications(events(t), F.col("event_type") != first, ["ts", "event_id"]).select("event_id")


@query("k5_online_learning", f"WITH {FOLD} SELECT municipality_key, address_signature, project_signature, protection_status, match_count, confidence FROM rules", "lrn")
def k5(t):
    """Decisions as they come, a quarter of the time span in a batch."""
    rows, path = t.lrn, work_path(t.spark, "decision-files")
    low, high = rows.agg(F.min(F.unix_timestamp("decided_at")), F.max(F.unix_timestamp("decided_at"))).first()
    if low is None:
        rows.write.parquet(path)  # no decisions: an empty stream
    else:
        part = F.least(F.lit(3), F.floor((F.unix_timestamp("decided_at") - low) * 4 / (high - low + 1)))
        for k in range(4):  # one after the other, so that later decisions lie in later files; a signature's in one of them
            rows.filter(part == k).repartition(4, *L.KEY).write.mode("append").parquet(path)
    return J.learn_online(J.file_stream(t.spark, path, rows.schema, 4), L.KEY, "protection_status", ["decided_at", "decision_id"])
