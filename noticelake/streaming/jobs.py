"""Incremental jobs: ingest, duplicate suppression, late records, notifications, online rule learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import work_path, written


def file_stream(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they come, at most `files` of them in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def home_of(stream: DataFrame, name: str, home: str | None) -> str:
    """The folder that holds a job's table and checkpoint from run to run."""
    return home or work_path(stream.sparkSession, name)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """One run over what is there, then stop; the checkpoint makes the next run go on from there."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(path: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number, so that a repeated batch replaces itself."""
    return lambda batch, n: transform(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")


def read_batches(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key; ties by the other columns."""
    others = [F.col(c) for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(order), *others)).alias("_s"))
    return best.select(*(F.col(key) if c == key else F.col(f"_s.{c}") for c in rows.columns))


def merge_into(path: str, key: str, order: str, buckets: int) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of every key. The table is partitioned by a hash of the key; a batch rewrites
    the buckets that it touches and reads no others. A repeated batch changes nothing."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = newest(batch, key, order).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows = written(rows, "merge-batch")
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        old = spark.read.schema(rows.schema).parquet(path).filter(F.col("_bucket").isin(touched))
        merged = written(newest(old.unionByName(rows).drop("_bucket"), key, order).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "merge-buckets")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    return each


def ingest(stream: DataFrame, key: str, order: str, home: str | None = None, buckets: int = 16) -> DataFrame:
    """Idempotent upsert: the newest row of every key, merged batch by batch."""
    spark, home = stream.sparkSession, home_of(stream, "ingest", home)
    table = f"{home}/table"
    columns = spark.createDataFrame([], stream.schema).withColumn("_bucket", F.lit(0))
    columns.write.mode("append").partitionBy("_bucket").parquet(table)  # the folder, before the first batch
    run_available(stream, merge_into(table, key, order, buckets), f"{home}/checkpoint")
    return spark.read.schema(columns.schema).parquet(table).drop("_bucket")


def suppress_repeats(stream: DataFrame, key: str, time: str, delay: str = "31 days", home: str | None = None) -> DataFrame:
    """The first record of every key within the watermark."""
    home = home_of(stream, "unique", home)
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    run_available(unique, append_to(f"{home}/rows"), f"{home}/checkpoint")
    return read_batches(stream.sparkSession, unique.schema, f"{home}/rows")


def split_late(stream: DataFrame, time: str, reference: str, days: int = 31, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Active and late records; those after the reference lose their time."""
    spark, home = stream.sparkSession, home_of(stream, "late", home)
    ref = F.lit(reference).cast("timestamp")

    def each(batch, n):
        seen = batch.withColumn(time, F.when(F.col(time) <= ref, F.col(time)))
        old = F.coalesce(F.col(time) < ref - F.expr(f"interval {days} days"), F.lit(False))
        append_to(f"{home}/active")(seen.filter(~old), n)
        append_to(f"{home}/late")(seen.filter(old), n)

    run_available(stream, each, f"{home}/checkpoint")
    return read_batches(spark, stream.schema, f"{home}/active"), read_batches(spark, stream.schema, f"{home}/late")


def expire_active(source: Callable[[], DataFrame], key: str, time: str, days: int = 31, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, time, change) of every record's changes, and the rows that came too late.

    source() gives the stream; time is not null. A record is active from its newest time on, for `days` of event time:
    a timer in its state then takes it out (change: expired), whether or not another row of it comes. The state of a
    record is its newest time, and is cleared with it. Rows older than that when they come change nothing; they go to a
    table of their own. The newest change of a record by (time, change) is its present one.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Active(StatefulProcessor):
        def init(self, handle):
            self.handle, self.newest = handle, handle.getValueState("newest", "ms long")

        def handleInputRows(self, key, rows, timerValues):
            came = max(int(r[time].max().value // 1_000_000) for r in rows)
            held = self.newest.get()[0] if self.newest.exists() else None
            if held is None or came > held:
                if held is not None:
                    self.handle.deleteTimer(held)
                self.newest.update((came,))
                self.handle.registerTimer(came)  # the watermark is `days` behind the newest time of all
                yield self._change(key, came, "active")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.newest.get()[0]
            self.newest.clear()
            yield self._change(key, held, "expired")

        def _change(self, key, ms, change):
            return pd.DataFrame({names[0]: [key[0]], names[1]: [pd.Timestamp(ms, unit="ms")], "change": [change]})

        def close(self):
            pass

    names = [key, time]
    stream = source()
    spark, home = stream.sparkSession, home_of(stream, "active", home)
    kind = stream.schema[key].dataType.simpleString()
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = stream.select(key, time).withWatermark(time, f"{days} days")
        changes = rows.groupBy(key).transformWithStateInPandas(Active(), f"{key} {kind}, {time} timestamp, change string", "Append", "EventTime")
        run_available(changes, append_to(f"{home}/changes"), f"{home}/checkpoint")
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return read_batches(spark, changes.schema, f"{home}/changes"), too_late(source(), time, days, f"{home}/late-rows")


def too_late(stream: DataFrame, time: str, days: int, home: str) -> DataFrame:
    """Rows that are `days` older, when they come, than the newest time of all batches before theirs."""
    spark = stream.sparkSession
    clock = spark.createDataFrame([], "batch long, newest timestamp")
    clock.write.mode("append").parquet(f"{home}/clock")
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{home}/rows")

    def each(batch: DataFrame, n: int) -> None:
        # one row for each batch; a batch that comes again does not see itself
        newest = read_batches(spark, clock.schema, f"{home}/clock").filter(F.col("batch") < n).agg(F.max("newest")).first()[0]
        append_to(f"{home}/clock")(batch.agg(F.lit(n).cast("long").alias("batch"), F.max(time).alias("newest")), n)
        bound = F.lit(newest).cast("timestamp") - F.expr(f"interval {days} days")
        append_to(f"{home}/rows")(batch.filter(F.coalesce(F.col(time) < bound, F.lit(False))), n)

    run_available(stream, each, f"{home}/checkpoint")
    return read_batches(spark, stream.schema, f"{home}/rows")


def notifications(stream: DataFrame, wanted, order: list[str], keep: int = 40, home: str | None = None) -> DataFrame:
    """The newest `keep` notifications of all batches; the later ones by `order`.

    A batch writes the newest of its own and those that the batch before it left, so no more than these are read; a
    batch that comes again does the same again.
    """
    spark, home = stream.sparkSession, home_of(stream, "notes", home)
    first = lambda d: d.orderBy(*(F.desc(c) for c in order)).limit(keep)
    left = lambda n: spark.read.schema(stream.schema).parquet(f"{home}/newest/batch={n}")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{home}/newest/batch=-1")  # in front of the first

    def each(batch: DataFrame, n: int) -> None:
        append_to(f"{home}/newest", first)(batch.filter(wanted).unionByName(left(n - 1)), n)

    run_available(stream, each, f"{home}/checkpoint")
    newest = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{home}/newest").agg(F.max("batch")).first()[0]
    return first(left(-1 if newest is None else newest))


def learn_online(stream: DataFrame, keys: list[str], status: str, order: list[str], home: str | None = None) -> DataFrame:
    """Rules folded from decisions as they come: status, decisions and confidence of every signature.

    The state of a signature is its status, the length of its last run of equal statuses, whether that run is its
    first, and its decisions so far. A batch's decisions of a signature are folded in order; batches in the order of
    their arrival. Earlier decisions are not read again.
    """
    import pandas as pd

    from ..operators.learning import FIRST_CONFIDENCE, MOST, NEW_STATUS, STEP

    spark, home = stream.sparkSession, home_of(stream, "rules", home)

    def fold(key, chunks, state):
        held, run, first, n = state.get if state.exists else (None, 0, True, 0)
        rows = pd.concat(list(chunks)).sort_values(order)
        for s in rows[status]:
            first = first and held in (None, s)
            run, held = (run + 1, s) if s == held else (1, s)
            n += 1
        state.update((held, run, first, n))
        confidence = round(min(MOST, (FIRST_CONFIDENCE if first else NEW_STATUS) + STEP * (run - 1)), 4)
        yield pd.DataFrame([(*key, held, n, confidence)], columns=[*keys, status, "match_count", "confidence"])

    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, status]) + ", match_count long, confidence double"
    rules = stream.groupBy(*keys).applyInPandasWithState(fold, schema, "status string, run long, first boolean, n long", "update", "NoTimeout")
    versions = lambda d, n: append_to(f"{home}/rules", lambda r: r.withColumn("_version", F.lit(n)))(d, n)
    run_available(rules, versions, f"{home}/checkpoint", "update")
    every = read_batches(spark, rules.schema.add("_version", "integer"), f"{home}/rules")
    latest = every.groupBy(*keys).agg(F.max(F.struct("_version", status, "match_count", "confidence")).alias("s"))
    return latest.select(*keys, f"s.{status}", "s.match_count", "s.confidence")
