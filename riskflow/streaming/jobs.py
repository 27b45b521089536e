"""Structured Streaming jobs (SS-4..SS-10, IO-7) over a file source.

* Event time is ``ts`` (a TIMESTAMP; the driver files hold TIMESTAMP_NTZ,
  which ``withWatermark`` refuses, so it is cast under the UTC session zone).
* Windowed aggregates run in append mode: a window is emitted once the
  watermark passes its end; a run with ``availableNow`` ends with a no-data
  batch, so every window ending at or before ``max(ts) - delay`` is emitted.
* Sinks are idempotent: the file sink commits through its own log, and
  ``foreachBatch`` writers overwrite ``batch_id=N`` so a retried batch
  replaces rather than duplicates its output.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.session import materialize, scratch_path

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file source over ``path`` (a folder that grows, a pattern or one file)."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def _run(stream: DataFrame, name: str, sink) -> str:
    """Run over everything available; ``sink(writer, out)`` completes the
    writer.  Returns the folder that the sink wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")
    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, f"{name}-ck"))
    sink(writer.trigger(availableNow=True), out).awaitTermination()
    return out


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available into a Parquet file
    sink under the shared folder; return the written table as a batch frame."""
    out = _run(stream, name, lambda w, path: w.format("parquet").outputMode(mode).start(path))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_foreach(stream: DataFrame, name: str, fn) -> str:
    """Run with a ``foreachBatch`` function ``fn(df, batch_id, out_path)``."""
    return _run(stream, name, lambda w, path: w.foreachBatch(lambda d, b: fn(d, b, path)).start())


def transactions_stream(events: DataFrame) -> DataFrame:
    """The §2.15 transaction binding applied to a streaming events frame, plus
    an event-time ``ts`` column."""
    from riskflow.bindings import transactions_from_events
    return transactions_from_events(events).withColumn(
        "ts", F.timestamp_seconds(F.col("t")))


def ended(spark: SparkSession, path: str, delay_seconds: int) -> DataFrame:
    """The events under ``path`` with a mark of their end: one more event, ``delay_seconds``
    and a second later than the last.  It moves the watermark past every event, so that
    all leave a stateful step that releases rows behind the watermark; the mark itself
    stays ahead of the watermark and is never released."""
    from riskflow.bindings import epoch_seconds
    last = spark.read.schema(EVENT_SCHEMA).parquet(path).agg(F.max(epoch_seconds(F.col("ts"))).alias("t")).where("t is not null")
    mark = last.select(F.lit(0).cast("long").alias("event_id"),
                       F.timestamp_seconds(F.col("t") + delay_seconds + 1).cast("timestamp_ntz").alias("ts"),
                       F.lit(0).cast("long").alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    out = scratch_path(spark, "stream-end")
    mark.write.parquet(out)
    return read_stream(spark, path, EVENT_SCHEMA).unionByName(read_stream(spark, out, EVENT_SCHEMA))


# ----------------------------------------------------------------------------- SS-5..SS-8
def tumbling_kpis(txn: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """SS-5: per window: volume, mean ticket, flagged count, highest score."""
    w = txn.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("volume"),
                 F.avg("amount").alias("average_ticket"),
                 F.sum(F.when(F.col("score") >= 0.6, 1).otherwise(0)).alias("flagged"),
                 F.max("score").alias("highest_score")) \
            .select(F.unix_seconds(F.col("w.start")).alias("window_start"), "n", "volume",
                    "average_ticket", "flagged", "highest_score")


def sliding_rate(txn: DataFrame, size: str = "24 hours", slide: str = "1 hour",
                 delay: str = "1 hour") -> DataFrame:
    """SS-6: fraud rate in sliding windows."""
    w = txn.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud")) \
            .select(F.unix_seconds(F.col("w.start")).alias("window_start"), "n", "fraud",
                    (F.col("fraud") / F.col("n")).alias("fraud_rate"))


def burst_sessions(txn: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """SS-7: per card, sessions of transactions separated by less than ``gap``."""
    s = txn.withWatermark("ts", delay).groupBy("card", F.session_window("ts", gap).alias("s"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")) \
            .select("card", F.unix_seconds(F.col("s.start")).alias("session_start"),
                    F.unix_seconds(F.col("s.end")).alias("session_end"), "n", "amount")


def dedup(txn: DataFrame, delay: str = "1 day") -> DataFrame:
    """SS-8: drop re-delivered transaction ids seen within the watermark."""
    return txn.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["txn_id"])


# ----------------------------------------------------------------------------- SS-8 / SS-9
ROUTES = ("on_time", "late", "repeated")


def _tables(spark: SparkSession, out: str, name: str, before: int, schema: str) -> DataFrame:
    """What earlier batches of this run kept under ``name``."""
    if before == 0:  # no folder yet
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch_id int").parquet(os.path.join(out, name)).where(
        F.col("batch_id") < before).drop("batch_id")


def arrival_router(delay_seconds: int, ttl_seconds: int, id_col: str = "txn_id", t: str = "t",
                   arrival: str = "arrival", day: int = 86400):
    """SS-8 / SS-9: a ``foreachBatch`` function that writes every delivered row to
    one of three folders, with the reason in numbers:

    * ``repeated``: its id was delivered before, at most ``ttl_seconds`` earlier
      (``previous_arrival`` says when); a table of ids, not the watermark, decides;
    * ``late``: its time lies more than ``delay_seconds`` behind the latest time
      that arrived in an earlier second (``behind`` says how much);
    * ``on_time``: all others, and rows without id, time or arrival.

    ``t`` and ``arrival`` are whole seconds; deliveries of one id in one second
    count in the order of ``t``.  Batches come in order of arrival; where they
    are cut makes no difference.  The folders, the table of ids and that of the
    latest times are written per batch (a retry overwrites its own)."""
    def fn(df: DataFrame, batch_id: int, out: str) -> None:
        spark = df.sparkSession
        df = materialize(df.withColumn("_at", F.col(arrival).cast("long")), "arrivals")
        oldest = df.agg(F.coalesce(F.min("_at"), F.lit(0))).first()[0]

        def put(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(os.path.join(out, name, f"batch_id={batch_id}"))

        # when each id was delivered before, here or in an earlier batch
        kind = dict(df.dtypes)
        known = _tables(spark, out, "_ids", batch_id, f"{id_col} {kind[id_col]}, _at bigint, {t} {kind[t]}")
        here = df.groupBy(id_col, "_at", t).agg(F.count("*").alias("copies"))
        order = Window.partitionBy(id_col).orderBy("_at", t)
        facts = (here.unionByName(known.where(F.col("_at") >= oldest - ttl_seconds).withColumn("copies", F.lit(0).cast("long")))
                 .where(F.col(id_col).isNotNull())
                 .withColumn("prev", F.lag("_at").over(order)).where("copies > 0"))
        # the latest time that arrived before each second: whole days first, then the seconds of a day
        ends = _tables(spark, out, "_latest", batch_id, "_at bigint, top bigint")
        past = ends.where(F.col("_at") < oldest).agg(F.max("top")).first()[0]
        earlier = Window.unboundedPreceding, -1
        seconds = (df.select("_at", F.col(t).cast("long").alias("top")).unionByName(ends.where(F.col("_at") >= oldest))
                   .groupBy("_at").agg(F.max("top").alias("top")).withColumn("d", F.floor(F.col("_at") / day)))
        days = seconds.groupBy("d").agg(F.max("top").alias("top"))  # one row a day
        days = days.select("d", F.max("top").over(Window.orderBy("d").rowsBetween(*earlier)).alias("past"))
        in_day = F.max("top").over(Window.partitionBy("d").orderBy("_at").rowsBetween(*earlier))
        seconds = seconds.withColumn("in_day", in_day).join(days, "d").select(
            "_at", F.greatest("in_day", "past", F.lit(past).cast("long")).alias("latest"))
        rows = df.join(facts, [id_col, "_at", t], "left").join(seconds, "_at", "left")
        copy = F.row_number().over(Window.partitionBy(id_col, "_at", t).orderBy(F.lit(1)))
        rows = rows.withColumn("_copy", F.when(F.col("copies") > 1, copy).otherwise(1))  # equal deliveries
        previous = F.when(F.col("_copy") > 1, F.col("_at")).when(F.col("_at") - F.col("prev") <= ttl_seconds, F.col("prev"))
        behind = F.col("latest") - F.col(t)
        rows = (rows.withColumn("previous_arrival", previous)
                .withColumn("behind", F.when(F.col("previous_arrival").isNull() & (behind > delay_seconds), behind))
                .withColumn("route", F.when(F.col("previous_arrival").isNotNull(), "repeated")
                            .when(F.col("behind").isNotNull(), "late").otherwise("on_time")))
        rows = materialize(rows.drop("_at", "_copy", "prev", "copies", "latest"), "routed")
        for route in ROUTES:
            put(rows.where(F.col("route") == route).drop("route"), route)
        put(facts.select(id_col, "_at", t), "_ids")
        newest = df.agg(F.max("_at")).first()[0]
        # the newest second may go on in the next batch: its latest time is kept apart
        put(df.where("_at is not null").groupBy((F.col("_at") == F.lit(newest).cast("long")).alias("last"))
            .agg(F.max("_at").alias("_at"), F.max(F.col(t).cast("long")).alias("top")).drop("last"), "_latest")
    return fn


def routed(spark: SparkSession, out: str) -> DataFrame:
    """All rows that ``arrival_router`` wrote, with their route."""
    parts = [spark.read.parquet(os.path.join(out, r)).drop("batch_id").withColumn("route", F.lit(r)) for r in ROUTES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ----------------------------------------------------------------------------- SS-10 / SS-4
def enrich(stream: DataFrame, profiles: DataFrame, key: str = "card") -> DataFrame:
    """SS-10: stream-static left join with a batch table (profiles, rules,
    dictionaries); the static side is re-read per batch."""
    return stream.join(profiles, key, "left")


def score_stream(features: DataFrame, model, names: list[str], out: str = "model_score",
                 keep: list[str] | None = None) -> DataFrame:
    """SS-4: a fitted pipeline applied inside the streaming plan (schema aligned
    as in batch); every row gets the score that the batch gives it."""
    from riskflow.operators.models import score
    return score(features, model, names, out, keep)


def alert_writer(min_band: str = "HIGH", score: str = "score"):
    """SS-4: ``foreachBatch`` sink of banded alerts, idempotent by batch id."""
    from riskflow.functions.bands import decision, risk_band
    edge = {"MEDIUM": 0.3, "HIGH": 0.6, "CRITICAL": 0.85}[min_band]

    def fn(df: DataFrame, batch_id: int, out: str) -> None:
        alerts = (df.filter(F.col(score) >= edge)
                    .withColumn("risk_band", risk_band(score)).withColumn("decision", decision(score)))
        alerts.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
    return fn
