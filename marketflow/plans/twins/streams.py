"""Streaming jobs run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.plans import derive as D
from marketflow.plans.twins.base import scratch
from marketflow.plans.twins.common import plain, r, sql
from marketflow.plans.twins.results import RS
from marketflow.plans.twins.results import rows as result_rows
from marketflow.streaming import jobs as J


def _stream(spark, df, files_per_batch: int | None = None):
    """Rows landed as files and read back as a stream, optionally a few files at a time."""
    folder = scratch(spark)
    df.write.parquet(folder)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def _finish(spark, df, mode="append"):
    """Everything available, as a table; complete mode keeps the last full state."""
    out, how = scratch(spark), "overwrite" if mode == "complete" else "append"
    J.run_available(df, scratch(spark), lambda batch, _: batch.write.mode(how).parquet(out), mode)
    return spark.read.schema(df.schema).parquet(out)


def _events(spark, root):
    return D.table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_ingest(spark, root):
    """Good events twice, some without a key and some years old, in several batches; each lands once and every failure is kept."""
    copies = F.when(F.col("value") >= 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    events = _events(spark, root).withColumn("ts", F.when(F.col("event_id") % 5 == 0, F.col("ts") - F.expr("interval 9 years")).otherwise(F.col("ts")))
    twice = events.withColumn("copy", F.explode(copies)).repartition(6, "copy", "event_id").drop("copy")  # copies meet in different files
    twice = twice.withColumn("event_id", F.when((F.col("value") < 1) & (F.col("event_id") % 2 == 0), F.lit(None)).otherwise(F.col("event_id")))
    landed, rejected = scratch(spark), scratch(spark)
    J.stream_ingest(_stream(spark, twice, 2), landed, rejected, scratch(spark), key="event_id", valid="value >= 1").awaitTermination()
    good = spark.read.parquet(landed).withColumn("status", F.lit("ok"))
    bad = spark.read.parquet(rejected).withColumn("status", F.lit("rejected"))
    return good.unionByName(bad).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


def stream_book(spark, root):
    """Per user, the event types in force before each error event, from a stream of changes."""
    ev = D.table(spark, root, "events")
    base = [F.col("user_id").alias("ledger_index"), F.col("event_id").alias("transaction_index")]
    state = F.when(F.col("event_id") % 13 != 0, F.col("value").cast("string"))
    changes = ev.select(*base, F.lit(1).alias("step"), F.lit("change").alias("kind"), F.lit(None).cast("string").alias("tx_hash"), F.col("event_type").alias("entity"), state.alias("state"))
    targets = ev.filter("event_type = 'error'").select(*base, F.lit(0).alias("step"), F.lit("target").alias("kind"), F.col("event_id").cast("string").alias("tx_hash"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("state"))
    out = _finish(spark, J.stream_book(_stream(spark, changes.unionByName(targets))))
    return plain(out.filter("problem is null").select("ledger_index", "transaction_index", "entity", F.col("state").cast("double").alias("state")))


def stream_summary(spark, root):
    return plain(_finish(spark, J.stream_summary(_stream(spark, result_rows(spark, root))), "complete"), 3)


def stream_activity(spark, root):
    out = _finish(spark, J.stream_activity(_stream(spark, _events(spark, root)), time="ts", window="6 hours", by=["event_type"]), "complete")
    return plain(out.select(F.col("window.start").alias("start"), "event_type", "n"))


def stream_order_check(spark, root):
    li = D.table(spark, root, "lineitem").select(F.col("l_orderkey").alias("ledger_index"), (F.col("l_linenumber") - 1).cast("bigint").alias("transaction_index")).distinct()
    return _finish(spark, J.stream_order_check(_stream(spark, li)))


TWINS = {
    "stream_ingest": (stream_ingest, "SELECT event_type, CASE WHEN value >= 1 THEN 'ok' ELSE 'rejected' END status, count(*) n FROM events GROUP BY 1, 2"),
    "stream_book": (stream_book, "WITH t AS (SELECT user_id, event_id ti FROM events WHERE event_type = 'error'), ty AS (SELECT DISTINCT event_type FROM events), q AS (SELECT t.*, ty.event_type FROM t, ty), "
        f"ch AS (SELECT user_id, event_type, event_id pos, CASE WHEN event_id % 13 <> 0 THEN value END s FROM events) SELECT q.user_id ledger_index, q.ti transaction_index, q.event_type entity, {r('ch.s')} AS state FROM q ASOF JOIN ch ON q.user_id = ch.user_id AND q.event_type = ch.event_type AND q.ti > ch.pos WHERE ch.s IS NOT NULL"),
    "stream_summary": (stream_summary, sql(RS, f"SELECT pair, coalesce(lm, 'unknown') measurement, count(*) n, count(*) FILTER (fnd) improved, {r('sum(CASE WHEN fnd THEN CAST(gain AS DOUBLE) END)', 3)} total_gain, {r('max(CASE WHEN fnd THEN ibps END)', 3)} max_bps FROM rs GROUP BY 1, 2")),
    "stream_activity": (stream_activity, "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n FROM events GROUP BY 1, 2"),
    "stream_order_check": (stream_order_check, "WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 i FROM lineitem), w AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY l_orderkey ORDER BY i) + 1, 0) e FROM q) SELECT l_orderkey ledger_index, CAST(e AS BIGINT) expected, CAST(i AS BIGINT) AS found FROM w WHERE e <> i"),
}
