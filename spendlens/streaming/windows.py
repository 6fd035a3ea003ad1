"""Event-time windows, enrichment and joins over streams, and how to run them to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.skew import last_per_key
from spendlens.session import shared_scratch

c = F.col
LATE = "1 hour"
SUMS = ["spend", "revenue", "clicks", "impressions", "conversions"]


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table as a stream; the schema comes from the files once."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """ts as TIMESTAMP with its watermark (a batch ignores the watermark)."""
    typed = df.withColumn(ts, c(ts).cast("timestamp"))
    return typed.withWatermark(ts, late) if df.isStreaming else typed


def metrics_tumbling(df: DataFrame, key: str, ts: str = "ts", size: str = "30 minutes", late: str = LATE) -> DataFrame:
    g = _event_time(df, ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(*[F.sum(s).alias(s) for s in SUMS])
    return g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), key, *SUMS)


def metrics_sliding(df: DataFrame, key: str, ts: str = "ts", size: str = "24 hours", slide: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Trailing sums every slide; rows meet per slide first, so 48 copies are made of sums, not of events."""
    step = _event_time(df, ts, late).groupBy(F.window(ts, slide).alias("w"), key).agg(*[F.sum(s).alias(s) for s in SUMS])
    g = step.groupBy(F.window(F.window_time("w"), size, slide).alias("w"), key).agg(*[F.sum(s).alias(s) for s in SUMS])
    return g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), key, *SUMS)


def session_stream(df: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    g = _event_time(df, ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("events"))
    return g.select(user, c("s.start").alias("session_start"), c("s.end").alias("session_end"), "events")


def enrich_stream(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Stream-static left join with the campaign dimension."""
    return events.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id", "left")


def prediction_actual_stream(predictions: DataFrame, actuals: DataFrame, within: str = "7 days", late: str = LATE) -> DataFrame:
    """Predictions meet the actual logged within the interval; both states are bounded by it."""
    p = _event_time(predictions, "ts", late).alias("p")
    a = _event_time(actuals.withColumnRenamed("ts", "actual_ts").withColumnRenamed("id", "actual_id"), "actual_ts", late).drop("model").alias("a")
    on = (c("id") == c("actual_id")) & (c("actual_ts") >= c("ts")) & (c("actual_ts") <= c("ts") + F.expr(f"interval {within}"))
    return p.join(a, on).select("model", "id", "prediction", "actual", "ts", "actual_ts")


def run_append(df: DataFrame, path: str, checkpoint: str, store: str | None = None) -> None:
    """Everything available, then stop; exactly once through the checkpoint.

    ``store`` names the state store of this query, as keyed timers need one; the session's own setting stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if store:
        conf.set(name, store)
    try:
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        conf.set(name, before)
    q.awaitTermination()


def run_batches(df: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    q = df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_update(df: DataFrame, path: str, checkpoint: str) -> None:
    """Changed rows of each batch, numbered; latest_state gives the final ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(df, write, checkpoint, "update")


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return last_per_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def collect_append(df: DataFrame, name: str, store: str | None = None) -> DataFrame:
    """Run an append stream into the shared folder and read the result."""
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    run_append(df, path, shared_scratch(spark, f"{name}-ckpt"), store)
    return spark.read.parquet(path)


def collect_update(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    run_update(df, path, shared_scratch(spark, f"{name}-ckpt"))
    return latest_state(spark, path, keys)
