"""Streaming: alert rules, suppression of repeated alerts, event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def alert_rows(daily: DataFrame, critical: float = 30, warning: float = 40, policy: float = -0.4, entropy: float = 0.3) -> DataFrame:
    """ST1: (date, kind, level) of every rule that a day's metrics break; the same for a batch and a stream.

    Attention is too concentrated below `entropy` on a day on which any industry was hit.
    """
    s = F.col("sentiment_index")
    rules = [F.when(s < critical, F.struct(F.lit("sentiment").alias("kind"), F.lit("critical").alias("level"))).when(s < warning, F.struct(F.lit("sentiment").alias("kind"), F.lit("warning").alias("level"))),
        F.when(F.col("policy_stance_score") < policy, F.struct(F.lit("policy").alias("kind"), F.lit("warning").alias("level"))),
        F.when((F.col("attention_entropy") < entropy) & (F.col("industry_count") > 0), F.struct(F.lit("volatility").alias("kind"), F.lit("warning").alias("level")))]
    return daily.select("date", F.explode(F.array_compact(F.array(*rules))).alias("a")).select("date", "a.kind", "a.level")


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """ST7: events (ts, event_type, value) by event-time window, with a watermark for late rows."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stream_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows of a Parquet path run as a stream to its end, as a table in the checkpoint folder.

    Each batch's changed windows are written as files by the executors, with the batch's number; the newest row of a window is its
    result. Nothing passes through the driver.
    """
    from ..operators.views import checkpoint_dir

    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")  # a stream reads folders or patterns, not one file
    base = f"{checkpoint_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    q = event_windows(source).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def suppressed(alerts: DataFrame, seconds: int = 60) -> DataFrame:
    """ST2 for a batch: alerts (key, ts) that fire: each at least `seconds` after the last fired one of its key.

    The fold depends on order, so the alerts of one key are folded in one array.
    """
    rows = alerts.groupBy("key").agg(F.sort_array(F.collect_list(F.col("ts").cast("timestamp").cast("double"))).alias("l"))
    zero = F.array().cast("array<double>")
    fired = F.aggregate("l", zero, lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= seconds), F.concat(a, F.array(x))).otherwise(a))
    return rows.select("key", F.explode(fired).alias("at")).select("key", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long")).alias("ts"))
