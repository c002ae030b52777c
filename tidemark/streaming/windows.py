"""Event-time windows over streams of Parquet files: sliding windows, sessions, and the run of a stream to its end.

Windows leave the state when the watermark passes their end, which is also when their row is written; a row that comes after that
is dropped. So the state holds the windows of the last `late` and no more, however long the stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.views import checkpoint_dir


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a path, at most `files` of them in a batch."""
    source = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    return source.parquet(path[:-1] + f"[{path[-1]}]")  # a stream reads folders or patterns, not one file


def timed(events: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """Events with their time as a timestamp and a watermark that trails the newest by `late`; rows without a time are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull()).withWatermark(time, late)


def sliding(events: DataFrame, width: str, slide: str, by: list[str], value: str = "value", time: str = "ts") -> DataFrame:
    """ST7: (start, end, *by, n, total) of windows of `width` that start every `slide`; a row lies in width / slide of them."""
    made = events.groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: list[str], value: str = "value", time: str = "ts") -> DataFrame:
    """ST7: (start, end, *by, n, total) of runs of rows with less than `gap` between neighbours; a session ends `gap` after its last row.

    A row between two sessions makes them one, also when they came in earlier batches.
    """
    made = events.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "total")


def replay(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], late: str, time: str = "ts", files: int | None = None) -> DataFrame:
    """The rows that `make` (windows of a timed stream, in append mode) gives for a path of Parquet files, run to its end.

    Append mode keeps the last windows open for rows that might still come. Here none will: a second run from the same checkpoint
    reads one closing row, a century later than all others, whose arrival moves the watermark past every open window. Its own window
    stays open and never shows. Executors write the results; the driver sees none of them.
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    ends = T.StructType([f for f in schema.fields if f.name == time])
    spark.createDataFrame([], ends).write.parquet(f"{base}/end")
    last = spark.read.parquet(path).agg(F.max(F.col(time).cast("timestamp")).alias("t"))

    def run() -> None:
        closing = spark.readStream.schema(ends).parquet(f"{base}/end")
        both = read(spark, path, schema, files).unionByName(closing, allowMissingColumns=True)
        q = make(timed(both, late, time)).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    last.filter("t is not null").select((F.col("t") + F.expr("interval 100 years")).cast(ends[time].dataType).alias(time)).write.mode("append").parquet(f"{base}/end")
    run()
    return spark.read.parquet(f"{base}/out")
