"""Intermediate tables in the session's shared folder: written once, read by several steps, deleted when nothing needs them."""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from ..operators.views import checkpoint_dir

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_kept: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str, most_rows: int = 0) -> DataFrame:
    """`df` as Parquet in the shared folder, read back: cuts lineage and survives lost executors. Goes when the driver's Python ends.

    Files have `most_rows` rows at most, if given.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out], _kept[path] = path, spark
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that `written` made; nothing may read them afterwards. Other frames are left alone."""
    for df in frames:
        path = _paths.pop(df, None)
        if path and path in _kept:
            _delete(_kept.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    while _kept:
        path, spark = _kept.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before; its folder is the user's to clear
            return
