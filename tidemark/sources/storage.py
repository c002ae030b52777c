"""Tables by primary key on Parquet: upsert, latest rows, JSON archives, lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("article_id", "title", "url", "source", "publish_time", "channel")] + [T.StructField("word_count", T.LongType()), T.StructField("content", T.ArrayType(T.StringType()))])
ARCHIVE = T.StructType([T.StructField("date", T.StringType()), T.StructField("count", T.LongType()), T.StructField("articles", T.ArrayType(ARTICLE))])


def latest(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """SNK1: rows of `old` replaced by the last row (by `seq`) of `new` with the same key; keys not in `old` are added."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__seq", F.lit(None).cast(new.schema[seq].dataType)).unionByName(new.select(*old.columns, F.col(seq).alias("__seq")))
    order = F.struct(F.col("__seq").isNotNull(), F.col("__seq"))
    return both.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*old.columns)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], seq: str, partition: str = "date") -> None:
    """Merge `new` into a Parquet table partitioned by `partition`, rewriting only the partitions that `new` touches.

    The merged rows are read back from a checkpoint in the session's shared folder before the overwrite, since a job can't
    overwrite files that it reads.
    """
    old = spark.read.schema(new.drop(seq).schema).parquet(path)
    touched = old.join(new.select(partition).distinct(), partition, "left_semi")
    merged = latest(touched, new, keys, seq).checkpoint()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: articles of JSON archives {date, count, articles}, one row each."""
    return spark.read.schema(ARCHIVE).json(path, multiLine=True).select("date", F.explode("articles").alias("a")).select("date", "a.*")


def read_markdown(spark: SparkSession, path: str, size: int = 400, newest: int = 60) -> DataFrame:
    """SRC11: (path, date, section, chunk, text) of the newest files of a folder: sections of `## ` headings in chunks of fixed length.

    A file's date is the one in its name (YYYY-MM-DD, empty without one); names sort by it, so the newest come last.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    names = whole.select("path").orderBy(F.desc("path")).limit(newest)
    whole = whole.join(F.broadcast(names), "path", "left_semi").withColumn("date", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1))  # `newest` rows
    sections = whole.select("path", "date", F.posexplode(F.split("value", "\n## ")).alias("section", "s"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1)), F.lit(size))
    return sections.select("path", "date", "section", F.posexplode(F.transform(starts, lambda i: F.col("s").substr(i, F.lit(size)))).alias("chunk", "text"))


def append_lines(df: DataFrame, path: str) -> None:
    """SNK8: append rows as lines of JSON."""
    df.write.mode("append").json(path)


def history(reports: DataFrame, articles: DataFrame, before: str, most: int = 4000) -> DataFrame:
    """SRC12: reports older than a date (their first `most` characters), and articles of the older dates that have no report."""
    r = reports.filter(F.col("date") < F.lit(before).cast("date")).withColumns({"text": F.left("text", F.lit(most)), "kind": F.lit("report")})
    a = articles.filter(F.col("date") < F.lit(before).cast("date")).join(reports.select("date").distinct(), "date", "left_anti").withColumn("kind", F.lit("json"))
    return r.unionByName(a.select(*r.columns))


def cached(entries: DataFrame, now: F.Column, keep: str) -> DataFrame:
    """SNK9: (key, value, put_at, alive): the last entry put under each key, and whether it is younger than `keep` at `now`."""
    last = entries.groupBy("key").agg(F.max_by("value", F.struct("put_at", "value")).alias("value"), F.max("put_at").alias("put_at"))
    return last.withColumn("alive", F.col("put_at") + F.expr(f"interval {keep}") > now)


def cache_stats(entries: DataFrame, now: F.Column, keep: str) -> DataFrame:
    """SNK9: number of keys, of those alive, and of entries."""
    c = cached(entries, now, keep)
    return c.agg(F.count("*").alias("keys"), F.count_if("alive").alias("alive")).crossJoin(F.broadcast(entries.agg(F.count("*").alias("entries"))))  # one row each
