"""Small relational operators: packing, links, arrows, keep-max, cost statistics, top rows by key, chunks, dispersion of stances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pack_prompt(blocks: DataFrame, by: str, order: str, text: str, block: int = 400, total: int = 8000) -> DataFrame:
    """FN23: blocks cut to `block` characters, in order, until the running length first exceeds `total`."""
    b = blocks.withColumn("block", F.left(F.col(text), F.lit(block)))
    run = F.sum(F.length("block")).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return b.withColumn("running", run).filter(F.col("running") <= total).select(by, order, "block", "running")


def trend_arrows(rows: DataFrame, key: str, order: str, value: str, band: float = 0.05) -> DataFrame:
    """FN25: arrow from the last two values; level where any of the newest three is missing."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    n = rows.withColumn("back", back).filter("back <= 3").groupBy(key).agg(*[F.max(F.when(F.col("back") == i, F.col(value))).alias(f"v{i}") for i in (1, 2, 3)])
    d = F.col("v1") - F.col("v2")
    return n.select(key, F.when(F.col("v1").isNull() | F.col("v2").isNull() | F.col("v3").isNull(), "→").when(d > band, "↑").when(d < -band, "↓").otherwise("→").alias("arrow"))


def keep_max(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """SC1: for each key the row of largest value, the first by `order` if tied."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def usage(rows: DataFrame, task: str, tokens: str, cost: str, ok: str) -> DataFrame:
    """AG14: calls, tokens, cost and success rate of each task."""
    return rows.groupBy(task).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"), F.avg(F.col(ok).cast("double")).alias("success_rate"))


def last_days(rows: DataFrame, key: str, n: int, order: str = "date") -> DataFrame:
    """SRC17: the newest n rows of each key."""
    return rows.withColumn("__back", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__back") <= n).drop("__back")


def anti(corpus: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """J7, SRC12: rows whose key isn't reported yet."""
    return corpus.join(reported.select(key).distinct(), key, "left_anti")


def indicator_signals(rows: DataFrame, name: str, value: str, thresholds: dict[str, float]) -> DataFrame:
    """MI1: above, below or at its threshold; indicators without one are references."""
    t = F.coalesce(*[F.when(F.col(name) == k, F.lit(float(x))) for k, x in thresholds.items()])
    return rows.withColumn("threshold", t).withColumn("signal", F.when(F.col("threshold").isNull(), "reference").when(F.col(value) > F.col("threshold"), "above").when(F.col(value) < F.col("threshold"), "below").otherwise("at"))


def source_health(rows: DataFrame, key: str) -> DataFrame:
    """SNK2: ordered fold of (seq, ok, latency): successes, failures and the running latency (old + new) // 2.

    The fold depends on order, so one source's observations of a day are folded in one array.
    """
    h = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "ok", "latency"))).alias("h"))
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("l"))

    def step(a, x):
        new = F.when(x["ok"], F.when(a["l"] != 0, F.floor((a["l"] + x["latency"]) / 2)).otherwise(x["latency"])).otherwise(a["l"]).cast("long")
        return F.struct((a["s"] + x["ok"].cast("long")).alias("s"), (a["f"] + (~x["ok"]).cast("long")).alias("f"), new.alias("l"))

    return h.withColumn("x", F.aggregate("h", zero, step)).select(key, F.col("x.s").alias("success_count"), F.col("x.f").alias("fail_count"), F.col("x.l").alias("latency_ms"))


def nodes(found: DataFrame, least: int = 1) -> DataFrame:
    """GR3: (id, type, freq, size) of entities, size log2(freq + 1) * 30."""
    return found.groupBy(F.col("value").alias("id"), "type").agg(F.count("*").alias("freq")).filter(F.col("freq") >= least).withColumn("size", F.log2(F.col("freq") + 1) * 30)
