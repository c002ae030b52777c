"""Operator 6, mixing sources to target weights: a time-varying curriculum.

A source s has a weight schedule over training time t in [0, 1] that runs linearly from start_s to end_s; its integral over the
whole training is proportional to the source's weight, which fixes its share of all tokens. Targets stop at `most` times the
source's size; what is above is shared again by weight among the others until none is above. The source's cumulative demand is
D_s(t) = target * (a t + b t^2), with a + b = 1; a document that covers the tokens [c, c + size) of its source (passes over the
source follow each other) gets the training position t = D_s^-1(c), in closed form. `training_order` range-sorts by position.

Cumulative sizes inside a source follow a hash of the document, so the order is the same in every run. They are computed in two
levels: sizes by (source, hash bucket), a window over those few rows, then a window inside each bucket. No source, however large,
passes through one task, and the buckets grow in number with the rows. Sources are data too: they are put in order by range
partitions and their targets found by sums, so that neither passes through one task or the driver.

Defined results: null text has size 0; null is a source of its own, last in order; target 0 where nothing has words; an empty
table gives an empty table; rows that repeat an id are told apart by a hash of their text, and alike rows share alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, table

#: Weights of sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows that a hash bucket should hold, and most buckets (the rows of a source's window over buckets).
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536


def ranked(sums: DataFrame) -> DataFrame:
    """`sums` (source and other columns) with place: 0, 1, ... by code point of source, null last. No task sees all sources."""
    parts = sums.withColumn("__last", F.col("source").isNull()).repartitionByRange("__last", "source")
    parts = stash(parts.withColumn("__part", F.spark_partition_id()), "sources")
    counts = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())  # a row for each partition
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = sums.sparkSession.createDataFrame(before, "__part int, __before long")
    inside = F.row_number().over(W.partitionBy("__part").orderBy("__last", "source")) - 1
    return parts.withColumn("__inside", inside).join(starts, "__part").withColumn("place", (F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__last", "__inside", "__before")


def water_level(sources: DataFrame, total: float, most: float) -> float | None:
    """Tokens for each unit of weight, where a source's target is the lesser of weight times level and `most` times its size.

    Sources (size n, weight) are summed anew until none is above its limit; only the sums reach the driver. None: all are at it.
    """
    level = 0.0
    while True:
        full = F.col("weight") * level >= most * F.col("n")
        r = sources.agg(F.sum(F.when(full, most * F.col("n")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not r.free or total <= 0:
            return None if total > 0 else 0.0
        new = (total - r.held) / r.free
        if new <= level:
            return level
        level = new


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """(id, source, size, turn and the columns of keep): words of each document and its place in the hash order."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))).alias("turn"),
        *keep,
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = 0.5, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies, position, positions and the columns of keep) for every document.

    taken counts words, repeats included; position is the training time of the document's first token, in [0, 1], null where
    nothing is taken, and positions holds that of each copy. Schedules tilt by turns: even sources (in order) fade from 1 + tilt to 1 - tilt, odd ones rise likewise.
    """
    rows = stash(sized(docs, text_col, id_col, source_col, keep), "sized")
    sums = ranked(rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sums = stash(sums.withColumn("weight", weight), "weights")
    whole = sums.agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).first()
    level = water_level(sums, share * (whole.n or 0), most)
    target = most * F.col("n") if level is None else F.least(F.col("weight") * level, most * F.col("n"))
    buckets = max(64, min(MOST_BUCKETS, math.ceil((whole.rows or 0) / BUCKET_ROWS)))
    plan = sums.select("source", F.col("n").alias("source_size"), target.alias("target"), F.when(F.col("place") % 2 == 0, -tilt).otherwise(tilt).alias("rise"))
    rows = rows.withColumn("bucket", F.pmod(F.col("turn"), F.lit(buckets)))
    whole = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = whole.select("source", "bucket", (F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).alias("earlier"))
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("turn", "id", "size", *keep).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("inside", inside).join(before.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("at", F.col("earlier") + F.col("inside")).join(plan.withColumnRenamed("source", "p"), F.col("source").eqNullSafe(F.col("p")))
    # whole passes over the source, then the part of one more pass that the target still needs
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    placed = placed.withColumn("passes", passes).withColumn("rest", rest).withColumn("part", part.cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("part")
    # t with a t + b t^2 = y, where the schedule is proportional to 1 + rise * (2 t - 1): a = 1 - rise, b = rise
    def when(c):
        y, flat = F.least(F.lit(1.0), c / F.col("target")), 1 - F.col("rise")
        return F.when(F.col("rise") == 0, y).otherwise((F.sqrt(flat * flat + 4 * F.col("rise") * y) - flat) / (2 * F.col("rise")))

    copies = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    some = (taken > 0) & (F.col("target") > 0)
    positions = F.when(some, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda j: when(F.col("at") + j * F.col("source_size"))))
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"),
        F.when(some, copies).otherwise(0).alias("copies"), F.when(some, when(F.col("at"))).alias("position"), positions.alias("positions"), *keep,
    )


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that the mix takes, range-partitioned and sorted by training position."""
    return mixed.filter("taken > 0").repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
