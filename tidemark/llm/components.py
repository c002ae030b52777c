"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Every step is a join and an aggregate over links; nothing but a count and a checksum reaches the driver. The smaller side of each
join is written to the shared folder first, so that both inputs of the sort-merge join are plain shuffles and adaptive execution
can split the rows of a hub. Before the first step, links are thinned inside each partition to a forest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def forest(pairs) -> list[tuple[int, int]]:
    """(node, root) links that join the same nodes as `pairs`; a root is the smallest of its nodes."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in up]


def thin(links: DataFrame, most: int = 500_000) -> DataFrame:
    """A forest for each `most` links of each partition."""

    def run(batches):
        held: list = []

        def flush():
            out = forest(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) > most:
                yield flush()
        yield flush()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node: root is the smallest node that it reaches. `links` has long columns a and b."""
    links = links.filter("a is not null and b is not null and a <> b")
    now = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = stash(large.distinct(), "large")
        first = stash(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(first, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, stash(moved.unionByName(first.withColumnRenamed("m", "b")).distinct(), "links")
        discard(old, least, large, first)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
