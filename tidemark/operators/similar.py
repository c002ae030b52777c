"""Similar pairs of weights given as rows, by bounds, and selection in order among similar documents.

`candidates` bounds the pairs of a table of weights (doc_id, term, df, weight); `bags` has the joins of whole texts. Terms stand in one
order, from frequent to rare. A document's head is its longest run of leading terms whose weights together are shorter than the
threshold; only the rest, its tail, is indexed, as two vectors that reach the threshold share a tail term. The index is joined with
itself; for each pair it sums the products of the shared tail terms and keeps how much of either vector stands before the first of
them. Terms before that place can only be common within one of the two heads, so by Cauchy-Schwarz the whole product is at most
sum + (norm of one's head) * (norm of the other's part before the place).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

#: Room for rounding in bounds.
SLACK = 1e-9


def candidates(weights: DataFrame, least: float) -> DataFrame:
    """(i, j), i < j, of the documents of (doc_id, term, df, weight) whose bound reaches `least`; vectors have length 1.

    Terms of a single document can't be shared: they stay out of the index, and a document whose other terms are shorter than
    `least` has no partner.
    """
    inside = W.partitionBy("doc_id")
    square = F.col("weight") * F.col("weight")
    placed = weights.withColumn("upto", F.sum(square).over(inside.orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)))
    cut = least * least - SLACK
    placed = placed.withColumns({"head": F.coalesce(F.max(F.when(F.col("upto") < cut, F.col("upto"))).over(inside), F.lit(0.0)), "shareable": F.sum(F.when(F.col("df") > 1, square)).over(inside)})
    before = F.sqrt(F.greatest(F.col("upto") - square, F.lit(0.0)))
    tail = placed.filter((F.col("upto") >= cut) & (F.col("df") > 1) & (F.col("shareable") >= cut)).select("doc_id", "term", "weight", before.alias("before"), F.sqrt("head").alias("head"))
    a, b = (tail.select("term", F.col("doc_id").alias(i), F.col("weight").alias(f"w{i}"), F.col("before").alias(f"b{i}"), F.col("head").alias(f"h{i}")) for i in ("i", "j"))
    met = a.join(b, "term").filter("i < j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("s"), F.min("bi").alias("bi"), F.min("bj").alias("bj"), F.first("hi").alias("hi"), F.first("hj").alias("hj"))
    bound = F.col("s") + F.greatest(F.col("hi") * F.col("bj"), F.col("hj") * F.col("bi"))
    return met.filter(bound >= least - SLACK).select("i", "j")


# --- selection in order ------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (i, j): root is the smallest node that a node reaches. Alternating large stars and small stars, until nothing moves."""
    now = written(links.filter("i <> j").select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).distinct(), "links")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, same = state(now), False
    while before[0] and not same:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(first, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(moved.unionByName(first.withColumnRenamed("m", "b")).distinct(), "links")
        drop(now, large)
        after = state(new)
        now, same, before = new, after == before, after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def fold(edges: DataFrame) -> DataFrame:
    """(doc_id, kept) of every document in edges (root, i, j), i < j: taken in order, one that has an earlier kept neighbour goes.

    The edges of a component are one sorted stream: an edge is read once, and only the documents that went are remembered.
    """
    def run(batches):
        root, gone = None, set()
        for batch in batches:
            roots, docs, later = (c.to_pylist() for c in batch.columns)
            new = []
            for r, i, j in zip(roots, docs, later):
                if r != root:
                    root, gone = r, set()
                if i not in gone and j not in gone:  # all of i's own neighbours have been read: it stays
                    gone.add(j)
                    new.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(docs + later + new, pa.int64()), pa.array([True] * (2 * len(docs)) + [False] * len(new), pa.bool_())], ["doc_id", "kept"])

    rows = edges.select("root", "i", "j").repartition("root").sortWithinPartitions("root", "j", "i").mapInArrow(run, "doc_id long, kept boolean")
    return rows.groupBy("doc_id").agg(F.min("kept").alias("kept"))


def select_in_order(pairs: DataFrame, most: int = 2_000_000) -> DataFrame:
    """DD2: the documents of similar pairs (i < j) that go when documents are taken in order and a kept one drops later similar ones.

    Components of up to `most` pairs are folded, each in one sorted stream, all of them side by side. A larger component is folded
    from its start: its first documents in order, with about `most` pairs among them, are settled, as they depend on earlier ones
    only; they drop later neighbours, and what is still open goes round again, now in smaller components. So any graph settles,
    however long its chains, in about (pairs of its largest component) / `most` rounds.
    """
    open_pairs = written(pairs.filter("i <> j").select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j")).distinct(), "open")
    gone = None
    while not open_pairs.isEmpty():
        root = components(open_pairs)
        edges = written(open_pairs.join(root, open_pairs.i == root.node).select("root", "i", "j"), "edges")
        sizes = edges.groupBy("root").agg(F.count("*").alias("n"))
        large = edges.join(sizes.filter(F.col("n") > most), "root").groupBy("root").agg(F.percentile_approx("j", [k / 1000 for k in range(1, 1000)], 10_000).alias("q"), F.first("n").alias("n"))
        cuts = large.select("root", F.get("q", F.greatest(F.floor(F.lit(1000.0) * most / F.col("n")).cast("int") - 1, F.lit(0))).alias("cut"))
        edges_now = edges.join(cuts, "root", "left")
        settled = written(fold(edges_now.filter("cut is null or j <= cut")), "settled")
        new = settled.filter("not kept").select("doc_id")
        late = edges_now.filter("j > cut").select("i", "j")
        kept = settled.filter("kept").select(F.col("doc_id").alias("i"))
        dropped = late.join(kept, "i", "left_semi").select(F.col("j").alias("doc_id"))
        gone_now = written(new.unionByName(dropped).distinct(), "gone")
        left = late.join(settled.select(F.col("doc_id").alias("i")), "i", "left_anti").join(gone_now.select(F.col("doc_id").alias("j")), "j", "left_anti").join(gone_now.select(F.col("doc_id").alias("i")), "i", "left_anti")
        after = written(left.select("i", "j"), "open")
        drop(open_pairs, edges, settled)
        gone = gone_now if gone is None else gone.unionByName(gone_now)
        open_pairs = after
    return open_pairs.select(F.col("i").alias("doc_id")) if gone is None else gone
