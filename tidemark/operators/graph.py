"""Graph operators over nodes (id, type, freq) and undirected edges (src, dst, weight), src < dst: summary, communities, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import drop, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def summary(rank: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """GR4: (kind, place, a, b, value): the `top` nodes by rank and twice as many edges by weight, ties by name."""
    nodes = rank.orderBy(F.desc(F.round("rank", 9)), "node").limit(top).select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("rank").alias("value"))
    links = edges.orderBy(F.desc("weight"), "src", "dst").limit(2 * top).select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("value"))
    return nodes.unionByName(links)


def communities(edges: DataFrame, rounds: int = 20, most: int = 8) -> DataFrame:
    """GR5: (node, community) by label propagation: each round a node takes the label with most weight around it, ties to the smallest.

    Nodes change in turns (by a hash of the name, halves), since all at once two neighbours could swap for ever. Then, while
    there are more than `most` communities, those beyond the largest most - 1 join the one that most of their nodes touch.
    """
    links = written(both_ways(edges), "links")
    label, last, still = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), None, 0
    for i in range(2 * rounds):
        votes = links.join(label, links.dst == label.node).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        new = written(label.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label"), (turn & (F.col("new") != F.col("label"))).alias("moved")), "labels")
        still = still + 1 if new.filter("moved").isEmpty() else 0
        drop(*[last] if last is not None else [])
        label, last = new.drop("moved"), new
        if still == 2:  # neither half moves
            break
    return merge_small(label.withColumnRenamed("label", "community"), links, most)


def merge_small(found: DataFrame, links: DataFrame, most: int = 8) -> DataFrame:
    """GR5: communities beyond the `most` - 1 largest (ties by name) join the large one that most of their nodes touch, else the largest."""
    size = found.groupBy("community").agg(F.count("*").alias("n"))
    large = size.orderBy(F.desc("n"), "community").limit(most - 1).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "community")))  # most - 1 rows
    if size.count() <= most:
        return found
    small = found.join(large, "community", "left_anti")
    touch = links.join(small.select(F.col("node").alias("src"), F.col("community").alias("of")), "src").join(found.join(large.select("community", "place"), "community").select(F.col("node").alias("dst"), F.col("community").alias("to"), "place"), "dst")
    votes = touch.groupBy("of", "to", "place").agg(F.countDistinct("src").alias("n"))
    to = votes.groupBy("of").agg(F.min_by("to", F.struct(-F.col("n"), F.col("place"))).alias("to"))
    first = large.filter("place = 1").select(F.col("community").alias("first"))
    moved = small.join(to, small.community == to.of, "left").crossJoin(F.broadcast(first)).select("node", F.coalesce("to", "first").alias("community"))  # one row on the right
    return found.join(large.select("community"), "community", "left_semi").select("node", "community").unionByName(moved)


def community_summary(found: DataFrame, nodes: DataFrame, edges: DataFrame, rank: DataFrame, top: int = 5) -> DataFrame:
    """GR7: (community, node_count, edge_count, label, top_nodes, top_edges, summary): label is the commonest type, ties by name."""
    n = found.join(nodes.select(F.col("id").alias("node"), "type"), "node").join(rank, "node")
    kinds = n.groupBy("community", "type").agg(F.count("*").alias("c")).groupBy("community").agg(F.min_by("type", F.struct(-F.col("c"), F.col("type"))).alias("label"))
    by = F.row_number().over(W.partitionBy("community").orderBy(F.desc(F.round("rank", 9)), "node"))
    tops = n.withColumn("r", by).filter(F.col("r") <= top).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("top_nodes"))
    inside = edges.join(found.select(F.col("node").alias("src"), "community"), "src").join(found.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst").filter("community = other")
    order = F.row_number().over(W.partitionBy("community").orderBy(F.desc("weight"), "src", "dst"))
    e = inside.withColumn("r", order).groupBy("community").agg(
        F.count("*").alias("edge_count"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", F.struct("src", "dst").alias("e"))))), lambda x: x["e"]).alias("top_edges"))
    out = n.groupBy("community").agg(F.count("*").alias("node_count")).join(kinds, "community").join(tops, "community").join(e, "community", "left")
    text = F.concat(F.lit("community "), "label", F.lit(" ("), "node_count", F.lit(" nodes, "), "edge_count", F.lit(" edges). core: "), F.array_join(F.slice("top_nodes", 1, 3), " / "), F.lit("."))
    return out.withColumn("edge_count", F.coalesce("edge_count", F.lit(0))).withColumn("top_edges", F.coalesce("top_edges", F.array().cast("array<struct<src:string,dst:string>>"))).withColumn("summary", text)


def route(questions: DataFrame, communities_: DataFrame, top: int = 3) -> DataFrame:
    """GR8: (question_id, community, score, rank): 2 for each top node that the question (question_id, text) names, 1 for each top edge
    with an end in it. Communities with a score, best first; a question that names none gets the largest."""
    names = communities_.select("community", "node_count", F.explode("top_nodes").alias("name")).select("community", "node_count", "name", F.lit(2).alias("points"), F.lit(None).cast("string").alias("other"))
    ends = communities_.select("community", "node_count", F.explode("top_edges").alias("e")).select("community", "node_count", F.col("e.src").alias("name"), F.lit(1).alias("points"), F.col("e.dst").alias("other"))
    asked = questions.crossJoin(F.broadcast(names.unionByName(ends)))  # at most eight communities of ten rows
    hit = F.contains("text", "name") | F.coalesce(F.contains("text", "other"), F.lit(False))
    score = asked.groupBy("question_id", "community", "node_count").agg(F.sum(F.when(hit, F.col("points")).otherwise(0)).alias("score"))
    some = F.max("score").over(W.partitionBy("question_id"))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("node_count"), "community"))
    return score.withColumns({"best": some, "rank": rank}).filter((F.col("rank") <= top) & ((F.col("score") > 0) | (F.col("best") == 0))).select("question_id", "community", "score", "rank")


def report(edges: DataFrame, nodes: DataFrame, rank: DataFrame, top: int = 5) -> DataFrame:
    """GR9: communities of a graph with their summaries, largest first, and the text of them all on each row."""
    c = community_summary(communities(edges), nodes, edges, rank, top)
    place = F.row_number().over(W.orderBy(F.desc("node_count"), "community"))  # eight rows at most
    c = c.withColumn("place", place)
    whole = c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "summary"))), lambda x: x["summary"]), " ").alias("global_text"))
    return c.crossJoin(F.broadcast(whole))  # one row on the right
