"""Graph and retrieval operators on small fixtures."""

import json

import numpy as np

from tidemark.operators import decision as d
from tidemark.operators import graph as g
from tidemark.operators import retrieval as r


def fixture(spark):
    groups = ["abcd", "efgh", "xyz"]
    edges = [(a, b, 5) for s in groups for i, a in enumerate(s) for b in s[i + 1 :]] + [("d", "e", 1), ("h", "x", 1)]
    nodes = [(n, "left" if n in "abc" else "right", 3) for s in groups for n in s]
    return spark.createDataFrame(nodes, "id string, type string, freq long"), spark.createDataFrame(edges, "src string, dst string, weight long")


def test_communities(spark):
    nodes, edges = fixture(spark)
    found = {}
    for x in g.communities(edges).collect():
        found.setdefault(x.community, set()).add(x.node)
    assert sorted("".join(sorted(s)) for s in found.values()) == ["abcd", "efgh", "xyz"]
    merged = {}
    for x in g.communities(edges, most=2).collect():
        merged.setdefault(x.community, set()).add(x.node)
    assert sum(map(len, merged.values())) == 11 and len(merged) == 1  # the largest one takes what is beyond most - 1


def test_summaries_routing_and_hits(spark):
    nodes, edges = fixture(spark)
    rank = d.pagerank(edges)
    c = g.report(edges, nodes, rank)
    rows = c.orderBy("place").collect()
    assert [(x.node_count, x.edge_count) for x in rows] == [(4, 6), (4, 6), (3, 3)] and {x.label for x in rows} == {"left", "right"}
    assert all(x.summary in x.global_text and len(x.top_nodes) == x.node_count for x in rows)
    asks = spark.createDataFrame([(1, "x y"), (2, "nothing known?".upper()), (3, "d e")], "question_id long, text string")
    routes = {}
    for x in g.route(asks, c).collect():
        routes.setdefault(x.question_id, []).append((x.rank, x.score))
    assert sorted(routes[1])[0][1] >= 4 and [s for _, s in sorted(routes[2])] == [0, 0, 0] and len(routes[3]) >= 2
    hits = r.graph_hits(g.route(asks, c), c).collect()
    assert all(0 < x.score <= 1 and x.source == "graph" for x in hits) and max(x.score for x in hits) == 0.8
    s = g.summary(rank, edges, 3).collect()
    assert [x.kind for x in s].count("node") == 3 and [x.kind for x in s].count("edge") == 6


def test_payload_hits_answers_and_citations(spark):
    reports = spark.createDataFrame([(f"2024-01-{i + 1:02d}", json.dumps({"keywords": [{"word": "steel"}, {"word": f"w{i}"}]})) for i in range(5)], "date string, payload string")
    asks = spark.createDataFrame([(1, "steel w3 prices"), (2, "none of it")], "query_id long, text string")
    got = r.payload_search(asks, reports).orderBy("rank").collect()
    assert [(x.date, x.score) for x in got] == [("2024-01-04", 0.6667), ("2024-01-05", 0.3333), ("2024-01-03", 0.3333)]
    hits = r.hits(r.payload_search(asks, reports).join(reports, "date"), "ai_report", "date", "payload")
    a = r.answer(hits).collect()
    assert len(a) == 1 and a[0].confidence == 0.6667 and a[0].n_hits == 3
    c = r.citations(hits).collect()
    assert all(len(x.snippet) <= 200 and "\n" not in x.snippet for x in c)


def test_vector_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for x in r.vector_top(df, df.filter("id % 20 = 0"), 4, block=30, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    for q, ids in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        assert ids == np.argsort(-s)[:4].tolist()
    old, new = df.filter("id < 5"), df.filter("id < 9")
    assert r.add_vectors(old, new).count() == r.add_vectors(old, new, True).count() == 9


def test_route_with_hyphens(spark):
    """Names may hold the mark that edges are written with."""
    edge = "struct<src:string,dst:string>"
    rows = [("c1", 3, ["a-b", "d-e"], [("a-b", "c"), ("c", "d-e")]), ("c2", 2, ["x", "y"], [("x", "y")])]
    c = spark.createDataFrame(rows, f"community string, node_count long, top_nodes array<string>, top_edges array<{edge}>")
    asks = spark.createDataFrame([(1, "what of a-b?"), (2, "nothing"), (3, "x")], "question_id long, text string")
    got = {(r.question_id, r["rank"]): (r.community, r.score) for r in g.route(asks, c).collect()}
    assert got[1, 1] == ("c1", 3) and got[2, 1] == ("c1", 0) and got[3, 1] == ("c2", 3) and (1, 2) not in got
