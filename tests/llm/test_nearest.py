import numpy as np

from tidemark.llm import nearest


def brute(ids, v, k=20, step=20):
    out = {}
    for i, q in zip(ids, v):
        if i % step == 0:
            s = sorted(((-float(np.dot(q, x)), j) for j, x in zip(ids, v) if j != i))[:k]
            out[i] = [(j, -t) for t, j in s]
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    v = nearest.usable(df)
    ix = nearest.fit(v)
    got = {}
    for r in nearest.search(v, v.filter("id % 20 = 0"), ix).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    v[200:500] = v[200]  # a large group of copies
    ids = list(range(1500))
    monkeypatch.setattr(nearest, "BLOCK", 100)
    odd = [(5000, None, ""), (5020, [0.0] * 24, ""), (5040, [float("nan")] * 24, ""), (5060, [1.0, 2.0], ""), (5080, [None] + [1.0] * 23, ""), (None, [1.0] * 24, "")]
    got = run(spark, [(i, x.tolist(), "x") for i, x in zip(ids, v)] + odd)
    want = brute(ids, v)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert all(j != q and abs(s - float(np.dot(v[q], v[j]))) < 1e-9 for j, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_few_candidates(spark):
    rows = [(i, [float(i), 1.0], "") for i in range(5)]
    assert run(spark, rows) == brute(range(5), np.array([[i, 1.0] for i in range(5)]))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.fit(nearest.usable(none)) is None


def test_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((120, 6)), 1)
    rows = [(i, x.tolist(), "") for i, x in enumerate(v)] + [(20, v[3].tolist(), ""), (20, v[20].tolist(), ""), (7, v[9].tolist(), ""), (40, (-v[40]).tolist(), "")]
    rows += [(200 + i, v[5].tolist(), "") for i in range(30)]  # ties at the 20th place
    best = {}
    for i, a, _ in rows:
        for j, b, _ in rows:
            if i % 20 == 0 and i != j:
                best[i, j] = max(best.get((i, j), -np.inf), float(np.dot(a, b)))
    got = run(spark, rows)
    hits = total = 0
    for q in {i for i, _ in best}:
        want = sorted(((-s, j) for (i, j), s in best.items() if i == q))[:20]
        assert len(got[q]) == 20 == len({j for j, _ in got[q]}) and all(abs(best[q, j] - s) < 1e-9 for j, s in got[q])
        hits, total = hits + len({j for j, _ in got[q]} & {j for _, j in want}), total + 20
    assert hits >= 0.9 * total


def test_short_queries_are_asked_again(spark, monkeypatch):
    monkeypatch.setattr(nearest.Index, "fitted", lambda self, asked, recall: (1, 0.0))  # one list, far too few
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 8))
    got = run(spark, [(i, x.tolist(), "") for i, x in enumerate(v)])
    assert len(got) == 15 and all(len(x) == 20 for x in got.values())


def test_query_prunes_lists_and_reaches_recall(spark):
    v = nearest.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    ix = nearest.fit(v)
    rows = v.collect()
    got = {}
    for r in nearest.op1_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([r.id for r in rows], np.array([r.v for r in rows]))
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
    assert ix.probes <= len(ix.centroids) and ix.recall >= 0.9
    print(f"lists {len(ix.centroids)}, probes {ix.probes}, recall fitted {ix.recall:.3f}, measured {hits / 20 / len(want):.3f}")
