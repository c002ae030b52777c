"""Similarity, deduplication and ranking against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import decision as d
from tidemark.operators import similar
from tidemark.operators import text as t


def words(s):
    return [w for w in re.split(r"[^\w]+", s.lower()) if len(w) >= 2]


def corpus(n=60):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(30)] + ["the", "and"] * 3
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for i in range(n)]
    for i in range(0, n, 4):
        w = docs[i][1].split()
        w[rng.randrange(len(w))] = "other"
        docs.append((n + i, " ".join(w)))
    return docs + [(500, ""), (501, docs[3][1]), (502, docs[3][1] + " word1 word1")]


def vectors(docs):
    tf = {i: Counter(words(s)) for i, s in docs}
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for i, c in tf.items():
        v = {w: k * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {w: x / norm for w, x in v.items()}
    return out


def cosines(docs, least):
    v = vectors(docs)
    pairs = {}
    for i in v:
        for j in v:
            if i < j:
                s = sum(x * v[j].get(w, 0) for w, x in v[i].items())
                if s >= least:
                    pairs[i, j] = s
    return pairs


def test_jaccard_and_cosine(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: set(words(s)) for i, s in docs}
    want = {(i, j): len(a & b) / len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and len(a & b) >= 0.8 * len(a | b)}
    got = {(r.i, r.j): r.sim for r in t.jaccard(df).collect()}
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    want = cosines(docs, 0.8)
    got = {(r.i, r.j): r.sim for r in t.cosine(df).collect()}
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def drops(ids, pairs):
    later = {}
    for a, b in pairs:
        later.setdefault(a, []).append(b)
    gone = set()
    for i in sorted(ids):
        if i not in gone:
            gone.update(later.get(i, ()))
    return gone


def test_greedy_follows_the_order(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 9), (5, 6), (6, 7), (5, 7), (7, 8), (10, 20), (15, 20), (10, 15)]
    got = {r.doc_id for r in t.greedy(spark.createDataFrame(pairs, "i long, j long")).collect()}
    assert got == drops({x for p in pairs for x in p}, pairs) == {2, 4, 6, 7, 9, 15, 20}
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in t.greedy(t.cosine(df, 0.85)).collect()}
    assert got == drops([i for i, _ in docs], cosines(docs, 0.85)) and len(got) > 5


def test_full_dedup(spark):
    docs = [(i, "title here" if i in (3, 4) else f"title {i} {'abc'[i % 3]}", s) for i, s in corpus(20)]
    kept = [r for r in docs if r[0] != 4]
    want = {r[0] for r in kept} - drops([r[0] for r in kept], cosines([(r[0], r[2]) for r in kept], 0.85))
    got = {r.doc_id for r in t.full_dedup(spark.createDataFrame(docs, "doc_id long, title string, text string")).collect()}
    assert got == want


def test_joins_and_selection_at_several_thresholds(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([1, 4, 12, 40])))) for i in range(150)]
    docs += [(1000 + i, docs[i][1] + " extra" + " w1" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: set(words(s)) for i, s in docs}
    for least in (0.5, 0.7, 0.95):
        want = cosines(docs, least)
        got = {(r.i, r.j): r.sim for r in t.cosine(df, least).collect()}
        assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        want = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and len(a & b) >= least * len(a | b)}
        assert {(r.i, r.j) for r in t.jaccard(df, least).collect()} == want


def test_candidates_are_few(spark):
    """The bound leaves at most three candidates for each result, on texts of a common vocabulary."""
    rng = random.Random(7)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(80))) for i in range(400)]
    docs += [(1000 + i, docs[i][1] + " w1") for i in range(100)]
    w = t.tfidf(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {tuple(r) for r in similar.candidates(w, 0.8).collect()}
    want = set(cosines(docs, 0.8))
    assert want <= found and len(found) <= 3 * len(want) and len(want) >= 100


def test_selection_settles_any_graph(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(5000)]
    star = [(10_000, 10_001 + i) for i in range(300)] + [(10_001 + i, 10_002 + i) for i in range(299)]
    wild = [tuple(sorted(rng.sample(range(20_000, 20_200), 2))) for _ in range(600)]
    edges = chain + star + wild + [(50_000 + 2 * i, 50_001 + 2 * i) for i in range(200)] + [(7, 7), (3, 4)]
    want = drops({x for p in edges for x in p}, {e for e in edges if e[0] != e[1]})
    df = spark.createDataFrame(edges, "i long, j long")
    rows = [r.doc_id for r in t.greedy(df).collect()]
    assert set(rows) == want and len(rows) == len(want)
    some = [e for e in edges if e[0] < 300 or 10_000 <= e[0] < 50_000]
    rows = [r.doc_id for r in similar.select_in_order(spark.createDataFrame(some, "i long, j long"), most=150).collect()]  # larger components go round again
    assert set(rows) == drops({x for p in some for x in p}, {e for e in some if e[0] != e[1]}) and len(rows) == len(set(rows))
    assert t.greedy(df.limit(0)).count() == 0


def test_textrank_edges(spark):
    docs = corpus(12) + [(900, "aa bb"), (901, "aa bb aa"), (902, "cc cc cc dd")]
    want = Counter()
    for _, s in docs:
        w = words(s)
        for k in range(len(w) - 2):
            win = w[k : k + 3]
            for x in range(3):
                for y in range(3):
                    if x != y and win[x] != win[y]:
                        want[min(win[x], win[y]), max(win[x], win[y])] += 1
    got = {(r.src, r.dst): r.weight for r in t.textrank_edges(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(want)


def test_pagerank(spark):
    rng = random.Random(1)
    edges = [(a, b, rng.randint(1, 5)) for i, a in enumerate("abcdefgh") for b in "abcdefgh"[i + 1 :] if rng.random() < 0.5]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    rank = {k: 1 / len(near) for k in near}
    for _ in range(30):
        rank = {k: 0.15 / len(near) + 0.85 * sum(rank[j] * w / sum(near[j].values()) for j, w in near[k].items()) for k in near}
    got = {r.node: r["rank"] for r in d.pagerank(spark.createDataFrame(edges, "src string, dst string, weight long")).collect()}
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 1e-12 for k in rank)


def test_fusion(spark):
    a, b = spark.createDataFrame([("x", 4.0), ("y", 2.0)], "term string, score double"), spark.createDataFrame([("y", 10.0), ("z", 5.0)], "term string, score double")
    assert {r.term: r.score for r in t.fuse(a, b).collect()} == {"x": 0.5, "y": 0.75, "z": 0.25}
    assert t.fuse(a.filter("false"), b).count() == 2


def test_pair_similarity(spark):
    rows = [(1, "same text here", "same text here"), (2, "one two", "three four"), (3, "one two three", "one two four"), (4, "", "x yy")]
    got = {r.pair_id: r for r in t.pair_similarity(spark.createDataFrame(rows, "pair_id long, a string, b string")).collect()}
    assert got[1].duplicate and abs(got[1].sim - 1) < 1e-9 and got[2].sim == 0 and got[4].sim == 0
    u = math.log(1.5) + 1
    assert abs(got[3].sim - 2 / (2 + u * u)) < 1e-9


def test_no_copies_meet(spark):
    df = spark.createDataFrame([(i, "a long enough text") for i in range(50)], "doc_id long, text string")
    assert t.classes(df, F.sha2("text", 256)).select("rep").distinct().count() == 1


def shuffled(spark):
    """Bytes that the session's shuffles have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def meeting_corpus(n=1500):
    """Documents that all share words with many others; each tenth one is nearly the one before it."""
    rng = random.Random(12)
    docs = [[f"word{rng.randrange(3000)}" for _ in range(80)] for _ in range(n)]
    for i in range(1, n, 10):
        docs[i] = docs[i - 1][:-2] + ["more", "words"]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_meetings_of_cosine_stay_in_tasks(spark):
    docs = meeting_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = shuffled(spark)
    got = {(r.i, r.j) for r in t.cosine(df).collect()}
    assert got == {(i - 1, i) for i in range(1, len(docs), 10)}
    assert shuffled(spark) - before < 2 * sum(len(s) for _, s in docs)


def test_meetings_of_jaccard_stay_in_tasks(spark):
    docs = meeting_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = shuffled(spark)
    got = {(r.i, r.j) for r in t.jaccard(df).collect()}
    assert got == {(i - 1, i) for i in range(1, len(docs), 10)}
    assert shuffled(spark) - before < 2 * sum(len(s) for _, s in docs)


def test_meetings_of_greedy_stay_in_tasks(spark):
    docs = meeting_corpus()
    before = shuffled(spark)
    got = {r.doc_id for r in t.greedy(t.cosine(spark.createDataFrame(docs, "doc_id long, text string"), 0.85)).collect()}
    assert got == set(range(1, len(docs), 10))
    assert shuffled(spark) - before < 2.5 * sum(len(s) for _, s in docs)


def test_meetings_of_full_dedup_stay_in_tasks(spark):
    docs = [(i, f"title {i}", s) for i, s in meeting_corpus()]
    before = shuffled(spark)
    got = {r.doc_id for r in t.full_dedup(spark.createDataFrame(docs, "doc_id long, title string, text string")).collect()}
    assert got == {i for i in range(len(docs)) if i % 10 != 1}
    assert shuffled(spark) - before < 4 * sum(len(s) for *_, s in docs)
