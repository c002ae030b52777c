import math
import random
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import toxicity as tox


def corpus(n=400):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiotra", "idiotel", "lostrador"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_probabilities_sum_to_one():
    words = ["abab", "abc", "cab", "bca", "aab"]
    counts = np.array([3.0, 1, 1, 2, 1])
    table = tox.levels(tox.gram_counts(words, counts, 3), 3)
    kept = table[2]
    for c in kept["context"]:
        inside = kept["share"][kept["code"] >> tox.BITS == c].sum()
        assert abs(inside + kept["rest"][kept["context"] == c][0] - 1) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, "x", 9.0) for i, t in docs], "doc_id long, text string, lang string, score double")
    y = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = tox.fit(d, y)
    got = {r.doc_id: r for r in tox.score(d, model, keep=["doc_id"]).collect()}
    held = [(i, v) for i, v in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == v for i, v in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    # a member of a family of words that was never seen is known by its start
    odd = spark.createDataFrame([(1, "idiotsen " + docs[1][1]), (2, None), (3, ""), (4, "x" * 5000)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in tox.score(odd, model).collect()}
    assert s[1] > s[2] == s[3] and 0 <= s[4] <= 1


def test_empty_and_one_class(spark):
    docs, _ = corpus(6)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.fit(d, none) == 0.0
    assert {r.predicted for r in tox.score(d, tox.fit(d, spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, toxic int"))).collect()} == {1}
    assert tox.score(d.limit(0), 0.0).count() == 0


def tables(bag, order):
    """Kneser-Ney counts by length, from their definition: raw at the top, distinct left neighbours below, and starts of words."""
    raw = {k: {} for k in range(1, order + 1)}
    for word, n in bag.items():
        s = "\x01" + word + "\x02"
        for i in range(1, len(s)):
            k = min(order, i + 1)
            g = s[i - k + 1 : i + 1]
            raw[k][g] = raw[k].get(g, 0) + n
    counts = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        c = dict(raw[k]) if k > 1 else {}
        for g in counts[k + 1]:
            c[g[1:]] = c.get(g[1:], 0) + 1
        counts[k] = c
    return counts


def chance(counts, k, gram, below):
    """P of the last symbol of `gram` after the others."""
    c = counts[k]
    n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    after = [v for g, v in c.items() if g[:-1] == gram[:-1]]
    if not after:
        return below
    return max(c.get(gram, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * below


def brute_ratio(word, toxic, ordinary, shared):
    s, total = "\x01" + word + "\x02", 0.0
    for i in range(1, len(s)):
        p = [1 / tox.SYMBOLS] * 2
        for k in range(1, min(i + 1, tox.ORDER) + 1):
            g = s[i - k + 1 : i + 1]
            p = [chance(c if k > tox.SHARED else shared, k, g, x) for c, x in zip((toxic, ordinary), p)]
        total += math.log(p[0]) - math.log(p[1])
    return total


def test_log_likelihoods_against_their_definition(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    bags = [Counter(word() for _ in range(40)) for _ in range(2)]
    both = Counter({w: bags[0][w] + bags[1][w] + 1 for w in [*bags[0], *bags[1]]})
    count = lambda bag, order: tox.gram_counts(list(bag), np.fromiter(bag.values(), float), order)
    shared = tox.levels(count(both, tox.SHARED + 1), tox.SHARED + 1)[: tox.SHARED]
    model = tox.Model(count(bags[0], tox.ORDER), count(bags[1], tox.ORDER), shared)
    words = list(both)[:15] + ["zzz", "abcabcabcabcabcabcabcabcabcabcabcabcabcabc", "c"]
    want = [brute_ratio(w, tables(bags[0], tox.ORDER), tables(bags[1], tox.ORDER), tables(both, tox.SHARED + 1)) for w in words]
    assert np.allclose(model.ratios(words), want, atol=1e-4)
    # the shared tables that Spark makes are the same
    docs = spark.createDataFrame([(" ".join([w] * n),) for w, n in both.items()], "text string").repartition(3)
    for a, b in zip(tox.shared_levels(docs, prune=0.0), shared):
        for k in ("code", "share", "context", "rest"):
            assert np.allclose(a[k], b[k])
    pruned = tox.shared_levels(docs, prune=0.1)
    assert sum(len(x["code"]) for x in pruned) < sum(len(x["code"]) for x in shared)
    for x in pruned:  # what is pruned stays in the weight of falling back
        _, at = np.unique(x["code"] >> tox.BITS, return_inverse=True)
        assert np.allclose(np.bincount(at, weights=x["share"]) + x["rest"], 1)


def test_passage_decides(monkeypatch):
    model = tox.Model.__new__(tox.Model)
    model.clear()
    value = {"bad": 9.0, "x": -1.0, "yy": 0.0, "l" * 100: 50.0}
    monkeypatch.setattr(model, "ratios", lambda words: np.array([value[w] for w in words]), raising=False)
    monkeypatch.setattr(tox, "PASSAGE", 2)
    got = model.comparisons([["x", "bad", "yy", "yy"], ["yy"], [], ["yy"] * 50 + ["bad"], ["x", "l" * 100]])
    assert np.allclose(got, [8 / 4, 0, 0, 9 / 5, 49 / 101])


def test_repeated_rows_ties_and_few_labels(spark):
    docs, labels = corpus(80)
    d = spark.createDataFrame(docs + docs[:5] + [(None, docs[0][1])], "doc_id long, text string")
    y = spark.createDataFrame(labels + labels[:3] + [(1, 1)], "doc_id long, toxic int")
    model = tox.fit(d, y)
    rows = tox.score(d, model, keep=["doc_id"]).collect()
    assert len(rows) == 86 and all(len({r.score for r in rows if r.doc_id == i}) == 1 for i in range(5))
    assert [r.score for r in rows if r.doc_id is None] == [r.score for r in rows if r.doc_id == 0][:1]
    few = tox.fit(d, spark.createDataFrame([(i, v) for i, v in labels if i in (1, 2, 3, 4, 6, 7, 8)], "doc_id long, toxic int"))
    assert not isinstance(few, float) and np.isfinite(few.weights).all() and few.weights[1] > 0
    assert np.allclose(tox.logistic(np.zeros(0), np.zeros(0), np.zeros(0), (-2.0, 5.0)), [-2, 5])  # without rows the prior stands


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in tox.op3_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())


def test_logistic_reaches_the_optimum():
    """Few toxic rows of steep evidence, where whole Newton steps throw each other about."""
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, m = rng.integers(5, 200), rng.integers(1, 8)
        x, y = np.concatenate([rng.normal(0.25, 0.15, n), rng.normal(rng.uniform(0.5, 6), 1, m)]), np.repeat([0.0, 1.0], [n, m])
        weight = len(y) * np.where(y == 1, 0.12 / m, 0.88 / n)
        prior = (-2.0, tox.SLOPE)
        w = tox.logistic(x, y, weight, prior)
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        scaled = np.array([w[0] - prior[0], w[1] / tox.SLOPE - 1])
        g = np.array([(weight * (p - y)).sum(), (weight * (p - y) * x * tox.SLOPE).sum()]) + tox.PRIOR_ROWS / 4 * scaled
        assert abs(g[0]) < 1e-5 and (abs(g[1]) < 1e-5 or w[1] == tox.SLOPE / 10 and g[1] > 0), trial
