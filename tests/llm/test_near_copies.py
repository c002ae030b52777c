import random

import corpus_pipeline as cp
from tidemark.llm import near_copies


def sets(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows, similarity=0.8):
    s, top = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(s[i] & s[j]) >= similarity * len(s[i] | s[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def planted(rng, n):
    """Pairs of texts whose five-word shingles share 0.8 to 0.95."""
    out = []
    while len(out) < 2 * n:
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 300, 900]))]
        c, goal = list(w), rng.uniform(0.8, 0.95)
        while True:
            d = list(c)
            d[rng.randrange(len(d))] = f"x{rng.random()}"
            a, b = sets(" ".join(w)), sets(" ".join(d))
            if len(a & b) < goal * len(a | b):
                break
            c = d
        if c != w:
            out += [" ".join(w), " ".join(c)]
    return out


def test_planted_copies_are_found(spark):
    docs = spark.createDataFrame(list(enumerate(planted(random.Random(5), 150))), "doc_id long, text string")
    kept = {r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(0, 300, 2))


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    texts = planted(rng, 30)
    base = [f"b{i}" for i in range(200)]
    for i in range(60):  # one group in a chain of blocks, and texts of about half the base
        w = list(base)
        for _ in range(rng.choice([1, 3, 8])):
            w[rng.randrange(200)] = f"y{i}"
        texts.append(" ".join(w))
        texts.append(" ".join(base[: rng.choice([90, 120, 160, 185])] + [f"z{i}k{k}" for k in range(30)]))
    texts += ["", None, " \t", "One", "one", "one two", "A b c d E", "a B C d e", "a b c d f"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "k long, text string").cache()
    want = brute(rows)
    for block in (512, 7):
        assert {r.k: r.component for r in near_copies.near_copies(df, "k", block=block).collect()} == want
    assert near_copies.near_copies(df.limit(0), "k").count() == 0
