import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def plain(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute(rows):
    n = len(rows)
    fp = [plain(t) for _, t in rows]
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(d, low.get(r, d))
    return sorted((d, f"{fp[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.choice([60, 400]))) for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(60)]
    for i in range(60, 200):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = word().upper()
        rows.append((i, "\n".join(w)))
    rows += [(200, ""), (201, None), (202, " \t"), (203, "One"), (204, "one two"), (205, "one two")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    want = brute(rows)
    for size in (4096, 7):
        got = sorted(tuple(r) for r in simhash.near_duplicates(df, list_size=size).collect())
        assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_all_bit_patterns_meet(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), 3)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    got = components(simhash.links(df)).filter("root = 0").count()
    assert got == len(fps)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90}


def test_list_links_span():
    rng = np.random.default_rng(0)
    fps = (np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))).astype(np.uint64)
    fps = np.unique(fps)
    assert len(simhash.list_links(fps, np.arange(len(fps)))) == len(fps) - 1


def test_null_ids_among_near_copies(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        w[rng.randrange(400)] = "x"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{rng.random()}" for _ in range(50)) for _ in range(40)]
    ids = [None if i % 3 == 0 else i for i in range(len(texts))]
    top = {d: c for d, _, c in brute(list(enumerate(texts)))}  # by position
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top[i]] = min(d, least.get(top[i], d))
    want = sorted(((d, f"{plain(t):016x}", least.get(top[i])) for i, (d, t) in enumerate(zip(ids, texts))), key=str)
    assert len(set(top.values())) < len(top) - 10
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want


def test_tally_prunes_before_bits_are_counted(monkeypatch):
    rng = np.random.default_rng(4)
    fixed = rng.integers(0, 256, 4, dtype=np.uint8)  # one posting list: four bytes in common
    rows = np.concatenate([np.tile(fixed, (3000, 1)), rng.integers(0, 256, (3000, 4), dtype=np.uint8)], axis=1)
    rows[1, 4:] = rows[0, 4:] ^ np.array([1, 2, 0, 0], np.uint8)
    rows[3, 4:], rows[4, 4:] = [255, 255, 255, 9], [255, 255, 254, 8]  # the last byte has postings like any other
    fps, ids = np.ascontiguousarray(rows).view(np.uint64).ravel(), np.arange(3000)
    looked = []
    real = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (looked.append(x.size), real(x))[1])
    links = simhash.list_links(fps, ids)
    monkeypatch.undo()
    want = {frozenset((i, j)) for i in range(0, 3000, 1) for j in np.flatnonzero(real(fps ^ fps[i]) <= 3).tolist() if j != i}
    assert (0, 1) in links and (3, 4) in links and {frozenset(x) for x in links} <= want
    assert sum(looked) < 0.05 * 3000 * 3000 / 2  # most pairs share four bytes only and are never verified


def test_null_and_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(1, "a b c d"), (1, "x y z q r"), (2, "a b c d"), (None, "x y z q r"), (3, long), (4, long), (5, None), (6, " \n"), (None, "alone here now")]
    df = spark.createDataFrame([(a, b, "k", 1, 2) for a, b in rows], "doc_id long, text string, k string, fp int, __fp int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 5), (6, 5), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
