import math
import re
from fractions import Fraction
from itertools import combinations

from tidemark.llm import mixing


def shares(sizes, weights, total, most=2):
    """Targets by trying every set of sources that stop at their limit, exactly."""
    n = len(sizes)
    for full in sorted((set(c) for k in range(n + 1) for c in combinations(range(n), k)), key=len):
        free = [i for i in range(n) if i not in full]
        left = Fraction(total) - sum(most * sizes[i] for i in full)
        unit = left / sum(weights[i] for i in free) if free else None
        got = [Fraction(most * sizes[i]) if i in full else weights[i] * unit for i in range(n)]
        if all(got[i] <= most * sizes[i] for i in range(n)) and (free or left >= 0) and all(unit is None or weights[i] * unit >= most * sizes[i] for i in full):
            return [float(x) for x in got]


def levels(spark, sizes, weights, total):
    rows = spark.createDataFrame(list(zip(sizes, map(float, weights))), "n long, weight double")
    level = mixing.water_level(rows, total, 2.0)
    return [2.0 * n if level is None else min(w * level, 2.0 * n) for n, w in zip(sizes, weights)]


def test_targets_reshare_excess(spark):
    assert levels(spark, [100, 10, 100], [1, 1, 1], 210) == [95, 20, 95]
    assert levels(spark, [10, 10], [3, 1], 100) == [20, 20]
    assert levels(spark, [0, 0], [3, 1], 0) == [0, 0]
    for sizes, weights in (([5, 50, 500, 20], [3, 1, 2, 3]), ([1, 1, 1000], [3, 1, 2]), ([7, 90, 3, 40, 0], [3, 1, 2, 3, 1])):
        want = shares(sizes, weights, Fraction(3, 2) * sum(sizes))
        assert all(abs(a - b) < 1e-6 for a, b in zip(levels(spark, sizes, weights, 1.5 * sum(sizes)), want))


def test_sources_are_ordered_by_code_point(spark):
    names = ["b", "a", "é", "Z", None, "", "zz", "\U0001F600", "\uffee"]
    got = mixing.ranked(spark.createDataFrame([(x, 1) for x in names], "source string, n long").repartition(3)).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.place)] == [*sorted(x for x in names if x is not None), None]
    assert sorted(r.place for r in got) == list(range(9))


def brute(spark, docs):
    """Taken words and positions of each row, from the documents alone: one list for each source, in hash order."""
    turn = docs.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, xxhash64(text)) turn").collect()
    buckets = max(64, -(-len(turn) // mixing.BUCKET_ROWS))
    order = sorted({r.source for r in turn if r.source is not None}) + [None] * any(r.source is None for r in turn)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sums = [sum(size(r) for r in turn if r.source == s) for s in order]
    targets = shares(sums, [(3, 1, 2)[i % 3] for i in range(len(order))], Fraction(3, 2) * sum(sums))
    out = []
    for i, (s, n, t) in enumerate(zip(order, sums, targets)):
        rise, at, stop = (-0.5 if i % 2 == 0 else 0.5), 0, math.floor(t + 0.5)
        for r in sorted((r for r in turn if r.source == s), key=lambda r: (r.turn % buckets, r.turn, r.doc_id is not None, r.doc_id or 0, size(r))):
            k, taken, first = at, 0, None
            while k < stop and size(r):
                if first is None:
                    y = min(1.0, k / t)
                    first = (math.sqrt((1 - rise) ** 2 + 4 * rise * y) - (1 - rise)) / (2 * rise)
                taken += min(size(r), stop - k)
                k += n
            out.append((r.doc_id, s, size(r), n, round(t, 6), taken, None if first is None else round(first, 9)))
            at += size(r)
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), [None, "a", "b", "b", "b", "é"][i % 6]) for i in range(150)]
    rows += [(None, "x y z", "a"), (None, "x y z", "a"), (None, None, None), (3, "other words here", "b"), (3, "other words here", "b"), (3, "", "b"), (900, "long " * 4000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken, None if r.position is None else round(r.position, 9)) for r in got), key=str) == brute(spark, docs)


def test_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 7 = 0 then null when doc_id % 3 = 0 then 'a' when doc_id < 120 then 'b' else 'é' end source", "1 as taken")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None, "a", 1), (10_001, "", None, 1), (10_002, None, "zero", 1)], docs.schema))
    a = sorted(tuple(r) for r in mixing.mix(docs).drop("position", "positions").collect())
    assert a == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).drop("position", "positions").collect())
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size and len(rows) == docs.count()
    order = ["a", "b", "zero", "é", None]
    sums = [sum(r["size"] for r in rows if r.source == s) for s in order]
    targets = shares(sums, [3, 1, 2, 3, 1], Fraction(3, 2) * sum(sums))
    for s, n, t in zip(order, sums, targets):
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == n and abs(r.target - t) < 1e-6 and r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 1
        assert all(r.positions is None or (len(r.positions) == r.copies and r.positions[0] == r.position and r.positions == sorted(r.positions)) for r in own)
        assert all(r.position is None or 0 <= r.position <= 1 for r in own)
    ordered = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert ordered == sorted(ordered)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_position_inverts_demand(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(100)], "doc_id long, text string, source string")
    rows = sorted(mixing.mix(docs, share=1.0, tilt=0.5).collect(), key=lambda r: r.position)
    for i, r in enumerate(rows):  # the first source fades: demand 1.5 t - 0.5 t^2
        assert abs(1.5 * r.position - 0.5 * r.position**2 - i / 100) < 1e-9
