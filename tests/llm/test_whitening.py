import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import whitening as w


def brute(rows, components=4):
    """vec_id: (deviation, [whitened], [explained]) with Python integers and numpy; rows are (vec_id, vector) that take part."""
    xs = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows]
    once = sorted({x for _, x in xs})
    n, d = len(once), len(once[0])
    sums = [sum(x[j] for x in once) for j in range(d)]
    z = [[n * x[j] - sums[j] for j in range(d)] for x in once]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in xs:
        dev = [n * x[j] - sums[j] for j in range(d)]
        flat = np.array([v / n for v in dev])
        out.append((i, sum(v * v for v in dev), [flat @ vectors[:, k] / math.sqrt(values[k]) for k in order], [values[k] / np.trace(cov) for k in order]))
    return n, out


def check(got, rows):
    n, want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == sum(len(x[2]) for x in want)
    signs = {}
    for vec, dev, whitened, explained in want:
        for r in by[vec]:
            k = r.component - 1
            assert r.n == n and r.deviation == dev and abs(r.explained - explained[k]) < 1e-9 and r.identity_error < 1e-9
            if abs(whitened[k]) > 1e-6:
                assert signs.setdefault(k, np.sign(r.whitened * whitened[k])) == np.sign(r.whitened * whitened[k])
            assert abs(abs(r.whitened) - abs(whitened[k])) < 1e-8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**80), 2**80), min_size=3, max_size=3), min_size=1, max_size=6))
def test_products_are_exact(rows):
    z = np.array(rows, object)
    assert sum((p.astype(np.int64).astype(object) << w.BITS * k for k, p in enumerate(w.limbs(z))), np.zeros_like(z)).tolist() == rows
    want = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    assert w.gram(z).tolist() == want
    for v in (want[0][0], want[0][1], -1, 0):
        assert sum(d << 32 * k for k, d in enumerate(w.digits(v, w.DIGITS))) == v


def test_many_rows_stay_exact():
    z = np.random.default_rng(4).integers(-(2**40), 2**40, (3 * w.ROWS + 5, 3))
    whole = z.astype(object)
    assert w.gram(z).tolist() == (whole.T @ whole).tolist()
    wide = np.random.default_rng(5).integers(-(2**19), 2**19, (4, 5))
    fitted = w.Whitening(1, (0,) * 5, np.ones(5), np.eye(5), 1.0)
    assert w._deviation(wide, fitted) == (wide.astype(object) ** 2).sum(axis=1).tolist()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    t = pq.read_table(f"{path}/embeddings.parquet", columns=["vec_id", "embedding"])
    rows = [(i, v) for i, v in zip(*(c.to_pylist() for c in t.columns)) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(w.op12_whitening(spark, path).collect(), rows)


def whole(spark, rows, schema="vec_id long, embedding array<double>"):
    x = w.integers(spark.createDataFrame(rows, schema).repartition(5))
    once = w.fit_list(x)
    return x, once, w.fit(once)


def test_edges(spark):
    dice = random.Random(2)
    good = [(i, [dice.uniform(-3, 3) for _ in range(6)]) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(150)] + [(5, good[9][1]), (None, good[3][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [math.nan] * 6), (2004, [math.inf] + [0.0] * 5), (2005, [1.0] * 5)]
    x, once, fitted = whole(spark, good + bad)
    assert x.count() == len(good) and fitted.n == 300 == once.count()
    n, want = brute(good)
    got = sorted((r.deviation, r.component, round(abs(r.whitened), 7)) for r in w.whiten(x, fitted).collect())
    assert got == sorted((dev, k + 1, round(abs(v), 7)) for _, dev, vals, _ in want for k, v in enumerate(vals))
    assert w.identity_error(once, fitted) < 1e-9
    huge = [(i, [(-1) ** i * 2.0**50 * (i + 1), 1.0, float(i), -(2.0**49) * i * i]) for i in range(6)]
    x, once, fitted = whole(spark, huge)
    assert all(r.deviation is None for r in w.whiten(x, fitted).collect()) and w.identity_error(once, fitted) < 1e-4
    assert [tuple(sorted(v)) for v in zip(*((r.x) for r in once.collect()))] == [tuple(sorted(math.floor(256 * v[j]) for _, v in huge)) for j in range(4)]


def test_few_rows(spark):
    x, once, fitted = whole(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.vec_id, r.component, r.deviation, r.whitened) for r in w.whiten(x, fitted).orderBy("vec_id", "component").collect()] == [(1, 1, 0, 0.0), (1, 2, 0, 0.0), (2, 1, 0, 0.0), (2, 2, 0, 0.0)]
    assert w.identity_error(once, fitted) == 0.0
    assert whole(spark, [(1, None)])[2] is None
    x = w.integers(spark.createDataFrame([(1, [1e300, -1e300])], "vec_id long, embedding array<double>"))
    assert x.first().x == [2**63 - 1, -(2**63)]
