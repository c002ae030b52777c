"""The ledger, the vector index on disk and the embedding store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import text as t
from tidemark.sources import ledger as ld
from tidemark.sources import vectors as v


def test_a_day_shows_all_its_tables_or_none(spark, tmp_path):
    base = str(tmp_path / "days")
    two = lambda x: {"metric": spark.createDataFrame([(x,)], "n int"), "keyword": spark.createDataFrame([(f"w{x}",)], "w string")}
    read = lambda d: {k: f.first()[0] for k, f in ld.read_day(spark, base, d).items()}
    ld.write_day(spark, base, "2024-01-01", two(1))
    ld.write_day(spark, base, "2024-01-02", two(2))
    bad = spark.createDataFrame([(1,)], "n int").select(F.raise_error(F.lit("no")).alias("w"))
    with pytest.raises(Exception, match="no"):  # the first table is written, the second fails
        ld.write_day(spark, base, "2024-01-01", {**two(9), "keyword": bad})
    assert read("2024-01-01") == {"metric": 1, "keyword": "w1"} and read("2024-01-02") == {"metric": 2, "keyword": "w2"}
    ld.write_day(spark, base, "2024-01-01", two(3))
    assert read("2024-01-01") == {"metric": 3, "keyword": "w3"} and read("2024-01-09") == {}
    ledger = ld.Ledger(spark, base)
    with pytest.raises(RuntimeError):  # another writer has published that version
        ledger.publish({}, ledger.version() - 1)


def vectors(n, size=16, seed=1):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, size))
    return [(i, (centres[i % 12] + 0.4 * g.normal(size=size)).tolist()) for i in range(n)]


def brute(rows, asks, top, least=-np.inf):
    ids, x = np.array([i for i, _ in rows]), np.array([w for _, w in rows])
    out = {}
    for i, q in asks:
        s = x @ np.array(q)
        best = sorted(((-a, int(b)) for a, b in zip(s, ids) if b != i and a >= least))[:top]
        out[i] = [b for _, b in best]
    return out


def test_index_add_replace_reopen_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 40)
    monkeypatch.setattr(v, "QUERY_BLOCK", 7)
    schema, base, rows = "id long, v array<double>", str(tmp_path / "index"), vectors(600)
    df = lambda r: spark.createDataFrame(r, schema)
    index = v.VectorIndex(spark, base)
    index.build(df(rows[:400]))
    assert index.add(df([*rows[350:], rows[599]])) == 200  # 50 are there already, one comes twice
    moved = [(i, w) for i, w in vectors(40, seed=5)]
    assert index.add(df(moved), replace=True) == 40
    now = {**dict(rows), **dict(moved)}
    index = v.VectorIndex(spark, base)
    assert {r.id: r.v for r in index.rows().collect()} == now
    asks = [(i, now[i]) for i in range(0, 600, 6)] + [(5000, rows[3][1])]
    every = len(index.ledger.read()["centroids"])
    for least in (None, 12.0):
        want = brute(list(now.items()), asks, 5, -np.inf if least is None else least)
        got = {}
        for r in sorted(index.search(df(asks), 5, least, probes=every).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {k: x for k, x in want.items() if x}
    want = brute(list(now.items()), asks, 5)
    found = [(r.query_id, r.id) for r in index.search(df(asks)).collect()]
    assert sum(b in want[a] for a, b in found) / (5 * len(asks)) >= 0.9 and index.ledger.read()["probes"] < every
    shown = lambda: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in v.VectorIndex(spark, base).search(df(asks)).collect())
    before = shown()
    index.compact()
    assert shown() == before and len(index.ledger.read()["parts"]) == 1
    empty = v.VectorIndex(spark, str(tmp_path / "none"))
    empty.build(df([]))
    assert empty.search(df(asks)).count() == 0 == empty.rows().count()


def test_texts_are_encoded_once(spark, tmp_path):
    schema, asked = "doc_id long, text string", []
    store = v.EmbeddingStore(spark, str(tmp_path / "store"))

    def encoder(docs):
        asked.append(docs.count())
        return t.hash_embedding(docs, 32)

    one = spark.createDataFrame([(1, "some words of text"), (2, "some words of text"), (3, "other words"), (4, ""), (5, None)], schema)
    rows, n = store.encode(one, encoder)
    assert n == 3 == sum(asked) and {tuple(r) for r in rows.collect()} == {tuple(r) for r in t.hash_embedding(one.filter("text is not null"), 32).collect()}
    rows, n = v.EmbeddingStore(spark, str(tmp_path / "store")).encode(one, encoder)
    assert n == 0 and len(asked) == 1 and rows.count() == t.hash_embedding(one.filter("text is not null"), 32).count()
    two = one.unionByName(spark.createDataFrame([(9, "a new text"), (10, "other words")], schema))
    rows, n = store.encode(two, encoder)
    assert n == 1 and {tuple(r) for r in rows.collect()} == {tuple(r) for r in t.hash_embedding(two.filter("text is not null"), 32).collect()}
