import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm import bpe, mixing
from tests.llm.test_simhash import brute

REAL = Tokenizer.from_file(bpe.public_vocabulary())


def lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    owner = {}
    for d, t in rows:
        for x in t.split("\n"):
            owner[key(x)] = min(d, owner.get(key(x), d))
    return {d: "\n".join(x for x in t.split("\n") if len(key(x)) < least or owner[key(x)] == d) for d, t in rows}


def test_stages_and_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = cp.drop_toxic(spark, docs, sf).cache()
    assert kept.columns == cols
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0").collect()}
    assert len(toxic - {r.doc_id for r in kept.collect()}) <= 0.02 * len(toxic)  # clean documents stay
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]

    lined = cp.drop_repeated_lines(spark, kept, sf).cache()
    want = lines(rows)
    assert lined.columns == cols and {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = cp.drop_near_copies(spark, lined, sf).cache()
    groups = brute(sorted(want.items()))
    assert single.columns == cols and sorted(r.doc_id for r in single.collect()) == [d for d, _, c in groups if c == d]

    mixed = cp.mix_sources(spark, single, sf).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert mixed.columns == cols and count == {d: n for d, n in copies.items() if n}

    out = cp.encode(spark, mixed, sf).collect()
    text = {r.doc_id: r.text for r in single.collect()}
    assert len(out) == sum(count.values())
    for r in out:
        assert list(r.ids) == REAL.encode(text[r.doc_id] or "", add_special_tokens=False).ids

    whole = cp.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    new = docs.selectExpr("case when doc_id % 5 = 0 then null when doc_id % 5 < 3 then doc_id - doc_id % 5 + 1 else doc_id end as doc_id", "text", "lang", "source", "n_chars")
    new.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id or -1, r.source, r.text)

    single = cp.drop_near_copies(spark, docs, sf).cache()
    nulls = lambda df: sorted(r.text for r in df.filter("doc_id is null").collect())
    assert nulls(single) == nulls(docs)

    plan = mixing.mix(single.withColumn("t", single.text), keep=("t",)).collect()
    want, got = {}, {}
    for r in plan:
        if r.copies:
            k = (r.doc_id or -1, r.source, r.t)
            want[k] = want.get(k, 0) + r.copies
    for r in cp.mix_sources(spark, single, sf).collect():
        got[key(r)] = got.get(key(r), 0) + 1
    assert got == want

    # two clean texts of one id, one of them a near copy of a smaller id: only that one goes
    w = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(w), " ".join(w[:-1] + ["x"]), " ".join(f"v{i}" for i in range(50))
    small = spark.createDataFrame([(1, a), (2, b), (2, c), (3, c), (3, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in cp.drop_near_copies(spark, small, sf).collect()) == [(1, a), (2, c)]

    out = cp.run(spark, str(tmp_path))
    assert out.filter("doc_id is null").count() > 0


def test_clashing_columns_pass_through(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    extra = ["score", "predicted", "n_lines", "n_dropped", "__row", "__at", "__drop", "positions", "component"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in extra])
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in extra)
    assert cp.encode(spark, docs, sf).count() == docs.count() > 0
