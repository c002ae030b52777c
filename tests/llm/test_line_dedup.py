import random
import re

from pyspark.sql import functions as F

from tidemark.llm import line_dedup as ld


def brute(rows, least=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for doc, text in rows:
        if doc is not None:
            for x in (text or "").split("\n"):
                owner[key(x)] = min(doc, owner.get(key(x), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < least or owner[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(5)
    lines = ["a shared line of text", "A Shared line OF text", "\tÄhnliche Zeile hier \r", "short", "ten chars!", " ten chars! ", "nine char", "", "ß" * 10, "   "]
    rows = [(i, "\n".join(rng.choice(lines + [f"own line number {i} {rng.random()}"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    return rows + [(120, None), (121, ""), (122, "\n\n"), (None, "a shared line of text"), (None, None), (7, "a shared line of text\nten chars!"), (123, "a shared line of text\n" * 5000 + "end")]


def test_against_brute_force_with_several_compactions(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for batch_docs, fanout in ((100_000, 2), (15, 2), (10, 3)):
        got = ld.dedup_lines(df, batch_docs=batch_docs, fanout=fanout).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_levels(spark):
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("some line number "), (F.col("id") % 40).cast("string")).alias("text"))
    edges = ld.batch_edges(df, 8, 1, "doc_id")
    assert len(edges) == 7
    keys = ld.line_keys(df).withColumn("batch", F.floor(F.col("doc") / 8).cast("int"))
    runs = ld.gather(keys, 8, 2)
    assert runs.compactions == 7 and [len(x) for x in runs.levels] == [0, 0, 0, 1]  # 4 + 2 + 1 compactions
    assert sorted(r.owner for r in runs.tables()[0].collect()) == list(range(40))
    runs.close()


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one long line here", 1, "x", 5, 6), (2, "one long line here", None, None, 5, 6)], "doc_id long, text string, __drop int, __Doc string, n_lines int, n_dropped int")
    got = {r["doc_id"]: r for r in ld.dedup_lines(df).collect()}
    assert got[1]["text"] == "one long line here" and got[2]["text"] == "" and got[2]["n_dropped"] == 1 and got[1]["__drop"] == 1 and got[1]["__Doc"] == "x"
    assert ld.dedup_lines(df.limit(0)).count() == 0
