"""Sources, sinks and streams."""

import datetime
import json

from pyspark.sql import functions as F

from tidemark.operators import tables as o
from tidemark.sources import storage as st
from tidemark.streaming import alerts as al


def test_archive_markdown_and_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps({"date": "2024-01-01", "count": 2, "articles": [{"article_id": "x", "title": "t", "content": ["p", "q"]}, {"article_id": "y"}]}, indent=1))
    got = st.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted(r.article_id for r in got) == ["x", "y"] and got[0].date == "2024-01-01"
    (tmp_path / "m").mkdir()
    for d in range(1, 4):
        (tmp_path / "m" / f"2024-01-0{d}.md").write_text("# Head\n## One\n" + "x" * 900 + "\n## Two\nshort")
    got = st.read_markdown(spark, str(tmp_path / "m"), newest=2)
    assert sorted({r.date for r in got.collect()}) == ["2024-01-02", "2024-01-03"]
    assert [len(r.text) for r in got.filter("date = '2024-01-03' and section = 1").orderBy("chunk").collect()] == [400, 400, 104]
    st.append_lines(spark.createDataFrame([(1, "a")], "k int, s string"), str(tmp_path / "l"))
    st.append_lines(spark.createDataFrame([(2, "b")], "k int, s string"), str(tmp_path / "l"))
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "l")).collect()) == [1, 2]


def test_cache(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    e = spark.createDataFrame([("a", "1", t(1)), ("a", "2", t(20)), ("b", "3", t(2))], "key string, value string, put_at timestamp")
    now = F.lit("2024-01-25").cast("timestamp")
    assert {r.key: (r.value, r.alive) for r in st.cached(e, now, "10 days").collect()} == {"a": ("2", True), "b": ("3", False)}
    r = st.cache_stats(e, now, "10 days").first()
    assert (r["keys"], r.alive, r.entries) == (2, 1, 3)


def test_source_health(spark):
    rows = [("s", 3, True, 30), ("s", 1, True, 10), ("s", 2, False, 99), ("f", 1, False, 5), ("f", 2, True, 8)]
    got = {r.src: tuple(r)[1:] for r in o.source_health(spark.createDataFrame(rows, "src string, seq long, ok boolean, latency long"), "src").collect()}
    assert got == {"s": (2, 1, 20), "f": (1, 1, 8)}


def test_suppression_in_batch(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(s)) for s in (0, 30, 59, 60, 100, 121)] + [("b", at(10))]
    want = [("a", at(0)), ("a", at(60)), ("a", at(121)), ("b", at(10))]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    assert sorted((r.key, r.ts) for r in al.suppressed(df).collect()) == want
