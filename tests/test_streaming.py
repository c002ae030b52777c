"""Streams: windows, late rows, sessions that merge, state that expires, routed alerts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import alerts as al
from tidemark.streaming import keyed as k
from tidemark.streaming import windows as w

START = datetime.datetime(2024, 1, 1, 10)
SCHEMA = "ts timestamp, event_type string, value double"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def files(spark, path, *batches, schema=SCHEMA):
    """One file for each batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return path


def one_file_a_batch(spark, path, make, late, schema):
    """`make` over the files of path/0, path/1, ... as batches of their own: rows, and the largest state that was held."""
    import shutil

    base, sizes = path + "-run", []
    import os

    os.makedirs(f"{base}/in")
    n = len(os.listdir(path))
    for i in range(n):
        for f in os.listdir(f"{path}/{i}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{path}/{i}/{f}", f"{base}/in/{i}-{f}")
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        q = make(w.timed(source, late)).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.recentProgress[-1].stateOperators[0].numRowsTotal if q.recentProgress else None)
    return spark.read.parquet(f"{base}/out"), sizes, q


def test_sliding_windows_drop_late_rows(spark, tmp_path):
    rows = [[(at(1), "a", 1.0), (at(7), "a", 2.0)], [(at(40), "a", 4.0)], [(at(8), "a", 100.0), (at(31), "a", 8.0)], [(at(200), "b", 0.0)], [(at(201), "b", 0.0)]]
    path = files(spark, str(tmp_path / "in"), *rows)
    got, _, _ = one_file_a_batch(spark, path, lambda e: w.sliding(e, "10 minutes", "5 minutes", ["event_type"]), "10 minutes", SCHEMA)
    seen = {(r.start, r.event_type): (r.n, r.total) for r in got.collect()}
    want = {at(-5): (1, 1.0), at(0): (2, 3.0), at(5): (1, 2.0), at(25): (1, 8.0), at(30): (1, 8.0), at(35): (1, 4.0), at(40): (1, 4.0)}  # 8 came after 40 had moved the watermark to 30
    assert seen == {(s, "a"): v for s, v in want.items()}


def test_sessions_merge_across_batches_and_leave_the_state(spark, tmp_path):
    rows = [[(at(0), "a", 1.0), (at(25), "a", 2.0)], [(at(12), "a", 4.0)], [(at(120), "b", 1.0)], [(at(1), "a", 50.0)], [(at(400), "c", 1.0)], [(at(401), "c", 1.0)]]
    path = files(spark, str(tmp_path / "in"), *rows)
    got, sizes, _ = one_file_a_batch(spark, path, lambda e: w.sessions(e, "15 minutes", ["event_type"]), "30 minutes", SCHEMA)
    assert sorted((r.start, r.end, r.event_type, r.n, r.total) for r in got.collect()) == [(at(0), at(40), "a", 3, 7.0), (at(120), at(135), "b", 1, 1.0)]
    assert sizes[0] == 2 and sizes[1] == 1 and sizes[-1] == 1


def test_replay_closes_all_windows(spark, tmp_path):
    rows = [(at(i * 7 % 300), "ab"[i % 2], float(i)) for i in range(100)] + [(None, "a", 1.0)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    batch = spark.createDataFrame([r for r in rows if r[0]], SCHEMA)
    for make in (lambda e: w.sliding(e, "1 hour", "20 minutes", ["event_type"]), lambda e: w.sessions(e, "4 minutes", ["event_type"])):
        want = sorted(map(tuple, make(batch).collect()))
        assert sorted(map(tuple, w.replay(spark, path, make, "1 hour").collect())) == want and len(want) > 10
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert w.replay(spark, str(tmp_path / "none"), lambda e: w.sessions(e, "1 hour", ["event_type"]), "1 hour").count() == 0


@pytest.fixture
def rocks(spark):
    name, new = next(iter(k.PROVIDER.items()))
    old = spark.conf.get(name)
    spark.conf.set(name, new)
    yield spark
    spark.conf.set(name, old)


def test_suppression_forgets_keys(rocks, tmp_path):
    schema = "key string, ts timestamp"
    sec = lambda s: START + datetime.timedelta(seconds=s)
    rows = [[(f"k{i}", sec(0)) for i in range(50)] + [("k0", sec(59)), ("k0", sec(60)), ("k1", sec(30))], [("k0", sec(100)), ("k0", sec(121)), ("k2", sec(59))], [("z", sec(1000))], [("z", sec(1001)), ("k0", sec(1002))]]
    path = files(rocks, str(tmp_path / "in"), *rows, schema=schema)
    got, _, q = one_file_a_batch(rocks, path, lambda e: k.suppress_with_expiry(e, 60, None), "1 minute", schema)
    want = [(f"k{i}", sec(0)) for i in range(50)] + [("k0", sec(60)), ("k0", sec(121)), ("z", sec(1000)), ("k0", sec(1002))]
    assert sorted((r.key, r.ts) for r in got.collect()) == sorted(want)
    state = lambda p: sum(s.numRowsTotal for s in p.stateOperators)
    assert state(q.recentProgress[-1]) <= 10  # two keys with their timers; fifty were held


def test_route_and_replayed_batch(spark, tmp_path):
    subs = spark.createDataFrame([("all", None), ("all", "x"), ("x1", "x"), ("x1", "x"), ("xy", "x"), ("xy", "y")], "subscriber string, topic string")
    alerts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id long, type string")
    want = [(1, "x", "all"), (1, "x", "x1"), (1, "x", "xy"), (2, "y", "all"), (2, "y", "xy"), (3, "z", "all"), (4, None, "all")]
    got = k.route(alerts, subs).select("id", "type", "subscriber")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    alerts.coalesce(1).write.parquet(str(tmp_path / "in"))
    for run in range(2):  # a new checkpoint numbers the same batch again
        source = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "in"))
        k.deliver(source, subs, str(tmp_path / "out"), str(tmp_path / f"ck{run}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, k.delivered(spark, str(tmp_path / "out")).select("id", "type", "subscriber").collect()), key=str) == sorted(want, key=str)


def test_alert_rules(spark):
    rows = [("d1", 20.0, 0.0, 0.9, 3), ("d2", 35.0, -0.5, 0.2, 3), ("d3", 90.0, 0.0, 0.2, 0), ("d4", 90.0, 0.0, 0.3, 2), ("d5", None, None, None, None)]
    df = spark.createDataFrame(rows, "date string, sentiment_index double, policy_stance_score double, attention_entropy double, industry_count long")
    assert sorted(map(tuple, al.alert_rows(df).collect())) == [("d1", "sentiment", "critical"), ("d2", "policy", "warning"), ("d2", "sentiment", "warning"), ("d2", "volatility", "warning")]
    assert al.alert_rows(df.filter(F.lit(False))).count() == 0
