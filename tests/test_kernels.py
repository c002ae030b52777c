import datetime

import numpy as np

from tidemark.operators import decision, kernels, timeseries
from tidemark.sources import storage


def series(spark, values, name="s"):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(name, day + datetime.timedelta(i), float(x)) for i, x in enumerate(values)], "series_id string, date date, value double")


def test_forecast_goldens(spark):
    one = lambda x, **kw: timeseries.naive_forecast(series(spark, x), **kw).collect()[0]
    r = one([1, 3], scale=2)
    assert (r.predicted, round(r.lower, 6), round(r.upper, 6), r.method, r.n) == (2.0, 1.8, 2.2, "MA", 2)
    r = one([1, 2, 3, 4, 5], horizon=2, scale=1)
    assert round(r.predicted, 6) == 5.0 and r.trend == "rising" and r.method == "MA+trend" and round(r.confidence, 6) == 0.25 and round(r.lower, 2) == 1.08 and round(r.upper, 2) == 8.92


def test_regimes_find_the_break(spark):
    rng = np.random.default_rng(42)
    y = [*rng.normal(50, 3, 15), *rng.normal(75, 8, 15)]
    p = [r.p_high for r in kernels.regimes(series(spark, y)).orderBy("date").collect()]
    assert all(0 <= x <= 1 for x in p) and max(p[:14]) < 0.5 < min(p[16:])


def test_regimes_against_plain_filter(spark):
    """One step of the same model, written out: filter and smoother with emissions, by sums over the two states."""
    rng = np.random.default_rng(7)
    y = [*rng.normal(10, 1, 12), *rng.normal(20, 2, 12)]
    got = [r.p_high for r in kernels.regimes(series(spark, y), rounds=1).orderBy("date").collect()]
    high = [v > np.median(y) for v in y]
    mean = [np.mean([v for v, h in zip(y, high) if h == s]) for s in (False, True)]
    var, move = np.var(y), [[0.9, 0.1], [0.1, 0.9]]
    like = [[np.exp(-((v - m) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) for m in mean] for v in y]
    n = len(y)
    fwd, bwd = [[0.0, 0.0] for _ in y], [[1.0, 1.0] for _ in y]
    for t in range(n):
        for s in (0, 1):
            fwd[t][s] = (0.5 if t == 0 else sum(fwd[t - 1][r] * move[r][s] for r in (0, 1))) * like[t][s]
    for t in range(n - 2, -1, -1):
        for s in (0, 1):
            bwd[t][s] = sum(move[s][r] * like[t + 1][r] * bwd[t + 1][r] for r in (0, 1))
    for t in range(n):
        both = [fwd[t][s] * bwd[t][s] for s in (0, 1)]
        assert abs(both[1] / sum(both) - got[t]) < 1e-6


def plain_holt_winters(y, p, h):
    best = None
    for a in (0.1, 0.3, 0.5, 0.7):
        for b in (0.05, 0.1, 0.3):
            for g in (0.1, 0.3, 0.5):
                first = sum(y[:p]) / p
                level, trend, season, errors = first, (sum(y[p : 2 * p]) / p - first) / p, [v - first for v in y[:p]], []
                for i in range(p, len(y)):
                    s = season[i % p]
                    errors.append(abs(level + trend + s - y[i]))
                    new = a * (y[i] - s) + (1 - a) * (level + trend)
                    trend, level, season[i % p] = b * (new - level) + (1 - b) * trend, new, g * (y[i] - new) + (1 - g) * s
                mae = sum(errors) / len(errors)
                if best is None or mae < best[0] - 1e-12:
                    best = mae, level + h * trend + season[(len(y) + h - 1) % p]
    return best


def test_holt_winters_against_plain_recursion(spark):
    rng = np.random.default_rng(3)
    y = [50 + 0.3 * i + 5 * np.sin(i * 2 * np.pi / 7) + rng.normal(0, 1) for i in range(60)]
    r = kernels.holt_winters(series(spark, y)).collect()[0]
    mae, predicted = plain_holt_winters(y, 7, 3)
    assert abs(r.mae - mae) < 1e-9 and abs(r.predicted - predicted) < 1e-9
    periods = spark.createDataFrame([("s", 7)], "series_id string, period int")
    got = {x.horizon: x for x in kernels.enhanced_report(series(spark, y), periods).collect()}
    assert sorted(got) == [1, 3, 7, 14] and abs(got[3].predicted - predicted) < 1e-9 and got[14].upper - got[14].lower > got[1].upper - got[1].lower
    assert kernels.enhanced_report(series(spark, y[:10]), periods).count() == 0


def test_underwater_and_total_loss(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day + datetime.timedelta(i), r) for i, r in enumerate([0.1, -0.1, -0.1, 0.3, -0.5, 0.1, 0.1, 0.1])] + [("t", day, -1.0), ("t", day + datetime.timedelta(1), 0.5)]
    got = {r.series_id: r for r in timeseries.underwater(spark.createDataFrame(rows, "series_id string, date date, r double")).collect()}
    assert got["s"].longest_underwater == 4 and abs(got["s"].max_drawdown + 0.5) < 1e-9 and got["t"].max_drawdown == -1 and got["t"].longest_underwater == 2
    p = spark.createDataFrame([(i, day + datetime.timedelta(k), r) for i, rs in (("a", [-1.0, 0.5, 0.5]), ("b", [0.1, 0.1, 0.1])) for k, r in enumerate(rs)], "industry string, date date, r double")
    got = [r.portfolio_return for r in timeseries.portfolio(p, {"a": 0.5, "b": 0.5}, 0).orderBy("date").collect()]
    assert np.allclose(got, [-0.45, 0.1, 0.1])


def test_holt_winters_follows_a_season(spark):
    y = [100 + i + 10 * (i % 7 == 3) for i in range(70)]
    r = kernels.holt_winters(series(spark, y), horizon=1).collect()[0]
    assert abs(r.predicted - 170) < 3 and r.n == 70


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("a", "c", 2), ("c", "d", 1)], "src string, dst string, weight long")
    rank = {r.node: r["rank"] for r in decision.pagerank(edges, rounds=20).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank["a"] > rank["d"]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d2")], "id string, v long, date string").write.partitionBy("date").parquet(path)
    new = spark.createDataFrame([("a", 5, "d1", 1), ("a", 7, "d1", 2), ("c", 9, "d1", 1)], "id string, v long, date string, seq long")
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    storage.upsert(spark, path, new, ["id", "date"], "seq")
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2), ("c", 9)]
