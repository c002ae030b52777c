"""Ordered operators on series: anomaly, volatility, risk, factors, forecasts, backtests, trends.

Long input is (series_id, date, value); every operator works on many series at once, partitioned by series_id.
Deviations are population deviations, as the model defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("sentiment_index", "policy_stance_score", "attention_entropy", "industry_count", "event_count")


def to_long(daily: DataFrame, metrics=METRICS) -> DataFrame:
    """Wide daily metrics as (series_id, date, value)."""
    parts = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    return daily.selectExpr("date", f"stack({len(metrics)}, {parts}) as (series_id, value)")


def _by(n: int | None = None):
    w = W.partitionBy("series_id").orderBy("date")
    return w if n is None else w.rowsBetween(-(n - 1), 0)


def anomalies(long: DataFrame, days: int = 30, least: int = 3, z_least: float = 1.5) -> DataFrame:
    """WN1: z against the calendar window of the days before; at least `least` rows; kept from |z| >= z_least."""
    w = W.partitionBy("series_id").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    z = F.when(F.col("sd") > 1e-9, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    out = long.withColumns({"mean": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w), "n": F.count("value").over(w)}).filter(F.col("n") >= least).withColumn("z", z)
    severity = F.when(F.abs("z") >= 3, "critical").when(F.abs("z") >= 2, "warning").otherwise("notice")
    return out.filter(F.abs("z") >= z_least).select("series_id", "date", "value", "mean", "z", severity.alias("severity"))


def returns(long: DataFrame) -> DataFrame:
    """WN4: value over the previous one less 1; 0 after a zero; the first row of a series has none."""
    prev = F.lag("value").over(_by())
    return long.withColumn("r", F.when(prev == 0, 0.0).otherwise(F.col("value") / prev - 1)).filter(F.col("r").isNotNull())


def risk(long: DataFrame, year: int = 252, risk_free: float = 0.025, q: float = 0.05) -> DataFrame:
    """WN5-WN10: annual return, volatility, Sharpe, Sortino, drawdown, Calmar, VaR, ES, skew and kurtosis of each series.

    The ordered array of one series' returns is aggregated in the row; a series is as long as its history.
    """
    r = returns(long).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("date", "r"))).alias("h"), F.stddev_pop("r").alias("sd"), F.avg("r").alias("mean"),
        F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"), F.count("r").alias("n"),
        F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r"))).alias("down"), F.count_if(F.col("r") < 0).alias("n_down"))
    r = r.withColumn("x", F.transform("h", lambda s: s["r"])).withColumn("s", F.sort_array("x"))
    grown = F.aggregate("x", F.lit(1.0), lambda a, x: a * (1 + x))
    start = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("top"), F.lit(0.0).alias("dd"))

    def step(a, x):
        nav = a["nav"] * (1 + x)
        top = F.greatest(a["top"], nav)
        return F.struct(nav.alias("nav"), top.alias("top"), F.least(a["dd"], nav / top - 1).alias("dd"))

    r = r.withColumns({"annual_return": F.pow(grown, F.lit(float(year)) / F.col("n")) - 1, "volatility": F.col("sd") * (year**0.5), "max_drawdown": F.aggregate("x", start, step)["dd"]})
    cut = F.floor(F.col("n") * q).cast("int")
    return r.select(
        "series_id", "n", "annual_return", "volatility",
        F.when(F.col("volatility") > 0, (F.col("annual_return") - risk_free) / F.col("volatility")).alias("sharpe"),
        F.when((F.col("n_down") >= 2) & (F.col("down") > 0), (F.col("annual_return") - risk_free) / (F.sqrt(F.col("down") / F.col("n_down")) * (year**0.5))).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).alias("calmar"),
        F.element_at("s", F.greatest(F.lit(0), cut - 1) + 1).alias("var95"),
        (F.aggregate(F.slice("s", F.lit(1), F.greatest(F.lit(1), cut)), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), cut)).alias("es95"),
        "skew", "kurtosis",
    )


def volatility(daily: DataFrame, days: int = 14) -> DataFrame:
    """WN2: volatility index of the `days` calendar days before each day, from four parts with weights .35, .25, .20, .20.

    Three days at least, else the index is 0 and the level unknown. ma7 is the mean sentiment of the last seven of those days.
    There is one row for each day of history, so one task orders them.
    """
    o = W.partitionBy(F.lit(1)).orderBy(F.unix_date("date"))
    w = o.rangeBetween(-days, -1)
    d = daily.withColumn("step", F.abs(F.col("industry_count") - F.lag("industry_count").over(o)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = d.withColumns({
        "n": F.count("*").over(w), "sd": F.stddev_pop("sentiment_index").over(w), "pm": F.avg(F.abs("policy_stance_score")).over(w),
        "steps": zero(F.sum("step").over(w).cast("double")) - zero(F.first("step").over(w).cast("double")), "dens": F.avg(F.col("event_count") / F.greatest(F.col("industry_count"), F.lit(1))).over(w),
        "mean": F.avg("sentiment_index").over(w), "m7": F.avg("sentiment_index").over(o.rowsBetween(-7, -1)),
    })
    d = d.withColumn("iv", F.when(F.col("n") >= 2, F.col("steps") / (F.col("n") - 1)).otherwise(0.0))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    index = 100 * (0.35 * unit(F.col("sd") / 30) + 0.25 * unit(F.col("pm") / 0.7) + 0.2 * unit(F.col("iv") / 3) + 0.2 * unit(F.col("dens") / 5))
    enough = F.col("n") >= 3
    d = d.withColumn("volatility_index", F.when(enough, F.round(index, 1)).otherwise(0.0))
    x = F.col("volatility_index")
    level = F.when(~enough, "unknown").when(x >= 80, "extreme_fear").when(x >= 60, "fear").when(x >= 40, "neutral").when(x >= 20, "calm").otherwise("extreme_calm")
    part = lambda c, k: zero(F.when(enough, F.round(c, k)))
    return d.select(
        "date", "volatility_index", level.alias("level"), part(F.when(F.col("n") >= 7, F.col("m7")).otherwise(F.col("mean")), 1).alias("ma7"), part(F.col("sd"), 3).alias("sentiment_vol"),
        part(F.col("pm"), 3).alias("policy_vol"), part(F.col("iv"), 3).alias("industry_vol"), part(F.col("dens"), 3).alias("event_density"),
    )


def local_volatility(long: DataFrame, rows: int = 4) -> DataFrame:
    """WN3: deviation over the last rows; 0 until there are enough."""
    return long.select("series_id", "date", F.when(F.row_number().over(_by()) >= rows, F.stddev_pop("value").over(_by(rows))).otherwise(0.0).alias("local_volatility"))


def factors(long: DataFrame) -> DataFrame:
    """WN12, WN15: momentum, value, quality, volatility and size of each day, clamped to [-2, 2], and their weighted sum."""
    short, long_, q, v, s = _by(20), _by(60), _by(14), _by(30), _by(60)
    x = F.col("value")
    clip = lambda c: F.greatest(F.lit(-2.0), F.least(F.lit(2.0), c))
    d = long.withColumn("n", F.row_number().over(_by()))
    d = d.withColumns({"m20": F.avg(x).over(short), "m60": F.avg(x).over(long_), "s60": F.stddev_pop(x).over(s), "m14": F.avg(x).over(q), "s14": F.stddev_pop(x).over(q), "m30": F.avg(x).over(v), "s30": F.stddev_pop(x).over(v)})
    d = d.filter("n >= 60")
    sd = F.greatest(F.col("s60"), F.lit(1.0))
    out = {
        "momentum": clip((F.col("m20") - F.col("m60")) / sd),
        "value_factor": clip((F.col("m60") - x) / sd),
        "quality": clip(1 - F.col("s14") / F.greatest(F.abs("m14"), F.lit(1e-9))),
        "volatility": clip(-F.col("s30") / F.greatest(F.abs("m30"), F.lit(1e-9))),
        "size": clip((x - F.col("m60")) / sd),
    }
    d = d.withColumns(out)
    return d.select("series_id", "date", *out, (0.3 * F.col("momentum") + 0.2 * F.col("value_factor") + 0.2 * F.col("quality") + 0.2 * F.col("volatility") + 0.1 * F.col("size")).alias("composite"))


def information_coefficient(long: DataFrame) -> DataFrame:
    """WN13: correlation of momentum (sums of 21 and 61 rows over at most 20 and 60) with the next return, and of their ranks."""
    o = _by()
    i = F.row_number().over(o) - 1
    m = lambda n: F.sum("value").over(_by(n + 1)) / F.least(F.lit(n), i + 1)
    nxt = F.lead("value").over(o)
    d = long.withColumns({"f": m(20) - m(60), "r": F.when(F.col("value") != 0, nxt / F.col("value") - 1).otherwise(0.0), "has": nxt.isNotNull()}).filter("has")
    ranked = d.withColumns({"rf": F.row_number().over(W.partitionBy("series_id").orderBy("f", "date")), "rr": F.row_number().over(W.partitionBy("series_id").orderBy("r", "date"))})
    return ranked.groupBy("series_id").agg(F.corr("f", "r").alias("ic"), F.corr("rf", "rr").alias("rank_ic"), F.count("*").alias("n"))


def quintiles(long: DataFrame) -> DataFrame:
    """WN14: mean next return by fifth of the sorted factor; the last fifth takes the remainder."""
    o = _by()
    nxt = F.lead("value").over(o)
    d = long.withColumns({"f": F.col("value") - F.avg("value").over(_by(20)), "r": F.when(F.col("value") != 0, nxt / F.col("value") - 1).otherwise(0.0), "has": nxt.isNotNull()}).filter("has")
    n = F.count("*").over(W.partitionBy("series_id"))
    at = F.row_number().over(W.partitionBy("series_id").orderBy("f", "date")) - 1
    d = d.withColumn("quintile", F.least(F.lit(5), F.floor(at / F.greatest(F.lit(1), F.floor(n / 5))) + 1).cast("int"))
    return d.groupBy("series_id", "quintile").agg(F.avg("r").alias("mean_return"), F.count("*").alias("n"))


def naive_forecast(long: DataFrame, window: int = 5, horizon: int = 1, scale: float = 1.0) -> DataFrame:
    """WN16-WN18: moving average of the newest rows plus slope times horizon, with a band and a confidence."""
    newest = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("date")))
    i = F.row_number().over(_by()) - 1
    d = long.withColumns({"back": newest, "i": i})
    g = d.groupBy("series_id").agg(
        F.avg(F.when(F.col("back") <= window, F.col("value"))).alias("ma"), F.coalesce(F.regr_slope("value", "i"), F.lit(0.0)).alias("slope"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    half = 1.96 * F.greatest(F.col("sd"), F.lit(0.05 * scale)) * F.sqrt(F.lit(float(horizon)))
    short = F.col("n") < 3
    predicted = F.when(short, F.col("ma")).otherwise(F.col("ma") + F.col("slope") * horizon)
    half = F.when(short, F.lit(0.1 * scale)).otherwise(half)
    from ..functions.expressions import trend_label

    return g.select("series_id", predicted.alias("predicted"), (predicted - half).alias("lower"), (predicted + half).alias("upper"), F.when(short, 0.2).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.9), F.col("n") / 20))).alias("confidence"),
        F.when(short, "stable").otherwise(trend_label(F.col("slope"), scale)).alias("trend"), F.when(short, "MA").otherwise("MA+trend").alias("method"), "n")


def decompose(long: DataFrame, period: int = 7) -> DataFrame:
    """WN19: centred moving average, de-meaned phase means, rest."""
    half = period // 2
    i = F.row_number().over(_by()) - 1
    d = long.withColumns({"i": i, "trend": F.avg("value").over(W.partitionBy("series_id").orderBy("date").rowsBetween(-half, half))})
    d = d.withColumn("raw", F.avg(F.col("value") - F.col("trend")).over(W.partitionBy("series_id", F.col("i") % period)))
    phases = d.filter(F.col("i") < period).groupBy("series_id").agg(F.avg("raw").alias("base"))
    d = d.join(phases, "series_id").withColumn("seasonal", F.col("raw") - F.col("base"))
    return d.select("series_id", "date", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("rest"))


def backtest(long: DataFrame, lookback: int = 14, window: int = 5, horizons=(1, 3)) -> DataFrame:
    """WN24, WN25: walk-forward forecasts from the previous `lookback` rows; errors, direction and coverage by horizon."""
    o = _by()
    back = W.partitionBy("series_id").orderBy("date").rowsBetween(-lookback, -1)
    recent = W.partitionBy("series_id").orderBy("date").rowsBetween(-window, -1)
    i = (F.row_number().over(o) - 1).cast("double")
    d = long.withColumn("i", i)
    d = d.withColumns({"n": F.count("value").over(back), "ma": F.avg("value").over(recent), "slope": F.covar_pop("i", "value").over(back) / F.var_pop("i").over(back), "sd": F.stddev_pop("value").over(back), "last": F.lag("value").over(o)}).filter(F.col("n") == lookback)
    d = d.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    d = d.withColumn("actual", F.col("value")).withColumn("predicted", F.col("ma") + F.col("slope") * F.col("horizon"))
    e = F.col("predicted") - F.col("actual")
    same = F.signum(F.col("predicted") - F.col("last")) == F.signum(F.col("actual") - F.col("last"))
    inside = F.abs(e) <= 1.96 * F.greatest(F.col("sd"), F.lit(0.05)) * F.sqrt(F.col("horizon"))
    return d.groupBy("series_id", "horizon").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(same.cast("double")).alias("direction"), F.avg(inside.cast("double")).alias("coverage"), F.count("*").alias("n"))


def keyword_trends(keywords: DataFrame, as_of, recent: int = 3, before: int = 7, top: int = 50, least: int = 3) -> DataFrame:
    """WN35: emerging, declining and persistent keywords of the days up to `as_of`, in one conditional aggregation."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    g = keywords.filter((age >= 0) & (age < recent + before)).groupBy("keyword").agg(
        F.sum(F.when(age < recent, F.col("freq")).otherwise(0)).alias("recent_sum"), F.sum(F.when(age >= recent, F.col("freq")).otherwise(0)).alias("previous_sum"))
    g = g.filter(F.col("recent_sum") + F.col("previous_sum") >= least)
    ratio = (F.col("recent_sum") / recent) / F.when(F.col("previous_sum") > 0, F.col("previous_sum") / before)
    label = F.when(F.col("previous_sum") == 0, "emerging").when(ratio >= 1.5, "emerging").when(ratio <= 0.5, "declining").otherwise("persistent")
    return g.orderBy(F.desc("recent_sum"), "keyword").limit(top).select("keyword", "recent_sum", "previous_sum", ratio.alias("ratio"), label.alias("trend"))


def comparison(long: DataFrame, scale: float = 100.0) -> DataFrame:
    """J3, WN36: each day against the previous business day and the same day of the last week."""
    from ..functions.expressions import previous_business_day

    a = long.alias("a")
    d = a.join(long.alias("p"), (F.col("a.series_id") == F.col("p.series_id")) & (F.col("p.date") == previous_business_day(F.col("a.date"))), "left")
    d = d.join(long.alias("w"), (F.col("a.series_id") == F.col("w.series_id")) & (F.col("w.date") == F.date_sub(F.col("a.date"), 7)), "left")
    diff = F.col("a.value") - F.col("p.value")
    return d.select(F.col("a.series_id").alias("series_id"), F.col("a.date").alias("date"), diff.alias("day_diff"), F.when(F.col("p.value") == 0, 0.0).otherwise(100 * diff / F.col("p.value")).alias("day_pct"),
        (F.col("a.value") - F.col("w.value")).alias("week_diff"), F.when(diff.isNull(), None).when(diff > 0.02 * scale, "up").when(diff < -0.02 * scale, "down").otherwise("flat").alias("direction"))


def keyword_overlap(keywords: DataFrame) -> DataFrame:
    """J4, WN37: keywords of each day and the day before: Jaccard in percent, new and vanished."""
    today, before = keywords.select("date", "keyword").distinct(), keywords.select(F.date_add("date", 1).alias("date"), "keyword").distinct()
    both = today.withColumn("t", F.lit(1)).join(before.withColumn("p", F.lit(1)), ["date", "keyword"], "full_outer")
    n = lambda c: F.count_if(c)
    t, p = F.col("t").isNotNull(), F.col("p").isNotNull()
    return both.groupBy("date").agg((100.0 * n(t & p) / F.count("*")).alias("overlap_pct"), n(t & ~p).alias("new_keywords"), n(p & ~t).alias("vanished_keywords"))


def drift(long: DataFrame, floor: float = 0.01) -> DataFrame:
    """WN29: mean and deviation of first differences, the deviation at least `floor`."""
    d = long.withColumn("d", F.col("value") - F.lag("value").over(_by()))
    return d.groupBy("series_id").agg(F.avg("d").alias("drift"), F.greatest(F.coalesce(F.stddev_pop("d"), F.lit(0.0)), F.lit(floor)).alias("volatility"))


def momentum(long: DataFrame) -> DataFrame:
    """WN38: mean of the newest third less the mean of the rest."""
    n = F.count("*").over(W.partitionBy("series_id"))
    back = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("date")))
    new = back <= F.greatest(F.lit(1), F.floor(n / 3))
    return long.withColumn("new", new).groupBy("series_id").agg((F.avg(F.when(F.col("new"), F.col("value"))) - F.avg(F.when(~F.col("new"), F.col("value")))).alias("momentum"))


def industry_returns(industries: DataFrame) -> DataFrame:
    """WN26: .02 by stance and .001 for each relative change of hits."""
    prev = F.lag("hit_count").over(W.partitionBy("industry").orderBy("date"))
    stance = F.when(F.col("stance") == "bullish", 0.02).when(F.col("stance") == "bearish", -0.02).otherwise(0.0)
    return industries.withColumn("r", stance + 0.001 * F.coalesce((F.col("hit_count") - prev) / F.greatest(prev, F.lit(1)), F.lit(0.0))).select("industry", "date", "r")


def alpha_beta(strategy: DataFrame, benchmark: DataFrame, year: int = 252) -> DataFrame:
    """WN28, J5, WN9: beta, alpha, information ratio and captures of each series of returns (series_id, date, r), joined by date."""
    d = strategy.join(benchmark.select("date", F.col("r").alias("b")), "date")
    g = d.groupBy("series_id").agg(F.covar_pop("r", "b").alias("cov"), F.var_pop("b").alias("var"), F.avg("r").alias("mr"), F.avg("b").alias("mb"), F.avg(F.col("r") - F.col("b")).alias("me"), F.stddev_pop(F.col("r") - F.col("b")).alias("te"),
        F.avg(F.when(F.col("b") > 0, F.col("r"))).alias("up_capture"), F.avg(F.when(F.col("b") < 0, F.col("r"))).alias("down_capture"))
    beta = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)
    return g.select("series_id", beta.alias("beta"), ((F.col("mr") - beta * F.col("mb")) * year).alias("alpha"), F.when(F.col("te") > 0, F.col("me") / F.col("te") * year**0.5).otherwise(0.0).alias("information_ratio"), "up_capture", "down_capture")


def as_of(long: DataFrame, dates: DataFrame) -> DataFrame:
    """J6: for each (series_id, at) the latest value at or before it, by one ordered window over both sides."""
    both = long.select("series_id", "date", "value", F.lit(0).alias("asked")).unionByName(dates.select("series_id", F.col("at").alias("date"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked")))
    w = W.partitionBy("series_id").orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumns({"found": F.last("value", True).over(w), "found_date": F.last(F.when(F.col("asked") == 0, F.col("date")), True).over(w)}).filter("asked = 1").select("series_id", F.col("date").alias("at"), "found_date", F.col("found").alias("value"))


def portfolio(returns_: DataFrame, weights: dict[str, float], every: int = 5) -> DataFrame:
    """WN27: daily return of weights that drift with returns and are reset every `every` rows (0: never).

    Between resets the product of (1 + r) gives the drifted weight in closed form, so the walk is a window, not a loop.
    """
    w = returns_.sparkSession.createDataFrame([(k, float(v) / sum(weights.values())) for k, v in weights.items()], "industry string, w double")
    days = returns_.select("date").distinct().withColumn("i", F.row_number().over(W.orderBy("date")) - 1)
    d = returns_.join(F.broadcast(w), "industry").join(days, "date").withColumn("block", F.floor(F.col("i") / every) if every else F.lit(0))
    before = W.partitionBy("industry", "block").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    lost = F.coalesce(F.max((F.col("r") <= -1).cast("int")).over(before), F.lit(0))  # a total loss leaves nothing until the next reset
    grown = F.coalesce(F.exp(F.sum(F.when(F.col("r") > -1, F.ln(1 + F.col("r")))).over(before)), F.lit(1.0))
    d = d.withColumn("v", F.when(lost == 1, 0.0).otherwise(F.col("w") * grown))
    return d.groupBy("date").agg((F.sum(F.col("v") * F.col("r")) / F.sum("v")).alias("portfolio_return"))


def load(long: DataFrame, usual: dict[str, float]) -> DataFrame:
    """LD1: the series named in `usual`, null and zero values replaced by theirs."""
    other = F.coalesce(*[F.when(F.col("series_id") == k, F.lit(x)) for k, x in usual.items()])
    return long.withColumn("usual", other).filter("usual is not null").select("date", "series_id", F.coalesce(F.nullif("value", F.lit(0.0)), F.col("usual")).alias("value"))


def underwater(returns_: DataFrame) -> DataFrame:
    """WN7: (series_id, max_drawdown, longest_underwater): the value of 1 invested, its deepest fall below its top, and the most rows
    in a row below it. Rows at the top start islands; the rest of an island is under water. A return of -1 ends at 0 and stays there.
    """
    grow = F.sum(F.when(F.col("r") > -1, F.ln(1 + F.col("r")))).over(_by())
    lost = F.max((F.col("r") <= -1).cast("int")).over(_by())
    d = returns_.withColumn("l", F.when(lost == 1, float("-inf")).otherwise(F.coalesce(grow, F.lit(0.0))))
    d = d.withColumn("top", F.greatest(F.lit(0.0), F.max("l").over(_by())))
    d = d.withColumns({"under": F.col("l") < F.col("top") - 1e-12, "fall": F.exp(F.col("l") - F.col("top")) - 1})
    d = d.withColumn("island", F.sum((~F.col("under")).cast("int")).over(_by()))
    runs = d.groupBy("series_id", "island").agg(F.count_if("under").alias("run"), F.min("fall").alias("fall"))
    return runs.groupBy("series_id").agg(F.least(F.lit(0.0), F.min("fall")).alias("max_drawdown"), F.max("run").alias("longest_underwater"))


def detect_periods(long: DataFrame, candidates: tuple = (5, 7, 14, 30), usual: int = 7, least: int = 30) -> DataFrame:
    """WN21: (series_id, period): the lag of largest absolute autocorrelation, the first if tied; `usual` for short series."""
    x = F.col("value")
    d = long.withColumns({f"lag{p}": F.lag("value", p).over(_by()) for p in candidates})
    g = d.groupBy("series_id").agg(F.count("*").alias("n"), *[F.corr(F.col(f"lag{p}"), x).alias(f"c{p}") for p in candidates])
    rows = F.array(*[F.struct(F.round(-F.abs(F.coalesce(F.nanvl(f"c{p}", F.lit(0.0)), F.lit(0.0))), 9).alias("c"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(candidates)])
    best = F.array_sort(rows)[0]
    return g.select("series_id", F.when((F.col("n") < least) | (best["c"] == 0), usual).otherwise(best["p"]).alias("period"))


def capture_report(returns_: DataFrame, main: str, bench: str) -> DataFrame:
    """WN11, WN9: mean return of the main series on days when the benchmark rose and fell, joined by date."""
    m, b = returns_.filter(F.col("series_id") == main).select("date", "r"), returns_.filter(F.col("series_id") == bench).select("date", F.col("r").alias("b"))
    return m.join(b, "date").agg(F.lit(main).alias("main"), F.lit(bench).alias("benchmark"), F.avg(F.when(F.col("b") > 0, F.col("r"))).alias("up_capture"), F.avg(F.when(F.col("b") < 0, F.col("r"))).alias("down_capture"), F.count("*").alias("n"))


def best_worst(reports: DataFrame) -> DataFrame:
    """WN39: the horizons of best and worst direction of each series, the first one if tied."""
    return reports.groupBy("series_id").agg(F.min_by("horizon", F.struct(-F.round("direction", 9), F.col("horizon"))).alias("best"), F.min_by("horizon", F.struct(F.round("direction", 9), F.col("horizon"))).alias("worst"))


def keyword_changes(keywords: DataFrame, most: int = 20) -> DataFrame:
    """WN37: (date, change, keywords): new and vanished keywords of each day against the day before, sorted, `most` at most."""
    today, before = keywords.select("date", "keyword").distinct(), keywords.select(F.date_add("date", 1).alias("date"), "keyword").distinct()
    new, gone = today.join(before, ["date", "keyword"], "left_anti").withColumn("change", F.lit("new")), before.join(today, ["date", "keyword"], "left_anti").withColumn("change", F.lit("vanished"))
    rank = F.row_number().over(W.partitionBy("date", "change").orderBy("keyword"))
    return new.unionByName(gone).withColumn("r", rank).filter(F.col("r") <= most).groupBy("date", "change").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords"))


#: Fixed values of the model: scenarios with their shocks to sentiment, policy and industries, factor on volatility, and days.
SCENARIOS = [
    ("rate_cut_50bp", 8.0, 0.20, 1.5, 1.2, 30), ("rate_hike_25bp", -6.0, -0.15, -0.8, 1.4, 30), ("property_crisis", -15.0, -0.30, -2.0, 1.8, 60), ("export_boom", 5.0, 0.10, 0.8, 0.9, 30),
    ("geopolitical_shock", -10.0, -0.05, -1.0, 1.6, 45), ("ai_breakthrough", 12.0, 0.10, 2.5, 1.3, 60), ("baseline", 0.0, 0.0, 0.0, 1.0, 30),
]


def scenarios(long: DataFrame, shocks: tuple = ("sentiment_index", "policy_stance_score", "industry_count")) -> DataFrame:
    """WN32 over WN29: (scenario, series_id, horizon, start, drift, volatility): what each scenario of the catalogue starts from.

    start is the newest value of a series with the scenario's shock (the columns' order is that of `shocks`, the series' names); the
    volatility is the series' own times the scenario's factor.
    """
    catalogue = long.sparkSession.createDataFrame(SCENARIOS, "scenario string, a double, b double, c double, vol_mult double, horizon int")
    each = catalogue.select("scenario", "vol_mult", "horizon", F.explode(F.array(*[F.struct(F.lit(s).alias("series_id"), F.col(x).alias("shock")) for s, x in zip(shocks, "abc")])).alias("x")).select("scenario", "vol_mult", "horizon", "x.*")
    now = drift(long).join(long.groupBy("series_id").agg(F.max_by("value", "date").alias("value")), "series_id")
    return each.join(now, "series_id").select("scenario", "series_id", "horizon", (F.col("value") + F.col("shock")).alias("start"), "drift", (F.col("volatility") * F.col("vol_mult")).alias("volatility"))
