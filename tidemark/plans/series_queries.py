"""Queries over daily metrics and long series, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


def query(name: str, sql: str | None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {v.SQL.strip()}{',' if not sql.lstrip().upper().startswith('SELECT') else ''} {sql}"
        return make

    return keep


LONG = """long AS (SELECT date, 'sentiment_index' AS series_id, CAST(sentiment_index AS DOUBLE) AS value FROM daily_metric UNION ALL SELECT date, 'policy_stance_score', policy_stance_score FROM daily_metric
 UNION ALL SELECT date, 'attention_entropy', attention_entropy FROM daily_metric UNION ALL SELECT date, 'industry_count', industry_count FROM daily_metric UNION ALL SELECT date, 'event_count', event_count FROM daily_metric)"""
RETURNS = """p AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM series),
r AS (SELECT series_id, date, CASE WHEN prev = 0 THEN 0 ELSE value / prev - 1 END AS r FROM p WHERE prev IS NOT NULL)"""


def long(spark, sf_dir):
    return ts.to_long(v.daily_metric(spark, sf_dir))


@query("ag08_daily_metric", "SELECT date, article_count, unique_keywords, round(sentiment_index, 6) AS sentiment_index, round(policy_stance_score, 6) AS policy_stance_score, industry_count, event_count, round(attention_entropy, 6) AS attention_entropy, round(attention_top_share, 6) AS attention_top_share FROM daily_metric")
def daily_metric(spark, sf_dir):
    return v.daily_metric(spark, sf_dir)


ANOMALY = """z AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n FROM long
 WINDOW w AS (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
a AS (SELECT series_id, date, value, mean, CASE WHEN sd > 1e-9 THEN (value - mean) / sd ELSE 0 END AS z FROM z WHERE n >= 3)"""


@query("wn01_anomalies", f"""{LONG}, {ANOMALY} SELECT series_id, date, round(value, 6) AS value, round(mean, 6) AS mean, round(z, 6) AS z,
 CASE WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2 THEN 'warning' ELSE 'notice' END AS severity FROM a WHERE abs(z) >= 1.5""")
def anomalies(spark, sf_dir):
    return ts.anomalies(long(spark, sf_dir))


@query("wn03_local_volatility", """SELECT series_id, date, round(CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date) >= 4 THEN stddev_pop(value) OVER (PARTITION BY series_id ORDER BY date ROWS 3 PRECEDING) ELSE 0 END, 4) AS local_volatility FROM series""")
def local_volatility(spark, sf_dir):
    return ts.local_volatility(v.order_series(spark, sf_dir)).withColumn("local_volatility", F.round("local_volatility", 4))


@query("wn04_returns", f"{RETURNS} SELECT series_id, date, round(r, 6) AS r FROM r")
def returns(spark, sf_dir):
    return ts.returns(v.order_series(spark, sf_dir)).select("series_id", "date", "r")


@query("wn05_risk_report", f"""{RETURNS},
nav AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY series_id ORDER BY date) AS l FROM r),
dd AS (SELECT series_id, min(exp(l - greatest(0, m)) - 1) AS x FROM (SELECT *, max(l) OVER (PARTITION BY series_id ORDER BY date) AS m FROM nav) GROUP BY series_id),
g AS (SELECT series_id, count(*) AS n, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS ar, stddev_pop(r) * sqrt(252) AS vol, sum(CASE WHEN r < 0 THEN r * r END) AS down, count(*) FILTER (r < 0) AS nd,
 list_sort(list(r)) AS s, avg(r) AS m1, avg(r*r) AS m2, avg(r*r*r) AS m3, avg(r*r*r*r) AS m4 FROM r GROUP BY series_id)
SELECT g.series_id, n, round(ar, 6) AS annual_return, round(vol, 6) AS volatility, round((ar - .025) / vol, 6) AS sharpe, round((ar - .025) / (sqrt(down / nd) * sqrt(252)), 6) AS sortino,
 round(least(0, x), 6) AS max_drawdown, round(ar / abs(x), 6) AS calmar, round(s[greatest(0, CAST(floor(n * .05) AS INT) - 1) + 1], 6) AS var95,
 round(list_avg(s[1:greatest(1, CAST(floor(n * .05) AS INT))]), 6) AS es95,
 round((m3 - 3*m1*m2 + 2*m1*m1*m1) / pow(m2 - m1*m1, 1.5), 6) AS skew, round((m4 - 4*m1*m3 + 6*m1*m1*m2 - 3*m1*m1*m1*m1) / pow(m2 - m1*m1, 2) - 3, 6) AS kurtosis FROM g JOIN dd USING (series_id)""")
def risk(spark, sf_dir):
    return ts.risk(v.order_series(spark, sf_dir))


@query("wn12_factors", """f AS (SELECT series_id, date, value, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n, avg(value) OVER a AS m20, avg(value) OVER b AS m60, greatest(stddev_pop(value) OVER b, 1) AS s60,
 avg(value) OVER c AS m14, stddev_pop(value) OVER c AS s14, avg(value) OVER d AS m30, stddev_pop(value) OVER d AS s30 FROM series WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS 19 PRECEDING),
 b AS (PARTITION BY series_id ORDER BY date ROWS 59 PRECEDING), c AS (PARTITION BY series_id ORDER BY date ROWS 13 PRECEDING), d AS (PARTITION BY series_id ORDER BY date ROWS 29 PRECEDING)),
g AS (SELECT series_id, date, greatest(-2, least(2, (m20 - m60) / s60)) AS momentum, greatest(-2, least(2, (m60 - value) / s60)) AS value_factor, greatest(-2, least(2, 1 - s14 / greatest(abs(m14), 1e-9))) AS quality,
 greatest(-2, least(2, -s30 / greatest(abs(m30), 1e-9))) AS volatility, greatest(-2, least(2, (value - m60) / s60)) AS size FROM f WHERE n >= 60)
SELECT series_id, date, round(momentum, 6) AS momentum, round(value_factor, 6) AS value_factor, round(quality, 6) AS quality, round(volatility, 6) AS volatility, round(size, 6) AS size,
 round(.3 * momentum + .2 * value_factor + .2 * quality + .2 * volatility + .1 * size, 6) AS composite FROM g""")
def factors(spark, sf_dir):
    return ts.factors(v.order_series(spark, sf_dir))


IC = """q AS (SELECT *, row_number() OVER o - 1 AS i, lead(value) OVER o AS nxt FROM series WINDOW o AS (PARTITION BY series_id ORDER BY date)),"""


@query("wn13_information_coefficient", f"""{IC} f AS (SELECT series_id, date, sum(value) OVER a / least(20, i + 1) - sum(value) OVER b / least(60, i + 1) AS f, CASE WHEN value <> 0 THEN nxt / value - 1 ELSE 0 END AS r, nxt FROM q
 WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS 20 PRECEDING), b AS (PARTITION BY series_id ORDER BY date ROWS 60 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY f, date) AS rf, row_number() OVER (PARTITION BY series_id ORDER BY r, date) AS rr FROM f WHERE nxt IS NOT NULL)
SELECT series_id, round(corr(f, r), 6) AS ic, round(corr(rf, rr), 6) AS rank_ic, count(*) AS n FROM k GROUP BY series_id""")
def information_coefficient(spark, sf_dir):
    return ts.information_coefficient(v.order_series(spark, sf_dir))


@query("wn14_quintiles", f"""{IC} f AS (SELECT series_id, date, value - avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS 19 PRECEDING) AS f, CASE WHEN value <> 0 THEN nxt / value - 1 ELSE 0 END AS r, nxt FROM q),
k AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY f, date) - 1 AS pos FROM f WHERE nxt IS NOT NULL)
SELECT series_id, CAST(least(5, pos // greatest(1, n // 5) + 1) AS INT) AS quintile, round(avg(r), 6) AS mean_return, count(*) AS n FROM k GROUP BY ALL""")
def quintiles(spark, sf_dir):
    return ts.quintiles(v.order_series(spark, sf_dir))


FORECAST = """b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM long),
g AS (SELECT series_id, avg(value) FILTER (back <= 5) AS ma, coalesce(regr_slope(value, i), 0) AS slope, stddev_pop(value) AS sd, count(*) AS n FROM b GROUP BY series_id)"""


@query("wn17_naive_forecast", f"""{LONG}, {FORECAST} SELECT series_id, round(ma + slope * 3, 6) AS predicted, round(ma + slope * 3 - 1.96 * greatest(sd, .05) * sqrt(3), 6) AS lower, round(ma + slope * 3 + 1.96 * greatest(sd, .05) * sqrt(3), 6) AS upper,
 round(greatest(.2, least(.9, n / 20)), 6) AS confidence, CASE WHEN abs(slope) < .1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend, 'MA+trend' AS method, n FROM g""")
def naive_forecast(spark, sf_dir):
    return ts.naive_forecast(long(spark, sf_dir), horizon=3)


@query("wn19_decomposition", """i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM series),
p AS (SELECT *, avg(value - trend) OVER (PARTITION BY series_id, i % 7) AS raw FROM i), b AS (SELECT series_id, avg(raw) AS base FROM p WHERE i < 7 GROUP BY series_id)
SELECT series_id, date, round(trend, 4) AS trend, round(raw - base, 4) AS seasonal, round(value - trend - raw + base, 4) AS rest FROM p JOIN b USING (series_id)""")
def decomposition(spark, sf_dir):
    return rounded(ts.decompose(v.order_series(spark, sf_dir)), 4)


@query("wn25_backtest", """t AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS DOUBLE) AS i FROM series),
w AS (SELECT *, count(value) OVER b AS n, avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma, covar_pop(i, value) OVER b / nullif(var_pop(i) OVER b, 0) AS slope, stddev_pop(value) OVER b AS sd,
 lag(value) OVER (PARTITION BY series_id ORDER BY date) AS last FROM t WINDOW b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, ma + slope * horizon AS predicted FROM w, (SELECT unnest([1, 3]) AS horizon) WHERE n = 14)
SELECT series_id, CAST(horizon AS INT) AS horizon, round(avg(abs(predicted - value)), 4) AS mae, round(sqrt(avg((predicted - value) ** 2)), 4) AS rmse, round(avg(predicted - value), 4) AS bias,
 round(avg(CASE WHEN sign(predicted - last) = sign(value - last) THEN 1e0 ELSE 0e0 END), 6) AS direction, round(avg(CASE WHEN abs(predicted - value) <= 1.96 * greatest(sd, .05) * sqrt(horizon) THEN 1e0 ELSE 0e0 END), 6) AS coverage, count(*) AS n
FROM h GROUP BY ALL""")
def backtest(spark, sf_dir):
    return ts.backtest(v.order_series(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "bias")})


@query("wn26_industry_returns", """r AS (SELECT *, lag(hit_count) OVER (PARTITION BY industry ORDER BY date) AS prev FROM industry_daily)
SELECT industry, date, round(CASE stance WHEN 'bullish' THEN .02 WHEN 'bearish' THEN -.02 ELSE 0 END + .001 * coalesce((hit_count - prev) / greatest(prev, 1), 0), 6) AS r FROM r""")
def industry_returns(spark, sf_dir):
    return ts.industry_returns(v.industry_daily(spark, sf_dir))


@query("wn28_alpha_beta", f"""{RETURNS}, m AS (SELECT date, avg(r) AS b FROM r GROUP BY date), j AS (SELECT series_id, r, b FROM r JOIN m USING (date)),
g AS (SELECT series_id, CASE WHEN var_pop(b) > 0 THEN covar_pop(r, b) / var_pop(b) ELSE 0 END AS beta, avg(r) AS mr, avg(b) AS mb, avg(r - b) AS me, stddev_pop(r - b) AS te, avg(r) FILTER (b > 0) AS up, avg(r) FILTER (b < 0) AS down FROM j GROUP BY series_id)
SELECT series_id, round(beta, 6) AS beta, round((mr - beta * mb) * 252, 6) AS alpha, round(CASE WHEN te > 0 THEN me / te * sqrt(252) ELSE 0 END, 6) AS information_ratio, round(up, 6) AS up_capture, round(down, 6) AS down_capture FROM g""")
def alpha_beta(spark, sf_dir):
    r = ts.returns(v.order_series(spark, sf_dir)).select("series_id", "date", "r")
    return ts.alpha_beta(r, r.groupBy("date").agg(F.avg("r").alias("r")))


@query("wn29_drift", """d AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS d FROM series)
SELECT series_id, round(avg(d), 6) AS drift, round(greatest(coalesce(stddev_pop(d), 0), .01), 6) AS volatility FROM d GROUP BY series_id""")
def drift(spark, sf_dir):
    return ts.drift(v.order_series(spark, sf_dir))


@query("wn35_keyword_trends", """t AS (SELECT max(date) AS d FROM e), g AS (SELECT keyword, sum(CASE WHEN date_diff('day', date, d) < 3 THEN freq ELSE 0 END) AS recent_sum, sum(CASE WHEN date_diff('day', date, d) >= 3 THEN freq ELSE 0 END) AS previous_sum
 FROM keyword_daily, t WHERE date_diff('day', date, d) BETWEEN 0 AND 9 GROUP BY keyword), h AS (SELECT *, CASE WHEN previous_sum > 0 THEN (recent_sum / 3) / (previous_sum / 7) END AS ratio FROM g WHERE recent_sum + previous_sum >= 3)
SELECT keyword, CAST(recent_sum AS BIGINT) AS recent_sum, CAST(previous_sum AS BIGINT) AS previous_sum, round(ratio, 6) AS ratio, CASE WHEN previous_sum = 0 OR ratio >= 1.5 THEN 'emerging' WHEN ratio <= .5 THEN 'declining' ELSE 'persistent' END AS trend
FROM h ORDER BY recent_sum DESC, keyword LIMIT 50""")
def keyword_trends(spark, sf_dir):
    k = v.keyword_daily(spark, sf_dir)
    return ts.keyword_trends(k, v.events(spark, sf_dir).agg(F.max("date")).first()[0])


@query("wn36_comparison", f"""{LONG}, p AS (SELECT series_id, date, value, date - CAST(CASE dayofweek(date) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS INT) AS before FROM long)
SELECT p.series_id, p.date, round(p.value - b.value, 6) AS day_diff, round(CASE WHEN b.value = 0 THEN 0 ELSE 100 * (p.value - b.value) / b.value END, 6) AS day_pct, round(p.value - w.value, 6) AS week_diff,
 CASE WHEN b.value IS NULL THEN NULL WHEN p.value - b.value > 2 THEN 'up' WHEN p.value - b.value < -2 THEN 'down' ELSE 'flat' END AS direction
FROM p LEFT JOIN long b ON b.series_id = p.series_id AND b.date = p.before LEFT JOIN long w ON w.series_id = p.series_id AND w.date = p.date - 7""")
def comparison(spark, sf_dir):
    return ts.comparison(long(spark, sf_dir))


@query("wn37_keyword_overlap", """a AS (SELECT DISTINCT date, keyword, 1 AS t FROM keyword_daily), b AS (SELECT DISTINCT CAST(date + 1 AS DATE) AS date, keyword, 1 AS p FROM keyword_daily), f AS (SELECT * FROM a FULL JOIN b USING (date, keyword))
SELECT date, round(100.0 * count(*) FILTER (t = 1 AND p = 1) / count(*), 6) AS overlap_pct, count(*) FILTER (t = 1 AND p IS NULL) AS new_keywords, count(*) FILTER (p = 1 AND t IS NULL) AS vanished_keywords FROM f GROUP BY date""")
def keyword_overlap(spark, sf_dir):
    return ts.keyword_overlap(v.keyword_daily(spark, sf_dir))


@query("wn38_momentum", """n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM series)
SELECT series_id, round(avg(value) FILTER (back <= greatest(1, n // 3)) - avg(value) FILTER (back > greatest(1, n // 3)), 4) AS momentum FROM n GROUP BY series_id""")
def momentum(spark, sf_dir):
    return rounded(ts.momentum(v.order_series(spark, sf_dir)), 4)


@query("wn27_portfolio", """r0 AS (SELECT *, lag(hit_count) OVER (PARTITION BY industry ORDER BY date) AS prev FROM industry_daily),
r AS (SELECT industry, date, CASE stance WHEN 'bullish' THEN .02 WHEN 'bearish' THEN -.02 ELSE 0 END + .001 * coalesce((hit_count - prev) / greatest(prev, 1), 0) AS r FROM r0),
d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM r)),
w AS (SELECT r.*, i // 5 AS block, CASE industry WHEN 'click' THEN .4 WHEN 'purchase' THEN .4 WHEN 'error' THEN .2 END AS w FROM r JOIN d USING (date) WHERE industry IN ('click', 'purchase', 'error')),
x AS (SELECT *, w * coalesce(exp(sum(ln(1 + r)) OVER (PARTITION BY industry, block ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS v FROM w)
SELECT date, round(sum(v * r) / sum(v), 6) AS portfolio_return FROM x GROUP BY date""")
def portfolio(spark, sf_dir):
    return ts.portfolio(ts.industry_returns(v.industry_daily(spark, sf_dir)), {"click": 0.4, "purchase": 0.4, "error": 0.2})


@query("j06_as_of", """q AS (SELECT DISTINCT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) + 1 AS at FROM orders)
SELECT q.series_id, CAST(q.at AS DATE) AS at, s.date AS found_date, round(s.value, 4) AS value FROM q ASOF LEFT JOIN series s ON q.series_id = s.series_id AND q.at >= s.date""")
def as_of(spark, sf_dir):
    s = v.order_series(spark, sf_dir)
    return rounded(ts.as_of(s, s.select("series_id", F.date_add("date", 1).alias("at"))), 4)


UNDER = """lv AS (SELECT series_id, date, sum(ln(1 + r)) OVER (PARTITION BY series_id ORDER BY date) AS l FROM r), tv AS (SELECT *, greatest(0, max(l) OVER (PARTITION BY series_id ORDER BY date)) AS top FROM lv),
uv AS (SELECT *, l < top - 1e-12 AS under, sum(CASE WHEN l < top - 1e-12 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY date) AS island FROM tv), rv AS (SELECT series_id, island, count(*) FILTER (under) AS run, min(exp(l - top) - 1) AS fall FROM uv GROUP BY ALL)"""


@query("wn07_underwater", f"{RETURNS}, {UNDER} SELECT series_id, round(least(0, min(fall)), 6) AS max_drawdown, max(run) AS longest_underwater FROM rv GROUP BY series_id")
def underwater(spark, sf_dir):
    return ts.underwater(ts.returns(v.order_series(spark, sf_dir)))


MRET = """mp AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM long), mr AS (SELECT series_id, date, CASE WHEN prev = 0 THEN 0 ELSE value / prev - 1 END AS r FROM mp WHERE prev IS NOT NULL)"""


@query("wn11_capture_report", f"{LONG}, {MRET} SELECT 'sentiment_index' AS main, 'attention_entropy' AS benchmark, round(avg(a.r) FILTER (b.r > 0), 6) AS up_capture, round(avg(a.r) FILTER (b.r < 0), 6) AS down_capture, count(*) AS n FROM mr a JOIN mr b ON a.date = b.date WHERE a.series_id = 'sentiment_index' AND b.series_id = 'attention_entropy'")
def capture_report(spark, sf_dir):
    return ts.capture_report(ts.returns(long(spark, sf_dir)), "sentiment_index", "attention_entropy")


@query("wn11_risk_of_metrics", f"""{LONG}, {MRET}, g AS (SELECT series_id, count(*) AS n, stddev_pop(r) * sqrt(252) AS vol FROM mr GROUP BY series_id) SELECT series_id, n, round(vol, 6) AS volatility FROM g""")
def risk_of_metrics(spark, sf_dir):
    """WN11's risk report over the five daily series; wn05_risk_report has all its columns on longer ones."""
    return ts.risk(long(spark, sf_dir)).select("series_id", "n", "volatility")


@query("wn18_next_day_report", f"""{LONG}, {FORECAST} SELECT series_id, round(ma + slope, 6) AS predicted, round(ma + slope - 1.96 * greatest(sd, .05), 6) AS lower, round(ma + slope + 1.96 * greatest(sd, .05), 6) AS upper, round(greatest(.2, least(.9, n / 20)), 6) AS confidence, CASE WHEN abs(slope) < .1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend, 'MA+trend' AS method, n FROM g WHERE series_id <> 'event_count'""")
def next_day_report(spark, sf_dir):
    """WN18: four metrics one day ahead, on ascending time."""
    return ts.naive_forecast(long(spark, sf_dir).filter("series_id <> 'event_count'"))


@query("wn40_predict_metric", f"{LONG}, {FORECAST} SELECT series_id, round(ma + slope * 7, 6) AS predicted, n FROM g WHERE series_id = 'sentiment_index'")
def predict_metric(spark, sf_dir):
    return ts.naive_forecast(long(spark, sf_dir).filter("series_id = 'sentiment_index'"), horizon=7).select("series_id", "predicted", "n")


PERIODS = """pl AS (SELECT *, lag(value, 5) OVER w AS l5, lag(value, 7) OVER w AS l7, lag(value, 14) OVER w AS l14, lag(value, 30) OVER w AS l30 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY date)),
pc AS (SELECT series_id, count(*) AS n, corr(l5, value) AS c5, corr(l7, value) AS c7, corr(l14, value) AS c14, corr(l30, value) AS c30 FROM pl GROUP BY series_id),
pb AS (SELECT series_id, n, list_sort([{'c': -round(coalesce(abs(c5), 0), 9), 'i': 0, 'p': 5}, {'c': -round(coalesce(abs(c7), 0), 9), 'i': 1, 'p': 7}, {'c': -round(coalesce(abs(c14), 0), 9), 'i': 2, 'p': 14}, {'c': -round(coalesce(abs(c30), 0), 9), 'i': 3, 'p': 30}])[1] AS b FROM pc)"""


@query("wn21_periods", f"{PERIODS} SELECT series_id, CASE WHEN n < 30 OR b.c = 0 THEN 7 ELSE b.p END AS period FROM pb")
def periods(spark, sf_dir):
    return ts.detect_periods(v.order_series(spark, sf_dir))


@query("wn23_enhanced_report", None)
def enhanced_report(spark, sf_dir):
    from ..operators import kernels

    s = v.order_series(spark, sf_dir)
    return kernels.enhanced_report(s, ts.detect_periods(s))


@query("wn32_scenarios", f"{LONG}, c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {x}e0, {m}e0, {h})" for n, a, b, c, m, h in ts.SCENARIOS for s, x in (("sentiment_index", a), ("policy_stance_score", b), ("industry_count", c))) + """) t(scenario, series_id, shock, mult, horizon)),
d AS (SELECT series_id, date, value, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS d FROM long), g AS (SELECT series_id, avg(d) AS drift, greatest(coalesce(stddev_pop(d), 0), .01) AS vol, max_by(value, date) AS value FROM d GROUP BY series_id)
SELECT scenario, series_id, horizon, round(value + shock, 6) AS start, round(drift, 6) AS drift, round(vol * mult, 6) AS volatility FROM c JOIN g USING (series_id)""")
def scenarios(spark, sf_dir):
    return ts.scenarios(long(spark, sf_dir))


@query("wn37_keyword_changes", """a AS (SELECT DISTINCT date, keyword FROM keyword_daily), b AS (SELECT DISTINCT CAST(date + 1 AS DATE) AS date, keyword FROM keyword_daily), c AS (SELECT *, 'new' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'vanished' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)),
r AS (SELECT *, row_number() OVER (PARTITION BY date, change ORDER BY keyword) AS r FROM c) SELECT date, change, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM r WHERE r <= 20 GROUP BY ALL""")
def keyword_changes(spark, sf_dir):
    return ts.keyword_changes(v.keyword_daily(spark, sf_dir).filter("keyword is not null"))


@query("wn39_best_worst", ORACLES["wn25_backtest"].split("SELECT series_id, CAST(horizon")[0].removeprefix(f"WITH {v.SQL.strip()}, ") + """, k AS (SELECT series_id, horizon, round(avg(CASE WHEN sign(predicted - last) = sign(value - last) THEN 1e0 ELSE 0e0 END), 9) AS d FROM h GROUP BY ALL)
SELECT series_id, CAST(first(horizon ORDER BY d DESC, horizon) AS INT) AS best, CAST(first(horizon ORDER BY d, horizon) AS INT) AS worst FROM k GROUP BY series_id""")
def best_worst(spark, sf_dir):
    return ts.best_worst(ts.backtest(v.order_series(spark, sf_dir)))


@query("wn28_equal_weight", """r0 AS (SELECT *, lag(hit_count) OVER (PARTITION BY industry ORDER BY date) AS prev FROM industry_daily),
r AS (SELECT industry AS series_id, date, CASE stance WHEN 'bullish' THEN .02 WHEN 'bearish' THEN -.02 ELSE 0 END + .001 * coalesce((hit_count - prev) / greatest(prev, 1), 0) AS r FROM r0), eq AS (SELECT date, avg(r) AS r FROM r GROUP BY date), al AS (SELECT series_id, date, r FROM r UNION ALL SELECT 'equal_weight', date, r FROM eq),
lv AS (SELECT series_id, date, r, sum(ln(1 + r)) OVER (PARTITION BY series_id ORDER BY date) AS l FROM al), tv AS (SELECT *, greatest(0, max(l) OVER (PARTITION BY series_id ORDER BY date)) AS top FROM lv)
SELECT series_id, round(least(0, min(exp(l - top) - 1)), 6) AS max_drawdown, round((exp(sum(ln(1 + r)) * 252 / count(*)) - 1 - .025) / (stddev_pop(r) * sqrt(252)), 4) AS sharpe FROM tv GROUP BY series_id""")
def equal_weight(spark, sf_dir):
    """WN28: drawdown and Sharpe of each industry's returns and of their equal weight."""
    r = ts.industry_returns(v.industry_daily(spark, sf_dir)).withColumnRenamed("industry", "series_id")
    both = r.unionByName(r.groupBy("date").agg(F.avg("r").alias("r")).select(F.lit("equal_weight").alias("series_id"), "date", "r"))
    fall = ts.underwater(both).select("series_id", "max_drawdown")
    g = both.groupBy("series_id").agg(F.exp(F.sum(F.ln(1 + F.col("r"))) * 252 / F.count("*")).alias("g"), (F.stddev_pop("r") * 252**0.5).alias("vol"))
    return fall.join(g, "series_id").select("series_id", "max_drawdown", F.round((F.col("g") - 1 - 0.025) / F.col("vol"), 4).alias("sharpe"))
