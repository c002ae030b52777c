"""Queries of decision signals, each with DuckDB SQL written from the surveyed formulas.

Stand-ins for the model's inputs are views over the driver's events: a good event (purchase, signup) is bullish, an error bearish.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dashboard as db
from ..operators import kernels as k
from ..operators import signals as g
from ..operators import timeseries as ts
from ..operators import views as v
from ..sources.scratch import written
from .series_queries import LONG, long, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {v.SQL.strip()}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"
        return make

    return keep


# --- inputs -----------------------------------------------------------------------------------------------------


def stance(col: str = "event_type"):
    return F.when(F.col(col).isin("purchase", "signup"), "bullish").when(F.col(col) == "error", "bearish").otherwise("neutral")


def event_rows(spark, sf_dir):
    """(date, category, stance, intensity, keyword) of each event; intensity by FN14's rule from type and size."""
    action = F.when(F.col("event_type") == "purchase", 0.9).when(F.col("event_type") == "error", 0.8).when(F.col("event_type") == "signup", 0.6).otherwise(0.5)
    subject = F.when(F.col("value") > 150, 0.9).when(F.col("value") > 80, 0.7).otherwise(0.5)
    e = v.events(spark, sf_dir)
    return e.select("date", F.col("event_type").alias("category"), stance().alias("stance"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), 0.5 * action + 0.4 * subject)), 3).alias("intensity"), "keyword", "value", "event_id")


EV = """ev AS (SELECT date, event_type AS category, CASE WHEN event_type IN ('purchase','signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS stance, keyword, value,
 round(least(1, greatest(.1, .5 * CASE event_type WHEN 'purchase' THEN .9 WHEN 'error' THEN .8 WHEN 'signup' THEN .6 ELSE .5 END + .4 * CASE WHEN value > 150 THEN .9 WHEN value > 80 THEN .7 ELSE .5 END)), 3) AS intensity FROM e)"""


def policy_daily(spark, sf_dir, daily=None):
    """(date, direction, confidence) and what AG11 needs."""
    p = F.col("policy_stance_score")
    daily = daily if daily is not None else v.daily_metric(spark, sf_dir)
    return daily.select("date", F.when(p > 0.22, "expansion").when(p < 0.18, "tightening").otherwise("neutral").alias("direction"), F.least(F.lit(1.0), 0.5 + F.abs(p)).alias("confidence"),
        F.col("industry_count").alias("hit_industries"), F.col("event_count").alias("events"), F.col("article_count").alias("articles"), F.col("attention_top_share").alias("top_share"), F.col("attention_entropy").alias("entropy"))


POLICY = """pol AS (SELECT date, CASE WHEN policy_stance_score > .22 THEN 'expansion' WHEN policy_stance_score < .18 THEN 'tightening' ELSE 'neutral' END AS direction, least(1, .5 + abs(policy_stance_score)) AS confidence FROM daily_metric)"""


def anomaly_daily(spark, sf_dir, daily=None):
    """(date, overall_risk) of days with anomalies: the worst severity."""
    a = ts.anomalies(ts.to_long(daily if daily is not None else v.daily_metric(spark, sf_dir)))
    worst = F.max(F.when(F.abs("z") >= 3, 3).when(F.abs("z") >= 2, 2).otherwise(1))
    return a.groupBy("date").agg(worst.alias("w")).select("date", F.when(F.col("w") == 3, "high").when(F.col("w") == 2, "medium").otherwise("low").alias("overall_risk"))


ANOMALY = """az AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n FROM long WINDOW w AS (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
aw AS (SELECT date, max(CASE WHEN abs((value - mean) / sd) >= 3 THEN 3 WHEN abs((value - mean) / sd) >= 2 THEN 2 ELSE 1 END) AS w FROM az WHERE n >= 3 AND sd > 1e-9 AND abs((value - mean) / sd) >= 1.5 GROUP BY date),
an AS (SELECT date, CASE w WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS overall_risk FROM aw)"""


def forecast_daily(spark, sf_dir, daily=None):
    """(date, current, predicted): mean of five days and slope of fourteen, one step ahead."""
    w, all_ = W.partitionBy(F.lit(1)).orderBy("date"), daily if daily is not None else v.daily_metric(spark, sf_dir)  # one row for each day
    d = all_.select("date", F.col("sentiment_index").alias("current")).withColumn("i", F.row_number().over(w).cast("double"))
    d = d.withColumns({"ma": F.avg("current").over(w.rowsBetween(-4, 0)), "slope": F.regr_slope("current", "i").over(w.rowsBetween(-13, 0)), "n": F.count("*").over(w.rowsBetween(-13, 0))})
    return d.filter("n >= 3").select("date", "current", (F.col("ma") + F.col("slope")).alias("predicted"))


FORECAST = """fi AS (SELECT date, sentiment_index AS cur, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS i FROM daily_metric),
fw AS (SELECT date, cur, avg(cur) OVER (ORDER BY date ROWS 4 PRECEDING) + regr_slope(cur, i) OVER w AS predicted, count(*) OVER w AS n FROM fi WINDOW w AS (ORDER BY date ROWS 13 PRECEDING)), fc AS (SELECT * FROM fw WHERE n >= 3)"""

VOL = """vs AS (SELECT *, abs(industry_count - lag(industry_count) OVER (ORDER BY date)) AS step FROM daily_metric),
vw AS (SELECT date, count(*) OVER w AS n, stddev_pop(sentiment_index) OVER w AS sd, avg(abs(policy_stance_score)) OVER w AS pm, coalesce(sum(step) OVER w, 0) - coalesce(first_value(step) OVER w, 0) AS steps,
 avg(event_count * 1e0 / greatest(industry_count, 1)) OVER w AS dens, avg(sentiment_index) OVER w AS mean, avg(sentiment_index) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM vs
 WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
vi AS (SELECT date, n, sd, pm, CASE WHEN n >= 2 THEN steps * 1e0 / (n - 1) ELSE 0 END AS iv, dens, CASE WHEN n >= 7 THEN m7 ELSE mean END AS ma7 FROM vw),
vx AS (SELECT *, CASE WHEN n >= 3 THEN round(100 * (.35e0 * least(1, greatest(0, sd / 30)) + .25e0 * least(1, greatest(0, pm / .7)) + .2e0 * least(1, greatest(0, iv / 3)) + .2e0 * least(1, greatest(0, dens / 5))), 1) ELSE 0 END AS idx FROM vi),
vol AS (SELECT *, CASE WHEN n < 3 THEN 'unknown' WHEN idx >= 80 THEN 'extreme_fear' WHEN idx >= 60 THEN 'fear' WHEN idx >= 40 THEN 'neutral' WHEN idx >= 20 THEN 'calm' ELSE 'extreme_calm' END AS level FROM vx)"""


def market_rows(spark, sf_dir):
    """(date, industry, name, change): an event's size against the usual 50, as a stock of its industry."""
    return v.events(spark, sf_dir).select("date", F.col("event_type").alias("industry"), F.col("event_id").alias("name"), ((F.col("value") - 50) / 10).alias("change"))


MARKET = "mk AS (SELECT date, event_type AS industry, event_id AS name, (value - 50) / 10 AS change FROM e), mo AS (SELECT date, CASE WHEN avg(change) > .5 AND avg(CASE WHEN change > 0 THEN 1e0 ELSE 0e0 END) > .6 THEN 'bullish' WHEN avg(change) < -.5 AND avg(CASE WHEN change > 0 THEN 1e0 ELSE 0e0 END) < .4 THEN 'bearish' ELSE 'mixed' END AS overall FROM mk GROUP BY date)"


def macro_rows(spark, sf_dir, daily=None):
    """(date, category, value, previous) of three indicators."""
    w = W.partitionBy(F.lit(1)).orderBy("date")  # one row for each day
    d = daily if daily is not None else v.daily_metric(spark, sf_dir)
    own = {"growth": "article_count", "money": "event_count", "other": "unique_keywords"}
    d = d.select("date", *[F.struct(F.lit(k).alias("category"), F.col(c).cast("double").alias("value"), F.lag(F.col(c).cast("double")).over(w).alias("previous")).alias(k) for k, c in own.items()])
    return d.select("date", F.explode(F.array(*own)).alias("x")).select("date", "x.*")


MACRO = """ml AS (SELECT date, 'growth' AS category, article_count * 1e0 AS value FROM daily_metric UNION ALL SELECT date, 'money', event_count FROM daily_metric UNION ALL SELECT date, 'other', unique_keywords FROM daily_metric),
mp AS (SELECT *, lag(value) OVER (PARTITION BY category ORDER BY date) AS previous FROM ml),
ma AS (SELECT date, greatest(-1, least(1, avg((value - previous) / greatest(abs(previous), 1e-6) * CASE category WHEN 'money' THEN -.5e0 WHEN 'growth' THEN .5e0 ELSE .2e0 END))) AS c FROM mp WHERE previous IS NOT NULL AND previous <> 0 AND value IS NOT NULL GROUP BY date)"""

SIDE = "CASE WHEN score > 0 THEN 'bull' WHEN score < 0 THEN 'bear' ELSE 'neutral' END"
SIGNALS = f"""{LONG}, {EV}, {POLICY}, {ANOMALY}, {FORECAST}, {VOL}, {MARKET}, {MACRO},
s0 AS (SELECT date, 'policy_stance' AS signal, round(CASE direction WHEN 'expansion' THEN 1 WHEN 'tightening' THEN -1 ELSE 0 END * confidence, 3) AS score, .2e0 AS weight, 0 AS place, direction FROM pol
 UNION ALL SELECT date, 'anomaly_risk', CASE overall_risk WHEN 'low' THEN .2 WHEN 'medium' THEN -.2 WHEN 'high' THEN -.6 ELSE 0 END, .15e0, 1, CASE overall_risk WHEN 'low' THEN 'bull' ELSE 'bear' END FROM an
 UNION ALL SELECT date, 'forecast', round(greatest(-1, least(1, (predicted - cur) / 20)), 3), .15e0, 2, NULL FROM fc
 UNION ALL SELECT date, 'volatility', CASE level WHEN 'extreme_calm' THEN .3 WHEN 'calm' THEN .15 WHEN 'fear' THEN -.3 WHEN 'extreme_fear' THEN -.8 ELSE 0 END, .1e0, 3, NULL FROM vol
 UNION ALL SELECT date, 'market_correlation', CASE overall WHEN 'bullish' THEN .6 WHEN 'bearish' THEN -.6 ELSE 0 END, .15e0, 4, overall FROM mo
 UNION ALL SELECT date, 'events_net', round((count(*) FILTER (stance = 'bullish') - count(*) FILTER (stance = 'bearish')) * 1e0 / count(*), 3), .1e0, 5, NULL FROM ev GROUP BY date
 UNION ALL SELECT date, 'topic_dispersion', round((attention_entropy - .5) * .6, 3), .05e0, 6, NULL FROM daily_metric UNION ALL SELECT date, 'macro_indicators', round(c, 3), .1e0, 7, NULL FROM ma),
sig AS (SELECT date, signal, score, weight, place, coalesce(direction, {SIDE}) AS direction FROM s0)"""


def signal_rows(spark, sf_dir, daily=None):
    """The sub-signals of each day; what they share, a row a day, is written once and read by each."""
    daily = written(v.daily_metric(spark, sf_dir), "daily") if daily is None else daily
    vol = ts.volatility(daily).select("date", "level", F.col("volatility_index").alias("index"))
    topics = daily.select("date", F.col("attention_entropy").alias("entropy"))
    rows = g.signals(policy_daily(spark, sf_dir, daily), anomaly_daily(spark, sf_dir, daily), forecast_daily(spark, sf_dir, daily), vol, g.market_overall(market_rows(spark, sf_dir), "date", "change"), event_rows(spark, sf_dir), topics, macro_rows(spark, sf_dir, daily))
    return written(rows, "signals")


# --- queries ----------------------------------------------------------------------------------------------------


@query("wn02_volatility_index", f"{VOL} SELECT date, round(idx, 1) AS volatility_index, level, round(coalesce(CASE WHEN n >= 3 THEN ma7 END, 0), 1) AS ma7, round(coalesce(CASE WHEN n >= 3 THEN sd END, 0), 3) AS sentiment_vol, round(coalesce(CASE WHEN n >= 3 THEN pm END, 0), 3) AS policy_vol, round(coalesce(CASE WHEN n >= 3 THEN iv END, 0), 3) AS industry_vol, round(coalesce(CASE WHEN n >= 3 THEN dens END, 0), 3) AS event_density FROM vol")
def volatility(spark, sf_dir):
    return ts.volatility(v.daily_metric(spark, sf_dir))


@query("sg01_signals", f"{SIGNALS} SELECT date, signal, round(score, 3) AS score, weight, direction FROM sig")
def signals(spark, sf_dir):
    return signal_rows(spark, sf_dir).drop("place")


BOARD = """b AS (SELECT date, sum(score * weight) / sum(weight) AS s, round(.6e0 * greatest(0, 1 - stddev_pop(abs(score) * weight) / greatest(avg(abs(score) * weight), 1e-6)) + .4e0 * least(1, CASE WHEN sum(abs(score) * weight) = 0 THEN 1 ELSE sum(abs(score) * weight) END / .6e0), 3) AS c, count(*) AS n FROM sig GROUP BY date),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(abs(score * weight), 9) DESC, place) AS r FROM sig),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r) AS k FROM r WHERE score < -.15),
t AS (SELECT date, string_agg(signal || ' ' || direction, '; ' ORDER BY r) AS reasons FROM r WHERE r <= 5 AND abs(score) > .05 GROUP BY date), q AS (SELECT date, string_agg(signal || ' ' || direction, '; ' ORDER BY k) AS risks FROM k WHERE k <= 3 GROUP BY date)"""


@query("sg02_decision_board", f"""{SIGNALS}, {BOARD} SELECT b.date, round(greatest(-1, least(1, s)), 3) AS score, c AS confidence, CASE WHEN s >= .3 THEN CASE WHEN c >= .55 THEN 'BUY' ELSE 'HOLD' END WHEN s <= -.3 THEN CASE WHEN c >= .55 THEN 'SELL' ELSE 'REDUCE' END ELSE 'HOLD' END AS action,
 coalesce(reasons, '') AS reasons, coalesce(risks, '') AS risks, CAST(n AS INT) AS n_signals FROM b LEFT JOIN t USING (date) LEFT JOIN q USING (date)""")
def decision_board(spark, sf_dir):
    return g.synthesis(signal_rows(spark, sf_dir))


@query("sg03_industry_signals", """i AS (SELECT date, industry, stance, hit_count, row_number() OVER (PARTITION BY date ORDER BY hit_count DESC, industry) AS r, hit_count * 1e0 / sum(hit_count) OVER (PARTITION BY date) AS dominance FROM industry_daily),
m AS (SELECT date, industry, CASE stance WHEN 'bullish' THEN .7 WHEN 'bearish' THEN -.7 ELSE 0 END AS m FROM i WHERE industry <> 'view'), t AS (SELECT date, industry, greatest(-1e0, least(1e0, (dominance - .2e0) * 1.5e0)) AS t FROM i WHERE r <= 5),
j AS (SELECT date, industry, CAST(round(CAST(CASE WHEN m IS NULL THEN t WHEN t IS NULL THEN m ELSE (m + t) / 2 END AS DECIMAL(12,6)), 3) AS DOUBLE) AS score, coalesce(m, t) AS f FROM m FULL JOIN t USING (date, industry))
SELECT date, industry, score, CASE WHEN f >= .4 THEN 'watch' WHEN f > -.4 THEN 'wait' ELSE 'avoid' END AS action, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(score) DESC, industry) AS rank FROM j) WHERE rank <= 8""")
def industry_signals(spark, sf_dir):
    i = v.industry_daily(spark, sf_dir)
    share = F.col("hit_count") / F.sum("hit_count").over(W.partitionBy("date"))
    topics = i.withColumns({"dominance": share, "place": F.row_number().over(W.partitionBy("date").orderBy(F.desc("hit_count"), "industry"))})
    return g.industry_signals(i.filter("industry <> 'view'"), topics)


BASE = """bw AS (SELECT date, coalesce(avg(policy_stance_score) OVER w, 0) AS p, coalesce(avg(attention_entropy) OVER w, .5) AS x FROM daily_metric WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)),
bl AS (SELECT date, 'policy_stance' AS signal, greatest(-1, least(1, p * 5)) AS baseline FROM bw UNION ALL SELECT date, 'volatility', greatest(-1, least(1, 1 - x)) FROM bw UNION ALL SELECT date, 'topic_dispersion', greatest(-1, least(1, (x - .5) * 2)) FROM bw UNION ALL SELECT date, 'macro_indicators', greatest(-1, least(1, p * 5)) FROM bw)"""


@query("sh01_attribution", f"""{SIGNALS}, {BASE}, c AS (SELECT date, signal, coalesce(baseline, 0) AS baseline, weight * (score - coalesce(baseline, 0)) AS c, weight * score / sum(weight) OVER (PARTITION BY date) AS share FROM sig LEFT JOIN bl USING (date, signal))
SELECT date, signal, round(baseline, 6) AS baseline, round(c, 6) AS contribution, round(share, 6) AS share, CASE WHEN c > .005 THEN 'push_up' WHEN c < -.005 THEN 'push_down' ELSE 'neutral' END AS direction FROM c""")
def attribution(spark, sf_dir):
    return g.attribution(signal_rows(spark, sf_dir), g.baselines(v.daily_metric(spark, sf_dir)))


OPINIONS = f"""{EV}, hs AS (SELECT date, max(CASE WHEN intensity >= .6 AND stance = 'bullish' THEN 1 ELSE 0 END) AS strong FROM ev GROUP BY date),
ol AS (SELECT *, list(sentiment_index) OVER (ORDER BY date ROWS 29 PRECEDING) AS l FROM daily_metric), ok AS (SELECT *, len(l) AS n, greatest(1, len(l) // 3) AS k FROM ol),
og AS (SELECT ok.*, strong, CASE WHEN n >= 5 THEN list_avg(l[n - k + 1:n]) - list_avg(l[1:n - k]) END AS gap FROM ok LEFT JOIN hs USING (date)),
op AS (SELECT date, 'hawk' AS persona, 0 AS place, CASE WHEN sentiment_index < 50 OR policy_stance_score < -.05 THEN -1 ELSE 0 END AS stance, CASE WHEN sentiment_index < 50 OR policy_stance_score < -.05 THEN .6e0 ELSE .45e0 END AS confidence FROM og
 UNION ALL SELECT date, 'dove', 1, CASE WHEN sentiment_index >= 55 OR policy_stance_score >= .1 THEN 1 ELSE 0 END, CASE WHEN sentiment_index >= 55 OR policy_stance_score >= .1 THEN .6e0 ELSE .45e0 END FROM og
 UNION ALL SELECT date, 'quant', 2, CASE WHEN gap > 2 THEN 1 WHEN gap < -2 THEN -1 ELSE 0 END, .55e0 FROM og UNION ALL SELECT date, 'pragmatist', 3, CASE WHEN strong = 1 THEN 1 ELSE 0 END, .5e0 FROM og)"""
VERDICT = "ar AS (SELECT date, sum(stance * confidence) / sum(confidence) AS m, 1 - (count(DISTINCT stance) - 1) * 1e0 / count(*) AS c FROM op GROUP BY date), vd AS (SELECT *, CASE WHEN m > .2 THEN 'bullish' WHEN m < -.2 THEN 'bearish' ELSE 'neutral' END AS verdict FROM ar)"


def opinion_rows(spark, sf_dir):
    return g.opinions(v.daily_metric(spark, sf_dir), event_rows(spark, sf_dir))


@query("cn01_council", f"{OPINIONS} SELECT date, persona, stance, confidence FROM op")
def council(spark, sf_dir):
    return opinion_rows(spark, sf_dir).drop("place")


@query("ag20_arbitration", f"{OPINIONS}, {VERDICT} SELECT date, round(m, 6) AS mean_stance, round(c, 6) AS consensus, verdict FROM vd")
def arbitration(spark, sf_dir):
    return g.arbitrate(opinion_rows(spark, sf_dir))


@query("cn02_debate", f"""{OPINIONS}, {VERDICT}, nm AS (SELECT op.*, verdict, c, CASE WHEN stance > 0 THEN 'bullish' WHEN stance < 0 THEN 'bearish' ELSE 'neutral' END AS name FROM op JOIN vd USING (date))
SELECT date, 2 AS rounds, verdict AS final_stance, round(c, 6) AS consensus, verdict || ' ' || verdict AS stance_evolution, coalesce(string_agg(persona || ': ' || name, '; ' ORDER BY place) FILTER (name <> verdict), '') AS dissent,
 count(*) FILTER (name = 'bearish') AS key_risks, count(*) FILTER (name = 'bullish') AS key_opportunities FROM nm GROUP BY date, verdict, c""")
def debate(spark, sf_dir):
    return g.debate(opinion_rows(spark, sf_dir))


@query("ca01_causal_chains", f"""{EV}, d AS (SELECT DISTINCT date, category, stance AS mediator FROM ev), p AS (SELECT t.date AS target, d.* FROM d t JOIN d USING (category, mediator) WHERE d.date BETWEEN t.date - 90 AND t.date), h AS (SELECT target, category, mediator, count(*) AS hits FROM p GROUP BY ALL),
g AS (SELECT target, category, mediator, lag, avg(b.sentiment_index - a.sentiment_index) AS ds, avg(b.industry_count - a.industry_count) AS db FROM p JOIN daily_metric a ON a.date = p.date, (SELECT unnest([1, 3, 7]) AS lag) l JOIN daily_metric b ON b.date = p.date + lag WHERE p.date + lag <= target GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY target, category, mediator ORDER BY round(abs(ds), 9) DESC, lag) AS r FROM g WHERE round(abs(ds), 9) > 0), j AS (SELECT target, category, mediator, hits, coalesce(lag, 0) AS lag, coalesce(db, 0) AS change FROM h LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (target, category, mediator)),
s AS (SELECT *, round(least(1, hits / 5e0 * .7e0 + least(1, abs(change) / 3) * .3e0), 3) AS strength FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY strength DESC, category, mediator) AS rank FROM s WHERE strength >= .2)
SELECT target AS date, category, mediator, hits, CAST(lag AS INT) AS lag, round(change, 6) AS change, strength, CASE WHEN change > .3 THEN 'rising' WHEN change < -.3 THEN 'falling' ELSE 'level' END AS response, CAST(rank AS INT) AS rank FROM k WHERE rank <= 6""")
def causal_chains(spark, sf_dir):
    return g.causal_chains(event_rows(spark, sf_dir).select("date", "category", F.col("stance").alias("mediator")), v.daily_metric(spark, sf_dir))


IMPACT = {"purchase": "demand rises", "signup": "reach grows", "error": "supply at risk"}


@query("ev01_event_study", f"""{EV}, n AS (SELECT date, category, count(*) AS n_events, max(intensity) AS intensity FROM ev GROUP BY ALL), o AS (SELECT date, event_type AS category, event_id, event_type || ' ' || coalesce(keyword, '-') AS title FROM e),
h AS (SELECT n.date, category, o.date AS d, event_id, title, row_number() OVER (PARTITION BY n.date, category ORDER BY o.date, event_id) AS r FROM n JOIN o USING (category) WHERE o.date BETWEEN n.date - 90 AND n.date),
l AS (SELECT date, category, count(*) AS historical_count, string_agg(d || ' ' || title, '; ' ORDER BY r) AS historical FROM h WHERE r <= 6 GROUP BY ALL)
SELECT date, category, n_events, intensity, CAST(historical_count AS INT) AS historical_count, historical, intensity >= .7 AS strong, CASE category {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in IMPACT.items())} ELSE 'no clear effect' END AS expected_impact FROM n JOIN l USING (date, category)""")
def event_study(spark, sf_dir):
    """EV1 with FN15's map from category to impact; the titles of an event are its type and keyword."""
    impact = F.coalesce(*[F.when(F.col("category") == k, F.lit(x)) for k, x in IMPACT.items()], F.lit("no clear effect"))
    rows = event_rows(spark, sf_dir).withColumn("title", F.concat_ws(" ", "category", F.coalesce("keyword", F.lit("-")))).withColumnRenamed("event_id", "seq")
    out = g.event_study(rows).withColumn("expected_impact", impact)
    return out.withColumn("historical", F.array_join(F.transform("historical", lambda h: F.concat_ws(" ", h["date"].cast("string"), h["title"])), "; "))


@query("wn34_regime_signal", None)
def regime_signal(spark, sf_dir):
    """WN34 on WN33's regimes of the daily sentiment: the calm state is the one with the lower mean."""
    rows = k.regimes(long(spark, sf_dir).filter("series_id = 'sentiment_index'")).withColumn("p_calm", 1 - F.col("p_high"))
    return g.regime_signal(rows).select("date", "p_calm", "score", "weight", "direction")


def dashboards(spark, sf_dir):
    """SNK6: each day's payload with the reports that this library makes for a day."""
    daily = written(v.daily_metric(spark, sf_dir), "daily")
    entities = v.events(spark, sf_dir).groupBy("date", F.col("event_type").alias("type"), F.concat(F.lit("user "), F.col("user_id") % 40).alias("value")).agg(F.count("*").alias("freq"))
    rows = signal_rows(spark, sf_dir, daily)
    ev = event_rows(spark, sf_dir).withColumn("title", F.concat_ws(" ", "category", F.coalesce("keyword", F.lit("-")))).withColumnRenamed("event_id", "seq")
    reports = {
        "anomaly": anomaly_daily(spark, sf_dir, daily), "forecast": forecast_daily(spark, sf_dir, daily), "market": g.market_overall(market_rows(spark, sf_dir), "date", "change"), "macro": macro_rows(spark, sf_dir, daily).filter("previous is not null"),
        "volatility": ts.volatility(daily), "events": g.event_study(ev), "causal": g.causal_chains(ev.select("date", "category", F.col("stance").alias("mediator")), daily), "signals": rows.drop("place"), "board": g.synthesis(rows),
    }
    return db.payload(daily, v.keyword_daily(spark, sf_dir), v.industry_daily(spark, sf_dir), entities, reports), list(reports)


LINES = " UNION ALL ".join(f"SELECT d.date, '{chart}', CAST(row_number() OVER (PARTITION BY d.date ORDER BY m.date) - 1 AS INT), CAST(m.date AS VARCHAR), round(m.{c} * 1e0, 6), {note} FROM daily_metric d JOIN daily_metric m ON m.date BETWEEN d.date - 14 AND d.date" for chart, c, note in (("sentiment", "sentiment_index", "NULL"), ("policy", "policy_stance_score", "CAST(m.article_count AS VARCHAR)"), ("attention", "attention_entropy", "NULL"), ("top_share", "attention_top_share", "NULL")))


@query("snk06_dashboard_payload", f"""kr AS (SELECT date, keyword, freq, row_number() OVER (PARTITION BY date ORDER BY freq DESC, keyword) AS r FROM keyword_daily WHERE keyword IS NOT NULL), ir AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY hit_count DESC, industry, stance) AS r FROM industry_daily),
en AS (SELECT date, event_type AS type, 'user ' || (user_id % 40) AS value, count(*) AS freq FROM e GROUP BY ALL), er AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY freq DESC, value, type) AS r FROM en)
SELECT date, 'keywords' AS chart, CAST(r - 1 AS INT) AS place, keyword AS label, freq * 1e0 AS value, NULL AS note FROM kr WHERE r <= 15 UNION ALL SELECT date, 'industries', CAST(r - 1 AS INT), industry, hit_count * 1e0, stance FROM ir WHERE r <= 12 UNION ALL SELECT date, 'entities', CAST(r - 1 AS INT), value, freq * 1e0, type FROM er WHERE r <= 15
UNION ALL SELECT t.date, 'keyword_trend', CAST(row_number() OVER (PARTITION BY t.date ORDER BY t.r, k.date) - 1 AS INT), CAST(k.date AS VARCHAR), k.freq * 1e0, k.keyword FROM kr t JOIN kr k ON k.keyword = t.keyword AND k.date BETWEEN t.date - 14 AND t.date WHERE t.r <= 5 UNION ALL {LINES}""")
def dashboard_charts(spark, sf_dir):
    return db.points(dashboards(spark, sf_dir)[0])


@query("snk06_dashboard_reports", f"""{SIGNALS}, r AS (SELECT date, 'anomaly' AS report, count(*) AS n FROM an GROUP BY date UNION ALL SELECT date, 'forecast', count(*) FROM fc GROUP BY date UNION ALL SELECT date, 'market', count(*) FROM mo GROUP BY date UNION ALL SELECT date, 'macro', count(*) FROM mp WHERE previous IS NOT NULL GROUP BY date
 UNION ALL SELECT date, 'volatility', count(*) FROM vol GROUP BY date UNION ALL SELECT date, 'events', count(DISTINCT category) FROM ev GROUP BY date UNION ALL SELECT date, 'causal', least(6, count(DISTINCT (category, stance))) FROM ev WHERE date >= (SELECT min(date) FROM ev) + 1 GROUP BY date UNION ALL SELECT date, 'signals', count(*) FROM sig GROUP BY date UNION ALL SELECT date, 'board', count(DISTINCT date) FROM sig GROUP BY date)
SELECT m.date, x.report, CAST(coalesce(n, 0) AS INT) AS n FROM daily_metric m CROSS JOIN (SELECT DISTINCT report FROM r) x LEFT JOIN r ON r.date = m.date AND r.report = x.report""")
def dashboard_reports(spark, sf_dir):
    return db.report_sizes(*dashboards(spark, sf_dir))


@query("ag10_sentiment", f"{EV} SELECT date, round((avg(CASE stance WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * intensity) + 1) * 50, 2) AS sentiment_index, round(stddev_pop(CASE stance WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * intensity), 4) AS dispersion FROM ev GROUP BY date")
def sentiment(spark, sf_dir):
    e = event_rows(spark, sf_dir).withColumn("stance", g.lookup(F.col("stance"), {"bullish": 1.0, "bearish": -1.0}))
    return g.sentiment(e)


@query("ag11_policy_stance", f"""{POLICY} SELECT date, CASE direction WHEN 'expansion' THEN 1e0 WHEN 'tightening' THEN -1e0 ELSE 0e0 END AS policy_stance_score, round(confidence, 4) AS policy_confidence, round(industry_count / 12e0, 4) AS industry_breadth, round(event_count * 1e0 / greatest(article_count, 1), 4) AS event_density,
 CASE WHEN attention_top_share >= .7 THEN 'focused' WHEN attention_top_share >= .5 THEN 'half_focused' WHEN attention_entropy >= .85 THEN 'dispersed' ELSE 'ordinary' END AS intensity_label FROM pol JOIN daily_metric USING (date)""")
def policy_stance(spark, sf_dir):
    return g.policy_stance(policy_daily(spark, sf_dir))


@query("ag13_market_overall", f"{MARKET} SELECT * FROM mo")
def market_overall(spark, sf_dir):
    return g.market_overall(market_rows(spark, sf_dir), "date", "change")


@query("ag13_movers", f"{MARKET}, r AS (SELECT industry, name, change, row_number() OVER (PARTITION BY industry ORDER BY change DESC, name) AS gain_rank, row_number() OVER (PARTITION BY industry ORDER BY change, name) AS loss_rank FROM mk) SELECT industry, name, round(change, 6) AS change, CAST(gain_rank AS INT) AS gain_rank, CAST(loss_rank AS INT) AS loss_rank FROM r WHERE gain_rank <= 5 OR loss_rank <= 5")
def movers(spark, sf_dir):
    return g.movers(market_rows(spark, sf_dir).drop("date"), "industry", "name", "change")


SNAP = {"sentiment_index": "sentiment", "policy_stance_score": "policy", "attention_entropy": "entropy", "industry_count": "industries", "unique_keywords": "keywords", "event_count": "events"}


@query("ag16_snapshot", "t AS (SELECT max(date) AS d FROM daily_metric) SELECT " + ", ".join(f"round(avg({c}), 3) AS {n}" for c, n in SNAP.items()) + ", CAST(sum(article_count) AS BIGINT) AS articles, count(*) AS n_days FROM daily_metric, t WHERE date BETWEEN d - 30 AND d")
def snapshot(spark, sf_dir):
    """AG16: means of six metrics over the newest day and the 30 days before it, nulls skipped."""
    m = v.daily_metric(spark, sf_dir)
    m = m.join(F.broadcast(m.agg(F.max("date").alias("d"))), F.col("date").between(F.date_sub("d", 30), F.col("d")))  # one row on the right
    return m.agg(*[F.round(F.avg(c), 3).alias(n) for c, n in SNAP.items()], F.sum("article_count").alias("articles"), F.count("*").alias("n_days"))


@query("ag17_stream_snapshot", "SELECT round(avg(coalesce(nullif(sentiment_index, 0), 50)), 6) AS sentiment, round(avg(coalesce(nullif(policy_stance_score, 0), 0)), 6) AS policy, round(avg(coalesce(nullif(attention_entropy, 0), .5)), 6) AS entropy, round(avg(coalesce(nullif(industry_count, 0), 8)), 6) AS industries, count(*) AS n_days FROM daily_metric")
def stream_snapshot(spark, sf_dir):
    """AG17: means where null and zero count as the usual value."""
    usual = {"sentiment_index": ("sentiment", 50.0), "policy_stance_score": ("policy", 0.0), "attention_entropy": ("entropy", 0.5), "industry_count": ("industries", 8.0)}
    return v.daily_metric(spark, sf_dir).agg(*[F.avg(F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(d))).alias(n) for c, (n, d) in usual.items()], F.count("*").alias("n_days"))
