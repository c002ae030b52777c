"""Queries of composed analytics, graph and kernels; those without SQL are checked in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decision as d
from ..operators import kernels as k
from ..operators import text as t
from ..operators import views as v
from .series_queries import long, rounded
from .text_queries import ENTITY, article_entities

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {v.SQL.strip()}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"
        return make

    return keep


@query("j02_ca01_lagged_effect", """c AS (SELECT DISTINCT date, event_type AS category FROM e), l AS (SELECT category, date, lag FROM c, (SELECT unnest([1, 3, 7]) AS lag)),
g AS (SELECT category, lag, avg(a.sentiment_index - b.sentiment_index) AS effect, count(*) AS n FROM l JOIN daily_metric b ON b.date = l.date JOIN daily_metric a ON a.date = l.date + lag GROUP BY ALL)
SELECT category, CAST(lag AS INT) AS lag, round(effect, 6) AS effect, n, row_number() OVER (PARTITION BY category ORDER BY round(abs(effect), 9) DESC, lag) = 1 AS best FROM g""")
def lagged_effect(spark, sf_dir):
    e = v.events(spark, sf_dir).select("date", F.col("event_type").alias("category"))
    return d.lagged_effect(e, v.daily_metric(spark, sf_dir).select("date", F.col("sentiment_index").alias("value")))


@query("ag13_market_summary", "SELECT p_brand AS brand, round(avg(p_retailprice - 1400), 6) AS mean_change, arg_max(p_name, (p_retailprice, p_name)) AS best, arg_min(p_name, (p_retailprice, p_name)) AS worst, round(avg(CASE WHEN p_retailprice > 1400 THEN 1e0 ELSE 0e0 END), 6) AS breadth FROM part GROUP BY p_brand")
def market_summary(spark, sf_dir):
    p = v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_name", (F.col("p_retailprice") - 1400).alias("change"))
    return d.market_summary(p, "brand", "p_name", "change")


@query("ag18_industry_weights", "t AS (SELECT industry, sum(hit_count) AS h FROM industry_daily GROUP BY industry ORDER BY h DESC, industry LIMIT 20) SELECT industry, CAST(h AS BIGINT) AS hits, round(h / sum(h) OVER (), 6) AS weight FROM t")
def industry_weights(spark, sf_dir):
    top = v.industry_daily(spark, sf_dir).groupBy("industry").agg(F.sum("hit_count").alias("hits")).orderBy(F.desc("hits"), "industry").limit(20)
    return top.crossJoin(F.broadcast(top.agg(F.sum("hits").alias("all")))).select("industry", "hits", (F.col("hits") / F.col("all")).alias("weight"))  # one row on the right


EDGES = f"{ENTITY}, ed AS (SELECT a.value AS src, b.value AS dst, count(*) AS weight FROM ent0 a JOIN ent0 b ON a.doc_id = b.doc_id AND a.value < b.value GROUP BY ALL HAVING count(*) >= 2), gr AS (SELECT DISTINCT value AS node, type AS grp FROM ent0)"


@query("gr06_modularity", f"""{EDGES}, g AS (SELECT a.grp AS gs, b.grp AS gd FROM ed JOIN gr a ON a.node = src JOIN gr b ON b.node = dst), m AS (SELECT count(*) AS m FROM g),
dg AS (SELECT grp, count(*) AS degree FROM (SELECT unnest([gs, gd]) AS grp FROM g) GROUP BY grp), i AS (SELECT gs AS grp, count(*) AS inside FROM g WHERE gs = gd GROUP BY gs)
SELECT round(sum(coalesce(inside, 0) / m - (degree / (2 * m)) * (degree / (2 * m))), 6) AS modularity FROM dg LEFT JOIN i USING (grp), m""")
def modularity(spark, sf_dir):
    e = article_entities(spark, sf_dir)
    return d.modularity(t.relations(e), e.select(F.col("value").alias("node"), F.col("type").alias("group")).distinct())


@query("gr01_pagerank")
def pagerank(spark, sf_dir):
    return d.pagerank(t.relations(article_entities(spark, sf_dir)))


ALERTS = """SELECT date, 'sentiment' AS kind, 'critical' AS level FROM daily_metric WHERE sentiment_index < 38 UNION ALL SELECT date, 'sentiment', 'warning' FROM daily_metric WHERE sentiment_index >= 38 AND sentiment_index < 41
 UNION ALL SELECT date, 'policy', 'warning' FROM daily_metric WHERE policy_stance_score < .2
 UNION ALL SELECT date, 'volatility', 'warning' FROM daily_metric WHERE attention_entropy < .97 AND industry_count > 0"""


@query("st01_alerts", ALERTS)
def alerts(spark, sf_dir):
    from ..streaming.alerts import alert_rows

    return alert_rows(v.daily_metric(spark, sf_dir), critical=38, warning=41, policy=0.2, entropy=0.97)


@query("st07_event_windows", "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming.alerts import stream_windows

    return stream_windows(spark, f"{sf_dir}/events.parquet").withColumn("total", F.round("total", 4))


@query("st07_sliding", """w AS (SELECT unnest([time_bucket(INTERVAL 8 HOUR, ts), time_bucket(INTERVAL 8 HOUR, ts) - INTERVAL 8 HOUR, time_bucket(INTERVAL 8 HOUR, ts) - INTERVAL 16 HOUR]) AS start, event_type, value FROM events)
SELECT CAST(start AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    """ST7: a day's window every eight hours, by a stream that runs to its end."""
    from ..streaming import windows as w

    made = w.replay(spark, f"{sf_dir}/events.parquet", lambda e: w.sliding(e, "1 day", "8 hours", ["event_type"]), "1 hour")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st07_session", """o AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    """ST7: a user's sessions, which six hours without an event end, by a stream that runs to its end."""
    from ..streaming import windows as w

    made = w.replay(spark, f"{sf_dir}/events.parquet", lambda e: w.sessions(e, "6 hours", ["user_id"]), "1 hour")
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query("st03_routed_alerts", """a AS (SELECT event_id, event_type AS type FROM events WHERE event_type IN ('error', 'purchase', 'signup')), s AS (SELECT n_name AS subscriber, CASE n_nationkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'purchase' WHEN 2 THEN 'signup' END AS topic FROM nation)
SELECT subscriber, type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM a JOIN s ON topic IS NULL OR topic = type GROUP BY ALL""")
def routed_alerts(spark, sf_dir):
    """ST3: alerts of a stream delivered to those who subscribe to their type or to all."""
    import uuid

    from ..streaming import keyed as ke
    from ..streaming import windows as w

    subs = v.table(spark, sf_dir, "nation").selectExpr("n_name AS subscriber", "CASE n_nationkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'purchase' WHEN 2 THEN 'signup' END AS topic")
    alerts = w.read(spark, f"{sf_dir}/events.parquet").selectExpr("event_id", "event_type AS type").filter("type IN ('error', 'purchase', 'signup')")
    base = f"{v.checkpoint_dir(spark).rstrip('/')}/routed-{uuid.uuid4().hex}"
    ke.deliver(alerts, subs, f"{base}/out", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return ke.delivered(spark, f"{base}/out").groupBy("subscriber", "type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("wn20_holt_winters")
def holt_winters(spark, sf_dir):
    return k.holt_winters(v.order_series(spark, sf_dir))


@query("wn33_regimes")
def regimes(spark, sf_dir):
    return k.regimes(long(spark, sf_dir))
