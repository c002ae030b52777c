"""Queries of small relational operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import tables as o
from ..operators import text as t
from ..operators import views as v
from .series_queries import rounded
from .text_queries import ENTITY, article_entities

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        ORACLES[name] = f"WITH {v.SQL.strip()}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"
        return make

    return keep


@query("fn22_ag14_usage", """SELECT role AS task, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens, round(sum(CASE WHEN role = 'user' THEN length(text) * 2e0 / 1e6 WHEN role = 'assistant' THEN length(text) * 8e0 / 1e6 ELSE 0 END), 6) AS cost, round(avg(CASE WHEN length(text) > 40 THEN 1e0 ELSE 0e0 END), 6) AS success_rate FROM conversations GROUP BY role""")
def usage(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    c = c.withColumns({"cost": x.cost(F.col("role"), F.col("n"), F.lit(0), {"user": (2.0, 0.0), "assistant": (8.0, 0.0)}), "ok": F.col("n") > 40})
    return o.usage(c.withColumnRenamed("role", "task"), "task", "n", "cost", "ok")


@query("fn23_prompt_packing", """p AS (SELECT source, doc_id, left(text, 400) AS block, sum(length(left(text, 400))) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM articles) SELECT source, doc_id, block, CAST(running AS BIGINT) AS running FROM p WHERE running <= 8000""")
def prompt_packing(spark, sf_dir):
    return o.pack_prompt(v.articles(spark, sf_dir), "source", "doc_id", "text")


@query("fn25_trend_arrows", """b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM series), g AS (SELECT series_id, max(value) FILTER (back = 1) AS a, max(value) FILTER (back = 2) AS b, max(value) FILTER (back = 3) AS c FROM b GROUP BY series_id)
SELECT series_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN '→' WHEN a - b > .05 THEN '↑' WHEN a - b < -.05 THEN '↓' ELSE '→' END AS arrow FROM g""")
def trend_arrows(spark, sf_dir):
    return o.trend_arrows(v.order_series(spark, sf_dir), "series_id", "date", "value")


@query("sc01_keep_max", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def keep_max(spark, sf_dir):
    return o.keep_max(v.table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "p_retailprice")


@query("src17_last_days", "SELECT industry, date, hit_count FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY date DESC) AS r FROM industry_daily) WHERE r <= 7")
def last_days(spark, sf_dir):
    return o.last_days(v.industry_daily(spark, sf_dir), "industry", 7).select("industry", "date", "hit_count")


@query("src16_range_scan", "SELECT date, article_count, event_count FROM daily_metric WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def range_scan(spark, sf_dir):
    return v.daily_metric(spark, sf_dir).filter(F.col("date").between("2024-01-05", "2024-01-20")).select("date", "article_count", "event_count")


@query("j07_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.anti(c, v.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


#: Fixed values of the model: the nine indicators of the snapshot in order, with the thresholds of those that have one.
INDICATORS = ["CPI_YoY", "PMI_MAKE", "PPI_YoY", "GDP_YoY", "LPR_1Y", "LPR_5Y", "M2_YoY", "SHIBOR_ON", "CN10Y_YIELD"]
THRESHOLDS = {"CPI_YoY": 3.0, "PMI_MAKE": 50.0, "PPI_YoY": 0.0, "GDP_YoY": 5.0}


@query("mi01_indicator_signals", f"""n AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {i})" for i, k in enumerate(INDICATORS))}) t(code, place)), m AS (SELECT place, avg(value) AS value FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) - 2 AS place, o_totalprice / 3000e0 AS value FROM orders) GROUP BY place)
SELECT code, CAST(n.place AS INT) AS place, round(coalesce(value, 0), 4) AS value, value IS NOT NULL AS live, CASE code {' '.join(f"WHEN '{k}' THEN CASE WHEN coalesce(value, 0) > {t} THEN 'above' WHEN coalesce(value, 0) < {t} THEN 'below' ELSE 'at' END" for k, t in THRESHOLDS.items())} ELSE 'reference' END AS signal FROM n LEFT JOIN m USING (place)""")
def indicator_signals(spark, sf_dir):
    """MI1: the snapshot of nine indicators: values of those that are there, a reference row for the others."""
    live = v.table(spark, sf_dir, "orders").groupBy((F.substring("o_orderpriority", 1, 1).cast("int") - 2).alias("place")).agg(F.avg(F.col("o_totalprice") / 3000).alias("value"))
    names = spark.createDataFrame(list(enumerate(INDICATORS)), "place int, code string")
    rows = names.join(live, "place", "left").withColumns({"live": F.col("value").isNotNull(), "value": F.coalesce("value", F.lit(0.0))})
    return o.indicator_signals(rows, "code", "value", THRESHOLDS).select("code", "place", F.round("value", 4).alias("value"), "live", "signal")


@query("ag01_counts", "SELECT date, CAST(sum(freq) AS BIGINT) AS total, count(*) AS n_keywords, max(freq) AS top FROM keyword_daily GROUP BY date")
def counts(spark, sf_dir):
    return v.keyword_daily(spark, sf_dir).groupBy("date").agg(F.sum("freq").alias("total"), F.count("*").alias("n_keywords"), F.max("freq").alias("top"))


def case(col: str, edges: list, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {e} THEN '{n}'" for e, n in edges) + f" ELSE '{other}' END"


LABELS = f"""z AS (SELECT date, sentiment_index AS s, (sentiment_index - avg(sentiment_index) OVER ()) / nullif(stddev_pop(sentiment_index) OVER (), 0) AS z FROM daily_metric)
SELECT date, {case("s", x.SENTIMENT_BANDS, "very_bearish")} AS label, {case("abs(z)", x.SEVERITIES, "normal")} AS severity, CASE WHEN z >= 1.5 THEN 'spike_high' WHEN z <= -1.5 THEN 'spike_low' ELSE 'normal' END AS direction, {case("z", x.GRADES, "D")} AS grade,
 CASE WHEN -abs(z) / 10 <= -.3 OR abs(z) / 8 > .4 OR z < -.5 THEN 'extreme' WHEN -abs(z) / 10 <= -.15 OR abs(z) / 8 > .25 OR z < 0 THEN 'high' WHEN -abs(z) / 10 <= -.08 OR abs(z) / 8 > .15 THEN 'medium' ELSE 'low' END AS risk, round(greatest(0, least(1, (s - 20) / 60e0)), 6) AS position,
 repeat('█', CAST(round(least(1, abs(z) / 3) * 10) AS INT)) || repeat('░', 10 - CAST(round(least(1, abs(z) / 3) * 10) AS INT)) AS bar FROM z"""


@query("fn16_labels", LABELS)
def labels(spark, sf_dir):
    """FN16's labels over a day's sentiment and its z against all days."""
    m = v.daily_metric(spark, sf_dir)
    m = m.crossJoin(F.broadcast(m.agg(F.avg("sentiment_index").alias("m"), F.stddev_pop("sentiment_index").alias("sd"))))  # one row on the right
    z = F.col("z")
    return m.withColumn("z", (F.col("sentiment_index") - F.col("m")) / F.nullif("sd", F.lit(0.0))).select(
        "date", x.sentiment_label(F.col("sentiment_index")).alias("label"), x.severity(z).alias("severity"), x.spike(z).alias("direction"), x.grade(z).alias("grade"), x.risk_label(z, -F.abs(z) / 10, F.abs(z) / 8).alias("risk"),
        x.minmax(F.col("sentiment_index"), 20.0, 80.0).alias("position"), x.confidence_bar(F.least(F.lit(1.0), F.abs(z) / 3)).alias("bar"),
    )


@query("gr03_nodes", f"{ENTITY} SELECT value AS id, type, count(*) AS freq, round(log2(count(*) + 1) * 30, 6) AS size FROM ent0 GROUP BY ALL HAVING count(*) >= 5")
def nodes(spark, sf_dir):
    return o.nodes(article_entities(spark, sf_dir), 5)


@query("rp01_bars", "m AS (SELECT industry, sum(hit_count) AS h FROM industry_daily GROUP BY industry) SELECT industry, repeat('█', CAST(floor(h * 20.0 / max(h) OVER ()) AS INT)) AS bar FROM m")
def bars(spark, sf_dir):
    m = v.industry_daily(spark, sf_dir).groupBy("industry").agg(F.sum("hit_count").alias("h"))
    return m.crossJoin(F.broadcast(m.agg(F.max("h").alias("top")))).select("industry", x.bar(F.col("h"), F.col("top")).alias("bar"))  # one row on the right
