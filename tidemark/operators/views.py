"""The model's tables as views over the driver's tables: daily metrics, keywords, industries, articles, series."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE = ("purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session for checkpoints; only a local session without one gets a temporary folder."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("date"), "ts", "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("keyword"))


def keyword_daily(spark, sf_dir) -> DataFrame:
    """(date, keyword, freq)."""
    return events(spark, sf_dir).groupBy("date", "keyword").agg(F.count("*").alias("freq"))


def industry_daily(spark, sf_dir) -> DataFrame:
    """(date, industry, hit_count, stance)."""
    stance = F.when(F.col("event_type").isin(*POSITIVE), "bullish").when(F.col("event_type") == "error", "bearish").otherwise("neutral")
    return events(spark, sf_dir).groupBy("date", F.col("event_type").alias("industry"), stance.alias("stance")).agg(F.count("*").alias("hit_count"))


def entropy(freq: DataFrame, by: str = "date", value: str = "freq") -> DataFrame:
    """AG8, AG9: normalised entropy of shares, and the share of the ten largest."""
    from pyspark.sql import Window as W

    total = F.sum(value).over(W.partitionBy(by))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), "keyword"))
    shares = freq.withColumn("p", F.col(value) / total).withColumn("rank", rank)
    return shares.groupBy(by).agg(
        F.when(F.count("*") > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(F.count("*"))).otherwise(0.0).alias("attention_entropy"),
        F.sum(F.when(F.col("rank") <= 10, F.col("p")).otherwise(0.0)).alias("attention_top_share"),
    )


def daily_metric(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    good = F.col("event_type").isin(*POSITIVE)
    base = e.groupBy("date").agg(
        F.count("*").alias("article_count"),
        F.countDistinct("keyword").alias("unique_keywords"),
        (100 * F.avg(good.cast("double"))).alias("sentiment_index"),
        F.avg(F.when(good, 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)).alias("policy_stance_score"),
        F.countDistinct(F.col("user_id") % 12).alias("industry_count"),
        F.count_if(F.col("event_type") == "error").alias("event_count"),
    )
    return base.join(entropy(keyword_daily(spark, sf_dir).filter("keyword is not null")), "date")


def order_series(spark, sf_dir) -> DataFrame:
    """(series_id, date, value): average order price by priority and day; many series, long histories."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("value"))


def articles(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def lexicon(spark, sf_dir) -> DataFrame:
    """(grp, phrase, place): a lexicon in eleven groups, from the neighbouring words of `benchmark`, whose passages occur in documents.

    A phrase belongs to the group of the first text that has it.
    """
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("l")).filter(F.size("l") > 1)
    two = F.transform(F.slice("l", F.lit(1), F.size("l") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("l", i + 1)))
    p = b.select("item_id", F.posexplode(two).alias("i", "phrase")).groupBy("phrase").agg(F.min(F.struct("item_id", "i")).alias("m"))
    return p.select(F.format_string("group %02d", F.col("m.item_id") % 11).alias("grp"), "phrase", (F.col("m.item_id") * 1_000_000 + F.col("m.i")).alias("place"))


#: The same views as DuckDB CTEs, for the oracle.
SQL = """
e AS (SELECT CAST(ts AS DATE) AS date, ts, event_id, user_id, event_type, value, json_extract_string(props, '$.k') AS keyword FROM events),
keyword_daily AS (SELECT date, keyword, count(*) AS freq FROM e GROUP BY ALL),
industry_daily AS (SELECT date, event_type AS industry, CASE WHEN event_type IN ('purchase','signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS stance, count(*) AS hit_count FROM e GROUP BY ALL),
kp AS (SELECT date, freq * 1e0 / sum(freq) OVER (PARTITION BY date) AS p, row_number() OVER (PARTITION BY date ORDER BY freq DESC, keyword) AS rank FROM keyword_daily WHERE keyword IS NOT NULL),
ent AS (SELECT date, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS attention_entropy, sum(CASE WHEN rank <= 10 THEN p ELSE 0 END) AS attention_top_share FROM kp GROUP BY date),
dm0 AS (SELECT date, count(*) AS article_count, count(DISTINCT keyword) AS unique_keywords, 100 * avg(CASE WHEN event_type IN ('purchase','signup') THEN 1e0 ELSE 0e0 END) AS sentiment_index,
  avg(CASE WHEN event_type IN ('purchase','signup') THEN 1e0 WHEN event_type = 'error' THEN -1e0 ELSE 0e0 END) AS policy_stance_score,
  count(DISTINCT user_id % 12) AS industry_count, count(*) FILTER (event_type = 'error') AS event_count FROM e GROUP BY date),
daily_metric AS (SELECT * FROM dm0 JOIN ent USING (date)),
series AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
articles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, coalesce(text, '') AS text, source, lang FROM documents),
lw AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda z: z <> '') AS l FROM benchmark),
lp AS (SELECT item_id, i, l[i] || ' ' || l[i + 1] AS phrase FROM lw, unnest(range(1, len(l))) AS t(i)),
lexicon AS (SELECT printf('group %02d', m // 1000000 % 11) AS grp, phrase, m AS place FROM (SELECT phrase, min(item_id * 1000000 + i - 1) AS m FROM lp GROUP BY phrase)),
found AS (SELECT doc_id, grp, phrase, place, (length(text) - length(replace(text, phrase, ''))) // length(phrase) AS hits FROM articles JOIN lexicon ON contains(text, phrase)),
kw AS (SELECT doc_id, grp, arg_min(phrase, place) AS phrase, arg_min(hits, place) AS hits FROM found GROUP BY ALL)
"""
