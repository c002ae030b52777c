"""SNK6: the payload of a day's dashboard, eight charts and the rows of other reports, as one JSON object for each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINT = "array<struct<label:string,value:double,note:string>>"
CHARTS = ("keywords", "sentiment", "policy", "attention", "top_share", "industries", "keyword_trend", "entities")


def _point(label: Column, value: Column, note: Column | None = None) -> Column:
    return F.struct(label.cast("string").alias("label"), F.round(value.cast("double"), 6).alias("value"), (F.lit(None) if note is None else note).cast("string").alias("note"))


def _top(rows: DataFrame, order: list, most: int, point: Column, name: str) -> DataFrame:
    """The first `most` rows of each date as a chart."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("date").orderBy(*order))).filter(F.col("r") <= most)
    return ranked.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", point.alias("p")))), lambda x: x["p"]).alias(name))


def payload(daily: DataFrame, keywords: DataFrame, industries: DataFrame, entities: DataFrame, reports: dict[str, DataFrame], days: int = 14) -> DataFrame:
    """(date, payload) for each day of `daily`.

    Charts are lists of (label, value, note): the 15 most frequent keywords (date, keyword, freq), sentiment, policy (note: articles),
    attention and the share of the first ten over the day and the `days` before, the 12 largest industries (date, industry, hit_count,
    stance), the five first keywords' days (note: keyword), the 15 most frequent entities (date, type, value, freq). `reports` are
    tables with a date, whose rows of the day come as a list in the order of their columns. Charts without a row are empty.
    """
    back = W.partitionBy(F.lit(1)).orderBy(F.unix_date("date")).rangeBetween(-days, 0)  # a row for each day
    own = lambda c, note=None: F.collect_list(_point(F.col("date"), F.col(c), note)).over(back)
    lines = daily.select("date", F.struct(*[c for c in daily.columns if c != "date"]).alias("today"), own("sentiment_index").alias("sentiment"), own("policy_stance_score", F.col("article_count")).alias("policy"), own("attention_entropy").alias("attention"), own("attention_top_share").alias("top_share"))
    known = keywords.filter("keyword is not null")
    order = [F.desc("freq"), F.col("keyword")]
    ranked = known.withColumn("r", F.row_number().over(W.partitionBy("date").orderBy(*order)))
    past = F.collect_list(_point(F.col("date"), F.col("freq"), F.col("keyword"))).over(W.partitionBy("keyword").orderBy(F.unix_date("date")).rangeBetween(-days, 0))
    trend = ranked.withColumn("past", past).filter("r <= 5").groupBy("date").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "past"))), lambda x: x["past"])).alias("keyword_trend"))
    parts = [
        _top(known, order, 15, _point(F.col("keyword"), F.col("freq")), "keywords"), trend,
        _top(industries, [F.desc("hit_count"), F.col("industry"), F.col("stance")], 12, _point(F.col("industry"), F.col("hit_count"), F.col("stance")), "industries"),
        _top(entities, [F.desc("freq"), F.col("value"), F.col("type")], 15, _point(F.col("value"), F.col("freq"), F.col("type")), "entities"),
    ]
    out = lines
    for p in parts:
        out = out.join(p, "date", "left")
    for name, rows in reports.items():
        row = F.to_json(F.struct(*[c for c in rows.columns if c != "date"]))
        out = out.join(rows.groupBy("date").agg(F.sort_array(F.collect_list(row)).alias(f"report_{name}")), "date", "left")  # reports have a few rows a day
    charts = [F.coalesce(c, F.array().cast(POINT)).alias(c) for c in CHARTS]
    said = [F.coalesce(f"report_{n}", F.array().cast("array<string>")).alias(n) for n in reports]
    return out.select("date", F.to_json(F.struct("today", F.struct(*charts).alias("charts"), F.struct(*said).alias("reports"))).alias("payload"))


def points(payloads: DataFrame) -> DataFrame:
    """(date, chart, place, label, value, note) of all charts, read back from the JSON."""
    p = payloads.select("date", F.from_json("payload", f"charts struct<{', '.join(f'{c} {POINT}' for c in CHARTS)}>").alias("p"))
    each = p.select("date", F.explode(F.array(*[F.struct(F.lit(c).alias("chart"), F.col(f"p.charts.{c}").alias("points")) for c in CHARTS])).alias("c"))
    return each.select("date", "c.chart", F.posexplode("c.points").alias("place", "x")).select("date", "chart", "place", "x.label", "x.value", "x.note")


def report_sizes(payloads: DataFrame, names: list[str]) -> DataFrame:
    """(date, report, n): the rows of each report, read back from the JSON."""
    p = payloads.select("date", F.from_json("payload", f"reports struct<{', '.join(f'{n} array<string>' for n in names)}>").alias("p"))
    return p.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("report"), F.size(F.col(f"p.reports.{n}")).alias("n")) for n in names])).alias("x")).select("date", "x.report", "x.n")
