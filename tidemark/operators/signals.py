"""Decision signals of a day: eight sub-signals, synthesis with reasons and risks, industries, attribution, council, debate, effects.

Inputs are small daily tables (a row for each day, or a few); every operator is a projection, a window over days or an aggregate by
day, so days are spread over tasks except where a window needs their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the model: weights of the sub-signals, in the order of ties.
WEIGHTS = {
    "policy_stance": 0.20, "anomaly_risk": 0.15, "forecast": 0.15, "volatility": 0.10,
    "market_correlation": 0.15, "events_net": 0.10, "topic_dispersion": 0.05, "macro_indicators": 0.10,
}
#: Fixed values of the model: scores by state.
POLICY = {"expansion": 1.0, "neutral": 0.0, "tightening": -1.0}
RISK = {"low": 0.2, "medium": -0.2, "high": -0.6, "extreme": -1.0}
CALM = {"extreme_calm": 0.3, "calm": 0.15, "neutral": 0.0, "fear": -0.3, "extreme_fear": -0.8}
MARKET = {"bullish": 0.6, "neutral": 0.0, "bearish": -0.6}
INDUSTRY = {"bullish": 0.7, "neutral": 0.0, "bearish": -0.7}
MACRO = {"money": -0.5, "growth": 0.5}


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lookup(x: Column, table: dict[str, float], other: float = 0.0) -> Column:
    """J10: value of a key in a small fixed table."""
    return F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in table.items()], F.lit(other))


def side(score: Column) -> Column:
    return F.when(score > 0, "bull").when(score < 0, "bear").otherwise("neutral")


def _row(name: str, frame: DataFrame, score: Column, direction: Column) -> DataFrame:
    place = list(WEIGHTS).index(name)
    out = frame.withColumn("score", F.round(score, 3))
    return out.select("date", F.lit(name).alias("signal"), "score", F.lit(WEIGHTS[name]).alias("weight"), F.lit(place).alias("place"), direction.alias("direction"))


def signals(policy: DataFrame, anomaly: DataFrame, forecast: DataFrame, volatility: DataFrame, market: DataFrame, events: DataFrame, topics: DataFrame, macro: DataFrame) -> DataFrame:
    """SG1: (date, signal, score, weight, place, direction), one row for each sub-signal that a day has.

    policy: direction, confidence; anomaly: overall_risk; forecast: predicted, current; volatility: level, index (which speaks where the level is unknown); market: overall;
    events: stance (a row for each event); topics: entropy; macro: category, value, previous (a row for each indicator).
    """
    s = F.col("score")
    net = events.groupBy("date").agg(((F.count_if(F.col("stance") == "bullish") - F.count_if(F.col("stance") == "bearish")) / F.count("*")).alias("net"))
    known = macro.filter("value is not null and previous is not null and previous <> 0")
    change = (F.col("value") - F.col("previous")) / F.greatest(F.abs("previous"), F.lit(1e-6)) * lookup(F.col("category"), MACRO, 0.2)
    rows = [
        _row("policy_stance", policy.filter("direction is not null"), lookup(F.col("direction"), POLICY) * F.col("confidence"), F.col("direction")),
        _row("anomaly_risk", anomaly, lookup(F.col("overall_risk"), RISK), F.when(s < 0, "bear").otherwise("bull")),
        _row("forecast", forecast, clip((F.col("predicted") - F.col("current")) / 20), side(s)),
        _row("volatility", volatility, F.when((F.col("level") == "unknown") & F.col("index").between(0, 100) & (F.col("index") > 0), clip((50 - F.col("index")) / 50, -1.0, 0.3)).otherwise(lookup(F.col("level"), CALM)), side(s)),
        _row("market_correlation", market, lookup(F.col("overall"), MARKET), F.col("overall")),
        _row("events_net", net, F.col("net"), side(s)),
        _row("topic_dispersion", topics, (F.col("entropy") - 0.5) * 0.6, side(s)),
        _row("macro_indicators", known.groupBy("date").agg(F.avg(change).alias("c")), clip(F.col("c")), side(s)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def confidence() -> Column:
    """AG19: agreement and size of |score| * weight over the rows of a group."""
    p = F.abs("score") * F.col("weight")
    agreement = F.greatest(F.lit(0.0), 1 - F.stddev_pop(p) / F.greatest(F.avg(p), F.lit(1e-6)))
    total = F.when(F.sum(p) == 0, 1.0).otherwise(F.sum(p))
    return F.round(0.6 * agreement + 0.4 * F.least(F.lit(1.0), total / 0.6), 3)


def synthesis(rows: DataFrame) -> DataFrame:
    """SG2: weighted mean score, confidence, action, up to five reasons and three risks of each date."""
    size = F.abs(F.col("score") * F.col("weight"))
    item = F.struct(F.round(-size, 9).alias("o"), "place", F.concat_ws(" ", "signal", "direction").alias("text"), "score")
    g = rows.groupBy("date").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("s"), confidence().alias("confidence"), F.array_sort(F.collect_list(item)).alias("ranked"))  # eight rows a day
    g = g.withColumn("score", F.round(clip(F.col("s")), 3))
    act = F.when(F.col("s") >= 0.3, F.when(F.col("confidence") >= 0.55, "BUY").otherwise("HOLD")).when(F.col("s") <= -0.3, F.when(F.col("confidence") >= 0.55, "SELL").otherwise("REDUCE")).otherwise("HOLD")
    texts = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "; ")
    reasons = texts(F.filter(F.slice("ranked", 1, 5), lambda x: F.abs(x["score"]) > 0.05))
    risks = texts(F.slice(F.filter("ranked", lambda x: x["score"] < -0.15), 1, 3))
    return g.select("date", "score", "confidence", act.alias("action"), reasons.alias("reasons"), risks.alias("risks"), F.size("ranked").alias("n_signals"))


def industry_signals(market: DataFrame, topics: DataFrame, top: int = 8, most: int = 5) -> DataFrame:
    """SG3: market stance and topic share of each industry, largest first; ties by name. The first speaker sets the action.

    topics: date, place, industry, dominance; the first `most` of a date speak, one after the other, each taking the mean with what
    was said before, to 3 digits (halves away from zero).
    """
    three = lambda x: F.round(x.cast("decimal(12,6)"), 3).cast("double")
    m = market.select("date", "industry", lookup(F.col("stance"), INDUSTRY).alias("m"))
    t = topics.filter(F.col("place") <= most).groupBy("date", "industry").agg(F.sort_array(F.collect_list(F.struct("place", clip((F.col("dominance") - 0.2) * 1.5).alias("t")))).alias("t"))  # five topics
    j = m.join(t, ["date", "industry"], "full_outer").withColumn("t", F.coalesce(F.transform("t", lambda x: x["t"]), F.array().cast("array<double>")))
    said = F.aggregate("t", F.col("m"), lambda a, x: F.when(a.isNull(), three(x)).otherwise(three((a + x) / 2)))
    first = F.coalesce("m", F.get("t", F.lit(0)))
    j = j.select("date", "industry", said.alias("score"), F.when(first >= 0.4, "watch").when(first > -0.4, "wait").otherwise("avoid").alias("action"))
    rank = F.row_number().over(W.partitionBy("date").orderBy(F.desc(F.abs("score")), "industry"))
    return j.withColumn("rank", rank).filter(F.col("rank") <= top)


def baselines(daily: DataFrame, days: int = 30) -> DataFrame:
    """SH1 (input): (date, signal, baseline) from means over the day and the `days` before it; the other signals have 0."""
    w = W.partitionBy(F.lit(1)).orderBy(F.unix_date("date")).rangeBetween(-days, 0)  # one row for each day
    pol, ent = F.coalesce(F.avg("policy_stance_score").over(w), F.lit(0.0)), F.coalesce(F.avg("attention_entropy").over(w), F.lit(0.5))
    own = {"policy_stance": clip(pol * 5), "volatility": clip(1 - ent), "topic_dispersion": clip((ent - 0.5) * 2), "macro_indicators": clip(pol * 5)}
    d = daily.select("date", *[v.alias(k) for k, v in own.items()])
    return d.select("date", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("baseline")) for k in own])).alias("x")).select("date", "x.*")


def attribution(rows: DataFrame, base: DataFrame) -> DataFrame:
    """SH1: weight times the score's distance from its baseline; `share` divides by the day's weights, so that shares add up to the score."""
    j = rows.join(base, ["date", "signal"], "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    c = F.col("weight") * (F.col("score") - F.col("baseline"))
    return j.select(
        "date", "signal", "baseline", c.alias("contribution"), (F.col("weight") * F.col("score") / F.sum("weight").over(W.partitionBy("date"))).alias("share"),
        F.when(c > 0.005, "push_up").when(c < -0.005, "push_down").otherwise("neutral").alias("direction"),
    )


def opinions(daily: DataFrame, events: DataFrame, rows: int = 30) -> DataFrame:
    """CN1: (date, persona, place, stance, confidence) of hawk, dove, quant and pragmatist by their rules.

    quant compares the newest third of up to `rows` days with the rest; pragmatist wants a strong event (intensity 0.6) with a
    good stance.
    """
    w = W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-(rows - 1), 0)  # one row for each day
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    strong = events.groupBy("date").agg(F.max(((F.col("intensity") >= 0.6) & (F.col("stance") == "bullish")).cast("int")).alias("strong"))
    d = daily.withColumn("l", F.collect_list("sentiment_index").over(w)).withColumn("n", F.size("l")).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 3).cast("int"))).join(strong, "date", "left")
    gap = F.when(F.col("n") >= 5, mean(F.slice("l", F.col("n") - F.col("k") + 1, F.col("k"))) - mean(F.slice("l", F.lit(1), F.col("n") - F.col("k"))))
    s, p = F.col("sentiment_index"), F.col("policy_stance_score")
    hawk, dove = (s < 50) | (p < -0.05), (s >= 55) | (p >= 0.1)
    own = [
        ("hawk", F.when(hawk, -1).otherwise(0), F.when(hawk, 0.6).otherwise(0.45)),
        ("dove", F.when(dove, 1).otherwise(0), F.when(dove, 0.6).otherwise(0.45)),
        ("quant", F.when(F.col("gap") > 2, 1).when(F.col("gap") < -2, -1).otherwise(0), F.lit(0.55)),
        ("pragmatist", F.when(F.col("strong") == 1, 1).otherwise(0), F.lit(0.5)),
    ]
    rows_ = F.array(*[F.struct(F.lit(n).alias("persona"), F.lit(i).alias("place"), st.alias("stance"), c.alias("confidence")) for i, (n, st, c) in enumerate(own)])
    return d.withColumn("gap", gap).select("date", F.explode(rows_).alias("x")).select("date", "x.*")


def verdict(mean: Column) -> Column:
    return F.when(mean > 0.2, "bullish").when(mean < -0.2, "bearish").otherwise("neutral")


def arbitrate(rows: DataFrame) -> DataFrame:
    """AG20: confidence-weighted mean stance, its verdict, and the consensus of each date."""
    g = rows.groupBy("date").agg((F.sum(F.col("stance") * F.col("confidence")) / F.sum("confidence")).alias("mean_stance"), (1 - (F.countDistinct("stance") - 1) / F.count("*")).alias("consensus"))
    return g.withColumn("verdict", verdict(F.col("mean_stance")))


def debate(rows: DataFrame) -> DataFrame:
    """CN2: two rounds (without a language model the second repeats the first) and the template judge: final, dissent, risks, chances."""
    final = arbitrate(rows)
    name = F.when(F.col("stance") > 0, "bullish").when(F.col("stance") < 0, "bearish").otherwise("neutral")
    j = rows.withColumn("name", name).join(final, "date")
    said = F.struct("place", F.concat_ws(": ", "persona", "name").alias("text"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, said))), lambda x: x["text"]), "; ")
    return j.groupBy("date", "verdict", "consensus").agg(
        text(F.col("name") != F.col("verdict")).alias("dissent"), F.count_if(F.col("name") == "bearish").alias("key_risks"), F.count_if(F.col("name") == "bullish").alias("key_opportunities"),
    ).select("date", F.lit(2).alias("rounds"), F.col("verdict").alias("final_stance"), "consensus", F.concat_ws(" ", "verdict", "verdict").alias("stance_evolution"), "dissent", "key_risks", "key_opportunities")


def causal_chains(days: DataFrame, daily: DataFrame, lags: tuple = (1, 3, 7), top: int = 6, lookback: int = 90) -> DataFrame:
    """CA1: for each date, its (category, mediator) pairs with what followed on the days of the same pair in the `lookback` days up to it.

    `days` has date, category and mediator. hits counts those days, the date itself included; lag is that of the largest mean change
    of sentiment after them, change the mean change of breadth at it. A change counts only if the day it ends on isn't after the
    date, so nothing later than a date enters its chains: each lag is a range window that stops that many days before the date.
    Without any change of sentiment the lag is 0 and the change 0. Chains weaker than 0.2 go, the `top` of each date stay.
    """
    m = daily.select("date", F.col("sentiment_index").alias("s"), F.col("industry_count").cast("double").alias("b"))
    later = m.select(F.col("date").alias("then"), F.col("s").alias("s1"), F.col("b").alias("b1"))
    moved = m.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn("then", F.date_add("date", F.col("lag"))).join(later, "then")
    at = lambda x, of: F.max(F.when(F.col("lag") == x, F.col(of)))
    effects = moved.groupBy("date").agg(*[at(x, "s1").alias(f"s{x}") for x in lags], *[at(x, "b1").alias(f"b{x}") for x in lags], F.first("s").alias("s"), F.first("b").alias("b"))
    d = days.select("date", "category", "mediator").distinct().join(effects, "date", "left")
    same = W.partitionBy("category", "mediator").orderBy(F.unix_date("date"))  # a row for each day
    back = {x: same.rangeBetween(-lookback, -x) for x in lags}
    d = d.withColumns({"hits": F.count("*").over(same.rangeBetween(-lookback, 0)), **{f"ds{x}": F.avg(F.col(f"s{x}") - F.col("s")).over(back[x]) for x in lags}, **{f"db{x}": F.avg(F.col(f"b{x}") - F.col("b")).over(back[x]) for x in lags}})
    best = F.array_max(F.filter(F.array(*[F.struct(F.round(F.abs(f"ds{x}"), 9).alias("size"), F.lit(-x).alias("first"), F.col(f"db{x}").alias("db")) for x in lags]), lambda e: e["size"] > 0))
    d = d.withColumn("best", best).withColumns({"lag": F.coalesce(-F.col("best.first"), F.lit(0)), "change": F.coalesce("best.db", F.lit(0.0))})
    strength = F.least(F.lit(1.0), F.col("hits") / 5 * 0.7 + F.least(F.lit(1.0), F.abs("change") / 3) * 0.3)
    d = d.withColumn("strength", F.round(strength, 3)).filter("strength >= 0.2")
    response = F.when(F.col("change") > 0.3, "rising").when(F.col("change") < -0.3, "falling").otherwise("level")
    rank = F.row_number().over(W.partitionBy("date").orderBy(F.desc("strength"), "category", "mediator"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= top).select("date", "category", "mediator", "hits", "lag", "change", "strength", response.alias("response"), "rank")


def event_study(events: DataFrame, days: int = 90, most: int = 6) -> DataFrame:
    """EV1: by (date, category) the events, their largest intensity, and the first events of the category in the `days` up to the date, `most` at most.

    `events` has date, category, intensity, seq (the order within a day) and title. A day's first events are cut out before days
    meet, so the window over days sees `most` titles a day.
    """
    place = F.row_number().over(W.partitionBy("date", "category").orderBy("seq"))
    first = F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("date", "seq", "title"))))
    n = events.withColumn("place", place).groupBy("date", "category").agg(F.count("*").alias("n_events"), F.max("intensity").alias("intensity"), first.alias("first"))
    w = W.partitionBy("category").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    n = n.withColumn("historical", F.slice(F.sort_array(F.flatten(F.collect_list("first").over(w))), 1, most)).drop("first")
    return n.withColumn("historical_count", F.size("historical")).withColumn("strong", F.col("intensity") >= 0.7)


def regime_signal(rows: DataFrame) -> DataFrame:
    """WN34: (score, weight, direction) from the chance of the calm state and the longest mean stay."""
    p = F.col("p_calm")
    score = F.when(p >= 0.7, 0.4).when(p >= 0.55, 0.15).when(p <= 0.3, -0.4).when(p <= 0.45, -0.15).otherwise(0.0)
    out = rows.withColumn("score", F.when(F.col("n_obs") < 6, 0.0).otherwise(score))
    weight = F.when(F.col("n_obs") < 6, 0.0).when(F.col("sojourn") > 5, 0.15).otherwise(0.08)
    return out.withColumn("weight", weight).withColumn("direction", F.when(F.col("score") > 0.05, "bullish").when(F.col("score") < -0.05, "bearish").otherwise("neutral"))


def sentiment(rows: DataFrame) -> DataFrame:
    """AG10: by date (mean(stance * intensity) + 1) * 50 and the deviation of stance * intensity."""
    x = F.col("stance") * F.col("intensity")
    return rows.groupBy("date").agg(F.round((F.avg(x) + 1) * 50, 2).alias("sentiment_index"), F.round(F.stddev_pop(x), 4).alias("dispersion"))


def policy_stance(rows: DataFrame, industries: int = 12) -> DataFrame:
    """AG11: stance score with its confidence beside it, breadth of industries, density of events, and the label of attention."""
    label = F.when(F.col("top_share") >= 0.7, "focused").when(F.col("top_share") >= 0.5, "half_focused").when(F.col("entropy") >= 0.85, "dispersed").otherwise("ordinary")
    return rows.select(
        "date", lookup(F.col("direction"), POLICY).alias("policy_stance_score"), F.round("confidence", 4).alias("policy_confidence"), F.round(F.col("hit_industries") / industries, 4).alias("industry_breadth"),
        F.round(F.col("events") / F.greatest(F.col("articles"), F.lit(1)), 4).alias("event_density"), label.alias("intensity_label"),
    )


def market_overall(rows: DataFrame, by: str, change: str) -> DataFrame:
    """AG13: bullish, bearish or mixed by the mean change and the share of gains of each group."""
    mean, gains = F.avg(change), F.avg((F.col(change) > 0).cast("double"))
    return rows.groupBy(by).agg(F.when((mean > 0.5) & (gains > 0.6), "bullish").when((mean < -0.5) & (gains < 0.4), "bearish").otherwise("mixed").alias("overall"))


def movers(rows: DataFrame, by: str, name: str, change: str, top: int = 5) -> DataFrame:
    """AG13: the largest gains and losses of each group, ties by name."""
    up = F.row_number().over(W.partitionBy(by).orderBy(F.desc(change), name))
    down = F.row_number().over(W.partitionBy(by).orderBy(change, name))
    return rows.withColumns({"gain_rank": up, "loss_rank": down}).filter((F.col("gain_rank") <= top) | (F.col("loss_rank") <= top))
