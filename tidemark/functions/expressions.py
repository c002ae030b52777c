"""Column expressions for texts, labels and scores; each takes and returns columns, so Catalyst sees all of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def minmax(x: Column, low: float, high: float) -> Column:
    """FN17: position of x between low and high, clamped to [0, 1]."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def truthy(x: Column, default: float) -> Column:
    """Null and zero both give the default."""
    return F.coalesce(F.nullif(x, F.lit(0)), F.lit(default))


def count_of(text: Column, part: str) -> Column:
    """FN4: non-overlapping occurrences of a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def title_key(title: Column) -> Column:
    """FN3: md5 of the trimmed, lower-case title without anything but letters and digits."""
    return F.md5(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}]", ""))


def text_key(text: Column) -> Column:
    """FN28."""
    return F.substring(F.sha2(text, 256), 1, 16)


def tokens(text: Column, stopwords: list[str] = (), least: int = 2, need_cjk: bool = False) -> Column:
    """FN1, FN2: lower-case tokens between non-word characters, without stopwords and short ones."""
    out = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= least)
    if stopwords:
        out = F.filter(out, lambda t: ~t.isin(*stopwords))
    return F.filter(out, lambda t: t.rlike(r"\p{IsHan}")) if need_cjk else out


def spam(text: Column, phrases: list[str], least: int = 2) -> Column:
    """FN5: empty, or at least `least` occurrences of the phrases together."""
    return F.coalesce(F.length(text) == 0, F.lit(True)) | (sum((count_of(text, p) for p in phrases), F.lit(0)) >= least)


def relevance(text: Column, words: list[str], full: int = 8) -> Column:
    """FN6: distinct lexicon words in the text as a share of `full`, 1 at most."""
    return F.least(F.lit(1.0), sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) / F.lit(float(full)))


def quality(title: Column, text: Column, words: list[str], phrases: list[str]) -> Column:
    """FN7: 0 for a short title, .2 for a short text, .1 for spam, else half relevance and half length."""
    rich = 0.5 * relevance(text, words) + 0.5 * F.least(F.lit(1.0), F.length(text) / 600)
    return F.when(F.length(title) < 6, 0.0).when(F.length(text) < 60, 0.2).when(spam(text, phrases), 0.1).otherwise(rich)


def intensity(text: Column, action: dict[str, float], subject: dict[str, float], bonus: Column) -> Column:
    """FN14: half the strongest action, two fifths of the strongest subject (.5 where none), a bonus; within [.1, 1]."""

    def best(scores):
        return F.coalesce(F.greatest(*[F.when(F.contains(text, F.lit(k)), F.lit(float(v))) for k, v in scores.items()]), F.lit(0.5))

    return clamp(0.5 * best(action) + 0.4 * best(subject) + bonus, 0.1, 1.0)


def bands(x: Column, edges: list[tuple[float, str]], other: str) -> Column:
    """Name of the first edge that x reaches, edges from high to low."""
    out = F.lit(other)
    for low, name in reversed(edges):
        out = F.when(x >= low, name).otherwise(out)
    return out


#: Fixed values of the model: bands of labels.
SENTIMENT_BANDS = [(75, "very_bullish"), (60, "bullish"), (45, "mild_bullish"), (40, "neutral"), (25, "mild_bearish"), (10, "bearish")]
GRADES = [(1.0, "A+"), (0.5, "A"), (0.2, "B+"), (-0.2, "B"), (-0.5, "C+"), (-1.0, "C")]
SEVERITIES = [(3.0, "critical"), (2.0, "warning"), (1.5, "notice")]


def sentiment_label(x: Column) -> Column:
    """FN16: seven bands of the sentiment index."""
    return bands(x, SENTIMENT_BANDS, "very_bearish")


def grade(score: Column) -> Column:
    """FN16: seven ranks of a factor score."""
    return bands(score, GRADES, "D")


def severity(z: Column) -> Column:
    """FN16: severity of an anomaly by |z|."""
    return bands(F.abs(z), SEVERITIES, "normal")


def spike(z: Column) -> Column:
    """FN16: direction of an anomaly."""
    return F.when(z >= 1.5, "spike_high").when(z <= -1.5, "spike_low").otherwise("normal")


def risk_label(sharpe: Column, drawdown: Column, volatility: Column) -> Column:
    """FN16: level of risk by Sharpe ratio, drawdown (negative) and volatility."""
    return F.when((drawdown <= -0.3) | (volatility > 0.4) | (sharpe < -0.5), "extreme").when((drawdown <= -0.15) | (volatility > 0.25) | (sharpe < 0), "high").when((drawdown <= -0.08) | (volatility > 0.15), "medium").otherwise("low")


def confidence_bar(x: Column) -> Column:
    """RP1: ten cells, filled by a share."""
    n = F.least(F.lit(10), F.greatest(F.lit(0), F.round(F.coalesce(x, F.lit(0.0)) * 10).cast("int")))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), 10 - n))


def trend_label(slope: Column, scale: float) -> Column:
    """FN16: rising or falling when |slope| / scale reaches .1."""
    s = slope / max(scale, 1e-3)
    return F.when(F.abs(s) < 0.1, "stable").when(s > 0, "rising").otherwise("falling")


def previous_business_day(d: Column) -> Column:
    """FN18: one day back, over the weekend."""
    return F.date_sub(d, F.when(F.dayofweek(d) == 2, 3).when(F.dayofweek(d) == 1, 2).otherwise(1))


#: Fixed values of the model: elements that are noise, and elements that are noise by their class.
NOISE_TAGS = ("script", "style", "iframe", "noscript", "svg", "form", "button", "input", "select", "textarea")
CLASS_TAGS = ("div", "section", "aside", "footer", "header", "nav")
NOISE_CLASS = "share|comment|recommend|ad|advert|banner|nav|footer|header|sidebar|popup|modal"


def clean_html(html: Column, most: int | None = None) -> Column:
    """FN10: noise elements, elements of noise classes, tags and runs of white space go. With `most`, a long rest is cut and marked."""
    out = F.coalesce(html, F.lit(""))
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    for tag in CLASS_TAGS:
        out = F.regexp_replace(out, rf"""(?is)<{tag}[^>]*class=["'][^"']*(?:{NOISE_CLASS})[^"']*["'][^>]*>.*?</{tag}>""", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"[ \t\n\r\f\v]+", " "))
    return out if most is None else F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most)), F.lit("..."))).otherwise(out)


def json_object(text: Column) -> Column:
    """FN21: the object inside a model's answer: reasoning dropped, then a fenced block or the outermost braces."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(braces), F.lit(""))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """FN22: price by the first provider whose name the model contains, per million tokens."""
    out = F.lit(0.0)
    for name, (a, b) in reversed(list(prices.items())):
        out = F.when(F.contains(F.lower(model), F.lit(name)), (tokens_in * a + tokens_out * b) / 1e6).otherwise(out)
    return out


def bar(x: Column, top: Column, cells: int = 20) -> Column:
    """RP1: a bar of cells relative to the largest value."""
    return F.repeat(F.lit("█"), F.when(top > 0, F.floor(x / top * cells)).otherwise(0).cast("int"))
