"""Operator 3, toxicity: class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the characters of expressions (runs of letters and digits, runs of punctuation), one of toxic
and one of ordinary documents, give each expression two log-likelihoods. A passage is PASSAGE expressions in a row; its toxic and
ordinary log-likelihoods are compared normalised by its length in characters, and the document's comparison is that of its most
toxic passage, so that a few expressions count in a long document as they do in a short one. One logistic function of that single
number, fitted on labelled documents which the models haven't seen, turns it into a score. Orders above SHARED are counted for
each class; the orders up to SHARED, on which rare expressions fall back, are counts shared by both classes, taken from the whole
texts of all documents (they need no labels).

Bounds: the class models are fitted on at most `rows_per_class` labelled documents of each class, those of smallest hash (a
quarter of them serves for the logistic function); the shared counts cover every document and stay on the executors. What comes to
the driver of them are the n-grams of up to SHARED symbols, SYMBOLS ** 2 at most at any size (a hundred thousand in texts of four
languages). Those of less than `prune` of their order's count could be left out, their mass then stays in the weight of falling
back; by default none is. Code points from DIRECT on share the rest of the alphabet: unlike characters of other scripts may be one
symbol (3,069 of them, so a character of 10,000 shares its symbol with two or three others). Scoring needs no shuffle: the model
goes with the task.

The logistic function is fitted with a prior (log-odds of the labels; SLOPE), whose weight is that of PRIOR_ROWS rows: however few
rows are left for it, it is fitted the same way.

Defined results: null text = empty text, which scores what a text without signs of either class does; labels whose id or value
is null are not used, a document with several labels counts as toxic if one says so, rows that repeat an id each teach and are
each scored; without labels every score is 0, with labels of one class only every score is that class; held_out is null for a
null id. Extra columns are ignored; a score of exactly 0.5 is predicted 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, stash, table, tenant, texts, with_arrow

ORDER, SHARED = 5, 2
#: Bits of a symbol: code points below DIRECT are symbols of their own, the others share the rest of the alphabet.
BITS, DIRECT = 12, 0x400
SYMBOLS = 1 << BITS
START, END = 1, 2
PASSAGE = 5
PRUNE = 0.0
SLOPE, PRIOR_ROWS = 5.0, 4.0
#: Expressions whose values a Python worker keeps, and the longest of them.
CACHE, CACHED_LETTERS = 120_000, 64
_WORD = re.compile(r"[^\W_]+|[^\w\s]+")


def words_of(text: str) -> list[str]:
    """Expressions of a text, lower-cased."""
    return _WORD.findall(text.lower())


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of start mark, characters and end mark of all words in a row; for each, its place in its word; the words' first places."""
    data = np.frombuffer("".join(["\x01" + w + "\x02" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(length) - length
    data = np.where(data < DIRECT, data + 3, DIRECT + 3 + data % (SYMBOLS - DIRECT - 3))
    data[first] = START
    data[first + length - 1] = END
    place = np.arange(len(data)) - np.repeat(first, length)
    return data, place, first


def grams(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols up to each place as one integer, -1 where the word has fewer."""
    code = np.zeros(len(data), np.int64)
    for j in range(k - 1, -1, -1):
        part = np.zeros(len(data), np.int64)
        part[j:] = data[: len(data) - j] if j else data
        code = code << BITS | part
    return np.where(place >= k - 1, code, -1)


def gram_counts(words: list[str], counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the n-grams that end each prefix: `order` symbols, fewer at the start of a word; with their counts."""
    out = {}
    data, place, _ = symbols(words)
    weight = np.repeat(counts, np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for k in range(2, order + 1):
        at = place == k - 1 if k < order else place >= k - 1
        code, back = np.unique(grams(data, place, k)[at], return_inverse=True)
        out[k] = (code, np.bincount(back, weights=weight[at], minlength=len(code)))
    return out


def levels(top: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> list[dict]:
    """Kneser-Ney tables of orders 1 to `order`: counts at the top, numbers of distinct left neighbours below."""
    out = []
    code, count = top.get(order, (np.zeros(0, np.int64), np.zeros(0)))
    for k in range(order, 0, -1):
        total = count.sum()
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context, back = np.unique(code >> BITS, return_inverse=True)
        whole = np.bincount(back, weights=count, minlength=len(context))
        kinds = np.bincount(back, minlength=len(context))
        out.append({"code": code, "share": np.maximum(count - discount, 0) / whole[back] if total else count, "context": context, "rest": discount * kinds / np.maximum(whole, 1e-9)})
        low = code & ((1 << BITS * (k - 1)) - 1)
        extra, n = top.get(k - 1, (np.zeros(0, np.int64), np.zeros(0)))
        code, back = np.unique(np.concatenate([low, extra]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([np.ones(len(low)), n]), minlength=len(code))
    return out[::-1]


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in a sorted table, its length where absent."""
    if not len(table):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, len(table))


class Model:
    """Both class models over the shared lower orders; `ratios` gives the difference of log-likelihoods of words.

    The table of an order has the n-grams of that length and the contexts of the next order, so that where an n-gram was found
    is also where the next symbol's context is: one look-up for each order and symbol.
    """

    def __init__(self, toxic: dict, ordinary: dict, shared: list[dict], weights=(0.0, SLOPE)):
        a, b = levels(toxic, ORDER), levels(ordinary, ORDER)
        pairs = [(x, x) for x in shared] + list(zip(a[SHARED:], b[SHARED:]))
        self.tables = []
        self.first = np.array([x["rest"][0] if len(x["rest"]) else 1.0 for x in pairs[0]], np.float32)
        for k, own in enumerate(pairs):
            above = pairs[k + 1] if k + 1 < len(pairs) else ()
            code = np.unique(np.concatenate([x["code"] for x in own] + [x["context"] for x in above]))
            share, rest = np.zeros((len(code) + 1, 2), np.float32), np.ones((len(code) + 1, 2), np.float32)  # the last row: not found
            for i, x in enumerate(own):
                share[_find(code, x["code"]), i] = x["share"]
            for i, x in enumerate(above):
                rest[_find(code, x["context"]), i] = x["rest"]
            self.tables.append((code, share, rest))
        self.weights = np.array(weights, float)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.value, self.length = np.zeros(0), np.zeros(0)

    def ratios(self, words: list[str]) -> np.ndarray:
        data, place, first = symbols(words)
        p = np.full((len(data), 2), 1.0 / SYMBOLS)
        g, rest = np.zeros(len(data), np.int64), self.first[None, :]
        for k, (code, share, after) in enumerate(self.tables):
            if k:
                g = np.concatenate([[0], g[:-1]]) << BITS
            g = g | data
            live = place >= k
            at = np.where(live, _find(code, g), len(code))
            q = share[at] + rest * p
            p = np.where((live & (place > 0))[:, None], q, p)
            rest = after[np.concatenate([[len(code)], at[:-1]])]
        value = np.where(place > 0, np.log(p[:, 0]) - np.log(p[:, 1]), 0.0)
        return np.add.reduceat(value, first)

    def look(self, words: set[str]) -> dict[str, float]:
        """Values of words beyond the cached length; the others are added to the cache, where these words stay when it is full."""
        if len(self.row) > CACHE:
            kept = [w for w in words if w in self.row]
            at = np.fromiter(map(self.row.__getitem__, kept), np.int64, len(kept))
            self.row, self.value, self.length = dict(zip(kept, range(len(kept)))), self.value[at], self.length[at]
        new = sorted((w for w in words if w not in self.row), key=len)
        long = {w: float(self.ratios([w])[0]) for w in new if len(w) > CACHED_LETTERS}
        new = new[: len(new) - len(long)]
        values = [self.value] + [self.ratios(new[i : i + 10_000]) for i in range(0, len(new), 10_000)]
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        self.value = np.concatenate(values)
        self.length = np.concatenate([self.length, np.fromiter(map(len, new), np.float64, len(new))])
        return long

    def comparisons(self, rows: list[list[str]]) -> np.ndarray:
        """For each document, the length-normalised difference of log-likelihoods of its most toxic passage; 0 without words."""
        every: set[str] = set()
        every.update(*rows)
        long = self.look(every)
        out = np.zeros(len(rows))
        for i, words in enumerate(rows):
            if not words:
                continue
            if long and not long.keys().isdisjoint(words):
                value = np.array([long[w] if w in long else self.value[self.row[w]] for w in words])
                size = np.fromiter(map(len, words), float, len(words))
            else:
                at = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
                value, size = self.value[at], self.length[at]
            n = min(PASSAGE, len(words))
            value, size = np.cumsum(value), np.cumsum(size)
            value[n:], size[n:] = value[n:] - value[:-n], size[n:] - size[:-n]
            out[i] = (value[n - 1 :] / size[n - 1 :]).max()
        return out

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * self.comparisons(rows)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))

    def bare(self) -> tuple:
        return self.tables, self.first, self.weights


def _restore(state: tuple) -> Model:
    m = Model.__new__(Model)
    m.tables, m.first, m.weights = state
    m.clear()
    return m


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: tuple[float, float]) -> np.ndarray:
    """Constant and slope by Newton steps on the likelihood of the rows and a prior that weighs as much as PRIOR_ROWS of them.

    A step is halved until it lowers the loss, which is convex: few rows of steep evidence would throw whole steps past each other.
    The slope is at least a tenth of the prior's: where a handful of rows says the contrary, the constant alone is fitted.
    """
    scale = np.array([1.0, max(prior[1], 1e-9)])
    a = np.column_stack([np.ones(len(x)), x * scale[1]])
    middle = np.array(prior) / scale

    def loss(w):
        z = a @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + PRIOR_ROWS / 8 * ((w - middle) ** 2).sum()

    def descend(w, free):
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (weight * (p - y)) + PRIOR_ROWS / 4 * (w - middle)
            h = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + PRIOR_ROWS / 4 * np.eye(2)
            step = np.zeros(2)
            step[:free] = np.linalg.solve(h[:free, :free], g[:free])
            now = loss(w)
            while loss(w - step) > now and np.abs(step).max() > 1e-9:
                step /= 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return w

    w = descend(middle, 2)
    return (w if w[1] >= 0.1 else descend(np.array([w[0], 0.1]), 1)) * scale


def in_fold(id_col) -> F.Column:
    """crc32(id as text) mod 5."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def counted(docs: DataFrame, order: int, text_col: str, by: str | None = None) -> DataFrame:
    """(y, k, code, n): counts of n-grams of the texts, for each value of the integer column `by` if one is named."""

    def run(batches):
        tenant("toxicity", _at_work.clear)
        total: dict[int, Counter] = {}

        def flush():
            for y, bag in total.items():
                for k, (code, n) in (gram_counts(list(bag), np.fromiter(bag.values(), float, len(bag)), order) if bag else {}).items():
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(code), pa.int32()), pa.array([k] * len(code), pa.int32()), pa.array(code), pa.array(n)], ["y", "k", "code", "n"])
            total.clear()

        for batch in batches:
            for part in pieces(batch, text_col):
                for y, text in zip(part.column(0).to_pylist(), texts(part, text_col)):
                    total.setdefault(y, Counter()).update(words_of(text))
                if sum(map(len, total.values())) > CACHE:
                    yield from flush()
        yield from flush()

    rows = docs.select((F.col(by) if by else F.lit(0)).cast("int").alias("__by"), text_col)
    return rows.mapInArrow(run, "y int, k int, code long, n double").groupBy("y", "k", "code").agg(F.sum("n").alias("n"))


def shared_levels(docs: DataFrame, text_col: str = "text", prune: float = PRUNE) -> list[dict]:
    """Kneser-Ney tables of orders 1 to SHARED over all documents; n-grams of less than `prune` of their order's count are left out."""
    top = stash(counted(docs, SHARED + 1, text_col), "grams")
    above, out = top.filter(F.col("k") == SHARED + 1).select("code"), []
    for k in range(SHARED, 0, -1):
        left = above.select(F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("code"), F.lit(1.0).alias("n"))
        count = stash(left.unionByName(top.filter(F.col("k") == k).select("code", "n")).groupBy("code").agg(F.sum("n").alias("n")), "grams")
        whole = count.agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
        discount = whole.one / (whole.one + 2 * whole.two) if whole.one and whole.two else 0.5
        context = F.shiftright("code", BITS)
        of = count.groupBy(context.alias("c")).agg(F.sum("n").alias("of"))
        kept = count.filter(F.col("n") >= prune * (whole.n or 0)).join(of, context == F.col("c"))
        rows = kept.select("code", (F.greatest(F.lit(0.0), F.col("n") - discount) / F.col("of")).alias("share")).toPandas()  # SYMBOLS ** 2 rows at most
        order = np.argsort(rows["code"].to_numpy(np.int64))
        code, share = rows["code"].to_numpy(np.int64)[order], rows["share"].to_numpy(float)[order]
        names, back = np.unique(code >> BITS, return_inverse=True)
        out.append({"code": code, "share": share, "context": names, "rest": 1 - np.bincount(back, weights=share, minlength=len(names))})
        above = count.select("code")
    return out[::-1]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model | float:
    """The model, or a constant score where the labels have one class at most."""
    own = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y is not null")
    own = own.groupBy("__id").agg(F.max("__y").alias("__y")).filter(in_fold(F.col("__id")) != 0)
    totals = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return 1.0 if totals.get(1) else 0.0
    order = F.xxhash64("__id", F.lit(3))
    picked = own.filter("__y = 1").orderBy(order, "__id").limit(rows_per_class).unionByName(own.filter("__y = 0").orderBy(order, "__id").limit(rows_per_class))
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")  # 2 * rows_per_class rows at most
    sample = sample.groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    sample = stash(sample.withColumn("late", F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(4)) == 0), "labelled")
    grams = counted(sample.filter("not late"), ORDER, "__text", "__y").toPandas()  # n-grams of a bounded sample

    def tops(y):
        return {int(k): (g["code"].to_numpy()[o], g["n"].to_numpy()[o]) for k, g in grams[grams["y"] == y].groupby("k") for o in [np.argsort(g["code"].to_numpy())]}

    model = Model(tops(1), tops(0), shared_levels(docs, text_col))
    state = model.bare()

    def measure(batches):
        m = _restore(state)
        for batch in batches:
            for part in pieces(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.comparisons([words_of(x) for x in texts(part, "__text")]))], ["y", "x"])

    seen = sample.filter("late").select("__y", "__text").mapInArrow(measure, "y int, x double").toPandas()  # a number for each row of a bounded sample
    y = seen["y"].to_numpy(float)
    share = totals[1] / (totals[0] + totals[1])
    ones, zeros = max(y.sum(), 1), max((1 - y).sum(), 1)
    weight = len(y) * np.where(y == 1, share / ones, (1 - share) / zeros)
    model.weights = logistic(seen["x"].to_numpy(float), y, weight, (math.log(share / (1 - share)), SLOPE))
    return model


def score(docs: DataFrame, model: Model | float, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with score (0 to 1) and predicted."""
    new = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    if isinstance(model, float):
        return (docs if keep is None else docs.select(*keep)).withColumns({"score": F.lit(model), "predicted": F.lit(int(model >= 0.5))})
    state = docs.sparkSession.sparkContext.broadcast(model.bare())  # n-grams of a bounded sample, and those of up to SHARED symbols

    def make(part: pa.RecordBatch) -> dict:
        s = _worker_model(state).scores([words_of(x) for x in texts(part, text_col)])
        return {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

    return with_arrow(docs, new, make, keep, text_col)


_at_work: dict = {}


def _worker_model(state) -> Model:
    """The model with its word cache, kept while a Python worker serves tasks of the same broadcast."""
    tenant("toxicity", _at_work.clear)
    value = state.value
    if _at_work.get("of") is not value:
        _at_work.update({"of": value, "model": _restore(value)})
    return _at_work["model"]


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (in_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
