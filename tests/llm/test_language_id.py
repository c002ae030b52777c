import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id as lid
from tidemark.llm.toxicity import in_fold

NAMES = [lid.BEGIN, lid.BEGIN + "a", "a", "b", "ab", "ba", "bab", "c"]


def brute(word, p):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        piece = word[:k]
        if piece in NAMES:
            total += p[NAMES.index(piece)] * brute(word[k:], p)
        elif k == 1:
            total += lid.UNKNOWN * brute(word[1:], p)
    return total


def test_forward_sums_every_segmentation():
    v = lid.Pieces(NAMES)
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((len(NAMES), 2)) / 8, [[0, 0], [lid.UNKNOWN] * 2]])
    words = [lid.BEGIN + w for w in ("ab", "babab", "zab", "a", "cabba", "q", "")]
    got = v.scores(words, p)
    for w, g in zip(words, got):
        assert np.allclose(g, [math.log(brute(w, p[:, c])) for c in range(2)])


def test_expected_counts_cover_each_letter():
    v = lid.Pieces(NAMES)
    words = [lid.BEGIN + w for w in ("abab", "cab", "b")]
    p = np.r_[np.full(len(NAMES), 1 / len(NAMES)), 0, lid.UNKNOWN]
    n = v.expected(words, np.array([2.0, 1.0, 5.0]), p)
    letters = sum(n[i] * len(x) for i, x in enumerate(NAMES))
    assert abs(letters - (2 * 5 + 4 + 5 * 2)) < 1e-9


def test_long_words_are_segmented_whole(monkeypatch):
    v = lid.Pieces(NAMES)
    p = np.r_[np.full(len(NAMES), 1 / len(NAMES)), 0, lid.UNKNOWN]
    words, n = [lid.BEGIN + w for w in ("abab", "cabba", "zzb", "bab")], np.array([2.0, 1.0, 5.0, 1.0])
    plain = v.scores(words, p[:, None]), v.expected(words, n, p)
    monkeypatch.setattr(lid, "PLAIN", 0)
    assert np.allclose(v.scores(words, p[:, None]), plain[0]) and np.allclose(v.expected(words, n, p), plain[1])
    long = lid.BEGIN + "ab" * 5000
    one = v.scores([long], p[:, None])[0, 0]
    assert np.isfinite(one) and one < v.scores([lid.BEGIN + "ab" * 4990], p[:, None])[0, 0]


def test_rounds_raise_the_likelihood():
    v, words, n = lid.Pieces(NAMES), [lid.BEGIN + w for w in ("abab", "cab", "bab", "ab")], np.array([4.0, 1.0, 9.0, 6.0])
    p, last = np.r_[np.full(len(NAMES), 1 / len(NAMES)), 0, lid.UNKNOWN], -np.inf
    for _ in range(4):
        like = (v.scores(words, p[:, None])[:, 0] * n).sum()
        assert like > last
        last, c = like, v.expected(words, n, p)
        p[:-2] = c / c.sum()


def test_letters():
    assert lid.words_of("a½b ²① x_y 3 Ünï") == ["a", "b", "x", "y", "ünï"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lid.fit(docs.filter(in_fold(F.col("doc_id")) != 0), lid.public_vocabulary())
    held = docs.filter(in_fold(F.col("doc_id")) == 0).filter("length(text) > 30")
    got = lid.predict(held.withColumn("score", F.lit("old")), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ! ½² ①"), (4, "x" * 3000), (5, "the"), (5, "the"), (None, "the")], "doc_id long, text string")
    rows = lid.predict(odd, model).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert got[1] == got[2] == got[3] == "und" and got[4] in model["languages"] and len(rows) == 7
    assert got[5] == got[None] and lid.predict(odd.limit(0), model).count() == 0
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lid.predict(empty, lid.fit(empty, lid.public_vocabulary())).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lid.predict(none, lid.fit(none, lid.public_vocabulary())).collect()] == ["und"]
