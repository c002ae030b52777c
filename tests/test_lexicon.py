"""Lexicons as tables against plain Python."""

import random

from tidemark.operators import lexicon as lx

LEX = "grp string, phrase string, place long"
DOC = "doc_id long, title string, text string"


def example():
    dice = random.Random(6)
    word = lambda k: "".join(dice.choice("abé ") for _ in range(k))
    phrases = list({word(dice.choice([1, 2, 3, 5, 6, 7, 12])) for _ in range(60)} | {"aa", "aaa", "央行", "🙂b", "ab" * 9})
    lexicon = [(f"g{dice.randrange(5)}", p, i) for i, p in enumerate(phrases)]
    docs = [(i, f"t{i % 7}", "".join(dice.choice(phrases) if dice.random() < 0.3 else word(3) for _ in range(dice.randrange(30)))) for i in range(80)]
    return lexicon, [*docs, (900, None, None), (901, "", ""), (902, "x", "aaaaaaa"), (903, "y", "央行央行 🙂b" * 20)]


def test_both_ways_find_the_same(spark):
    lexicon, docs = example()
    want = {(i, p): s.count(p) for i, _, s in docs if s for _, p, _ in lexicon if p in s}
    lex = spark.createDataFrame([*lexicon, ("g9", None, 0), ("g9", "", 1)], LEX)
    df = spark.createDataFrame(docs, DOC)
    for most in (lx.AUTOMATON, 0):
        rows = lx.hits(df, lex, most=most).collect()
        assert {(r.doc_id, r.phrase): r.hits for r in rows} == want and len(rows) == len(want) > 500
        assert lx.hits(df, lex.filter("false"), most=most).count() == 0 == lx.hits(df.filter("false"), lex, most=most).count()


def test_a_hundred_thousand_phrases(spark):
    dice = random.Random(1)
    phrases = sorted({f"{dice.choice('abcdef')}{dice.randrange(10**6)} {dice.randrange(100)}" for _ in range(100_500)})
    texts = [(i, "t", " ".join(dice.choice(phrases) if dice.random() < 0.5 else "filler" for _ in range(200))) for i in range(60)]
    lex = spark.createDataFrame([("g", p, i) for i, p in enumerate(phrases)], LEX)
    got = {}
    for r in lx.hits(spark.createDataFrame(texts, DOC), lex).collect():
        got.setdefault(r.doc_id, set()).add(r.phrase)
    known = set(phrases)
    for i, _, s in texts:
        there = {s[a : a + n] for a in range(len(s)) for n in range(3, 12)} & known
        assert got[i] == there and len(there) > 50


def test_first_keyword_rule_and_titles(spark):
    lexicon, docs = example()
    lex, df = spark.createDataFrame(lexicon, LEX), spark.createDataFrame(docs, DOC)
    first = {}
    for g, p, _ in sorted(lexicon, key=lambda x: x[2]):
        for i, _, s in docs:
            if s and p in s:
                first.setdefault((i, g), (p, s.count(p)))
    assert {(r.doc_id, r.grp): (r.phrase, r.hits) for r in lx.keyword_hits(df, lex).collect()} == first
    for r in lx.industry_matches(df, lex).collect():
        own = sorted(i for i, g in first if g == r.industry)
        titles = list(dict.fromkeys(t for i in own for d, t, _ in docs if d == i and t))
        assert (r.hit_count, r.article_count, r.titles) == (sum(first[i, r.industry][1] for i in own), len(own), titles[:5])
    rule = {r.doc_id: r.category for r in lx.first_rule(df, lex).collect()}
    assert rule == {i: min((g for d, g in first if d == i), default="other") for i, _, _ in docs}
