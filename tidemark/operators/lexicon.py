"""Phrases of a lexicon table in texts: any number of phrases, found where they stand as parts of the text, without word boundaries.

A lexicon is a table (grp, phrase, place): a phrase belongs to one group, and places order the phrases of a group. `hits` finds all
phrases of all texts in one pass. While the phrases' size, which is measured first, stays below a bound, an automaton of all of
them goes to every task, which reads each text once. A larger lexicon is matched by a join: every place of a text gives the grams
that start there, one for each anchor length (a phrase's anchor is its first few characters); grams meet the anchors of the phrases,
and what meets is compared in full. Both ways give the same rows.

Occurrences of one phrase don't overlap, counted from the left. Null texts hold nothing; null and empty phrases are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import tokens

#: Most characters of the phrases of one automaton, each phrase counted with 16 more for its node (about 100 bytes of memory each).
AUTOMATON = 20_000_000
#: Characters of an anchor.
ANCHOR = 6

_built: list = []


def _automaton(phrases):
    """The automaton of a broadcast list of phrases; a Python worker keeps the last one."""
    if not _built or _built[0] is not phrases:
        import ahocorasick

        made = ahocorasick.Automaton()
        for p in phrases.value:
            made.add_word(p, p)
        made.make_automaton()
        _built[:] = [phrases, made]
    return _built[1]


def hits(docs: DataFrame, lexicon: DataFrame, text: str = "text", most: int = AUTOMATON) -> DataFrame:
    """(doc_id, phrase, hits) of every phrase that a text holds."""
    phrases = lexicon.select("phrase").filter("phrase is not null and phrase <> ''").distinct()
    size = phrases.agg(F.sum(F.char_length("phrase") + 16)).first()[0] or 0
    rows = docs.select("doc_id", F.col(text).alias("text"))
    return _by_automaton(rows, phrases) if size <= most else _by_grams(rows, phrases)


def _by_automaton(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([r.phrase for r in phrases.collect()])  # its size is bounded by the caller
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        found = _automaton(shared) if shared.value else None
        for batch in batches:
            docs, names, counts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                free: dict = {}  # phrase: (first place after its last occurrence, occurrences)
                for end, phrase in found.iter(text) if text and found else ():
                    after, n = free.get(phrase, (0, 0))
                    if end - len(phrase) + 1 >= after:
                        free[phrase] = (end + 1, n + 1)
                docs += [doc] * len(free)
                names += free
                counts += [n for _, n in free.values()]
            yield pa.RecordBatch.from_arrays([pa.array(docs, to_arrow_type(kind)), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "phrase", "hits"])

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, phrase string, hits long")


def _by_grams(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    keyed = phrases.withColumn("anchor", F.left("phrase", F.lit(ANCHOR))).withColumn("n", F.char_length("phrase"))
    span = keyed.agg(F.max("n"), F.collect_set(F.least("n", F.lit(ANCHOR)))).first()  # a number, and ANCHOR numbers at most
    longest, widths = span[0], sorted(span[1])
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start in range(0, len(text or ""), 50_000):
                    at = [(i, text[i : i + w], text[i : i + longest]) for i in range(start, min(start + 50_000, len(text))) for w in widths if i + w <= len(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(at), to_arrow_type(kind)), pa.array([i for i, _, _ in at], pa.int64()), pa.array([g for _, g, _ in at], pa.string()), pa.array([a for _, _, a in at], pa.string())], ["doc_id", "at", "anchor", "ahead"])

    grams = docs.mapInArrow(run, f"doc_id {kind.simpleString()}, at long, anchor string, ahead string")
    met = grams.join(keyed, "anchor").filter(F.startswith("ahead", "phrase"))
    places = met.groupBy("doc_id", "phrase").agg(F.sort_array(F.collect_list("at")).alias("at"), F.first("n").alias("n"))  # places of one phrase in one text
    start = F.struct(F.lit(0).cast("long").alias("free"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate("at", start, lambda s, i: F.when(i >= s["free"], F.struct((i + F.col("n")).cast("long").alias("free"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    return places.select("doc_id", "phrase", count.alias("hits"))


def keyword_hits(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, grp, phrase, hits): for each group, the first of its phrases (by place) that a text holds, with all its occurrences."""
    found = hits(docs, lexicon).join(lexicon, "phrase")
    return found.groupBy("doc_id", "grp").agg(F.min_by(F.struct("phrase", "hits"), "place").alias("first")).select("doc_id", "grp", "first.phrase", "first.hits")


def industry_matches(docs: DataFrame, lexicon: DataFrame, titles: int = 5) -> DataFrame:
    """AG3, J1: (industry, hit_count, article_count, titles): occurrences of each text's first phrase, and the first unlike titles of the texts (doc_id, title, text)."""
    found = keyword_hits(docs, lexicon)
    counts = found.groupBy(F.col("grp").alias("industry")).agg(F.sum("hits").alias("hit_count"), F.countDistinct("doc_id").alias("article_count"))
    named = found.join(docs.select("doc_id", "title"), "doc_id").filter("title <> ''").groupBy("grp", "title").agg(F.min("doc_id").alias("doc_id"))
    rank = F.row_number().over(W.partitionBy("grp").orderBy("doc_id"))
    first = named.withColumn("rank", rank).filter(F.col("rank") <= titles).groupBy(F.col("grp").alias("industry")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))  # five titles
    return counts.join(first, "industry", "left")


def industry_words(docs: DataFrame, lexicon: DataFrame, top: int = 5) -> DataFrame:
    """AG4: (industry, word, n, rank): the most frequent words of the texts that hold a phrase of a group."""
    own = keyword_hits(docs, lexicon).select("doc_id", F.col("grp").alias("industry"))
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    counts = own.join(words, "doc_id").groupBy("industry", "word").agg(F.sum("c").alias("n"))
    rank = F.row_number().over(W.partitionBy("industry").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def entities(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """AG12 (input): one (doc_id, type, value) for each phrase that a text holds."""
    return hits(docs, lexicon).join(lexicon.select("phrase", F.col("grp").alias("type")), "phrase").select("doc_id", "type", F.col("phrase").alias("value"))


def first_rule(docs: DataFrame, lexicon: DataFrame, other: str = "other") -> DataFrame:
    """FN13, FN19: (doc_id, category): the first group, in the groups' order, any of whose phrases a text holds."""
    found = keyword_hits(docs, lexicon).groupBy("doc_id").agg(F.min("grp").alias("category"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("category", F.lit(other)).alias("category"))


def themes(docs: DataFrame, lexicon: DataFrame, top: int = 3) -> DataFrame:
    """FN9: (doc_id, score, themes): relevance by unlike phrases found, and the `top` groups with most of them, ties in the groups' order."""
    n = hits(docs, lexicon).join(lexicon, "phrase").groupBy("doc_id", "grp").agg(F.count("*").alias("c"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("c"), "grp"))
    best = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "grp")))), lambda x: x["grp"])  # three groups
    per = n.withColumn("rank", rank).groupBy("doc_id").agg(F.sum("c").alias("n"), F.array_join(best, ",").alias("themes"))
    out = docs.select("doc_id", (F.trim("text") == "").alias("blank")).join(per, "doc_id", "left")
    score = F.when(F.col("blank"), 0.0).when(F.col("n").isNull(), 0.1).otherwise(F.least(F.lit(0.95), 0.3 + 0.1 * F.col("n")))
    return out.select("doc_id", score.alias("score"), F.coalesce("themes", F.lit("")).alias("themes"))


def linked_codes(docs: DataFrame, lexicon: DataFrame, codes: DataFrame, words: int = 8, most: int = 6, fallback: str = "CPI") -> DataFrame:
    """FN24: (doc_id, codes): the codes of a table (phrase, code) for a text's first `words` phrases in their own order, each once, `most` at most."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("phrase"))
    first = hits(docs, lexicon).withColumn("pos", place).filter(F.col("pos") <= words)
    found = first.join(codes, "phrase").groupBy("doc_id", "code").agg(F.min("pos").alias("pos"))
    lists = found.groupBy("doc_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "code"))), 1, most), lambda y: y["code"]).alias("l"))  # eight codes
    return docs.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("l", ","), F.lit(fallback)).alias("codes"))
