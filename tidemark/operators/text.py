"""Text operators: keywords, lexicon matches, similarity, deduplication and retrieval, as joins and aggregates over tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import title_key, tokens
from .bags import cosine_join, jaccard_join
from .similar import select_in_order


def postings(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select("doc_id", F.explode(tokens(F.col(text), least=least)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def word_frequency(docs: DataFrame, top: int = 50) -> DataFrame:
    """AG2: most frequent words, ties by word."""
    words = docs.select(F.explode(tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def weigh(tf: DataFrame, n: int) -> DataFrame:
    """(doc_id, term, df, weight) of postings: tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 in each document.

    One join on terms and one window over each document's terms; other columns of the postings pass through.
    """
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").withColumn("w", F.col("tf") * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return w.withColumn("weight", F.col("w") / norm).drop("w", "tf")


def tfidf(docs: DataFrame, least: int = 2, vocabulary: int | None = None) -> DataFrame:
    """(doc_id, term, df, weight) of all documents. The postings' readers share one shuffle; `vocabulary` keeps the most frequent terms alone."""
    return weigh(frequent(postings(docs, least=least), vocabulary), docs.count())


def frequent(tf: DataFrame, vocabulary: int | None) -> DataFrame:
    """Postings of the `vocabulary` terms with most occurrences, ties by term; all of them if None.

    The counts are shuffled by term and each task sorts its own; only the heads of the sorted parts meet, and the terms found go back
    to the postings by a semi join, so exactly that many terms stay, however large the vocabulary of the texts.
    """
    if vocabulary is None:
        return tf
    most = tf.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(vocabulary)
    return tf.join(most.select("term"), "term", "left_semi")


def tfidf_keywords(docs: DataFrame, top: int = 20, vocabulary: int | None = None) -> DataFrame:
    """AG5: terms by the sum of their weights over all documents; `vocabulary` as for `tfidf` (the model has 5000)."""
    return tfidf(docs, vocabulary=vocabulary).groupBy("term").agg(F.sum("weight").alias("score")).orderBy(F.desc(F.round("score", 6)), "term").limit(top)


def fuse(a: DataFrame, b: DataFrame, alpha: float = 0.5, top: int = 20) -> DataFrame:
    """AG7: two keyword scores (term, score), each scaled by its largest, added with weights alpha and 1 - alpha."""

    def scaled(df, name):
        most = df.agg(F.max("score").alias("most"))
        return df.crossJoin(F.broadcast(most)).select("term", (F.col("score") / F.when(F.col("most") == 0, 1.0).otherwise(F.col("most"))).alias(name))  # one row on the right

    both = scaled(a, "x").join(scaled(b, "y"), "term", "full_outer")
    score = alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))
    return both.select("term", score.alias("score")).orderBy(F.desc(F.round("score", 6)), "term").limit(top)


def textrank_edges(docs: DataFrame, window: int = 3) -> DataFrame:
    """AG6 (input): (src, dst, weight) of unlike words less than `window` places apart, src < dst.

    The words of each document stand in a row. Each window of `window` words adds 1 for each ordered pair of places, so an edge
    gains 2 for every window that holds both words; two words d places apart share window - d windows (fewer at the ends).
    """
    t = docs.select("doc_id", tokens(F.col("text")).alias("t")).filter(F.size("t") >= window).select("t", F.posexplode("t").alias("i", "a"), F.size("t").alias("n"))
    rows = None
    for d in range(1, window):
        # windows start at 0 .. n - window; those that hold i and i + d start at max(0, i + d - window + 1) .. min(i, n - window)
        windows = F.least(F.col("i"), F.col("n") - window) - F.greatest(F.lit(0), F.col("i") + d - window + 1) + 1
        x = t.filter(F.col("i") + d < F.col("n")).select("a", F.element_at("t", F.col("i") + d + 1).alias("b"), (2 * windows).cast("long").alias("w"))
        rows = x if rows is None else rows.unionByName(x)
    return rows.filter("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("weight"))


def relations(found: DataFrame, least: int = 2) -> DataFrame:
    """GR2, J9: entity pairs in one article, by number of articles."""
    a, b = found.select("doc_id", F.col("value").alias("src")).distinct(), found.select("doc_id", F.col("value").alias("dst")).distinct()
    return a.join(b, "doc_id").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def classes(docs: DataFrame, key: F.Column) -> DataFrame:
    """(doc_id, rep): the smallest doc_id of the documents with the same key. Copies are one class, so they meet nobody twice."""
    k = docs.select("doc_id", key.alias("k"))
    return k.join(k.groupBy("k").agg(F.min("doc_id").alias("rep")), "k").select("doc_id", "rep")


def jaccard(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """SM1: (i, j, sim), i < j, of documents whose sets of tokens share `least` of their union; each document is a set of its own."""
    return jaccard_join(docs, least)


def cosine(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """SM2: (i, j, sim), i < j, of documents whose TF-IDF vectors have a cosine of `least` or more."""
    return cosine_join(docs, least)


def greedy(pairs: DataFrame) -> DataFrame:
    """DD2: documents of similar pairs (i < j) that go when documents are taken in order and a kept one drops later similar ones."""
    return select_in_order(pairs)


def full_dedup(docs: DataFrame, least: float = 0.85) -> DataFrame:
    """DD3: DD1 by title, then DD2 by content; documents (doc_id, title, text)."""
    one = dedup_titles(docs)
    return one.join(greedy(cosine(one.select("doc_id", "text"), least)), "doc_id", "left_anti")


def pair_similarity(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """DD4: (pair_id, sim, duplicate) of pairs of short texts (pair_id, a, b): cosine of TF-IDF over the two texts alone."""
    side = lambda c, n: pairs.select("pair_id", F.explode(tokens(F.col(c))).alias("term"), F.lit(n).alias("n"))
    tf = side("a", 1).unionByName(side("b", 2)).groupBy("pair_id", "term").agg(F.count_if(F.col("n") == 1).alias("x"), F.count_if(F.col("n") == 2).alias("y"))
    idf = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(F.ln(F.lit(1.5)) + 1)
    g = tf.withColumns({"u": F.col("x") * idf, "v": F.col("y") * idf}).groupBy("pair_id").agg(F.sum(F.col("u") * F.col("v")).alias("d"), F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("p"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("q"))
    sim = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("d") / (F.col("p") * F.col("q"))).otherwise(0.0)
    out = pairs.select("pair_id").join(g.select("pair_id", sim.alias("sim")), "pair_id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return out.withColumn("duplicate", F.round("sim", 9) >= least)


def dedup_titles(docs: DataFrame) -> DataFrame:
    """DD1: the first document of each title key."""
    rank = F.row_number().over(W.partitionBy("title_key").orderBy("doc_id"))
    return docs.withColumn("title_key", title_key(F.col("title"))).withColumn("rank", rank).filter("rank = 1").drop("rank")


def lexical_search(docs: DataFrame, queries: DataFrame, top: int = 3, least: float = 0.05, vocabulary: int | None = None) -> DataFrame:
    """RT1: top documents of each query (query_id, text) by TF-IDF cosine, fitted on corpus and queries; score at least `least`; `vocabulary` as for `tfidf`.

    Texts are read into postings once; the join on terms brings the document frequency and whether a query asks for the term, so
    that after lengths are known only asked postings go on.
    """
    tf = postings(docs.select(F.struct(F.lit(False).alias("asks"), F.col("doc_id").alias("id")).alias("doc_id"), "text").unionByName(queries.select(F.struct(F.lit(True).alias("asks"), F.col("query_id").alias("id")).alias("doc_id"), "text")))
    tf, n = frequent(tf, vocabulary), docs.count() + queries.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.max("doc_id.asks").alias("asked"))
    w = tf.join(df, "term").withColumn("w", F.col("tf") * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    w = w.select("doc_id", "term", "asked", (F.col("w") / norm).alias("weight")).filter("asked")
    q, d = w.filter("doc_id.asks").select(F.col("doc_id.id").alias("query_id"), "term", F.col("weight").alias("x")), w.filter("not doc_id.asks").select(F.col("doc_id.id").alias("doc_id"), "term", "weight")
    score = q.join(d, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("x") * F.col("weight")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id"))
    return score.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("score") >= least))


def co_occurrence(docs: DataFrame, word: str, window: int = 5, top: int = 20) -> DataFrame:
    """SM3: words within `window` places of a token that holds `word`, without those that hold it themselves, most frequent first.

    The places are an explode, not a self-join.
    """
    t = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    near = t.select("t", F.posexplode("t").alias("at", "w")).filter(F.contains("w", F.lit(word))).select(F.explode(F.slice("t", F.greatest(F.lit(1), F.col("at") + 1 - window), F.least(F.col("at"), F.lit(window)) + 1 + window)).alias("word"))
    return near.filter(~F.contains("word", F.lit(word))).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def index_quantiles(df: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """AG15: values at index min(int(n q), n - 1) of each key's sorted values.

    Counted by distinct value first, so the window sees one row for each value; more copies of a value add no rows.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(key).orderBy(value)
    c = c.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(W.partitionBy(key))})
    at = {name: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value))).alias(name) for name, q in quantiles.items()}
    return c.groupBy(key).agg(*at.values(), F.min(value).alias("low"), F.max(value).alias("high"), F.sum("c").alias("n"))


def secrets(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """SRC18: (kind, doc_id, line) of every line that a pattern finds."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    kinds = F.array_compact(F.array(*[F.when(F.col("s").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return lines.select(F.explode(kinds).alias("kind"), "doc_id", (F.col("line") + 1).alias("line"))


def hash_embedding(docs: DataFrame, size: int = 256) -> DataFrame:
    """FN27: (doc_id, bucket, weight): hashed character 3-grams (weight 1) and word bigrams (weight 1.5), scaled to length 1."""
    d = docs.select("doc_id", F.lower("text").alias("s"))
    number = F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long")
    chars = d.filter(F.length("s") >= 3).select("doc_id", F.split("s", "").alias("c"))  # a letter is one step away, however long the text
    grams = chars.select("doc_id", F.explode(F.transform(F.slice("c", F.lit(1), F.size("c") - 2), lambda x, i: F.concat(x, F.element_at("c", i + 2), F.element_at("c", i + 3)))).alias("g"))
    words = d.select("doc_id", F.filter(F.split("s", r"[ \t\n\r]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= 2)
    pairs = words.select("doc_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    raw = grams.select("doc_id", (number % size).alias("bucket"), F.lit(1.0).alias("w"))
    raw = raw.unionByName(pairs.select("doc_id", F.concat_ws(" ", "p.a", "p.b").alias("g")).select("doc_id", (number * 7 % size).alias("bucket"), F.lit(1.5).alias("w")))
    sums = raw.groupBy("doc_id", "bucket").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return sums.select("doc_id", F.col("bucket").cast("int").alias("bucket"), (F.col("w") / norm).alias("weight"))


def topic_labels(topics: DataFrame, rules: list[tuple[str, list[str]]], industries: dict[str, list[str]]) -> DataFrame:
    """TM2: topics (topic, words) with a readable label, the first rule that shares a word with them, else the topic's first word;
    and the industry with the largest overlap, the first if tied, null where none overlaps."""
    words = lambda keys: F.array(*[F.lit(k) for k in keys])
    label = F.coalesce(*[F.when(F.arrays_overlap("words", words(keys)), F.lit(name)) for name, keys in rules], F.try_element_at("words", F.lit(1)), F.lit("unnamed"))
    overlaps = F.array(*[F.struct((-F.size(F.array_intersect("words", words(keys)))).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(industries.items())])
    best = F.array_sort(overlaps)[0]
    return topics.select("topic", label.alias("label"), F.when(best["n"] < 0, best["name"]).alias("industry"))
