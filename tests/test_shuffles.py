"""What the session's shuffles write, against the size of the texts."""

import random

from pyspark.sql import functions as F

from tidemark.operators import html as h
from tidemark.plans import retrieval_queries as q


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_of_hits_stay_where_they_are(spark, tmp_path):
    """Words are few and texts long: only their postings are shuffled."""
    rng = random.Random(3)
    noise = lambda: "".join(rng.choice("!#$%&*+-/:;<=>?@^|~.,") for _ in range(20_000))
    texts = [f"word{i} common {noise()}" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source", "1L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word7 word8"), (2, "word9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        got = {(r.query_id, r.source) for r in q.citations(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, "lexical:7"), (1, "lexical:8"), (2, "lexical:9")}
    assert shuffled(spark) - before < 0.2 * sum(map(len, texts))


def test_pages_are_shuffled_before_they_become_tokens(spark):
    """Each token of a page has its page's number and place and its text; they aren't shuffled."""
    rng = random.Random(5)
    pages = [(i, "".join(f"<p>{rng.randrange(10**6)}</p>" for _ in range(3000))) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(4)
    rows = h.tokens(df).groupBy("row").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in rows) == [9000] * 40
    plan = h.tokens(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
