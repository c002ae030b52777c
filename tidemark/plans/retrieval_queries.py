"""Queries of deduplication, retrieval and graphs over the driver's texts, events and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import decision as d
from ..operators import graph as gr
from ..operators import retrieval as r
from ..operators import tables as o
from ..operators import text as t
from ..operators import views as v
from ..sources import ledger as ld
from ..sources import vectors as vs
from .decision_queries import EDGES
from .series_queries import rounded
from .text_queries import TFIDF, TOKENS, article_entities

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {v.SQL.strip()}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"
        return make

    return keep


def questions(spark, sf_dir):
    return v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- similarity and deduplication -------------------------------------------------------------------------------

SETS = f"src AS (SELECT doc_id, text FROM articles), {TOKENS}, d AS (SELECT DISTINCT doc_id, term FROM tok), h AS (SELECT doc_id, md5(string_agg(term, ' ' ORDER BY term)) AS k FROM d GROUP BY doc_id), rp AS (SELECT k, min(doc_id) AS rep FROM h GROUP BY k)"


def term_sets(spark, sf_dir):
    """(doc_id, rep): documents of equal token sets, by the smallest of them."""
    docs = v.articles(spark, sf_dir)
    terms = docs.select("doc_id", F.array_sort(F.array_distinct(x.tokens(F.col("text")))).alias("s")).filter(F.size("s") > 0)
    return t.classes(terms, F.md5(F.array_join("s", " ")))


@query("sm01_classes", f"{SETS} SELECT doc_id, rep FROM h JOIN rp USING (k)")
def set_classes(spark, sf_dir):
    return term_sets(spark, sf_dir)


@query("sm01_jaccard", f"{SETS}, q AS (SELECT d.* FROM d JOIN rp ON rep = doc_id), z AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id), c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared FROM q a JOIN q b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) SELECT i, j, round(shared / (a.n + b.n - shared), 6) AS sim FROM c JOIN z a ON i = a.doc_id JOIN z b ON j = b.doc_id WHERE shared / (a.n + b.n - shared) >= .8 - 1e-9")
def jaccard(spark, sf_dir):
    """SM1 between representatives of equal token sets; sm01_classes has the membership."""
    reps = term_sets(spark, sf_dir).filter("doc_id = rep").select("doc_id")
    return t.jaccard(v.articles(spark, sf_dir).join(reps, "doc_id", "left_semi"))


COPIES = "cp AS (SELECT text, min(doc_id) AS rep FROM articles GROUP BY text), src AS (SELECT rep AS doc_id, text FROM cp)"


def text_classes(spark, sf_dir):
    docs = v.articles(spark, sf_dir)
    return t.classes(docs, F.sha2("text", 256))


def single_texts(spark, sf_dir):
    """Articles whose text no smaller doc_id has."""
    return v.articles(spark, sf_dir).join(text_classes(spark, sf_dir).filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")


@query("sm02_classes", f"{COPIES} SELECT doc_id, rep FROM articles JOIN cp USING (text)")
def copies(spark, sf_dir):
    return text_classes(spark, sf_dir)


@query("sm02_cosine", f"{COPIES}, {TOKENS}, {TFIDF} SELECT a.doc_id AS i, b.doc_id AS j, round(sum(a.weight * b.weight), 6) AS sim FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.weight * b.weight) >= .8 - 1e-9")
def cosine(spark, sf_dir):
    """SM2 between representatives of equal texts; sm02_classes has the membership."""
    return t.cosine(single_texts(spark, sf_dir))


@query("dd02_greedy")
def greedy(spark, sf_dir):
    """DD2: documents that go when each kept one drops later ones of cosine .85 or more; copies go by class first."""
    near = t.greedy(t.cosine(single_texts(spark, sf_dir), 0.85)).withColumn("why", F.lit("near"))
    same = text_classes(spark, sf_dir).filter("doc_id <> rep").select("doc_id", F.lit("copy").alias("why"))
    return near.unionByName(same)


@query("dd03_full_dedup")
def full_dedup(spark, sf_dir):
    return t.full_dedup(v.articles(spark, sf_dir)).select("doc_id", "source")


@query("dd04_pair_duplicate", f"""p AS (SELECT a.doc_id AS pair_id, a.title || ' ' || left(a.text, 200) AS a, b.title || ' ' || left(b.text, 200) AS b FROM articles a JOIN articles b ON b.doc_id = a.doc_id + 1),
k AS (SELECT pair_id, unnest(list_filter(regexp_split_to_array(lower(a), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)) AS term, 1 AS n FROM p UNION ALL SELECT pair_id, unnest(list_filter(regexp_split_to_array(lower(b), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)), 2 FROM p),
f AS (SELECT pair_id, term, count(*) FILTER (n = 1) AS x, count(*) FILTER (n = 2) AS y FROM k GROUP BY ALL), i AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1e0 ELSE ln(1.5e0) + 1 END AS idf FROM f),
s AS (SELECT pair_id, sum(x * idf * y * idf) AS d, sqrt(sum(x * idf * x * idf)) AS p, sqrt(sum(y * idf * y * idf)) AS q FROM i GROUP BY pair_id), o AS (SELECT p.pair_id, coalesce(CASE WHEN s.p > 0 AND s.q > 0 THEN d / (s.p * s.q) ELSE 0 END, 0) AS sim FROM p LEFT JOIN s USING (pair_id))
SELECT pair_id, round(sim, 6) AS sim, round(sim, 9) >= .7 AS duplicate FROM o""")
def pair_duplicate(spark, sf_dir):
    a = v.articles(spark, sf_dir).select("doc_id", F.concat_ws(" ", "title", F.left("text", F.lit(200))).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return t.pair_similarity(a.join(b, "doc_id").withColumnRenamed("doc_id", "pair_id"))


# --- keywords ---------------------------------------------------------------------------------------------------

RANKED = f"src AS (SELECT doc_id, text FROM articles), {TOKENS}, {TFIDF}, ti AS (SELECT term, round(sum(weight), 6) AS score FROM w GROUP BY term ORDER BY score DESC, term LIMIT 20)"
PAIRS = r"""tl AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda z: length(z) >= 2) AS t FROM articles), tn AS (SELECT t, CAST(len(t) AS INT) AS n, CAST(unnest(range(0, len(t))) AS INT) AS i FROM tl WHERE len(t) >= 3),
te AS (SELECT t[i + 1] AS a, t[i + 2] AS b, 2 * (least(i, n - 3) - greatest(0, i - 1) + 1) AS w FROM tn WHERE i + 1 < n UNION ALL SELECT t[i + 1], t[i + 3], 2 * (least(i, n - 3) - greatest(0, i) + 1) FROM tn WHERE i + 2 < n),
tg AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, CAST(sum(w) AS BIGINT) AS weight FROM te WHERE a <> b GROUP BY ALL)"""


@query("ag06_textrank_edges", f"{PAIRS} SELECT src, dst, weight FROM tg")
def textrank_edges(spark, sf_dir):
    return t.textrank_edges(v.articles(spark, sf_dir))


@query("ag06_textrank")
def textrank(spark, sf_dir):
    """AG6: words by PageRank of the graph of neighbours."""
    rank = d.pagerank(t.textrank_edges(v.articles(spark, sf_dir)))
    return rank.select(F.col("node").alias("term"), F.col("rank").alias("score")).orderBy(F.desc(F.round("score", 9)), "term").limit(20)


@query("ag07_fused_keywords", f"""{RANKED}, wf AS (SELECT term, count(*) AS n FROM tok GROUP BY term), wl AS (SELECT term, n FROM wf ORDER BY n DESC, term LIMIT 50), a AS (SELECT term, score / max(score) OVER () AS x FROM ti), b AS (SELECT term, n * 1e0 / max(n) OVER () AS y FROM wl)
SELECT term, round(.5 * coalesce(x, 0) + .5 * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (term) ORDER BY score DESC, term LIMIT 20""")
def fused_keywords(spark, sf_dir):
    docs = v.articles(spark, sf_dir)
    words = t.word_frequency(docs).select(F.col("word").alias("term"), F.col("n").cast("double").alias("score"))
    return t.fuse(t.tfidf_keywords(docs).withColumn("score", F.round("score", 6)), words)


# --- retrieval --------------------------------------------------------------------------------------------------


def reports(spark, sf_dir):
    """(date, payload): theme words of a day as the model stores them: the ten most frequent words of its articles."""
    a = v.articles(spark, sf_dir).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("doc_id"), "text")
    words = t.postings(a)
    rank = F.row_number().over(t.W.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))
    top = words.withColumn("r", rank).filter("r <= 10").groupBy(F.col("doc_id").alias("date")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda y: F.struct(y["term"].alias("word"))).alias("keywords"))
    return top.select("date", F.to_json(F.struct("keywords")).alias("payload"))


REPORTS = r"""rw AS (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS date, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda z: length(z) >= 2)) AS term FROM articles), rf AS (SELECT date, term, count(*) AS tf FROM rw GROUP BY ALL),
rt AS (SELECT date, term FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY tf DESC, term) AS r FROM rf) WHERE r <= 10),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda z: length(z) >= 2)) AS term FROM benchmark), qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
ph AS (SELECT query_id, date, count(*) AS hits FROM qt JOIN rt USING (term) GROUP BY ALL), pr AS (SELECT query_id, date, round(least(1, hits * 1e0 / greatest(3, n)), 4) AS score FROM ph JOIN qn USING (query_id)),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, date DESC) AS rank FROM pr)"""


def payload_hits(spark, sf_dir):
    return r.payload_search(questions(spark, sf_dir), reports(spark, sf_dir))


@query("rt07_payload_search", f"{REPORTS} SELECT query_id, date, score, CAST(rank AS INT) AS rank FROM pk WHERE rank <= 3")
def payload_search(spark, sf_dir):
    return payload_hits(spark, sf_dir)


LEXICAL = f"src AS (SELECT 'd' || doc_id AS doc_id, text FROM articles UNION ALL SELECT 'q' || item_id, text FROM benchmark), {TOKENS}, {TFIDF}, ls AS (SELECT CAST(substr(a.doc_id, 2) AS BIGINT) AS query_id, CAST(substr(b.doc_id, 2) AS BIGINT) AS doc_id, sum(a.weight * b.weight) AS score FROM w a JOIN w b USING (term) WHERE a.doc_id LIKE 'q%' AND b.doc_id LIKE 'd%' GROUP BY ALL), lk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ls) WHERE rank <= 3 AND score >= .05)"


def all_hits(spark, sf_dir):
    docs = v.articles(spark, sf_dir)
    best = t.lexical_search(docs, questions(spark, sf_dir))  # three rows of each question go to the texts, which stay where they are
    lexical = docs.select("doc_id", "text").join(F.broadcast(best), "doc_id")
    payload = payload_hits(spark, sf_dir).join(reports(spark, sf_dir), "date")
    return r.hits(lexical, "lexical", "doc_id", "text").unionByName(r.hits(payload, "ai_report", "date", "payload"))


@query("rt09_citations", f"""{REPORTS}, {LEXICAL}, hl AS (SELECT query_id, 'lexical:' || doc_id AS source, score, md5(translate(left(a.text, 200), chr(10), ' ')) AS snippet FROM lk JOIN articles a USING (doc_id))
SELECT query_id, source, round(score, 6) AS score, snippet FROM hl""")
def citations(spark, sf_dir):
    return r.citations(all_hits(spark, sf_dir).filter("source = 'lexical'")).withColumn("snippet", F.md5("snippet"))


@query("rt08_answers", f"""{REPORTS}, {LEXICAL}, h AS (SELECT query_id, 'lexical:' || doc_id AS id, score FROM lk UNION ALL SELECT query_id, 'ai_report:' || date, score FROM pk WHERE rank <= 3), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM h)
SELECT query_id, string_agg(id, ' ' ORDER BY rank) AS citations, round(max(score), 6) AS best, count(*) AS n_hits, round(least(.7, max(score)), 6) AS confidence FROM k WHERE rank <= 5 GROUP BY query_id""")
def answers(spark, sf_dir):
    return r.answer(all_hits(spark, sf_dir))


HISTORY = r"""hx AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS date, text FROM articles), hq AS (SELECT item_id AS query_id, DATE '2024-01-20' AS target, text FROM benchmark),
src AS (SELECT 'd' || doc_id AS doc_id, text FROM hx UNION ALL SELECT 'q' || query_id, text FROM hq), tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda z: z <> '')) AS term FROM src)"""


@query("rt02_recall", f"""{HISTORY}, {TFIDF}, s AS (SELECT CAST(substr(a.doc_id, 2) AS BIGINT) AS query_id, CAST(substr(b.doc_id, 2) AS BIGINT) AS doc_id, sum(a.weight * b.weight) AS score FROM w a JOIN w b USING (term) WHERE a.doc_id LIKE 'q%' AND b.doc_id LIKE 'd%' GROUP BY ALL),
j AS (SELECT s.*, hx.date, target, left(hx.text, 300) AS t FROM s JOIN hx USING (doc_id) JOIN hq USING (query_id) WHERE score > .01 AND hx.date < target), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM j),
c AS (SELECT *, trim(regexp_replace(regexp_replace(t, '[#*`>|]+', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS c FROM k WHERE rank <= 5),
f AS (SELECT query_id, doc_id, string_agg('+' || off || 'd ' || CAST(round(sentiment_index, 1) AS VARCHAR), '; ' ORDER BY off) AS followup FROM c, (SELECT unnest([1, 3, 7]) AS off) JOIN daily_metric m ON m.date = c.date + off WHERE c.date + off <= target GROUP BY ALL)
SELECT query_id, doc_id, date, round(score, 6) AS score, CAST(rank AS INT) AS rank, CASE WHEN length(c) > 160 THEN left(c, 160) || '…' ELSE c END AS snippet, coalesce(followup, '-') AS followup FROM c LEFT JOIN f USING (query_id, doc_id)""")
def recall(spark, sf_dir):
    docs = v.articles(spark, sf_dir).select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"), "text")
    return r.recall(docs, questions(spark, sf_dir).withColumn("date", F.lit("2024-01-20").cast("date")), v.daily_metric(spark, sf_dir))


@query("rt03_vector_search", "s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5")
def vector_search(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return r.vector_top(e, e.filter("id % 100 = 0")).select("query_id", "vec_id", "score")


def fresh_index(spark, sf_dir):
    """RT3's index in a new folder: vectors of even labels build it, all others are added, those of label 3 come again, negated, and replace theirs."""
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    base = f"{v.checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index = vs.VectorIndex(spark, base)
    index.build(e.filter("label % 2 = 0"))
    index.add(e)
    index.add(e.filter("label = 3").select("id", F.transform("v", lambda c: -c).alias("v")), replace=True)
    return vs.VectorIndex(spark, base), e


@query("rt03_index_members", "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS size, round(CASE WHEN label = 3 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def index_members(spark, sf_dir):
    return fresh_index(spark, sf_dir)[0].rows().select("id", F.size("v").alias("size"), F.col("v")[0].alias("first"))


@query("rt03_index_search")
def index_search(spark, sf_dir):
    """The five best of the probed lists, of score .2 or more; tests measure recall."""
    index, e = fresh_index(spark, sf_dir)
    return index.search(e.filter("id % 100 = 0"), 5, 0.2).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query("rt05_encode_once", "SELECT run, CASE run WHEN 1 THEN n ELSE 0 END AS encoded, d AS documents FROM (SELECT count(DISTINCT text) AS n, count(*) AS d FROM articles), (SELECT unnest([1, 2]) AS run)")
def encode_once(spark, sf_dir):
    """RT5: hashed embeddings of all articles by content, in two runs; the second one finds every text encoded."""
    store = vs.EmbeddingStore(spark, f"{v.checkpoint_dir(spark).rstrip('/')}/embeddings-{uuid.uuid4().hex}")
    docs, out = v.articles(spark, sf_dir).select("doc_id", "text"), None
    for run in (1, 2):
        rows, n = store.encode(docs, t.hash_embedding)
        without = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").count()  # too short for a gram
        made = rows.agg((F.countDistinct("doc_id") + without).alias("documents")).select(F.lit(run).alias("run"), F.lit(n).cast("long").alias("encoded"), "documents")
        out = made if out is None else out.unionByName(made)
    return out


@query("snk03_daily_tables", """m AS (SELECT date FROM daily_metric), k AS (SELECT date FROM keyword_daily), i AS (SELECT date FROM industry_daily), l AS (SELECT DISTINCT date FROM m ORDER BY date DESC LIMIT 3)
SELECT date, 'metric' AS name, count(*) AS n FROM m JOIN l USING (date) GROUP BY date UNION ALL SELECT date, 'keyword', count(*) FROM k JOIN l USING (date) GROUP BY date UNION ALL SELECT date, 'industry', count(*) FROM i JOIN l USING (date) GROUP BY date""")
def daily_tables(spark, sf_dir):
    """SNK3: the tables of the newest three days, each day published at once; the last day is written twice."""
    base = f"{v.checkpoint_dir(spark).rstrip('/')}/days-{uuid.uuid4().hex}"
    all_days = {"metric": v.daily_metric(spark, sf_dir), "keyword": v.keyword_daily(spark, sf_dir), "industry": v.industry_daily(spark, sf_dir)}
    dates = [r.date for r in all_days["metric"].select("date").orderBy(F.desc("date")).limit(3).collect()]
    for d in [*dates, *dates[-1:]]:
        ld.write_day(spark, base, str(d), {name: df.filter(F.col("date") == F.lit(d)) for name, df in all_days.items()})
    out = None
    for d in dates:
        for name, df in ld.read_day(spark, base, str(d)).items():
            n = df.groupBy("date").agg(F.count("*").alias("n")).select("date", F.lit(name).alias("name"), "n")
            out = n if out is None else out.unionByName(n)
    return out


@query("rt03_add_vectors", "SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'old' ELSE 'new' END AS kind, round(CASE WHEN label % 2 = 0 THEN embedding[1]::DOUBLE ELSE 0 END, 6) AS first FROM embeddings")
def add_vectors(spark, sf_dir):
    """RT3's index: half of the vectors are there, all are added; those that were there stay."""
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("first"))
    old = e.filter("label % 2 = 0").select("id", F.lit("old").alias("kind"), "first")
    return r.add_vectors(old, e.select("id", F.lit("new").alias("kind"), F.lit(0.0).alias("first")))


# --- graph ------------------------------------------------------------------------------------------------------


def keyword_graph(spark, sf_dir):
    """Keywords that one user's events of a day share (J9), at least twice; a keyword's type is its event type most often."""
    e = v.events(spark, sf_dir).filter("keyword is not null")
    found = e.select(F.struct("user_id", "date").alias("doc_id"), F.col("keyword").alias("value"), "event_type")
    kinds = e.groupBy("keyword", "event_type").agg(F.count("*").alias("c")).groupBy(F.col("keyword").alias("id")).agg(F.min_by("event_type", F.struct(-F.col("c"), F.col("event_type"))).alias("type"), F.sum("c").alias("freq"))
    return kinds, t.relations(found)


@query("gr04_summary_edges", f"{EDGES} SELECT src, dst, weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS rank FROM ed) WHERE rank <= 16")
def summary_edges(spark, sf_dir):
    e = t.relations(article_entities(spark, sf_dir)).orderBy(F.desc("weight"), "src", "dst").limit(16)
    return e.withColumn("rank", F.row_number().over(t.W.orderBy(F.desc("weight"), "src", "dst")))  # 16 rows


@query("gr04_summary")
def graph_summary(spark, sf_dir):
    _, edges = keyword_graph(spark, sf_dir)
    return gr.summary(d.pagerank(edges), edges)


@query("gr05_communities")
def communities(spark, sf_dir):
    return gr.communities(keyword_graph(spark, sf_dir)[1])


@query("gr09_graph_report")
def graph_report(spark, sf_dir):
    """GR9 over GR5 and GR7."""
    nodes, edges = keyword_graph(spark, sf_dir)
    c = gr.report(edges, nodes, d.pagerank(edges))
    return c.select("community", "place", "node_count", "edge_count", "label", F.array_join("top_nodes", " ").alias("top_nodes"), F.array_join(F.transform("top_edges", lambda e: F.concat_ws("-", e["src"], e["dst"])), " ").alias("top_edges"), "summary", "global_text")


def routed(spark, sf_dir):
    nodes, edges = keyword_graph(spark, sf_dir)
    rank = d.pagerank(edges)
    summaries = gr.community_summary(gr.communities(edges), nodes, edges, rank)
    asks = v.table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    return gr.route(asks, summaries), summaries


@query("gr08_routing")
def routing(spark, sf_dir):
    return routed(spark, sf_dir)[0]


@query("rt06_graph_hits")
def graph_hits(spark, sf_dir):
    return r.graph_hits(*routed(spark, sf_dir))


@query("snk02_source_health", """h AS (SELECT user_id % 50 AS source, event_id AS seq, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS latency FROM e), r AS (SELECT source, list({'ok': ok, 'latency': latency} ORDER BY seq) AS l FROM h GROUP BY source)
SELECT source, CAST(len(list_filter(l, lambda z: z.ok)) AS BIGINT) AS success_count, CAST(len(list_filter(l, lambda z: NOT z.ok)) AS BIGINT) AS fail_count,
 list_reduce(list_prepend(CAST(0 AS BIGINT), [CASE WHEN z.ok THEN z.latency ELSE CAST(-1 AS BIGINT) END FOR z IN l]), lambda a, y: CASE WHEN y = -1 THEN a WHEN a <> 0 THEN (a + y) // 2 ELSE y END) AS latency_ms FROM r""")
def source_health(spark, sf_dir):
    e = v.events(spark, sf_dir)
    rows = e.select((F.col("user_id") % 50).alias("source"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("long").alias("latency"))
    return o.source_health(rows, "source")
