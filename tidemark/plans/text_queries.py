"""Queries over texts, pages and vectors, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import lexicon as lx
from ..operators import text as t
from ..operators import views as v
from .series_queries import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SECRETS = {"email": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "card": r"\b[0-9]{16}\b", "key": r"(?i)api[_-]?key", "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}
TOKENS = r"tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) AS term FROM src)"
TFIDF = """tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nd AS (SELECT count(*) AS n FROM src),
w0 AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nd), nn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY doc_id), w AS (SELECT doc_id, term, w / norm AS weight FROM w0 JOIN nn USING (doc_id))"""


def query(name: str, sql: str | None):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        if sql:
            plain = sql.lstrip().upper().startswith("SELECT")
            ORACLES[name] = f"WITH {v.SQL.strip()}{'' if plain else ','} {sql}"
        return make

    return keep


def has(col, keys):
    return "(" + " OR ".join(f"contains({col}, '{k}')" for k in keys) + ")"


@query("fn01_tokens", f"src AS (SELECT doc_id, text FROM articles), {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_distinct, max(term) AS last_token FROM tok GROUP BY doc_id")
def tokens(spark, sf_dir):
    d = v.articles(spark, sf_dir).select("doc_id", F.explode(x.tokens(F.col("text"))).alias("term"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_distinct"), F.max("term").alias("last_token"))


@query("fn03_dd01_title_dedup", r"k AS (SELECT doc_id, source, md5(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}]', '', 'g')) AS title_key FROM articles) SELECT doc_id, source, title_key FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY doc_id) AS r FROM k) WHERE r = 1")
def title_dedup(spark, sf_dir):
    return t.dedup_titles(v.articles(spark, sf_dir)).select("doc_id", "source", "title_key")


QUALITY_WORDS, SPAM = ["tion", "the", "ment", "que", "ung", "der", "ción", "and"], ["click here", "buy now", "free", "winner"]


@query("fn07_quality", f"""q AS (SELECT doc_id, length(title) AS lt, text, ({' + '.join(f"CAST(contains(text, '{w}') AS INT)" for w in QUALITY_WORDS)}) AS hits,
 (length(text) = 0 OR ({' + '.join(f"(length(text) - length(replace(text, '{p}', ''))) // {len(p)}" for p in SPAM)}) >= 2) AS spam FROM articles)
SELECT doc_id, round(CASE WHEN lt < 6 THEN 0 WHEN length(text) < 60 THEN .2 WHEN spam THEN .1 ELSE .5 * least(1, hits / 8) + .5 * least(1, length(text) / 600) END, 6) AS quality FROM q""")
def quality(spark, sf_dir):
    return v.articles(spark, sf_dir).select("doc_id", x.quality(F.col("title"), F.col("text"), QUALITY_WORDS, SPAM).alias("quality"))


@query("fn13_event_category", "SELECT doc_id, coalesce(min(grp), 'other') AS category FROM articles LEFT JOIN kw USING (doc_id) GROUP BY doc_id")
def event_category(spark, sf_dir):
    return lx.first_rule(v.articles(spark, sf_dir), v.lexicon(spark, sf_dir))


@query("fn14_event_intensity", """SELECT doc_id, round(greatest(.1, least(1, .5 * coalesce(greatest(CASE WHEN contains(text, 'tion') THEN .9 END, CASE WHEN contains(text, 'ment') THEN .6 END), .5)
 + .4 * coalesce(greatest(CASE WHEN contains(text, 'der') THEN .8 END, CASE WHEN contains(text, 'les') THEN .3 END), .5) + CASE WHEN length(text) > 2000 THEN .1 ELSE 0 END)), 6) AS intensity FROM articles""")
def event_intensity(spark, sf_dir):
    bonus = F.when(F.length("text") > 2000, 0.1).otherwise(0.0)
    return v.articles(spark, sf_dir).select("doc_id", x.intensity(F.col("text"), {"tion": 0.9, "ment": 0.6}, {"der": 0.8, "les": 0.3}, bonus).alias("intensity"))


@query("fn18_business_days", "SELECT DISTINCT date, CAST(date - CAST(CASE dayofweek(date) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS INT) AS DATE) AS before, CAST(date - 7 AS DATE) AS week_before FROM series")
def business_days(spark, sf_dir):
    return v.order_series(spark, sf_dir).select("date").distinct().select("date", x.previous_business_day(F.col("date")).alias("before"), F.date_sub("date", 7).alias("week_before"))


@query("fn21_json_object", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_object(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<think>a {b}</think> so\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("answer: "), "props", F.lit(" end")))
    return e.select("event_id", F.get_json_object(x.json_object(said), "$.k").alias("k"))


@query("fn27_hash_embedding", r"""b AS (SELECT doc_id AS item_id, lower(text) AS s FROM articles),
c AS (SELECT item_id, string_split(s, '') AS c FROM b WHERE length(s) >= 3), u AS (SELECT item_id, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS gram FROM c), g AS (SELECT item_id, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 256 AS bucket, 1.0e0 AS w FROM u),
t AS (SELECT item_id, list_filter(regexp_split_to_array(s, '[ \t\n\r]+'), lambda z: z <> '') AS l FROM b),
v AS (SELECT item_id, unnest([l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))]) AS gram FROM t WHERE len(l) >= 2), p AS (SELECT item_id, (CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) * 7) % 256 AS bucket, 1.5e0 AS w FROM v),
r AS (SELECT item_id, bucket, sum(w) AS w FROM (SELECT * FROM g UNION ALL SELECT * FROM p) GROUP BY ALL)
SELECT item_id, CAST(bucket AS INT) AS bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM r""")
def hash_embedding(spark, sf_dir):
    return t.hash_embedding(v.articles(spark, sf_dir)).withColumnRenamed("doc_id", "item_id")


@query("fn28_snk09_cache_keys", "SELECT doc_id, substr(sha256(text), 1, 16) AS text_key, substr(sha256(concat_ws('|', '2024-01-01', 'summary', source, lang)), 1, 24) AS cache_key FROM articles")
def cache_keys(spark, sf_dir):
    return v.articles(spark, sf_dir).select("doc_id", x.text_key(F.col("text")).alias("text_key"), F.substring(F.sha2(F.concat_ws("|", F.lit("2024-01-01"), F.lit("summary"), "source", "lang"), 256), 1, 24).alias("cache_key"))


@query("ag02_word_frequency", f"src AS (SELECT doc_id, text FROM articles), {TOKENS} SELECT term AS word, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, word LIMIT 50")
def word_frequency(spark, sf_dir):
    return t.word_frequency(v.articles(spark, sf_dir))


@query("ag05_tfidf_keywords", f"src AS (SELECT doc_id, text FROM articles), {TOKENS}, {TFIDF} SELECT term, round(sum(weight), 6) AS score FROM w GROUP BY term ORDER BY round(sum(weight), 6) DESC, term LIMIT 20")
def tfidf_keywords(spark, sf_dir):
    return t.tfidf_keywords(v.articles(spark, sf_dir))


VOCABULARY = "vt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), vk AS (SELECT term FROM (SELECT term, sum(tf) AS n FROM vt GROUP BY term ORDER BY n DESC, term LIMIT {k}))"
TFIDF_OF = TFIDF.replace("FROM tok GROUP BY ALL)", "FROM tok JOIN vk USING (term) GROUP BY ALL)", 1)


@query("ag05_vocabulary", f"src AS (SELECT doc_id, text FROM articles), {TOKENS}, {VOCABULARY.format(k=500)}, {TFIDF_OF} SELECT term, round(sum(weight), 6) AS score FROM w GROUP BY term")
def vocabulary_keywords(spark, sf_dir):
    """AG5 on the 500 most frequent terms: all their scores."""
    return t.tfidf(v.articles(spark, sf_dir), vocabulary=500).groupBy("term").agg(F.sum("weight").alias("score"))


@query("rt01_vocabulary", f"src AS (SELECT 'd' || doc_id AS doc_id, text FROM articles UNION ALL SELECT 'q' || item_id, text FROM benchmark), {TOKENS}, {VOCABULARY.format(k=5000)}, {TFIDF_OF}, s AS (SELECT CAST(substr(a.doc_id, 2) AS BIGINT) AS query_id, CAST(substr(b.doc_id, 2) AS BIGINT) AS doc_id, sum(a.weight * b.weight) AS score FROM w a JOIN w b USING (term) WHERE a.doc_id LIKE 'q%' AND b.doc_id LIKE 'd%' GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 3 AND score >= .05")
def vocabulary_search(spark, sf_dir):
    """RT1 on the 5000 most frequent terms."""
    return t.lexical_search(v.articles(spark, sf_dir), v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), vocabulary=5000)


@query("ag03_lexicon_matches", """n AS (SELECT grp, title, min(doc_id) AS doc_id FROM kw JOIN articles USING (doc_id) WHERE title <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS rank FROM n),
t AS (SELECT grp, string_agg(title, ' | ' ORDER BY rank) AS titles FROM r WHERE rank <= 5 GROUP BY grp)
SELECT grp AS industry, CAST(sum(hits) AS BIGINT) AS hit_count, count(DISTINCT doc_id) AS article_count, any_value(titles) AS titles FROM kw LEFT JOIN t USING (grp) GROUP BY grp""")
def lexicon_matches(spark, sf_dir):
    return lx.industry_matches(v.articles(spark, sf_dir), v.lexicon(spark, sf_dir)).withColumn("titles", F.array_join("titles", " | "))


@query("ag04_industry_words", r"""k AS (SELECT grp AS industry, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) AS word FROM kw JOIN articles USING (doc_id)), c AS (SELECT industry, word, count(*) AS n FROM k GROUP BY ALL)
SELECT industry, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 5""")
def industry_words(spark, sf_dir):
    return lx.industry_words(v.articles(spark, sf_dir), v.lexicon(spark, sf_dir))


#: Entities of articles: (doc_id, type, value).
ENTITY = "ent0 AS (SELECT doc_id, grp AS type, phrase AS value FROM found)"


def article_entities(spark, sf_dir):
    return lx.entities(v.articles(spark, sf_dir), v.lexicon(spark, sf_dir))


@query("ag12_entities", f"{ENTITY} SELECT type, value, count(*) AS freq FROM ent0 GROUP BY ALL")
def entities(spark, sf_dir):
    return article_entities(spark, sf_dir).groupBy("type", "value").agg(F.count("*").alias("freq"))


@query("gr02_relations", f"{ENTITY} SELECT a.value AS src, b.value AS dst, count(*) AS weight FROM ent0 a JOIN ent0 b ON a.doc_id = b.doc_id AND a.value < b.value GROUP BY ALL HAVING count(*) >= 2")
def relations(spark, sf_dir):
    return t.relations(article_entities(spark, sf_dir))


@query("ag15_index_quantiles", "s AS (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n FROM e WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, " + ", ".join(f"s[least(CAST(floor(n * {q}) AS BIGINT), n - 1) + 1] AS {p}" for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + ", s[1] AS low, s[n] AS high, n FROM s")
def index_quantiles(spark, sf_dir):
    return t.index_quantiles(v.events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("sm03_co_occurrence", f"src AS (SELECT doc_id, text FROM articles), l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2) AS l FROM src), p AS (SELECT l, unnest(range(1, len(l) + 1)) AS pos FROM l), k AS (SELECT unnest(l[greatest(1, pos - 5):pos + 5]) AS word FROM p WHERE contains(l[pos], 'with')) SELECT word, count(*) AS n FROM k WHERE NOT contains(word, 'with') GROUP BY word ORDER BY n DESC, word LIMIT 20")
def co_occurrence(spark, sf_dir):
    return t.co_occurrence(v.articles(spark, sf_dir), "with")


@query("rt01_lexical_search", f"src AS (SELECT 'd' || doc_id AS doc_id, text FROM articles UNION ALL SELECT 'q' || item_id, text FROM benchmark), {TOKENS}, {TFIDF}, s AS (SELECT CAST(substr(a.doc_id, 2) AS BIGINT) AS query_id, CAST(substr(b.doc_id, 2) AS BIGINT) AS doc_id, sum(a.weight * b.weight) AS score FROM w a JOIN w b USING (term) WHERE a.doc_id LIKE 'q%' AND b.doc_id LIKE 'd%' GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 3 AND score >= .05")
def lexical_search(spark, sf_dir):
    return t.lexical_search(v.articles(spark, sf_dir), v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("src05_page_title", r"SELECT page_id, trim(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title FROM pages")
def page_title(spark, sf_dir):
    h1, title = (F.regexp_extract("html", f"(?is)<{g}[^>]*>(.*?)</{g}>", 1) for g in ("h1", "title"))
    return v.table(spark, sf_dir, "pages").select("page_id", F.trim(F.coalesce(F.nullif(h1, F.lit("")), title)).alias("title"))


@query("src18_secrets", "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM articles) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, doc_id, CAST(line AS INT) AS line FROM l WHERE regexp_matches(s, '{p}')" for k, p in SECRETS.items()))
def secrets(spark, sf_dir):
    return t.secrets(v.articles(spark, sf_dir), SECRETS)
