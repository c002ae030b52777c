"""Queries of pages, policy texts, judged reports and small projections, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as x
from ..operators import html as h
from ..operators import lexicon as lx
from ..operators import pages as p
from ..operators import timeseries as ts
from ..operators import views as v
from .series_queries import LONG, long, rounded
from .text_queries import QUALITY_WORDS, SPAM

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        ORACLES[name] = f"WITH {v.SQL.strip()}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"
        return make

    return keep


def pages(spark, sf_dir):
    return v.table(spark, sf_dir, "pages")


# --- pages ------------------------------------------------------------------------------------------------------

#: The driver's pages have a navigation list; its addresses are one word.
LISTS = [r'(?is)<div class="list">(.*?)</div>', r"(?is)<nav>(.*?)</nav>"]


def link_sql(least: int, most: int, stop: tuple) -> str:
    where = " AND ".join([f"length(title) BETWEEN {least} AND {most}", "article_id <> ''", *[f"NOT contains(title, '{w}')" for w in stop]])
    return f"""n AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<nav>(.*?)</nav>', 1), ' ') AS h FROM pages),
z AS (SELECT page_id, regexp_extract_all(h, '{p.LINK}', 1) AS a, regexp_extract_all(h, '{p.LINK}', 2) AS b FROM n), u AS (SELECT page_id, unnest(a) AS href, unnest(b) AS raw, generate_subscripts(a, 1) AS i FROM z),
l AS (SELECT page_id, i, href, regexp_extract(href, '/([^/]*)$', 1) AS article_id, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM u WHERE regexp_matches(href, '^/')),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, article_id ORDER BY i) AS r FROM l WHERE {where}) SELECT page_id, article_id, href, title FROM k WHERE r = 1"""


@query("src02_list_links", link_sql(4, 10000, ()))
def list_links(spark, sf_dir):
    return p.links(pages(spark, sf_dir), LISTS, r"^/", r"/([^/]*)$")


@query("src04_site_links", link_sql(2, 80, ("tion", "und")))
def site_links(spark, sf_dir):
    return p.links(pages(spark, sf_dir), LISTS[1:], r"^/", r"/([^/]*)$", 2, 80, ("tion", "und"))


LANGS = {"en": "English", "de": "Deutsch", "fr": "Français"}
ARTICLE = r"""b AS (SELECT page_id, url, html, regexp_replace(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?is)<div class="ad">.*?</div>', '', 'g') AS body,
 trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS tt, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS code FROM pages),
q AS (SELECT *, list_filter([trim(regexp_replace(regexp_replace(regexp_extract(z, '(?is)^(.*?)(?:</p>|$)', 1), '(?s)<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) FOR z IN regexp_split_to_array(body, '(?i)<p\b[^>]*>')[2:]], lambda y: length(y) >= 4 AND regexp_matches(y, '[一-龥A-Za-z0-9]') AND NOT contains(y, 'license')) AS ps FROM b)"""


@query("src05_article", f"""{ARTICLE} SELECT page_id, CASE WHEN length(h1) >= 4 THEN h1 ELSE trim(split_part(split_part(tt, '_', 1), '-', 1)) END AS title, CASE code WHEN '' THEN '' {' '.join(f"WHEN '{k}' THEN '{n}'" for k, n in LANGS.items())} ELSE 'other(' || code || ')' END AS channel,
 CAST(coalesce(list_sum([length(z) FOR z IN ps]), 0) AS INT) AS word_count, md5(array_to_string(ps, chr(10))) AS content_md5 FROM q""")
def article(spark, sf_dir):
    site = h.Site(body=("#rm_txt_zw", "article"), noise=(".ad",), code=r"/([a-z]{2})/[0-9]+", names=LANGS, stop=("license",))
    return h.articles(pages(spark, sf_dir), site).select("page_id", "title", "channel", "word_count", F.md5("content").alias("content_md5"))


@query("src06_article", r"""a AS (SELECT doc_id AS page_id, source, lang, trim(regexp_replace(replace(replace(title, '<', ' '), '>', ' '), '[ \t\n\r]+', ' ', 'g')) AS t, list_filter([trim(regexp_replace(z, '[ \t\n\r]+', ' ', 'g')) FOR z IN string_split(replace(replace(text, '<', ' '), '>', ' '), chr(10))], lambda y: length(y) >= 4 AND regexp_matches(y, '[一-龥A-Za-z0-9]')) AS ps FROM articles)
SELECT page_id, CASE WHEN length(t) >= 4 THEN t ELSE 'none' END AS title, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ' 08:05' AS publish_time, coalesce(source, '') AS source, 'writer' || page_id % 90 AS reporter, 'ed' || page_id % 7 AS editor, CAST(coalesce(list_sum([length(z) FOR z IN ps]), 0) AS INT) AS word_count, md5(array_to_string(ps, chr(10))) AS content_md5 FROM a""")
def second_site_article(spark, sf_dir):
    """SRC6 on pages made of the documents in the second site's template, lines nested in the body between elements of noise."""
    plain = lambda c: F.translate(c, "<>", "  ")
    line = lambda x: F.concat(F.lit("<div><div><p>"), x, F.lit('</p></div><div class="ad"><div>ad</div><p>an ad here</p></div></div>'))
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    html = F.concat(
        F.lit('<html><head><meta name="NewsArticleSource" content="'), F.coalesce("source", F.lit("")), F.lit('"><meta name="NewsArticleAuthor" content="writer'), F.col("doc_id") % 90, F.lit('"><title>none</title></head><body><h1>'), plain(F.coalesce("title", F.lit(""))),
        F.lit('</h1><div class="time">2024-01-'), day, F.lit(' 08:05</div><div class="foot">编辑：ed'), F.col("doc_id") % 7, F.lit('</div><div id="article">'), F.array_join(F.transform(F.split(plain(F.col("text")), "\n"), line), ""), F.lit("</div><p>after the end</p></body></html>"),
    )
    made = v.articles(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), html.alias("html"))
    # fixed values of the model: selectors, pattern and meta tags of the second site
    site = h.Site(body=("#article", ".content", "#articleText"), noise=(".share", ".ad", ".edit"), time=(".time",), source=(".source", "#source"), author=(), line="", editor_pattern=r"编辑[：:]*([^\s|]{1,8})", meta_time="NewsArticlePubDay", meta_source="NewsArticleSource", meta_author="NewsArticleAuthor")
    return h.articles(made, site).select("page_id", "title", "publish_time", "source", "reporter", "editor", "word_count", F.md5("content").alias("content_md5"))


TIME = " ".join(f"WHEN regexp_extract(t, '{r}', 1) <> '' THEN lpad(regexp_extract(t, '{r}', 1), 4, '0') || '-' || lpad(regexp_extract(t, '{r}', 2), 2, '0') || '-' || lpad(regexp_extract(t, '{r}', 3), 2, '0') || ' ' || lpad(regexp_extract(t, '{r}', 4), 2, '0') || ':' || lpad(regexp_extract(t, '{r}', 5), 2, '0')" for r in p.TIMES)
STAMPS = "st AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y年%-m月%-d日 %-H:%M') WHEN 1 THEN 'posted ' || strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y/%-m/%-d %H:%M') END AS t FROM e)"


@query("src06_publish_time", f"{STAMPS} SELECT event_id, CASE {TIME} ELSE '' END AS publish_time FROM st")
def publish_time(spark, sf_dir):
    """SRC5, SRC6: the cascade of time formats over texts of each of them."""
    f = F.date_format
    t = F.when(F.col("event_id") % 3 == 0, f("ts", "yyyy年M月d日 H:mm")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("posted "), f("ts", "yyyy-MM-dd HH:mm:ss"))).otherwise(f("ts", "yyyy/M/d HH:mm"))
    return v.events(spark, sf_dir).select("event_id", p.published(t).alias("publish_time"))


CLEAN = "coalesce(html, '')"
for _tag in x.NOISE_TAGS:
    CLEAN = f"regexp_replace({CLEAN}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
for _tag in x.CLASS_TAGS:
    CLEAN = f"""regexp_replace({CLEAN}, '(?is)<{_tag}[^>]*class=["''][^"'']*(?:{x.NOISE_CLASS})[^"'']*["''][^>]*>.*?</{_tag}>', '', 'g')"""


@query("fn10_clean_html", rf"c AS (SELECT page_id, trim(regexp_replace(regexp_replace({CLEAN}, '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS c FROM pages) SELECT page_id, md5(c) AS text_md5, CAST(length(c) AS INT) AS n FROM c")
def clean_html(spark, sf_dir):
    c = pages(spark, sf_dir).select("page_id", x.clean_html(F.col("html")).alias("c"))
    return c.select("page_id", F.md5("c").alias("text_md5"), F.length("c").alias("n"))


@query("fn11_extract", r"""s AS (SELECT doc_id, text, list_filter([trim(regexp_replace(z, '[ \t\n\r]+', ' ', 'g')) FOR z IN string_split(text, '.')], lambda y: length(y) > 10) AS l FROM articles)
SELECT doc_id, coalesce(left(l[1], 50), '') AS title, md5(left(array_to_string(l[1:15], '.'), 2000)) AS content_md5, CASE WHEN regexp_extract(text, '(\d{4})-(\d{1,2})-(\d{1,2})', 1) <> '' THEN regexp_extract(text, '(\d{4})-(\d{1,2})-(\d{1,2})', 1) || '-' || lpad(regexp_extract(text, '(\d{4})-(\d{1,2})-(\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(text, '(\d{4})-(\d{1,2})-(\d{1,2})', 3), 2, '0') ELSE '' END AS publish_time, regexp_extract(text, '(?i)with ([^\s|]{2,30})', 1) AS source FROM s""")
def extract(spark, sf_dir):
    a = v.articles(spark, sf_dir).select("doc_id", p.extract(F.col("text"), ".", r"(?i)with ([^\s|]{2,30})").alias("x"))
    return a.select("doc_id", "x.title", F.md5("x.content").alias("content_md5"), "x.publish_time", "x.source")


@query("src03_date_token", r"SELECT page_id, regexp_extract(url, '(/[a-z]{2}/)[0-9]+', 1) AS token FROM pages WHERE contains(url, '/en/')")
def date_token(spark, sf_dir):
    """SRC3: pages whose address holds a token; the token as the address has it."""
    return pages(spark, sf_dir).filter(F.contains("url", F.lit("/en/"))).select("page_id", F.regexp_extract("url", r"(/[a-z]{2}/)[0-9]+", 1).alias("token"))


# --- quality, relevance, policy texts ---------------------------------------------------------------------------

QUALITY = f"""q AS (SELECT doc_id, length(title) AS lt, text, ({' + '.join(f"CAST(contains(text, '{w}') AS INT)" for w in QUALITY_WORDS)}) AS hits,
 (length(text) = 0 OR ({' + '.join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in SPAM)}) >= 2) AS spam FROM articles),
qs AS (SELECT doc_id, CASE WHEN lt < 6 THEN 0 WHEN length(text) < 60 THEN .2 WHEN spam THEN .1 ELSE .5 * least(1, hits / 8) + .5 * least(1, length(text) / 600) END AS quality FROM q)"""


@query("fn08_quality_filter", f"{QUALITY} SELECT doc_id, round(quality, 4) AS quality FROM qs WHERE round(quality, 4) >= .25")
def quality_filter(spark, sf_dir):
    a = v.articles(spark, sf_dir).select("doc_id", F.round(x.quality(F.col("title"), F.col("text"), QUALITY_WORDS, SPAM), 4).alias("quality"))
    return a.filter("quality >= 0.25")


@query("fn09_relevance", """n AS (SELECT doc_id, grp, count(*) AS c FROM found GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, grp) AS rank FROM n),
p AS (SELECT doc_id, sum(c) * 1e0 AS n, string_agg(grp, ',' ORDER BY rank) FILTER (rank <= 3) AS themes FROM r GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN trim(text) = '' THEN 0 WHEN n IS NULL THEN .1 ELSE least(.95e0, .3e0 + .1e0 * n) END, 6) AS score, coalesce(themes, '') AS themes FROM articles LEFT JOIN p USING (doc_id)""")
def relevance(spark, sf_dir):
    return lx.themes(v.articles(spark, sf_dir), v.lexicon(spark, sf_dir))


GOOD, BAD = ["the", "der", "que"], ["ing", "ung", "ción"]


def _sum(keys, col="text"):
    return " + ".join(f"(length({col}) - length(replace({col}, '{k}', ''))) // {len(k)}" for k in keys)


def _stance(col):
    return f"CASE WHEN p + n = 0 THEN 'neutral' WHEN p * 1e0 / (p + n) > .65 THEN 'bullish' WHEN p * 1e0 / (p + n) < .35 THEN 'bearish' ELSE 'neutral' END AS stance, round(CASE WHEN p + n = 0 THEN 0 WHEN p * 1e0 / (p + n) > .65 THEN least(1, (p * 1e0 / (p + n) - .5) * 2) WHEN p * 1e0 / (p + n) < .35 THEN least(1, (.5 - p * 1e0 / (p + n)) * 2) ELSE 1 - abs(p * 1e0 / (p + n) - .5) * 2 END, 3) AS confidence"


@query("fn20_policy_text", f"""k AS (SELECT doc_id, text, {_sum(GOOD)} AS p, {_sum(BAD)} AS n FROM articles) SELECT doc_id, regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS publish_date, regexp_extract(text, '([0-9]+)', 1) AS amount, {_stance('text')} FROM k""")
def policy_text(spark, sf_dir):
    a = v.articles(spark, sf_dir).withColumn("x", p.stance(F.col("text"), GOOD, BAD))
    return a.select("doc_id", F.regexp_extract("text", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("publish_date"), F.regexp_extract("text", r"([0-9]+)", 1).alias("amount"), "x.stance", "x.confidence")


@query("fn20_clauses", f"""c AS (SELECT doc_id, list_filter([trim(z) FOR z IN regexp_split_to_array(text, '\\. ')], lambda y: length(y) > 5)[1:20] AS l FROM articles), u AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS place, unnest(l) AS body FROM c),
k AS (SELECT doc_id, place, body, {_sum(GOOD, 'body')} AS p, {_sum(BAD, 'body')} AS n FROM u) SELECT doc_id, place, md5(body) AS body_md5, {_stance('body')} FROM k""")
def clauses(spark, sf_dir):
    c = p.clauses(v.articles(spark, sf_dir), r"\. ").withColumn("x", p.stance(F.col("body"), GOOD, BAD))
    return c.select("doc_id", "place", F.md5("body").alias("body_md5"), "x.stance", "x.confidence")


HEADS = [r"^[A-Z][a-z]+ is ", r"^The ", r"^Is "]


@query("fn29_sections", "SELECT doc_id, CAST(len(list_distinct(list_concat(" + ", ".join(f"[trim(left(z, 80)) FOR z IN regexp_extract_all(text, '(?m)({h}.*)', 1)]" for h in HEADS[:2]) + "))) AS INT) AS n FROM articles")
def sections(spark, sf_dir):
    return v.articles(spark, sf_dir).select("doc_id", p.sections(F.col("text"), HEADS[:2]).alias("n"))


@query("fn30_truncate", "SELECT doc_id, md5(array_to_string([array_to_string([left(w, 5) FOR w IN string_split(z, ' ')], ' ') FOR z IN string_split(text, chr(10))], chr(10))) AS cut_md5 FROM articles")
def truncate(spark, sf_dir):
    """FN30 on the words of lines."""
    cut = p.truncate(F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")), 5, T.ArrayType(T.ArrayType(T.StringType())))
    return v.articles(spark, sf_dir).select("doc_id", F.md5(F.array_join(F.transform(cut, lambda x: F.array_join(x, " ")), "\n")).alias("cut_md5"))


WORDS = {"consistency": ["the ", "der "], "groundedness": ["[0-9]+", "tion"], "actionability": ["ing", "keit"], "novelty": ["aux", "ción"], "domains": ["energy", "the", "und", "les", "que", "with"]}
AGAINST = ["the.{0,40}and", "und.{0,40}der"]
SCORES = f"""j0 AS (SELECT doc_id, text, ({' + '.join(f"CAST(regexp_matches(text, '{a}') AS INT)" for a in AGAINST)}) AS w, {', '.join('(' + ' + '.join(f"len(regexp_extract_all(text, '{k}'))" for k in WORDS[n]) + f') AS c_{n}' for n in ('consistency', 'groundedness', 'actionability', 'novelty'))},
 ({' + '.join(f"CAST(contains(text, '{k}') AS INT)" for k in WORDS['domains'])}) AS c_domains, len(list_distinct(list_concat({', '.join(f"[trim(left(z, 80)) FOR z IN regexp_extract_all(text, '(?m)({h}.*)', 1)]" for h in HEADS)}))) AS heads FROM articles),
j1 AS (SELECT doc_id, length(text) > 0 AS filled, (1 - least(1, w / 3e0) * .6e0) * (.5e0 + .5e0 * least(1, c_consistency / 8e0)) AS consistency, least(1, c_groundedness / 25e0) AS groundedness, least(1, heads / 31e0) * .7e0 + least(1, c_domains / 6e0) * .3e0 AS completeness, least(1, c_actionability / 12e0) AS actionability, least(1, c_novelty / 6e0) AS novelty FROM j0),
j2 AS (SELECT doc_id, {', '.join(f'CASE WHEN filled THEN {d} ELSE 0e0 END AS {d}' for d in p.DIMENSIONS)} FROM j1)"""


def _total(ws):
    return " + ".join(f"{k} * {w}e0" for k, w in zip(p.DIMENSIONS, ws))


@query("jd01_judge", f"""{SCORES} SELECT doc_id, {', '.join(f'round({d}, 6) AS {d}' for d in p.DIMENSIONS)}, {', '.join(f'round({_total(ws)}, 6) AS judge_{j}' for j, ws in p.JUDGES.items())}, round({_total((0.20, 0.25, 0.20, 0.20, 0.15))}, 6) AS overall,
 concat_ws(',', {', '.join(f"CASE WHEN {d} < .4 THEN '{d}' END" for d in p.DIMENSIONS)}) AS concerns, concat_ws(',', {', '.join(f"CASE WHEN {d} >= .7 THEN '{d}' END" for d in p.DIMENSIONS)}) AS strengths, round({_total((0.20, 0.25, 0.20, 0.20, 0.15))}, 9) >= .65 AS passed FROM j2""")
def judge(spark, sf_dir):
    return p.judged(v.articles(spark, sf_dir), p.dimensions(F.col("text"), WORDS, AGAINST, HEADS))


@query("ag21_judge_panel", f"""o AS (SELECT user_id AS doc_id, event_type AS judge, ['{"', '".join(p.DIMENSIONS)}'][CAST(keyword AS INT) % 5 + 1] AS dimension, least(1, avg(value) / 40) AS score FROM e WHERE keyword IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
d AS (SELECT doc_id, dimension, avg(score) AS mean, stddev_pop(score) AS sd, greatest(0, 1 - 2.5e0 * stddev_pop(score)) AS consensus FROM o GROUP BY ALL), w AS (SELECT doc_id, sum(mean * CASE dimension WHEN 'consistency' THEN .2e0 WHEN 'groundedness' THEN .25e0 WHEN 'completeness' THEN .2e0 WHEN 'actionability' THEN .2e0 ELSE .15e0 END) AS overall, avg(consensus) AS level FROM d GROUP BY doc_id)
SELECT doc_id, dimension, round(mean, 6) AS mean, round(sd, 6) AS sd, round(consensus, 6) AS consensus, round(overall, 6) AS overall, round(level, 6) AS level, round(overall, 9) >= .65 AND round(level, 9) >= .4 AS passed, round(CASE WHEN round(mean, 9) < .65 THEN greatest(.65e0, mean + .2e0) END, 6) AS target FROM d JOIN w USING (doc_id)""")
def judge_panel(spark, sf_dir):
    """JD1, AG21: event types as the judges of each user's five dimensions (by keyword)."""
    e = v.events(spark, sf_dir).filter("keyword is not null and value is not null")
    name = F.element_at(F.array(*[F.lit(d) for d in p.DIMENSIONS]), (F.col("keyword").cast("int") % 5 + 1))
    o = e.groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("judge"), name.alias("dimension")).agg(F.least(F.lit(1.0), F.avg("value") / 40).alias("score"))
    return p.panel(o)


@query("jd02_quick_score", f"{SCORES} SELECT doc_id, round({_total((0.20, 0.25, 0.20, 0.20, 0.15))}, 6) AS overall, round({_total((0.20, 0.25, 0.20, 0.20, 0.15))}, 9) >= .65 AS passed FROM j2")
def quick_score(spark, sf_dir):
    return p.judged(v.articles(spark, sf_dir), p.dimensions(F.col("text"), WORDS, AGAINST, HEADS)).select("doc_id", "overall", "passed")


# --- sources and sinks ------------------------------------------------------------------------------------------


@query("src09_source_union", f"""{QUALITY}, u AS (SELECT doc_id, source, 0 AS rank, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source, 1, lang FROM documents WHERE lang <> 'en' OR lang IS NULL UNION ALL SELECT doc_id, NULL, 2, NULL FROM labels),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, source) AS r FROM u) SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN CASE rank WHEN 0 THEN 'english' WHEN 1 THEN 'others' ELSE 'labels' END ELSE source END AS source, rank, round(quality, 4) AS quality FROM k JOIN qs USING (doc_id) WHERE r = 1 AND round(quality, 4) >= .2""")
def source_union(spark, sf_dir):
    """SRC9: sources in fixed order, the first to bring an id wins, a blank source is named after its table, quality .20 or more."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    u = d.filter("lang = 'en'").select("doc_id", "source", F.lit(0).alias("rank")).unionByName(d.filter("lang <> 'en' or lang is null").select("doc_id", "source", F.lit(1).alias("rank")))
    u = u.unionByName(v.table(spark, sf_dir, "labels").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(2).alias("rank")))
    first = u.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("rank", F.col("source").asc_nulls_last()))).filter("r = 1")
    name = F.when(F.coalesce("source", F.lit("")) == "", F.element_at(F.array(F.lit("english"), F.lit("others"), F.lit("labels")), F.col("rank") + 1)).otherwise(F.col("source"))
    q = v.articles(spark, sf_dir).select("doc_id", F.round(x.quality(F.col("title"), F.col("text"), QUALITY_WORDS, SPAM), 4).alias("quality"))
    return first.select("doc_id", name.alias("source"), "rank").join(q, "doc_id").filter("quality >= 0.2")


@query("src12_corpus", "r AS (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS date, doc_id, left(text, 4000) AS text FROM articles WHERE doc_id % 3 = 0), j AS (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS date, doc_id, text FROM articles WHERE doc_id % 3 <> 0) SELECT date, doc_id, kind, md5(text) AS text_md5 FROM (SELECT *, 'report' AS kind FROM r WHERE date < DATE '2024-01-25' UNION ALL SELECT *, 'json' FROM j WHERE date < DATE '2024-01-25' AND NOT EXISTS (SELECT 1 FROM r WHERE r.date = j.date))")
def corpus(spark, sf_dir):
    from ..sources.storage import history

    a = v.articles(spark, sf_dir).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"), "doc_id", "text")
    h = history(a.filter("doc_id % 3 = 0"), a.filter("doc_id % 3 <> 0"), "2024-01-25")
    return h.select("date", "doc_id", "kind", F.md5("text").alias("text_md5"))


@query("snk01_upsert", "n AS (SELECT o_custkey + 100 AS id, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey) SELECT coalesce(n.id, c_custkey) AS id, coalesce(n.value, c_acctbal) AS value FROM customer FULL JOIN n ON n.id = c_custkey")
def upsert(spark, sf_dir):
    """SNK1: replaced, kept and inserted keys."""
    from ..sources.storage import latest

    old = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    new = v.table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return latest(old, new, ["id"], "seq")


@query("snk09_cache", "c AS (SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS value, max(ts) AS put_at FROM e GROUP BY user_id) SELECT key, value, put_at + INTERVAL 10 DAY > TIMESTAMP '2024-01-31 00:00:00' AS alive FROM c")
def cache(spark, sf_dir):
    """SNK9: the last entry of each key and whether it is alive at a time, ten days after it was put."""
    from ..sources.storage import cached

    e = v.events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("put_at"))
    return cached(e, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), "10 days").select("key", "value", "alive")


@query("snk09_articles_hash", "a AS (SELECT source, string_agg(title || '|' || doc_id || '|' || length(text), chr(10) ORDER BY title || '|' || doc_id || '|' || length(text)) AS s FROM articles GROUP BY source) SELECT source, sha256(s) AS articles_hash FROM a")
def articles_hash(spark, sf_dir):
    """SNK9's key over a source's articles in sorted order."""
    a = v.articles(spark, sf_dir).select("source", F.concat_ws("|", "title", "doc_id", F.length("text")).alias("s"))
    return a.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("s")), "\n"), 256).alias("articles_hash"))  # the articles of one report


# --- small projections ------------------------------------------------------------------------------------------


@query("sc02_array_checks", "l AS (SELECT source, list(doc_id % 7 ORDER BY doc_id) AS l FROM documents GROUP BY source) SELECT source, array_to_string(list_sort(list_distinct(l)), ',') AS indices, len(list_distinct(l)) = len(l) AS is_unique, round(list_avg(l), 3) AS mean, len(l) > 0 AS filled FROM l")
def array_checks(spark, sf_dir):
    """SC2: sorted unique indices, whether there are repeats, mean rounded to 3, not empty."""
    d = v.table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_list(F.col("doc_id") % 7).alias("l"))  # the rows of one report
    u = F.array_sort(F.array_distinct("l"))
    return d.select("source", F.array_join(u, ",").alias("indices"), (F.size(u) == F.size("l")).alias("is_unique"), F.round(F.aggregate("l", F.lit(0.0), lambda a, y: a + y) / F.size("l"), 3).alias("mean"), (F.size("l") > 0).alias("filled"))


@query("sc03_progressive_parse", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events")
def progressive_parse(spark, sf_dir):
    """SC3: a value is parsed as it is, else cut at 80, 30 and 15 characters and closed, else a default; some are broken on purpose."""
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(", \"note"), F.lit(" x" * 30))).otherwise(F.col("props"))
    e = v.table(spark, sf_dir, "events").select("event_id", said.alias("s"))
    tries = [F.from_json("s", "k int")["k"]] + [F.from_json(F.concat(F.regexp_replace(F.left("s", F.lit(n)), r',[^,]*$', ""), F.lit("}")), "k int")["k"] for n in (80, 30, 15)]
    return e.select("event_id", F.coalesce(*tries, F.lit(-1)).alias("k"))


@query("sg00_getter", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing FROM events")
def getter(spark, sf_dir):
    """SG0: a nested field or a default, whether the path is there or not."""
    s = F.from_json("props", "struct<k:string, inner:struct<x:string>>")
    return v.table(spark, sf_dir, "events").select("event_id", F.coalesce(s["k"], F.lit("none")).alias("k"), F.coalesce(s["inner"]["x"], F.lit("none")).alias("missing"))


@query("dt01_dates", "SELECT DISTINCT date, strftime(date, '/n1/%Y/%m%d/') AS token, CAST(date - 1 AS DATE) AS yesterday, CASE WHEN date > DATE '2024-01-20' THEN DATE '2024-01-20' ELSE date END AS resolved FROM e")
def dates(spark, sf_dir):
    """DT1: parse and format, the day before, the token of an address, the target date (no later than today)."""
    d = v.events(spark, sf_dir).select(F.to_date(F.date_format("date", "yyyy-MM-dd")).alias("date")).distinct()
    return d.select("date", F.date_format("date", "'/n1/'yyyy'/'MMdd'/'").alias("token"), F.date_sub("date", 1).alias("yesterday"), F.least("date", F.lit("2024-01-20").cast("date")).alias("resolved"))


@query("sq01_entity_frequency", "SELECT date, keyword, CAST(sum(freq) AS BIGINT) AS freq FROM keyword_daily WHERE date >= DATE '2024-01-30' - 7 GROUP BY ALL")
def entity_frequency(spark, sf_dir):
    """SQ1: an entity's frequency per day since some days before an as-of date."""
    return v.keyword_daily(spark, sf_dir).filter(F.col("date") >= F.date_sub(F.lit("2024-01-30").cast("date"), 7)).groupBy("date", "keyword").agg(F.sum("freq").alias("freq"))


@query("ld01_series_loader", f"{LONG} SELECT date, series_id, round(coalesce(nullif(value, 0), CASE series_id WHEN 'sentiment_index' THEN 50 WHEN 'industry_count' THEN 8 ELSE 0 END), 6) AS value FROM long WHERE series_id IN ('sentiment_index', 'industry_count', 'event_count')")
def series_loader(spark, sf_dir):
    """LD1: chosen series, null and zero replaced by the series' usual value."""
    return ts.load(long(spark, sf_dir), {"sentiment_index": 50.0, "industry_count": 8.0, "event_count": 0.0})


@query("lm02_plain_report", "SELECT date, round(greatest(.1, least(.99, freq / 20e0)), 6) AS score, CASE WHEN freq >= 5 THEN 'High' ELSE 'Medium' END AS heat, keyword FROM keyword_daily WHERE keyword IS NOT NULL")
def plain_report(spark, sf_dir):
    """LM2: a report from counts alone: score clamped to .1 and .99, heat High from five on."""
    k = v.keyword_daily(spark, sf_dir).filter("keyword is not null")
    return k.select("date", "keyword", F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.col("freq") / 20)).alias("score"), F.when(F.col("freq") >= 5, "High").otherwise("Medium").alias("heat"))


STOCKS = {"purchase": ["Alpha", "Beta"], "signup": ["Gamma"], "error": ["Delta", "Epsilon", "Zeta"]}


@query("fn26_st08_stocks", "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {k}, '{n}', 'S{j}{k}')" for j, (i, ns) in enumerate(STOCKS.items()) for k, n in enumerate(ns)) + ") t(industry, place, name, code)) SELECT DISTINCT industry, name, code FROM industry_daily JOIN s USING (industry) WHERE place < 2")
def stocks(spark, sf_dir):
    """FN26, ST8, J10: the first two stocks of each industry that was hit, by a small fixed table."""
    rows = [(i, k, n, f"S{j}{k}") for j, (i, ns) in enumerate(STOCKS.items()) for k, n in enumerate(ns)]
    s = spark.createDataFrame(rows, "industry string, place int, name string, code string")
    return v.industry_daily(spark, sf_dir).select("industry").distinct().join(F.broadcast(s), "industry").filter("place < 2").select("industry", "name", "code")  # six rows


@query("fn24_indicator_links", """w AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY phrase) AS pos FROM found), c AS (SELECT phrase, ['CPI', 'PMI', 'GDP', 'PPI', 'M2'][place % 7 + 1] AS code FROM lexicon WHERE place % 7 < 5),
l AS (SELECT doc_id, code, min(pos) AS pos FROM w JOIN c USING (phrase) WHERE pos <= 8 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, code) AS k FROM l)
SELECT a.doc_id, coalesce(string_agg(code, ',' ORDER BY k) FILTER (k <= 6), 'CPI') AS codes FROM articles a LEFT JOIN r USING (doc_id) GROUP BY a.doc_id""")
def indicator_links(spark, sf_dir):
    """FN24: indicators of a text's first eight theme phrases, each once, six at most, the first indicator if there is none; some phrases have no indicator."""
    lexicon = v.lexicon(spark, sf_dir)
    codes = lexicon.filter("place % 7 < 5").selectExpr("phrase", "array('CPI', 'PMI', 'GDP', 'PPI', 'M2')[CAST(place % 7 AS INT)] AS code")
    return lx.linked_codes(v.articles(spark, sf_dir), lexicon, codes)


# --- topics, stop words, suppressed alerts ----------------------------------------------------------------------

TOPIC_RULES = [("english", ["the", "and"]), ("german", ["der", "die"]), ("french", ["que", "les"])]
TOPIC_INDUSTRIES = {"energy": ["the", "of"], "finance": ["que", "les", "de"], "transport": ["und", "der", "die"]}


def _list(keys):
    return "[" + ", ".join(f"'{k}'" for k in keys) + "]"


@query("tm02_topic_labels", r"""w AS (SELECT source, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda z: length(z) >= 2)) AS term FROM articles), f AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS topic, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT topic, list(term ORDER BY r) AS words FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM f) WHERE r <= 8 GROUP BY topic), """ + f"""
b AS (SELECT topic, words, list_sort([{', '.join(f"{{'n': -len(list_intersect(words, {_list(keys)})), 'i': {i}, 'name': '{name}'}}" for i, (name, keys) in enumerate(TOPIC_INDUSTRIES.items()))}])[1] AS b FROM k)
SELECT topic, CASE {' '.join(f"WHEN list_has_any(words, {_list(keys)}) THEN '{name}'" for name, keys in TOPIC_RULES)} ELSE coalesce(words[1], 'unnamed') END AS label, CASE WHEN b.n < 0 THEN b.name END AS industry FROM b""")
def topic_labels(spark, sf_dir):
    """TM2 over the eight most frequent words of each source and language."""
    from ..operators import text as t

    a = v.articles(spark, sf_dir).select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("doc_id"), "text")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))
    top = t.postings(a).withColumn("r", rank).filter("r <= 8").groupBy(F.col("doc_id").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda y: y["term"]).alias("words"))
    return t.topic_labels(top, TOPIC_RULES, TOPIC_INDUSTRIES)


STOP = ["the", "and", "der", "die", "que", "les"]


@query("fn01_stopwords", r"t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda z: length(z) >= 2 AND NOT list_contains(" + _list(STOP) + ", z)) AS l FROM articles) SELECT doc_id, CAST(len(l) AS INT) AS n, md5(array_to_string(l, ' ')) AS tokens_md5 FROM t")
def stopwords(spark, sf_dir):
    """FN1 with a list of stop words."""
    a = v.articles(spark, sf_dir).select("doc_id", x.tokens(F.col("text"), STOP).alias("l"))
    return a.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", " ")).alias("tokens_md5"))


@query("st02_suppressed_alerts", """k AS (SELECT event_type || '|' || (user_id % 5) AS key, list([epoch_us(ts)] ORDER BY ts) AS l FROM e WHERE event_type = 'error' GROUP BY ALL), r AS (SELECT key, list_reduce(l, lambda a, b: CASE WHEN b[1] - a[len(a)] >= 86400000000 THEN list_concat(a, b) ELSE a END) AS f FROM k)
SELECT key, unnest(f) AS at FROM r""")
def suppressed_alerts(spark, sf_dir):
    """ST2 for a batch: an alert of a key fires when a day has passed since the last fired one."""
    from ..streaming.alerts import suppressed

    e = v.events(spark, sf_dir).filter("event_type = 'error'").select(F.concat_ws("|", "event_type", F.col("user_id") % 5).alias("key"), "ts")
    return suppressed(e, 86_400).select("key", F.unix_micros("ts").alias("at"))
