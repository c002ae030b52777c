"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes each stage's result as Parquet into
the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, near_copies, toxicity
from tidemark.llm.common import fresh, stash, table


def aside(docs: DataFrame, names: tuple) -> tuple[DataFrame, dict]:
    """`docs` with its columns of these names called otherwise, and how to call them back: an operator would replace them."""
    new = {c: fresh("__" + c.lower(), docs) for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(new), {v: k for k, v in new.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; null and empty texts stay. Rows are judged one by one, whatever their ids."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    own, back = aside(docs, ("score", "predicted"))
    return toxicity.score(own, model).filter("predicted = 0").select(*own.columns).withColumnsRenamed(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds leave the text, and n_chars follows; rows without an id keep all lines, null text is empty."""
    own, back = aside(docs, ("n_lines", "n_dropped"))
    out = line_dedup.dedup_lines(own)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*own.columns).withColumnsRenamed(back)


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key of its own for each row, which ids aren't: they may be null or repeat; and that column's name."""
    row = fresh("__row", docs)
    return stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles) one row with the smallest doc_id stays; documents without an id stay.

    Rows that repeat an id are rows of their own: near copies among them leave one, unlike texts stay both.
    """
    rows, row = with_row(docs)
    found = near_copies.near_copies(rows, row).select(F.col(row).alias("row"), "component")
    named = rows.filter("doc_id is not null").select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("h")).join(found, "row")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "h", "row")).alias("m")).select(F.col("m.row").alias(row))
    stay = stash(first.unionByName(rows.filter("doc_id is null").select(row)), "stay")
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a source's last pass ends where its target is met), sorted by training position.

    Rows are told apart by a key of their own, so each of those without an id, or with the same id, comes as often as its own take.
    """
    rows, row = with_row(docs)
    at = fresh("__at", rows)
    plan = mixing.mix(rows, keep=(row,)).filter("taken > 0").select(F.col(row).alias("of_row"), "positions")
    taken = rows.join(plan.select(F.col("of_row"), F.explode("positions").alias("position")), rows[row] == F.col("of_row")).select(*[rows[c] for c in docs.columns], F.col("position").alias(at))
    return taken.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text; null text is empty."""
    return bpe.encode_documents(docs.select("doc_id", "text"), bpe.public_vocabulary(), keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The models, fingerprints and tokens of the stages aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
