"""Operator 10, line dedup: levelled sorted runs of line hashes.

Documents are hashed once and written by batch, in ascending doc_id. A run is a table of (line hash, owner) bucketed and sorted by
the hash, so that merging a batch with the runs needs no shuffle of what is already stored. Each batch reads its own folder,
reduces its lines to one row for each key, merge-anti-joins the runs, and adds the keys that no run has as a run of level 0; when
a level holds `fanout` runs they are compacted into one run of the next level. So a batch meets fewer than `fanout` runs of each
level, and a key is rewritten once for each level. The number of batches follows the number of documents (BATCH_DOCS each,
LEAST_BATCHES at least). The owner of a key is the smallest doc_id that holds it. A last join marks every occurrence whose
document isn't the owner. That join is a plain sort-merge join of two shuffled sides, which adaptive execution splits when one line
is in a large part of all documents. Runs lie in the shared folder and are dropped when the marks are written.

Defined results: null text = one empty line; a null id owns nothing and loses nothing; rows that repeat an id are one document
(each loses the lines that a smaller id holds); an empty table gives an empty table; a text is held by one task as a whole; other
columns pass through whatever their names, and columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, LOWER_AZ, column, delete, discard, fresh, pieces, shared_dir, shuffle_partitions, stash, table, tenant, texts, with_arrow

MIN_CHARS = 10
#: Documents of a batch, least number of batches, runs of a level before they are compacted.
BATCH_DOCS, LEAST_BATCHES, FANOUT = 100_000_000, 4, 2


def _digest(line: str, least: int) -> bytes | None:
    key = line.strip(ASCII_SPACE)
    return xxhash.xxh3_128_digest(key.encode().translate(LOWER_AZ)) if len(key) >= least else None


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(h1, h2, doc): the 128-bit hashes of a document's qualifying line keys, each once."""

    def run(batches):
        tenant("line_dedup")
        for batch in batches:
            for part in pieces(batch, text_col):
                hashes, ids = [], []
                for doc, text in zip(column(part, id_col), texts(part, text_col)):
                    if doc is None:
                        continue
                    found = {_digest(x, min_chars) for x in text.split("\n")} - {None}
                    hashes += found
                    ids += [doc] * len(found)
                pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "h1 long, h2 long, doc long")


class Runs:
    """Sorted runs by level, each a bucketed table in the shared folder."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.compactions = 0

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def add(self, keys: DataFrame, level: int = 0) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        keys.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.path(name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:  # compaction; the anti joins keep keys of the runs disjoint
            old, self.levels[level] = self.levels[level], []
            whole = self.spark.table(old[0])
            for x in old[1:]:
                whole = whole.unionByName(self.spark.table(x))
            self.compactions += 1
            self.add(whole, level + 1)
            for x in old:
                self.drop(x)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.path(name))

    def close(self) -> None:
        for level in self.levels:
            for x in level:
                self.drop(x)
        self.levels = [[]]


def batch_edges(docs: DataFrame, batch_docs: int, least_batches: int, id_col: str) -> list[int]:
    """Largest doc_id of every batch but the last, ascending: batches of about `batch_docs` documents."""
    n = max(least_batches, math.ceil(docs.count() / batch_docs))
    if n < 2:
        return []
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)])).first()[0]
    return sorted(set(cuts or []))


def gather(keys: DataFrame, batches: int, fanout: int) -> Runs:
    """The smallest document of every key as (h1, h2, owner), gathered batch by batch in runs."""
    runs = Runs(keys.sparkSession, fanout)
    for i in range(batches):
        new = keys.filter(F.col("batch") == i).groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        for run in runs.tables():
            new = new.join(run, ["h1", "h2"], "left_anti")
        runs.add(new)
    return runs


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, batch_docs: int = BATCH_DOCS, least_batches: int = LEAST_BATCHES, fanout: int = FANOUT, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """`docs` with repeated lines removed from the text, plus n_lines (before) and n_dropped."""
    edges = batch_edges(docs, batch_docs, least_batches, id_col)
    batch = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x < F.col("doc"))) if edges else F.lit(0)
    keys = stash(line_keys(docs, min_chars, text_col, id_col).withColumn("batch", batch), "line-keys", by="batch")
    runs = gather(keys, len(edges) + 1, fanout)
    owners = None
    for run in runs.tables():
        owners = run if owners is None else owners.unionByName(run)
    gone, doc = fresh("__drop", docs), fresh("__doc", docs)
    drops = keys.join(owners, ["h1", "h2"]).filter(F.col("doc") != F.col("owner")).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias(gone))  # at most the lines of one document
    drops = stash(drops.withColumnRenamed("doc", doc), "dropped-lines")
    runs.close()
    discard(keys)
    joined = docs.join(drops, docs[id_col].cast("long") == drops[doc], "left").drop(doc)

    def make(part: pa.RecordBatch) -> dict:
        tenant("line_dedup")
        out, total, lost = [], [], []
        lists = part.column(part.schema.get_field_index(gone)).to_pylist()
        for text, drop in zip(texts(part, text_col), lists):
            lines = text.split("\n")
            kept = lines
            if drop:
                drop = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drop}
                kept = [x for x in lines if _digest(x, min_chars) not in drop]
            out.append("\n".join(kept))
            total.append(len(lines))
            lost.append(len(lines) - len(kept))
        return {text_col: out, "n_lines": total, "n_dropped": lost}

    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return with_arrow(joined, [(text_col, T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())], make, keep, text_col)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, n, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, (owner IS NOT NULL AND owner <> doc_id) AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
