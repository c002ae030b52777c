"""Exact similarity join of bags of words whose meetings never leave a task: block against block, from the shared folder.

A document is a vector of length 1; its terms stand from rare to frequent. q is the squared length of a vector from a term on. If the
first of a pair's common terms are those where q(x) q(y) >= LEVEL ** 2, the rest of their product is below LEVEL by
Cauchy-Schwarz, since q falls along both. So a pair that reaches `least` has at least `least` - LEVEL in its first common terms. Only
these meet: each term's list stands by falling q, so what may meet is a head of it. Pairs that pass are computed in full, at once.

Sums live in a task's arrays; on disk are the bags, the terms that two documents share, and the vectors, each once. Tasks read
blocks of vectors by URI through pyarrow.fs: a block is indexed once and met by several others. Meetings still grow with the square
of the documents as long as the vocabulary doesn't grow, memory doesn't.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import tokens
from ..sources.scratch import drop, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package on their path

#: How far below the threshold the rest of a product may reach; less makes fewer meetings and more pairs to compute.
SPARE = 0.04
#: Room for rounding in bounds.
MARGIN = 1e-7
SLACK = 1e-9
#: Documents and postings of a block, blocks that meet an indexed one in a task, sums and meetings held at once.
DOCS, POSTINGS, TOGETHER, SUMS, MEETINGS = 6_000, 2_000_000, 24, 500_000, 250_000
VECTOR = "doc_id long, ids array<int>, tf array<int>, df array<int>, alone double"


def _slices(batches):
    """Batches of DOCS documents at most, so that a task's memory doesn't hang on the session's batches."""
    for b in batches:
        for at in range(0, b.num_rows, DOCS):
            yield b.slice(at, DOCS)
        pa.default_memory_pool().release_unused()


def _lists(offsets, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def bags(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, terms, tf): the distinct tokens of each document and how often it has them. doc_id tells documents apart."""

    def run(batches):
        for b in _slices(batches):
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            many = max(len(coded.dictionary), 1)
            key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(key, np.arange(len(sizes) + 1) * many)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ends, coded.dictionary.take(pa.array(key % many))), _lists(ends, pa.array(n, pa.int32()))], ["doc_id", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col(text)).alias("t")).mapInArrow(run, "doc_id long, terms array<string>, tf array<int>")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:/") else f"file://{uri}")


def _parts(df: DataFrame) -> list[str]:
    """URIs of the files of a written table, in order."""
    return sorted(df.inputFiles())


def shared_terms(made: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(term, df, at) of terms that two bags hold, from rare to frequent, and where the numbers of each sorted part begin."""
    df = made.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    terms = written(df.orderBy("df", "term").withColumn("at", F.monotonically_increasing_id()), "terms")
    begin, upto = {}, 0
    for part, n in terms.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each part
        begin[part], upto = upto, upto + n
    return terms, begin


def vectors(made: DataFrame, terms: DataFrame, begin: dict[int, int]) -> DataFrame:
    """Bags with numbers for terms, from rare to frequent, and their frequencies; `alone` is the sum of squared counts of terms that nobody shares.

    Terms are looked up part by part, so a task holds one part of them at a time.
    """
    files = _parts(terms)

    def run(batches):
        for b in _slices(batches):
            lists, tf = b.column(1), b.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            number, often = np.full(len(coded.dictionary), -1, np.int64), np.ones(len(coded.dictionary), np.int32)
            for file in files:
                where, path = _open(file)
                part = pq.read_table(path, filesystem=where)
                hit = pc.index_in(coded.dictionary, value_set=part["term"].combine_chunks())
                own = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
                at = hit.drop_null().to_numpy()
                n = part["at"].to_numpy()[at]
                number[own] = np.array([begin[k] for k in (n >> 33).tolist()], np.int64) + (n & ((1 << 33) - 1))
                often[own] = part["df"].to_numpy()[at]
            code = coded.indices.to_numpy(zero_copy_only=False)
            doc, term = np.repeat(np.arange(len(sizes)), sizes), number[code]
            lone = term < 0
            alone = np.bincount(doc[lone], tf[lone].astype(float) ** 2, len(sizes))
            doc, term, tf, often = doc[~lone], term[~lone], tf[~lone], often[code[~lone]]
            order = np.lexsort((term, doc))
            ends = np.searchsorted(doc, np.arange(len(sizes) + 1))
            each = [_lists(ends, pa.array(x[order], pa.int32())) for x in (term, tf, often)]
            yield pa.RecordBatch.from_arrays([b.column(0), *each, pa.array(alone, pa.float64())], ["doc_id", "ids", "tf", "df", "alone"])

    return made.mapInArrow(run, VECTOR)


class Block:
    """Vectors of some files: terms `ids` and weights `w` of document k at start[k]:start[k + 1], q as above."""

    def __init__(self, files: list[str], n: int | None):
        parts = []
        for file in files:
            where, path = _open(file)
            parts.append(pq.read_table(path, filesystem=where))
        t = pa.concat_tables(parts).combine_chunks()
        flat = lambda c: pc.list_flatten(t[c]).to_numpy()
        self.doc, sizes = t["doc_id"].to_numpy(), pc.list_value_length(t["ids"]).to_numpy()
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.of, self.ids = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), flat("ids")
        idf = (lambda df: np.log((1 + n) / (1 + df)) + 1) if n is not None else (lambda df: np.ones(np.shape(df)))
        self.w = flat("tf") * idf(flat("df").astype(float))
        alone = t["alone"].to_numpy() * float(idf(np.float64(1))) ** 2
        self.size = sizes + t["alone"].to_numpy()  # of sets
        norm = np.sqrt(np.bincount(self.of, self.w * self.w, len(sizes)) + alone)
        self.w /= np.repeat(norm, sizes)
        upto = np.cumsum(self.w * self.w)
        last = np.concatenate([[0.0], upto])[self.start[1:]]
        self.q = np.repeat(last, sizes) - upto + self.w * self.w + MARGIN


class Index:
    """The postings of a block that can meet at `level`: lists of terms, each by falling q."""

    def __init__(self, block: Block, level: float):
        self.block, self.level = block, level
        own = np.flatnonzero(block.q >= level * level)
        own = own[np.lexsort((-block.q[own], block.ids[own]))]
        self.terms, first = np.unique(block.ids[own], return_index=True)
        self.first = np.concatenate([first, [len(own)]])
        self.doc, self.w = block.of[own], block.w[own]
        self.key = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) + self._place(block.q[own])
        self.all_terms, self.local = np.unique(block.ids, return_inverse=True)

    @staticmethod
    def _place(q):
        return np.clip((1 - q) / 2, 0, 0.5)

    def met(self, other: Block, least: float):
        """(x, y), documents of this block and of the other, whose first common terms bring `least`; for one run of y after another."""
        if not len(self.terms):
            return
        many = len(self.block.doc)
        own = np.flatnonzero(other.q >= self.level * self.level)
        at = np.minimum(np.searchsorted(self.terms, other.ids[own]), len(self.terms) - 1)
        known = self.terms[at] == other.ids[own]
        own, at = own[known], at[known]
        upto = np.searchsorted(self.key, at + self._place(self.level * self.level / other.q[own]) + MARGIN, "right")
        n = np.maximum(upto - self.first[at], 0)
        own, begin, n = own[n > 0], self.first[at][n > 0], n[n > 0]
        y, w, total = other.of[own], other.w[own], np.concatenate([[0], np.cumsum(n)])
        step = max(1, SUMS // many)
        for y0 in range(0, len(other.doc), step):
            k, end = np.searchsorted(y, [y0, y0 + step])
            if k == end:
                continue
            cells, sums = min(step, len(other.doc) - y0) * many, None
            while k < end:
                to = min(end, max(k + 1, np.searchsorted(total, total[k] + MEETINGS, "right") - 1))
                r = n[k:to]
                place = np.arange(total[to] - total[k]) + np.repeat(begin[k:to] - (total[k:to] - total[k]), r)
                cell = np.repeat((y[k:to].astype(np.int64) - y0) * many, r) + self.doc[place]
                more = np.bincount(cell, self.w[place] * np.repeat(w[k:to], r), cells)
                sums = more if sums is None else sums + more
                k = to
            hit = np.flatnonzero(sums >= least)
            if len(hit):
                yield hit % many, hit // many + y0

    def products(self, x, y, other: Block):
        """The whole products of documents x of this block and y (ascending) of the other, and how many terms they share."""
        terms, mine = self.all_terms, self.block
        dense, dot, shared = np.zeros(len(terms)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        edges = np.flatnonzero(np.diff(y, prepend=-1, append=-1))
        for k, end in zip(edges[:-1], edges[1:]):
            own = slice(other.start[y[k]], other.start[y[k] + 1])
            at = np.minimum(np.searchsorted(terms, other.ids[own]), len(terms) - 1)
            fits = terms[at] == other.ids[own]
            dense[at[fits]] = other.w[own][fits]
            for m in range(k, end):
                mine_ = slice(mine.start[x[m]], mine.start[x[m] + 1])
                v = dense[self.local[mine_]]
                dot[m], shared[m] = v @ mine.w[mine_], np.count_nonzero(v)
            dense[at[fits]] = 0
        return dot, shared


def _join(made: DataFrame, n: int | None, least: float, measure) -> DataFrame:
    """(i, j, sim), i < j, of the pairs of bags whose cosine reaches `least` and for which measure(product, shared, size, size) gives a number."""
    spark, made = made.sparkSession, written(made, "bags")
    terms, begin = shared_terms(made)
    whole = written(vectors(made, terms, begin), "vectors", most_rows=DOCS)
    drop(made, terms)
    blocks, rows, posts = [], DOCS, POSTINGS
    for file in _parts(whole):
        where, path = _open(file)
        about = pq.ParquetFile(path, filesystem=where).metadata
        r, p = about.num_rows, sum(about.row_group(g).column(1).num_values for g in range(about.num_row_groups))
        if rows + r > DOCS or posts + p > POSTINGS:
            blocks, rows, posts = [*blocks, []], 0, 0
        blocks[-1].append(file)
        rows, posts = rows + r, posts + p
    work = [(a, b) for a in range(len(blocks)) for b in range(a, len(blocks), TOGETHER)]
    level = least - SPARE

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, first = work[k]
                index = Index(Block(blocks[a], n), level)
                for b in range(first, min(first + TOGETHER, len(blocks))):
                    other = index.block if a == b else Block(blocks[b], n)
                    for x, y in index.met(other, least - level - SLACK):
                        if a == b:
                            x, y = x[x < y], y[x < y]
                        dot, shared = index.products(x, y, other)
                        sim = measure(dot, shared, index.block.size[x], other.size[y])
                        ok = ~np.isnan(sim)
                        i, j = index.block.doc[x[ok]], other.doc[y[ok]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(sim[ok], pa.float64())], ["i", "j", "sim"])

    out = written(spark.range(0, len(work), 1, max(len(work), 1)).mapInArrow(run, "i long, j long, sim double"), "similar")
    drop(whole)
    return out


def cosine_join(docs: DataFrame, least: float) -> DataFrame:
    """(i, j, sim), i < j, of all documents (doc_id, text) whose TF-IDF vectors have a cosine of `least` or more."""
    return _join(bags(docs), docs.count(), least, lambda dot, shared, m, n: np.where(dot >= least - SLACK, dot, np.nan))


def jaccard_join(docs: DataFrame, least: float) -> DataFrame:
    """(i, j, sim), i < j, of all documents whose sets of tokens share `least` of their union.

    Sets are vectors of equal entries: a pair that shares that much has a cosine of 2 least / (1 + least) or more, since the mean of
    two sizes is at least the root of their product.
    """
    sets = bags(docs).withColumn("tf", F.transform("tf", lambda x: F.lit(1)))

    def measure(dot, shared, m, n):
        sim = shared / np.maximum(m + n - shared, 1)
        return np.where(sim >= least - SLACK, sim, np.nan)

    return _join(sets, None, 2 * least / (1 + least), measure)
