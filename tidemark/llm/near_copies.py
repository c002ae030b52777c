"""Near copies by the similarity of word shingles, as the pipeline needs them: every pair of a share of `similarity` or more is a link.

Operator 8's index finds fingerprints that differ in 3 bits, which texts of similarity 0.8 seldom do. Candidates therefore come from
two sources: that index, and bands of shingle minima (MinHash): texts of similarity s agree in one of BANDS bands of ROWS minima with
the chance 1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8 and more above. First, each text is compared with the smallest of its band (and the
index's pairs with each other), by the shingle sets themselves, so that m near copies of one text cost m comparisons. Only bands in
which more than two texts meet and aren't all linked by then go on: their texts are gathered into groups, in which sets are compared
breadth-first, a found set leaving the open ones. A large group is dealt in blocks, and each pair of blocks is a task of its own.

Defined results: rows are told apart by a key of their own, so ids may be null or repeat; a text of fewer words is one shingle; null
text has no words, and texts without words are copies of each other. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import LOWER_AZ, discard, gram_hash, mix64, stash, tenant, texts, with_arrow, word_table
from .components import components, thin

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
#: Sets, and shingles of all sets, that a block of a group holds.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000

_SEED = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_FLIP, _TIMES = _SEED[: BANDS * ROWS], _SEED[BANDS * ROWS :] | np.uint64(1)


def shingle_sets(part: pa.RecordBatch, name: str, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    tenant("near_copies")
    low = pa.array([x.encode().translate(LOWER_AZ).decode() for x in texts(part, name)], pa.large_string())
    _, _, _, hashes, first = word_table(pa.RecordBatch.from_arrays([low], ["t"]), "t")
    grams = gram_hash(hashes, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(grams[a : b - words + 1]) if b - a >= words else gram_hash(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = mix64(key + np.minimum.reduceat((flat ^ _FLIP[i]) * _TIMES[i], starts))
        keys[:, b] = key
    return keys


def sketches(rows: DataFrame, key: str, words: int, text_col: str) -> DataFrame:
    """(key, d1, d2, n, fp, bands): digest and size of the shingle set, SimHash fingerprint, keys of the bands."""

    def make(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part, text_col, words)
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        size = np.array([len(s) for s in sets])
        some = [s for s in sets if len(s)]
        values = bands(some).view(np.int64).ravel() if some else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
        fp = np.frombuffer(b"".join(simhash.fingerprint(x, words) for x in texts(part, text_col)), ">u8").astype(np.uint64).view(np.int64)
        return {"d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1]), "n": pa.array(size, pa.int64()), "fp": pa.array(fp), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    long = T.LongType()
    return with_arrow(rows.select(key, text_col), [("d1", long), ("d2", long), ("n", long), ("fp", long), ("bands", T.ArrayType(long))], make, [key], text_col)


def similar(sets: list[np.ndarray], ids: list[int], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that share `similarity` of their union."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    open_, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root], front = False, [root]
        while front and open_.any():
            x = front.pop()
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            # the runs lo..hi of all its shingles, laid end to end
            runs = hi - lo
            at = np.arange(runs.sum()) + np.repeat(lo - (np.cumsum(runs) - runs), runs)
            shared = np.bincount(owner[at], minlength=len(sets))
            found = np.flatnonzero(open_ & (shared >= similarity * (size + size[x] - shared) - 1e-9))
            open_[found] = False
            front += found.tolist()
            out += [(ids[x], ids[y]) for y in found.tolist()]
    return out


def buckets(classes: DataFrame) -> DataFrame:
    """(rep, k): each class (rep, fp, bands) under the keys of its bands, and under its fingerprint."""
    prints = F.xxhash64(F.lit("fp"), F.col("fp"))
    return classes.select("rep", F.explode(F.array_append(F.coalesce("bands", F.array().cast("array<bigint>")), prints)).alias("k"))


def sets_of(rows: DataFrame, key: str, text_col: str, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set) of the rows whose key is a node."""

    def make(part: pa.RecordBatch) -> dict:
        return {"set": pa.array([s.tobytes() for s in shingle_sets(part, "__text", words)], pa.binary())}

    text = rows.select(F.col(key).alias("node"), F.col(text_col).alias("__text")).join(nodes, "node", "left_semi")
    return with_arrow(text, [("set", T.BinaryType())], make, ["node"], "__text")


def confirmed(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose sets share `similarity` of their union; each side brings its set to the link."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            found = []
            for i, (s, t) in enumerate(zip(x, y)):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if shared >= similarity * (len(s) + len(t) - shared) - 1e-9:
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64())], ["a", "b"])

    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in ("a", "b"))
    return links.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_copies(rows: DataFrame, key: str, words: int = WORDS, similarity: float = SIMILARITY, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, component) for every row of `rows`, whose long column `key` is unique; component is the smallest key of its group.

    `rows` is read more than once and has to give the same keys each time.
    """
    own = stash(sketches(rows, key, words, text_col), "sketches")
    classes = stash(own.groupBy("d1", "d2").agg(F.min(key).alias("rep"), F.min_by("fp", key).alias("fp"), F.min_by("bands", key).alias("bands"), F.min("n").alias("n")), "classes")
    prints = stash(classes.groupBy("fp").agg(F.min("rep").alias("rep")), "prints")
    centre = stash(buckets(classes).groupBy("k").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1"), "centres")
    star = buckets(classes).join(centre, "k").filter("rep <> a").select("a", F.col("rep").alias("b"))
    star = stash(star.unionByName(simhash.links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "star")
    sets = stash(sets_of(rows, key, text_col, star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words), "sets")
    sure = stash(confirmed(star, sets, similarity), "confirmed")
    first = stash(components(sure), "first")

    # buckets of more than two classes that are still apart: all of these meet, in blocks
    whose = buckets(classes).join(centre.filter("c > 2").select("k", "a"), "k").join(first, F.col("rep") == F.col("node"), "left").select("k", "a", "rep", F.coalesce("root", "rep").alias("now"))
    apart = stash(whose.groupBy("k").agg(F.min("now").alias("x"), F.max("now").alias("y")).filter("x <> y").select("k"), "apart")
    groups = components(thin(whose.join(apart, "k", "left_semi").select("a", F.col("rep").alias("b")).filter("a <> b")))
    groups = stash(groups.join(classes.select(F.col("rep").alias("node"), "n"), "node"), "groups")
    sizes = stash(groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")), "sizes")
    dealt = stash(groups.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))), "dealt")
    discard(groups, sizes, star, prints, centre, apart, first)
    pairs = dealt.join(sets, "node").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "set")

    def compare(group: pa.Table) -> pa.Table:
        found = similar([np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()], group.column("node").to_pylist(), similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    roots = components(pairs.groupBy("root", "a", "b").applyInArrow(compare, "a long, b long").unionByName(sure))
    named = stash(classes.join(roots, classes.rep == roots.node, "left").select("d1", "d2", F.coalesce("root", "rep").alias("component")), "named")
    out = stash(own.select(key, "d1", "d2").join(named, ["d1", "d2"]).select(key, "component"), "near-copies")
    discard(own, classes, dealt, named, sets, sure)
    return out
