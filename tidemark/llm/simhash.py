"""Operator 8, SimHash near-dedup: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so at least 5 positional bytes are
shared: the guaranteed minimum. Of any 7 positions such a pair then shares 4, so the index posts each distinct fingerprint under
every 4 of the first 7 positional bytes (35 postings); all pairs that can reach the minimum meet in a posting list, and lists
stay short because a list fixes 32 bits. Inside a list the shared positional bytes of a pair are tallied, pairs below 5 are
dropped, and the rest is verified by counting bits.

Equal fingerprints are one entry. A list is searched breadth-first: a found fingerprint leaves the open set, so a list of m near
copies emits fewer than m links and costs about m comparisons, never all pairs. A list above LIST entries is dealt in blocks, and
each pair of blocks is a task of its own. Components are found on links between fingerprints; a component is named by its smallest
doc_id.

Defined results: null text = no words = fingerprint zero; a text is held by one task as a whole, its shingles 200,000 at a time; an
empty table gives an empty table; other columns, whatever their names, aren't read; rows that repeat an id are separate rows with their own fingerprints;
null ids get a fingerprint and the component of their class (null where no row of the component has an id).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, discard, stash, table, tenant, texts, with_arrow
from .components import components, thin

BITS, BYTES = 3, 8
LEAST_SHARED = BYTES - BITS
#: Positional bytes that a posting fixes, out of the first KEYED positions.
FIXED = LEAST_SHARED - 1
KEYED = BYTES - 1
#: Entries of a posting list that one task searches.
LIST = 4096


def fingerprint(text: str, words: int = 3) -> bytes:
    """Eight bytes, most significant first."""
    w = text.encode().translate(LOWER_AZ).split()
    if not w:
        return bytes(8)
    if len(w) < words:
        return xxhash.xxh64_digest(b" ".join(w), 42)
    digest = xxhash.xxh64_digest
    n = len(w) - words + 1
    total = np.zeros(64, np.int64)
    for i in range(0, n, 200_000):
        part = w[i : i + 200_000 + words - 1]
        raw = b"".join([digest(x, 42) for x in map(b" ".join, zip(*(part[k:] for k in range(words))))])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with __fp, the fingerprint's 64 bits as a signed long."""

    def make(part: pa.RecordBatch) -> dict:
        tenant("simhash")
        raw = b"".join(fingerprint(x, words) for x in texts(part, text_col))
        return {"__fp": pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))}

    return with_arrow(docs, [("__fp", T.LongType())], make, keep, text_col)


def list_links(fps: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one posting list.

    The list's own inverted index has a posting list for each positional byte that its entries don't all share. An entry's
    postings are tallied; only entries that reach the minimum of shared bytes are verified by counting bits.
    """
    part = fps.view(np.uint8).reshape(-1, BYTES)
    differ = np.flatnonzero((part != part[0]).any(axis=0))
    need = LEAST_SHARED - (BYTES - len(differ))
    postings = []
    for p in differ.tolist():
        order = np.argsort(part[:, p], kind="stable")
        postings.append((order, np.searchsorted(part[order, p], np.arange(257))))
    out, open_, left = [], np.ones(len(fps), bool), len(fps)
    for root in range(len(fps)):
        if not open_[root]:
            continue
        open_[root], left, front = False, left - 1, [root]
        while front and left:
            x = front.pop()
            if need > 0:
                posted = [order[edge[b] : edge[b + 1]] for (order, edge), b in zip(postings, part[x, differ].tolist())]
                tally = np.bincount(np.concatenate(posted), minlength=len(fps)) if len(fps) <= 256 else None
                if tally is None:
                    near, count = np.unique(np.concatenate(posted), return_counts=True)
                    near = near[count >= need]
                else:
                    near = np.flatnonzero(tally >= need)
                near = near[open_[near]]
            else:
                near = np.flatnonzero(open_)
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= BITS]
            open_[near] = False
            left -= len(near)
            front += near.tolist()
            out += [(int(ids[x]), y) for y in ids[near].tolist()]
        if not left:
            break
    return out


def _search(batches):
    """Rows sorted by posting key (k, a, b): links of each list; a list that goes over a batch's end is carried on."""
    held: list[np.ndarray] = []

    def links(key: np.ndarray, fps: np.ndarray, ids: np.ndarray):
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = end - start
        found: set = set()
        two = start[size == 2]
        x = fps[two] ^ fps[two + 1]
        ok = ((x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= LEAST_SHARED) & (np.bitwise_count(x) <= BITS)
        found.update(zip(ids[two[ok]].tolist(), ids[two[ok] + 1].tolist()))
        for s, e in zip(start[size > 2], end[size > 2]):
            found.update(list_links(fps[s:e], ids[s:e]))
        return found

    def give(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]))
        rows = np.concatenate(held)
        edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        cut = int(edge[-1]) if len(edge) else 0
        if cut:
            yield give(links(rows[:cut, :3], rows[:cut, 3].astype(np.int64).view(np.uint64), rows[:cut, 4]))
        held = [rows[cut:]]
    rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
    if len(rows):
        yield give(links(rows[:, :3], np.ascontiguousarray(rows[:, 3]).view(np.uint64), rows[:, 4]))


def links(classes: DataFrame, list_size: int = LIST) -> DataFrame:
    """(a, b): a forest of the links between the classes (fp long, rep long), as pairs of representatives, which can't be null."""
    sets = list(combinations(range(KEYED), FIXED))

    def mask(s):
        m = sum(0xFF << (8 * (BYTES - 1 - i)) for i in s)
        return m - (1 << 64) if m >> 63 else m

    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask(s)).cast("long"))) for i, s in enumerate(sets)]
    posted = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k"))
    heavy = stash(posted.groupBy("k").count().filter(F.col("count") > list_size).select("k", F.ceil(F.col("count") / list_size).cast("int").alias("blocks")), "heavy")
    if heavy.isEmpty():
        dealt = posted.select("k", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "fp", "rep")
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("long")
        split = posted.join(heavy, "k", "left").withColumn("own", F.coalesce(own, F.lit(0).cast("long"))).withColumn("other", F.explode(F.expr("sequence(0L, cast(coalesce(blocks, 1) as bigint) - 1)")))
        dealt = split.select("k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "rep")
    found = dealt.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b").mapInArrow(_search, "a long, b long")
    return thin(found)


def near_duplicates(docs: DataFrame, words: int = 3, text_col: str = "text", id_col: str = "doc_id", list_size: int = LIST) -> DataFrame:
    """(doc id, fingerprint, component_id) for every row of `docs`."""
    own = stash(fingerprints(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")), words, "__text", ["__id"]), "fingerprints")
    classes = stash(own.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("rep")), "classes")
    # nodes are the fingerprints themselves, which are never null; a class without any id still links others
    roots = components(links(classes.select("fp", F.col("fp").alias("rep")), list_size))
    named = stash(classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "named")
    least = stash(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    last = stash(named.join(least, "root").select(F.col("fp").alias("__fp"), "component_id"), "components")
    discard(classes, named, least)
    named = last
    return own.join(named, "__fp", "left").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
