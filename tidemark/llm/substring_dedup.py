"""Operator 2, substring dedup: repeated-phrase automata.

A window is WINDOW consecutive words of one document. Of every window the phrase of PHRASE words with the smallest hash is its
anchor; equal windows have equal anchors, and neighbours share them, so about one word in seven begins an anchor.

1. Candidates: anchors are counted over all documents. A window whose anchor doesn't recur (in two documents, or twice in one)
   can't recur, so only the stretches of windows around recurring anchors travel to the shards, from every document.
2. Confirm: a shard's windows are counted by 128-bit digests; those found twice or more are the recurring passages, each with its
   first place in (document, start) order.
3. Compile: the recurring windows of a shard become an Aho-Corasick automaton (pyahocorasick) over numbers of words, which a
   dictionary gives out by the words' bytes, so that a hit is an equality of words and not of hashes.
4. Stream: all stretches run through the automaton. Every hit is an occurrence of its pattern; those that aren't the pattern's
   first place are repeats. Words that repeats cover go; the rest stays, joined by one space.

Anchors are sharded by the document that holds them first, so that a passage stays together; a document that is first with more
than PHRASES anchors is split by anchor. A shard of more than CHUNK words is dealt in chunks: they confirm by one more aggregate,
their patterns are dealt in parts of PATTERNS, and each part meets each chunk in a task of its own. So a task's stretches and its
automaton are bounded whatever repeats. Nothing is sampled or capped; no phrases or documents are broadcast or sent to the driver.

Defined results: null text has no words; rows with a null id keep their words; rows that repeat an id count as one document at
the same place (equal texts of one id don't remove each other); an empty table gives an empty table; n_words and n_removed columns
are replaced, others pass through. A text is held by one task as a whole.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, gram_hash, mix64, pieces, stash, table, tenant, texts, with_arrow, word_table

WINDOW, PHRASE = 20, 8
#: Anchors of a shard on average, words of a chunk, patterns of an automaton, windows of a stretch.
PHRASES, CHUNK, PATTERNS, STRETCH = 2048, 131_072, 32_768, 32_768
_SECOND = 0xA0761D6478BD642F


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes by place, the starts of all windows inside a row, and each window's anchor place."""
    g = gram_hash(hashes, PHRASE)
    width = window - PHRASE + 1
    if len(g) < width:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.arange(len(g) - width + 1)
    anchor = low + np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))  # row of each word
    inside = row[low] == row[np.minimum(low + window - 1, len(row) - 1)]
    return g, low[inside], anchor[inside]


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc, twice): the anchors of each document, once each."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                _, _, _, hashes, first = word_table(part)
                g, starts, anchor = anchors(hashes, first, window)
                place = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])] if len(anchor) else anchor
                row = np.searchsorted(first, place, side="right") - 1
                key = np.column_stack([row, g[place].view(np.int64)])
                order = np.lexsort((key[:, 1], key[:, 0]))
                key = key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]).any(axis=1)
                twice = np.diff(np.append(np.flatnonzero(new), len(key))) > 1
                ids = part.column(part.schema.get_field_index("doc")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key[new, 1]), pa.array(ids[key[new, 0]], pa.int64()), pa.array(twice)], ["h", "doc", "twice"])

    return docs.select("doc", "text").mapInArrow(run, "h long, doc long, twice boolean")


def stretches(found: DataFrame, window: int) -> DataFrame:
    """Stretches of windows around recurring anchors, by shard, from documents that come with their anchors' hashes and shards."""
    names = ["shard", "doc", "text_key", "start", "n", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        tenant("substring_dedup")
        engine = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in pieces(batch, "packed", 800_000):
                yield cut(part, engine)

    def cut(part: pa.RecordBatch, engine) -> pa.RecordBatch:
        doc, key = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        plain = pa.record_batch([pa.array([engine.decompress(x) for x in part.column(1).to_pylist()], pa.binary()).cast(pa.string())], ["text"])
        raw, start, end, hashes, first = word_table(plain)
        g, starts, anchor = anchors(hashes, first, window)
        row = np.searchsorted(first, starts, side="right") - 1
        lists = part.column(3)
        both = lists.flatten()
        h, to = (both.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        of = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
        # a window's anchor recurs if (hash, row) is in the lists
        mixed = h.view(np.uint64) ^ mix64(of.astype(np.uint64) + np.uint64(1))
        order = np.argsort(mixed)
        h, to, of, mixed = h[order], to[order], of[order], mixed[order]
        mine = g[anchor].view(np.int64)
        at = np.minimum(np.searchsorted(mixed, mine.view(np.uint64) ^ mix64(row.astype(np.uint64) + np.uint64(1))), max(0, len(h) - 1))
        ok = (h[at] == mine) & (of[at] == row) if len(h) else np.zeros(len(mine), bool)
        shard = np.where(ok, to[at], -1) if len(h) else np.full(len(mine), -1)
        data, out = raw.tobytes(), []
        new = np.ones(len(starts), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(starts)) - 1
        lead, last = lead[shard[lead] >= 0], last[shard[lead] >= 0]
        for w, v in zip(lead.tolist(), last.tolist()):
            s, r = int(shard[w]), row[w]
            for i in range(int(starts[w]), int(starts[v]) + 1, STRETCH):
                j = min(i + STRETCH - 1, int(starts[v])) + window
                out.append((s, doc[r], key[r], i - first[r], j - i, data[start[i] : end[j - 1]]))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return found.mapInArrow(run, "shard long, doc long, text_key long, start long, n long, words binary")


class Chunk:
    """The stretches (document, text, start, words) of a shard or of a chunk of it, and their windows."""

    def __init__(self, rows: list[tuple], window: int):
        self.window, self.blobs = window, [r[3] for r in rows]
        batch = pa.record_batch([pa.array(self.blobs, pa.binary()).cast(pa.string())], ["text"])
        _, _, _, self.hashes, self.first = word_table(batch)
        row = np.repeat(np.arange(len(rows)), np.diff(self.first))
        low = np.arange(max(0, len(row) - window + 1))
        self.low = low[row[low] == row[low + window - 1]] if len(low) else low
        doc, key, begin = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        at = row[self.low]
        self.doc, self.key, self.begin = doc[at], key[at], begin[at]
        self.pos = self.begin + self.low - self.first[at]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, digest, first window, number of places) of each distinct window."""
        a, b = gram_hash(self.hashes, self.window)[self.low], gram_hash(self.hashes, self.window, _SECOND)[self.low]
        order = np.lexsort((self.pos, self.doc, b, a))
        a, b, doc, pos = a[order], b[order], self.doc[order], self.pos[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = new.copy()
        place[1:] |= (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])  # rows that repeat an id share places
        lead = np.flatnonzero(new)
        return a[new].view(np.int64), b[new].view(np.int64), order[lead], np.add.reduceat(place.astype(np.int64), lead) if len(lead) else lead

    def numbered(self) -> tuple[list[int], dict[bytes, int]]:
        """The words in a row as numbers, and the dictionary of them."""
        number: dict[bytes, int] = {}
        return [number.setdefault(w, len(number)) for blob in self.blobs for w in blob.split()], number

    def repeats(self, patterns: list[tuple[int, int, tuple]], words: list[int]) -> list[tuple]:
        """Runs of words covered by repeated windows. A pattern is its first document and start, and its words' numbers."""
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (_, _, key) in enumerate(patterns):
            found.add_word(key, i)
        if not len(found):
            return []
        found.make_automaton()
        hits = np.fromiter((x for hit in found.iter(tuple(words)) for x in hit), np.int64).reshape(-1, 2)
        window_at = np.full(len(words) + 1, -1)
        window_at[self.low] = np.arange(len(self.low))
        at = window_at[hits[:, 0] - self.window + 1]
        at, pattern = at[at >= 0], hits[at >= 0, 1]  # a hit from one stretch into the next is none
        doc, pos = (np.array([x[i] for x in patterns], np.int64)[pattern] for i in (0, 1))
        at = at[(self.doc[at] != doc) | (self.pos[at] != pos)]
        return covered(self.doc[at], self.key[at], self.pos[at], self.window)


def covered(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, window: int) -> list[tuple]:
    """Runs of overlapping windows as (document, text, first word, last word + 1)."""
    if not len(doc):
        return []
    order = np.lexsort((pos, key, doc))
    doc, key, pos = doc[order], key[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (pos[1:] > pos[:-1] + window)
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(doc)) - 1
    return list(zip(doc[lead].tolist(), key[lead].tolist(), pos[lead].tolist(), (pos[last] + window).tolist()))


def groups(batches, keys: int):
    """(key, rows) of runs of equal first `keys` columns in sorted batches."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


_FOUND = ["shard", "a", "b", "n", "doc", "text_key", "start", "lo", "hi"]


def locate(dealt: DataFrame, window: int) -> DataFrame:
    """Rows (shard, chunk, chunks, doc, text_key, start, words), sorted: repeated runs of whole shards, and the distinct windows of chunks."""

    def run(batches):
        tenant("substring_dedup")
        for (shard, _, chunks), rows in groups(batches, 3):
            chunk = Chunk(rows, window)
            a, b, lead, n = chunk.distinct()
            if chunks > 1:
                cols = [np.full(len(a), shard), a, b, n, chunk.doc[lead], chunk.key[lead], chunk.begin[lead], chunk.pos[lead], chunk.pos[lead] + window]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], _FOUND)
            else:
                words, _ = chunk.numbered()
                at = chunk.low[lead[n > 1]].tolist()
                patterns = [(d, p, tuple(words[i : i + window])) for d, p, i in zip(chunk.doc[lead[n > 1]].tolist(), chunk.pos[lead[n > 1]].tolist(), at)]
                out = [(shard, None, None, None, d, k, None, lo, hi) for d, k, lo, hi in chunk.repeats(patterns, words)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(9)], _FOUND)

    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in _FOUND))


def chunked(firsts: DataFrame, cut: DataFrame, sizes: DataFrame, window: int, patterns: int) -> DataFrame:
    """(doc, text_key, lo, hi): repeated runs of shards that are dealt in chunks, from the distinct windows of the chunks."""
    first = F.min(F.struct("doc", "lo", "text_key", "start")).alias("first")
    recurring = firsts.groupBy("shard", "a", "b").agg(first, F.sum("n").alias("n")).filter("n > 1")
    recurring = stash(recurring.select("shard", "a", "b", "first.*"), "recurring")
    parts = recurring.groupBy("shard").agg(F.ceil(F.count("*") / patterns).cast("long").alias("parts"))
    sizes = stash(sizes.join(parts, "shard"), "grid")
    own = recurring.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("a", "b"), "parts"))
    own = own.groupBy("shard", "doc", "text_key", "start", "chunks").agg(F.collect_list(F.struct("lo", "part")).alias("picked"))  # windows of one stretch

    def pick(batches):
        for batch in batches:
            out = []
            for shard, chunks, doc, start, words, picked in zip(*(c.to_pylist() for c in batch.columns)):
                words = words.split()
                out += [(shard, x["part"], chunks, doc, x["lo"], b" ".join(words[x["lo"] - start : x["lo"] - start + window])) for x in picked]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i == 5 else pa.int64()) for i in range(6)], ["shard", "part", "chunks", "doc", "start", "words"])

    chosen = cut.drop("n").join(own, ["shard", "doc", "text_key", "start"]).select("shard", "chunks", "doc", "start", "words", "picked")
    chosen = stash(chosen.mapInArrow(pick, "shard long, part long, chunks long, doc long, start long, words binary"), "patterns")
    left = chosen.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).select("shard", "part", "chunk", F.lit(0).alias("kind"), "doc", F.lit(0).cast("long").alias("text_key"), "start", "words")
    right = cut.join(sizes, "shard").withColumn("chunk", chunk_of()).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    right = right.select("shard", "part", "chunk", F.lit(1).alias("kind"), "doc", "text_key", "start", "words")
    keys = ["shard", "part", "chunk"]

    def run(batches):
        tenant("substring_dedup")
        for _, rows in groups(batches, 3):
            own = [r[1:] for r in rows if r[0]]
            if own:
                chunk = Chunk(own, window)
                words, number = chunk.numbered()
                keys = [(r[1], r[3], [number.get(w) for w in r[4].split()]) for r in rows if not r[0]]
                out = chunk.repeats([(d, p, tuple(k)) for d, p, k in keys if None not in k], words)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["doc", "text_key", "lo", "hi"])

    met = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(run, "doc long, text_key long, lo long, hi long")


def chunk_of() -> F.Column:
    return F.pmod(F.xxhash64("doc", "start"), F.col("chunks"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, phrases: int = PHRASES, chunk: int = CHUNK, patterns: int = PATTERNS) -> DataFrame:
    """(doc, text_key, lo, hi): words lo to hi - 1 of a document that repeated windows cover. `docs` has doc and text."""
    docs = docs.filter("doc is not null and text is not null")
    seen = occurrences(docs, window)
    known = seen.groupBy("h").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min("doc").alias("src")).filter("n > 1 or twice")
    known = stash(known.select("h", "src"), "anchors")
    shards = max(1, math.ceil(known.count() / phrases))
    wide = known.groupBy("src").agg(F.ceil(F.count("*") / phrases).cast("long").alias("split")).filter("split > 1")
    shard = F.pmod(F.xxhash64("src", F.coalesce(F.pmod("h", "split"), F.lit(0).cast("long"))), F.lit(shards)).alias("shard")
    lists = seen.select("h", "doc").join(known.join(wide, "src", "left").select("h", shard), "h").groupBy("doc").agg(F.collect_list(F.struct("h", "shard")).alias("anchors"))  # at most the anchors of one document

    def pack(part: pa.RecordBatch) -> dict:
        engine = zstandard.ZstdCompressor(level=1)
        return {"packed": [engine.compress(x.encode()) for x in texts(part)]}

    packed = with_arrow(docs.select("doc", "text", F.xxhash64("text").alias("text_key")), [("packed", T.BinaryType())], pack, ["doc", "text_key"])
    found = packed.join(lists, "doc").select("doc", "packed", "text_key", "anchors")
    cut = stash(stretches(found, window), "stretches")
    discard(known)
    sizes = stash(cut.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / chunk)).cast("long").alias("chunks")), "sizes")
    dealt = cut.join(sizes, "shard").withColumn("chunk", chunk_of())
    dealt = dealt.select("shard", "chunk", "chunks", "doc", "text_key", "start", "words").repartition("shard", "chunk").sortWithinPartitions("shard", "chunk")
    got = stash(locate(dealt, window), "located")
    out = got.filter("a is null").select("doc", "text_key", "lo", "hi")
    firsts = got.filter("a is not null")
    return out if firsts.isEmpty() else out.unionByName(chunked(firsts, cut, sizes.filter("chunks > 1"), window, patterns))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", phrases: int = PHRASES, chunk: int = CHUNK, patterns: int = PATTERNS) -> DataFrame:
    """`docs` with the words that repeat removed from the text (words joined by one space), plus n_words (before) and n_removed."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    gone, doc, key = (fresh(x, docs) for x in ("__gone", "__doc", "__key"))
    ranges = repeated_ranges(own, window, phrases, chunk, patterns).groupBy("doc", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias(gone))  # ranges of one document
    ranges = ranges.select(F.col("doc").alias(doc), F.col("text_key").alias(key), gone)
    joined = docs.join(ranges, (docs[id_col].cast("long") == ranges[doc]) & (F.xxhash64(docs[text_col]) == ranges[key]), "left")

    def make(part: pa.RecordBatch) -> dict:
        out, total, removed = [], [], []
        for text, found in zip(texts(part, text_col), part.column(part.schema.get_field_index(gone)).to_pylist()):
            words = text.encode().split()
            total.append(len(words))
            if found:
                keep = np.ones(len(words), bool)
                for r in found:
                    keep[r["lo"] : r["hi"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            removed.append(total[-1] - len(words))
            out.append(b" ".join(words).decode())
        return {text_col: out, "n_words": total, "n_removed": removed}

    keep = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return with_arrow(joined, [(text_col, T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())], make, keep, text_col)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
