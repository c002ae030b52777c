"""Operator 9, document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte triplet of the UTF-8 text is hashed into one of 256 buckets. The digest is 130 hex digits: two for the length on a
logarithmic scale, then two bits for each bucket, the quarter of the document's own bucket counts in which its count lies. Two
digests differ by the steps between bucket quarters (an opposite quarter counts double) and between lengths; the difference is
bounded, and likeness is one minus its share of the bound.

The query compares each document with its own edited text and with the next document. Rows are range-partitioned and sorted by id
once; inside a partition a row meets the next one as the stream goes by, so texts are shuffled a single time. The first and last
row of each partition are kept aside (two rows for each partition) and joined by partition number afterwards.

Defined results: null text = empty text; equal texts have equal digests; texts under 3 bytes have no triplet and a digest of
their length alone; rows with the same id follow each other in the order of their texts; null ids come first, as Spark sorts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, pieces, stash, table, texts, with_arrow

BUCKETS = 256
#: Most that lengths add to a difference.
LENGTH_MOST = 32
#: What a bucket adds when its quarters are 0, 1, 2 or 3 apart.
_STEP = np.array([0, 1, 2, 6], np.int64)
BOUND = BUCKETS * int(_STEP[-1]) + LENGTH_MOST
_BLOCK = 1 << 20
_HASH = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED2701)).astype(np.uint8)
_HASH2 = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x7F4A7C15)).astype(np.uint8)


def _counts(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(0, len(raw) - 2), _BLOCK):
        part = raw[i : i + _BLOCK + 2]
        pair = part[:-2].astype(np.uint16) << 8 | part[1:-1]
        total += np.bincount(_HASH2[_HASH[pair].astype(np.uint16) << 8 | part[2:]], minlength=BUCKETS)
    return total


def digest(raw: bytes) -> str:
    """130 hex digits for the bytes of a text."""
    data = np.frombuffer(raw, np.uint8)
    counts = _counts(data)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quarter = np.searchsorted(q, counts, side="left").astype(np.uint8).reshape(-1, 4)
    packed = quarter[:, 0] << 6 | quarter[:, 1] << 4 | quarter[:, 2] << 2 | quarter[:, 3]
    length = min(255, round(math.log(len(raw) + 1) * 8))
    return f"{length:02x}" + packed.tobytes().hex()


def _quarters(d: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(d[2:]), np.uint8)
    return np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1).ravel().astype(np.int64)


def difference(a: str, b: str) -> int:
    """0 for equal digests, BOUND at most."""
    if a == b:
        return 0
    steps = int(_STEP[np.abs(_quarters(a) - _quarters(b))].sum())
    return steps + min(LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    return 1.0 - difference(a, b) / BOUND


def fingerprint_documents(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with its digest in the column fingerprint."""
    return with_arrow(docs, [("fingerprint", T.StringType())], lambda part: {"fingerprint": [digest(x.encode()) for x in texts(part, text_col)]}, keep, text_col)


def edited(text: str, following: str) -> str:
    """`text` whose last half (rounded down) gives way to the start of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, own: str, other: str | None, following: str) -> tuple:
    new = edited(text, following)
    raw = new.encode()
    there = digest(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), own, there, likeness(own, there), likeness(own, other)


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def compare_with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: its digest, that of its edited text, and likeness to that and to the next document."""
    schema = _FIELDS + ", part int, head string, tail string"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last = None  # (id, text, digest) of the row before
        first = True
        for batch in (part for b in batches for part in pieces(b, "text")):
            rows, head = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                own = digest(text.encode())
                if first:
                    head = [(doc, text)]
                    first = False
                if last is not None:
                    rows.append(_row(*last, own, text))
                last = (doc, text, own)
            cols = [list(c) for c in zip(*rows)] or [[] for _ in _NAMES]
            n = len(rows)
            yield _batch(cols, [part] * n, [None] * n, [None] * n)
            for _, text in head:
                yield _batch([[None]] * len(_NAMES), [part], [text], [None])
        if last is not None:
            doc, text, own = last
            yield _batch([[doc], [len(text)], [None], [own], [None], [None], [None]], [part], [None], [text])

    def _batch(cols, part, head, tail):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, part, head, tail], kinds)], [*_NAMES, "part", "head", "tail"])

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = stash(dealt.mapInArrow(run, schema), "digests")
    heads = made.filter("head is not null").select("part", F.col("head").alias("next_text"))
    tails = made.filter("tail is not null").select("part", "doc_id", "tail")
    # two rows for each partition; a partition's successor is the next one that has rows, the last is followed by the first
    spots = [r.part for r in heads.select("part").orderBy("part").collect()]
    after = dict(zip(spots, spots[1:] + spots[:1]))
    if not after:
        return made.select(*_NAMES)
    turn = docs.sparkSession.createDataFrame(list(after.items()), "part int, next int")
    ends = tails.join(turn, "part").select("doc_id", "tail", F.col("next").alias("part")).join(heads, "part")

    def close(batches):
        for batch in batches:
            rows = []
            for doc, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append(_row(doc, text, digest(text.encode()), digest(following.encode()), following))
            cols = [list(c) for c in zip(*rows)] or [[] for _ in _NAMES]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)

    closed = ends.select("doc_id", "tail", "next_text").mapInArrow(close, _FIELDS)
    return made.filter("head is null and tail is null").select(*_NAMES).unionByName(closed)


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
