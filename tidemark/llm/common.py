"""Small helpers that the operators of this subpackage share: tables, shared storage, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text handled at once inside a task, in bytes; a longer document is handled alone.
CHUNK_BYTES = 2_000_000
#: The ASCII white space of the contracts, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (names differ by more than case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- tables in shared storage ----------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that setting is absent, a local session (tests) gets a temporary folder; on a cluster that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_kept: dict[str, SparkSession] = {}


def stash(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` as Parquet (in a folder for each value of `by`) into the shared folder and read it back: cuts lineage, survives lost executors.

    `discard` deletes it once all that reads it is written; what is left goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out], _kept[path] = path, spark
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's Python ends."""
    _kept[path] = spark


def discard(*frames: DataFrame) -> None:
    """Delete the folders of tables that `stash` wrote; nothing may read them afterwards."""
    for df in frames:
        path = _paths.pop(df, None)
        if path and _kept.pop(path, None):
            delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    while _kept:
        path, spark = _kept.popitem()
        try:
            delete(spark, path)
        except Exception:  # the session has ended before; its folder is the user's to clear
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose `text` column has about `limit` bytes at most (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    lengths = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_arrow(
    df: DataFrame,
    new: list[tuple[str, T.DataType]],
    make: Callable[[pa.RecordBatch], dict],
    keep: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Add (or replace) columns computed batch by batch from Arrow data.

    `keep` names the input columns that stay (all when None); a new column replaces one of the same name in place.
    `make` gets slices of bounded text size and returns one sequence for each new column.
    """
    names = {n for n, _ in new}
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    fields, types = [], dict(new)
    for f in kept:
        fields.append(T.StructField(f.name, types[f.name], True) if f.name in names else f)
    fields += [T.StructField(n, t, True) for n, t in new if n not in {f.name for f in kept}]
    schema = T.StructType(fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces(batch, text):
                got = make(part)
                cols = []
                for f in arrow:
                    if f.name in names:
                        v = got[f.name]
                        cols.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type))
                    else:
                        cols.append(part.column(part.schema.get_field_index(f.name)).cast(f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


# --- caches of Python workers ----------------------------------------------------------------------------------

_tenant: dict[str, Callable[[], None]] = {}


def tenant(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """Note whose caches a Python worker holds. Workers outlive stages: a new operator's first call drops the last one's."""
    if name not in _tenant:
        for other in _tenant.values():
            other()
        _tenant.clear()
        _tenant[name] = drop
        release()


def release() -> None:
    """Hand freed memory back to the system, as executors share theirs with their Python workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


# --- word hashes, for a whole slice of documents at once -------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words above this length are hashed one by one.
_LONG_WORD = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64), wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_table(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of every text of a slice, as arrays.

    Returns (bytes of all texts, word starts, word ends, 64-bit word hashes, first word of each row and one past the last).
    A word's hash depends on its bytes only: eight bytes at a time go through a mixing function, words above _LONG_WORD bytes
    through XXH3. Null texts have no words. Besides the texts, a word takes about 40 bytes here, a byte of text 3.
    """
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return raw, z, z, np.zeros(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    solid = ~_SPACE[raw]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, ~solid[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True  # a word never runs over into the next text
    starts = np.flatnonzero(solid & edge)
    edge[:-1], edge[-1] = edge[1:] | ~solid[1:], True
    ends = np.flatnonzero(solid & edge) + 1
    return raw, starts, ends, word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(raw) + 1, 8), (1, 1))
    at = np.flatnonzero(size <= _LONG_WORD)
    done = 0
    while len(at):
        block = np.ascontiguousarray(eight[starts[at] + done]).view("<u8")[:, 0]
        left = size[at] - done
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[at] = mix64(out[at] * np.uint64(0xD1342543DE82EF95) + block)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), 42)
    return out


def gram_hash(hashes: np.ndarray, k: int, odd: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (length n - k + 1), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    block, width = hashes, 1
    rest = k
    while rest:
        if rest & 1:
            part = block[have : have + n]
            if out is None:
                out = part.copy()
            else:
                out = out * np.uint64(pow(odd, width, 1 << 64)) + part
            have += width
        rest >>= 1
        if rest:
            m = len(block) - width
            block = block[:m] * np.uint64(pow(odd, width, 1 << 64)) + block[width : width + m]
            width *= 2
    return mix64(out)
