"""Operator 4, WARC: a writer of gzip-per-record archives and a splittable reader.

The writer gives each page a record; of equal payloads only the one with the smallest page_id is a response, the others revisit
it. Every task writes archives of bounded size into a folder of all executors under a temporary name and moves them into place
when they are whole, so a task that runs again only replaces its own files.

The reader splits archives into byte ranges. A task scans its range for the gzip magic, validates each candidate by decoding the
member's header and the start of a WARC record, and owns the records that start inside its range; a record may end in the next
one. So a range needs nothing from the tasks before it, and a large archive is read by many.

Storage is reached through pyarrow.fs (local or mounted folders, HDFS, S3, GCS) by URI.

Defined results: null html is an empty payload; null page_ids sort after all others and write page-null in their record; pages
that repeat an id get a record each, a response where id and payload are the owner's, and a record's own id follows from page_id
and payload; an empty table gives no archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shared_dir, stash, table, tenant

MAGIC = b"\x1f\x8b\x08"
#: Bytes of one archive at most (a larger record stands alone), of one read range, and of one step of a scan.
ARCHIVE, RANGE, STEP = 16 << 20, 4 << 20, 1 << 20
MOST_TASKS = 100_000
#: Payloads of fewer bytes are always responses.
LEAST = 0
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, start long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    uri = uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}"
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with one WARC/1.1 record, the same bytes each time."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload if refers_to is None else http  # a revisit leaves the payload out
    heads = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "X-Page-ID": "null" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        heads["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        heads["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}/{digest}')}>"
        heads["X-Refers-To-Page-ID"] = str(refers_to)
    heads["Content-Length"] = str(len(body))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads.items()) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def planned(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): the record each page gets.

    The owner of a payload is found by a pre-aggregated minimum; only payloads with several pages are joined back, as a plain
    sort-merge join that adaptive execution splits where one payload has many pages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    own = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    own = stash(own, "payload-owners")
    light = rows.select("page_id", "digest").distinct().join(own, "digest").filter("page_id is null or page_id <> owner").select("page_id", F.col("digest").alias("d"), F.col("owner").alias("refers_to"))
    return rows.join(light.withColumnRenamed("page_id", "p"), (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write the records of `planned` into `folder`; (path, bytes, records) of every archive."""

    def run(batches):
        from pyspark import TaskContext

        tenant("warc")
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        buf, n, k, done = io.BytesIO(), 0, 0, []

        def close():
            nonlocal buf, n, k
            if n:
                name = f"part-{part:06d}-{k:05d}.warc.gz"
                temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary, compression=None) as out:
                    out.write(buf.getvalue())
                store.move(temporary, f"{base}/{name}")
                done.append((f"{folder}/{name}", buf.tell(), n))
                buf, n, k = io.BytesIO(), 0, k + 1

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                member = record(page, url, html.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                if n and buf.tell() + len(member) > ARCHIVE:
                    close()
                buf.write(member)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return plan.mapInArrow(run, "path string, bytes long, records long")


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Headers of one record, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return fields, rest[: int(fields.get("Content-Length", 0))]


def _valid(prefix: bytes) -> bool:
    """Whether bytes that begin with the magic are a gzip member that holds a WARC record."""
    if len(prefix) < 10 or prefix[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(prefix, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _next_magic(source, at: int, stop: int) -> int:
    """The first place in [at, stop) where the gzip magic stands, or stop."""
    while at < stop:
        source.seek(at)
        window = source.read(min(STEP, stop - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit >= 0:
            return min(stop, at + hit)
        at += STEP
    return stop


def read_range(source, start: int, stop: int):
    """(offset, headers, block) of the records that start in [start, stop) of a seekable file."""
    at = start
    while at < stop:
        source.seek(at)
        chunk = source.read(4096)
        if not chunk.startswith(MAGIC):  # only where no record follows on the last one
            at = _next_magic(source, at, stop)
            continue
        if not _valid(chunk):
            at += 1
            continue
        engine, out, used = zlib.decompressobj(31), [], 0
        try:
            while chunk and not engine.eof:
                out.append(engine.decompress(chunk))
                used += len(chunk)
                if not engine.eof:
                    chunk = source.read(1 << 14)
        except zlib.error:
            at += 1
            continue
        if not engine.eof:  # cut short: not a whole member
            at += 1
            continue
        yield at, *parse(b"".join(out))
        at += used - len(engine.unused_data)


def read_archives(spark, paths: DataFrame, width: int = RANGE, payloads: bool = True) -> DataFrame:
    """Records of the archives in `paths` (path, bytes), one row each; a revisit carries what its headers say of the payload."""
    ranges = paths.select("path", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {width}L)")).alias("start"), "bytes")
    # as many tasks as ranges, up to a limit: rows of ranges are tiny, so their own size says nothing of the work
    total = paths.agg(F.sum(F.ceil(F.col("bytes") / width))).first()[0] or 1
    ranges = ranges.repartition(int(min(total, MOST_TASKS)), "path", "start")

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in _FIELDS.split(", ")]

        def give(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        def number(x):
            return int(x) if x and x.lstrip("-").isdigit() else None

        for batch in batches:
            for path, start, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, name = _open(path)
                rows, held = [], 0
                with store.open_input_file(name) as source:
                    for at, head, block in read_range(source, start, min(start + width, size)):
                        kind = head.get("WARC-Type", "")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None:  # from what was read, not from what the header says
                            length, sha = len(payload), base32_sha1(payload)
                        else:
                            length, sha = number(head.get("X-Payload-Length")), head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        rows.append((number(head.get("X-Page-ID")), length, sha, kind, number(head.get("X-Refers-To-Page-ID")), head.get("WARC-Target-URI"), payload if payloads else None, path, at))
                        held += len(block)
                        if held > 8 << 20:
                            yield give(rows)
                            rows, held = [], 0
                yield give(rows)

    return ranges.mapInArrow(run, _FIELDS)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    forget(spark, folder)
    archives = stash(write_archives(planned(table(spark, sf_dir, "pages")), folder), "archives")
    return read_archives(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT h, min(page_id) AS owner, sha1(h) AS hex, octet_length(encode(h)) AS n FROM p GROUP BY h),
b AS (SELECT h, owner, n, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS digest FROM d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN p.page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN b USING (h)
"""
