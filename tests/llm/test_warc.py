import base64
import gzip
import hashlib
import io

from tidemark.llm import warc


def expected(rows):
    low = {}
    for i, h in rows:
        low[h or ""] = min(i, low.get(h or "", i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        own = low[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own == i else "revisit", None if own == i else own))
    return sorted(out)


def test_round_trip(spark, tmp_path, monkeypatch):
    magic = "\x1f‹\x08"
    rows = [(i, ["<p>é</p>", None, "", magic * 50, f"<b>{i}</b>\r\n\r\n" * 300][i % 5]) for i in range(120)]
    df = spark.createDataFrame([(i, f"http://x/{i}\n", h, "z") for i, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    monkeypatch.setattr(warc, "ARCHIVE", 5000)
    out = warc.write_archives(warc.planned(df), f"file://{tmp_path}/a").collect()
    assert sum(r.records for r in out) == len(rows)
    paths = spark.createDataFrame(out)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for width in (97, 4 << 20):  # ranges far smaller than a record, and one range for all
        got = warc.read_archives(spark, paths, width)
        assert sorted(tuple(r) for r in got.select(*names).collect()) == expected(rows)
    body = {r.page_id: bytes(r.payload) for r in got.filter("record_type = 'response'").collect()}
    assert all(body[i] == (h or "").encode() for i, h in rows if i in body)
    for r in out:  # each archive is also one whole gzip stream
        assert gzip.decompress(open(r.path.removeprefix("file://"), "rb").read()).count(b"WARC/1.1\r\n") == r.records


def test_false_magic_is_passed_over():
    member = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    noise = b"ab" + warc.MAGIC + b"\x00" * 20 + gzip.compress(b"not a record") + warc.MAGIC
    raw = noise + member + noise + member[:-9]
    got = list(warc.read_range(io.BytesIO(raw), 0, len(raw)))
    assert [at for at, *_ in got] == [len(noise)] and got[0][2].endswith(b"payload")
    assert list(warc.read_range(io.BytesIO(raw), len(noise) + 1, len(raw))) == []


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.planned(df, least=3).collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert warc.planned(df.limit(0)).count() == 0


def test_null_and_repeated_ids_and_long_payloads(spark, tmp_path):
    long = "<p>é</p>" * 300_000
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (7, long), (8, long), (9, None), (10, "")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    out = warc.write_archives(warc.planned(df), f"file://{tmp_path}/a").collect()
    got = warc.read_archives(spark, spark.createDataFrame(out), 1 << 16).collect()
    kinds = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to or 0) for r in got)
    n = len(long.encode())
    assert kinds == [(0, 1, "response", 0), (0, 1, "revisit", 1), (1, 1, "response", 0), (1, 1, "response", 0), (1, 1, "response", 0), (2, 1, "revisit", 1), (7, n, "response", 0), (8, n, "revisit", 7), (9, 0, "response", 0), (10, 0, "revisit", 9)]
    a, b = (warc.record(1, "u", x, warc.base32_sha1(x), None) for x in (b"a", b"b"))
    name = lambda m: gzip.decompress(m).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0]
    assert name(a) != name(b)


def test_query(spark):
    got = {r.page_id: r for r in warc.op4_warc(spark, "/root/testdata/sf0.001").collect()}
    pages = {r.page_id: r.html or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert got.keys() == pages.keys() and all(got[i].payload_bytes == len(h.encode()) for i, h in pages.items())
    assert warc.read_archives(spark, spark.createDataFrame([], "path string, bytes long, records long")).count() == 0
