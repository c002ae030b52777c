import hashlib
import math

from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import digest as d


def scramble(x):
    """splitmix64's finaliser, one number at a time."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_digest(raw):
    """The digest from its description: counts of hashed triplets, their quartiles, the length."""
    counts = [0] * 256
    for i in range(len(raw) - 2):
        pair = scramble((raw[i] * 256 + raw[i + 1] + 0x51ED2701) % 2**64) % 256
        counts[scramble((pair * 256 + raw[i + 2] + 0x7F4A7C15) % 2**64) % 256] += 1
    ranked = sorted(counts)
    quartiles = (ranked[63], ranked[127], ranked[191])
    bits = "".join(f"{sum(c > q for q in quartiles):02b}" for c in counts)
    return f"{min(255, round(math.log(len(raw) + 1) * 8)):02x}" + f"{int(bits, 2):0128x}"


def plain_likeness(a, b):
    """1 minus the share of the largest difference: 6 for each bucket and 32 for the length."""
    two = lambda d: [int(c, 16) >> s & 3 for c in d[2:] for s in (2, 0)]
    steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(two(a), two(b)))
    return 1 - (steps + min(32, abs(int(a[:2], 16) - int(b[:2], 16)))) / (256 * 6 + 32)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = (plain_digest(x.encode()) for x in (text, new, following))
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def test_against_brute_force(spark):
    rows = [(i * 3, ["", None, "é" * i, "some words of text " * i, "x"][i % 5]) for i in range(40)]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, head string").repartition(5)
    assert sorted(tuple(r) for r in d.compare_with_next(df).collect()) == brute(rows)
    one = df.filter("doc_id = 9")
    assert [tuple(r) for r in d.compare_with_next(one).collect()] == brute([(9, rows[3][1])])
    assert d.compare_with_next(df.limit(0)).count() == 0


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_bounds(a, b):
    x, y = d.digest(a), d.digest(b)
    assert len(x) == 130 and 0 <= d.difference(x, y) <= d.BOUND and d.difference(x, y) == d.difference(y, x)
    assert d.likeness(x, d.digest(bytes(a))) == 1.0


def test_near_texts_are_nearer():
    text = " ".join(f"word{i * 7919 % 613}" for i in range(400))
    near = text.replace("word5", "term5", 3)
    far = " ".join(f"chose{i * 31 % 977}q" for i in range(400))
    a = d.digest(text.encode())
    assert d.likeness(a, d.digest(near.encode())) > 0.9 > d.likeness(a, d.digest(far.encode()))


def test_operator(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in d.fingerprint_documents(df).collect()}
    assert got[1] == got[3] != got[2]


def test_null_and_repeated_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.CHUNK_BYTES", 50)
    rows = [(None, "no id"), (None, None), (3, "same"), (3, "same"), (3, "another"), (1, "word é " * 40_000), (2, ""), (9, "🙂" * 7)]
    got = d.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_query(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    assert sorted(tuple(r) for r in d.op9_document_fingerprints(spark, sf).collect()) == brute(list(zip(*(c.to_pylist() for c in t.columns))))
