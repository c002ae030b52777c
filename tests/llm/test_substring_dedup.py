import hashlib
import random
import re

import pyarrow as pa

from tidemark.llm import substring_dedup as sd
from tidemark.llm.common import gram_hash, word_table


def brute(rows, window=20):
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            else:
                seen[k] = (doc, i)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return out


def sample(n=160):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ß.", "x" * 60]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [words(k) for k in (20, 21, 33, 60, 150)]
    rows = []
    for i in range(n):
        w = words(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randint(5, 80)] + words(rng.randint(0, 5))
        if i % 17 == 0:
            w += w
        if i % 19 == 0:
            w = ["a"] * 70
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[5][1]), (n + 3, "a " * 19)]


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(a, b, "s", 3) for a, b in rows], "doc_id long, text string, src string, n_words int").repartition(4)
    want = brute(rows)
    for phrases, chunk, patterns in ((4096, 65_536, 9999), (20, 300, 100)):  # one automaton; many shards, dealt in chunks and parts
        got = sd.dedup_substrings(df, phrases=phrases, chunk=chunk, patterns=patterns).select("doc_id", "n_words", "n_removed", "text").collect()
        assert sorted(tuple(r) for r in got) == want
    assert sd.dedup_substrings(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    long = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.dedup_substrings(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 40)]


def test_word_table():
    rows = ["ab  cd\tab", None, "", "cd", " ab\x0b", "é ab"]
    raw, start, end, hashes, first = word_table(pa.record_batch([pa.array(rows, pa.string())], ["text"]))
    words = [raw[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert words == ["ab", "cd", "ab", "cd", "ab", "é", "ab"] and first.tolist() == [0, 3, 3, 3, 4, 5, 7]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    g = gram_hash(hashes, 2)
    assert len(g) == 6 and g[1] == g[3] != g[0] and gram_hash(hashes, 8).tolist() == []


def test_words_are_compared_not_hashes(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # words whose polynomial hashes modulo 2^64 are equal
    start = " ".join(f"u{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{start} {a}"), (2, f"{start} {b}"), (3, f"{start} {a}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.dedup_substrings(df).collect()) == [(1, 0), (2, 0), (3, 20)]


def test_hits_decide(monkeypatch):
    words = [f"w{i}".encode() for i in range(30)]
    chunk = sd.Chunk([(1, 0, 0, b" ".join(words)), (2, 0, 5, b" ".join(words[3:27]))], 20)
    numbers, _ = chunk.numbered()
    a, b, lead, n = chunk.distinct()
    patterns = [(int(chunk.doc[i]), int(chunk.pos[i]), tuple(numbers[chunk.low[i] : chunk.low[i] + 20])) for i in lead[n > 1]]
    assert len(patterns) == 5 and chunk.repeats(patterns, numbers) == [(2, 0, 5, 29)]
    assert chunk.repeats(patterns[1:2], numbers)[0][3] - chunk.repeats(patterns[1:2], numbers)[0][2] == 20 and chunk.repeats([], numbers) == []


def test_one_huge_repeated_document_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 500)
    rng = random.Random(3)
    long = " ".join(f"h{rng.randrange(10**6)}" for _ in range(6000))
    df = spark.createDataFrame([(1, long), (2, "x y " + long), (3, long[: len(long) // 2])], "doc_id long, text string")
    own = df.selectExpr("doc_id as doc", "text")
    known = sd.occurrences(own, 20).groupBy("h").count().count()
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.dedup_substrings(df, phrases=64, chunk=4000, patterns=256).collect()}
    assert known > 600 and got[1] == (6000, 0) and got[2] == (6002, 6000) and got[3][0] - got[3][1] <= 1


def test_clashing_columns(spark):
    text = " ".join(f"u{i}" for i in range(25))
    df = spark.createDataFrame([(1, text, "a", "b", 1), (2, text, None, "d", 2)], "doc_id long, text string, __gone string, __Key string, n_removed int")
    got = {r["doc_id"]: r for r in sd.dedup_substrings(df).collect()}
    assert got[2]["n_removed"] == 25 and got[1]["__gone"] == "a" and got[2]["__Key"] == "d"
