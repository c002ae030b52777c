"""The columns of the registered queries against the brute-force versions of their operators, on the driver's smallest tables."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm import test_simhash, test_substring_dedup
from tidemark.llm import bpe, language_id, mixing, registry, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source", "lang"])
    return list(zip(*(c.to_pylist() for c in t.columns)))


def test_op2(spark, docs):
    got = sorted(tuple(r)[:4] for r in substring_dedup.op2_substring_dedup(spark, SF).collect())
    assert got == sorted((d, n, gone, sha(kept)) for d, n, gone, kept in test_substring_dedup.brute([r[:2] for r in docs]))


def test_op5(spark, docs):
    real = Tokenizer.from_file(bpe.public_vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5_bpe(spark, SF).collect()}
    for d, text, *_ in docs:
        ids = real.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(real.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(docs)


def test_op6(spark, docs):
    got = {r.doc_id: r for r in mixing.op6_mixing(spark, SF).collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in docs}
    total: dict = {}
    for d, _, s, _ in docs:
        total[s] = total.get(s, 0) + size[d]
    assert len(got) == len(docs)
    for d, _, s, _ in docs:
        assert (got[d]["size"], got[d].source_size) == (size[d], total[s]) and 0 <= got[d].taken <= 2 * size[d] and got[d].target <= 2 * total[s] + 1e-6
    for s in total:
        own = [got[d] for d, _, x, _ in docs if x == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert abs(sum({s: got[d].target for d, _, s, _ in docs}.values()) - 1.5 * sum(size.values())) < 1e-3
    again = {r.doc_id: tuple(r) for r in mixing.op6_mixing(spark, SF).collect()}
    assert again == {d: tuple(r) for d, r in got.items()}


def test_op7(spark, docs):
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    right = 0
    for d, text, _, lang in docs:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        right += r.lang_pred == lang or lang is None or r.lang_pred == "und"
    assert right >= 0.97 * len(docs)


def test_op8(spark, docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, SF).collect())
    assert got == sorted((d, fp if isinstance(fp, str) else f"{fp:016x}", c) for d, fp, c in test_simhash.brute([r[:2] for r in docs]))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.MODULES) == list(range(1, 14))
    assert all(callable(registry.query(n)) for n in registry.MODULES)
