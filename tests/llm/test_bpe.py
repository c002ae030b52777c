import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

REAL = Tokenizer.from_file(bpe.public_vocabulary())
OWN = bpe.Vocabulary(__import__("json").load(open(bpe.public_vocabulary(), encoding="utf-8")))
CASES = ["", " ", "Hello, world!  it's 123", "ΣΑΣ ΟΔΟΣ İstanbul ﬁn", "a\x1cb\x85c　d", "é́x", "x<|endoftext|>Y<|startoftext|><|endo", "\0<|endoftext|>\0a", "🙂🙂 àéîõü", "w" * 5000 + "!" * 40, "don't I'LL we'd", "ab" * 17, ":\U0003d000 \u0558a"]


def same(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OWN.decode(got) == REAL.decode(want, skip_special_tokens=False)


def test_cases():
    for x in CASES:
        same(x)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeinrst'é1 !ΣßIİ", max_size=80))
def test_equal_to_library(text):
    same(text)


def test_long_and_short_trees_agree():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 17, 32):
        word = bytes(rng.choice(list(b"aehinorst"), n))
        assert OWN.encode_batch([b'x', word, b'the'])[0][1:-1].tolist() == OWN.encode_long(word)


def test_documents(spark):
    rows = [(i, x, "k") for i, x in enumerate([*CASES, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(df, bpe.public_vocabulary()), bpe.public_vocabulary()).collect()}
    assert len(got) == len(rows)
    for i, x, _ in rows:
        ids = REAL.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and list(got[i].ids) == ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        plain = REAL.decode(ids, skip_special_tokens=False)
        assert got[i].decoded == plain and got[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), bpe.public_vocabulary()).count() == 0
