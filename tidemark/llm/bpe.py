"""Operator 5, byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols form a row of leaves; leaf i holds rank * size + i of the pair that starts at symbol i (infinite where the
pair has no merge or the symbol is gone). Every inner node holds the smaller of its children, so the root is the leftmost pair
of lowest rank. A merge changes at most three leaves, each carried to the root in log2(size) steps, until the root is infinite.
Short pre-tokens share the tree levels of a numpy batch (one row for each distinct pre-token); long ones have a tree of their own.

The vocabulary file is read on the driver and its merges go to the executors with the task closure (its size is fixed by the
file: 49k entries). Encoded pre-tokens are kept in a cache of bounded size for each Python worker.

Defined results: null text = empty text = no tokens; ids and rows may repeat; special tokens' strings in a text become their
ids, as in the tokenizers library; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from .common import table, tenant, texts, with_arrow

#: Pre-tokens above this many symbols get their own tree.
LONG = 32
CACHE = 300_000
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the split pattern of the public vocabulary file.
_LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_INF = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a word-end byte-level BPE file, with an encoder of pre-tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + self.end] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.rank_of = dict(zip(key.tolist(), range(len(merges))))
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
        # Latin text needs no property look-ups: there the letters are these, and no digits but 0-9
        self.latin = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f\u2010-\u2027]*")
        self.latin_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9]|[^\t-\r a-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
        self.beyond = regex.compile("[\u0530-\U0010ffff]")  # below this no Unicode version adds characters any more
        self.library = pre_tokenizers.Split(Regex(_LIBRARY_PATTERN), "removed", invert=True)
        #: pre-token -> its ids as bytes, its tokens' text; the older generation is dropped when the newer one is full
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    # -- pre-tokens ------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (a capital sigma never takes its final form)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Words of a normalised text. Characters newer than Python's tables are classed by the library's own splitter."""
        if self.latin.fullmatch(text):
            return self.latin_words.findall(text)
        if self.beyond.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [w for w, _ in self.library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string stays whole."""
        if self.split_special is None or "<|" not in text:
            return self.split(self.normalise(text))
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append("\0" + part)  # no pre-token holds \0 together with letters, so this marks a special one
            elif part:
                out += self.split(self.normalise(part))
        return out

    # -- segment trees ---------------------------------------------------------------------------------------

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode_batch(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of at most LONG bytes, all in a row, and where each one's begin (one place more at the end)."""
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        size = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64))
        parts, counts = [], np.zeros(len(rows), np.int64)
        order = np.argsort(size, kind="stable")
        for p in np.unique(size):
            at = order[size[order] == p]
            for i in range(0, len(at), 8_000):
                ids, n = self._encode_rows([rows[j] for j in at[i : i + 8_000]], length[at[i : i + 8_000]], int(p))
                parts.append(ids)
                counts[at[i : i + 8_000]] = n
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # from the order of sizes back to the order of rows
        n = counts[order]
        begin = np.zeros(len(rows), np.int64)
        begin[order] = np.cumsum(n) - n
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat[np.repeat(begin - ends[:-1], counts) + np.arange(ends[-1])], ends

    def _encode_rows(self, rows: list[bytes], length: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """One tree of p leaves for each row; every round merges the leftmost pair of lowest rank of each row that has one."""
        n, w = len(rows), p + 1  # place p of each row stands for "no symbol"
        data = np.frombuffer(b"".join([x.ljust(p, b"\0") for x in rows]), np.uint8).reshape(n, p)
        live = np.arange(p) < length[:, None]
        sym = np.full((n, w), -1, np.int64)
        sym[:, :p] = np.where(live, self.first[data], -1)
        lines = np.arange(n)
        sym[lines, length - 1] = self.last[data[lines, length - 1]]
        after = np.minimum(np.arange(1, w + 1)[None, :], np.full((n, 1), p))
        after[lines, length - 1] = p
        before = np.tile(np.arange(-1, p), (n, 1))
        before[:, 0] = p
        tree = np.full((n, 2 * p), _INF, np.int64)
        rank = self._pair(sym[:, : p - 1], sym[:, 1:p])
        tree[:, p : 2 * p - 1] = np.where(rank >= 0, rank * p + np.arange(p - 1), _INF)
        low = p
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        sym, after, before, tree = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
        act = np.flatnonzero(tree[1 :: 2 * p] < _INF)
        while len(act):
            root = tree[act * (2 * p) + 1]
            pos, base, top = root % p, act * w, act * (2 * p)
            right = after[base + pos]
            sym[base + pos] = self.made[root // p]
            sym[base + right] = -1
            nxt, prv = after[base + right], before[base + pos]
            after[base + pos] = nxt
            before[base + nxt] = pos
            # the three leaves that change: the symbol that went, the merged one, the one before it
            here = self._pair(sym[base + pos], sym[base + nxt])
            there = self._pair(sym[base + prv], sym[base + pos])
            leaf = np.concatenate([right, pos, np.where(prv < p, prv, right)])
            value = np.concatenate([np.full(len(act), _INF), np.where(here >= 0, here * p + pos, _INF), np.where(there >= 0, there * p + prv, _INF)])
            at = np.tile(top, 3)
            node = leaf + p
            tree[at + node] = value
            for _ in range(p.bit_length() - 1):
                node >>= 1
                two = at + 2 * node
                tree[at + node] = np.minimum(tree[two], tree[two + 1])
            act = act[tree[top + 1] < _INF]
        sym = sym.reshape(n, w)[:, :p]
        kept = sym >= 0
        return sym[kept], kept.sum(axis=1)

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        n = len(word)
        sym = [int(self.first[b]) for b in word]
        sym[-1] = int(self.last[word[-1]])
        size = 1 << max(1, (n - 1).bit_length())
        inf, rank_of, made = 1 << 62, self.rank_of, self.made.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def value(i: int) -> int:
            j = after[i]
            r = rank_of.get(sym[i] << 20 | sym[j]) if j < n else None
            return inf if r is None else r * size + i

        tree = [inf] * (2 * size)
        for i in range(n):
            tree[size + i] = value(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                i >>= 1
                v = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == v:
                    break  # nothing changes further up
                tree[i] = v

        while tree[1] < inf:
            rank, i = divmod(tree[1], size)
            j = after[i]
            sym[i], sym[j] = made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, inf)
            put(i, value(i))
            if before[i] >= 0:
                put(before[i], value(before[i]))
        return [s for s in sym if s >= 0]

    # -- documents -------------------------------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Encode what the cache doesn't have: ids as bytes and the tokens' text. What wasn't used lately goes first."""
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        cache, old, tokens = self.cache, self.old, self.tokens
        new = words.difference(cache)
        known = new.intersection(old)
        for w in known:
            cache[w] = old[w]
        short, long = [], []
        for w in new - known:
            if w[0] == "\0" and w[1:] in self.special:
                self._put(w, [self.special[w[1:]]])
            elif len(b := w.encode()) <= LONG:
                short.append((w, b))
            else:
                long.append((w, b))
        for w, b in long:
            self._put(w, self.encode_long(b))
        flat, ends = self.encode_batch([b for _, b in short])
        raw, ends, shown = flat.astype("<u4").tobytes(), ends.tolist(), [tokens[i] for i in flat.tolist()]
        for i, (w, _) in enumerate(short):
            a, b = ends[i], ends[i + 1]
            cache[w] = raw[4 * a : 4 * b], " ".join(shown[a:b]).encode()

    def _put(self, word: str, ids: list[int]) -> None:
        self.cache[word] = np.array(ids, "<u4").tobytes(), " ".join(map(self.tokens.__getitem__, ids)).encode()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        words = self.pre_tokens(text)
        self.learn(set(words))
        return b"".join([self.cache[w][0] for w in words])

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: what a file without a decoder decodes to, special tokens kept."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(digest: str, spec: str) -> Vocabulary:
    tenant("bpe", _loaded.clear)
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = Vocabulary(json.loads(spec))
    return _loaded[digest]


def encode_documents(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_tokens, ids (array, left out if not asked for), ids_sha256 and decoded_sha256."""
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    digest = hashlib.sha256(spec.encode()).hexdigest()
    spec = docs.sparkSession.sparkContext.broadcast(spec)  # a file of fixed size

    def make(part: pa.RecordBatch) -> dict:
        v = _vocabulary(digest, spec.value)
        rows = [v.pre_tokens(x) for x in texts(part, text_col)]
        every: set[str] = set()
        every.update(*rows)
        v.learn(every)
        n, made, sha, plain = [], [], [], []
        for words in rows:
            found = list(map(v.cache.__getitem__, words))
            b = b"".join([x for x, _ in found])
            n.append(len(b) // 4)
            if ids:
                made.append(np.frombuffer(b, "<u4").astype(np.int32))
            sha.append(hashlib.sha256(b).hexdigest())
            # a pre-token's tokens decode alike wherever it stands
            plain.append(hashlib.sha256(b" ".join([x for _, x in found])).hexdigest())
        return {"n_tokens": n, "ids": made, "ids_sha256": sha, "decoded_sha256": plain}

    new = [("n_tokens", T.LongType())] + ([("ids", T.ArrayType(T.IntegerType()))] if ids else []) + [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return with_arrow(docs, new, make, keep, text_col)


def decode_documents(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the column decoded; null ids stay null."""
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    digest = hashlib.sha256(spec.encode()).hexdigest()
    spec = encoded.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != "decoded"], T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            v = _vocabulary(digest, spec.value)
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = [None if x is None else v.decode(np.array(x, "<u4").tobytes()) for x in lists]
            names = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(out, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_vocabulary(), ids=False, keep=["doc_id"])
