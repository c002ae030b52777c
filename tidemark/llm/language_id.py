"""Operator 7, language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

A language gives each piece of the vocabulary a probability. The probability of a word is the sum over all its segmentations into
pieces, by a forward algorithm; a text's is the product over its words (runs of letters, lower case, of any length). Piece
probabilities are fitted by ROUNDS of expectation and maximisation from equal weights: training documents are reduced once to
counts of words by language (a table in the shared folder), and each round is a forward-backward pass over that table, whose
expected counts are summed by language and piece. A letter that no piece holds is a piece of its own with a small fixed probability.

All words of a batch are segmented together in numpy: one table of substring hashes by length, one step for each end place. Word
scores are kept in a cache of bounded size for each Python worker.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score 0; null languages don't teach;
without any training document every text is `und`; ties go to the language that sorts first; rows that repeat an id each teach
and are each predicted; an empty table gives an empty table; held_out is null for a null id.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, discard, mix64, pieces, stash, table, tenant, texts, with_arrow
from .toxicity import in_fold

#: Longest piece taken from the vocabulary; letters of a word above which sums are kept as logarithms.
LETTERS, PLAIN = 32, 36
#: Words whose scores a Python worker keeps, and the longest of them.
CACHE, CACHED_LETTERS = 300_000, 64
UNKNOWN = 1e-7
SMOOTH = 0.05
ROUNDS = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The mark of a word's beginning in the vocabulary.
BEGIN = "▁"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; numbers such as ½ or ① aren't letters."""
    found = _RUN.findall(text.lower())
    return [x for w in found for x in ([w] if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]).split())]


def public_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a beginning, of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            p = sp.id_to_piece(i)
            bare = p.removeprefix(BEGIN)
            if (bare.isalpha() or not bare) and p == p.lower() and len(p) <= LETTERS:
                out.append(p)
    return out


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    m = int(length.max(initial=1))
    data = np.frombuffer("".join([w.ljust(m, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), m)
    return data.astype(np.uint64), length


class Pieces:
    """The vocabulary as a sorted table of hashes, and segmentation of many words at once."""

    def __init__(self, names: list[str]):
        self.names = names
        self.longest = max(map(len, names))
        self.size = len(names)
        codes, length = _codes(names)
        h, at_length = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        for j in range(codes.shape[1]):
            h = h * _ODD + codes[:, j] + np.uint64(1)
            at_length[length == j + 1] = h[length == j + 1]
        key = mix64(at_length)
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def spots(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each piece length, the piece that starts at each place of each word; size: none, size + 1: an unknown letter."""
        codes, length = _codes(words)
        n, m = codes.shape
        out, h = [], np.zeros((n, m), np.uint64)
        for k in range(1, min(self.longest, m) + 1):
            h = h[:, : m - k + 1] * _ODD + codes[:, k - 1 :] + np.uint64(1)
            key = mix64(h)
            at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
            found = np.where(self.keys[at] == key, self.order[at], self.size if k > 1 else self.size + 1)
            found[np.arange(m - k + 1)[None, :] + k > length[:, None]] = self.size
            out.append(found)
        return out, length

    def forward(self, spots: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of each prefix: (word, place, column of p)."""
        n, m = spots[0].shape
        alpha = np.zeros((n, m + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for j in range(1, m + 1):
            for k in range(1, min(j, len(spots)) + 1):
                alpha[:, j] += alpha[:, j - k] * p[spots[k - 1][:, j - k]]
        return alpha

    def log_forward(self, spots: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """The logarithm of `forward`, for words of any length."""
        n, m = spots[0].shape
        alpha = np.zeros((n, m + 1, p.shape[1]))
        for j in range(1, m + 1):
            here = np.zeros((n, p.shape[1]))
            for k in range(1, min(j, len(spots)) + 1):
                here += np.exp(alpha[:, j - k] - alpha[:, j - 1]) * p[spots[k - 1][:, j - k]]
            alpha[:, j] = alpha[:, j - 1] + np.log(here)
        return alpha

    def log_backward(self, spots: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        n, m = spots[0].shape
        beta = np.zeros((n, m + 1, p.shape[1]))
        for i in range(m - 1, -1, -1):
            here = np.zeros((n, p.shape[1]))
            for k in range(1, min(m - i, len(spots)) + 1):
                here += np.exp(beta[:, i + k] - beta[:, i + 1]) * p[spots[k - 1][:, i]]
            beta[:, i] = beta[:, i + 1] + np.log(here)
        return beta

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of words that occur `counts` times, under piece probabilities p (pieces, no piece, unknown letter)."""
        total = np.zeros(self.size + 2)
        for part in self.by_length(words):
            spots, length = self.spots([words[i] for i in part])
            n, m = spots[0].shape
            if m > PLAIN:
                alpha, beta = self.log_forward(spots, p[:, None])[:, :, 0], self.log_backward(spots, p[:, None])[:, :, 0]
                whole = alpha[:, m]
            else:
                alpha = self.forward(spots, p[:, None])[:, :, 0]
                beta = np.zeros((n, m + 1))
                beta[:, m] = 1.0
                for i in range(m - 1, -1, -1):
                    for k in range(1, min(m - i, len(spots)) + 1):
                        beta[:, i] += p[spots[k - 1][:, i]] * beta[:, i + k]
                whole = alpha[:, m]
            for k, spot in enumerate(spots, 1):
                if m > PLAIN:
                    share = np.exp(alpha[:, : m - k + 1] + beta[:, k:] - whole[:, None]) * p[spot]
                else:
                    share = alpha[:, : m - k + 1] * p[spot] * beta[:, k:] / whole[:, None]
                on = share > 0
                total += np.bincount(spot[on], weights=(share * counts[part][:, None])[on], minlength=self.size + 2)
        return total[: self.size]

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language (column of p)."""
        out = np.zeros((len(words), p.shape[1]))
        for part in self.by_length(words):
            spots, length = self.spots([words[i] for i in part])
            m = spots[0].shape[1]
            out[part] = self.log_forward(spots, p)[:, m] if m > PLAIN else np.log(self.forward(spots, p)[:, m])
        return out

    @staticmethod
    def by_length(words: list[str], letters: int = 60_000):
        """Places of words of equal length, about `letters` letters at a time."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        edge = np.flatnonzero(np.diff(length[order])) + 1
        for run in np.split(order, edge):
            rows = max(1, letters // max(1, int(length[run[0]]))) if len(run) else 1
            for i in range(0, len(run), rows):
                yield run[i : i + rows]


_at_work: dict = {}


def _pieces(names: list[str]) -> Pieces:
    tenant("language_id", _at_work.clear)
    key = (len(names), names[-1])
    if _at_work.get("names") != key:
        _at_work.update({"names": key, "pieces": Pieces(names)})
    return _at_work["pieces"]


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n): words of the documents of each language; word null: documents."""

    def run(batches):
        tenant("language_id", _at_work.clear)
        bags: dict[str, Counter] = {}
        documents: Counter = Counter()

        def flush():
            for lang, bag in bags.items():
                words = list(bag)
                for i in range(0, len(words), 20_000):
                    part = words[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([bag[w] for w in part], pa.int64())], ["lang", "word", "n"])
            x = list(documents)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array([None] * len(x), pa.string()), pa.array([documents[k] for k in x], pa.int64())], ["lang", "word", "n"])
            bags.clear()
            documents.clear()

        for batch in batches:
            for part in pieces(batch, text_col):
                for text, lang in zip(texts(part, text_col), column(part, lang_col)):
                    bags.setdefault(lang, Counter()).update(words_of(text))
                    documents[lang] += 1
                if sum(map(len, bags.values())) > CACHE:
                    yield from flush()
        yield from flush()

    rows = docs.filter(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> dict:
    """{languages, pieces, p}: probabilities by piece and language, with the logarithm of each language's share of documents."""
    names = public_pieces(vocabulary_path)
    spark = docs.sparkSession
    counts = stash(word_counts(docs, text_col, lang_col), "words")
    share = {r["lang"]: r["n"] for r in counts.filter("word is null").collect()}  # a row for each language
    langs = sorted(share)
    p = np.zeros((len(names) + 2, len(langs)))
    p[:-2], p[-1] = 1.0 / len(names), UNKNOWN
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(p)  # pieces of the file x languages

        def run(batches, shared=shared):
            v, at = _pieces(names), {x: i for i, x in enumerate(langs)}
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                of = np.array(batch.column(0).to_pylist(), object)
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for lang in set(of.tolist()):
                    on = np.flatnonzero(of == lang)
                    got = v.expected([BEGIN + words[i] for i in on], n[on], shared.value[:, at[lang]])
                    total[lang] = total[lang] + got if lang in total else got
            for lang, got in total.items():
                piece = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(piece), pa.string()), pa.array(piece.astype(np.int32)), pa.array(got[piece])], ["lang", "piece", "n"])

        summed = counts.filter("word is not null").mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        rows = summed.toPandas()  # languages x pieces of the file at most
        new = np.full((len(names), len(langs)), SMOOTH)
        for i, x in enumerate(langs):
            own = rows[rows["lang"] == x]
            new[own["piece"].to_numpy(), i] += own["n"].to_numpy()
        p[:-2] = new / new.sum(axis=0) * (1 - UNKNOWN)
    discard(counts)
    share = np.array([share[x] for x in langs], float)
    return {"languages": langs, "pieces": names, "p": p, "prior": np.log(share / share.sum()) if len(langs) else share}


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with lang_pred and score, the posterior of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces of the file x languages
    langs = model["languages"]

    def make(part: pa.RecordBatch) -> dict:
        tenant("language_id", _at_work.clear)
        m = shared.value
        if _at_work.get("of") is not m:
            _at_work.update({"of": m, "row": {}, "table": np.zeros((0, len(langs)))})
        rows = [words_of(x) for x in texts(part, text_col)]
        if not langs:
            return {"lang_pred": ["und"] * len(rows), "score": [0.0] * len(rows)}
        every: set[str] = set()
        every.update(*rows)
        if len(_at_work["row"]) > CACHE:  # what this slice has stays
            kept = [w for w in every if w in _at_work["row"]]
            _at_work["table"] = _at_work["table"][np.fromiter(map(_at_work["row"].__getitem__, kept), np.int64, len(kept))]
            _at_work["row"] = dict(zip(kept, range(len(kept))))
        row: dict[str, int] = _at_work["row"]
        new = sorted(every.difference(row), key=len)
        scored = _pieces(m["pieces"]).scores([BEGIN + w for w in new], m["p"]) if new else np.zeros((0, len(langs)))
        known = dict(zip(new, range(len(row), len(row) + len(new))))
        values = np.concatenate([_at_work["table"], scored])
        short = sum(len(w) <= CACHED_LETTERS for w in new)  # longer words aren't kept
        at_row = {**row, **known} if short < len(new) else row
        row.update((w, known[w]) for w in new[:short])
        _at_work["table"] = values[: len(values) - len(new) + short]
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.concatenate([np.fromiter(map(at_row.__getitem__, w), np.int64, len(w)) for w in rows]) if rows else np.zeros(0, np.int64)
        total = np.zeros((len(rows), len(langs)))
        full = np.flatnonzero(count)
        if len(full):
            total[full] = np.add.reduceat(values[at], (np.cumsum(count) - count)[full])
        total += m["prior"]
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return {"lang_pred": [langs[b] if c else "und" for b, c in zip(best, count)], "score": pa.array(np.where(count > 0, score, 0.0))}

    return with_arrow(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], make, keep, text_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(in_fold(F.col("doc_id")) != 0), public_vocabulary())
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (in_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
