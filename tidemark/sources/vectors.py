"""A vector index on disk, and a store of embeddings by content.

The index is a set of Parquet folders, partitioned by list, that a ledger publishes. Lists are the nearest of about root(n) centroids,
which are fitted on a bounded sample; every vector is stored. Additions are new folders; a replacement also writes the ids that older
folders no longer show, and `compact` folds all of it into one folder. A search reads only the lists that some query probes, in blocks
of bounded size, so a list with most of the vectors is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ledger import Ledger

#: Most bytes of the sample that centroids and probes are fitted on, as doubles; it goes through the driver.
SAMPLE_BYTES = 32_000_000
#: Vectors of a block, and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 1024


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k means of the rows of x; a list that runs empty takes the row that lies worst."""
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        far = ((x - c[own]) ** 2).sum(axis=1)
        for j in range(k):
            there = own == j
            c[j] = x[there].mean(axis=0) if there.any() else x[far.argmax()]
            if not there.any():
                far[far.argmax()] = 0
    return c


def _probes(x: np.ndarray, centroids: np.ndarray, top: int, recall: float) -> int:
    """The least number of lists, by product with the centroid, that hold `recall` of the best `top` of the sample's rows (200 of them ask)."""
    asks = np.random.default_rng(8).choice(len(x), min(200, len(x)), replace=False)
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(top, len(x) - 1)]
    own = _nearest(x, centroids)
    order = np.argsort(-(x[asks] @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # the rank of each list for each query
    ranks = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


class VectorIndex:
    """RT3: vectors (id long, v array<double>) under a folder; opening it again finds what was published."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.ledger = spark, Ledger(spark, base)

    # --- writing

    def build(self, vectors: DataFrame, top: int = 5, recall: float = 0.95) -> None:
        """A new index of the vectors, in place of what was there; the probes are those that give `recall` on the sample."""
        version = self.ledger.version()
        first = vectors.select("id", "v").filter("v is not null")
        n, size = (int(x or 0) for x in first.agg(F.count("*"), F.max(F.size("v"))).first())
        if not n:
            self.ledger.publish({"centroids": [], "probes": 1, "parts": []}, version)
            return
        most = max(64, SAMPLE_BYTES // (8 * size))
        k = max(1, min(round(n**0.5), most // 16))
        some = first.select("v").orderBy(F.xxhash64("id")).limit(min(n, most)) if n > most else first.select("v")
        x = np.array([r.v for r in some.collect()], float)  # SAMPLE_BYTES at most
        c = _centroids(x, min(k, len(x)))
        centroids = c.tolist()
        part = self.ledger.write(self._listed(first, centroids), "part", by="list")
        self.ledger.publish({"centroids": centroids, "probes": _probes(x, c, top, recall), "parts": [{"rows": part}]}, version)

    def add(self, vectors: DataFrame, replace: bool = False) -> int:
        """Vectors whose ids are new; with `replace`, also those in place of the ones with the same id. Repeated ids keep one row. Returns rows written."""
        version, entry = self.ledger.version(), self.ledger.read()
        new = vectors.select("id", "v").filter("v is not null").groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        known = self.rows().select("id")
        part = {}
        if replace:
            part["gone"] = self.ledger.write(new.select("id").join(known, "id", "left_semi"), "gone")
        else:
            new = new.join(known, "id", "left_anti")
        part["rows"] = self.ledger.write(self._listed(new, entry["centroids"]), "part", by="list")
        self.ledger.publish({**entry, "parts": [*entry["parts"], part]}, version)
        return self._open(part["rows"]).count()

    def compact(self) -> None:
        """One folder with the rows that are shown; older versions' folders go."""
        version, entry = self.ledger.version(), self.ledger.read()
        part = self.ledger.write(self.rows(), "part", by="list")
        self.ledger.publish({**entry, "parts": [{"rows": part}]}, version)
        self.ledger.forget([f for p in entry["parts"] for f in p.values()])

    def _listed(self, vectors: DataFrame, centroids: list) -> DataFrame:
        c = np.array(centroids)

        def run(frames):
            for f in frames:
                x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
                yield f.assign(list=_nearest(x, c) if len(x) and len(c) else np.zeros(len(x), int))

        return vectors.mapInPandas(run, f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>, list int")

    # --- reading

    def _open(self, folder: str) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, list int").parquet(f"{self.ledger.base}/{folder}")

    def rows(self) -> DataFrame:
        """(id, v, list) of all vectors that are shown: of each folder, those that no later folder replaces."""
        out, gone = None, None
        for part in reversed(self.ledger.read()["parts"]):
            own = self._open(part["rows"])
            own = own if gone is None else own.join(gone, "id", "left_anti")
            out = own if out is None else out.unionByName(own)
            if "gone" in part:
                ids = self.spark.read.schema("id long").parquet(f"{self.ledger.base}/{part['gone']}")
                gone = ids if gone is None else gone.unionByName(ids)
        return out if out is not None else self.spark.createDataFrame([], "id long, v array<double>, list int")

    def search(self, queries: DataFrame, top: int = 5, min_score: float | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the best of each query's probed lists by inner product, itself left out; ties to the smaller id."""
        entry = self.ledger.read()
        c = np.array(entry["centroids"])
        most = min(probes or entry["probes"], max(1, len(c)))

        def lists(frames):
            for f in frames:
                x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
                near = np.argsort(-(x @ c.T), axis=1)[:, :most] if len(x) and len(c) else np.zeros((len(x), 0), int)
                rows = np.repeat(np.arange(len(f)), near.shape[1])
                yield pd.DataFrame({"query_id": f["id"].to_numpy()[rows], "q": f["v"].to_numpy()[rows], "list": near.ravel()})

        asked = queries.select("id", F.col("v").cast("array<double>").alias("v")).filter("v is not null").mapInPandas(lists, "query_id long, q array<double>, list int")
        wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # as many as there are lists at most
        stored = self.rows().filter(F.col("list").isin(wanted))  # partitions that nobody probes aren't read
        sizes = stored.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        asks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("ask_blocks"))
        shape = sizes.join(asks, "list")
        number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = stored.join(shape, "list").withColumn("b", number("id", "blocks")).withColumn("a", spread("ask_blocks")).select("list", "a", "b", "id", "v")
        right = asked.join(shape, "list").withColumn("a", number("query_id", "ask_blocks")).withColumn("b", spread("blocks")).select("list", "a", "b", "query_id", "q")

        def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(v) or not len(q):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
            ids, who = v["id"].to_numpy(), q["query_id"].to_numpy()
            score = np.array(q["q"].tolist(), float) @ np.array(v["v"].tolist(), float).T
            score[who[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :top]
            at = np.repeat(np.arange(len(who)), order.shape[1])
            out = pd.DataFrame({"query_id": who[at], "id": ids[order.ravel()], "score": score[at, order.ravel()]})
            return out[out["score"] >= min_score] if min_score is not None else out[np.isfinite(out["score"])]

        found = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInPandas(best, "query_id long, id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= top)


class EmbeddingStore:
    """RT5: what an encoder made of a text, kept by the text's SHA-256, so that each text is encoded once, in any run."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.ledger = spark, Ledger(spark, base)

    def rows(self) -> DataFrame | None:
        parts = [self.ledger.open(f) for f in self.ledger.read().get("parts", [])]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def encode(self, docs: DataFrame, encoder) -> tuple[DataFrame, int]:
        """(doc_id, *what the encoder makes) of (doc_id, text), and how many texts had to be encoded; null texts are left out.

        `encoder` takes rows (doc_id, text) and gives rows with that doc_id. New texts are found by an anti join on keys, encoded once
        however many documents hold them, and published together.
        """
        keyed = docs.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("key"), "text")
        once = keyed.groupBy("key").agg(F.min("text").alias("text"))
        version, entry = self.ledger.version(), self.ledger.read()
        known = self.keys()
        new = once if known is None else once.join(known, "key", "left_anti")
        names = self.ledger.write(new.select("key"), "keys")
        n = self.ledger.open(names).count()
        if n:
            made = self.ledger.write(encoder(new.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key"), "part")
            self.ledger.publish({"parts": [*entry.get("parts", []), made], "keys": [*entry.get("keys", []), names]}, version)
        else:
            self.ledger.forget([names])
        rows = self.rows()
        return keyed.select("doc_id", "key").join(rows, "key").drop("key") if rows is not None else encoder(docs.limit(0)), n

    def keys(self) -> DataFrame | None:
        """Keys of all texts that were encoded, also of those of which the encoder made no row."""
        out = None
        for f in self.ledger.read().get("keys", []):
            out = self.ledger.open(f) if out is None else out.unionByName(self.ledger.open(f))
        return out
