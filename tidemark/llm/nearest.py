"""Operator 1, approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Largest inner product becomes smallest Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2), which is 0 for queries (M:
the largest norm). Vectors are assigned to lists by k-means centroids; a query probes its nearest lists. Within a probed list the
vectors are rotated by a fixed random orthogonal matrix and scanned in blocks of columns. After d of D columns the distance so
far, scaled by D / d, estimates the whole; when it exceeds (1 + EPSILON / sqrt(d))^2 times the query's bound, the hypothesis that
the candidate is near enough is rejected and it is abandoned. Survivors get their inner product in double precision on the
original vectors. The bound is the 2 K-th smallest distance to the sample's vectors in the probed lists, a subset of the candidates.
A query that ends with fewer than K neighbours though there are more vectors is asked again over all lists without a bound.

The number of lists is the square root of the number of vectors (MOST_LISTS at most, which bounds the centroids that go to the
tasks), so a query's probed lists hold a share of all vectors that falls as they grow. Centroids, rotation and number of probes
are fitted on at most SAMPLE vectors, or PER_LIST for each list, of smallest hash; every vector is indexed. `fit` measures recall
from end to end on the sample, abandoned candidates included, and probes as few lists as reach RECALL. Lists and probing queries
are dealt in blocks of at most BLOCK rows, so a list that holds a third of all vectors (or copies of one vector) is many tasks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose dimension
isn't the commonest (the smaller one if tied); rows with a null id take no part; rows that repeat an id are one item of several
vectors: as queries and as candidates their best pair counts, and each vec_id comes once; ties go to the smaller id; with fewer
than K candidates all of them are returned; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, table, tenant

K, SAMPLE, PER_LIST, BLOCK, COLUMNS = 20, 20_000, 16, 2048, 16
EPSILON, RECALL, MOST_LISTS = 2.1, 0.93, 16_384
#: Share of live candidates below which they are scanned one by one.
DENSE = 0.02


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, v array<double>) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter("id is not null and v is not null").filter(fine)
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("v") == (common.d if common else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, float).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Index:
    """What the sample fixes: centroids, rotation, number of probed lists; and the sample itself for first bounds."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, norm: float, rows: int, k: int = K, recall: float = RECALL):
        self.norm, self.k, self.sample, self.ids = norm, k, sample, ids
        rng = np.random.default_rng(7)
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = max(1, min(MOST_LISTS, math.isqrt(rows), len(sample) // 4))
        x = self.stored(sample)
        self.centroids = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(8):
            own = self.nearest(x, 1)[:, 0]
            total = np.zeros_like(self.centroids)
            np.add.at(total, own, x)
            n = np.bincount(own, minlength=lists)
            self.centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], self.centroids)
        self.own = self.nearest(x, 1)[:, 0]
        self.probes, self.recall = self.fitted(rng.choice(len(sample), min(256, len(sample)), replace=False), recall)

    def fitted(self, asked: np.ndarray, recall: float) -> tuple[int, float]:
        """The least number of probed lists whose recall on the sample reaches `recall`, from end to end; and that recall."""
        q, ids = self.sample[asked], self.ids[asked]
        score = q @ self.sample.T
        score[ids[:, None] == self.ids[None, :]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        real = np.take_along_axis(score, best, axis=1) > -np.inf
        lists = len(self.centroids)
        ranked = self.nearest(self.asking(q), lists)
        place = np.take_along_axis(np.argsort(ranked, axis=1), self.own[best], axis=1)
        reached = np.array([((place < p) & real).sum() / max(1, real.sum()) for p in range(1, lists + 1)])
        probes = int(np.argmax(reached >= min(recall, reached[-1]))) + 1
        while True:
            probed = np.zeros((len(q), lists), bool)
            np.put_along_axis(probed, ranked[:, :probes], True, axis=1)
            row, at, _ = self.scan(q, ids, self.bounds(q, ids, ranked[:, :probes]), self.sample, self.ids, probed[:, self.own])
            found = np.zeros(score.shape, bool)
            found[row, at] = True
            got = (np.take_along_axis(found, best, axis=1) & real).sum() / max(1, real.sum())
            if got >= recall or probes == lists:
                return probes, float(got)
            probes = min(lists, probes + max(1, probes // 8))

    def stored(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.norm**2 - (v * v).sum(axis=1), 0))])

    def asking(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.zeros(len(v))])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids * self.centroids).sum(axis=1) - 2 * x @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def bounds(self, v: np.ndarray, ids: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distance within which 2 K sample vectors of each query's probed lists lie (infinite where there are fewer).

        Twice K, so that K are found even where a hypothesis test abandons a near one.
        """
        out = np.full(len(v), np.inf)
        k = 2 * self.k
        if len(self.sample) > k:
            for i in range(0, len(v), 256):
                s = v[i : i + 256] @ self.sample.T
                probed = np.zeros((len(s), len(self.centroids)), bool)
                np.put_along_axis(probed, lists[i : i + 256], True, axis=1)
                s[~probed[:, self.own] | (ids[i : i + 256, None] == self.ids[None, :])] = -np.inf
                kth = np.partition(s, -k, axis=1)[:, -k]
                out[i : i + 256] = np.where(kth > -np.inf, (v[i : i + 256] ** 2).sum(axis=1) + self.norm**2 - 2 * kth, np.inf)
        return out * (1 + 1e-9) + 1e-12

    @staticmethod
    def limit(bound: np.ndarray, seen: int, d: int) -> np.ndarray:
        """Distance over the columns so far beyond which a candidate is abandoned; all columns: the bound, with room for rounding."""
        return bound * (1 + 1e-9) if seen == d else bound * (seen / d) * (1 + EPSILON / math.sqrt(seen)) ** 2

    def scan(self, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, v: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None):
        """(query place, candidate place, score) of the best K surviving ids of each query id in one block."""
        a, x = self.asking(q) @ self.rotation, self.stored(v) @ self.rotation
        d = a.shape[1]
        part = np.zeros((len(a), len(x)))
        live = q_ids[:, None] != ids[None, :]
        if allowed is not None:
            live &= allowed
        seen = 0
        # while many candidates are left, a block of columns is one matrix product over all of them
        while seen < d and (seen == 0 or np.count_nonzero(live) > DENSE * live.size):
            stop = min(d, seen + COLUMNS)
            b, c = a[:, seen:stop], x[:, seen:stop]
            step = b @ c.T
            step *= -2
            step += (b * b).sum(axis=1)[:, None]
            step += (c * c).sum(axis=1)[None, :]
            part += step
            live &= part <= self.limit(bound, stop, d)[:, None]
            seen = stop
        row, at = np.nonzero(live)
        far = part[row, at]
        while seen < d and len(row):
            stop = min(d, seen + COLUMNS)
            keep = np.zeros(len(row), bool)
            most = self.limit(bound, stop, d)
            for i in range(0, len(row), 200_000):
                s = slice(i, i + 200_000)
                gap = a[row[s], seen:stop] - x[at[s], seen:stop]
                far[s] += (gap * gap).sum(axis=1)
                keep[s] = far[s] <= most[row[s]]
            row, at, far = row[keep], at[keep], far[keep]
            seen = stop
        score = np.zeros(len(row))
        for i in range(0, len(row), 200_000):
            score[i : i + 200_000] = np.einsum("ij,ij->i", q[row[i : i + 200_000]], v[at[i : i + 200_000]])
        # the best pair of each query id and candidate id, then the best K of each query id
        order = np.lexsort((-score, ids[at], q_ids[row]))
        row, at, score = row[order], at[order], score[order]
        first = np.ones(len(row), bool)
        first[1:] = (q_ids[row[1:]] != q_ids[row[:-1]]) | (ids[at[1:]] != ids[at[:-1]])
        row, at, score = row[first], at[first], score[first]
        order = np.lexsort((ids[at], -score, q_ids[row]))
        row, at, score = row[order], at[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(q_ids[row], q_ids[row], side="left")
        top = rank < self.k
        return row[top], at[top], score[top]


def fit(vectors: DataFrame, k: int = K, recall: float = RECALL) -> Index | None:
    """The index of usable vectors (id, v); None if there are none."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not size.n:
        return None
    most = max(SAMPLE, PER_LIST * min(MOST_LISTS, math.isqrt(size.n)))
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(most).toPandas()
    return Index(np.stack(sample["v"].to_numpy()).astype(float), sample["id"].to_numpy(np.int64), math.sqrt(size.m) * (1 + 1e-12), size.n, k, recall)


def pairs(placed: DataFrame, asked: DataFrame, scan) -> DataFrame:
    """(query_id, vec_id, score): the best K of each block of a list for each block of queries that probe it."""

    def blocks(df):
        return df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))

    sizes = stash(blocks(placed).withColumnRenamed("n", "vectors").join(blocks(asked).withColumnRenamed("n", "queries"), "list"), "list-sizes")

    def dealt(df, own, other):
        df = df.join(sizes, "list").withColumn(own[0], F.pmod(F.xxhash64("id", "v", F.lit(5)), F.col(own[1])).cast("int"))
        return df.withColumn(other[0], F.explode(F.expr(f"sequence(0, {other[1]} - 1)"))).drop("vectors", "queries")

    left = dealt(placed, ("vb", "vectors"), ("qb", "queries"))
    right = dealt(asked, ("qb", "queries"), ("vb", "vectors"))
    keys = ["list", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest vectors of each query; both tables have (id, v)."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # the sample and MOST_LISTS centroids at most
    k = index.k

    def assign(batches):
        tenant("nearest")
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                own = shared.value.nearest(shared.value.stored(_matrix(part.column(1))), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column(0), part.column(1)], ["list", "id", "v"])

    def probing(everywhere: bool):
        def probe(batches):
            tenant("nearest")
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    ix, q = shared.value, _matrix(part.column(1))
                    lists = ix.nearest(ix.asking(q), len(ix.centroids) if everywhere else ix.probes)
                    bound = np.full(len(q), np.inf) if everywhere else ix.bounds(q, part.column(0).to_numpy(), lists)
                    at = np.repeat(np.arange(len(q)), lists.shape[1])
                    again = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), again.column(0), again.column(1), pa.array(bound[at])], ["list", "id", "v", "bound"])

        return probe

    def scan(cand: pa.Table, quer: pa.Table) -> pa.Table:
        if not cand.num_rows or not quer.num_rows:
            row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            q_ids = ids = np.zeros(0, np.int64)
        else:
            cand, quer = cand.combine_chunks(), quer.combine_chunks()
            q_ids, ids = quer["id"].to_numpy(), cand["id"].to_numpy()
            row, at, score = shared.value.scan(_matrix(quer["v"].chunk(0)), q_ids, quer["bound"].to_numpy(), _matrix(cand["v"].chunk(0)), ids)
        return pa.table({"query_id": pa.array(q_ids[row], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()), "score": pa.array(score)})

    schema = "list int, id long, v array<double>, bound double"
    placed = stash(vectors.select("id", "v").mapInArrow(assign, "list int, id long, v array<double>"), "lists")
    asked = stash(queries.select("id", "v").mapInArrow(probing(False), schema), "probes")
    found = stash(pairs(placed, asked, scan).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    # a query that its lists, or the tests, left short of K
    need = min(k, placed.select("id").distinct().count() - 1)
    full = found.groupBy("query_id").count().filter(F.col("count") >= need).select(F.col("query_id").alias("id"))
    short = stash(queries.select("id", "v").join(full, "id", "left_anti").mapInArrow(probing(True), schema), "short")
    if need > 0 and not short.isEmpty():
        again = pairs(placed, short, scan).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    index = fit(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(vectors, vectors.filter("id % 20 = 0"), index)
