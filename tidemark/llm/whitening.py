"""Operator 12, embedding whitening: exact integer covariance by digit-slice matrix products, then an eigendecomposition.

Vectors become integers (floor of 256 times each entry). The fit list holds each distinct integer vector once. With n vectors and sums
S, the centred vectors n x - S are integers too; each is split into limbs small enough that a float64 matrix product of two limb
blocks is exact (a block of m rows of w-bit limbs stays below 2^53), the products are put together as big integers, and tasks hand
them on in 32-bit digits, whose sums Spark takes entry by entry. So the covariance is exact until the one division that makes it a
double, however many rows there are and whatever their order; the driver gets d x d sums and decomposes them.

Defined results: a vector takes part if it isn't null, not empty, and all entries are finite numbers, and if its length is the commonest
one (the longer of two as common), as a covariance has one dimension. Rows without a vec_id, and rows that repeat one, are rows of
their own; other columns are left out. Integers beyond a long stop at its ends. Components of eigenvalue zero (up to rounding)
whiten to 0. A deviation beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, table

#: Rows of a block, and bits of a limb: 2^13 products of two 20-bit limbs stay below 2^53.
ROWS, BITS = 1 << 13, 20
#: 32-bit digits of an entry of the centred Gram matrix on its way through Spark: twice (a 63-bit number times a count of rows), summed.
DIGITS = 9
SUM_DIGITS = 4
_SCALE = 256


class Whitening(NamedTuple):
    """What the fit gives: rows and sums of the fit list, eigenvalues (falling) with unit eigenvectors as rows, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# --- exact products ----------------------------------------------------------------------------------------------


def limbs(x: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Float64 limbs of integers (int64 or Python integers), least first: x = sum of limb k times 2^(bits k), |limb| <= 2^(bits-1)."""
    out, half, mask = [], 1 << (bits - 1), (1 << bits) - 1
    if not x.size:
        return [np.zeros(x.shape)]
    while True:
        low = ((x + half) & mask) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> bits
        if not x.any():
            return out


def gram(z: np.ndarray) -> np.ndarray:
    """z' z exactly, as Python integers; limb products below the diagonal are the transposes of those above."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), ROWS):
        parts = limbs(z[at : at + ROWS])
        for i, x in enumerate(parts):
            for j in range(i, len(parts)):
                p = (x.T @ parts[j]).astype(np.int64)
                total = total + ((p if i == j else p + p.T).astype(object) << BITS * (i + j))
    return total


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S: int64 where that holds it, Python integers otherwise."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums) if x.size else 0
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def digits(v: int, count: int) -> list[int]:
    """`count` digits of base 2^32, least first; the last one carries the sign."""
    return [(v >> 32 * k) & 0xFFFFFFFF for k in range(count - 1)] + [v >> 32 * (count - 1)]


# --- tables ------------------------------------------------------------------------------------------------------


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    raw = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    whole = raw.filter(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    size = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if size:
        whole = whole.filter(F.size("v") == size[0]["d"])
    return whole.select("vec_id", F.transform("v", lambda c: F.floor(_SCALE * c) + F.lit(0).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _summed(df: DataFrame, count: int, cells: str) -> dict[int, int]:
    """Sums of the integers that tasks hand on as (cell, d0, d1, ...), by cell; as many as the square of the dimension at most."""
    rows = df.groupBy(cells).agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(count)]).collect()
    return {r[0]: sum(int(v) << 32 * k for k, v in enumerate(r[1:])) for r in rows}


def _cells(values: dict[int, int], count: int) -> pa.RecordBatch:
    parts = [digits(v, count) for v in values.values()]
    cols = [pa.array(list(values), pa.int64())] + [pa.array([p[k] for p in parts], pa.int64()) for k in range(count)]
    return pa.RecordBatch.from_arrays(cols, ["cell"] + [f"d{k}" for k in range(count)])


def _cell_schema(count: int) -> str:
    return "cell long, " + ", ".join(f"d{k} long" for k in range(count))


def _sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and per-dimension sums; cell -1 counts the rows."""

    def run(batches):
        total, rows = None, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                low = (x & 0xFFFFFFFF).sum(axis=0).astype(object) + ((x >> 32).sum(axis=0).astype(object) << 32)  # halves, so that no sum wraps
                total = low if total is None else total + low
                rows += len(x)
        if rows:
            yield _cells({-1: rows, **dict(enumerate(total.tolist()))}, SUM_DIGITS)

    got = _summed(fit.select("x").mapInArrow(run, _cell_schema(SUM_DIGITS)), SUM_DIGITS, "cell")
    n = got.pop(-1, 0)
    return n, tuple(got[j] for j in range(len(got)))


def _gram(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum of (n x - S)(n x - S)' over the fit list, exact; tasks hand on the entries on and above the diagonal."""
    d = len(sums)

    def run(batches):
        total, held, count = np.zeros((d, d), object), [], 0

        def flush():
            nonlocal total, held, count
            if held:
                total = total + gram(centred(np.concatenate(held), n, sums))
            held, count = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(_matrix(batch.column(0).slice(at, ROWS)))
                count += len(held[-1])
                if count >= ROWS:
                    flush()
        flush()
        for i in range(d if total.any() else 0):  # a batch for each row of the matrix
            yield _cells({i * d + j: int(total[i, j]) for j in range(i, d)}, DIGITS)

    got = _summed(fit.select("x").mapInArrow(run, _cell_schema(DIGITS)), DIGITS, "cell")
    out = np.zeros((d, d), object)
    for cell, v in got.items():
        out[cell // d, cell % d] = out[cell % d, cell // d] = v
    return out


def fit_list(x: DataFrame) -> DataFrame:
    """Each distinct vector once, as a table in the shared folder."""
    return stash(x.select("x").distinct(), "fit-list")


def fit(once: DataFrame) -> Whitening | None:
    """Whitening of a fit list; None where it is empty."""
    n, sums = _sums(once)
    if not n:
        return None
    exact = _gram(once, n, sums)
    v = np.array([[e / n**3 for e in row] for row in exact.tolist()], np.float64)  # quotients of integers are rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    trace = sum(exact[i, i] for i in range(len(sums))) / n**3
    values = np.where(values > max(values[0], 0.0) * len(sums) * np.finfo(float).eps, values, 0.0)
    return Whitening(n, sums, values, np.ascontiguousarray(vectors), trace)


def _project(x: np.ndarray, w: Whitening, components: int) -> np.ndarray:
    """Whitened values: the centred integers over n, on the unit eigenvectors, over the root of the eigenvalue."""
    z = centred(x, w.n, w.sums)
    scale = np.sqrt(w.values[:components])
    flat = np.array([[e / w.n for e in r] for r in z.tolist()], np.float64).reshape(z.shape) if z.dtype == object else z / w.n
    return np.divide(flat @ w.vectors[:components].T, scale, out=np.zeros((len(x), len(scale))), where=scale > 0)


def _deviation(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact: the limbs' products along each row."""
    z = centred(x, w.n, w.sums)
    parts, total = limbs(z), np.zeros(len(x), object)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            part = sum(np.einsum("ij,ij->i", a[:, k : k + ROWS], parts[j][:, k : k + ROWS]).astype(np.int64).astype(object) for k in range(0, z.shape[1], ROWS))
            total = total + ((part if i == j else 2 * part) << BITS * (i + j))
    return [v if v < 1 << 63 else None for v in total.tolist()]


def whiten(x: DataFrame, w: Whitening, components: int = 4) -> DataFrame:
    """(vec_id, component, deviation, whitened) for each row of (vec_id, x) and each of the first components."""
    most = min(components, len(w.sums))
    kind = x.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = _matrix(part.column(1))
                rows = np.repeat(np.arange(len(z)), most)
                cols = [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, most + 1), len(z)), pa.int32()), pa.array(_deviation(z, w), pa.int64()).take(pa.array(rows)), pa.array(_project(z, w, most).ravel())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "deviation", "whitened"])

    return x.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def identity_error(once: DataFrame, w: Whitening, components: int = 4) -> float:
    """Largest absolute entry of the covariance of whitened values over the fit list, minus the identity (of components with a variance)."""
    most = int((w.values[:components] > 0).sum())
    if not most:
        return 0.0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _project(_matrix(batch.column(0).slice(at, ROWS)), w, most)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y[:, k])) for k in range(most)], [f"c{k}" for k in range(most)])

    values = once.select("x").mapInArrow(run, ", ".join(f"c{k} double" for k in range(most)))
    got = values.agg(*[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i in range(most) for j in range(i, most)]).first()
    return max(abs(got[f"v{i}_{j}"] - (i == j)) for i in range(most) for j in range(i, most))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings` on the first four components of the distinct integer vectors."""
    x = integers(table(spark, sf_dir, "embeddings"))
    once = fit_list(x)
    w = fit(once)
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(once, w)
    discard(once)
    explained = F.element_at(F.array(*[F.lit(float(v / w.trace) if w.trace else 0.0) for v in w.values[:4]]), F.col("component"))
    return whiten(x, w).select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
