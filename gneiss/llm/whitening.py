"""Embedding whitening by a cyclic Jacobi method.

Vectors are put on an integer grid, so that equal ones are counted once and sums
are exact. Spark sums the centred scatter of the distinct vectors; the driver
turns it by symmetric Jacobi rotations until its off-diagonal entries vanish
beside their diagonal ones, which keeps small eigenvalues accurate; the matrix
that whitens goes out to the tasks again. The driver holds matrices of
dimension x dimension entries, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gneiss.llm.arrow import give_back, numbered
from gneiss.staging import drop, stage

#: Grid points to a unit.
SCALE = 256
#: Bytes of vectors, as doubles, that a task multiplies at once.
ROOM = 16 << 20
#: Sweeps after which rotations end at the latest; about ten are usual.
SWEEPS = 60
#: Bounds of grid entries, and of what a decimal holds.
LEAST, MOST, DIGITS = 1024 - (1 << 63), (1 << 63) - 1024, 10**38


@dataclass
class Whitening:
    """What vectors of one length are whitened by; rows of matrix are components by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    matrix: np.ndarray
    error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total > 0 else np.zeros_like(self.variances)


def grid(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) for each length among the vectors that are not empty and wholly finite."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (sizes > 0) & (odd[ends] == odd[ends - sizes])
    for d in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == d))
        step = max(1, ROOM // (8 * int(d)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            with np.errstate(over="ignore"):
                x = np.floor(flat[(ends - sizes)[part][:, None] + np.arange(d)] * scale)
            yield part, np.clip(x, LEAST, MOST).astype(np.int64)


def packed(vectors: DataFrame, scale: float) -> DataFrame:
    """(dim, wide, x): the grid vectors of a one-column table as bytes, two to an entry where all of a vector's fit, else eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in grid(b.column(0), scale):
                large = (np.abs(x) >= 1 << 15).any(axis=1)
                for wide in (False, True):
                    part = np.ascontiguousarray(x[large == wide].astype(np.int64 if wide else np.int16))
                    if len(part):
                        width = part.dtype.itemsize * part.shape[1]
                        data = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, width * len(part) + 1, width, dtype=np.int32)), pa.py_buffer(part)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x.shape[1], np.int32)), pa.array(np.full(len(part), wide)), data], names=["dim", "wide", "x"])
        give_back()

    return vectors.mapInArrow(run, "dim int, wide boolean, x binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The integer vectors of a batch of (dim, wide, x), those of equal length together."""
    dims, wides = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for d in np.unique(dims):
        for wide in (False, True):
            own = (dims == d) & (wides == wide)
            if own.any():
                part = batch.column(2).filter(pa.array(own))
                step = max(1, ROOM // (8 * int(d)))
                for at in range(0, len(part), step):
                    kind = np.int64 if wide else np.int16
                    yield np.frombuffer(b"".join(part.slice(at, step).to_pylist()), kind).reshape(-1, d).astype(np.int64)


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length, the number of vectors and their sums; the halves of the numbers are summed apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for x in unpacked(b):
                n, high, low = found.get(x.shape[1], (0, 0, 0))
                found[x.shape[1]] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array(high), pa.array(low)], names=["dim", "i", "n", "high", "low"])
        give_back()

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(run, "dim int, i int, n long, high long, low long").groupBy("dim", "i").agg(wide("n"), wide("high"), wide("low"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["dim"], r["i"])):
        out.setdefault(r["dim"], (int(r["n"]), []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


def summed_products(fit: DataFrame, projected: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """By length, the sum over the fit list of y yᵀ, where y is 1 and then (x - mean) times the matrix that projected gives."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for x in unpacked(b):
                mean, matrix = projected[x.shape[1]]
                y = x - mean
                y = np.hstack([np.ones((len(y), 1)), y if matrix is None else y @ matrix.T])
                found[x.shape[1]] = found.get(x.shape[1], 0) + y.T @ y
        yield from rows_of(found)
        give_back()

    def rows_of(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for d, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["dim", "i", "row"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for d, i, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[d, i] = found.get((d, i), 0) + np.frombuffer(row)
        for (d, i), row in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], names=["dim", "i", "row"])

    kind = "dim int, i int, row binary"
    rows = fit.mapInArrow(multiplied, kind).repartition("dim", "i").mapInArrow(merged, kind).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):
        out.setdefault(r["dim"], []).append(np.frombuffer(bytes(r["row"])))
    return {d: np.vstack(m) for d, m in out.items()}


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as rows) of a symmetric matrix.

    Sweeps meet every pair of dimensions once, half as many pairs at a time as
    there are dimensions, as these do not touch each other. A pair is turned
    while its entry is more than rounding beside its two diagonal entries.
    """
    a = np.array(symmetric, np.float64)
    d = len(a)
    v, ring = np.eye(d), np.arange(d + d % 2)
    small, floor = np.finfo(float).eps, np.abs(a).max(initial=0) * np.finfo(float).eps ** 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            own = (p < d) & (q < d)
            p, q = p[own], q[own]
            own = np.abs(a[p, q]) > np.maximum(small * np.sqrt(np.abs(a[p, p])) * np.sqrt(np.abs(a[q, q])), floor)
            p, q = p[own], q[own]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if not len(p):
                continue
            turned = True
            theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
            t = np.where(theta >= 0, 1, -1) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a.T, a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = v.T[order]
    lead = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], 1)
    return np.diag(a)[order], np.where(lead < 0, -vectors, vectors)


def fit_whitening(docs: DataFrame, vector: str = "embedding", scale: float = SCALE, components: int | None = None) -> dict[int, Whitening]:
    """What whitens the vectors of a table, by their length.

    Vectors that are null, empty or hold a null or a non-finite entry take no
    part; entries become floor(scale * entry), as a long, its bounds at most;
    equal vectors count once. All else is computed over every vector left, apart
    for each length. Components without variance (rank below the dimension, or a
    single vector) get a row of zeros. An empty table gives an empty result.
    """
    fit = stage(packed(docs.select(docs[vector]), scale).distinct(), "fit-list")
    sums = exact_sums(fit)
    means = {d: np.array([s / n for s in own]) for d, (n, own) in sums.items()}
    products = summed_products(fit, {d: (m, None) for d, m in means.items()}) if sums else {}
    out = {}
    for d, (n, own) in sums.items():
        moved = products[d][0, 1:] / n
        values, vectors = jacobi(products[d][1:, 1:] / n - np.outer(moved, moved))
        values = np.where(values > max(d, 8) * np.finfo(float).eps * values[0], values, 0)
        matrix = np.where(values[:, None] > 0, vectors / np.sqrt(np.where(values > 0, values, 1))[:, None], 0)
        out[d] = Whitening(n, own, values, matrix[:components])
    products = summed_products(fit, {d: (w.mean, w.matrix) for d, w in out.items()}) if out else {}
    for d, w in out.items():
        m = products[d] / w.n
        w.error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(m) - 1)).max())
    drop(fit)
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact squared distance of each row from the mean, times n squared."""
    most = max(n * int(max(x.max(), -x.min())) + abs(s) for s in sums)
    if len(sums) * most * most < 1 << 63:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    far = x.astype(object) * n - np.array(sums, object)
    return (far * far).sum(axis=1).tolist()


def whiten(docs: DataFrame, models: dict[int, Whitening], vector: str = "embedding", scale: float = SCALE, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The kept columns of every row that takes part, then dim, whitened (array of doubles) and deviation (decimal).

    Repeated rows come back each. Rows whose vector takes no part, or is of a
    length that models does not know, are left out.
    """
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[docs[c] for c in keep], docs[vector]).toDF(*names, "v")
    ready = {d: (w.mean, w.matrix, w.n, w.sums) for d, w in models.items()}
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "dim int, whitened array<double>, deviation decimal(38,0)"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in grid(b.column(len(keep)), scale):
                d = x.shape[1]
                if d in ready:
                    mean, matrix, n, sums = ready[d]
                    y = (x - mean) @ matrix.T
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                    far = pa.array([f if f < DIGITS else None for f in deviations(x, n, sums)], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in b.columns[: len(keep)]), pa.array(np.full(len(x), d, np.int32)), lists, far], names=[*names, "dim", "whitened", "deviation"])
        give_back()

    return source.mapInArrow(run, schema).toDF(*keep, "dim", "whitened", "deviation")


def whitened_digest(docs: DataFrame, components: int = 4) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error; dim follows.

    A deviation beyond a long is null; deviation_exact holds it as a decimal, of
    38 digits at most.
    """
    source = docs.select("vec_id", "embedding")
    models = fit_whitening(source, components=components)
    facts = {d: [(i + 1, float(w.explained[i])) for i in range(len(w.matrix))] for d, w in models.items()}
    rows = whiten(source, models)
    case = lambda f, kind: F.coalesce(*[F.when(F.col("dim") == d, F.lit(f(w)).cast(kind)) for d, w in models.items()], F.lit(None).cast(kind))
    shares = F.coalesce(*[F.when(F.col("dim") == d, F.array(*[F.lit(e) for _, e in f])) for d, f in facts.items()], F.lit(None).cast("array<double>"))
    rows = numbered(rows).toDF("vec_id", "dim", "y", "deviation_exact").withColumn("shares", shares)
    rows = rows.select("vec_id", "dim", "deviation_exact", F.posexplode(F.arrays_zip("y", "shares")).alias("i", "x"))
    return rows.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        case(lambda w: w.n, "long").alias("n"),
        F.expr("try_cast(deviation_exact as long)").alias("deviation"),
        F.col("x.y").alias("whitened"),
        F.col("x.shares").alias("explained"),
        case(lambda w: w.error, "double").alias("identity_error"),
        "dim",
        "deviation_exact",
    )
