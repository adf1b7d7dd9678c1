"""Embedding whitening: the covariance of quantised vectors, each different vector counted once with its multiplicity.

A vector's entries become integers, packed into as few bytes as they need; equal vectors have equal bytes and meet as one row
with a count. Sums are exact integers. Covariances are weighted products of centred blocks, one matrix a task, which are
added by rows. Only matrices as large as the dimension squared reach the driver. Each different vector is projected once and
joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Components that are returned of each vector.
COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Vectors of one matrix product.
BLOCK = 4096
_KINDS = ("<i1", "<i2", "<i4", "<i8")


def _pack(values: np.ndarray) -> list[bytes]:
    """Rows of long integers as bytes: the width of an entry, then the entries. The width follows from the row alone."""
    if not len(values):
        return []
    size = np.maximum(values.max(axis=1), -1 - values.min(axis=1))
    kind = sum((size > np.iinfo(k).max).astype(np.int8) for k in _KINDS[:-1])
    out: list[bytes] = [b""] * len(values)
    for k, dtype in enumerate(_KINDS):
        rows = np.flatnonzero(kind == k)
        for row, packed in zip(rows.tolist(), values[rows].astype(dtype), strict=True):
            out[row] = bytes((k,)) + packed.tobytes()
    return out


def _unpack(codes: list[bytes]) -> np.ndarray:
    """Rows of x of one dimension."""
    return np.stack([np.frombuffer(c, _KINDS[c[0]], offset=1).astype(np.int64) for c in codes]) + SHIFT


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, dim, code`` of every row whose vector has entries, none of them null, infinite or not a number: ``code`` packs
    floor(64 * c) of each entry c as double; x is that plus a million. Entries beyond 2^56 are an error: x would be no long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            entries = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
            good = (size > 0) & (bad[ends] == bad[ends - size])
            for dim in np.unique(size[good]).tolist():
                rows = np.flatnonzero(good & (size == dim))
                scaled = np.floor(entries[(ends - size)[rows][:, None] + np.arange(dim)] * SCALE)
                if len(scaled) and np.abs(scaled).max() > 2.0**62:
                    raise OverflowError("an entry is too large for a long")
                ids = batch.column("vec_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), dim, np.int32)), pa.array(_pack(scaled.astype(np.int64)), pa.binary())], ["vec_id", "dim", "code"])

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where("v is not null")
    return rows.mapInArrow(run, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, dim int, code binary")


def _summed(blocks: DataFrame, rows: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Over all tasks the sum of a matrix that each makes of its blocks of (x, weights). Matrices are added by row: tasks send
    numbered rows, each row's sum is one entry of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                part = rows(_unpack(some.column("code").to_pylist()), some.column("n").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            values = pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["row", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, v in zip(batch.column("row").to_pylist(), batch.column("v"), strict=True):
                v = v.values.to_numpy()
                sums[row] = sums[row] + v if row in sums else v
        if sums:
            values = pa.array(list(sums.values()), pa.list_(pa.int64() if kind == "long" else pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["row", "v"])

    schema = f"row int, v array<{kind}>"
    added = blocks.select("code", "n").mapInArrow(run, schema).repartition("row").mapInArrow(add, schema)
    return np.array([r["v"] for r in sorted(added.collect(), key=lambda r: r["row"])])


class Whitening:
    """The fit: number of vectors, their sums, components as columns, eigenvalues, the trace, and what a projection is off."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps]
        self.n, self.sums, self.values, self.trace = n, sums, values[order], float(np.trace(covariance))
        self.vectors = vectors[:, order]
        if len(order):
            largest = self.vectors[np.abs(self.vectors).argmax(axis=0), np.arange(len(order))]
            self.vectors = self.vectors * np.sign(largest)
        self.error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, from the exact difference n * x - S where that fits."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)^2, exact."""
        away = x.astype(object) * self.n - self.sums.astype(object) if np.abs(x).max(initial=0) > (1 << 62) // self.n else x * self.n - self.sums
        largest = int(np.abs(away).max(initial=0))
        if largest * largest * max(1, x.shape[1]) >= 1 << 63:
            exact = [sum(int(a) * int(a) for a in row) for row in away]
            if max(exact) >= 1 << 63:
                raise OverflowError("a deviation is too large for a long")
            return exact
        return (away * away).sum(axis=1).tolist()


def fit_whitening(different: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit over ``code, n``: different vectors of one dimension and how often each stands; None without vectors."""
    n = different.agg(F.sum("n")).first()[0]
    if not n:
        return None
    sums = _summed(different, lambda x, w: (x * w[:, None]).sum(axis=0, keepdims=True), "long")[0]

    def scatter(centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c * w[:, None])

        both = _summed(different, product, "double") / n
        return (both + both.T) / 2

    start = Whitening.__new__(Whitening)
    start.n, start.sums = n, sums
    fit = Whitening(n, sums, scatter(start.centred), components)
    if len(fit.values):
        mean = _summed(different, lambda x, w: (fit.project(x) * w[:, None]).sum(axis=0, keepdims=True), "double")[0] / n
        fit.error = float(np.abs(scatter(lambda x: fit.project(x) - mean) - np.eye(len(fit.values))).max())
    return fit


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, counted: bool = True) -> DataFrame:
    """``vec_id, whitened, deviation, fit`` (an array over components; ``fit`` repeats what is common to all rows: n, explained,
    identity_error). With ``counted``, each row of the table is fitted; without, each different vector once.

    Rows without a vector, or with null, infinite or undefined entries, are left out, and so are vectors of another length
    than most have (of lengths that are as frequent the longest counts). Rows that repeat a vec_id, or have none, all count
    and all come back. Components without variance have no whitened value and aren't returned: fewer different vectors than
    ``components`` give fewer of them, equal vectors none at all (``whitened`` is empty). An empty table gives an empty
    result. Extra columns are ignored. A deviation beyond a long is an error.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    members = quantise(vectors, id_col, vec_col)
    different = scratch.table(members.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("rows")), "different")
    lengths = different.groupBy("dim").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    different = different.where(F.col("dim") == (lengths["dim"] if lengths else 0)).select("code", (F.col("rows") if counted else F.lit(1).cast("long")).alias("n"))
    fit = fit_whitening(different, components)
    id_type = vectors.schema[id_col].dataType.simpleString()
    common = "struct<n:long,explained:array<double>,identity_error:double>"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, whitened array<double>, deviation long, fit {common}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                code = batch.column("code").slice(at, BLOCK)
                x = _unpack(code.to_pylist())
                yield pa.RecordBatch.from_arrays([code, pa.array(list(fit.project(x)), pa.list_(pa.float64())), pa.array(fit.deviation(x), pa.int64())], ["code", "whitened", "deviation"])

    once = different.select("code").mapInArrow(run, "code binary, whitened array<double>, deviation long")
    explained = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values]).cast("array<double>")
    shared = F.struct(F.lit(fit.n).cast("long").alias("n"), explained.alias("explained"), F.lit(fit.error).alias("identity_error"))
    return members.select("vec_id", "code").join(once, "code").select("vec_id", "whitened", "deviation", shared.alias("fit"))


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component, numbered from 1: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``; edge cases as in ``whiten``."""
    rows = whiten(vectors, id_col, vec_col, components).select("vec_id", "deviation", "fit", F.posexplode("whitened").alias("k", "w"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.col("fit.n").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.col("fit.explained")[F.col("k")].alias("explained"), F.col("fit.identity_error").alias("identity_error"),
    )
