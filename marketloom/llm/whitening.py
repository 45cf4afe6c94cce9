"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

Entries become whole numbers x = floor(256 c); the fit runs over the distinct x vectors.
Count, sums and greatest entry come from one aggregate.  A pass over all centred rows
multiplies the covariance with a basis of few columns: each batch adds (x - m)' ((x - m) Q),
Spark adds the batches up cell by cell, and the driver holds one matrix of dimension times
columns.  The basis starts at random with more columns than components asked for
(oversampling).  Each pass gives, at no further cost, Rayleigh-Ritz vectors and their
residuals |V u - e u|; if those are at rounding level the passes end, otherwise the product
is the next basis (a power pass).  When two passes show that the residuals fall too slowly
to get there in the passes left, or those are used up, the basis is completed to the full
dimension, and one more pass gives all of V in that basis and components to double
precision whatever the spectrum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Shared, read

COMPONENTS, OVERSAMPLING, PASSES = 4, 8, 6
SCALE = 256.0
#: A residual that counts as rounding, and a variance that counts as none, both as a share of the greatest eigenvalue.
RESIDUAL, NONE = 4e-15, 1e-13


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _added(rows: DataFrame, shape: tuple[int, int], part) -> np.ndarray:
    """The sum over all batches of part(x), a matrix: added up in each task first, then cell by cell by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(batch.column(0))
        i, j = np.indices(shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    cells = rows.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for r in cells.toLocalIterator():
        out[r["i"], r["j"]] = r["value"]
    return out


@dataclass
class Model:
    """What a fit gives: n distinct vectors, their sums, the mean, components (columns), eigenvalues and the trace of V."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    #: (passes, whether the basis was completed, greatest residual as a share of the first eigenvalue)
    log: tuple[int, bool, float]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): rows whose vector has finite entries only, as whole numbers."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)
    return d.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 13) -> Model:
    """The components of greatest variance of distinct(x), at most so many; those without variance are left out."""
    at = distinct.select(F.posexplode("x").alias("i", "value")).groupBy("i").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()
    sums = [0] * dim
    for r in at:
        sums[r["i"]] = r["s"]
    n = at[0]["n"]
    model = Model(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, (0, False, 0.0))
    mean = model.mean
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(dim, components)
    basis = np.linalg.qr(rng.normal(size=(dim, min(dim, components + oversampling))))[0]
    before, step = np.inf, 0
    while True:
        full = basis.shape[1] == dim
        width = basis.shape[1]

        def part(column: pa.Array, basis: np.ndarray = basis, width: int = width) -> np.ndarray:
            x = _matrix(column, dim).astype(np.float64) - mean
            return np.hstack([x.T @ (x @ basis), np.full((dim, 1), (x * x).sum() / dim)])

        added = _added(distinct, (dim, width + 1), part)
        product, trace = added[:, :width] / n, float(added[:, width].sum()) / n
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(product @ turn - vectors * values, axis=0).max()) / top if top > 0 else 0.0
        step += 1
        if full or residual <= RESIDUAL:
            break
        rate = residual / before
        slow = rate >= 1 or residual * rate ** max(0, passes - step) > RESIDUAL
        if step >= passes or (step > 1 and slow):
            rest = rng.normal(size=(dim, dim - width))
            basis = np.linalg.qr(np.hstack([np.linalg.qr(product)[0], rest]))[0]
        else:
            basis = np.linalg.qr(product)[0]
        before = residual
    kept = values > NONE * top
    vectors = vectors[:, kept] / np.linalg.norm(vectors[:, kept], axis=0)
    return Model(n, sums, vectors, values[kept], trace, (step, full, residual))


def identity_error(distinct: DataFrame, model: Model) -> float:
    """The greatest absolute entry of the whitened vectors' covariance minus the identity: one more pass."""
    k = len(model.values)
    dim, mean, scaled = len(model.sums), model.mean, model.components / np.sqrt(model.values)

    def part(column: pa.Array) -> np.ndarray:
        z = (_matrix(column, dim).astype(np.float64) - mean) @ scaled
        return np.vstack([z.T @ z, z.sum(0)])

    added = _added(distinct, (k + 1, k), part) / model.n
    return float(np.abs(added[:k] - np.outer(added[k], added[k]) - np.eye(k)).max()) if k else 0.0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where it is no 64-bit number."""
    most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * n + max([abs(s) for s in sums], default=0)
    if most * most * len(sums) < 1 << 63:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Null vectors and those with null or non-finite entries are left out, and so are those
    of another length than the commonest (the longer of two), which no one covariance can
    hold.  Repeated rows, and rows that repeat a vector, have rows of their own, while the
    fit takes each distinct vector once.  Tied eigenvalues give any basis of their space, the
    same for all rows.  Components without variance are left out: with one distinct vector
    there are no rows at all.  A deviation beyond 64 bits is null, entries beyond count as
    the greatest long.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    shared = Shared(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(vectors, id_col, vec_col)
    length = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length["d"]
    rows = rows.where(F.size("x") == dim)
    distinct = shared.put(rows.select("x").distinct(), "distinct")
    model = fit(distinct, dim, components, oversampling, passes)
    error, k = identity_error(distinct, model), len(model.values)
    n, sums, mean, scaled, explained = model.n, model.sums, model.mean, model.components / np.sqrt(model.values), model.values / (model.trace or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            m = len(x)
            z = (x.astype(np.float64) - mean) @ scaled
            own = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(own)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The four first components of all embeddings; `whiten` states the cases."""
    return whiten(read(spark, sf_dir, "embeddings"))
