"""Whitening of embeddings: Golub-Kahan-Lanczos bidiagonalisation by distributed products with the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgauge.llm.common import query, staged, table

LARGEST = 1 << 52  # whole numbers up to here are exact as doubles
EXACT = 8 * np.finfo(float).eps


@dataclass
class Whitening:
    """What whitening needs of the rows it was fitted on.

    ``components`` are unit rows by falling ``variances`` (mean squares along them); only directions with
    variance above rounding are among them. ``total`` is the sum of the variances of all dimensions and
    ``steps`` the length of the bidiagonalisation.
    """

    rows: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.rows for s in self.sums])


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of a matrix of rows: ``size`` numbers.

    Each task adds up its rows and sends one number a place; Spark adds up the places. So the driver gets
    ``size`` numbers, however many rows or tasks there are.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    places = rows.select("x").mapInArrow(work, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for place, value in places.collect():
        out[place] = value
    return out


def usable_vectors(vectors: DataFrame, vector: Column, id_col: str = "vec_id") -> DataFrame:
    """vec_id and x, a list of doubles that are whole numbers: the rows of ``vector`` without missing entries.

    Rows are left out if their vector is null or empty, holds a null, a non-finite entry or one above 2^52 (no exact double),
    or has another length than most vectors (of equally frequent lengths the longest counts).
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("x"))
    usable = rows.where(F.coalesce(F.size("x") > 0, F.lit(False)) & F.forall("x", lambda c: F.coalesce(F.abs(c) <= float(LARGEST), F.lit(False))))
    rows = staged(usable, "vectors")
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows if length is None else rows.where(F.size("x") == length["n"])


def bidiagonalise(rows: DataFrame, mean: np.ndarray, wanted: int, tolerance: float = EXACT) -> tuple[np.ndarray, np.ndarray, int]:
    """Right singular vectors (rows) and singular values of the centred rows X, the ``wanted`` largest, and the steps taken.

    Step k multiplies X with the right vector v_k, takes the earlier left vectors out of the product and
    scales it to u_k; then it multiplies X transposed with u_k, takes the earlier right vectors out and
    scales to v_k+1. Both products are passes over the rows. In exact arithmetic U'XV is upper bidiagonal; its small
    SVD gives X's.

    Reorthogonalisation is full on both sides. A left vector is as long as the table, so it is kept as
    y with u = Xy: a row computes its entries of all left vectors from itself, and nothing as long as the
    table is ever stored, shuffled or lost with an executor. Products of new left vectors with all earlier ones are
    measured in the second pass and taken out once more.

    The steps end when the residuals of the wanted singular triples are below ``tolerance`` times the
    largest value, or when the right vectors span all dimensions. If a product vanishes, its vectors
    span an invariant space, and the next right vector is any other direction.
    """
    d = len(mean)
    draw = np.random.default_rng(0)
    right, left, images = np.empty((0, d)), np.empty((0, d)), np.empty((0, d))  # v, y with u = Xy, X'u
    upper = np.zeros((d, d))
    scale = 0.0

    def fresh() -> np.ndarray:
        while True:
            v = draw.normal(size=d)
            for _ in range(2):
                v -= right.T @ (right @ v)
            if np.linalg.norm(v) > 1e-3:
                return v / np.linalg.norm(v)

    def product(v: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For w = Xv: X'w, its products with the earlier left vectors, and its squared length."""
        k = len(earlier)

        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            w = x @ v
            return np.concatenate([x.T @ w, (x @ earlier.T).T @ w, [w @ w]])

        out = _summed(rows, part, d + k + 1)
        return out[:d], out[d : d + k], out[-1]

    v = fresh()
    while True:
        right = np.vstack([right, v])
        k = len(right) - 1
        image, inner, square = product(v, left)
        y, image = v - inner @ left, image - inner @ images
        alpha = np.sqrt(max(square - inner @ inner, 0.0))
        scale = max(scale, np.sqrt(square))
        if alpha > 1e-7 * scale:
            image, again, square = product(y / alpha, left)
            y, image = y / alpha - again @ left, image - again @ images
            unit = np.sqrt(max(square - again @ again, 0.0))
            y, image, alpha = y / unit, image / unit, alpha * unit
        else:
            # Xv lies in the earlier left vectors' span: a left vector of zeros, which adds no row
            y, image, alpha = np.zeros(d), np.zeros(d), 0.0
        left, images = np.vstack([left, y]), np.vstack([images, image])
        upper[: k + 1, k] = np.append(inner, alpha)
        v = image - right.T @ (right @ image)
        v -= right.T @ (right @ v)
        beta = np.linalg.norm(v)
        if k + 1 == d or (k + 1 >= 2 * wanted and k % 4 == 3):
            p, sizes, q = np.linalg.svd(upper[: k + 1, : k + 1])
            # a product that vanishes says nothing of the directions outside its space
            if k + 1 == d or (beta > 1e-10 * scale and beta * np.abs(p[k, :wanted]).max() <= tolerance * sizes[0]):
                return (q @ right)[:wanted], sizes[:wanted], k + 1
        v = v / beta if beta > 1e-10 * scale else fresh()


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Components of ``rows`` (see :func:`usable_vectors`); None if there are no rows."""
    first = rows.select(F.size("x")).first()
    if first is None:
        return None
    # whole sums, exact: the high and low halves of the numbers are added apart
    high = F.transform("x", lambda c: F.floor(c / float(1 << 26)))
    halves = rows.select(F.posexplode(F.arrays_zip(high.alias("h"), F.col("x").alias("c"))).alias("place", "e"))
    halves = halves.groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("e.h").cast("decimal(18,0)")).alias("h"),
                                         F.sum((F.col("e.c") - F.col("e.h") * float(1 << 26)).cast("decimal(10,0)")).alias("l"))
    found = sorted(halves.collect(), key=lambda r: r["place"])
    n, sums = found[0]["n"], [(int(r["h"]) << 26) + int(r["l"]) for r in found]
    mean = np.array([s / n for s in sums])
    vectors, sizes, steps = bidiagonalise(rows, mean, min(components, len(sums)))
    total = _summed(rows, lambda x: np.array([np.square(x - mean).sum()]), 1)[0] / n
    variances = sizes**2 / n
    real = variances > len(sums) * 1e-13 * max(total, 0.0)
    return Whitening(n, sums, vectors[real], variances[real], float(total), steps)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, deviation and whitened (a list, one number a component) of each row.

    ``deviation`` is the sum over dimensions of (n x - S)^2, exact; null if that is no 64-bit number.
    """
    if model is None:
        return rows.selectExpr("vec_id", "cast(null as long) deviation", "cast(null as array<double>) whitened").limit(0)
    sums, mean, n = np.array(model.sums, dtype=object), model.mean, model.rows
    onto = model.components.T / np.sqrt(model.variances)

    def exact(x: np.ndarray) -> list[int | None]:
        widest = float(np.abs(x - mean).max()) * n + 1
        if n * float(np.abs(x).max()) < 2.0**61 and widest**2 * x.shape[1] < 2.0**62:
            away = x.astype(np.int64) * n - sums.astype(np.int64)
            return (away * away).sum(axis=1).tolist()
        away = [[int(c) * n - s for c, s in zip(row, model.sums)] for row in x]
        return [v if v < 1 << 63 else None for v in (sum(a * a for a in row) for row in away)]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                z = (x - mean) @ onto
                cuts = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(exact(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening | None) -> float:
    """The largest entry, without sign, of the whitened rows' covariance minus the identity."""
    if model is None or not len(model.variances):
        return 0.0
    mean, onto, k = model.mean, model.components.T / np.sqrt(model.variances), len(model.variances)

    def part(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ onto
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    out = _summed(rows, part, k * k + k)
    centre = out[k * k :] / model.rows
    return float(np.abs(out[: k * k].reshape(k, k) / model.rows - np.outer(centre, centre) - np.eye(k)).max())


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each usable vector and component. Vectors that do not vary give no rows."""
    # 1024 times a single-precision number is exact
    scaled = F.transform("embedding", lambda c: F.when(F.abs(c.cast("double")) < 2.0**40, F.floor(c.cast("double") * 1024) + F.lit(100000)).cast("double"))
    rows = usable_vectors(table(spark, sf_dir, "embeddings"), scaled)
    model = fit_whitening(rows)
    error = identity_error(rows, model)
    explained = (model.variances / model.total).tolist() if model is not None else []
    share = F.element_at(F.lit(explained).cast("array<double>"), F.col("component"))
    out = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    out = out.withColumn("component", F.col("place") + 1)
    return out.select("vec_id", "component", F.lit(model.rows if model else 0).cast("long").alias("n"), "deviation", "whitened",
                      share.alias("explained"), F.lit(error).alias("identity_error"))
