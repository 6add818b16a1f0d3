"""Embedding whitening: principal components by spectral divide and conquer, applied by broadcast.

1. One pass counts the vectors and adds up their entries, exactly.
2. One pass adds up the products of the centred entries: the covariance, one matrix
   row of it per group, so no task holds more than a matrix.
3. The covariance (dimensions squared, whatever the number of rows) is split on the
   driver. The polar factor of ``A - shift`` is found by the dynamically weighted Halley
   iteration in its QR form (Cholesky form once it is well conditioned); half of it plus
   the identity is the projector on the components above the shift. A random block
   times the projector gives bases of both invariant subspaces, and the smaller
   problems are split again until they are diagonal. Parts without a wanted component
   are left alone.
4. The wanted components, divided by the root of their eigenvalue, are broadcast
   (dimensions x components numbers) and every row is projected. One pass more
   measures the covariance of the result.

* a null vector, and one with a null or non-finite entry, is left out, as is one with an
  entry that as a whole number reaches 2**53, where doubles have no more units
* vectors of another length than the commonest (the longer one if two are) are left out
* repeated rows, and rows with a null id, each get their rows
* components whose variance is rounding noise beside the largest are not returned, so
  equal vectors, a single one, and an empty table give an empty result
* a deviation of 10**38 or more is null
* components of equal variance are any basis of their space, the same for all rows
* other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The whole numbers that entries become: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
_LOW = 26
_LARGEST = 2.0**53


class Moments(NamedTuple):
    """Number of vectors and the exact sum of each entry."""

    count: int
    sums: list[int]


class Whitening(NamedTuple):
    """``vectors`` has one component a column; ``explained`` is the share of all variance."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


# -- spectral divide and conquer ----------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix; for one this is its sign."""
    x = a / np.linalg.norm(a)
    eye, low = np.eye(len(a)), EPS
    for _ in range(60):
        square = low * low
        g = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + g)
        wa = root + np.sqrt(8 - 4 * g + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[: len(a)] @ q[len(a):].T)
        else:
            factor = np.linalg.cholesky(eye + wc * (x @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, np.linalg.solve(factor, x))
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns, as many as returned, span the upper
    invariant subspace; None if no shift divides the spectrum."""
    diagonal, n = np.diag(a), len(a)
    spread = np.linalg.norm(a - np.mean(diagonal) * np.eye(n))
    shifts = [np.median(diagonal), np.mean(diagonal)]
    shifts += [np.mean(diagonal) + part * spread / n for part in (1e-3, -1e-3, 0.1, -0.1, 0.3, -0.3)]
    for shift in shifts:
        sign = polar(a - shift * np.eye(n))
        upper = (sign + np.eye(n)) / 2
        rank = round(float(np.trace(upper)))
        if not 0 < rank < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-10 * n:
            continue
        basis = np.linalg.qr(upper @ rng.standard_normal((n, rank)))[0]
        basis = np.linalg.qr(upper @ basis, mode="complete")[0]
        return basis, rank
    return None


def leading(a: np.ndarray, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors."""
    rng = np.random.default_rng(seed)
    noise = EPS * np.linalg.norm(a)

    def parts(block: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
        n = len(block)
        diagonal = np.diag(block)
        halves = None
        if n > 1 and np.linalg.norm(block - np.diag(diagonal)) > noise:
            halves = split(block, rng)
        if halves is None:
            order = np.argsort(-diagonal, kind="stable")[:most]
            return [(float(diagonal[k]), np.eye(n)[:, k]) for k in order]
        basis, rank = halves
        found = []
        for own in (basis[:, :rank], basis[:, rank:]):
            if len(found) < most:
                inner = own.T @ block @ own
                found += [(e, own @ v) for e, v in parts((inner + inner.T) / 2, most - len(found))]
        return found

    found = sorted(parts((a + a.T) / 2, min(wanted, len(a))), key=lambda p: -p[0]) if len(a) else []
    vectors = np.array([v for _, v in found]).reshape(len(found), len(a)).T
    return np.array([e for e, _ in found]), vectors / np.maximum(np.linalg.norm(vectors, axis=0), EPS)


# -- passes over the vectors ---------------------------------------------------------


def usable(df: DataFrame, vector: str, name: str, scale: float = SCALE) -> DataFrame:
    """``df`` with the vector as doubles under ``name``, without those that take no part."""
    cell = F.col(name)
    sound = F.forall(cell, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < _LARGEST))
    out = df.withColumn(name, F.col(vector).cast("array<double>"))
    return out.where(cell.isNotNull() & F.coalesce(sound, F.lit(False)))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """The rows' entries as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * values).astype("i8") + OFFSET).reshape(len(column), -1)


def centred(x: np.ndarray, moments: Moments) -> np.ndarray:
    """``n * x - S``, exact: in 64 bits if they suffice, as Python's numbers if not."""
    n, sums = moments
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return n * x - np.array(sums, "i8")
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def sums_of(vectors: DataFrame, name: str) -> Moments:
    """Vectors of the commonest length: how many, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        count = 0
        for batch in batches:
            x = whole_numbers(batch.column(0))
            high = (x >> _LOW).sum(axis=0) + (0 if high is None else high)
            low = (x & ((1 << _LOW) - 1)).sum(axis=0) + (0 if low is None else low)
            count += len(x)
        if count:
            size = len(high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(high), pa.array(low), pa.array([count] * size, pa.int64())],
                names=["place", "high", "low", "count"],
            )

    big = "decimal(38,0)"
    rows = (
        vectors.select(name).mapInArrow(run, "place int, high bigint, low bigint, count bigint")
        .groupBy("place").agg(*(F.sum(F.col(c).cast(big)).alias(c) for c in ("high", "low", "count")))
        .orderBy("place").collect()
    )
    sums = [(int(r["high"]) << _LOW) + int(r["low"]) for r in rows]
    return Moments(int(rows[0]["count"]) if rows else 0, sums)


def products_of(df: DataFrame, name: str, size: int, function) -> np.ndarray:
    """The sum over all rows of ``v' v``, ``function`` giving the rows ``v`` of a batch.

    Each task adds up its own; Spark adds up the rows of the matrix apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = function(batch.column(0))
            total += v.T @ v
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["place", "row"]
        )

    cells = df.select(name).mapInArrow(run, "place int, row array<double>").select("place", F.posexplode("row").alias("at", "x"))
    found = cells.groupBy("place", "at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((size, size))
    out[found["place"].to_numpy(), found["at"].to_numpy()] = found["x"].to_numpy()
    return out


def fit(vectors: DataFrame, name: str, components: int = COMPONENTS) -> Whitening:
    moments = sums_of(vectors, name)
    n, size = moments.count, len(moments.sums)
    covariance = products_of(
        vectors, name, size, lambda column: (centred(whole_numbers(column), moments) / n).astype(float)
    ) / max(n, 1)
    values, found = leading(covariance, components)
    kept = values > max(size, 1) * 8 * EPS * max(values[0] if len(values) else 0.0, 0.0)
    values, found = values[kept], found[:, kept]
    return Whitening(moments, found, values, values / np.trace(covariance) if len(values) else values)


def whiten(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Columns: the id, component, n, deviation (decimal), whitened, explained, identity_error."""
    name = "_vector"
    kept = usable(df.select(F.col(id).alias("_id"), F.col(vector).alias(name)), name, name)
    lengths = kept.groupBy(F.size(name).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kept = kept.where(F.size(name) == (lengths["size"] if lengths else 0))
    id_type = df.schema[id].dataType.simpleString()
    schema = (
        f"`{id}` {id_type}, component int, n bigint, deviation decimal(38,0), "
        "whitened double, explained double, identity_error double"
    )
    if not lengths or not lengths["size"]:
        return df.sparkSession.createDataFrame([], schema)
    model = fit(kept, name, components)
    moments, count = model.moments, len(model.values)
    scaled = df.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values))

    def project(d: np.ndarray) -> np.ndarray:
        return (d / moments.count).astype(float) @ scaled.value

    def measured(column: pa.Array) -> np.ndarray:
        # a column of ones beside the values gives their sums, too
        w = project(centred(whole_numbers(column), moments))
        return np.hstack([w, np.ones((len(w), 1))])

    error = 0.0
    if count:
        sums = products_of(kept, name, count + 1, measured)
        mean = sums[count, :count] / moments.count
        seen = sums[:count, :count] / moments.count - np.outer(mean, mean)
        error = float(np.abs(seen - np.eye(count)).max())
    explained = model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = centred(whole_numbers(batch.column(1)), moments)
            rows = np.repeat(np.arange(len(d)), count)
            exact = pa.array([Decimal(x) if x < 10**38 else None for x in deviations(d)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, count + 1, dtype="i4"), len(d))),
                pa.array(np.full(len(rows), moments.count, "i8")),
                exact.take(pa.array(rows)),
                pa.array(project(d).ravel()),
                pa.array(np.tile(explained, len(d))),
                pa.array(np.full(len(rows), error)),
            ], names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    if not count:
        return df.sparkSession.createDataFrame([], schema)
    return kept.select("_id", name).mapInArrow(run, schema)
