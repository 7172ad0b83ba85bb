"""Whitening of embeddings by a compensated covariance.

An entry c becomes the integer x = floor(64 * c) + 1000000, far from zero, where products of raw values would
cancel. A first pass adds x exactly. A second one centres each x on the exact mean S / n, held as a double-double (an
unevaluated sum of two doubles), and adds the outer products in double-double: the rounding error of each product and
of each sum is found by error-free transformations (Dekker's product, Knuth's sum) and carried in the low part. Tasks
merge high and low parts by the same sums, in two levels, so that one matrix for each vector length reaches the driver.
There `numpy.linalg.eigh`, LAPACK's `syevd`, reduces it to a tridiagonal matrix and solves that by divide and conquer. A
third pass measures the whitened vectors' own covariance, the last one writes them.

What grows with the data is read in lots and added up; what travels is bounded by the square of a vector's length.

Cases: rows whose vector is null or empty, or holds null or non-finite entries, or entries of 2**56 and more (whose x no
long holds), are left out; vectors of different length are whitened apart, each length with its own n and S; a
component without variance (an eigenvalue up to 1e-12 of the largest) has a null `whitened` and isn't part of
identity_error (which is null where no component has variance); a deviation that no long holds is null; rows with equal
or null ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .embeddings import by_dimension

COMPONENTS, SCALE, SHIFT = 32, 64.0, 1_000_000
#: Eigenvalues up to this share of the largest count as none.
FLAT = 1e-12
#: Products held at once.
PRODUCTS = 1 << 17


# Double-doubles: pairs (high, low) of arrays.


def two_sum(a, b):
    """a + b as a rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """a as two numbers of 26 bits each, whose products are exact."""
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def add(a, b):
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def integers(x: np.ndarray):
    """64-bit integers as double-doubles."""
    high = x.astype(np.float64)
    return high, (x - high.astype(np.int64)).astype(np.float64)


def exact(value: Fraction):
    high = float(value)
    return high, float(value - Fraction(high))


def outer_sum(y, upper) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of the products y[i] * y[j] for the places (i, j) of `upper`."""
    i, j = upper
    high, low = y
    h, t = halves(high)
    p = high[:, i] * high[:, j]
    e = ((h[:, i] * h[:, j] - p) + h[:, i] * t[:, j] + t[:, i] * h[:, j]) + t[:, i] * t[:, j]
    e += high[:, i] * low[:, j] + low[:, i] * high[:, j]
    while len(p) > 1:
        half = len(p) // 2
        s, r = two_sum(p[:half], p[half : 2 * half])
        r += e[:half] + e[half : 2 * half]
        p, e = (s, r) if len(p) % 2 == 0 else (np.concatenate((s, p[-1:])), np.concatenate((r, e[-1:])))
    return two_sum(p[0], e[0])


# What tasks add up.


def grid(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def sound(column: str):
    return F.expr(f"coalesce({column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < {2.0**56!r}D), false)")


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors their number and the exact sums of x."""

    def run(it):
        n: dict[int, int] = {}
        s: dict[int, np.ndarray] = {}
        for b in it:
            for d, (rows, v) in by_dimension(b.column(0)).items():
                x = grid(v)
                part = x.sum(0).astype(object) if np.abs(x).max() < 1 << 50 else x.astype(object).sum(0)
                n[d], s[d] = n.get(d, 0) + len(rows), s.get(d, 0) + part
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array([Decimal(v) for v in s[d]], pa.decimal128(38, 0))], names=["d", "i", "n", "s"])

    parts = arrow_map(vectors.select("embedding"), run, "d int, i int, n long, s decimal(38, 0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "i").collect():  # a row for each dimension
        found.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return found


def centred(v: np.ndarray, n: int, s: list[int]):
    """x - S / n as double-doubles."""
    mean = np.array([exact(Fraction(-t, n)) for t in s]).T
    return add(integers(grid(v)), (np.broadcast_to(mean[0], v.shape), np.broadcast_to(mean[1], v.shape)))


def totals(vectors: DataFrame, measure: Callable, merge: Callable) -> dict[int, np.ndarray]:
    """For each length d of vectors the merged measure(d, vectors): an array of doubles. Tasks merge their lots,
    as many tasks as there are cores those of all, one task for each length the rest."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["d", "x"])

    def run(it):
        found: dict[int, np.ndarray] = {}
        for b in it:
            for d, (_, v) in by_dimension(b.column(0)).items():
                step = max(1, 2 * PRODUCTS // (d * (d + 1)))
                for k in range(0, len(v), step):
                    x = measure(d, v[k : k + step])
                    found[d] = merge(d, found[d], x) if d in found else x
        if found:
            yield batch(found)

    def join(it):
        found: dict[int, np.ndarray] = {}
        for b in it:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.float64)
                found[d] = merge(d, found[d], x) if d in found else x
        if found:
            yield batch(found)

    schema = "d int, x binary"
    parts = arrow_map(vectors.select("embedding"), run, schema)
    few = arrow_map(parts.repartition(vectors.sparkSession.sparkContext.defaultParallelism), join, schema)
    merged = arrow_map(few.repartition("d"), join, schema)
    return {r["d"]: np.frombuffer(r["x"], np.float64) for r in merged.collect()}  # a matrix for each length


def covariances(vectors: DataFrame, fit: dict) -> dict[int, np.ndarray]:
    """The covariance of x for each length, divisor n, rounded once from its double-double."""

    def measure(d, v):
        return np.concatenate(outer_sum(centred(v, *fit[d]), np.triu_indices(d)))

    def merge(d, a, b):
        return np.concatenate(add(np.split(a, 2), np.split(b, 2)))

    out = {}
    for d, x in totals(vectors, measure, merge).items():
        n, (high, low) = fit[d][0], np.split(x, 2)
        v = np.zeros((d, d))
        v[np.triu_indices(d)] = high / n + low / n
        out[d] = v + np.triu(v, 1).T
    return out


def identity_errors(vectors: DataFrame, fit: dict, maps: dict) -> dict[int, float]:
    """The largest entry of the whitened vectors' covariance less the identity, measured on these vectors: means and
    centred products of lots, merged pairwise."""

    def measure(d, v):
        w = centred(v, *fit[d])[0] @ maps[d]
        mean = w.mean(0)
        return np.concatenate(([len(w)], mean, ((w - mean).T @ (w - mean)).ravel()))

    def merge(d, a, b):
        k = maps[d].shape[1]
        n, gap = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        return np.concatenate(([n], a[1 : k + 1] + gap * (b[0] / n), a[k + 1 :] + b[k + 1 :] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)))

    out = {}
    for d, x in totals(vectors, measure, merge).items():
        k = maps[d].shape[1]
        if k:
            out[d] = float(np.abs(x[k + 1 :].reshape(k, k) / x[0] - np.eye(k)).max())
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
    most = max(int(np.abs(x).max()), max(map(abs, s)) // n + 1)
    if len(s) * (2 * n * most) ** 2 < 1 << 62 or (n * most < 1 << 61 and len(s) * float(np.abs(x * n - np.array(s, np.int64)).max()) ** 2 < 1 << 62):
        gap = x * n - np.array(s, np.int64)
        return (gap * gap).sum(1).tolist()
    gap = x.astype(object) * n - np.array(s, object)
    return [int(t) if t < 1 << 63 else None for t in (gap * gap).sum(1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors' rows (vec_id, embedding) as (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = vectors.where(sound("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = sums(rows)
    maps, shares = {}, {}
    for d, v in covariances(rows, fit).items():
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        used = int((e > FLAT * max(e[0], 0)).sum())
        maps[d] = u[:, :used] / np.sqrt(e[:used])
        trace = float(np.trace(v))
        shares[d] = [float(max(t, 0) / trace) if trace > 0 else 0.0 for t in e]
    errors = identity_errors(rows, fit, maps)

    def run(it):
        for b in it:
            out: list[list] = [[None] * b.num_rows for _ in range(5)]
            for d, (at, v) in by_dimension(b.column(1)).items():
                w = centred(v, *fit[d])[0] @ maps[d]
                pad = [None] * (len(shares[d]) - w.shape[1])
                for i, dev, white in zip(at.tolist(), deviations(grid(v), *fit[d]), w.tolist()):
                    for column, value in zip(out, (fit[d][0], dev, white + pad, shares[d], errors.get(d))):
                        column[i] = value
            kinds = pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], names=["vec_id", "n", "deviation", "w", "shares", "identity_error"])

    made = arrow_map(rows, run, "vec_id long, n long, deviation long, w array<double>, shares array<double>, identity_error double")
    long = made.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "shares")).alias("k", "c"))
    return long.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.shares").alias("explained"), "identity_error")
