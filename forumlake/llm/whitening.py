"""Embedding whitening along the leading eigenvectors, isolated by spectrum slicing.

Entries become integers (``floor(scale * c)``), so sums, the covariance and deviations are
exact and do not depend on the order in which rows arrive.

1. The fit list holds each distinct integer vector once: a group by the vector's bytes, which
   combines copies before the shuffle. It is a table in the shared folder.
2. Sums of the fit list, then its covariance: products of vectors centred on the rounded
   mean are added as integers and corrected for the rest of the mean as fractions. Tasks
   send one partial sum each, cell by cell, for Spark to add.
3. The covariance (dimensions squared, whatever the rows) is solved on the driver. Counting
   the positive pivots of an LDL^T factorisation of V - sI tells how many eigenvalues exceed
   s; bisection on that count isolates each leading eigenvalue, Rayleigh quotient iteration
   converges cubically inside its interval, and counts on both sides certify its number.
   Eigenvalues that no double tells apart share an interval; their vectors are orthogonal.
4. Every row is projected in the tasks, and the covariance of the whitened fit list is
   measured against the identity.

Defined results: a row goes if its vector is NULL, empty, holds a NULL or a non-finite entry,
or has another length than the most frequent one (of equally frequent ones, the greatest);
integers beyond 64 bits are held at their bounds; a ``deviation`` beyond 64 bits is NULL. A
direction without variance (to rounding) has no component, so a table of one distinct vector gives
no rows. NULL ids and repeated rows give rows of their own; other columns are ignored; an
empty table gives an empty one. Above ``EXACT`` in the largest entry, covariance sums are
doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from forumlake.session import stage

SCALE, COMPONENTS = 256, 4
BLOCK = 1 << 16  # rows that are multiplied at once
EXACT = 1 << 16  # entries up to this have exact sums of products: (2 * EXACT)^2 * BLOCK < 2^53
STEPS = 60  # of Rayleigh quotient iteration, before an interval is cut further
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
_LEAST, _MOST = -(2.0**63), 2.0**63 - 1024


def packed(vectors: pa.Array, scale: int) -> list[bytes | None]:
    """Bytes of every integer vector, in the narrowest width that holds its entries; None for a vector that goes."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray([0 if s is None else s for s in pc.list_value_length(vectors).to_pylist()], np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat * scale) + 0.0
    out: list[bytes | None] = []
    for start, size in zip(np.cumsum(sizes) - sizes, sizes):
        part, raw = whole[start : start + size], flat[start : start + size]
        if not size or not np.isfinite(raw).all():
            out.append(None)
            continue
        most = np.abs(part).max()
        width = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        out.append(width[-1].encode() + np.clip(part, _LEAST, _MOST).astype(width).tobytes())
    return out


def unpacked(vectors: list[bytes], dims: int) -> np.ndarray:
    """The vectors as rows of 64-bit integers."""
    out = np.zeros((len(vectors), dims), np.int64)
    for width in b"248":
        at = [k for k, v in enumerate(vectors) if v[0] == width]
        if at:
            out[at] = np.frombuffer(b"".join(vectors[k][1:] for k in at), f"<i{chr(width)}").reshape(len(at), dims)
    return out


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x, dims) of the rows whose vectors can be used, whatever their lengths."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = packed(batch.column(1), scale)
            dims = [None if v is None else (len(v) - 1) // (v[0] - 48) for v in held]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "x", "dims"])
            yield made.filter(pc.is_valid(made.column(1)))

    return rows.mapInArrow(each, "vec_id bigint, x binary, dims int")


def sums_of(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Vectors, sums by dimension, and the largest entry by size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, np.zeros(dims, object), 0
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dims)
            if len(x):
                low, high = int(x.min()), int(x.max())
                most = max(most, -low, high)
                total += (x if most < 2**31 else x.astype(object)).sum(axis=0).astype(object)
                n += len(x)
        if n:
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string())
            columns = (range(dims), [n] * dims, [str(s) for s in total], [str(most)] * dims)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "n", "total", "most"])

    parts = fit.select("x").mapInArrow(each, "i int, n bigint, total string, most string")
    whole = lambda name: F.col(name).cast("decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(whole("total")).alias("total"), F.max(whole("most")).alias("most")).orderBy("i").collect()  # one a dimension
    return rows[0]["n"], [int(r["total"]) for r in rows], int(rows[0]["most"])


def added_products(rows: DataFrame, columns: int, make, exact: bool) -> np.ndarray:
    """The sum over all rows of the outer products of ``make(batch)``'s rows; integers if ``exact``."""
    kind = pa.int64() if exact else pa.float64()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns), np.int64 if exact else np.float64)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                y = make(batch.slice(k, BLOCK))
                total += (y.T @ y).astype(total.dtype)
        i, j = np.triu_indices(columns)
        yield pa.RecordBatch.from_arrays([pa.array(i * columns + j, pa.int64()), pa.array(total[i, j], kind)], names=["cell", "value"])

    parts = rows.mapInArrow(each, f"cell bigint, value {'bigint' if exact else 'double'}")
    value = F.col("value").cast("decimal(38,0)") if exact else F.col("value")
    summed = parts.groupBy("cell").agg(F.sum(value).alias("value")).collect()  # dimensions squared, halved
    out = np.zeros((columns, columns), object if exact else np.float64)
    for cell, value in summed:
        i, j = divmod(cell, columns)
        out[i, j] = out[j, i] = int(value) if exact else value
    return out


def covariance(fit: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """Of the fit list, divisor n, every entry rounded once."""
    dims = len(sums)
    centre = np.asarray([round(Fraction(s, n)) for s in sums], np.int64)
    exact = most <= EXACT
    mean = np.asarray([float(Fraction(s, n)) for s in sums])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        x = unpacked(batch.column(0).to_pylist(), dims)
        return (x - centre).astype(np.float64) if exact else x - mean

    products = added_products(fit.select("x"), dims, centred, exact)
    if not exact:
        return products / n
    rest = [s - n * int(c) for s, c in zip(sums, centre)]  # of the sums, after centring
    return np.asarray([[float(Fraction(n * products[i, j] - rest[i] * rest[j], n * n)) for j in range(dims)] for i in range(dims)])


def positive_pivots(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: of the pivots of its LDL^T factorisation, by Sylvester's law.

    Pivots are the largest entry of the diagonal, or a two-by-two block around the largest entry where the diagonal is small.
    """
    a, positive = a.copy(), 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        d = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), len(a))
        if max(diagonal[d], off[i, j]) == 0:
            break
        if diagonal[d] >= 0.64 * off[i, j]:  # keeps the growth of entries least
            positive += a[d, d] > 0
            at, rest = [d], np.delete(np.arange(len(a)), d)
        else:
            at, rest = [i, j], np.delete(np.arange(len(a)), [i, j])
            positive += 1  # its determinant is negative: one eigenvalue of each sign
        step = a[np.ix_(rest, at)]
        a = a[np.ix_(rest, rest)] - step @ np.linalg.solve(a[np.ix_(at, at)], step.T)
        a = (a + a.T) / 2
    return positive


def leading_eigenpairs(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest positive eigenvalues, falling, and unit eigenvectors as columns."""
    size = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) if size else 0.0  # no eigenvalue is greater
    least = scale * size * np.finfo(float).eps
    above = lambda s: positive_pivots(v - s * np.eye(size))
    values: list[float] = []
    vectors = np.zeros((size, 0))
    for number in range(1, min(most, size) + 1):
        low, high = least, values[-1] + least if values else scale * (1 + 1e-9) + least
        over_low, over_high = above(low), number - 1 if not values else above(high)
        if over_low < number:
            break
        found = None
        while found is None:
            # Cut the interval until only this eigenvalue is in it, or it is as narrow as doubles allow.
            alone = over_low == number and over_high == number - 1
            middle = (low + high) / 2
            narrow = high - low <= 4 * least or not low < middle < high
            if alone or narrow:
                found = rayleigh(v, low, high, vectors, least, 0.0 if alone else least)
            if found is None and narrow:
                raise ArithmeticError(f"eigenvalue {number} did not converge")
            if found is None:
                over = above(middle)
                if over >= number:
                    low, over_low = middle, over
                else:
                    high, over_high = middle, over
        value, vector = found
        if above(value - 4 * least) < number or above(value + 4 * least) > number - 1 and (not values or values[-1] - value > 8 * least):
            raise ArithmeticError(f"eigenvalue {number} is not certified by its counts")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.asarray(values), vectors


def rayleigh(v: np.ndarray, low: float, high: float, known: np.ndarray, least: float, slack: float) -> tuple[float, np.ndarray] | None:
    """An eigenvalue in the interval and its unit vector, orthogonal to ``known``; None if the iteration leaves the interval."""
    size = len(v)
    x = np.random.default_rng(size).standard_normal(size)
    shift = (low + high) / 2
    for step in range(STEPS):
        x /= np.linalg.norm(x)
        left = 0.0
        while left < 0.7:  # again, while what rounding left of the known directions counts
            x = x - known @ (known.T @ x)
            left = float(np.linalg.norm(x))
            x /= left
        quotient = float(x @ v @ x)
        error = float(np.linalg.norm(v @ x - quotient * x))
        if low - slack <= quotient <= high + slack and error <= least:
            return quotient, x
        if step >= 2:  # two steps towards the middle first
            if not low <= quotient <= high:
                return None
            shift = quotient
        try:
            x = np.linalg.solve(v - shift * np.eye(size), x)
        except np.linalg.LinAlgError:  # the shift is the eigenvalue
            x = np.linalg.solve(v - (shift + least) * np.eye(size), x)
    return None


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2 of every row."""
    most, largest = int(max(-int(x.min()), int(x.max()))) if x.size else 0, max(map(abs, sums), default=0)
    if len(sums) * most * max(most, largest, 1) < 2**62:
        squares, crossed = (x * x).sum(axis=1), x @ np.asarray(sums, np.int64)
    else:
        big = x.astype(object)
        squares, crossed = (big * big).sum(axis=1), big @ np.asarray(sums, object)
    own = sum(s * s for s in sums)
    found = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, crossed)]
    return [d if d < 2**63 else None for d in found]


def whitened_embeddings(
    rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per remaining row and component: ``whitened`` (unit variance over the fit list), ``explained``, ``deviation`` and ``identity_error``."""
    context = rows.sparkSession.sparkContext
    rows = usable(rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")), scale)
    lengths = rows.groupBy("dims").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dims")).alias("top")).first()["top"]
    schema = f"{WHITENED}, identity_error double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = lengths["dims"]
    rows = rows.where(F.col("dims") == dims)
    fit = stage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit-list")
    n, sums, most = sums_of(fit, dims)
    v = covariance(fit, n, sums, most)
    values, vectors = leading_eigenpairs(v, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    mean = np.asarray([float(Fraction(s, n)) for s in sums])
    shared = context.broadcast((mean, vectors, np.sqrt(values), values / np.trace(v)))

    def projected(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mean, vectors, roots, _ = shared.value
        x = unpacked(held, dims)
        return x, (x - mean) @ vectors / roots

    identity = added_products(fit.select("x"), len(values), lambda batch: projected(batch.column(0).to_pylist())[1], False) / n - np.eye(len(values))
    error = float(np.abs(identity).max())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = shared.value[3]
        k = len(explained)
        for batch in batches:
            x, white = projected(batch.column(1).to_pylist())
            m = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.select("vec_id", "x").mapInArrow(each, WHITENED).withColumn("identity_error", F.lit(error))
