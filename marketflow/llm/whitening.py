"""Whitening of embeddings by spectrum slicing.

Entries become integers, so counts, sums and the scatter matrix are exact whatever the partitioning. The covariance is one small
matrix (dimension squared). Its leading eigenvalues are isolated by inertia counts: the signs of the pivots of an LDL'
factorisation of ``V - s I`` say how many eigenvalues lie above ``s``. Rayleigh quotient iteration then converges cubically to the
eigenpair of the bracket, and counts just above and below the value found certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.vectors import EXACT, LONG, finite, integers, scaled

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
CHUNK = 1024
LIMB = 1 << 64
ARROW = {"int": pa.int32(), "double": pa.float64(), "decimal(38,0)": pa.decimal128(38, 0)}
NO_VARIANCE = 1e-12  # eigenvalues below this share of the trace are rounding noise and have no whitened component
PIVOT_RATIO = (1 + 17**0.5) / 8  # growth-minimising choice between pivots of order one and two


# Eigenvalues of one symmetric matrix


def inertia(matrix: np.ndarray, shift: float) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix lie above, at and below ``shift``: pivot signs of LDL' with symmetric pivoting."""
    m = np.array(matrix, dtype=np.float64)
    size = len(m)
    m[np.diag_indices(size)] -= shift
    above = below = k = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < size:
        column = np.abs(m[k + 1 :, k])
        largest = column.max(initial=0.0)
        if largest == 0 and m[k, k] == 0:
            k += 1
            continue
        order = 1
        if abs(m[k, k]) < PIVOT_RATIO * largest:
            r = k + 1 + int(column.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            if abs(m[k, k]) * row.max() < PIVOT_RATIO * largest**2:
                if abs(m[r, r]) >= PIVOT_RATIO * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    order = 2
        rest = slice(k + order, size)
        if order == 1:
            above, below = above + (m[k, k] > 0), below + (m[k, k] < 0)
            m[rest, rest] -= np.outer(m[rest, k], m[k, rest] / m[k, k])
        else:  # a block of order two is chosen only where it is indefinite
            above, below = above + 1, below + 1
            m[rest, rest] -= m[rest, k : k + 2] @ np.linalg.solve(m[k : k + 2, k : k + 2], m[k : k + 2, rest])
        k += order
    return int(above), size - int(above) - int(below), int(below)


def _iterate(matrix: np.ndarray, shift: float, known: list[np.ndarray], seed: int, close: float) -> tuple[float, np.ndarray] | None:
    """Two inverse iterations at ``shift``, then Rayleigh quotient iteration; orthogonal to the vectors already found."""
    size = len(matrix)
    x = np.random.default_rng(seed).standard_normal(size)

    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in known:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    x, best = unit(x), None
    for step in range(24):
        value = x @ matrix @ x if step > 1 else shift
        if step > 1:
            misfit = float(np.linalg.norm(matrix @ x - value * x))
            if best is not None and misfit >= best[0] and best[0] <= close:
                break
            if best is None or misfit < best[0]:
                best = misfit, float(value), x
        try:
            solved = np.linalg.solve(matrix - value * np.eye(size), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            solved = np.linalg.solve(matrix - (value + close / 8) * np.eye(size), x)
        if not np.isfinite(solved).all():
            break
        x = unit(solved)
    return (best[1], best[2]) if best is not None and best[0] <= close else None


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as rows; each certified by inertia counts.

    Equal eigenvalues share a bracket and get orthogonal vectors of their space.
    """
    matrix = np.asarray(matrix, dtype=np.float64)
    size = len(matrix)
    reach = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if size == 0 or reach == 0:
        count = min(count, size)
        return np.zeros(count), np.eye(size)[:count]
    close = 8 * size * np.finfo(float).eps * reach
    slices = {-2 * reach: size, 2 * reach: 0}

    def above(shift: float) -> int:
        if shift not in slices:
            slices[shift] = inertia(matrix, shift)[0]
        return slices[shift]

    values: list[float] = []
    found: list[np.ndarray] = []
    for number in range(1, min(count, size) + 1):
        while True:
            low = max(s for s, n in slices.items() if n >= number)
            high = min(s for s, n in slices.items() if n < number and s > low)
            single = slices[low] == number and slices[high] == number - 1
            if single or high - low <= close:
                pair = _iterate(matrix, (low + high) / 2, found, number, close)
                if pair and low - close <= pair[0] <= high + close and above(pair[0] - 2 * close) >= number > above(pair[0] + 2 * close):
                    values.append(pair[0])
                    found.append(pair[1])
                    break
                if high - low <= close / 4:
                    raise ArithmeticError(f"eigenvalue {number} near {low} was not certified")
            above((low + high) / 2)
    return np.array(values), np.array(found)


# The model


@dataclass(frozen=True)
class Whitener:
    """Exact counts and sums of the fit list, and its leading eigenpairs."""

    n: int
    centre: tuple[int, ...]  # per dimension, the integer next to the mean
    residue: tuple[int, ...]  # per dimension, S - n * centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.centre)

    @property
    def offsets(self) -> np.ndarray:
        return np.array([float(Fraction(r, self.n)) for r in self.residue])


def _centred(x: np.ndarray, centre: tuple[int, ...]) -> np.ndarray:
    """x - centre, exactly: doubles where they hold it, else Python integers."""
    if np.abs(x).max(initial=0) < EXACT / 2 and max(map(abs, centre)) < EXACT / 2:
        return x + float(OFFSET) - np.array(centre, dtype=np.float64)
    return integers(x) + OFFSET - np.array(centre, dtype=object)


def _wide(value: int) -> Decimal:
    with localcontext() as context:
        context.prec = 60
        return Decimal(value)


def _matrices(vectors: DataFrame, vector: str, width: int, work: Callable[[Iterator[np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """``work`` turns the integer chunks of one partition into its few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = work(scaled(b.column(0).slice(at, CHUNK), SCALE, width) for b in batches for at in range(0, b.num_rows, CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [field.split()[0] for field in schema.split(", ")]
    types = [ARROW[field.split()[1]] for field in schema.split(", ")]
    return vectors.filter(F.size(vector) == width).select(vector).mapInArrow(run, schema)


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that take part: see ``fit``."""
    return vectors.filter(finite(F.col(vector), SCALE))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Fit the whitener on all rows of ``vectors`` that hold a usable vector; None where there are none.

    Not usable: null and empty vectors, and those with a null, a non-finite or an entry too large for a long. Vectors of another
    length than the most common one (ties: the shorter) take no part. Repeated rows count as often as they occur. Two scans; what
    reaches the driver is one number per dimension, then one per pair of dimensions. Components without variance are left out.
    """
    good = fit_list(vectors, vector)
    lengths = good.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not lengths:
        return None
    width, n = lengths[0]

    def sums(chunks: Iterator[np.ndarray]) -> list[tuple]:
        total = [0] * width
        for chunk in chunks:
            if np.abs(chunk).max(initial=0) * CHUNK < EXACT:
                add = [int(v) for v in chunk.sum(axis=0).tolist()]
            else:
                add = integers(chunk).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, add, strict=True)]
        return [(i, _wide(v)) for i, v in enumerate(total)]

    found = _matrices(good, vector, width, sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    totals = [int(r.s) + n * OFFSET for r in found]
    centre = tuple(round(Fraction(s, n)) for s in totals)
    residue = tuple(s - n * c for s, c in zip(totals, centre, strict=True))

    def scatter(chunks: Iterator[np.ndarray]) -> list[tuple]:
        total = np.zeros((width, width), dtype=object)
        whole, held = np.zeros((width, width)), 0.0
        for chunk in chunks:
            y = _centred(chunk, centre)
            bound = float(np.abs(y).max(initial=0)) ** 2 * len(y)
            if y.dtype != object and bound < EXACT:
                if held + bound >= EXACT:
                    total, whole, held = total + integers(whole), np.zeros((width, width)), 0.0
                whole, held = whole + y.T @ y, held + bound
            else:
                y = y if y.dtype == object else integers(y)
                total = total + y.T @ y
        total = total + integers(whole)
        return [(i, j, *map(_wide, divmod(int(total[i, j]), LIMB))) for i in range(width) for j in range(i, width)]

    parts = _matrices(good, vector, width, scatter, "i int, j int, high decimal(38,0), low decimal(38,0)")
    v = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        exact = n * (int(r.high) * LIMB + int(r.low)) - residue[r.i] * residue[r.j]
        v[r.i, r.j] = v[r.j, r.i] = float(Fraction(exact, n * n))
    trace = float(np.trace(v))
    values, rows = leading(v, components)
    keep = values > NO_VARIANCE * trace
    return Whitener(n, centre, residue, values[keep], rows[keep], trace)


def transform(vectors: DataFrame, model: Whitener, vector: str = "embedding") -> DataFrame:
    """The rows of the fit list with ``whitened`` (one double per component) and ``deviation``; input columns of those names are replaced.

    ``deviation`` is the exact sum over dimensions of (n * x - S) squared, a decimal(38,0): null where it needs more digits.
    """
    rest = fit_list(vectors, vector).filter(F.size(vector) == model.width).drop("whitened", "deviation")
    schema = rest.withColumns({"whitened": F.array(F.lit(0.0)), "deviation": F.lit(None).cast("decimal(38,0)")}).schema
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, rests = m.n, np.array(m.residue, dtype=object)
        constant, largest = int((rests * rests).sum()), max(map(abs, m.residue))
        weights = m.vectors.T / np.sqrt(m.values)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                y = _centred(scaled(piece.column(vector), SCALE, m.width), m.centre)
                most = int(np.abs(y).max(initial=0))
                if y.dtype != object and m.width * most * max(most, largest) < LONG / 2:
                    long = y.astype(np.int64)
                    squares, crosses = (long * long).sum(axis=1), long @ np.array(m.residue, dtype=np.int64)
                else:
                    long = y if y.dtype == object else integers(y)
                    squares, crosses = (long * long).sum(axis=1), long @ rests
                sizes = [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(squares.tolist(), crosses.tolist(), strict=True)]
                flat = (y.astype(np.float64) - m.offsets) @ weights
                ends = np.arange(len(y) + 1, dtype=np.int32) * flat.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))
                exact = pa.array([_wide(s) if s < 10**38 else None for s in sizes], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists, exact], [*piece.schema.names, "whitened", "deviation"])

    return rest.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitener, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured in one more scan."""
    count = len(model.values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def moments(chunks: Iterator[np.ndarray]) -> list[tuple]:
        m = shared.value
        weights = m.vectors.T / np.sqrt(m.values)
        first, second = np.zeros(count), np.zeros((count, count))
        for chunk in chunks:
            w = (_centred(chunk, m.centre).astype(np.float64) - m.offsets) @ weights
            first, second = first + w.sum(axis=0), second + w.T @ w
        return [(i, float(v)) for i, v in enumerate(np.concatenate([first, second.ravel()]).tolist())]

    found = _matrices(fit_list(vectors, vector), vector, model.width, moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    sums = np.array([r.s for r in found]) / model.n
    mean, second = sums[:count], sums[count:].reshape(count, count)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector of the fit list and component: key, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``, and ``deviation_exact`` (decimal).

    ``deviation`` is null where it does not fit a long. Other columns are left out; a null key stays. An empty table, or one
    whose vectors are all equal (no variance), gives no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    model = fit(rows, "v", components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, "v")
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    listed = transform(rows, model, "v").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    fits = F.when(F.col("deviation") < F.lit(str(LIMB // 2)).cast("decimal(38,0)"), F.col("deviation").cast("long"))
    return listed.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), fits.alias("deviation"), "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
