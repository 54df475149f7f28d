"""Embedding whitening by incremental eigendecomposition.

Each task keeps the eigenpairs of the scatter matrix of its vectors. A vector comes in as a centred rank-one update: the new
eigenvalues are the roots of a secular equation between the old ones, the new eigenvectors follow from them; directions that
the update does not touch and equal eigenvalues are deflated first. Two spectra are combined in the same way, one rank-one
update for each direction of the second and one for the difference of the means, sixteen spectra to a task until one is left.
Its vectors are a basis in which the covariance is nearly diagonal. A last pass over all vectors takes the covariance in that
basis (Rayleigh-Ritz) and its small eigenproblem leaves rounding errors of the data alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
FAN = 16
LOW_BITS = 26
MOST_LONG = (1 << 63) - 1
EPS = np.finfo(float).eps
ITERATIONS = 60


class Spectrum:
    """Eigenpairs (ascending) of the scatter matrix of the vectors seen so far, with their number and mean."""

    def __init__(self, size: int):
        self.n, self.mean = 0.0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.n += 1
        self.mean += off / self.n
        self.update(off, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.update(vector, value)
        total, off = self.n + other.n, other.mean - self.mean
        self.update(off, self.n * other.n / total)
        self.mean += off * (other.n / total)
        self.n = total

    def update(self, v: np.ndarray, weight: float) -> None:
        """Adds ``weight v v'`` to the scatter matrix."""
        d, q = self.values, self.vectors
        z = q.T @ v
        gain = weight * (z @ z)
        if not gain > 0:
            return
        small = 8 * EPS * max(d[-1], gain)
        # deflation of equal values: a reflection gathers their part of z in the last of them
        same = np.concatenate([[False], np.diff(d) <= small, [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            part = z[a : b + 1]
            length = np.sqrt(part @ part)
            if length > 0 and part[:-1].any():
                mirror = part.copy()
                sign = 1.0 if part[-1] >= 0 else -1.0
                mirror[-1] += sign * length
                q[:, a : b + 1] -= np.outer(q[:, a : b + 1] @ mirror, mirror * (2 / (mirror @ mirror)))
                z[a:b], z[b] = 0.0, -sign * length
        # deflation of directions that the update does not touch
        live = np.flatnonzero(weight * np.abs(z) * np.sqrt(z @ z) > small)
        if not len(live):
            return
        values, turn = secular(d[live], z[live], weight)
        d, q = d.copy(), q.copy() if len(live) < len(d) else q
        d[live] = values
        q[:, live] = self.vectors[:, live] @ turn
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.reshape(-1)]).tobytes()

    @staticmethod
    def from_bytes(data: bytes, size: int) -> Spectrum:
        out, flat = Spectrum(size), np.frombuffer(data, float)
        out.n, out.mean, out.values = float(flat[0]), flat[1 : size + 1].copy(), flat[size + 1 : 2 * size + 1].copy()
        out.vectors = flat[2 * size + 1 :].reshape(size, size).copy()
        return out


def row_sums(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, mask)


def secular(d: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of ``diag(d) + weight z z'``: ``d`` ascending and apart, no ``z`` zero.

    Root j of 1 + weight * sum z^2 / (d - x) lies between d[j] and d[j + 1] (the last one at most weight |z|^2 beyond d[-1]). It is
    sought as a distance from the nearer of its two poles, so that differences to all poles stay exact to rounding. A step
    replaces the poles on either side by one pole each with equal value and slope; a step out of its bracket becomes a bisection.
    """
    k = len(d)
    if k == 1:
        return d + weight * z * z, np.ones((1, 1))
    power = weight * z * z
    rows = np.arange(k)
    gap = np.append(np.diff(d), power.sum())
    middle = (power / (d - (d + gap / 2)[:, None])).sum(1)
    right = (middle < -1) & (rows < k - 1)  # the root is in the upper half: its pole is the next one
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    delta = d - origin[:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    above = (middle < -1) & (rows == k - 1)
    low[above], high[above] = gap[-1] / 2, gap[-1] * (1 + 4 * EPS)
    x = (low + high) / 2
    left = np.tri(k)
    beyond = 1 - left
    p1 = delta[rows, rows]
    p2 = np.append(delta[rows[:-1], rows[1:]], np.inf)
    last = k - 1
    for _ in range(ITERATIONS):
        apart = delta - x[:, None]
        term = power / apart
        slope = term / apart
        psi, phi = row_sums(term, left), row_sums(term, beyond)
        f = 1 + psi + phi
        done = (np.abs(f) <= 2 * EPS * k * (1 + np.abs(psi) + np.abs(phi))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        dpsi, dphi = row_sums(slope, left), row_sums(slope, beyond)
        with np.errstate(all="ignore"):
            e1, e2 = p1 - x, p2 - x
            a, b = dpsi * e1 * e1, dphi * e2 * e2
            c = 1 + psi - dpsi * e1 + phi - dphi * e2
            half = (c * (p1 + p2) + a + b) / 2
            rest = c * p1 * p2 + a * p2 + b * p1
            root = half + np.where(half >= 0, 1.0, -1.0) * np.sqrt(np.maximum(half * half - c * rest, 0.0))
            one, two = root / c, rest / root
            step = np.where((one > low) & (one < high), one, two)
            step[last] = p1[last] + dpsi[last] * e1[last] ** 2 / (1 + psi[last] - dpsi[last] * e1[last])
        inside = (step > low) & (step < high)
        x = np.where(done, x, np.where(inside, step, (low + high) / 2))
    apart = delta - x[:, None]  # d[i] - value[j]
    # the z for which these values are exact keeps the vectors orthogonal however close the values are
    poles = d[:, None] - d
    poles[rows, rows] = -1.0
    exact = np.sqrt(np.abs((apart / poles).prod(0)))
    vectors = (np.where(z < 0, -exact, exact) / apart).T
    return origin + x, vectors / np.sqrt((vectors * vectors).sum(0))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, x`` (longs): rows whose vector has entries, all of them finite and such that 1024 times each is below 2^52."""
    rows = named(vectors, id=vec_id, v=embedding).where("v is not null and size(v) > 0")
    wide = rows.select("id", F.transform("v", lambda c: c.cast("double") * SCALE).alias("v"))
    good = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 52)), F.lit(False)))
    return wide.where(good).select("id", F.transform("v", lambda c: F.floor(c).cast("bigint") + SHIFT).alias("x"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def per_task(rows: DataFrame, size: int, make: Callable[[], Callable], result: Callable) -> DataFrame:
    """``part, state``: one row per task; ``make()`` gives a function that takes each block of vectors, ``result()`` its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, take = make()
        seen = 0
        for batch in batches:
            if batch.num_rows:
                seen += batch.num_rows
                take(state, matrix(batch.column(0), size))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([result(state)], pa.binary())], ["part", "state"])

    return rows.select("x").mapInArrow(run, "part bigint, state binary")


def folded(rows: DataFrame, combine: Callable[[bytes, bytes], bytes]) -> bytes:
    """All states (at least one) as one, ``FAN`` of them to a task, in the order of their numbers."""

    def fold(key, table):
        states = table.sort_by("part")["state"].to_pylist()
        state = states[0]
        for other in states[1:]:
            state = combine(state, other)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([state], pa.binary())})

    rows = written(rows)
    while rows.count() > 1:
        rows = written(rows.withColumn("to", F.floor(F.col("part") / FAN)).groupBy("to").applyInArrow(fold, "part bigint, state binary"))
    return bytes(rows.first().state)


def added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, float) + np.frombuffer(b, float)).tobytes()


def column_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def take(state, x):
        state[0] += len(x)
        state[1] += (x >> LOW_BITS).sum(0)
        state[2] += (x & ((1 << LOW_BITS) - 1)).sum(0)

    def make():
        return [0, np.zeros(size, np.int64), np.zeros(size, np.int64)], take

    def result(state):
        return np.concatenate([[state[0]], state[1], state[2]]).astype(np.int64).tobytes()

    def combine(a, b):
        return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()

    flat = np.frombuffer(folded(per_task(rows, size, make, result), combine), np.int64).tolist()
    return flat[0], [(high << LOW_BITS) + low for high, low in zip(flat[1 : size + 1], flat[size + 1 :])]


class Whitening:
    """Mean, leading eigenpairs and trace of a covariance, and the exact sums of the rows it was taken of."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of each vector; None if it is no long."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if x.shape[1] * most * most <= MOST_LONG:
            off = self.n * off - self.rest
            return (off * off).sum(1).tolist()
        out = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest.tolist())) for row in off.tolist()]
        return [v if v <= MOST_LONG else None for v in out]

    def take(self, values: np.ndarray, vectors: np.ndarray, trace: float, k: int) -> None:
        """Leading ``k`` pairs of ascending ones. A value that is rounding error of the trace counts as zero."""
        k = min(k, len(values))
        self.values, self.vectors, self.trace = values[::-1][:k], vectors[:, ::-1][:, :k], trace
        self.real = self.values > len(values) * EPS * trace
        scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.values, 1.0)), 0.0)
        self.turn = self.vectors * scale

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.turn


def products(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the ``width`` columns ``of(x)`` over all vectors."""

    def take(state, x):
        for part in np.array_split(x, -(-len(x) // 4096)):
            y = of(part)
            state[0] += y.sum(0)
            state[1] += y.T @ y

    def make():
        return [np.zeros(width), np.zeros((width, width))], take

    flat = np.frombuffer(folded(per_task(rows, size, make, lambda state: np.concatenate([state[0], state[1].reshape(-1)]).tobytes()), added), float)
    return flat[:width], flat[width:].reshape(width, width)


def spectrum_of(rows: DataFrame, size: int) -> Spectrum:
    """The eigenpairs of all vectors' scatter matrix, by rank-one updates alone."""

    def make():
        def take(state, x):
            for row in x.astype(float):
                state.add(row)

        return Spectrum(size), take

    def combine(a, b):
        spectrum = Spectrum.from_bytes(a, size)
        spectrum.merge(Spectrum.from_bytes(b, size))
        return spectrum.to_bytes()

    return Spectrum.from_bytes(folded(per_task(rows, size, make, Spectrum.to_bytes), combine), size)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors ``x`` (of ``size`` longs) of ``rows``; None without any."""
    if rows.isEmpty():
        return None
    model = Whitening(*column_sums(rows, size))
    basis = np.linalg.qr(spectrum_of(rows, size).vectors)[0]
    total, cross = products(rows, size, lambda x: model.centred(x) @ basis, size)
    inner = cross / model.n - np.outer(total, total) / model.n**2
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    model.take(np.maximum(values, 0.0), basis @ turn, float(np.trace(inner)), components)
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component.

    An entry c becomes x = floor(1024 c) + 100000. Components are the unit eigenvectors of the covariance of all x-vectors, by
    falling eigenvalue, at most as many as there are dimensions. ``deviation`` is the exact sum of (n x - S)^2, null if that is
    no long. ``whitened`` is null for a component without variance (equal vectors, one vector, fewer vectors than dimensions);
    ``explained`` is 0 there, and null if nothing varies. ``identity_error`` is measured on the whitened values of all rows,
    over the components that have variance.

    Left out are vectors that are null or empty or hold a null or non-finite entry (or one of 2^42 and more, whose x is not
    exact), and those of another length than the commonest (at a tie the shortest). Rows that repeat an id are rows like any
    others, and so are those with a null id. Without usable vectors there are no rows.

    The data are read once for each pass. Tasks send one state each (a matrix of dimensions squared), 16 of them meet in a
    task until one is left, and that one goes to the driver; so nothing that grows with the rows meets in one place.
    """
    spark, rows = vectors.sparkSession, usable(vectors, vec_id, embedding)
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], shape)
    size = int(lengths.d)
    rows = rows.where(F.size("x") == size)
    model = fit(rows, size, components)
    width = len(model.values)
    total, cross = products(rows, size, model.whitened, width)
    off = np.abs(cross / model.n - np.outer(total, total) / model.n**2 - np.eye(width))[np.ix_(model.real, model.real)]
    error = float(off.max(initial=0.0))
    share = [float(v / model.trace) if model.trace > 0 else None for v in np.where(model.real, model.values, 0.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column(1), size)
            white = model.whitened(x)
            some = pa.array(np.repeat(np.arange(n), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(some),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * width, model.n, np.int64)),
                    pa.array(model.deviations(x), pa.int64()).take(some),
                    pa.array(white.reshape(-1), mask=np.tile(~model.real, n)),
                    pa.array(share * n, pa.float64()),
                    pa.array(np.full(n * width, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, shape)
