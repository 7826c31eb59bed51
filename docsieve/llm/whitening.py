"""Whitening of embeddings: spectra grown by rank-one updates, combined likewise, refined by a Rayleigh-Ritz step."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import arrow_map, keep

# So many partial results are combined in one task, or at the end on the driver.
FAN = 32
# Entries of this size or more have no place in a long after scaling.
LARGEST = float(1 << 50)
EPS = np.finfo(np.float64).eps


def _between(rest, left, right, at_left, at_right) -> np.ndarray:
    """Roots of rest + left / (at_left - x) + right / (at_right - x) between two poles, one of which is at 0."""
    # Distances y from the left pole and u from the right one solve quadratic equations with the same discriminant; each
    # is taken in the form without cancellation.
    gap = at_right - at_left
    b, d = rest * gap + left + right, rest * gap - left - right
    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.sqrt(np.maximum(b * b - 4 * rest * left * gap, 0))
        y = np.where(b > 0, 2 * left * gap / (b + root), (b - root) / (2 * rest))
        u = np.where(d < 0, 2 * right * gap / (root - d), (d + root) / (2 * rest))
    return np.where(at_left == 0, y, -u)


def _secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (pole - x)), one behind each pole, as (nearest pole, distance from it).

    Poles are ascending and different, no z is zero, and rho is positive. All roots are sought at once: each step fits
    the poles on both sides of a root by two rational functions, and falls back to halving where that leaves the bracket.
    """
    k, own = len(poles), np.arange(len(poles))
    weight = rho * z * z
    # The last root is at most the sum of the weights away; a pole that is none, well behind it, makes it like the others.
    after = np.append(poles[1:], poles[-1] + 2 * weight.sum())
    gap = after - poles
    # The sign in the middle says which pole is nearer; distances are taken from that one, so that they are exact.
    inverse = 1 / (poles[None, :] - poles[:, None] - gap[:, None] / 2)
    middle = 1 + inverse @ weight
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, own, own + 1)
    shifted = poles[None, :] - poles[origin][:, None]
    at_left = np.where(left, 0.0, -gap)
    at_right = at_left + gap
    # Brackets for the distance.
    low = np.where(left, np.where(middle >= 0, 0.0, gap / 2), -gap / 2)
    high = np.where(left, np.where(middle >= 0, gap / 2, gap), 0.0)
    # A first guess: what is not of the two poles next to a root stays as it is in the middle.
    other = np.append(weight[1:], 0.0)
    rest = middle + 2 * (weight - other) / gap
    x = _between(rest, weight, other, at_left, at_right)
    x = np.where((x > low) & (x < high), x, (low + high) / 2)
    lower = np.tril(np.ones((k, k)))
    for _ in range(80):
        inverse = 1 / (shifted - x[:, None])
        below = inverse * lower
        minus, plus = below @ weight, inverse @ weight
        plus -= minus
        value = 1 + minus + plus
        # Terms before the root are negative, those behind it positive.
        done = np.abs(value) <= 2 * EPS * k * (1 + plus - minus)
        if done.all():
            break
        slope_below = (below * inverse) @ weight
        slope_above = (inverse * inverse) @ weight - slope_below
        low = np.where(value < 0, x, low)
        high = np.where(value >= 0, x, high)
        d1, d2 = at_left - x, at_right - x
        rest = value - d1 * slope_below - d2 * slope_above
        new = _between(rest, d1 * d1 * slope_below, d2 * d2 * slope_above, at_left, at_right)
        done |= np.abs(new - x) <= 4 * EPS * np.abs(x)
        x = np.where(done, x, np.where((new > low) & (new < high), new, (low + high) / 2))
        if done.all():
            break
    return origin, x


def rank_one_update(values: np.ndarray, vectors: np.ndarray, u: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of ``vectors @ diag(values) @ vectors.T + rho * u @ u.T``, rho >= 0.

    Entries of the update that vanish, and all but one of those at equal eigenvalues (after a rotation), are deflated:
    their eigenpairs stay. The others are the roots of the secular equation; their vectors are made from weights that
    belong to the computed roots exactly (Gu and Eisenstat), so that they are orthogonal.
    """
    norm = float(np.sqrt(u @ u))
    if rho * norm * norm <= 0:
        return values, vectors
    z = vectors.T @ (u / norm)
    rho *= norm * norm
    tiny = 8 * EPS * max(float(np.abs(values).max()), rho)
    live = np.flatnonzero(rho * np.abs(z) > tiny)
    if len(live) > 1:
        close = np.flatnonzero(np.diff(values[live]) <= tiny)
        if len(close):
            vectors = vectors.copy()
            # Rotate equal neighbours so that the first of them has no part in the update.
            for i, j in zip(live[close].tolist(), live[close + 1].tolist()):
                both = np.hypot(z[i], z[j])
                c, s = z[j] / both, z[i] / both
                z[i], z[j] = 0.0, both
                first = c * vectors[:, i] - s * vectors[:, j]
                vectors[:, j] = s * vectors[:, i] + c * vectors[:, j]
                vectors[:, i] = first
            live = live[rho * np.abs(z[live]) > tiny]
    if not len(live):
        return values, vectors
    poles, part = values[live], z[live]
    k = len(live)
    if k == 1:
        new_values = values.copy()
        new_values[live] += rho * part * part
        new_vectors = vectors
    else:
        origin, x = _secular_roots(poles, part, rho)
        # distance[j, i]: from root j to pole i.
        distance = (poles[None, :] - poles[origin][:, None]) - x[:, None]
        between = poles[None, :] - poles[:, None]
        np.fill_diagonal(between, -1.0)
        ratio = distance / between
        weights = np.sqrt(np.abs(ratio.prod(axis=0) / rho)) * np.sign(part)
        inner = weights[:, None] / distance.T
        inner /= np.sqrt((inner * inner).sum(axis=0))
        new_values = values.copy()
        new_values[live] = poles[origin] + x
        new_vectors = vectors.copy()
        new_vectors[:, live] = vectors[:, live] @ inner
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean, and eigenpairs of the scatter (sum of centred squares) of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """Take up rows of integers. Equal rows are one update, of their number's weight."""
        self.sums = [a + int(b) for a, b in zip(self.sums, x.sum(axis=0))]
        rows, counts = np.unique(x, axis=0, return_counts=True)
        for row, m in zip(rows.astype(np.float64), counts.tolist()):
            away = row - self.mean
            total = self.n + m
            self.values, self.vectors = rank_one_update(self.values, self.vectors, away, self.n * m / total)
            self.mean = self.mean + away * (m / total)
            self.n = total

    def merge(self, other: Spectrum) -> None:
        """Take up another spectrum: an update for each of its eigenpairs, and one for the distance of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one_update(self.values, self.vectors, vector, max(float(value), 0.0))
        away = other.mean - self.mean
        total = self.n + other.n
        self.values, self.vectors = rank_one_update(self.values, self.vectors, away, self.n * other.n / total)
        self.mean = self.mean + away * (other.n / total)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = total

    def row(self) -> dict:
        # Sums go as text, as no number type holds all of them.
        return {
            "n": self.n,
            "sums": [str(s) for s in self.sums],
            "values": [*self.mean.tolist(), *self.values.tolist(), *self.vectors.ravel().tolist()],
        }

    @classmethod
    def of(cls, n: int, sums: Iterable[str], values: Iterable[float]) -> Spectrum:
        exact = [int(s) for s in sums]
        d, all_ = len(exact), np.asarray(values, np.float64)
        return cls(int(n), exact, all_[:d], all_[d : 2 * d], all_[2 * d :].reshape(d, d).copy())


@dataclass
class Scatter:
    """Count, mean and sum of centred squares of some vectors."""

    n: int
    mean: np.ndarray
    squares: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Scatter:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        mean = x.mean(axis=0)
        centred = x - mean
        self.merge(Scatter(len(x), mean, centred.T @ centred))

    def merge(self, other: Scatter) -> None:
        if not other.n:
            return
        away, total = other.mean - self.mean, self.n + other.n
        self.squares = self.squares + other.squares + np.outer(away, away) * (self.n * other.n / total)
        self.mean = self.mean + away * (other.n / total)
        self.n = total

    def row(self) -> dict:
        return {"n": self.n, "sums": [str(len(self.mean))], "values": [*self.mean.tolist(), *self.squares.ravel().tolist()]}

    @classmethod
    def of(cls, n: int, sums: Iterable[str], values: Iterable[float]) -> Scatter:
        d, all_ = int(list(sums)[0]), np.asarray(values, np.float64)
        return cls(int(n), all_[:d], all_[d:].reshape(d, d))


PARTIAL = "part int, n bigint, sums array<string>, values array<double>"


def _vectors(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """Rows of integers floor(64 * c) from a column of lists of ``d`` numbers each."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return np.floor(64 * flat.reshape(-1, d)).astype(np.int64)


def _summed(rows: DataFrame, d: int, kind: type, size: int, prepare: Callable[[np.ndarray], np.ndarray], name: str):
    """A ``kind`` over ``size`` columns that ``prepare`` makes of all rows of ``d`` integers.

    One is made per task; they are combined FAN at a time in tasks, the last FAN on the driver. Each is of a size bounded
    by the dimension, and they are combined in the order of the tasks, so that runs agree.
    """

    def one_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = kind.empty(size)
        for batch in batches:
            # Some thousand rows at a time, so that what is made of them stays small.
            for start in range(0, batch.num_rows, 4096):
                total.add(prepare(_vectors(batch.slice(start, 4096), 0, d)))
        if total.n:
            yield _partial([{"part": TaskContext.get().partitionId()} | total.row()])

    def combine(_, group):
        import pandas as pd

        group = group.sort_values("part")
        total = None
        for n, sums, values in zip(group["n"], group["sums"], group["values"]):
            one = kind.of(n, sums, values)
            if total is None:
                total = one
            else:
                total.merge(one)
        return pd.DataFrame([{"part": int(group["part"].iloc[0]) // FAN} | total.row()])

    partial = keep(rows.select("vector").mapInArrow(one_per_task, PARTIAL), name)
    while partial.count() > FAN:
        partial = keep(partial.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(combine, PARTIAL), name)
    total = kind.empty(size)
    for r in sorted(partial.collect(), key=lambda r: r["part"]):
        total.merge(kind.of(r["n"], r["sums"], r["values"]))
    return total


def _partial(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema(
        [("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64()))]
    )
    return pa.RecordBatch.from_pylist(rows, schema)


@dataclass(frozen=True)
class Whitening:
    """Sums and number of the fitted integer vectors floor(64 c), and their principal components (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def __post_init__(self) -> None:
        # A whole number next to the mean is taken away first, so that centring loses nothing.
        near = np.array([round(s / self.n) if self.n else 0 for s in self.sums], np.int64)
        object.__setattr__(self, "near", near)
        object.__setattr__(self, "rest", [s - self.n * int(m) for s, m in zip(self.sums, near)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The rows in whitened coordinates; components without variance give NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ (self.components / np.sqrt(np.where(self.values > 0, self.values, np.nan)))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2 per row; None where that is no long."""
        off = x - self.near
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            exact = self.n * off - np.array(self.rest, np.int64)
            return (exact * exact).sum(axis=1).tolist()
        found = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, self.rest)) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def usable_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has numbers only, and none beyond LARGEST."""
    rows = df.select(df[vec_id].alias("vec_id"), df[vector].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & fine)


def _size_of(rows: DataFrame) -> int:
    """The most frequent length of the vectors, the greater of equally frequent ones; 0 if there are none."""
    counts = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    found = counts.where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def fit_whitening(rows: DataFrame, d: int, components: int) -> Whitening:
    """Principal components of ``vector`` (lists of ``d`` usable numbers, read as floor(64 c)).

    Each task grows a spectrum by centred rank-one updates, spectra are combined by further ones, and the eigenvectors
    found span the space in which the covariance of all rows is formed once more, by sums of squares of the centred and
    rotated rows, and solved (Rayleigh-Ritz), which rids it of what rounding the many updates has left.
    """
    spectrum = _summed(rows, d, Spectrum, d, lambda x: x, "spectra")
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    plain = Whitening(spectrum.n, spectrum.sums, np.ones(d), basis, 1.0)
    scatter = _summed(rows, d, Scatter, d, lambda x: plain.centred(x) @ basis, "ritz")
    covariance = scatter.squares / max(scatter.n, 1)
    values, inner = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], basis @ inner[:, ::-1]
    # Signs are fixed by the entry that is largest, so that reruns agree.
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    # What rounding makes of a variance of zero counts as zero.
    values = np.where(values > d * EPS * max(float(values[0]), 0.0), values, 0.0)
    kept = min(components, d)
    return Whitening(spectrum.n, spectrum.sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)))


def whiten_embeddings(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """Whiten vectors: project x = floor(64 c) on the principal components, each to variance one.

    Rows whose vector is null, or holds null, non-finite or huge entries (2^50 or more, whose x is no whole number that
    a double holds) are dropped, and so are those whose vector is empty or has another length than the most frequent one
    (the greater of equally frequent ones). All others are fitted. Result, one row per input row left: ``vec_id``, ``n``
    (fitted rows), ``deviation`` (sum over the dimensions of (n x - S)^2, S their sums; exact, null if it is no long),
    ``whitened`` (one number per component, by falling variance), ``explained`` (shares of the variance) and
    ``identity_error``: the largest entry by which the covariance of the whitened rows, summed up over all of them,
    differs from the identity. Components without variance give null, and do not count for the error.

    A number added to all x cancels out of n x - S and of x less its mean, and so of all results.

    Repeated rows are fitted as often as they come, null ids are ids, an empty table (or one without usable vectors)
    gives an empty result, other columns are not read.
    """
    kind = df.schema[vec_id].dataType.simpleString()
    schema = (
        f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    )
    rows = usable_vectors(df, vec_id, vector)
    d = _size_of(rows)
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == d)
    model = fit_whitening(rows, d, components)
    live = np.flatnonzero(model.values > 0)
    error = None
    if len(live):
        done = _summed(rows, d, Scatter, len(live), lambda x: model.whiten(x)[:, live], "identity")
        error = float(np.abs(done.squares / done.n - np.eye(len(live))).max())
    explained = [float(v / model.trace) if v > 0 else None for v in model.values]

    def each():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = _vectors(part, 1, d)
                whitened, m = model.whiten(x), part.num_rows
                flat = whitened.ravel()
                ends = np.arange(m + 1, dtype=np.int32) * whitened.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(m, model.n)),
                        pa.array(model.deviations(x), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(flat, mask=np.isnan(flat))),
                        pa.array([explained] * m, pa.list_(pa.float64())),
                        pa.array([error] * m, pa.float64()),
                    ],
                    ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return work

    return arrow_map(rows, schema, each)


def component_rows(whitened: DataFrame) -> DataFrame:
    """The result of `whiten_embeddings` with a row per component, numbered from 1 by falling variance."""
    both = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", both.alias("at", "both"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("both")["whitened"].alias("whitened"),
        F.col("both")["explained"].alias("explained"),
        "identity_error",
    )
