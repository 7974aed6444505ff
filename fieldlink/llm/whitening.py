"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

1. Vectors become whole numbers x = floor(64 * c) + 1000000; one pass sums each
   dimension exactly. n * x - S is exact too, so centring loses nothing.
2. A block of vectors Q goes through a Chebyshev polynomial of the covariance: each
   degree is one pass over the table, in which every task adds up its share of
   centred X^T (X Q). The polynomial is small over the unwanted spectrum [low, cut] and
   grows fast above it. low comes from a Lanczos column that rides along in the
   first round, cut from the block's smallest Ritz value.
3. QR and Rayleigh-Ritz (one more pass) give
   Ritz pairs and their residuals. Each round some fresh random columns join the block,
   so that an eigenvector missed so far would show. Certified: all wanted residuals are
   under `tolerance` of the largest eigenvalue, and so is what the last round moved of
   the wanted eigenvalues. While that fails the block grows, at most to all dimensions,
   where Rayleigh-Ritz is exact.

Rows leave whose vector is null, is empty or holds a null or non-finite entry; so do rows of
another length than most rows have (of equally frequent lengths the largest counts). An entry
beyond 2**56 counts as 2**56. Rows that repeat are rows of their own; ties of
eigenvalues give any orthonormal basis of their space, the same for all rows. Components
without variance (e within rounding of 0) don't exist: equal vectors, a single one
or an empty table give none. Further columns pass through; one that is named like a
result comes back as doc_<name>. The driver holds blocks of dimensions x columns only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from . import common

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**56
#: Degree of the polynomial, fresh columns a round, rounds before the block grows.
DEGREE, FRESH, ROUNDS = 10, 4, 6
TOLERANCE = 1e-13
#: Entries that a task multiplies at once; partial sums that one task or the driver adds up at once.
ENTRIES, FAN = 1 << 18, 64
SAFE = 2**62


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """rows that have a usable vector, of any length, with it as whole numbers in `x`."""
    rows, vector = common.beside(rows, vector, ("x",))
    keep = [f for f in rows.schema if f.name != vector]

    def run(batches):
        for batch in batches:
            lists = batch.column(vector)
            flat = pc.cast(lists.flatten(), pa.float64())
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            good = (n > 0) & (np.bincount(row[~np.isfinite(values)], minlength=len(n)) == 0)
            kept = values[good[row]]
            x = np.floor(np.clip(SCALE * np.clip(kept, -LARGEST, LARGEST), -LARGEST, LARGEST)).astype(np.int64) + SHIFT
            own = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in keep), common.list_array(x, n[good], pa.int64())], names=[*(f.name for f in keep), "x"])

    return rows.mapInArrow(run, StructType([*keep]).add("x", ArrayType(LongType())))


def blocks(batches, d: int):
    """Parts of batches of about ENTRIES entries, each with its x as a matrix."""
    rows = max(1, ENTRIES // max(1, d))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit where that holds it, else Python's whole numbers."""
    near = [round(s / n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, near)]
    moved = x - np.array(near, np.int64)
    if max(int(moved.max()), -int(moved.min())) * n + n < SAFE:
        return moved * n - np.array(rest, np.int64)
    return moved.astype(object) * n - np.array(rest, object)


def squares(y: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exactly."""
    most = max(int(y.max()), -int(y.min()))
    if most * most * y.shape[1] >= SAFE:
        y = y.astype(object)
    return (y * y).sum(1)


def totals(xs: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and each dimension's sum, exactly."""

    def run(batches):
        n, s = 0, [0] * d
        for _, x in blocks(batches, d):
            wide = x.astype(object) if np.abs(x).max() >= SAFE // ENTRIES else x
            n, s = n + len(x), [a + int(b) for a, b in zip(s, wide.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *s)])], names=["j", "v"])

    found = {r.j: int(r.v) for r in xs.select("x").mapInArrow(run, "j int, v string").groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return found.get(-1, 0), [found.get(j, 0) for j in range(d)]


def added(parts: DataFrame, n: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of n partial sums (part, v: doubles as bytes), FAN at a time and always in the same order."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("v").to_pylist()))
        total = np.zeros(shape)
        for _, v in rows:
            total += np.frombuffer(v).reshape(shape)
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    while n > FAN:
        parts, n = parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, "part int, v binary"), -(-n // FAN)
    total = np.zeros(shape)
    for _, v in sorted((r.part, bytes(r.v)) for r in parts.collect()):
        total += np.frombuffer(v).reshape(shape)
    return total


class Table:
    """The fit list: whole vectors of one length, with their number and sums."""

    def __init__(self, xs: DataFrame, d: int):
        self.xs, self.d, self.parts = xs.select("x"), d, xs.rdd.getNumPartitions()
        self.n, self.sums = totals(xs, d)

    def summed(self, of, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all rows of of(centred rows), which tasks add up matrix by matrix."""
        d, n, sums = self.d, self.n, self.sums

        def run(batches):
            total = np.zeros(shape)
            for _, x in blocks(batches, d):
                total += of(scaled(x, n, sums).astype(float) / n)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        return added(self.xs.mapInArrow(run, "part int, v binary"), self.parts, shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q."""
        return self.summed(lambda c: c.T @ (c @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([(c * c).sum()]), (1,))[0]) / self.n


class Lanczos:
    """Bounds of the spectrum from one more column of the passes that are made anyway."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    def column(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, product: np.ndarray) -> None:
        self.alpha.append(float(product @ self.basis[-1]))
        rest = product
        for _ in range(2):
            rest = rest - sum((rest @ b) * b for b in self.basis)
        self.beta.append(float(np.linalg.norm(rest)))
        self.basis.append(rest / self.beta[-1] if self.beta[-1] > 1e-12 * abs(self.alpha[0]) else np.zeros_like(rest))

    def low(self) -> float:
        """A value that the spectrum hardly goes below; never under 0."""
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[-1])


def filtered(times, q: np.ndarray, degree: int, low: float, cut: float, side: Lanczos | None = None) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small over [low, cut], times q."""
    half, middle = max((cut - low) / 2, 1e-12 * max(cut, 1e-300)), (cut + low) / 2

    def step(y: np.ndarray) -> np.ndarray:
        if side is None:
            return times(y)
        both = times(np.column_stack([y, side.column()]))
        side.take(both[:, -1])
        return both[:, :-1]

    before, now = q, (step(q) - middle * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (step(now) - middle * now) / half - before
        size = np.abs(now).max()
        if size > 1e100:  # both by the same number: the recurrence is linear
            before, now = before / size, now / size
    return now


def ritz(times, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Ritz values, falling; vectors; residuals) of the space that y spans."""
    q, _ = np.linalg.qr(y / np.maximum(np.linalg.norm(y, axis=0), 1e-300))
    q, _ = np.linalg.qr(q)
    product = times(q)
    inner = q.T @ product
    e, w = np.linalg.eigh((inner + inner.T) / 2)
    e, w = e[::-1], w[:, ::-1]
    v = q @ w
    return e, v, np.linalg.norm(product @ w - v * e, axis=0)


def leading(times, d: int, k: int, tolerance: float = TOLERANCE, degree: int = DEGREE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues, vectors as columns, how it went) of the k largest of a covariance of d dimensions, given by its product with a block."""
    made = np.random.default_rng(seed)
    k = min(k, d)
    width = min(d, k + max(8, k // 2))
    side = Lanczos(made.standard_normal(d))
    low, last, rounds, passes = 0.0, None, 0, 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(q)

    # the block as it is gives a first cut; a block of all dimensions needs no more
    e, v, residual = ritz(counted, made.standard_normal((d, width)))
    while width < d:
        rounds += 1
        cut = float(e[width - 1])
        fresh = made.standard_normal((d, min(FRESH, d - width)))
        block = np.column_stack([v[:, :width], fresh - v @ (v.T @ fresh)])
        grown = filtered(counted, block, degree, min(low, 0.999 * cut), cut, side)
        if side is not None:
            low, side = side.low(), None
        e, v, residual = ritz(counted, grown)
        if e[-1] < low:  # the bound was too high
            low = max(0.0, 0.9 * float(e[-1]))
        scale = max(float(e[0]), 1e-300)
        if last is not None and max(float(residual[:k].max()), float(np.abs(last - e[:k]).max())) <= tolerance * scale:
            break
        last = e[:k].copy()
        if rounds % ROUNDS == 0:
            width = min(d, 2 * width)
            e, v, residual = ritz(counted, np.column_stack([v, made.standard_normal((d, width))])[:, :width])
    return e[:k], v[:, :k], {"rounds": rounds, "passes": passes, "width": width, "residual": float(residual[:k].max()) if k else 0.0}


def fit(xs: DataFrame, k: int = 32, **how) -> dict:
    """n, sums, trace, eigenvalues and vectors (columns) of the covariance of whole vectors `x`, which all have one length."""
    first = xs.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return {"n": 0, "d": 0, "sums": [], "trace": 0.0, "e": np.zeros(0), "v": np.zeros((0, 0)), "report": {}}
    table = Table(xs, first[0].d)
    trace = table.trace()
    e, v, report = leading(table.times, table.d, k, **how) if trace > 0 else (np.zeros(0), np.zeros((table.d, 0)), {})
    real = e > 1e-13 * table.d * (e[0] if len(e) else 0)
    e, v = e[real], v[:, real]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) if len(e) else v
    model = {"n": table.n, "d": table.d, "sums": table.sums, "trace": trace, "e": e, "v": v, "report": report}
    return model | {"identity_error": _identity_error(table, model)}


def _identity_error(table: Table, model: dict) -> float:
    """The largest entry of the whitened rows' covariance less the identity: one pass for their mean, one for their products about it."""
    w, k = model["v"] / np.sqrt(model["e"]), len(model["e"])
    if not k:
        return 0.0
    mean = table.summed(lambda c: (c @ w).sum(0), (k,)) / table.n

    def products(c: np.ndarray) -> np.ndarray:
        y = c @ w - mean
        return y.T @ y

    return float(np.abs(table.summed(products, (k, k)) / table.n - np.eye(k)).max())


def whitened(xs: DataFrame, model: dict) -> DataFrame:
    """xs with deviation (null where a long can't hold it) and whitened (an entry for each component)."""
    xs, x = common.beside(xs, "x", ("deviation", "whitened"))
    n, d, sums, k = model["n"], model["d"], model["sums"], len(model["e"])
    w = model["v"] / np.sqrt(model["e"]) if k else None
    keep = [f for f in xs.schema if f.name != x]

    def run(batches):
        for part, rows in blocks(batches, d):
            y = scaled(rows, n, sums)
            far = [int(s) if int(s) < 2**63 else None for s in squares(y)]
            out = (y.astype(float) / n) @ w if k else np.zeros((len(rows), 0))
            lists = common.list_array(out.ravel(), np.full(len(rows), k, np.int64), pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(far, pa.int64()), lists], names=[*(f.name for f in keep), "deviation", "whitened"])

    return xs.mapInArrow(run, StructType([*keep]).add("deviation", LongType()).add("whitened", ArrayType(DoubleType())))


def of_one_length(xs: DataFrame) -> DataFrame:
    """The rows whose x has the length that most have, the largest of equally frequent ones."""
    lengths = xs.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(2).collect()
    return xs.where(F.size("x") == lengths[0].d) if len(lengths) > 1 else xs


def components(rows: DataFrame, vector: str, k: int = 32, **how) -> DataFrame:
    """A row for each usable row of `rows` and component: its other columns, component, n, deviation, whitened, explained, identity_error."""
    rows, vector = common.beside(rows, vector, ("x", "component", "n", "deviation", "whitened", "explained", "identity_error"))
    xs = of_one_length(common.written(whole(rows, vector), "whole-vectors"))
    model = fit(xs, k, **how)
    explained = F.array(*(F.lit(float(e / model["trace"])) for e in model["e"])) if len(model["e"]) else F.array().cast("array<double>")
    out = whitened(xs, model)
    others = [c for c in out.columns if c not in ("deviation", "whitened")]
    long = out.select(*(F.col(f"`{c}`") for c in others), "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return long.select(
        *(F.col(f"`{c}`") for c in others), (F.col("component") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("component")).alias("explained"), F.lit(float(model.get("identity_error", 0.0))).alias("identity_error"),
    )
