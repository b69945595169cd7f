"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows are whole numbers x, their sums are exact, and every product is taken on centred rows. A step sends a right vector v
through all rows (Xv), back again (X'u), and extends the bidiagonal matrix. Right vectors are few and short and live on the
driver. Left vectors have an entry per row: they are never stored, but each is ``u = X w`` for a short w, so the tasks work its
entries out again wherever they are needed. A lost executor costs its tasks of one pass.

Reorthogonalisation is full, on both sides. Before a pass, v loses what it has in common with all earlier left vectors (their
X'u are known); the pass itself measures the products with all of them, and what rounding left is taken off, with another pass if
that is more than rounding. The singular values and vectors of the small bidiagonal matrix give components and deviations.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import store

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Residual of a component, relative to the largest singular value, below which it counts as found.
EXACT = 1e-15
#: Tasks whose partial sums the driver adds up by itself; the sums of more tasks meet in fewer ones first.
DIRECT = 64
_LARGEST = 2.0**62


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x): usable vectors as whole numbers (binary, int64), stored, and how many entries each has."""
    import pyarrow as pa

    def convert(batches):
        for b in batches:
            lists = b.column(1)
            known = np.flatnonzero(~lists.is_null().to_numpy(zero_copy_only=False))
            ids, lists = b.column(0).take(pa.array(known)), lists.take(pa.array(known))
            size = lists.value_lengths().to_numpy().astype(np.int64)
            entries = lists.flatten()
            value = entries.cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(SCALE * value)
                good = np.abs(x) < _LARGEST  # not null (which is nan here), not infinite, not beyond whole numbers
            bad = np.concatenate([[0], np.cumsum(~good)])
            end = np.cumsum(size)
            keep = np.flatnonzero((bad[end] == bad[end - size]) & (size > 0))
            if keep.size:
                x = (np.where(good, x, 0).astype(np.int64) + SHIFT).astype("<i8")
                rows = [x[e - n:e].tobytes() for e, n in zip(end[keep].tolist(), size[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(size[keep], pa.int32()), pa.array(rows, pa.binary())], ["vec_id", "entries", "x"])

    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    kind = T.StructType([T.StructField("vec_id", rows.schema[0].dataType), T.StructField("entries", T.IntegerType()), T.StructField("x", T.BinaryType())])
    found = store(rows.mapInArrow(convert, kind))
    lengths = found.groupBy("entries").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("entries")).limit(1).collect()
    entries = lengths[0].entries if lengths else 0
    return found.filter(F.col("entries") == entries).select("vec_id", "x"), entries


def _matrix(batch, column: int, entries: int) -> np.ndarray:
    """A binary column of equally long values as a matrix, without copying."""
    values = batch.column(column)
    _, offsets, data = values.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[values.offset]
    return np.frombuffer(data, dtype="<i8", offset=first, count=len(values) * entries).reshape(len(values), entries)


def _summed(rows: DataFrame, partial, tasks: int) -> np.ndarray:
    """Sum over all tasks of ``partial`` (a function of a task's batches, giving an array of doubles)."""
    import pyarrow as pa

    def one(total):
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(total, dtype="<f8").tobytes()], pa.binary())], ["s"])

    def work(batches):
        total = partial(batches)
        if total is not None:
            yield one(total)

    def add(batches):
        parts = [np.frombuffer(v, dtype="<f8") for b in batches for v in b.column(0).to_pylist()]
        if parts:
            yield one(np.sum(parts, axis=0))

    sums = rows.select("x").mapInArrow(work, "s binary")
    if tasks > DIRECT:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add, "s binary")
    return np.sum([np.frombuffer(bytes(r.s), dtype="<f8") for r in sums.collect()], axis=0)


def exact_sums(rows: DataFrame, entries: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each entry, both exact."""
    import pyarrow as pa

    kind = pa.decimal128(38, 0)

    def work(batches):
        n, total = 0, [0] * entries
        for b in batches:
            x = _matrix(b, 0, entries)
            high, low = (x >> 20).sum(axis=0).tolist(), (x & ((1 << 20) - 1)).sum(axis=0).tolist()  # a batch's sums fit
            n, total = n + len(x), [t + (h << 20) + r for t, h, r in zip(total, high, low, strict=True)]
        if n:
            at = pa.array(range(-1, entries), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([Decimal(v) for v in [n, *total]], kind)], ["at", "s"])

    sums = {r["at"]: int(r.s) for r in rows.select("x").mapInArrow(work, "at int, s decimal(38, 0)").groupBy("at").agg(F.sum("s").cast("decimal(38, 0)").alias("s")).collect()}
    return sums.get(-1, 0), [sums.get(k, 0) for k in range(entries)]


class Bidiagonal:
    """Right vectors, the short forms of left vectors, and the bidiagonal matrix between them."""

    def __init__(self, entries: int) -> None:
        self.right = np.zeros((0, entries))  # rows are right vectors
        self.short, self.back = np.zeros((0, entries)), np.zeros((0, entries))  # w and X'u of left vectors u = X w
        self.matrix = np.zeros((0, 0))  # left by right vectors

    def fresh(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        """``v`` without what it has in common with the right vectors, of length one, and its length before that."""
        for _ in range(2):
            v = v - (self.right @ v) @ self.right
        size = float(np.linalg.norm(v))
        return (v / size if size else v), size


def _product(rows: DataFrame, centre, t: np.ndarray, short: np.ndarray, tasks: int) -> tuple[np.ndarray, float, np.ndarray]:
    """X'u, u'u and the products of u with all earlier left vectors, for u = X t: one pass."""
    entries = len(t)

    def partial(batches):
        total = np.zeros(entries + 1 + len(short))
        for b in batches:
            x = centre(_matrix(b, 0, entries))
            u = x @ t
            total[:entries] += x.T @ u
            total[entries] += u @ u
            if len(short):
                total[entries + 1:] += (x @ short.T).T @ u
        return total

    sums = _summed(rows, partial, tasks)
    return sums[:entries], float(sums[entries]), sums[entries + 1:]


def bidiagonalise(rows: DataFrame, centre, entries: int, components: int, tasks: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows and their right vectors (one per row of the result).

    Ends once ``components`` of them are found to double precision, or all there are. Values that are zero are left out. An
    invariant space (equal singular values, few different rows) is followed by a new start outside of it.
    """
    state, rnd = Bidiagonal(entries), np.random.default_rng(seed)
    v, _ = state.fresh(rnd.standard_normal(entries))
    started = True  # v is a new start
    while len(state.right) < entries:
        common = state.back @ v
        t = v - common @ state.short
        back, square, left = _product(rows, centre, t, state.short, tasks)
        scale = float(np.sqrt(np.square(state.back).sum(axis=1)).max()) if len(state.back) else 0.0
        for _ in range(3):
            if not len(left):
                break
            t, back, square = t - left @ state.short, back - left @ state.back, square - float(left @ left)
            common = common + left
            if np.abs(left).max() <= 1e-8 * np.sqrt(max(square, 0)) or square <= (1e-13 * scale) ** 2:
                break
            back, square, left = _product(rows, centre, t, state.short, tasks)  # too much was left: measure again
        alpha = float(np.sqrt(max(square, 0)))
        empty = alpha <= 1e-13 * scale or alpha == 0
        n = len(state.short)
        matrix = np.zeros((n + (not empty), len(state.right) + 1))
        matrix[:n, :-1] = state.matrix
        if n and not started:
            matrix[n - 1, -1] = common[-1]
        state.right = np.vstack([state.right, v])
        if not empty:
            matrix[n, -1] = alpha
            state.short, state.back = np.vstack([state.short, t / alpha]), np.vstack([state.back, back / alpha])
        state.matrix = matrix
        if empty and started:
            break  # nothing is left outside of the right vectors
        v, beta = (state.fresh(state.back[-1] - alpha * v) if not empty else (v, 0.0))
        largest = np.linalg.norm(state.matrix, 2) if state.matrix.size else 0.0
        started = beta <= 1e-13 * largest
        if started:
            v, _ = state.fresh(rnd.standard_normal(entries))
        elif len(state.short) >= components:
            p, _, _ = np.linalg.svd(state.matrix)
            if beta * np.abs(p[-1, :components]).max() <= EXACT * largest:
                break
    if not len(state.short):
        return np.zeros(0), np.zeros((0, entries))
    _, values, q = np.linalg.svd(state.matrix, full_matrices=False)
    some = values > 1e-12 * values[0]
    return values[some][:components], (q[some] @ state.right)[:components]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the whitened vectors, a row per vector and component.

    Entries c become whole numbers ``floor(64 c) + 1000000``; covariances have the divisor n. Components are numbered from 1 by
    falling variance. ``deviation`` is the exact sum over entries of ``(n x - sum)^2``, null where it exceeds a long. ``explained``
    is the component's share of the variance, ``identity_error`` the largest entry of the whitened vectors' covariance less the identity.

    Vectors that are null, empty, or hold null, infinite or nan entries (or ones beyond 2^62 / 64) are left out of everything, as
    are those that have another number of entries than most (of equally frequent numbers, the larger stays). There are no more
    components than directions with a variance, so vectors that are all alike, or a single one, give no rows, as no rows do.
    Repeated ids are rows of their own; null ids stay null; other columns are ignored.
    """
    import pyarrow as pa

    rows, entries = whole_vectors(vectors, id_col, vector_col)
    kind = T.StructType([
        T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    n, sums = exact_sums(rows, entries) if entries else (0, [])
    if not n:
        return vectors.sparkSession.createDataFrame([], kind)
    tasks = rows.rdd.getNumPartitions()
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    part = rest / n

    def centre(x):
        return (x - whole).astype(np.float64) - part

    values, axes = bidiagonalise(rows, centre, entries, components, tasks)
    k = len(values)
    project = (axes / (values / np.sqrt(n))[:, None]).T

    def first(batches):
        out = np.zeros(k + 1)
        for b in batches:
            x = centre(_matrix(b, 0, entries))
            out[:k] += (x @ project).sum(axis=0)
            out[k] += np.square(x).sum()
        return out

    means = _summed(rows, first, tasks)
    trace, means = means[k] / n, means[:k] / n

    def second(batches):
        out = np.zeros((k, k))
        for b in batches:
            y = centre(_matrix(b, 0, entries)) @ project - means
            out += y.T @ y
        return out.ravel()

    error = float(np.abs(_summed(rows, second, tasks).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    explained = np.square(values) / n / trace if k else values

    def deviations(x):
        away = x - whole
        if (float(np.abs(away).max(initial=0)) + 1) ** 2 * float(n) ** 2 * entries < _LARGEST:
            return pa.array(np.square(n * away - rest).sum(axis=1), pa.int64())
        exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in away.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def emit(batches):
        for b in batches:
            step = max(1, (1 << 18) // max(k, 1))
            for at in range(0, b.num_rows if k else 0, step):
                some = b.slice(at, step)
                x = _matrix(some, 1, entries)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), n), pa.int64()),
                    deviations(x).take(each), pa.array((centre(x) @ project).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error))], kind.names)

    return rows.mapInArrow(emit, kind)
