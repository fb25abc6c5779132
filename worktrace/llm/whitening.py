"""Whitening of embeddings by matrix-free block subspace iteration: no covariance matrix is ever formed.

Entries c become whole numbers floor(64 * c) + 1,000,000 (``SCALE``, ``SHIFT``). With n vectors and sums S of their dimensions, rows
are centred as (n * x - S) / n, whose numerator is exact. Each pass over the table multiplies the centred rows with a block Q and
sums X'(XQ); the Rayleigh-Ritz step turns the block to its best vectors; orthogonal columns (QR) of the product are the next block.
Passes end when the residual of each of the ``k`` components is below ``TOLERANCE`` of the largest eigenvalue; if ``most_passes`` do not
bring that, an error says so, and nothing uncertified is returned. The block has 2 * k columns, or as many as there are dimensions.

What travels to the driver is one sum of dimensions x columns of the block, whatever the number of rows.

Left out are null vectors and those with entries that are null, not finite or beyond ``LARGEST``, and vectors of another length than
most have (of two equally common lengths, the longer counts). Components whose eigenvalue is zero but for rounding (fewer
vectors than components, constant dimensions) are left out as well, as nothing can be divided by them: a table of one vector, or of
equal ones, gives no rows, and so does an empty table. Rows of one id, equal vectors and rows without id are rows like others.
Further columns do not matter. ``deviation`` is null where a long cannot hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 31)
COMPONENTS = 32
TOLERANCE = 1e-12
#: Below this share of the largest eigenvalue, one is zero but for rounding.
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    """Components (dimensions x k), their eigenvalues, and what was certified about them."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def usable(vectors: pa.ListArray, size: int | None = None) -> np.ndarray:
    """Which vectors of an Arrow list array are whole; with ``size``, also of that length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    ok = ~vectors.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(vectors.values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < LARGEST))])
    at = vectors.offsets.to_numpy()
    ok &= (bad[at[1:]] - bad[at[:-1]] == 0) & (lengths > 0)
    return ok if size is None else ok & (lengths == size)


def whole_numbers(vectors: pa.ListArray, ok: np.ndarray, size: int) -> np.ndarray:
    values = vectors.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values.reshape(-1, size)).astype(np.int64) + SHIFT


def _lists(batch, i: int) -> pa.ListArray:
    column = batch.column(i)
    return column.cast(pa.list_(column.type.value_type)) if not pa.types.is_list(column.type) else column


def sums_of(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of whole vectors of the most common length, and the exact sums of their dimensions."""

    def run(batches):
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            listed = _lists(batch, 0)
            ok = usable(listed)
            lengths = np.diff(listed.offsets.to_numpy())
            for size in np.unique(lengths[ok]).tolist():
                x = whole_numbers(listed, ok & (lengths == size), size)
                counts[size] = counts.get(size, 0) + len(x)
                sums[size] = sums.get(size, np.zeros(size, np.int64)) + x.sum(axis=0)
        for size, n in counts.items():
            yield pa.RecordBatch.from_pydict(
                {"size": np.full(size, size), "dim": np.arange(size), "n": np.full(size, n), "total": sums[size]},
                schema=pa.schema([("size", pa.int64()), ("dim", pa.int64()), ("n", pa.int64()), ("total", pa.int64())]),
            )

    parts = vectors.select("embedding").mapInArrow(run, "size long, dim long, n long, total long")
    by_dim = parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    most = by_dim.groupBy().agg(F.max(F.struct("n", "size")).alias("m"))
    rows = by_dim.join(most, F.col("size") == F.col("m.size")).select("dim", by_dim["n"], "total").collect()  # a row for each dimension
    sums = np.zeros(len(rows), np.int64)
    for r in rows:
        sums[r["dim"]] = r["total"]
    return (rows[0]["n"] if rows else 0), sums


def _summed(vectors: DataFrame, n: int, sums: np.ndarray, product, rows: int, columns: int) -> np.ndarray:
    """The sum over the table of ``product`` (rows x columns) of blocks of centred vectors, added up by Spark."""

    def run(batches):
        total = np.zeros((rows, columns))
        for batch in batches:
            listed = _lists(batch, 0)
            x = whole_numbers(listed, usable(listed, len(sums)), len(sums))
            for start in range(0, len(x), 4096):
                total += product((n * x[start : start + 4096] - sums) / n)
        values = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), columns).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), values], names=["i", "row"])

    parts = vectors.select("embedding").mapInArrow(run, "i long, row array<double>")
    added = parts.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(columns)]).alias("row"))
    out = np.zeros((rows, columns))
    for r in added.collect():  # dimensions x columns of the block
        out[r["i"]] = r["row"]
    return out


def fit(vectors: DataFrame, k: int = COMPONENTS, most_passes: int = 300, tolerance: float = TOLERANCE) -> Whitening | None:
    """Components of the column ``embedding``; None without any whole vector."""
    n, sums = sums_of(vectors)
    d = len(sums)
    if n == 0:
        return None
    k = min(k, d)
    block, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((d, min(d, 2 * k))))
    for passes in range(1, most_passes + 1):
        q = block

        def product(y, q=q):
            # X'(XQ), and the squares of the entries for the trace, as one more column
            return np.column_stack([y.T @ (y @ q), (y * y).sum(axis=0)])

        summed = _summed(vectors, n, sums, product, d, q.shape[1] + 1) / n
        w, trace = summed[:, :-1], float(summed[:, -1].sum())
        small = q.T @ w
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        q, w = q @ turn, w @ turn
        residuals = np.linalg.norm(w - q * values, axis=0)[:k]
        if values[0] <= 0 or residuals.max() <= tolerance * values[0]:
            real = int((values[:k] > max(NOTHING * values[0], 0.0)).sum()) if trace > 0 else 0
            return Whitening(n, sums, q[:, :real], values[:real], trace, float(residuals.max()), passes)
        block, _ = np.linalg.qr(w)
    raise RuntimeError(f"{most_passes} passes leave a residual of {residuals.max() / values[0]:.1e} of the largest eigenvalue")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured by a pass over the table."""
    k = len(model.values)
    if k == 0:
        return 0.0
    scaled = model.vectors / np.sqrt(model.values)

    def product(y):
        z = y @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    summed = _summed(vectors, model.n, model.sums, product, k + 1, k) / model.n
    covariance = summed[:k] - np.outer(summed[k], summed[k])
    return float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2, null beyond a long."""
    y = n * x - sums
    if len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, model: Whitening | None, error: float | None = None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every whole row of ``vectors``."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k, n, sums, d = len(model.values), model.n, model.sums, len(model.sums)
    scaled, explained = model.vectors / np.sqrt(model.values), model.values / model.trace
    error = identity_error(vectors, model) if error is None else error

    def run(batches):
        for batch in batches:
            listed = _lists(batch, 1)
            ok = usable(listed, d)
            ids, x = batch.column(0).filter(pa.array(ok)), whole_numbers(listed, ok, d)
            for start in range(0, len(x), 4096):
                part = x[start : start + 4096]
                z = ((n * part - sums) / n) @ scaled
                m = len(part)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array(deviations(part, n, sums), pa.int64()).take(each), pa.array(z.reshape(-1)),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, schema)
