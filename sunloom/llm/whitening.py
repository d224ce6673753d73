"""Whitened principal components of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay on the cluster, as blocks of a written table. A step multiplies X by a right vector v, takes the
earlier left vectors off the product u = Xv (full reorthogonalisation, by inner products measured on the rows), and
multiplies Xᵀ by u for the next right vector, which is orthogonalised against all earlier ones. A left vector has as many
entries as there are rows, so it is kept as u = Xw by its short w: every task makes its part of it anew, a step is one
pass, and a lost executor loses nothing. The singular value decomposition of the small bidiagonal matrix gives components
and deviations. The driver holds vectors of the length of a row only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written

#: Below this share of the largest singular value, a length counts as 0.
TINY = 1e-11


@dataclass(frozen=True)
class Whitening:
    """Components (columns) by falling eigenvalue of the covariance of n rows with sums S, and what was measured."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def on_grid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """key and x, the entries as integers floor(scale * entry) + shift; without vectors that are null or hold null or
    non-finite entries, or none."""
    c = F.col(vector)
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = F.when(c.isNotNull() & (F.size(c) > 0), fine).otherwise(False)
    x = F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))
    return vectors.select(F.col(key), F.when(good, x).alias("x")).where("x IS NOT NULL")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width)


def _blocks(rows: DataFrame, width: int, most: int = 1 << 20) -> DataFrame:
    """The vectors of x packed into blocks of up to `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            m = np.ascontiguousarray(_matrix(batch.column(0), width), dtype=np.int64)
            held.append(m.tobytes())
            size += m.nbytes
            if size >= most:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])

    return written(rows.mapInArrow(run, "block binary"), "whitening_rows")


def _summed(blocks: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> list:
    """The sum over all blocks of part(matrix of a block), an array of fixed length; exact: of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column(0):
                m = np.frombuffer(b.as_buffer(), np.int64).reshape(-1, width)
                p = part(m)
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(kind))], ["part"])

    kind, name = (pa.int64(), "bigint") if exact else (pa.float64(), "double")
    each = blocks.mapInArrow(run, f"part array<{name}>").select(F.posexplode("part").alias("k", "v"))
    got = each.groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)") if exact else F.col("v")).alias("v")).collect()  # a row an entry
    out = [0] * len(got)
    for r in got:
        out[r.k] = int(r.v) if exact else r.v
    return out


def _centre(m: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Rows less their mean base + rest; the large whole part is taken off as integers."""
    return (m - base) - rest


def bidiagonalise(blocks: DataFrame, base: np.ndarray, rest: np.ndarray, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(right vectors as columns, upper bidiagonal matrix, squared norm of the centred rows).

    Ends when the leading `wanted` singular triplets have converged and a fresh start that is orthogonal to all before
    finds nothing as large (equal singular values show in fresh starts only), or after as many steps as a row is long.
    """
    d, rng = len(base), np.random.default_rng(seed)
    v = np.zeros((d, 0))
    w, z = np.zeros((d, 0)), np.zeros((d, 0))  # left vectors u = Xw, and Xᵀu
    alpha, beta, scale, whole, begun = [], [], 0.0, 0.0, 0

    def fresh() -> np.ndarray:
        r = rng.standard_normal(d)
        for _ in range(3):
            r -= v @ (v.T @ r)
        return r / np.linalg.norm(r)

    following = fresh()
    while v.shape[1] < d:
        now = following
        ask = now - w @ (z.T @ now)  # u = Xv less what earlier left vectors take of it

        def products(m: np.ndarray, ask: np.ndarray = ask, w: np.ndarray = w) -> np.ndarray:
            c = _centre(m, base, rest)
            u = c @ ask
            return np.concatenate([[u @ u, np.einsum("ij,ij->", c, c)], c.T @ u, (c @ w).T @ u])

        got = np.array(_summed(blocks, d, products))
        square, whole, down, over = got[0], got[1], got[2 : d + 2], got[d + 2 :]
        ask, down, square = ask - w @ over, down - z @ over, square - over @ over
        scale = np.sqrt(whole)
        long_ = np.sqrt(max(square, 0.0))
        if long_ <= TINY * scale:
            long_, ask, down = 0.0, np.zeros(d), np.zeros(d)
        else:
            ask, down = ask / long_, down / long_
        v, w, z = (np.column_stack([a, b]) for a, b in ((v, now), (w, ask), (z, down)))
        alpha.append(long_)
        if scale == 0 or v.shape[1] == d:
            break
        r = down - long_ * now
        for _ in range(2):
            r -= v @ (v.T @ r)
        step = np.linalg.norm(r)
        if step <= TINY * scale:
            step, following = 0.0, fresh()
        else:
            following = r / step
            own = np.diag(alpha[begun:]) + np.diag(beta[begun:], 1)
            left, s, _ = np.linalg.svd(own)
            k = min(wanted, len(s))
            if len(alpha) > wanted and step * np.abs(left[-1, :k]).max() <= 1e-15 * s[0]:
                every = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1), compute_uv=False)
                if begun and s[0] < every[wanted - 1]:
                    break
                step, following, begun = 0.0, fresh(), len(alpha)
        beta.append(step)
    return v, np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1), whole


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening of the distinct vectors x of rows (all of one length); None without any.

    Directions without variance are no components.
    """
    lengths = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None:
        return None
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have between {lengths[0]} and {lengths[1]} entries")
    d = lengths[0]
    bound_batches(rows.sparkSession)
    blocks = _blocks(rows.select("x").distinct(), d)
    n, *sums = _summed(blocks, d, lambda m: np.concatenate([[len(m)], m.sum(axis=0)]), exact=True)
    base = np.array([round(s / n) if abs(s) < 1 << 53 else s // n for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(b)) / n for s, b in zip(sums, base, strict=True)])
    k = min(components, d)
    v, b, whole = bidiagonalise(blocks, base, rest, k)
    _, s, q = np.linalg.svd(b)
    k = min(k, int((s > 1e-9 * max(s[0], 1e-300)).sum()) if whole > 0 else 0)
    axes, e = v @ q[:k].T, s[:k] ** 2 / n

    def gram(m: np.ndarray) -> np.ndarray:
        y = _centre(m, base, rest) @ axes / np.sqrt(e)
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    worst = 0.0
    if k:
        got = np.array(_summed(blocks, d, gram)) / n
        worst = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return Whitening(n, tuple(sums), axes, e, whole / n, worst)


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """A row for each row and component: key, component, n, deviation, whitened, explained, identity_error.

    Without a model, or where no direction has variance, there are no components and so no rows. A deviation too great
    for a long is null. Rows of equal vectors have equal values; a null key stays null.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    n, k = model.n, len(model.eigenvalues)
    sums = np.array(model.sums, dtype=object)
    base = np.array([s // n for s in model.sums], dtype=np.int64)
    left = np.array([s - n * int(b) for s, b in zip(model.sums, base, strict=True)], dtype=object)
    rest = np.array([x / n for x in left])
    axes = model.components / np.sqrt(model.eigenvalues)
    share = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.asarray(_matrix(batch.column(1), len(base)), dtype=np.int64)
            off = m - base
            if n * (int(np.abs(off).max()) + 1) < 1 << 30:
                apart = ((n * off - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                apart = ((n * m.astype(object) - sums) ** 2).sum(axis=1).tolist()
            y = (off - rest) @ axes
            rows_ = len(m)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows_), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n)),
                pa.array([a if a < 1 << 63 else None for a in apart], pa.int64()).take(pa.array(np.repeat(np.arange(rows_), k))),
                pa.array(y.ravel()), pa.array(np.tile(share, rows_)), pa.array(np.full(rows_ * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    bound_batches(rows.sparkSession)
    return rows.select(key, "x").mapInArrow(run, schema)
