"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_of_id

_UPPER = re.compile(rb"[A-Z]")
_MARKS = (b"!", b"|", b"#", b"*", b"$", b"%", b"&", b"<", b">", b".", b",", b"@", b"/")
STATS = 12 + len(_MARKS)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of what it is fitted on; sample bounds the labelled rows that training sees."""

    words: int = 2048
    rank: int = 8
    sample: int = 8000
    epochs: int = 30
    seed: int = 7


class _Hasher:
    """Word to bucket, remembered for about 100,000 words."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 100_000:
            known.clear()
        new = set(words).difference(known)
        known.update((w, zlib.crc32(w.lower().strip(b".,;:!?")) % self.words) for w in new)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        for w in new:
            if len(w) > 64:  # memory is bounded by bytes
                del known[w]
        return out


def structure(text: str, raw: bytes, words: list[bytes]) -> list[float]:
    """Statistics of form, each about 0 to 1; of an empty text all 0."""
    n, m = max(1, len(raw)), max(1, len(words))
    lines = raw.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    pairs = list(zip(words, words[1:], strict=False))
    return [
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, np.log1p(len(raw)) / 12),
        min(1.0, (len(raw) - len(words)) / m / 20),
        upper / n,
        digits / n,
        (len(raw) - len(text)) / n,
        len(set(words)) / m,
        1 - len(set(pairs)) / max(1, len(pairs)),
        1 - len(set(full)) / max(1, len(full)),
        min(1.0, len(full) / m * 5),
        min(1.0, max(map(len, words), default=0) / 100),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        *(min(1.0, raw.count(c) / m) for c in _MARKS),
    ]


def featurise(texts: list[str | None], hasher: _Hasher) -> np.ndarray:
    """A row a text: root shares of hashed words, then the statistics. Whole texts count."""
    x = np.zeros((len(texts), hasher.words + STATS), dtype=np.float32)
    for i, text in enumerate(texts):
        text = text or ""
        raw = text.encode()
        words = raw.split()
        if words:
            x[i, : hasher.words] = np.sqrt(np.bincount(hasher(words), minlength=hasher.words) / len(words))
        x[i, hasher.words :] = structure(text, raw, words)
    return x


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + interactions); the interactions take linear time by the sum-of-squares identity."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) * self.scale
        return self.bias + z @ self.w + 0.5 * ((z @ self.v) ** 2 - (z**2) @ (self.v**2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, shape: Shape) -> Machine:
    """Adam on the logistic loss. Without rows, or with one label only, the bias alone speaks. x is scaled in place."""
    rng = np.random.default_rng(shape.seed)
    n, d = x.shape
    mean = x.mean(axis=0, dtype=np.float64) if n else np.zeros(d)
    sd = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / n - mean**2, 0)) if n else np.ones(d)
    scale = np.where(sd > 1e-6, 1 / np.maximum(sd, 1e-2), 0).astype(np.float32)
    scale[: shape.words] *= 0.1  # many weak inputs beside few strong ones
    share = float((y.sum() + 1) / (n + 2))
    out = Machine(float(np.log(share / (1 - share))), np.zeros(d, np.float32), rng.normal(0, 0.01, (d, shape.rank)).astype(np.float32), mean.astype(np.float32), scale)
    if n < 2 or y.min() == y.max():
        out.v[:] = 0
        return out
    x -= out.mean
    x *= out.scale
    theta = [np.array([out.bias], np.float32), out.w, out.v]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for epoch in range(shape.epochs):
        rate = 0.02 * (1 - epoch / shape.epochs) + 1e-4
        for at in np.array_split(rng.permutation(n), max(1, n // 256)):
            b = x[at]
            sq = b**2
            inner = b @ theta[2]
            m = theta[0] + b @ theta[1] + 0.5 * (inner**2 - sq @ theta[2] ** 2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[at]).astype(np.float32) / len(at)
            grads = [g.sum(keepdims=True), b.T @ g + 1e-4 * theta[1], b.T @ (g[:, None] * inner) - (sq.T @ g)[:, None] * theta[2] + 1e-3 * theta[2]]
            step += 1
            for t, gr, f, s in zip(theta, grads, first, second, strict=True):
                f += 0.1 * (gr - f)
                s += 0.001 * (gr**2 - s)
                t -= rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    out.bias, out.w, out.v = float(theta[0][0]), theta[1], theta[2]
    return out


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Machine:
    """Fit on at most shape.sample labelled documents: those of least hash among rows whose crc fold isn't 0.

    Only text enters. Labels that are null, or of no document, are left out.
    """
    spark, width = docs.sparkSession, shape.words
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 5 != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id")).limit(shape.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(width)
        for batch in batches:
            x = featurise(batch.column(1).to_pylist(), hasher).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["doc_id", "x", "y"])

    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    got = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, x binary, y int").orderBy("doc_id", "x").limit(2 * shape.sample).toArrow()
    x = np.empty((len(got), width + STATS), dtype=np.float32)
    at = 0
    for part in got["x"].chunks:  # 33 MB for 8000 rows as half floats, twice that here
        for cell in part:
            x[at] = np.frombuffer(cell.as_buffer(), dtype=np.float16)
            at += 1
    y = got["y"].to_numpy().astype(np.float32)
    del got
    pa.default_memory_pool().release_unused()
    return fit(x, y, shape)


def _scorer(docs: DataFrame, model: Machine, shape: Shape) -> Callable[[list[str | None]], np.ndarray]:
    """Scores of texts; the function made for a task remembers words from batch to batch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    hashers: list[_Hasher] = []

    def score(texts: list[str | None]) -> np.ndarray:
        if not hashers:
            hashers.append(_Hasher(shape.words))
        parts = [shared.value.score(featurise(texts[i : i + 256], hashers[0])) for i in range(0, len(texts), 256)]
        return np.concatenate(parts or [np.zeros(0)]).astype(float)

    bound_batches(docs.sparkSession)
    return score


def score_documents(docs: DataFrame, model: Machine, shape: Shape = Shape(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; a null text is scored as the empty one, a null doc_id not held out."""
    score = _scorer(docs, model, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, shape: Shape = Shape(), threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    score = _scorer(docs, model, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
