"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (n = 1, 2, 3 bytes, hashed) that both hold,
over the root of the product of how many each holds. Landmarks span a Nystroem space in which kernel ridge regression
is fitted one-versus-rest; both fold into one coefficient matrix, so scoring is two matrix products a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc_of_id, sized_broadcast, written

_FOLD = bytes(range(256)).lower()


@dataclass(frozen=True)
class Shape:
    """per_language bounds the training sample of each language; landmarks (two a language at least) and grams the model."""

    grams: int = 8192
    landmarks: int = 128
    per_language: int = 400
    ridge: float = 1e-2


def presence(text: str, grams: int) -> np.ndarray:
    """Which hashed n-grams a whole text holds."""
    b = np.frombuffer(text.encode().translate(_FOLD), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(grams, dtype=bool)
    shift = np.uint32(32 - (grams.bit_length() - 1))
    out[((b + np.uint32(1)) * np.uint32(2654435761)) >> shift] = True
    if len(b) > 1:
        two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1000)
        out[(two * np.uint32(2654435761)) >> shift] = True
        if len(b) > 2:
            out[((two[:-1] * np.uint32(257) + b[2:] + np.uint32(77777)) * np.uint32(2246822519)) >> shift] = True
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    nx, nz = x.sum(axis=1), landmarks.sum(axis=1)
    return (x @ landmarks.T) / np.sqrt(np.maximum(nx, 1)[:, None] * np.maximum(nz, 1)[None, :])


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray
    coef: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        k = kernel(x, self.landmarks)
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.coef


def fit(x: np.ndarray, y: list[str], shape: Shape) -> Model:
    """Landmarks are dealt evenly over the languages. Without rows there are no languages, and all is `und`."""
    langs = sorted(set(y))
    if not langs:
        return Model([], np.zeros((0, shape.grams), np.float32), np.zeros((1, 0), np.float32))
    rows = {c: [i for i, v in enumerate(y) if v == c] for c in langs}
    pick = [i for k in range(len(y)) for c in langs for i in rows[c][k : k + 1]][: max(shape.landmarks, 2 * len(langs))]
    z = x[pick]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    good = values > 1e-6 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([kernel(x, z) @ half, np.ones((len(x), 1))])
    target = np.array([[1.0 if v == c else -1.0 for c in langs] for v in y])
    weight = np.array([1 / len(rows[v]) for v in y])[:, None] * len(y) / len(langs)
    beta = np.linalg.solve(phi.T @ (weight * phi) + shape.ridge * np.eye(phi.shape[1]), phi.T @ (weight * target))
    return Model(langs, z, np.vstack([half @ beta[:-1], beta[-1:]]).astype(np.float32))


def train(docs: DataFrame, shape: Shape = Shape()) -> Model:
    """Fit on per_language documents at most of each value of lang; all values are learnt.

    Only rows whose crc fold is not 2 and whose doc_id, text and lang aren't null count. A language's documents are those
    with the least hashes of id and text; rows that repeat both count once.
    """
    spark = docs.sparkSession
    ok = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 4 != 2)).where("text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    space = 1 << 40
    ok = ok.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(space)))
    counts = written(ok.groupBy("lang").agg(F.count("*").alias("count"), F.min("draw").alias("first")), "lang_counts")
    cut = F.greatest(F.col("first") + 1, F.least(F.lit(1.0), 1.5 * shape.per_language / F.col("count")) * space)  # some more than asked, one at least
    sample = ok.join(sized_broadcast(counts, counts.count(), 100_000), "lang").where(F.col("draw") < cut).select("doc_id", "lang", "text", "draw")
    sample = written(sample.dropDuplicates(["lang", "draw"]), "lang_sample")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = sample.withColumn("place", place).where(F.col("place") <= shape.per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence(t, shape.grams)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    bound_batches(spark)
    got = sample.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, bits binary")
    got = got.orderBy("doc_id", "bits").toArrow()  # per_language short rows a language
    bits = np.frombuffer(b"".join(got["bits"].to_pylist()), dtype=np.uint8).reshape(-1, shape.grams // 8)
    return fit(np.unpackbits(bits, axis=1).astype(np.float32), got["lang"].to_pylist(), shape)


def predict(docs: DataFrame, model: Model, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    `und` with score 0 if the text is null or has no letter (number characters are none), or nothing was learned. score:
    the winning language's share of a softmax over the regression values; of equal ones the first name wins. A row without
    a doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]
            for k in range(0, len(todo), 256):
                part = todo[k : k + 256]
                x = np.empty((len(part), shape.grams), dtype=np.float32)
                for j, i in enumerate(part):
                    x[j] = presence(texts[i], shape.grams)
                s = m.scores(x)
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                p = e / e.sum(axis=1, keepdims=True)
                for i, best, value in zip(part, s.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = m.langs[best], min(1.0, max(0.0, value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
