"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, written
from .wordbpe import encoder

SCHEMA = "doc_id long, part int, row long, ids array<int>"


def write_token_orc(docs: DataFrame, out: str, path: str, end_id: int = 2, stripe_mb: int = 64, stride: int = 1000) -> None:
    """Write one row a document (doc_id, part, row, ids) in ascending doc_id order, over files and in them.

    part numbers the files in order, row the rows in a file. A null text has the end id alone; null ids come first;
    rows of one id stand in the order of their text's hash, and are cut into ranges like others, also where they are equal.
    The texts, not the ids, are shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, row, tail = encoder(path), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            ids = [x + tail for x in enc.encode_all(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.ListArray.from_arrays(pa.array(ends), values)],
                ["doc_id", "part", "row", "ids"],
            )
            row += n

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = texts.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", str(stride))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(out)
    )


def read_token_orc(spark: SparkSession, out: str) -> DataFrame:
    """The table as written; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(out)


def find_documents(spark: SparkSession, out: str, doc_ids: Iterable[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups that can't hold them are skipped."""
    return read_token_orc(spark, out).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    start is a running sum within a file plus the sums of the files before it. Only the counts are sorted.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), dtype="<i4").view(np.uint8)
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    bound_batches(spark)
    rows = read_token_orc(spark, out).mapInArrow(digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    rows = written(rows, "token_counts")
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    out_rows = rows.withColumn("start", within).join(sums, "part")
    return out_rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
