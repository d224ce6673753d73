"""First-fit decreasing packing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written
from .wordbpe import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item. The tree holds the largest free room below each node, so the first bin that fits
    is found by one walk down; items go in by falling length, ties in their given order."""
    n = max(1, len(lengths))
    leaves = 1 << (n - 1).bit_length()
    free = [room] * (2 * leaves)
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need, node = lengths[i], 1
        while node < leaves:
            node = 2 * node if free[2 * node] >= need else 2 * node + 1
        out[i] = (node - leaves, room - free[node])
        free[node] -= need
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return out


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, room: int = 4096) -> DataFrame:
    """Each document's ids, with end_id last, cut into pieces of room ids and one of the rest.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows each give their pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                rows += [(doc, s, min(room, n - s), zlib.crc32(ids[4 * s : 4 * (s + room)]), n) for s in range(0, n, room)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, room: int = 4096, group_rows: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset. Groups hold about group_rows pieces each, dealt by a hash of each row's place in
    the written table, so equal rows spread as others do, and neither a group nor a worker's memory grows with the input.

    sequence_id is unique over groups (group times 2**32 plus the sequence's place in it), offsets are gapless.
    """
    pieces = written(pieces, "token_pieces")  # a row's place must not change when a task runs again
    groups = max(1, -(-pieces.count() // group_rows))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        spots = first_fit_decreasing(rows["length"].tolist(), room)
        rows["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in spots]
        rows["offset"] = [o for _, o in spots]
        return rows.drop(columns="__group")

    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("__group", group).groupBy("__group").applyInPandas(place, PACKED)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, room: int = 4096, group_rows: int = 4096) -> DataFrame:
    """All documents packed into sequences of at most room ids; an empty table gives no rows."""
    return pack(token_pieces(docs, path, end_id, room), room, group_rows)
