"""Operator 4: pack tokenised documents into fixed-length sequences by best-fit decreasing.

Every document is tokenised whole, closed with an end id, and cut into full windows of
``capacity`` ids; the remainder (shorter than a window) is what gets packed. Remainders are dealt
by a hash of their row number into shards of about ``SHARD_ROWS`` rows (the number of shards follows
the row count, the size of a shard doesn't), and each shard is packed by itself: lengths in
decreasing order, each into the tightest open window found with a segment tree over remaining
capacities. Only (doc_id, start, length) rows are shuffled, never texts; equal rows are dealt as evenly as others.

Defined results: a null or empty text is one piece that holds only the end id; very long texts
give several full windows; repeated rows or repeated doc_ids are packed row by row (their pieces
share a doc_id); pieces of equal length are taken by doc_id, start and checksum; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.byte_level import byte_level
from rfmspark.llm.common import setup

CAPACITY = 2048
END_ID = 1
SHARD_ROWS = 32768


def _cutter(path: str | None, capacity: int, end_id: int, with_ids: bool):
    def fn(batches):
        encoder = byte_level(path)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encoder.encode(text.as_py() or ""), end_id], "<u4").tobytes()
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s:4 * (s + capacity)]
                    rows["doc_id"].append(d)
                    rows["start"].append(s)
                    rows["length"].append(len(piece) // 4)
                    rows["ids_crc32"].append(zlib.crc32(piece))
                    rows["doc_tokens"].append(n)
                    if with_ids:
                        rows["ids"].append(piece)
            types = {"doc_id": batch.schema.field("doc_id").type, "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in rows.items() if with_ids or k != "ids"})
    return fn


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and the ids as little-endian unsigned 32-bit)."""
    setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, capacity, end_id, with_ids), schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: whether an open window has exactly that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.open[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """Smallest room >= need that an open window has; -1 if none."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, given in decreasing order."""
    tree, rooms, count = CapacityTree(capacity), {}, 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        room = tree.tightest(n)
        if room < 0:
            w, room, count = count, capacity, count + 1
        else:
            w = rooms[room].pop()
            tree.add(room, -1)
        window[i], offset[i] = w, capacity - room
        if room > n:
            tree.add(room - n, 1)
            rooms.setdefault(room - n, []).append(w)
    return window, offset


def _shard_packer(capacity: int):
    def fn(key, rows: pd.DataFrame) -> pd.DataFrame:
        order = ["length", *[c for c in ("doc_id", "start", "ids_crc32") if c in rows]]
        rows = rows.sort_values(order, ascending=[False] + [True] * (len(order) - 1), kind="stable")
        window, offset = best_fit(rows["length"].tolist(), capacity)
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 32) + window, offset
        return rows.drop(columns="shard")
    return fn


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; any further columns stay.

    The pieces (never texts) are written once, so that every row has a fixed number of its own to be dealt by."""
    setup(pieces.sparkSession)
    pieces = pieces.checkpoint()
    n = pieces.count()  # a shard's size doesn't depend on it
    shards = max(1, -(-n // SHARD_ROWS))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("shard").applyInPandas(_shard_packer(capacity), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(cut(docs, tokenizer, capacity, end_id, with_ids), capacity)
