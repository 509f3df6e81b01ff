"""Operator 5: level-wise doubling over word windows.

The first level looks at short windows of ``SEED`` words. It need not see all of them: every window
of ``WINDOW`` words holds a leftmost smallest hashed seed, the same one wherever the window stands,
so only these seeds (about one word in four) are counted. Seeds that stand in one document only
drop out; around the others the windows of the next length, ``WINDOW`` words, are formed and
compared. ``levels`` goes on by the same rule: windows repeated at one length alone are joined with
their followers to twice that length, until no candidates survive.

Documents whose whole word sequence is that of a smaller one go entirely and are left out before.
A word goes if it lies in a ``WINDOW``-word window whose word sequence also starts in a document
with a smaller doc_id. Counts are pre-aggregated by hash before any join, so a window that a third
of all documents share is one row per task; windows are compared by 64-bit hashes.

Defined results: null and empty texts have no words; texts under ``WINDOW`` words lose nothing;
very long texts are read whole; rows are told apart by a hash of doc_id and text (``rid``); rows that
share a doc_id don't remove each other, as neither is the smaller; a null doc_id counts as larger than any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.common import SPACE, U64, covered, leftmost_minima, mix, prefix_hash, releasing, rolling, setup, slices, span_hash, utf8, words

WINDOW = 13
SEED = 6
LAST = (1 << 63) - 1


def _windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every window within one text: its text, its first word, the word at which its chosen seed begins; and the words' and seeds' hashes and the texts' first words."""
    start, end, at = words(buf, offs)
    h = span_hash(prefix_hash(buf), start, end)
    seeds = rolling(h, SEED)
    chosen = leftmost_minima(seeds, WINDOW - SEED + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))[:len(chosen)]
    first = np.flatnonzero(np.arange(len(chosen)) + WINDOW <= at[1:][doc])
    return doc[first], first, chosen[first], h, seeds, at


def _whole(batches):
    """Two hashes of the word sequence of each text that has a window."""
    for batch in batches:
        for part in slices(batch, "text"):
            buf, offs = utf8(part.column("text"))
            start, end, at = words(buf, offs)
            n = np.diff(at)
            place = np.arange(len(start)) - np.repeat(at[:-1], n)
            out = []
            for seed in (0, 1):
                total = np.zeros(len(start) + 1, U64)
                np.cumsum(mix(span_hash(prefix_hash(buf, seed), start, end, seed) + mix(place.astype(U64) + U64(seed + 1))), out=total[1:])
                out.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(U64)).astype(np.int64))
            long_ = pa.array(n >= WINDOW)
            yield pa.RecordBatch.from_pydict({"rid": part.column("rid"), "key": part.column("key"), "h1": pa.array(out[0]), "h2": pa.array(out[1])}).filter(long_)


def _seeds(batches):
    for batch in batches:
        batch = batch.filter(pa.compute.invert(batch.column("copy")))
        for part in slices(batch, "text"):
            doc, _, chosen, _, seeds, at = _windows(*utf8(part.column("text")))
            new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, int)
            doc, chosen = doc[new], chosen[new]
            # 48 bits suffice to tell whether a seed may stand elsewhere
            yield pa.RecordBatch.from_pydict({"seed": pa.array((seeds[chosen] >> U64(16)).astype(np.int64)), "rid": part.column("rid").take(pa.array(doc)),
                                              "pos": pa.array((chosen - at[doc]).astype(np.int32))})


def _extend(batches):
    """The windows whose seed survived."""
    for batch in batches:
        batch = batch.filter(pa.compute.is_valid(batch.column("seeds")))
        for part in slices(batch, "text"):
            doc, first, chosen, h, _, at = _windows(*utf8(part.column("text")))
            alive = np.zeros(len(h) + 1, bool)
            lists = part.column("seeds")
            alive[np.repeat(at[:-1], pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)) + lists.flatten().to_numpy(zero_copy_only=False)] = True
            on = alive[chosen]
            doc, first = doc[on], first[on]
            hashes = rolling(h, WINDOW)[first].astype(np.int64) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"w": pa.array(hashes), "rid": part.column("rid").take(pa.array(doc)), "key": part.column("key").take(pa.array(doc)),
                                              "pos": pa.array((first - at[doc]).astype(np.int32))})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), "doc_id", "text")


def _anew(name: str):
    """The value as a new one: both sides of a join on it are then shuffled for the join, so a hot value is split."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("long")).alias("g")


def _first(rows: DataFrame) -> DataFrame:
    """The smallest document of each window."""
    return rows.groupBy("w").agg(F.min("key").alias("first")).select(_anew("w"), "first")


def copies(docs: DataFrame) -> DataFrame:
    """k (rid) of every row whose whole word sequence (with a window in it) is that of a row with a smaller key."""
    whole = _texts(docs).select("rid", "key", "text").mapInArrow(_whole, "rid long, key long, h1 long, h2 long").checkpoint()
    first = whole.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last") \
        .select(_anew("h1"), F.col("h2").alias("g2"), "first")
    return whole.join(first, (F.col("h1") == F.col("g")) & (F.col("h2") == F.col("g2"))).where("key > first").select(F.col("rid").alias("k")).distinct()


def _marked(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """The texts by rid, with whether they are copies."""
    return _texts(docs).join(copied.withColumn("copy", F.lit(True)), F.col("rid") == F.col("k"), "left").withColumn("copy", F.coalesce("copy", F.lit(False))).drop("k")


def repeated_windows(docs: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """w, rid (row), key (doc_id), pos (word) and first (smallest doc_id) of every window that stands in several documents.

    With ``copied`` (see ``copies``) these rows are left out; what stands in them stands in a smaller one too. The seeds that
    survive are kept before the windows are formed, so the shuffles of both don't lie on disk together."""
    setup(docs.sparkSession)
    texts = _marked(docs, copied if copied is not None else docs.sparkSession.createDataFrame([], "k long"))
    seeds = texts.mapInArrow(_seeds, "seed long, rid long, pos int")
    often = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_anew("seed"))
    with releasing(docs.sparkSession):
        alive = seeds.join(often, F.col("seed") == F.col("g")).groupBy("rid").agg(F.collect_set("pos").alias("seeds")).withColumnRenamed("rid", "k").checkpoint()
    rows = texts.join(alive, F.col("rid") == F.col("k"), "left").select("rid", "key", "doc_id", "text", F.when(~F.col("copy"), F.col("seeds")).alias("seeds")) \
        .mapInArrow(_extend, "w long, rid long, key long, pos int")
    return rows.join(_first(rows), F.col("w") == F.col("g")).select("w", "rid", "key", "pos", "first")


def levels(docs: DataFrame) -> list[tuple[int, DataFrame]]:
    """(length, its repeated windows) for WINDOW words and each doubling, as long as any window survives."""
    def shared(rows):
        both = rows.groupBy("w").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select(_anew("w"))
        return rows.join(both, F.col("w") == F.col("g"), "left_semi").checkpoint()

    length, rows, out = WINDOW, shared(repeated_windows(docs)), []
    while not rows.isEmpty():
        out.append((length, rows))
        ahead = rows.select(F.col("rid").alias("k"), (F.col("pos") - length).alias("p"), F.col("w").alias("next"))
        twice = rows.join(ahead, (F.col("rid") == F.col("k")) & (F.col("pos") == F.col("p"))).select(F.xxhash64("w", "next").alias("w"), "rid", "key", "pos").distinct()
        rows = shared(twice.join(_first(twice), F.col("w") == F.col("g")).select("w", "rid", "key", "pos", "first"))
        length *= 2
    return out


def _report(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            buf, offs = utf8(part.column("text"))
            start, end, at = words(buf, offs)
            lists = part.column("gone")
            begin = np.repeat(at[:-1], pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)) \
                + lists.flatten().to_numpy(zero_copy_only=False)
            gone = covered(len(start), begin, begin + WINDOW) if len(begin) else np.zeros(len(start), bool)
            gone |= np.repeat(part.column("copy").to_numpy(zero_copy_only=False), np.diff(at))
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
            # bytes of kept words, and the first blank after each (none at the text's end)
            stay = covered(len(buf), start[~gone], end[~gone])
            blank = end[~gone & (end < offs[1:][doc])]
            stay[blank] = True
            text = np.where(SPACE[buf], 32, buf).astype(np.uint8)
            removed = np.bincount(doc[gone], minlength=len(offs) - 1)
            sums = [hashlib.sha256(text[a:b][stay[a:b]].tobytes().rstrip(b" ")).hexdigest() for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(at)), "n_removed": pa.array(removed), "kept_sha256": pa.array(sums, pa.string())})


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    with releasing(docs.sparkSession):
        copied = copies(docs).checkpoint()
        gone = repeated_windows(docs, copied).where("key > first").groupBy(F.col("rid").alias("k")).agg(F.collect_set("pos").alias("gone")).checkpoint()
    return _marked(docs, copied).join(gone, F.col("rid") == F.col("k"), "left").select("doc_id", "text", "copy", "gone") \
        .mapInArrow(_report, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
