"""Operator 1: repeated passages from the interval tree of a distributed, sampled suffix array.

Every ``WINDOW``-byte string holds the leftmost smallest of its hashed ``GRAM``-byte grams; equal
strings choose the same one, so it is enough to sort and compare suffixes at the chosen places
(anchors, about one in 85 bytes). An anchor stands for the run of windows that chose it, its
segment. Anchors whose gram occurs once drop out after a count. Of the rest, equal segments are
counted by hash; distinct segments of one gram are put in suffix order (the text from the anchor
on), the array of longest common prefixes between neighbours is scanned with a stack, and each of
the tree's intervals is tested for left extension: its members, ordered by the text before the
anchor, fall into groups that agree on at least ``WINDOW`` bytes in all. A group whose members come
from two or more children of the interval is a maximal repeat, reported with all occurrences.
A gram with more than ``GROUP`` distinct segments (a passage in a large share of all documents)
isn't gathered in one task: its windows are counted by hash instead, which is exact as well.

Texts are UTF-8 bytes, null counts as empty, matches stay in one document, rows are told apart by a
hash of doc_id and text. Defined results: texts under ``WINDOW`` bytes lose nothing; very long
texts are read in overlapping chunks; a repeated row makes both its copies repeats of each other;
null doc_ids are kept; an empty table gives no rows; other columns are ignored by ``dedup_report``
and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.common import SLICE_BYTES, U64, covered, leftmost_minima, prefix_hash, setup, slices, span_hash, utf8

WINDOW = 200
GRAM = 32
GROUP = 8192


def _chunks(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the first text, its bytes skipped, bytes, offsets): whole texts, or a long one in chunks that share WINDOW - 1 bytes."""
    if len(offs) > 2 or offs[-1] <= 2 * SLICE_BYTES:
        yield 0, 0, buf, offs
        return
    for lo in range(0, len(buf) - WINDOW + 1, SLICE_BYTES):
        part = buf[lo:lo + SLICE_BYTES + WINDOW - 1]
        yield 0, lo, part, np.array([0, len(part)])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, anchor, segment start and end (bytes of the text), gram hash and segment hash."""
    out = []
    for first, skip, b, o in _chunks(buf, offs):
        n = len(b) - WINDOW + 1
        if n <= 0:
            continue
        prefix = prefix_hash(b)
        at = np.arange(len(b) - GRAM + 1)
        gram = span_hash(prefix, at, at + GRAM)
        chosen = leftmost_minima(gram, WINDOW - GRAM + 1)
        size = np.diff(o)
        doc = np.repeat(np.arange(len(size)), size)[:n]
        good = np.flatnonzero(np.arange(n) + WINDOW <= o[1:][doc])  # windows within one text
        if not len(good):
            continue
        c, d = chosen[good], doc[good]
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        last = np.r_[new[1:], len(good)] - 1
        start, end, c, d = good[new], good[last] + WINDOW, c[new], d[new]
        base = o[:-1][d]
        out.append((d + first, c - base + skip, start - base + skip, end - base + skip, gram[c], span_hash(prefix, start, end)))
    if not out:
        return tuple(np.zeros(0, t) for t in (int, int, int, int, U64, U64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchor_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            doc, at, start, end, h, seg = anchors(*utf8(part.column("text")))
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(h.astype(np.int64)), "seg": pa.array(seg.astype(np.int64)), "rid": part.column("rid").take(pa.array(doc)),
                "at": pa.array(at, pa.int64()), "left": pa.array((at - start).astype(np.int32)), "right": pa.array((end - at).astype(np.int32))})


def _contexts(batches):
    """Bytes before (reversed) and from each wanted anchor on."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("h", "seg", "before", "after")}
        for text, want in zip(batch.column("text"), batch.column("want")):
            raw = (text.as_py() or "").encode() if want.is_valid else b""
            for w in want.as_py() or ():
                out["h"].append(w["h"])
                out["seg"].append(w["seg"])
                out["before"].append(raw[w["at"] - w["left"]:w["at"]][::-1])
                out["after"].append(raw[w["at"]:w["at"] + w["right"]])
        yield pa.RecordBatch.from_pydict({"h": pa.array(out["h"], pa.int64()), "seg": pa.array(out["seg"], pa.int64()),
                                          "before": pa.array(out["before"], pa.binary()), "after": pa.array(out["after"], pa.binary())})


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], n: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(depth, first, last, where its children begin) of each inner interval of the tree, by a stack scan; ``lcp[i]`` is of i - 1 and i."""
    stack = [(0, 0, [0])]
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else -1
        begin = i - 1
        while stack and depth < stack[-1][0]:
            d, begin, cuts = stack.pop()
            yield d, begin, i - 1, cuts
            if stack and depth <= stack[-1][0]:
                stack[-1][2].append(begin) if begin != stack[-1][2][-1] else None
        if i < n and (not stack or depth > stack[-1][0]):
            stack.append((depth, begin, [begin]))
        if i < n:
            stack[-1][2].append(i)
        if i == n and stack:
            d, begin, cuts = stack.pop()
            yield d, begin, n - 1, cuts


def maximal_repeats(before: list[bytes], after: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(bytes shared before, bytes shared after, [(member, bytes before that it shares with some other member)]) of each group.

    Members are numbers of the given contexts, which share a gram and are pairwise distinct."""
    n = len(after)
    order = sorted(range(n), key=lambda i: after[i])
    lcp = [0, *(common_prefix(after[a], after[b]) for a, b in zip(order, order[1:]))]
    for depth, first, last, cuts in intervals(lcp, n):
        if first == last or depth == 0:
            continue
        need = window - depth
        starts = sorted(set(cuts))
        child, k = {}, 0
        for place in range(first, last + 1):
            while k + 1 < len(starts) and starts[k + 1] <= place:
                k += 1
            child[order[place]] = k
        members = sorted(child, key=lambda i: before[i])
        shared = [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:])]
        run = 0
        for j in range(1, len(members) + 1):
            if j < len(members) and shared[j - 1] >= need:
                continue
            if j - run > 1 and len({child[m] for m in members[run:j]}) > 1:  # not the same group as in a deeper interval
                reach = [max(shared[i - 1] if i > run else 0, shared[i] if i + 1 < j else 0) for i in range(run, j)]
                yield min(shared[run:j - 1]), depth, list(zip(members[run:j], reach))
            run = j


def _grouped(batches) -> Iterator[dict[str, list]]:
    """Rows of one gram at a time, from batches sorted by gram."""
    held: dict[str, list] | None = None
    for batch in batches:
        rows = batch.to_pydict()
        h, lo = rows["h"], 0
        for i in range(1, len(h) + 1):
            if i < len(h) and h[i] == h[lo]:
                continue
            part = {k: v[lo:i] for k, v in rows.items()}
            if held is not None and held["h"][0] == part["h"][0]:
                for k in held:
                    held[k] += part[k]
            else:
                if held is not None:
                    yield held
                held = part
            lo = i
    if held is not None:
        yield held


def _tree(batches):
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_pydict({k: pa.array(c, t) for k, c, t in zip(("h", "seg", "left", "right", "repeat"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))})

    for g in _grouped(batches):
        for before, after, members in maximal_repeats(g["before"], g["after"]):
            name = int.from_bytes(hashlib.blake2b(g["before"][members[0][0]][:before][::-1] + g["after"][members[0][0]][:after], digest_size=8).digest(), "big", signed=True)
            out += [(g["h"][0], g["seg"][m], reach, after, name) for m, reach in members]
        if len(out) > 50_000:
            yield flush()
    yield flush()


def _window_rows(batches):
    """A row per window of a segment: for grams with too many distinct segments to be gathered."""
    for batch in batches:
        for h, seg, before, after in zip(*(batch.column(k).to_pylist() for k in ("h", "seg", "before", "after"))):
            raw = np.frombuffer(before[::-1] + after, np.uint8)
            start = np.arange(len(raw) - WINDOW + 1)
            hashes = span_hash(prefix_hash(raw), start, start + WINDOW).astype(np.int64)
            n = len(start)
            yield pa.RecordBatch.from_pydict({"h": pa.array([h] * n, pa.int64()), "seg": pa.array([seg] * n, pa.int64()),
                                              "left": pa.array((len(before) - start).astype(np.int32)), "window": pa.array(hashes)})


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors whose gram repeats, and for each segment (g, s) the repeats that its anchors lie in: bytes before (l) and from the anchor on (r)."""
    setup(docs.sparkSession)
    texts = keyed(docs)
    rows = texts.select("rid", "text").mapInArrow(_anchor_rows, "h long, seg long, rid long, at long, left int, right int")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select(F.col("h").bitwiseXOR(F.lit(0).cast("long")).alias("g"))  # a value anew, so both sides are shuffled for the join and a hot gram is split
    live = rows.join(often, F.col("h") == F.col("g")).drop("g").checkpoint()
    segs = live.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at", "left", "right")).alias("one")).checkpoint()
    same = segs.where("n > 1").select("h", "seg", F.col("one.left").alias("left"), F.col("one.right").alias("right"), F.xxhash64("h", "seg").alias("repeat"))
    many = segs.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("h").alias("g"), "m")
    want = segs.join(many, F.col("h") == F.col("g")).groupBy("one.rid").agg(
        F.collect_list(F.struct("h", "seg", "one.at", "one.left", "one.right")).alias("want"))
    # a left join that keeps all texts, so that its exchange of texts is the one that the result's join uses
    found = texts.join(want, "rid", "left").select("text", "want").mapInArrow(_contexts, "h long, seg long, before binary, after binary").checkpoint()
    sized = found.join(many, F.col("h") == F.col("g"))
    tree = sized.where(F.col("m") <= GROUP).select("h", "seg", "before", "after").repartition("h").sortWithinPartitions("h") \
        .mapInArrow(_tree, "h long, seg long, left int, right int, repeat long")
    wide = sized.where(F.col("m") > GROUP).select("h", "seg", "before", "after").mapInArrow(_window_rows, "h long, seg long, left int, window long").checkpoint()
    twice = wide.groupBy("h", "left", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("g"), F.col("left").alias("l"), F.col("window").alias("w"))
    apart = wide.join(twice, (F.col("h") == F.col("g")) & (F.col("left") == F.col("l")) & (F.col("window") == F.col("w"))) \
        .select("h", "seg", "left", (WINDOW - F.col("left")).cast("int").alias("right"), F.col("window").alias("repeat"))
    return live, same.union(tree).union(apart).select(F.col("h").alias("g"), F.col("seg").alias("s"), F.col("left").alias("l"), F.col("right").alias("r"), "repeat")


def _placed(live: DataFrame, hits: DataFrame, *more: str) -> DataFrame:
    return live.join(hits, (F.col("h") == F.col("g")) & (F.col("seg") == F.col("s"))) \
        .select("rid", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"), *more)


def repeats(docs: DataFrame) -> DataFrame:
    """Every occurrence of every repeat of at least ``WINDOW`` bytes: rid, start, end (bytes) and the repeat's number."""
    return _placed(*_found(docs), "repeat")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The bytes that ``repeats`` covers, with one row per anchor: rid, start, end. All repeats of an anchor hold its place, so
    together they cover what the longest reach to either side covers, and rows don't follow the repeats of a passage."""
    live, hits = _found(docs)
    widest = hits.groupBy("g", "s").agg(F.max("l").alias("l"), F.max("r").alias("r")) \
        .withColumn("g", F.col("g").bitwiseXOR(F.lit(0).cast("long")))  # as in ``_found``: both sides are shuffled, so a hot segment is split
    return _placed(live, widest)


def removed_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    if not spans:
        return np.zeros(n, bool)
    return covered(n, np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))


def _report(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode()
            gone = removed_mask(len(raw), spans)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def _with_spans(docs: DataFrame, *cols) -> DataFrame:
    spans = repeated_runs(docs).groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("rid", "r")
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), *cols).join(spans, F.col("rid") == F.col("r"), "left")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, "doc_id", "text").select("doc_id", "text", "spans") \
        .mapInArrow(_report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            if spans:
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = removed_mask(len(raw), spans)
                # a code point goes only if all its bytes go
                head = np.flatnonzero((raw & 0xC0) != 0x80)
                size = np.diff(np.append(head, len(raw)))
                text = raw[np.repeat(~np.logical_and.reduceat(gone, head), size)].tobytes().decode()
            out.append(text)
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "text": pa.array(out, pa.string())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without its repeated passages; all rows and columns stay."""
    held = _with_spans(docs, F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text").select("row", "text", "spans")
    schema = f"row {held.schema['row'].dataType.simpleString()}, text string"
    cut = held.mapInArrow(_cut, schema)
    return cut.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
