"""Operator 13: alignment of two tokenizers by a galloping intersection of their token ends.

Every text is encoded whole by both tokenizers; a token becomes the byte offset at which it ends in
space + text. Per document the shorter end list drives an exponential-plus-binary search into the
longer one: from where the last end was found, doubling steps pass the next, then a binary search
between the last two steps finds it. Lanes of ``LANE`` successive ends run side by side as array
operations, each from its own finger. Ends found in both lists cut the document into groups; the
ranks found for two successive ends are the range of tokens that overlap the token between them.

Corpus counts (in how many documents an id pair is linked) are pre-aggregated per task. They reach
the documents in two ways at once: of R distinct (document, pair) rows, the pairs that stand in at
least R / ``HOT_PAIRS`` documents are, by that rule, at most ``HOT_PAIRS``; these are broadcast and
looked up in place. The rarer ones are joined by pair, where no key has more rows than that share.
Documents pass through one written table (spark.checkpoint.dir), texts are read and encoded once.

Defined results: a null or empty text, and one whose joined token bytes of either tokenizer are not
those of space + text, has no tokens: zeros, empty groups; very long texts are aligned whole;
repeated rows and rows that share a doc_id (null included) each have a result and count as documents
of their own; ties for an id's highest count all are best; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.byte_level import byte_level
from rfmspark.llm.common import setup, slices

#: Successive ends that one lane searches from its own finger.
LANE = 64
#: Bound of the broadcast pairs.
HOT_PAIRS = 1 << 20
#: Pairs that a task counts before it passes their counts on.
HELD_PAIRS = 1 << 21
#: Words whose ids a worker keeps from one slice to the next; a full store is emptied, nothing else changes.
STORE_WORDS = 400_000
OTHER = 0xFFFFFFFF
SHIFT = 32


class PieceModel:
    """Sentence-piece vocabulary: an encoder, and each id's bytes in space + text.

    No piece holds a blank after another character (checked), so no merge crosses the place where blanks follow a word:
    texts are cut there and every distinct word with the blanks before it is encoded once, as long as the store holds it."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        crossing = any("▁" in p.lstrip("▁") for p in names)
        self.words = re.compile(" .*" if crossing else " +[^ ]*", re.S)
        self.store: dict[str, bytes] = {}

    def encode(self, wholes: list[str]) -> list[np.ndarray]:
        """Ids of each space + text; ``OTHER`` for a word whose pieces' bytes are not its own."""
        parts = [self.words.findall(w) for w in wholes]
        if len(self.store) > STORE_WORDS:
            self.store.clear()
        self._learn(list(set().union(*parts).difference(self.store)))
        return [np.frombuffer(b"".join(map(self.store.__getitem__, p)), "<u4") for p in parts]

    def _learn(self, words: list[str]) -> None:
        blank = [self.model.piece_to_id("▁")]
        lists = [blank if w == " " else own for w, own in zip(words, self.model.encode([w[1:] for w in words], num_threads=1))]
        if b"".join([self.pieces[i] for own in lists for i in own]) != "".join(words).encode():
            lists = [own if b"".join([self.pieces[i] for i in own]) == w.encode() else [OTHER] for w, own in zip(words, lists)]
        ends = (4 * np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))).tolist()
        raw = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
        self.store.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str | None = None) -> PieceModel:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rank in ``long`` (how many of its values are smaller) of each value of ``short``; both ascend."""
    out, m = np.zeros(len(short), np.int64), len(long)
    reach = np.append(long, np.iinfo(np.int64).max)
    lanes = np.arange(0, len(short), LANE)
    finger = np.searchsorted(long, short[lanes])
    for k in range(min(LANE, len(short))):
        at = lanes[lanes + k < len(short)] + k
        x, lo = short[at], finger[:len(at)]
        hi, jump = lo.copy(), 1
        behind = np.flatnonzero(reach[hi] < x)
        while len(behind):
            lo[behind] = hi[behind] + 1
            hi[behind] = np.minimum(hi[behind] + jump, m)
            behind = behind[reach[hi[behind]] < x[behind]]
            jump *= 2
        between = np.flatnonzero(lo < hi)
        while len(between):
            mid = (lo[between] + hi[between]) >> 1
            less = reach[mid] < x[between]
            lo[between] = np.where(less, mid + 1, lo[between])
            hi[between] = np.where(less, hi[between], mid)
            between = between[lo[between] < hi[between]]
        out[at] = lo
        finger = lo
    return out


def _dealt(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (``size`` of them) for each entry, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


_DIGITS: list[tuple[np.ndarray, np.ndarray]] = []


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Right-aligned decimal digits of 0 to n - 1 (or further), each followed by a comma, and which of them are shown."""
    if not _DIGITS or len(_DIGITS[0][0]) < n:
        numbers = np.arange(max(n, 1 << 16))
        power = 10 ** np.arange(len(str(len(numbers) - 1)) - 1, -1, -1)
        digits = np.full((len(numbers), len(power) + 1), ord(","), np.uint8)
        digits[:, :-1] = numbers[:, None] // power % 10 + ord("0")
        valid = np.ones(digits.shape, bool)
        valid[:, :len(power) - 1] = numbers[:, None] >= power[:-1]
        _DIGITS[:] = [(digits, valid)]
    return _DIGITS[0]


class Alignment:
    """Groups and links of a run of documents, given each one's ids by both tokenizers."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        def flat(arrays):
            n = np.fromiter(map(len, arrays), np.int64, len(arrays))
            return n, np.concatenate([np.zeros(0, np.int64), *arrays], dtype=np.int64)

        self.n_a, self.a = flat(ids_a)
        self.n_b, self.b = flat(ids_b)
        end_a, end_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])  # each document ends at the same place in both
        docs = np.arange(len(ids_a))
        self.doc_a, self.doc_b = np.repeat(docs, self.n_a), np.repeat(docs, self.n_b)
        # the shorter list of each document, and the longer one
        swap = self.n_b < self.n_a
        n_short, n_long = np.where(swap, self.n_b, self.n_a), np.where(swap, self.n_a, self.n_b)
        of_a, of_b = self._places(n_short, n_long, swap, self.n_a), self._places(n_short, n_long, ~swap, self.n_b)
        short, long = np.zeros(n_short.sum(), np.int64), np.zeros(n_long.sum(), np.int64)
        for place, doc, end, other in ((of_a, self.doc_a, end_a, swap), (of_b, self.doc_b, end_b, ~swap)):
            moved = other[doc]
            short[place[~moved]], long[place[moved]] = end[~moved], end[moved]
        rank = gallop(short, long)
        common = long[rank] == short if len(short) else np.zeros(0, bool)
        in_long = np.zeros(len(long), bool)
        in_long[rank[common]] = True
        # a short token overlaps the long ones from the first that ends after the token before it, up to the one over its own end
        first = np.zeros(len(short), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        size = rank - first + 1
        s, l = np.repeat(np.arange(len(short)), size), _dealt(first, size)
        id_short, id_long = np.zeros(len(short), np.int64), np.zeros(len(long), np.int64)
        for place, doc, ids, other in ((of_a, self.doc_a, self.a, swap), (of_b, self.doc_b, self.b, ~swap)):
            moved = other[doc]
            id_short[place[~moved]], id_long[place[moved]] = ids[~moved], ids[moved]
        doc = np.repeat(docs, n_short)
        self.n_groups = np.bincount(doc[common], minlength=len(docs))
        self.n_links = np.bincount(doc, weights=size, minlength=len(docs)).astype(np.int64)
        link_doc = doc[s]
        turned = swap[link_doc]
        self.link_doc = link_doc
        self.link_a, self.link_b = np.where(turned, id_long[l], id_short[s]), np.where(turned, id_short[s], id_long[l])
        # number of the group of every token
        g_short, g_long = np.cumsum(common) - common, np.cumsum(in_long) - in_long
        self.group_a = np.where(swap[self.doc_a], g_long[np.minimum(of_a, len(long) - 1)], g_short[np.minimum(of_a, len(short) - 1)]) if len(self.a) else of_a
        self.group_b = np.where(swap[self.doc_b], g_short[np.minimum(of_b, len(short) - 1)], g_long[np.minimum(of_b, len(long) - 1)]) if len(self.b) else of_b

    @staticmethod
    def _places(n_short, n_long, moved, n):
        """Place of every token in the joined list (short or long) that its document's list belongs to."""
        return _dealt(np.where(moved, np.cumsum(n_long) - n_long, np.cumsum(n_short) - n_short), n)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;a3|b2`` of all documents, and where each document begins (with the end)."""
        n_groups = int(self.n_groups.sum())
        in_a, in_b = (np.bincount(g, minlength=n_groups) for g in (self.group_a, self.group_b))
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        ids = np.zeros(len(self.a) + len(self.b), np.int64)
        ids[np.arange(len(self.a)) + np.repeat(end_b - in_b, in_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(end_a, in_b)] = self.b
        digits, valid = _decimals(int(ids.max(initial=0)) + 1)
        cells, shown = digits[ids], valid[ids]
        cells[end_a + end_b - in_b - 1, -1] = ord("|")
        cells[end_a + end_b - 1, -1] = ord(";")
        last = np.cumsum(self.n_a + self.n_b) - 1  # of each document; no separator follows
        shown[last[self.n_a > 0], -1] = False
        size = np.r_[0, np.cumsum(valid.sum(1)[ids])][last + 1] - np.cumsum(self.n_a > 0)
        return cells[shown], np.r_[0, size]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each document in order, how often each is linked there, and where each document begins (with the end)."""
        bits = int(self.b.max(initial=0)).bit_length()
        wide = bits + int(self.a.max(initial=0)).bit_length()
        both = np.sort(self.link_doc << wide | self.link_a << bits | self.link_b)
        new = np.flatnonzero(np.diff(both, prepend=-1))
        one = both[new]
        key = (one >> bits & (1 << wide - bits) - 1) << SHIFT | one & (1 << bits) - 1
        return key, np.diff(np.r_[new, len(both)]), np.searchsorted(one >> wide, np.arange(len(self.n_a) + 1))


def _packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending keys and their numbers of links: differences, byte plane by byte plane, compressed."""
    if not len(keys):
        return b""
    planes = [np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T, times.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return len(keys).to_bytes(4, "little") + pa.compress(np.concatenate([p.ravel() for p in planes]).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = int.from_bytes(raw[:4], "little")
    flat = np.frombuffer(pa.decompress(raw[4:], decompressed_size=12 * n, codec="zstd", asbytes=True), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(flat[:8 * n].reshape(8, n).T).view(np.int64).ravel())
    return keys, np.ascontiguousarray(flat[8 * n:].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _aligner(path_a: str | None, path_b: str | None):
    def fn(batches):
        a, b = byte_level(path_a, specials_as_text=True), piece_model(path_b)
        sizes = [np.array([len(p) for p in v.pieces], np.int64) for v in (a, b)]
        for batch in batches:
            for part in slices(batch, "text"):
                kept, ids_a, ids_b = [], [], []
                wholes = [" " + t if t else "" for t in part.column("text").to_pylist()]
                for i, (whole, y) in enumerate(zip(wholes, b.encode(wholes))):
                    if not whole:
                        continue
                    x = np.array(a.encode(whole), np.uint32)
                    # byte-level pieces are the text's own bytes, so their number tells whether all are there
                    if not (y == OTHER).any() and sizes[0][x].sum() == len(whole.encode()):
                        kept.append(i)
                        ids_a.append(x)
                        ids_b.append(y)
                made = Alignment(ids_a, ids_b, *sizes)
                out = {k: np.zeros(part.num_rows, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
                for k, v in out.items():
                    v[kept] = getattr(made, k)
                raw, begin = made.groups()
                ends = np.zeros(part.num_rows + 1, np.int64)
                ends[np.array(kept, np.int64) + 1] = np.diff(begin)
                groups = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(np.cumsum(ends)), pa.py_buffer(raw)).cast(pa.string())
                keys, times, at = made.pairs()
                pairs = [b""] * part.num_rows
                for i, lo, hi in zip(kept, at[:-1], at[1:]):
                    pairs[i] = _packed(keys[lo:hi], times[lo:hi])
                yield pa.RecordBatch.from_pydict({"rid": part.column("rid"), "doc_id": part.column("doc_id"), **{k: pa.array(v) for k, v in out.items()},
                                                  "groups": groups, "pairs": pa.array(pairs, pa.binary())})
    return fn


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """Of every row: rid (a number of its own), doc_id, n_a and n_b (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2``)
    and pairs (its distinct id pairs and how often each is linked, packed)."""
    setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(
        _aligner(tokenizer_a, tokenizer_b),
        f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary")


def _counts(batches):
    """Documents of each id pair, summed within the task."""
    held, size = [], 0

    def total():
        key = np.concatenate([k for k, _ in held])
        key, inverse = np.unique(key, return_inverse=True)
        return key, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(key, n):
        return pa.RecordBatch.from_pydict({"pair": pa.array(key), "n": pa.array(n)})

    for batch in batches:
        for raw in batch.column("pairs").to_pylist():
            key, _ = _unpacked(raw)
            held.append((key, np.ones(len(key), np.int64)))
            size += len(key)
            if size > HELD_PAIRS:
                held = [total()]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield rows(*held.pop())
                    size = 0
    if held:
        yield rows(*total())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (ids of both, the first in the high half), n (documents that link it) and best (no pair of its first id has more)."""
    n = aligned.select("pairs").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = n.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))
    return n.join(most, F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every wanted key among the ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _scorer(shared):
    """Sums over a document's hot pairs; its other pairs and how often each is linked."""
    def fn(batches):
        keys, n, best = shared.value
        for batch in batches:
            rows = {"hot_best": [], "hot_sum": [], "cold": [], "times": []}
            for raw in batch.column("pairs").to_pylist():
                key, times = _unpacked(raw)
                at, there = _found(keys, key)
                rest, at = ~there, at[there]
                rows["cold"].append(key[rest])
                rows["times"].append(times[rest])
                rows["hot_best"].append(int(times[there][best[at]].sum()) if len(at) else 0)
                rows["hot_sum"].append(int((times[there] * n[at]).sum()) if len(at) else 0)
            kept = [k for k in batch.schema.names if k != "pairs"]
            types = {"cold": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(v, types.get(k, pa.int64())) for k, v in rows.items())], names=[*kept, *rows])
    return fn


def score(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` (a written table) without its pairs, with n_best and count_sum by ``counts`` (a written table)."""
    spark = aligned.sparkSession
    rows = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(hot_pairs) >= F.lit(rows)  # at most hot_pairs pairs can have so many documents
    hot = counts.where(often).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(hot.column(k).to_numpy() for k in ("pair", "n", "best")))
    plain = [f for f in aligned.schema if f.name != "pairs"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    docs = aligned.mapInArrow(_scorer(shared), f"{schema}, hot_best long, hot_sum long, cold array<long>, times array<long>").checkpoint()
    cold = docs.select(F.col("rid").alias("row"), F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("pair"), "x.times") \
        .join(counts.where(~often), "pair") \
        .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("cold_best"), F.sum(F.col("times") * F.col("n")).alias("cold_sum"))
    return docs.join(cold, F.col("rid") == F.col("row"), "left").select(
        *(f.name for f in plain), (F.col("hot_best") + F.coalesce("cold_best", F.lit(0))).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0))).alias("count_sum"))


def alignment_report(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align(docs, tokenizer_a, tokenizer_b).select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs").checkpoint()
    counts = pair_counts(aligned).checkpoint()
    return score(aligned, counts, hot_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
