"""Operator 8: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (a shorter text is one shingle of all its words), weighted by
term frequency times inverse document frequency. Copies of one text must not make it common, so a
first pass with flat weights finds classes, and documents are counted by one text of each class.
Every shingle of every text gets its document frequency df: the texts are cut into slices, and the
shingles of each slice are dealt by hash to parts of about ``PART`` text bytes. A part counts its
shingles, and those of df 2 or more go back to the texts that hold them. A shingle weighs
log(n / df) / log(n), n being the number of classes (at least ``FLOOR``), so one of df 1 or less (it stands
in no class's counted text) weighs 1. Only texts that hold a shingle of df 2 or more are sampled
again with these weights; the others, and the classes without such texts, stay as they are.

Identical word sequences are one node. Each node draws ``BANDS * ROWS`` weighted samples, banded
into buckets. In a bucket all nodes are held against one hub, the node that shares most buckets with
most others; verified pairs (weighted Jaccard of
at least ``LEVEL`` on whole sets) join components. Buckets that still hold several components go
on in blocks of at most two chunks of about ``CHUNK`` nodes or ``CHUNK_BYTES`` bytes of sets. A block holds the
whole sets of its nodes, and its task settles it: all pairs that lie in different components are held against
an upper bound of their similarity (weights summed in ``GROUPS`` groups of shingles, which can only overstate
what two sets share), those that may reach ``LEVEL`` are verified, of each two components the likeliest first (see
``PAIRS``), and join components at once. A block gives links only, fewer than it has nodes, so no
rows are made per pair. Nodes that share several buckets are held against each other in the first of them. So no link
is lost within buckets, and nodes that a chain of links joins already aren't paired.

Defined results: every row gets a row; class_id is the smallest doc_id of the component; texts
without words (null, empty) are no duplicates of anything and keep their own doc_id; repeated rows
fall into one class; very long texts are taken whole; rows with a null doc_id are classed by their text (null if alone); an empty
table gives no rows; other columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rfmspark.llm.common import U64, mix, prefix_hash, releasing, setup, slices, span_hash, utf8, words

WIDTH = 5
LEVEL = 0.8
BANDS, ROWS = 16, 4
#: Least weight of a shingle, and the base of the logarithms that ``common_shingles`` gives is 1 / COMMON.
FLOOR, COMMON = 1e-3, 0.05
#: Text bytes whose shingles make one part of the document frequencies (about a fourth as many shingles).
PART = 1 << 22
#: Pairs that a block tries first of each two components, and of each component beyond its partners'; then it tries all that are left, row by row.
PAIRS = 4
#: Nodes, and bytes of their sets, of a chunk.
CHUNK, CHUNK_BYTES = 4096, 1 << 25
#: Groups of shingles in a sketch, and its units in a weight of 1.
GROUPS, UNITS = 256, 4
#: Text bytes that are signed at once: their numbers stay in a core's cache.
SIGNED_BYTES = 1 << 18
DRAW_BITS = 18


def occurrences(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every shingle of the words ``h``, as they stand; ``at`` is where each text's words begin."""
    n = np.diff(at)
    size = np.minimum(n, WIDTH)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    out = np.zeros(len(place), U64)
    if len(place) and (size[n > 0] == WIDTH).all():
        for i in range(WIDTH):
            out *= U64(0x9FB21C651E98DF25)
            out += h[place + i]
        return doc, mix(out + U64(WIDTH))
    width = size[doc]
    for i in range(WIDTH):
        here = i < width
        out = np.where(here, out * U64(0x9FB21C651E98DF25) + h[np.minimum(place + i, max(len(h) - 1, 0))], out) if len(h) else out
    return doc, mix(out + width.astype(U64))


def raw_shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every shingle, repeated ones too."""
    start, end, at = words(buf, offs)
    return occurrences(span_hash(prefix_hash(buf), start, end), at)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, term frequency) of each distinct shingle of each text."""
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(doc) and doc[-1] < 65536 else doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, term frequency) of each distinct shingle of each text."""
    return counted(*raw_shingles(buf, offs))


def keyed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the word at which each text begins (with the end), and two hashes of each text's word sequence."""
    start, end, at = words(buf, offs)
    n = np.diff(at)
    place = (np.arange(len(start)) - np.repeat(at[:-1], n)).astype(U64)
    keys, hashes = [], []
    for seed in (0, 1):
        h = span_hash(prefix_hash(buf, seed), start, end, seed)
        # position-weighted sum per text: a hash of the whole sequence
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h + mix(place + U64(seed + 1))), out=total[1:])
        keys.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(U64)))
        hashes.append(h)
    return hashes[0], at, keys[0], keys[1]


def among(h: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each shingle is in the sorted, not empty ``wanted``, and its place there."""
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    return wanted[at] == h, at


def _deal(parts: int):
    """Shingles of each slice of texts (batch, its first rid) by part, those of counted texts (``ones`` of them) first: the
    place of the text in the slice, and 48 bits of the shingle beside those that make its part. Part 0 names the texts."""
    def fn(batches):
        for batch in batches:
            for piece in (p.slice(i, 1 << 16) for p in slices(batch, "text") for i in range(0, p.num_rows, 1 << 16)):
                doc, h, _ = shingles(*utf8(piece.column("text")))
                other = ~piece.column("one").to_numpy(zero_copy_only=False).astype(bool)[doc]
                part = (h & U64(parts - 1)).astype(np.uint16)
                order = np.argsort(other, kind="stable")
                order = order[np.argsort(part[order], kind="stable")]
                key = h[order] >> U64(16)
                blobs = {"doc": doc[order].astype("<u2"), "high": (key >> U64(16)).astype("<u4"), "low": (key & U64(0xFFFF)).astype("<u2")}
                ones = np.bincount(part[~other], minlength=parts).tolist()
                ends = np.append(0, np.cumsum(np.bincount(part, minlength=parts))).tolist()
                held = [p for p in range(parts) if p == 0 or ends[p + 1] > ends[p]]
                rids = piece.column("rid").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(held, pa.int32()), "batch": pa.array([int(rids[0])] * len(held), pa.int64()),
                    "rids": pa.array([None if p else rids.tobytes() for p in held], pa.binary()), "ones": pa.array([ones[p] for p in held], pa.int64()),
                    **{c: pa.array([v[ends[p]:ends[p + 1]].tobytes() for p in held], pa.binary()) for c, v in blobs.items()}})
    return fn


def _joined_bytes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count(rows: pa.Table) -> pa.Table:
    """Shingles of one part that stand in two or more counted texts: for each slice the place of the text in it, the 48 bits and df."""
    key = _joined_bytes(rows.column("high"), "<u4").astype(U64) << U64(16) | _joined_bytes(rows.column("low"), "<u2").astype(U64)
    doc = _joined_bytes(rows.column("doc"), "<u2")
    n = np.array([len(x) // 2 for x in rows.column("doc").to_pylist()])
    place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
    _, same = np.unique(key, return_inverse=True)
    df = np.bincount(same, place < np.repeat(rows.column("ones").to_numpy(), n)).astype("<u4")[same] if len(key) else np.zeros(0, "<u4")
    hit = np.flatnonzero(df > 1)
    at = np.searchsorted(hit, np.append(0, np.cumsum(n))).tolist()
    found = {"doc": doc[hit], "keys": key[hit], "df": df[hit]}
    out = pa.table({"batch": rows.column("batch"), "rids": rows.column("rids"),
                    **{c: pa.array([v[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()) for c, v in found.items()}})
    return out.filter(pa.array([a < b or r is not None for a, b, r in zip(at[:-1], at[1:], rows.column("rids").to_pylist())], pa.bool_()))


def _by_text(rows: pa.Table) -> pa.Table:
    """One slice's shingles of df 2 or more by text, in order; texts without any are left out."""
    rids = np.frombuffer(next(r for r in rows.column("rids").to_pylist() if r is not None), "<i8")
    doc, key, df = _joined_bytes(rows.column("doc"), "<u2"), _joined_bytes(rows.column("keys"), "<u8"), _joined_bytes(rows.column("df"), "<u4")
    order = np.lexsort((key, doc))
    doc, key, df = doc[order], key[order], df[order]
    at = np.searchsorted(doc, np.arange(len(rids) + 1))
    held = np.flatnonzero(np.diff(at)).tolist()
    return pa.table({"node": pa.array(rids[held], pa.int64()), "keys": pa.array([key[at[i]:at[i + 1]].tobytes() for i in held], pa.binary()),
                     "df": pa.array([df[at[i]:at[i + 1]].tobytes() for i in held], pa.binary())})


def _frequencies(texts: DataFrame, nodes: DataFrame, label: DataFrame) -> tuple[int, DataFrame]:
    """Number of classes, and of each node that holds shingles of df 2 or more (node) these shingles (see ``_deal``) and df."""
    marked = nodes.select("node").join(label, "node", "left") \
        .select(F.col("node").alias("rid"), F.coalesce(F.col("label") == F.col("node"), F.lit(True)).alias("one")).checkpoint()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << min(16, max(0, (size - 1) // PART).bit_length())
    chosen = texts.select("rid", "text").join(marked, "rid").dropDuplicates(["rid"])
    dealt = chosen.mapInArrow(_deal(parts), "part int, batch long, rids binary, ones long, doc binary, high binary, low binary")
    found = dealt.groupBy("part").applyInArrow(_count, "batch long, rids binary, doc binary, keys binary, df binary") \
        .groupBy("batch").applyInArrow(_by_text, "node long, keys binary, df binary")
    return marked.where("one").count(), found.checkpoint()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all shingles and their inverse document frequencies, log(n / df) to the base 1 / COMMON. Both are
    collected, so this is for a look at small tables; ``classes`` and ``deduplicate`` keep them in the cluster."""
    setup(docs.sparkSession)
    texts = _keyed(docs)
    signed, nodes, label, _ = _flat(texts)
    n, found = _frequencies(texts, nodes, label)
    once = np.log(n) / np.log(1 / COMMON) if n else 0.0
    sets = texts.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("text", "keys", "df").collect()
    out: dict[int, float] = {}
    for text, keys, df in sets:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, h, _ = shingles(raw, np.array([0, len(raw)]))
        if keys is not None:
            out.update(zip(h.tolist(), (weigh(h >> U64(16), np.ones(len(h)), idf(keys, df, n)) * once).tolist()))
        else:
            out |= {x: once for x in h.tolist() if x not in out}
    got = sorted(out.items())
    return np.array([h for h, _ in got], U64), np.array([w for _, w in got])


def idf(keys: bytes | None, df: bytes | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles of df 2 or more (see ``_deal``) and their weights, in units of a shingle of df 1."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0)
    return np.frombuffer(keys, "<u8"), np.log(n / np.frombuffer(df, "<u4")) / np.log(n)


def weigh(h: np.ndarray, tf: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Term frequencies times inverse document frequencies: ``common`` has sorted shingles and theirs, any other's is 1."""
    w = tf.astype(np.float64)
    keys, weight = common
    if len(keys):
        hit, at = among(h, keys)
        w[hit] *= np.maximum(weight[at[hit]], FLOOR)
    return w


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned 32-bit keys in the order of the given single-precision numbers."""
    b = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(b >> 31, ~b, b | np.uint32(0x80000000))


class Sampler:
    """Consistent weighted samples: the draws (r, ln c, beta) of shingle and sample come from tables of 2^DRAW_BITS entries."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(20_240_601))
        n = 1 << DRAW_BITS
        self.r = rng.gamma(2, 1, n)
        self.ln_c = np.log(rng.gamma(2, 1, n))
        self.beta = rng.random(n)
        self.unit = _ordered(self.ln_c - self.r * (1 - self.beta)).astype(U64) << U64(32)  # weight 1: t is 0
        self.odd = [int(x) | 1 for x in rng.integers(1, 1 << 63, BANDS * ROWS)]

    def draw(self, doc_at: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(samples, texts) keys; ``doc_at`` are the places at which the texts' shingles begin (none is empty)."""
        low = h >> U64(32)
        more, less = np.flatnonzero(w > 1), np.flatnonzero(w < 1)
        owner = np.repeat(np.arange(len(doc_at)), np.diff(np.append(doc_at, len(h)))) if len(less) else None
        out = np.empty((BANDS * ROWS, len(doc_at)), U64)

        def weighted(which, a):
            r, beta = self.r[a], self.beta[a]
            t = np.floor(np.log(w[which]) / r + beta)
            own = low[which] ^ (mix(t.astype(np.int64).astype(U64)) >> U64(32))
            return _ordered(self.ln_c[a] - r * (t - beta + 1)).astype(U64) << U64(32) | own
        at, v = np.empty(len(h), U64), np.empty(len(h), U64)
        places = at.view(np.int64)
        for k, odd in enumerate(self.odd):
            np.multiply(h, U64(odd), out=at)
            np.right_shift(at, U64(64 - DRAW_BITS), out=at)
            np.take(self.unit, places, out=v, mode="clip")  # no place is outside
            np.bitwise_or(v, low, out=v)
            if len(more):
                v[more] = weighted(more, places[more])
            if len(less):
                flat = v[less]
                v[less] = U64(0xFFFFFFFFFFFFFFFF)
            out[k] = np.minimum.reduceat(v, doc_at)
            if len(less):  # a weight under 1 never draws less than a weight of 1 does
                near = less[flat >> U64(32) <= out[k][owner[less]] >> U64(32)]
                np.minimum.at(out[k], owner[near], weighted(near, places[near]))
        return out


def _bands(sampler: Sampler, doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> list[list[int] | None]:
    """Bands of each of ``n`` texts; null without words."""
    bands: list[list[int] | None] = [None] * n
    if len(doc):
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        got = sampler.draw(at, h, w)
        keys = np.zeros((BANDS, len(at)), U64)
        for b in range(BANDS):
            for r in range(ROWS):
                keys[b] = mix(keys[b] * U64(31) + got[b * ROWS + r] + U64(b + 1))
        for d, row in zip(doc[at], keys.T.astype(np.int64).tolist()):
            bands[d] = row
    return bands


def _signer(batches):
    """Bands of every text by flat weights."""
    sampler = Sampler()
    for batch in batches:
        for part in slices(batch, "text", SIGNED_BYTES):
            word, begin, k1, k2 = keyed_words(*utf8(part.column("text")))
            doc, h, tf = counted(*occurrences(word, begin))
            bands = _bands(sampler, doc, h, tf.astype(np.float64), part.num_rows)
            yield pa.RecordBatch.from_pydict({"rid": part.column("rid"), "k1": pa.array(k1.astype(np.int64)), "k2": pa.array(k2.astype(np.int64)),
                                              "bands": pa.array(bands, pa.list_(pa.int64()))})


def _weighed_signer(n: int):
    """Bands of every text by term frequency times inverse document frequency."""
    def fn(batches):
        sampler = Sampler()
        for batch in batches:
            for part in slices(batch, "text", SIGNED_BYTES):
                doc, h, tf = shingles(*utf8(part.column("text")))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                w = np.concatenate([weigh(h[a:b] >> U64(16), tf[a:b], idf(keys, df, n))
                                    for a, b, keys, df in zip(at[:-1], at[1:], part.column("keys").to_pylist(), part.column("df").to_pylist())])
                yield pa.RecordBatch.from_pydict({"rid": part.column("rid"), "bands": pa.array(_bands(sampler, doc, h, w, part.num_rows), pa.list_(pa.int64()))})
    return fn


def _sets(batches):
    """Shingles and their term frequencies."""
    for batch in batches:
        for part in slices(batch, "text", SIGNED_BYTES):
            doc, h, tf = shingles(*utf8(part.column("text")))
            w = tf.astype("<f4")
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            # weights of 1 all over are left out
            ws = [b"" if (w[a:b] == 1).all() else w[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_pydict({"node": part.column("rid"), "h": pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                                              "w": pa.array(ws, pa.binary())})


def _weighed(n: int):
    """Sets of term frequencies as sets of weights."""
    def fn(batches):
        for batch in batches:
            ws = []
            for h, w, keys, df in zip(*(batch.column(c).to_pylist() for c in ("h", "w", "keys", "df"))):
                all_ = np.frombuffer(h, "<u8")
                new = weigh(all_ >> U64(16), np.frombuffer(w, "<f4") if w else np.ones(len(all_)), idf(keys, df, n)).astype("<f4")
                ws.append(b"" if (new == 1).all() else new.tobytes())
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "h": batch.column("h"), "w": pa.array(ws, pa.binary())})
    return fn


def weighted_jaccard(h1: bytes, w1: bytes, h2: bytes, w2: bytes) -> float:
    a, b = np.frombuffer(h1, "<u8"), np.frombuffer(h2, "<u8")
    x = np.frombuffer(w1, "<f4").astype(float) if w1 else np.ones(len(a))
    y = np.frombuffer(w2, "<f4").astype(float) if w2 else np.ones(len(b))
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    shared = np.minimum(x[same], y[at[same]]).sum()
    return float(shared / (x.sum() + y.sum() - shared))


def _sketch(batches):
    """Total weight and weights by group of shingles, rounded up, of each set; no total where a group passes two bytes."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            hs = [np.frombuffer(h, "<u8") for h in part.column("h").to_pylist()]
            ws = [np.frombuffer(w, "<f4") if w else np.ones(len(h), "<f4") for h, w in zip(hs, part.column("w").to_pylist())]
            row = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
            h, w = np.concatenate([np.zeros(0, "<u8"), *hs]), np.concatenate([np.zeros(0), *ws])
            sums = np.bincount(row * GROUPS + (h >> U64(56)).astype(np.int64) % GROUPS, w, len(hs) * GROUPS).reshape(-1, GROUPS)
            units = np.ceil(sums * UNITS - 1e-9)
            total = sums.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"node": part.column("node"), "total": pa.array([None if over else t for t, over in zip(total.tolist(), (units > 65535).any(axis=1))], pa.float64()),
                                              "sketch": pa.array([u.tobytes() for u in np.minimum(units, 65535).astype("<u2")], pa.binary())})


def may_reach(total: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of the share of both weights that the sets ``x`` and ``y`` (places) have in common, over what LEVEL needs: 1 or more may reach it."""
    shared = np.minimum(sketch[x], sketch[y]).sum(axis=1, dtype=np.int64) / UNITS
    need = (total[x] + total[y]) * (LEVEL / (1 + LEVEL))
    return np.where(np.isnan(need), np.inf, (shared + 1e-6) / np.maximum(need, 1e-12))


def _block(node: np.ndarray, label: np.ndarray, total: np.ndarray, sketch: np.ndarray, side: np.ndarray, limit: int):
    """Pairs (places) of a block that may reach LEVEL, the likeliest by ``limit``, and whether there are more.
    Sides: 0 the first chunk, 1 the second; a block of one chunk has side 0 only."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    one = not side.any()
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    more, full = False, 65536
    for at in range(0, len(left), 64):
        rows = left[at:at + 64]
        ok = label[rows][:, None] != label[right][None, :]
        big, small = np.fmax(total[rows][:, None], total[right][None, :]), np.fmin(total[rows][:, None], total[right][None, :])
        known = ~(np.isnan(total[rows])[:, None] | np.isnan(total[right])[None, :])
        ok &= ~(known & (small < big * LEVEL - 1e-6))
        if one:
            ok &= rows[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 65536):
            x, y = rows[i[k:k + 65536]], right[j[k:k + 65536]]
            score = may_reach(total, sketch, x, y)
            hit = score >= 1
            best = [np.concatenate([old, new[hit]]) for old, new in zip(best, (x, y, score))]
            if len(best[0]) > full:  # memory follows what stays
                best, cut = _likeliest(best, label, limit)
                more, full = more | cut, max(full, 2 * len(best[0]))
    best, cut = _likeliest(best, label, limit)
    return best[0], best[1], more | cut


def _rank(key: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Place of each row among the rows of its key, the highest score first."""
    order = np.lexsort((-score, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def _likeliest(best: list[np.ndarray], label: np.ndarray, limit: int) -> tuple[list[np.ndarray], bool]:
    """At most ``limit`` pairs of each two labels, of these the first ``limit`` of either label; whether any was left out."""
    x, y, score = best
    if not len(x):
        return best, False
    _, place = np.unique(label, return_inverse=True)
    a, b = np.minimum(place[x], place[y]), np.maximum(place[x], place[y])
    stay = np.flatnonzero(_rank(a * len(label) + b, score) < limit)
    a, b, s = a[stay], b[stay], score[stay]
    stay = stay[(_rank(a, s) < limit) | (_rank(b, s) < limit)]
    return [v[stay] for v in best], len(stay) < len(x)


class _Sets:
    """The whole sets of a block's nodes, and the components that verified pairs of them make."""

    def __init__(self, h: list[bytes], w: list[bytes], label: np.ndarray):
        self.h, self.w = h, w
        self.at = np.append(0, np.cumsum([len(x) // 8 for x in h]))
        _, self.col = np.unique(np.frombuffer(b"".join(h), "<u8"), return_inverse=True)
        self.weight = np.concatenate([np.frombuffer(x, "<f4") if x else np.ones(len(y) // 8, "<f4") for x, y in zip(w, h)]).astype(float)
        self.total = np.add.reduceat(np.append(self.weight, 0.0), self.at[:-1])
        self.row = np.zeros(self.col.max(initial=-1) + 1)
        _, self.part = np.unique(label, return_inverse=True)

    def reach(self, x: int, y: np.ndarray) -> np.ndarray:
        """Whether the set ``x`` and each of the sets ``y`` are alike by LEVEL (as ``weighted_jaccard`` says)."""
        own = slice(self.at[x], self.at[x + 1])
        self.row[self.col[own]] = self.weight[own]
        size = self.at[y + 1] - self.at[y]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(self.at[y] - begin, size)
        shared = np.add.reduceat(np.minimum(self.row[self.col[place]], self.weight[place]), begin)
        self.row[self.col[own]] = 0
        like = shared / (self.total[x] + self.total[y] - shared)
        ok = like >= LEVEL
        for i in np.flatnonzero(np.abs(like - LEVEL) < 1e-9).tolist():  # sums differ in their last digits
            ok[i] = weighted_jaccard(self.h[x], self.w[x], self.h[y[i]], self.w[y[i]]) >= LEVEL
        return ok

    def link(self, x: int, y: np.ndarray) -> list[tuple[int, int]]:
        """Verified pairs of ``x`` with ``y``, one for each component that it joins; after each step those that are joined by then are left out."""
        out, step = [], 16
        while len(y):
            now, y = y[:step], y[step:]
            for z in now[self.reach(x, now)].tolist():
                if self.part[z] != self.part[x]:
                    out.append((x, z))
                    self.part[self.part == self.part[z]] = self.part[x]
            y, step = y[self.part[y] != self.part[x]], min(4096, 4 * step)
        return out


def _settle(sets: _Sets, bands: np.ndarray, bucket: int, total: np.ndarray, sketch: np.ndarray, side: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Verified pairs (places) that join all components of a block that links between its sides join (of a block of one chunk, all links).
    Pairs that share an earlier band are left to its bucket."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    one = not side.any()
    x, y, more = _block(np.arange(len(total)), sets.part.copy(), total, sketch, side, limit)
    out = []
    for i in np.unique(x).tolist():
        out += sets.link(i, y[x == i])
    if not more:
        return out
    band = (bands == bucket).argmax(axis=1)
    for n, i in enumerate(left.tolist()):
        j = right[n + 1:] if one else right
        j = j[sets.part[j] != sets.part[i]]
        j = j[~((total[j] < total[i] * LEVEL - 1e-6) | (total[i] < total[j] * LEVEL - 1e-6))]  # kept where a total is missing
        j = j[~(bands[j, :band[i]] == bands[i, :band[i]]).any(axis=1)]
        score = np.concatenate([np.zeros(0), *(may_reach(total, sketch, np.full(len(k), i), k) for k in (j[m:m + 4096] for m in range(0, len(j), 4096)))])
        j, score = j[score >= 1], score[score >= 1]
        out += sets.link(i, j[np.argsort(-score, kind="stable")])
    return out


def _near(limit: int):
    """Of each block (its rows stand together) the pairs to verify; one more row, without nodes, tells that a block has more.
    Rows that hold their sets are verified here: of such a block the links that join its components."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        node, label = (rows.column(c).to_numpy() for c in ("node", "label"))
        bucket, whole = rows.column("bucket")[0].as_py(), "h" in rows.column_names
        drawn = pa.Table.from_batches(list(_sketch(rows.to_batches()))) if whole else rows
        total = drawn.column("total").to_numpy().astype(float)
        sketch = np.frombuffer(b"".join(drawn.column("sketch").to_pylist()), "<u2").reshape(-1, GROUPS)
        side, more = rows.column("side").to_numpy(), False
        if whole:
            bands = rows.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            sets = _Sets(rows.column("h").to_pylist(), rows.column("w").to_pylist(), label)
            x, y = np.array(_settle(sets, bands, bucket, total, sketch, side, limit), np.int64).reshape(-1, 2).T
        else:
            x, y, more = _block(node, label, total, sketch, side, limit)
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        tail = [None] if more else []
        out = {c: pa.array([*v.tolist(), *tail], pa.int64()) for c, v in (("src", node[x]), ("dst", node[y]), ("a", label[x]), ("b", label[y]))}
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * len(out["src"]), pa.int64()), **out})

    def fn(batches):
        held = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and batch.num_rows:
                last = held[-1]
                if any(last.column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("bucket", "i", "j")):
                    yield solve(pa.Table.from_batches(held))
                    held = []
            at = 0
            for end in ends.tolist():
                yield solve(pa.Table.from_batches([*held, batch.slice(at, end - at)]))
                held, at = [], end
            if batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield solve(pa.Table.from_batches(held))
    return fn


def _verify(batches):
    for batch in batches:
        rows = batch.select(["h1", "w1", "h2", "w2"]).to_pydict()
        ok = [weighted_jaccard(*x) >= LEVEL for x in zip(rows["h1"], rows["w1"], rows["h2"], rows["w2"])]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of labels that verified pairs of nodes (src, dst, labels a, b) join."""
    full = pairs.join(sets.select(F.col("node").alias("src"), F.col("h").alias("h1"), F.col("w").alias("w1")), "src") \
        .join(sets.select(F.col("node").alias("dst"), F.col("h").alias("h2"), F.col("w").alias("w2")), "dst")
    good = full.select("a", "b", "h1", "w1", "h2", "w2").mapInArrow(_verify, "a long, b long")
    return good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()


def _closure(links: DataFrame) -> DataFrame:
    """old and new (the smallest of its component) of every label in ``links``.

    Each round every label takes its least neighbour's pointer, or itself if it is less; then the links are drawn anew between
    these. Of two linked labels the greater one always merges, so what is left shrinks fast, and a star, the usual component,
    is done in one round. A giant star's centre is one row on the right side of a join, however many rows point to it."""
    done = None
    while True:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")) \
            .select("a", F.least("a", "b").alias("p"))
        step = near.join(near.select(F.col("a").alias("p"), F.col("p").alias("top")), "p").select(F.col("a").alias("old"), F.col("top").alias("new")).checkpoint()
        done = step if done is None else done.join(step.select(F.col("old").alias("new"), F.col("new").alias("top")), "new", "left") \
            .select("old", F.coalesce("top", "new").alias("new"))
        links = links.join(step.select(F.col("old").alias("a"), F.col("new").alias("x")), "a").join(step.select(F.col("old").alias("b"), F.col("new").alias("y")), "b") \
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
        if links.isEmpty():
            return done


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, label) after ``links`` between labels: components of the labels, a graph that shrinks with each round."""
    if links.isEmpty():
        return label
    return label.join(_closure(links), F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")).checkpoint()


def _keyed(docs: DataFrame) -> DataFrame:
    """rid (row key), doc_id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """node, h and w of the rows ``ids`` (node)."""
    return texts.select("rid", "text").join(ids.select(F.col("node").alias("rid")), "rid", "left_semi").dropDuplicates(["rid"]).mapInArrow(_sets, "node long, h binary, w binary")


def _shared(nodes: DataFrame) -> DataFrame:
    """bucket, node, score and hub of all buckets with several nodes."""
    cells = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("top"), F.count(F.lit(1)).alias("size")) \
        .where("least < top").select(F.col("bucket").alias("b"), "size")
    held = cells.join(shared, F.col("bucket") == F.col("b")).select("bucket", "node", "size").checkpoint()
    # the node that shares most buckets with most others is nearest to all of a group: the text that the copies come from
    score = held.groupBy("node").agg(F.sum("size").alias("score")).withColumnRenamed("node", "s")
    scored = held.join(score, F.col("node") == F.col("s")).select("bucket", "node", "score")
    hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("one")).select(F.col("bucket").alias("b"), F.col("one.node").alias("hub"))
    return scored.join(hubs, F.col("bucket") == F.col("b")).select("bucket", "node", "score", "hub").checkpoint()


def _components(active: DataFrame, sets: DataFrame, label: DataFrame, alone: bool, nodes: DataFrame) -> DataFrame:
    """``label`` after all links in the buckets; ``alone``: every node is its own label still; ``nodes`` has the bands."""
    pairs = active.where("node != hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")).distinct()
    if alone:
        pairs = pairs.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    else:
        a, b = (label.select(F.col("node").alias(node), F.col("label").alias(tag)) for node, tag in (("src", "a"), ("dst", "b")))
        pairs = pairs.join(a, "src").join(b, "dst").where("a != b").select("src", "dst", "a", "b")
    label = _joined(label, _links(pairs, sets))
    # the hub met everyone in its bucket
    tagged = active.where("node != hub").select("bucket", "node").join(label, "node") \
        .join(sets.select("node", (F.octet_length("h") + F.octet_length("w")).alias("bytes")), "node").select("bucket", "node", "label", "bytes")
    per = tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("label").alias("least"), F.max("label").alias("top")) \
        .where("least < top").select(F.col("bucket").alias("b"), F.ceil(F.greatest(F.col("n") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    still = tagged.drop("bytes").join(per, F.col("bucket") == F.col("b")).drop("b").checkpoint()
    if still.isEmpty():
        return label
    own = sets.join(still.select("node").distinct(), "node", "left_semi").join(nodes.select("node", "bands"), "node")
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    dealt = still.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = dealt.join(own, "node").select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                                            (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", "label", "h", "w", "bands")
    found = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j") \
        .mapInArrow(_near(PAIRS), "bucket long, src long, dst long, a long, b long")
    return _joined(label, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint())


def _flat(texts: DataFrame) -> tuple[DataFrame, ...]:
    """By flat weights: signed rows, nodes (one row of each word sequence), labels of the nodes in shared buckets, and their sets."""
    signed = texts.select("rid", "text").mapInArrow(_signer, "rid long, k1 long, k2 long, bands array<long>").checkpoint()
    nodes = signed.where("bands is not null").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.first("bands").alias("bands")).checkpoint()
    active = _shared(nodes)
    ids = active.select("node").distinct()
    sets = _texts_of(texts, ids).checkpoint()
    return signed, nodes, _components(active, sets, sets.select("node", F.col("node").alias("label")), True, nodes), sets


def _labels(docs: DataFrame) -> DataFrame:
    """rid, doc_id and label (null without words) of every row."""
    setup(docs.sparkSession)
    texts = _keyed(docs)
    signed, nodes, label, sets = _flat(texts)
    n, found = _frequencies(texts, nodes, label)
    if n > 1 and not found.isEmpty():  # else all weights are the same
        again = texts.select("rid", "text").join(found.withColumnRenamed("node", "rid"), "rid") \
            .mapInArrow(_weighed_signer(n), "rid long, bands array<long>").groupBy("rid").agg(F.first("bands").alias("new"))
        both = nodes.join(again.withColumnRenamed("rid", "node"), "node", "left") \
            .select("k1", "k2", "node", F.coalesce("new", "bands").alias("bands"), F.col("new").isNotNull().alias("changed")).checkpoint()
        active = _shared(both)
        ids = active.select("node").distinct().checkpoint()
        more = _texts_of(texts, ids.join(sets.select("node"), "node", "left_anti"))
        weighed = sets.join(ids, "node", "left_semi").union(more).join(found, "node", "left") \
            .mapInArrow(_weighed(n), "node long, h binary, w binary").checkpoint()
        # classes without shingles of df 2 or more hold as they are, the others begin anew
        touched = label.join(both.where("changed").select("node"), "node", "left_semi").select("label").distinct()
        begin = ids.join(label.join(touched, "label", "left_anti"), "node", "left").select("node", F.coalesce("label", "node").alias("label")).checkpoint()
        label = _components(active, weighed, begin, False, both)
    named = nodes.join(label, "node", "left").select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.coalesce("label", "node").alias("label"))
    own = signed.select("rid", "k1", "k2", F.col("bands").isNotNull().alias("worded")) \
        .join(named, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")) & F.col("worded"), "left").select(F.col("rid").alias("r"), "label").distinct()
    return texts.select("rid", "doc_id").join(own, F.col("rid") == F.col("r"), "left").select("rid", "doc_id", "label")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    with releasing(docs.sparkSession):
        rows = _labels(docs).checkpoint()
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")).withColumnRenamed("label", "l")
    return rows.join(least, F.col("label") == F.col("l"), "left").select("doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the smallest doc_id (null last), once. Rows are told apart by rid; rows without words all stay."""
    with releasing(docs.sparkSession):
        rows = _labels(docs).checkpoint()
    worded = rows.where("label is not null")
    best = worded.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best")).select(F.col("label").alias("l"), F.col("best.rid").alias("stays"))
    gone = worded.join(best, F.col("label") == F.col("l")).where("rid != stays").select(F.col("rid").alias("_gone")).distinct()
    # rows without words are no copies: each has a number of its own
    own = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    left = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("rid"), own.alias("own"))
    return left.join(gone, F.col("rid") == F.col("_gone"), "left_anti").dropDuplicates(["rid", "own"]).select("row.*")
