"""Operator 6: generalised additive model with pairwise interactions, scored from lookup tables.

Shallow trees are boosted cyclically, one feature after the other, on quantile bins; their sum is
one lookup table per feature. The strongest pairs, found on the residuals, get two-dimensional
tables in the same way. A score is the logistic of an intercept plus one table cell per feature
and pair, added by vectorised bin look-ups for all documents.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS``, by hash order of doc_id)
outside the held-out fold; features come from the text alone. Every document is scored.

Defined results: null and empty texts have zero features and get the score these give; unlabelled
rows are scored alike; repeated label rows of one document count once (the smaller label); with no
usable label, or labels of one class only, the score is that class's smoothed share; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rfmspark.llm.common import setup, slices, utf8
from rfmspark.llm.textstats import Texts, count_in

FIT_ROWS = 20_000
BINS = 32
ROUNDS, RATE = 120, 0.1
PAIRS, PAIR_ROUNDS = 8, 40
CUT = 0.3
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeat_3", "repeat_1", "capitals", "digits", "stops",
            "commas", "marks", "line_words", "bars", "accents", "long_words", "first_run")


def byte_class(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[np.frombuffer(chars, np.uint8)] = True
    return m


CAPITALS, DIGITS = byte_class(bytes(range(65, 91))), byte_class(b"0123456789")
STOPS, COMMAS, MARKS, BARS = byte_class(b"."), byte_class(b",;:"), byte_class(b"!?@#$%&*=+~^_<>{}[]\\/"), byte_class(b"|")


def features(t: Texts) -> np.ndarray:
    """(texts, features): counts relative to words or code points."""
    n = np.maximum(t.n_words, 1)
    chars = np.maximum(count_in(t.points, t.offs), 1)
    share = lambda table: count_in(table[t.buf], t.offs) / chars
    ls, _, ldoc = t.lines()
    lines = np.maximum(np.bincount(ldoc, minlength=t.n), 1)
    size = t.end - t.start
    same = np.zeros(len(t.hash), bool)
    same[1:] = (t.hash[1:] == t.hash[:-1]) & (t.doc[1:] == t.doc[:-1])
    cols = [np.log1p(t.n_words), t.word_chars() / n, t.n_symbols() / chars, t.n_dup_lines() / lines, t.repeat_words() / n,
            1 - t.n_distinct() / n, share(CAPITALS), share(DIGITS), share(STOPS), share(COMMAS), share(MARKS), t.n_words / lines,
            share(BARS), count_in(t.buf >= 0xC2, t.offs) / chars, t.by_doc(size > 15) / n, t.by_doc(same) / n]
    return np.column_stack(cols).astype(np.float64) if t.n else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """edges: inner bin borders of each feature; tables by feature; pair tables by (feature, feature)."""
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of an ordered histogram (cells before the place against the rest)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps of a tree of ``depth`` over an ordered histogram, spread over its cells."""
    gain, k = _best_cut(g, h)
    if depth == 0 or gain <= 1e-9:
        return np.full(len(g), _step(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Two-level tree over a two-dimensional histogram: a cut of one axis, then of the other on each side."""
    options = []
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, k = _best_cut(a.sum(1), b.sum(1))
        out = np.empty_like(a)
        for rows in (slice(0, k), slice(k, None)):
            ga, ha = a[rows].sum(0), b[rows].sum(0)
            if len(ga):
                gain += max(0.0, _best_cut(ga, ha)[0])
                out[rows] = shallow_tree(ga, ha, 1)
        options.append((gain, out.T if turned else out))
    gain, out = max(options, key=lambda o: o[0])
    return out, gain


def train(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    m = Model(float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return m
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    b, total = m.bins(x), np.full(len(y), m.intercept)

    def grads():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(m.tables):  # cyclic: every feature in turn
            g, h = grads()
            step = RATE * shallow_tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
            table += step
            total += step[b[:, j]]

    def cells(i, j, v):
        return np.bincount(b[:, i] * len(m.tables[j]) + b[:, j], v, len(m.tables[i]) * len(m.tables[j])).reshape(len(m.tables[i]), -1)

    g, h = grads()
    gains = sorted(((pair_tree(cells(i, j, g), cells(i, j, h))[1], -i, -j) for i in range(len(m.tables)) for j in range(i)), reverse=True)
    m.pairs = {(-i, -j): np.zeros((len(m.tables[-i]), len(m.tables[-j]))) for _, i, j in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in m.pairs.items():
            g, h = grads()
            step = RATE * pair_tree(cells(i, j, g), cells(i, j, h))[0]
            table += step
            total += step[b[:, i], b[:, j]]
    return m


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _featurise(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(Texts(*utf8(part.column("text"))))
            yield pa.RecordBatch.from_pydict({"y": part.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Model from at most ``rows`` labelled rows outside the held-out fold."""
    setup(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    sample = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample has at most ``rows`` ids, so it can be broadcast; the texts aren't shuffled
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y").mapInArrow(_featurise, "y int, x array<double>").toPandas()
    if not len(got):
        return Model()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the tables don't depend on the order in which tasks end
    return train(x[order], y[order])


def _scorer(model: Model):
    def fn(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.score(features(Texts(*utf8(part.column("text")))))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(s),
                                                  "predicted": pa.array((s >= CUT).astype(np.int32))})
    return fn


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text") \
        .mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _keeper(model: Model):
    def fn(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.score(features(Texts(*utf8(part.column("text")))))
                yield part.filter(pa.array(s >= CUT))
    return fn


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of good quality, with all their columns."""
    setup(docs.sparkSession)
    return docs.mapInArrow(_keeper(model), docs.schema)
