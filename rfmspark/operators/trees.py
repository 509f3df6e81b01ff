"""Boosted trees and forests whose fits are Spark jobs of a few tasks instead of a few jobs a tree level.

Same models as Spark ML's ``GBTClassifier`` (logistic loss, variance gain, first tree of weight 1) and ``RandomForestClassifier``
(Poisson bootstrap, gini gain, the square root of the features at each node), on ``BINS`` bins a feature whose bounds come from all
rows: quantiles, or the middles between the values of a feature with few. The binned rows are packed and written once; the tasks of a
fit hold a share of them each, and add up their counts per node, feature and bin at every level (barrier tasks). Residuals are rounded
to 2^-18, so these sums are exact and the trees don't depend on how the rows are dealt.
"""

from __future__ import annotations

import base64
import math
from functools import partial

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmspark.operators.model_store import _Stored

BINS = 32
TASK_ROWS = 1 << 23  # rows that one task of a fit holds at most, as long as there are cores
PAIR_ROWS, PAIR_NODES = 100_000, 128  # two features are counted at once over that many rows and up to that many nodes
# Rows counted at a time, and what a row counts for beside its target (UNIT + residual, times its draws in a forest): both parts of a
# block's sum are exact and can be told apart. |residual| <= 4; a forest's targets are 0 or 1, so its levels of many nodes take larger blocks.
BLOCK, UNIT = 1 << 16, float(1 << 19)
WIDE_BLOCK, FOREST_UNIT = 1 << 20, float(1 << 32)
NODE = [("feature", "i2"), ("threshold", "f8"), ("left", "i4"), ("value", "f8")]  # a leaf's feature is -1; the right child follows the left


# --------------------------------------------------------------------------- packed rows


def bin_bounds(rows: DataFrame, width: int, features: str = "features") -> list[list[float]]:
    """Of each feature the upper bounds of its bins but the last, which has no bound (and holds NaN)."""
    from pyspark.ml.functions import vector_to_array
    x = rows.select(vector_to_array(features).alias("x")).select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)])
    at = [k / BINS for k in range(1, BINS)]
    row = x.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(width) for n, f in (
        ("q", lambda c: F.percentile_approx(c, at, 10000)), ("d", F.approx_count_distinct))]).first()
    out = []
    for i in range(width):
        values = []
        if row[f"d{i}"] <= 2 * BINS:
            values = sorted(r[0] for r in x.select(f"x{i}").distinct().limit(4 * BINS).collect() if r[0] is not None and math.isfinite(r[0]))
        if 0 < len(values) <= BINS:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        else:
            out.append(sorted({q for q in row[f"q{i}"] or [] if math.isfinite(q)}))
    return out


def packed(rows: DataFrame, bounds: list[list[float]], label: str = "Target", features: str = "features") -> DataFrame:
    """``rows`` as blocks (at: place of the block, bins: a byte per row and feature, positive: a byte per row), written once."""
    from pyspark.ml.functions import vector_to_array
    width = len(bounds)

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = np.column_stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bounds)]).astype("u1")
            yield pa.RecordBatch.from_pydict({"at": [(part << 32) + i], "bins": [bins.tobytes()], "positive": [(y == 1).astype("u1").tobytes()]},
                                             pa.schema([("at", pa.int64()), ("bins", pa.binary()), ("positive", pa.binary())]))
    return rows.select(F.col(label).cast("int"), vector_to_array(features)).mapInArrow(pack, "at bigint, bins binary, positive binary").checkpoint()


# --------------------------------------------------------------------------- growing trees (inside a fit's tasks)


class _Rows:
    """A task's share of the packed rows."""

    def __init__(self, batches, width: int):
        import numpy as np
        got = sorted((a.as_py(), b.as_py(), p.as_py()) for batch in batches for a, b, p in zip(*batch.columns))
        self.width, self.chunks = width, [(a, len(p)) for a, _, p in got]
        self.bins = np.frombuffer(b"".join(b for _, b, _ in got), "u1")  # row after row
        self.positive = np.frombuffer(b"".join(p for _, _, p in got), "u1")
        self.pairs = len(self.positive) >= PAIR_ROWS
        self._count_by()

    def _count_by(self):
        import numpy as np
        by = self.bins.reshape(-1, self.width)
        self.single = [((f,), np.ascontiguousarray(by[:, f])) for f in range(self.width)]
        self.double = [((f, f + 1), by[:, f].astype("u2") * BINS + by[:, f + 1]) if f + 1 < self.width else self.single[f]
                       for f in range(0, self.width, 2)] if self.pairs else self.single

    def kept(self, where):
        import numpy as np
        out = object.__new__(_Rows)
        out.width, out.chunks, out.pairs = self.width, [], self.pairs
        out.bins, out.positive = np.ascontiguousarray(self.bins.reshape(-1, self.width)[where]).ravel(), self.positive[where]
        out._count_by()
        return out


def _grow(rows: _Rows, amount, unit: float, wide: int, split_classes: bool, weight: float, depth: int, least: int, pick, merge):
    """One tree, level by level: (nodes, node of every row). ``amount`` is (``unit`` + target) x count of a row; levels of over
    ``PAIR_NODES`` nodes are counted in blocks of ``wide`` rows; positives weigh ``weight``; ``pick(n)`` says which features each of n nodes may be split by; ``merge`` adds up an array over the fit's tasks."""
    import numpy as np
    n, d, kinds = len(rows.positive), rows.width, 2 if split_classes else 1
    node, offset = np.zeros(n, "i4"), np.arange(min(n, max(BLOCK, wide)), dtype="i8") * d
    feature, bound, left, value = [np.zeros(1, t) for t in ("i2", "i2", "i4", "f8")]
    start = 0
    for level in range(depth):
        width = len(left) - start
        counts, size = np.zeros((2, kinds, width, d, BINS)), BLOCK if width <= PAIR_NODES else wide  # rows, sums of the target
        for a in range(0, n, size):
            cut = slice(a, min(n, a + size))
            at = node[cut]
            if level:  # down to this level; leaves stay
                at = left[at] + (rows.bins[a * d:cut.stop * d][offset[:len(at)] + feature[at]] > bound[at])
                node[cut] = at
            place = at.astype("i8") - start
            place[place < 0] = kinds * width  # rows in leaves above
            if split_classes:
                place[at >= start] += width * rows.positive[cut][at >= start].astype("i8")
            for columns, code in rows.double if width <= PAIR_NODES else rows.single:
                cells = BINS ** len(columns)
                h = np.bincount(place * cells + code[cut], amount[cut], (kinds * width + 1) * cells)[:kinds * width * cells]
                h = h.reshape(kinds, width, *[BINS] * len(columns))
                for i, f in enumerate(columns):
                    s = h if len(columns) == 1 else h.sum(3 - i)
                    c = np.floor(s / unit + 0.5)
                    counts[0, :, :, f] += c
                    counts[1, :, :, f] += s - c * unit
        counts = merge(counts)
        raw = counts[0].sum(0)
        both = counts[:, 0] + weight * counts[:, 1] if split_classes else counts[:, 0]
        (c, s), below = both.cumsum(3), raw.cumsum(2)
        whole_c, whole_s = c[:, :1, -1:], s[:, :1, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.where(whole_c > 0, whole_s ** 2 / whole_c, 0)
            gain = (s ** 2 / c + (whole_s - s) ** 2 / (whole_c - c) - base)[:, :, :-1]
        low = below[:, :, :-1]
        fits = (low >= max(least, 1)) & (raw.sum(2)[:, :, None] - low >= max(least, 1)) & pick(width)[:, :, None]
        gain = np.where(fits, gain, -1.0).reshape(width, -1)
        best = gain.argmax(1)
        top = gain[np.arange(width), best]
        divided = top > 1e-12 * np.maximum(base[:, 0, 0], 1)
        f, b = np.divmod(best, BINS - 1)
        here = np.arange(start, start + width)
        if level == 0:
            value[0] = whole_s[0, 0, 0] / whole_c[0, 0, 0] if whole_c[0, 0, 0] > 0 else 0.0
        split = np.flatnonzero(divided)
        children = len(left) + 2 * np.arange(len(split))
        feature[here], bound[here], left[here] = 0, BINS, here  # a leaf: no bin is above, and it is its own child
        feature[here[split]], bound[here[split]], left[here[split]] = f[split], b[split], children
        lc, ls = c[split, f[split], b[split]], s[split, f[split], b[split]]
        rc, rs = whole_c[split, 0, 0] - lc, whole_s[split, 0, 0] - ls
        start, m = len(left), 2 * len(split)
        feature, bound = np.concatenate([feature, np.zeros(m, "i2")]), np.concatenate([bound, np.full(m, BINS, "i2")])
        left = np.concatenate([left, np.arange(start, start + m, dtype="i4")])
        value = np.concatenate([value, np.column_stack([ls / lc, rs / rc]).ravel()])
        if not m:
            break
    for a in range(0, n, BLOCK):
        cut = slice(a, min(n, a + BLOCK))
        at = node[cut]
        node[cut] = left[at] + (rows.bins[a * d:cut.stop * d][offset[:len(at)] + feature[at]] > bound[at])
    return (feature, bound, left, value), node


def _as_nodes(tree, bounds) -> bytes:
    import numpy as np
    feature, bound, left, value = tree
    out = np.zeros(len(left), NODE)
    inner = left != np.arange(len(left))
    out["feature"], out["left"], out["value"] = np.where(inner, feature, -1), left, value
    out["threshold"][inner] = [bounds[f][b] if b < len(bounds[f]) else math.inf for f, b in zip(feature[inner], bound[inner])]
    return out.tobytes()


def _merger(together: bool):
    if not together:
        return lambda a: a
    import numpy as np
    from pyspark import BarrierTaskContext
    context = BarrierTaskContext.get()

    def merge(a):
        flat, out = a.ravel(), np.zeros(a.size)
        for i in range(0, a.size, 1 << 19):
            for part in context.allGather(base64.b64encode(flat[i:i + (1 << 19)].tobytes()).decode()):
                out[i:i + (1 << 19)] += np.frombuffer(base64.b64decode(part))
        return out.reshape(a.shape)
    return merge


def _boost(rows, bounds, point, weight, numbers, seed, merge):
    import numpy as np
    y = 2.0 * rows.positive - 1
    margin, every = np.zeros(len(y)), np.ones(len(bounds), bool)
    for i in numbers:
        target = y if i == 0 else np.rint(4 * y / (1 + np.exp(2 * y * margin)) * 2 ** 18) / 2 ** 18
        tree, node = _grow(rows, UNIT + target, UNIT, BLOCK, weight != 1, weight, point["depth"], 1, lambda n: np.broadcast_to(every, (n, len(every))), merge)
        margin += (1.0 if i == 0 else point["step"]) * tree[3][node]
        yield i, _as_nodes(tree, bounds)


def _forest(rows, bounds, point, weight, numbers, seed, merge):
    import numpy as np
    d = len(bounds)
    for i in numbers:
        drawn = np.concatenate([np.zeros(0, "i8"), *(np.random.default_rng([seed, i, at >> 32, at & 0xFFFFFFFF]).poisson(1.0, n) for at, n in rows.chunks)])
        some, random = rows.kept(drawn > 0), np.random.default_rng([seed, i])
        count = drawn[drawn > 0].astype("f8")
        tree, _ = _grow(some, count * (FOREST_UNIT + some.positive), FOREST_UNIT, WIDE_BLOCK, False, 1.0, point["depth"], point["least"],
                        lambda n: random.random((n, d)).argsort(1).argsort(1) < math.ceil(d ** 0.5), merge)
        yield i, _as_nodes(tree, bounds)


def _run(batches, kind, bounds, point, weight, numbers, seed, together):
    import pyarrow as pa
    first = True
    if together:
        from pyspark import BarrierTaskContext
        first = BarrierTaskContext.get().partitionId() == 0
    grown = {"boost": _boost, "forest": _forest}[kind](_Rows(batches, len(bounds)), bounds, point, weight, numbers, seed, _merger(together))
    for i, nodes in grown:
        if first:
            yield pa.RecordBatch.from_pydict({"tree": [i], "nodes": [nodes]}, pa.schema([("tree", pa.int32()), ("nodes", pa.binary())]))


def tasks_of_fit(spark: SparkSession, rows: int) -> int:
    """As many tasks as keep a task's rows in bounds. No more: a sum over barrier tasks takes Spark a second a level, and there are
    independent fits (and parts of forests) enough for the other cores."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":  # barrier tasks need a fixed number of cores
        return 1
    return max(1, min(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))


def fit(kind: str, blocks: DataFrame, bounds: list[list[float]], point: dict, weight: float = 1.0, seed: int = 42, tasks: int = 1,
        numbers: range | None = None) -> list:
    """Trees ``numbers`` (a forest's may be grown in parts; default: all) of one model as (number, nodes) rows."""
    together = tasks > 1
    data = blocks.repartition(tasks) if together else blocks.coalesce(1)
    run = partial(_run, kind=kind, bounds=bounds, point=point, weight=weight, numbers=numbers or range(point["trees"]), seed=seed, together=together)
    return [(r["tree"], bytes(r["nodes"])) for r in data.mapInArrow(run, "tree int, nodes binary", barrier=together).collect()]


# --------------------------------------------------------------------------- fitted model


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.instance.trees, "tree int, nodes binary").coalesce(1).write.parquet(f"{path}/trees")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model.trees = [(r["tree"], bytes(r["nodes"])) for r in SparkSession.getActiveSession().read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return model


class TreesModel(Model, _Stored, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """Fitted trees: boosted ones add up to a margin, those of a forest vote by their leaf's share of positives."""

    kind = Param(Params._dummy(), "kind", "boost or forest", TypeConverters.toString)
    step = Param(Params._dummy(), "step", "weight of every boosted tree but the first", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, trees: list | None = None, kind: str | None = None, step: float | None = None, featuresCol: str | None = None,
                 predictionCol: str | None = None, probabilityCol: str | None = None, rawPredictionCol: str | None = None):
        super().__init__()
        given = dict(self._input_kwargs)
        self.trees = sorted(given.pop("trees", None) or [])
        self._given(**given)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def _packed_trees(self):
        """All trees' nodes in one table: roots, feature, threshold, both children, value times the tree's weight."""
        import numpy as np
        trees = [np.frombuffer(b, NODE) for _, b in self.trees]
        boosted = self.getOrDefault(self.kind) == "boost"
        weights = [1.0 if not boosted or i == 0 else self.getOrDefault(self.step) for i, _ in self.trees]
        roots = np.cumsum([0] + [len(t) for t in trees])[:-1]
        own = [np.arange(len(t)) for t in trees]
        child = [np.column_stack([np.where(t["feature"] < 0, o, t["left"]), np.where(t["feature"] < 0, o, t["left"] + 1)]) + r for t, o, r in zip(trees, own, roots)]
        return (roots, np.maximum(np.concatenate([t["feature"] for t in trees]), 0).astype("i4"), np.concatenate([t["threshold"] for t in trees]),
                np.concatenate(child).ravel().astype("i4"), np.concatenate([t["value"] * w for t, w in zip(trees, weights)]))

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        shared = df.sparkSession.sparkContext.broadcast(self._packed_trees())

        @F.pandas_udf("double")
        def total(x: pd.Series) -> pd.Series:
            import numpy as np
            roots, feature, threshold, child, value = shared.value
            flat = np.concatenate([np.zeros(0), *x]).astype("f8")
            row = np.arange(len(x), dtype="i8") * (len(flat) // max(len(x), 1))
            out = np.zeros(len(x))
            for root in roots:
                at = np.full(len(x), root, "i4")
                while True:
                    to = child[2 * at + ~(flat[row + feature[at]] <= threshold[at])]
                    if np.array_equal(to, at):
                        break
                    at = to
                out += value[at]
            return pd.Series(out)
        z, n = F.col("_total"), float(len(self.trees))
        if self.getOrDefault(self.kind) == "boost":
            p, raw = 1.0 / (1.0 + F.exp(-2.0 * z)), F.array(-z, z)
        else:
            p, raw = z / n, F.array(n - z, z)
        return df.withColumn("_total", total(vector_to_array(self.getFeaturesCol()))).withColumns({
            self.getRawPredictionCol(): array_to_vector(raw), self.getProbabilityCol(): array_to_vector(F.array(1.0 - p, p)),
            self.getPredictionCol(): (p > 0.5).cast("double")}).drop("_total")
