"""Operator 9: approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (``FIT_ROWS`` vectors by hash order): each node splits at
the median of the projections on a random direction until leaves hold about ``LEAF`` sample
vectors. Every row is then filed in one leaf of each tree. A query searches all trees through one
priority queue, ordered by the sum of squared margins by which a branch was missed, until the leaves
it has taken hold ``SEARCH`` of the sample (all trees together); all rows in these leaves are compared exactly.

Leaves are joined with the queries that visit them in blocks: rows are spread over the chunks that
a leaf's counted size asks for, and each block returns only the best ``k`` of each query, so no
pairs are shuffled. Equal vectors are one row with their k + 1 smallest ids, so a vector that very
many rows share is no large leaf.

Defined results: rows without an id, and vectors that are null, empty, zero or hold null or
non-finite components, take no part, nor do vectors whose size isn't the queries' most frequent;
a query gets all candidates found if fewer than k; ties go to the smaller vec_id; repeated rows
count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rfmspark.llm.common import setup

FIT_ROWS = 20_000
LEAF = 16
TREES = 16
#: Share of the (sample's) rows that the leaves taken by a query hold, all trees together; at least SEARCH_ROWS sample vectors.
SEARCH = 0.75
SEARCH_ROWS = 1_000
#: Distinct vectors of a leaf that one block compares.
BLOCK_ROWS = 4096
FLOAT = "<f8"


class Forest:
    """Trees as arrays: normal and offset of inner nodes, children (a leaf as -1 - its number), sample size of leaves."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.trees = []
        self.sizes: list[int] = []  # of all trees' leaves, numbered through
        for _ in range(trees):
            normals, offsets, children = [], [], []

            def grow(rows):
                if len(rows) > leaf:
                    for _ in range(3):
                        a, b = sample[rng.choice(rows, 2, replace=False)]
                        n = (a - b) if rng.random() < 0.5 and (a != b).any() else rng.standard_normal(sample.shape[1])
                        n = n / np.linalg.norm(n)
                        p = sample[rows] @ n
                        cut = np.median(p)
                        right = p > cut
                        if 0 < right.sum() < len(rows):
                            at = len(normals)
                            normals.append(n)
                            offsets.append(cut)
                            children.append([0, 0])
                            children[at] = [grow(rows[~right]), grow(rows[right])]
                            return at
                self.sizes.append(len(rows))
                return -len(self.sizes)

            root = grow(np.arange(len(sample)))
            self.trees.append((root, np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets), np.array(children, int).reshape(-1, 2)))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, (root, normals, offsets, children) in enumerate(self.trees):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], normals[node]) > offsets[node]
                at[inner] = children[node, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, rows: float) -> list[int]:
        """Leaves in the order of the shared queue until they hold ``rows`` sample vectors."""
        queue = [(0.0, t, root) for t, (root, _, _, _) in enumerate(self.trees)]
        heapq.heapify(queue)
        projected = [normals @ q - offsets for _, normals, offsets, _ in self.trees]
        out, held = [], 0
        while queue and held < rows:
            miss, t, at = heapq.heappop(queue)
            children = self.trees[t][3]
            while at >= 0:
                margin = projected[t][at]
                near, far = (children[at][1], children[at][0]) if margin > 0 else (children[at][0], children[at][1])
                heapq.heappush(queue, (miss + margin * margin, t, int(far)))
                at = int(near)
            out.append(-1 - at)
            held += self.sizes[-1 - at]
        return out


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _packed(rows: DataFrame) -> DataFrame:
    """vec_id, dim and the vector as 64-bit floats, distinct."""
    def fn(batches):
        for b in batches:
            v = [np.array(x, FLOAT).tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "dim": pa.array([len(x) // 8 for x in v], pa.int32()), "vec": pa.array(v, pa.binary())})
    v = F.col("embedding").cast("array<double>")
    # adding 0.0 makes the two zeros one
    return rows.where(F.col("vec_id").isNotNull() & _valid(v)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v")) \
        .mapInArrow(fn, "vec_id long, dim int, vec binary").distinct()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), FLOAT).reshape(len(column), -1)


def _filer(forest: Forest):
    def fn(batches):
        for b in batches:
            vec = b.column("vec").to_pylist()
            if vec:
                leaf = forest.leaves(_matrix(vec))
                yield pa.RecordBatch.from_pydict({"ids": b.column("ids"), "vec": b.column("vec"), "leaf": pa.array(leaf.tolist(), pa.list_(pa.int64()))})
    return fn


def _searcher(forest: Forest, rows: float):
    def fn(batches):
        for b in batches:
            leaf = [forest.search(np.frombuffer(v, FLOAT), rows) for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_pydict({"query_id": b.column("vec_id"), "vec": b.column("vec"), "leaf": pa.array(leaf, pa.list_(pa.int64()))})
    return fn


def _best(query: int, vec: np.ndarray, matrix: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The k nearest (score, id) of a query among the rows, its own id left out."""
    d = np.sqrt(((matrix - vec) ** 2).sum(axis=1))
    if len(d) > k + 1:
        near = np.flatnonzero(d <= np.partition(d, k)[k])  # the query's own row may be one; ties all stay
    else:
        near = range(len(d))
    found = {(float(d[i]), int(v)) for i in near for v in ids[i] if v != query}
    return heapq.nsmallest(k, found)


def _block(k: int):
    def fn(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            matrix, ids = _matrix(rows["vec"].tolist()), rows["ids"].tolist()
            for q, v in zip(queries["query_id"].tolist(), queries["vec"].tolist()):
                out += [(q, i, s) for s, i in _best(q, np.frombuffer(v, FLOAT), matrix, ids, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return fn


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, search: float = SEARCH, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query among ``rows`` (vec_id, embedding), itself apart."""
    setup(rows.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    packed = _packed(rows)
    dims = packed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    dim = dims[0]["dim"]
    one = Window.partitionBy("vec").orderBy("vec_id")
    distinct = packed.where(F.col("dim") == dim).withColumn("turn", F.row_number().over(one)).where(F.col("turn") <= k + 1) \
        .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).checkpoint()
    sample = distinct.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(FIT_ROWS).collect()  # bounded: what the trees are fitted on
    forest = Forest(_matrix([bytes(r["vec"]) for r in sample]), trees)
    want = max(SEARCH_ROWS, search * len(sample))
    filed = distinct.mapInArrow(_filer(forest), "ids array<long>, vec binary, leaf array<long>").select("ids", "vec", F.explode("leaf").alias("leaf"))
    # one row per leaf (trees * FIT_ROWS / LEAF * 2 at most): how many blocks its rows need
    sizes = filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select(F.col("leaf").alias("l"), F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks"))
    left = filed.join(F.broadcast(sizes), F.col("leaf") == F.col("l")).select("leaf", F.pmod(F.xxhash64("vec"), F.col("blocks")).alias("block"), "ids", "vec")
    asked = _packed(queries).where(F.col("dim") == dim).mapInArrow(_searcher(forest, want), "query_id long, vec binary, leaf array<long>") \
        .select("query_id", "vec", F.explode("leaf").alias("leaf"))
    right = asked.join(F.broadcast(sizes), F.col("leaf") == F.col("l")) \
        .select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "query_id", "vec")
    found = left.groupBy("leaf", "block").cogroup(right.groupBy("leaf", "block")).applyInPandas(_block(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
