"""Operator 11: exact top-k by inner product, as tiled matrix products.

Components become whole numbers, floor(``SCALE`` * x). Candidates are dealt by hash into shards and
queries into blocks; a tile is one block against one shard. A tile multiplies sub-tiles of bounded
size, selects each query's k best of every sub-tile (whatever isn't above the k-th score is passed
over before anything is sorted) and returns k rows per query at most; the lists of a query are merged
as a tree of fixed fan-in. The number of shards and blocks follows the rows, a tile's size doesn't.
What is copied are packed vectors: queries once per shard, candidates once per block of queries.

Products are exact: vectors whose components are small enough for their sums to stay below 2^53 go
through double-precision matrix products, any others through whole numbers of any size; scores that
pass 64 bits are held at its bounds.

Defined results: rows without an id, and vectors that are null or hold null or non-finite components,
take no part; zero and empty vectors do; only vectors of a query's own length are its candidates, and
rows with its id never are; a component whose product with SCALE passes a double's range counts as not finite; a query gets all candidates if fewer than k; ties go to the smaller
vec_id; repeated rows count once; an id with several vectors has one row, and as a query one list, for
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.common import setup
from rfmspark.llm.toplists import merge_tree

SCALE = 1024
#: Bounds of a tile, and of the part of it that is multiplied at once.
SHARD_ROWS, BLOCK_ROWS = 65_536, 16_384
SUB_ROWS, SUB_QUERIES = 8_192, 1_024
#: A shard isn't cut below this many rows to keep all cores busy.
LEAST_ROWS = 4_096
FAR = 1 << 62


def _pack(scale: int):
    """vec_id and its vector as bytes: components of 16 bits where they fit (length even), else doubles and a closing byte."""
    def fn(batches):
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("embedding"))))
            lists = batch.column("embedding")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null component is NaN
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row[~np.isfinite(x)], minlength=len(size)) == 0
            wide = np.bincount(row[~(abs(x) < 1 << 15)], minlength=len(size)) > 0
            begin = np.r_[0, np.cumsum(size)]
            short = np.where(np.repeat(good & ~wide, size), x, 0).astype("<i2")
            vecs = [x[a:b].astype("<f8").tobytes() + b"d" if w else short[a:b].tobytes()
                    for a, b, w, g in zip(begin[:-1], begin[1:], wide, good) if g]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").filter(pa.array(good)), "vec": pa.array(vecs, pa.binary())})
    return fn


def packed(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Distinct (vec_id, vec) of the rows that take part."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_pack(scale), "vec_id long, vec binary").distinct()


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: the rows that have it and their vectors, as doubles."""
    by_size: dict[int, list[int]] = {}
    raw = column.to_pylist()
    for i, v in enumerate(raw):
        by_size.setdefault(len(v), []).append(i)
    out: dict[int, list] = {}
    for size, at in by_size.items():
        dim = size // 8 if size & 1 else size // 2
        flat = np.frombuffer(b"".join(raw[i] for i in at), np.dtype([("x", "<f8", (dim,)), ("d", "u1")]))["x"] if size & 1 \
            else np.frombuffer(b"".join(raw[i] for i in at), "<i2").reshape(len(at), dim).astype(np.float64)
        out.setdefault(dim, []).append((np.array(at), flat))
    return {dim: (np.concatenate([a for a, _ in parts]), np.concatenate([x for _, x in parts])) for dim, parts in out.items()}


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q and c as 64-bit numbers."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    top = (1 << 53) / q.shape[1]
    if abs(q).max(initial=0) * abs(c).max(initial=0) < top:
        return (q @ c.T).astype(np.int64)
    out = np.zeros((len(q), len(c)), np.int64)
    small = [abs(x).max(axis=1) < top ** 0.5 for x in (q, c)]
    out[np.ix_(*small)] = (q[small[0]] @ c[small[1]].T).astype(np.int64)
    for i, row in enumerate(q):
        rest = np.flatnonzero(~small[1]) if small[0][i] else np.arange(len(c))
        whole = [int(x) for x in row]
        for j in rest:
            score = sum(a * int(b) for a, b in zip(whole, c[j]))
            out[i, j] = min(max(score, -(1 << 63) + 1), (1 << 63) - 1)
    return out


def select(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest open scores of every row, ties to the left column."""
    if scores.shape[1] > k:
        floor = np.partition(np.where(open_, scores, np.iinfo(np.int64).min), scores.shape[1] - k, axis=1)[:, -k][:, None]
        over, level = open_ & (scores > floor), open_ & (scores == floor)
        free = k - over.sum(axis=1)
        crowded = np.flatnonzero(level.sum(axis=1) > free)
        level[crowded] &= np.cumsum(level[crowded], axis=1) <= free[crowded, None]
        open_ = over | level
    return np.nonzero(open_)


def _best(k: int, *columns: np.ndarray) -> list[np.ndarray]:
    """The k best (query, score, id) rows of every query."""
    query, score, number = columns
    order = np.lexsort((number, -score, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[place < k]
    return [c[order] for c in columns]


def _tile(k: int):
    def fn(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        found = [[np.zeros(0, np.int64)] * 3]
        if len(ids) and len(asked):
            candidates = _vectors(rows.column("vec"))
            for dim, (at, q) in _vectors(queries.column("vec")).items():
                if dim not in candidates:
                    continue
                have, c = candidates[dim]
                order = np.argsort(ids[have], kind="stable")
                have, c = ids[have][order], c[order]
                for a in range(0, len(q), SUB_QUERIES):
                    best = [np.zeros(0, np.int64)] * 3
                    for b in range(0, len(c), SUB_ROWS):
                        scores = _products(q[a:a + SUB_QUERIES], c[b:b + SUB_ROWS])
                        row, col = select(scores, asked[at[a:a + SUB_QUERIES]][:, None] != have[b:b + SUB_ROWS], k)
                        best = _best(k, *(np.concatenate(x) for x in zip(best, (at[a + row], scores[row, col], have[b + col]))))
                    found.append(best)
        query, score, number = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": pa.array(asked[query] if len(asked) else query), "form": queries.column("form").take(pa.array(query)),
                         "vec_id": pa.array(number), "score": pa.array(score),
                         "node": pa.array(np.full(len(query), rows.column("shard")[0].as_py() if len(ids) else 0, np.int32))})
    return fn


def top_products(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows with the highest inner product of each query, itself apart."""
    spark = rows.sparkSession
    setup(spark)
    have, ask = packed(rows, scale).checkpoint(), packed(queries, scale).checkpoint()
    n, n_ask = have.count(), ask.count()
    shards = max(1, -(-n // shard_rows), min(n // LEAST_ROWS, 2 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-n_ask // block_rows))

    def each(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(count):
        return F.pmod(F.xxhash64("vec_id", "vec"), F.lit(count)).cast("int")

    left = have.select("vec_id", "vec", dealt(shards).alias("shard"), each(blocks).alias("block"))
    right = ask.select(F.col("vec_id").alias("query_id"), "vec", F.xxhash64("vec").alias("form"), dealt(blocks).alias("block"), each(shards).alias("shard"))
    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")) \
        .applyInArrow(_tile(k), "query_id long, form long, vec_id long, score long, node int")
    return merge_tree(lists, ["query_id", "form"], "node", [F.desc("score"), F.asc("vec_id")], k, shards).select("query_id", "rank", "vec_id", "score")


#: The query's own result in DuckDB.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
