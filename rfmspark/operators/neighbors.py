"""Exact neighbour queries in a few dimensions without emitting all pairs
(SURVEY §2.4, §2.8): k nearest neighbours, eps-neighbour counts and DBSCAN.

Equal points are one place (with its smallest ids, or its number of points): points at one
place have the same neighbours. Places are cut into tiles by median splits in all dimensions
(the cuts come from a sample, so they only decide sizes; a tile that came out too big is cut
by a hash). A tile is one row of packed coordinates with its bounding box, ordered so that
runs of ``RUN`` places are near each other and have small boxes of their own.

* kNN: every tile is searched for its own places first. A place then asks only those tiles
  whose box is no farther than its k-th distance so far, so one more pass is exact.
* eps counts: tiles whose boxes are within eps meet once for both of them. Runs farther
  apart are skipped, runs that lie within eps as a whole are counted as a whole. Tasks return
  one packed count a tile.
* DBSCAN: counts decide core points. Core places of a tile form local components; pairs of
  tiles give links between components (a spanning forest, so few rows); components of these
  links are found by iterative min-label propagation (checkpointed); border points join the
  smallest-labelled core neighbour; the rest are noise (-1).

Points with a null or NaN coordinate take no part. Distances are screened by matrix products
and decided by the sum of squared differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a tile in kNN; eps queries, which return less, take eight times as many.
CHUNK_ROWS = 4096
RUN = 256
#: Rows that the cuts are taken from, tiles that they make at most (beyond, tiles are cut by a hash), and tiles met by one task's tile at a time.
SAMPLE, MAX_CUTS, TOGETHER = 32768, 4096, 8


def _points(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]
    ok = whole[0]
    for w in whole[1:]:
        ok = ok & w
    # + 0.0: minus zero is zero
    return df.where(ok).select(F.col(id_col).cast("string").alias("pid"),
                               F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols]).alias("x"))


# --------------------------------------------------------------------------- tiles

def _cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each median split of a tree of ``depth`` levels (in heap order)."""
    dims, at = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1)
    parts = [x]
    for node in range(len(dims)):
        part = parts[node]
        if len(part):
            dims[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            v = part[:, dims[node]]
            at[node] = np.median(v)
            left = v <= at[node]
            parts += [part[left], part[~left]]
        else:
            parts += [part, part]
    return dims, at


def _mat(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _cell(dims: np.ndarray, at: np.ndarray, depth: int, d: int):
    def fn(batches):
        for batch in batches:
            x = _mat(batch.column("x"), d)
            node, row = np.zeros(len(x), int), np.arange(len(x))
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, dims[node]] > at[node])
            yield batch.append_column("cell", pa.array(node - ((1 << depth) - 1), pa.int64()))
    return fn


def _near_order(x: np.ndarray) -> np.ndarray:
    """Order in which runs of RUN places lie near each other."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= RUN:
            out.append(rows)
            continue
        part = x[rows]
        dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        cut = max(1, round(len(rows) / RUN / 2)) * RUN
        order = np.argpartition(part[:, dim], cut)
        todo += [rows[order[cut:]], rows[order[:cut]]]
    return np.concatenate(out) if out else np.zeros(0, int)


def _pack(d: int, kept: list[str]):
    def fn(rows: pa.Table) -> pa.Table:
        x = _mat(rows.column("x"), d)
        order = _near_order(x)
        x, take = x[order], pa.array(order)
        out = {"tile": pa.array([rows.column("tile")[0].as_py()], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()),
               "lo": pa.array([x.min(axis=0).tolist()], pa.list_(pa.float64())), "hi": pa.array([x.max(axis=0).tolist()], pa.list_(pa.float64()))}
        for c in kept:
            values = rows.column(c).combine_chunks().take(take)
            out[c] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(out)
    return fn


def _tiles(places: DataFrame, d: int, size: int, kept: dict[str, str]) -> DataFrame:
    """tile, x (packed), lo and hi (its box) and the columns ``kept`` as arrays, one row for about ``size`` places (a checkpoint)."""
    places = places.checkpoint(eager=True)
    n = places.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / size, MAX_CUTS))))))
    few = [r["x"] for r in places.select("x").sample(False, min(1.0, SAMPLE / max(n, 1)), 42).limit(2 * SAMPLE).collect()] if depth else []
    dims, at = _cuts(np.array(few, float).reshape(-1, d), depth)
    held = ", ".join(["x array<double>", *[f"{c} {t}" for c, t in kept.items()], "cell long"])
    cells = places.select("x", *kept).mapInArrow(_cell(dims, at, depth, d), held).checkpoint(eager=True)
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2.0 * size)).cast("long").alias("parts"))
    tiled = cells.join(F.broadcast(parts), "cell").select("x", *kept, (F.col("cell") * F.lit(1 << 20) + F.pmod(F.xxhash64("x"), "parts")).alias("tile"))
    out = ", ".join(["tile long, x binary, lo array<double>, hi array<double>", *[f"{c} array<{t}>" for c, t in kept.items()]])
    return tiled.groupBy("tile").applyInArrow(_pack(d, list(kept)), out).checkpoint(eager=True)


def _box_gap(alo: str, ahi: str, blo: str, bhi: str) -> Column:
    """Squared distance of two boxes."""
    gaps = F.zip_with(F.zip_with(alo, bhi, lambda a, b: a - b), F.zip_with(blo, ahi, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _boxes_within(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """(i, j) of tiles whose boxes may hold points within ``eps`` of each other."""
    a = left.select(F.col("tile").alias("i"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = right.select(F.col("tile").alias("j"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return a.crossJoin(b).where(_box_gap("alo", "ahi", "blo", "bhi") <= eps * eps * (1 + 1e-9)).select("i", "j")


def _meet(pairs: DataFrame, left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(left rows, right row)`` for each tile j of ``pairs`` (i, j) and about TOGETHER of its partners i at a time."""
    groups = max(1, -(-left.count() // TOGETHER))
    keyed = pairs.withColumn("g", F.pmod(F.xxhash64("i"), F.lit(groups)))
    home = keyed.join(left.withColumnRenamed("tile", "i"), "i")
    # fresh column identities: both sides of the cogroup may come from the same tiles
    other = keyed.select("j", "g").distinct().join(right.withColumnRenamed("tile", "j"), "j")
    other = other.select(*[F.col(c).alias(c) for c in other.columns])
    return home.groupBy("j", "g").cogroup(other.groupBy("j", "g")).applyInArrow(fn, schema)


# --------------------------------------------------------------------------- distances

def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to the same rows of ``b``."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


class _Screen:
    """Squared distances of rows to the places ``x`` by matrix products, and how far they may be off."""

    def __init__(self, x: np.ndarray):
        self.x, self.middle = x, x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        y = x - self.middle
        norm = (y ** 2).sum(axis=1)
        self.turned = np.ascontiguousarray(np.column_stack([y * -2.0, norm, np.ones(len(x))]).T)  # the norms are two more dimensions
        self.top = (norm.max() if len(x) else 0.0) + (self.middle ** 2).sum()

    def to(self, rows: np.ndarray, at=None) -> tuple[np.ndarray, np.ndarray]:
        y = rows - self.middle
        own = (y ** 2).sum(axis=1)
        turned = self.turned if at is None else self.turned[:, at]
        return np.column_stack([y, np.ones(len(rows)), own]) @ turned, 1e-13 * (own + self.top)

    def within(self, rows: np.ndarray, at, eps: float) -> np.ndarray:
        """Whether each of ``rows`` is within ``eps`` of each place ``at`` (None: of all)."""
        d2, off = self.to(rows, at)
        off = off.max()
        out = d2 <= eps * eps + off
        sure = d2 < eps * eps - off
        if np.count_nonzero(out) != np.count_nonzero(sure):
            i, j = np.nonzero(out & ~sure)
            out[i, j] = _exact(rows[i], (self.x if at is None else self.x[at])[j]) <= eps
        return out


class _Runs:
    """Boxes of the runs of RUN places of a tile."""

    def __init__(self, x: np.ndarray):
        self.at = np.arange(0, len(x), RUN)
        self.end = np.minimum(self.at + RUN, len(x))
        self.lo, self.hi = np.minimum.reduceat(x, self.at), np.maximum.reduceat(x, self.at)

    def gap(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of a box to each run."""
        least = np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0.0)
        most = np.maximum(self.hi - lo, hi - self.lo)
        return np.sqrt((least ** 2).sum(axis=1)), np.sqrt((most ** 2).sum(axis=1))

    def rows(self, which: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.at[r], self.end[r]) for r in which])


NO_ID = "\uffff"  # stands for a null id, which sorts last
SLACK = 1e-9  # of eps: boxes this near it are looked into


def _unpack(cell, d: int) -> np.ndarray:
    return np.frombuffer(cell.as_py(), float).reshape(-1, d)


# --------------------------------------------------------------------------- kNN

FOUND = pa.schema([("src", pa.int64()), ("row", pa.list_(pa.int32())), ("d", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.string())))])
#: What a tile found among its own places, and what it asks of others (then ``tile`` is set).
KNN_PARTS = "src long, row array<int>, d array<double>, ids array<array<string>>, tile long, hx binary, far binary"


def _closest(rows: np.ndarray, screen: _Screen, rank: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, distance) of what may be among the k nearest ids of each row, and the distance within which k ids lie (or infinity)."""
    row, place, dist, far = [], [], [], np.full(len(rows), np.inf)
    kk = min(k, len(screen.x))
    for at in range(0, len(rows), RUN):
        part = rows[at:at + RUN]
        d2, off = screen.to(part)
        kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        i, j = np.nonzero(d2 <= (kth + 4 * off)[:, None])
        d = _exact(part[i], screen.x[j])
        order = np.lexsort((rank[j], d, i))
        i, j, d = i[order], j[order], d[order]
        begin = np.searchsorted(i, np.arange(len(part)))
        stay = np.arange(len(i)) - begin[i] < kk  # k places hold the k smallest (distance, id)
        i, j, d = i[stay], j[stay], d[stay]
        begin = np.searchsorted(i, np.arange(len(part)))
        total = np.concatenate([[0], np.cumsum(size[j])])
        enough = total[1:] - total[begin[i]] >= k
        np.minimum.at(far, at + i[enough], d[enough])
        stay = d <= far[at + i]
        row.append(at + i[stay])
        place.append(j[stay])
        dist.append(d[stay])
    return np.concatenate(row), np.concatenate(place), np.concatenate(dist), far


def _lists(values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _found(src: int, row: np.ndarray, d: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([src], pa.int64()), _lists(row.astype(np.int32)), _lists(d), _lists(ids)], schema=FOUND)


def _ranked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Position of each list's first id among all, and the number of ids of each."""
    first = np.array([v[0] or "" for v in ids.to_pylist()], dtype=object)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    return rank, np.array(pc.list_value_length(ids))


def _list_of(column, at: int = 0) -> pa.Array:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)[at].values


def _own_tile(k: int, d: int, names: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Nearest ids in the own tile, and the rows that must ask each of the other tiles."""
    def one(tile: int, x: np.ndarray, ids: pa.Array):
        row, place, dist, far = _closest(x, _Screen(x), *_ranked(ids), k)
        got = _found(tile, row, dist, ids.take(pa.array(place)))
        yield pa.RecordBatch.from_arrays([*got.columns, pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary())],
                                         names=[*got.schema.names, "tile", "hx", "far"])
        own = int(np.flatnonzero(names == tile)[0])
        gap = np.maximum(np.maximum(lo - hi[own], lo[own] - hi), 0.0)
        near = np.sqrt((gap ** 2).sum(axis=1)) <= far.max() * (1 + SLACK)
        for other in np.flatnonzero(near & (names != tile)):
            gap = np.sqrt((np.maximum(np.maximum(lo[other] - x, x - hi[other]), 0.0) ** 2).sum(axis=1))
            asks = np.flatnonzero(gap <= far * (1 + SLACK))
            if len(asks):
                yield pa.RecordBatch.from_arrays([
                    pa.array([tile], pa.int64()), _lists(asks.astype(np.int32)), pa.array([None], FOUND.field("d").type), pa.array([None], FOUND.field("ids").type),
                    pa.array([int(names[other])], pa.int64()), pa.array([x[asks].tobytes()], pa.binary()), pa.array([far[asks].tobytes()], pa.binary())],
                    names=[*FOUND.names, "tile", "hx", "far"])

    def fn(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield from one(batch.column("tile")[at].as_py(), _unpack(batch.column("x")[at], d), _list_of(batch.column("ids"), at))
    return fn


def _other_tile(k: int, d: int):
    def fn(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            x, ids = _unpack(held.column("x")[0], d), _list_of(held.column("ids"))
            screen, (rank, size) = _Screen(x), _ranked(ids)
            for at in range(asked.num_rows):
                far = np.frombuffer(asked.column("far")[at].as_py(), float)
                row, place, dist, _ = _closest(_unpack(asked.column("hx")[at], d), screen, rank, size, k)
                stay = dist <= far[row]
                number = _list_of(asked.column("row"), at).to_numpy()
                out.append(_found(asked.column("src")[at].as_py(), number[row[stay]], dist[stay], ids.take(pa.array(place[stay]))))
        return pa.Table.from_batches(out, schema=FOUND)
    return fn


def _rows_of(d: int, more: dict[str, pa.DataType]):
    """tile, row and x of every place, with the array columns ``more``."""
    def fn(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                x = _unpack(batch.column("x")[at], d)
                n = len(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column("tile")[at].as_py())), pa.array(np.arange(n, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.reshape(-1))),
                    *[_list_of(batch.column(c), at).cast(t) for c, t in more.items()]], names=["tile", "row", "x", *more])
    return fn


def knn(df: DataFrame, id_col: str, cols: list[str], k: int = 5) -> DataFrame:
    """Exact k nearest neighbours (the point itself counts as the first): one row per
    point with ``neighbors`` = array of (dist, id) sorted by distance, then id.

    A tile's own places give every place a distance within which k ids lie; it then asks the
    tiles whose boxes are no farther (the tiles' boxes, one small row each, travel with every task)."""
    d = len(cols)
    pts = _points(df, id_col, cols).checkpoint(eager=True)
    # of a place's ids only the k smallest can be among the k nearest of anything
    first = pts.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy("pid"))).where(F.col("_r") <= k)
    places = first.groupBy("x").agg(F.array_sort(F.collect_list(F.coalesce("pid", F.lit(NO_ID)))).alias("ids"))
    tiles = _tiles(places, d, CHUNK_ROWS, {"ids": "array<string>"})
    boxes = tiles.select("tile", "lo", "hi").collect()
    names = np.array([b["tile"] for b in boxes], np.int64)
    lo, hi = (np.array([b[c] for b in boxes], float).reshape(-1, d) for c in ("lo", "hi"))
    parts = tiles.select("tile", "x", "ids").mapInArrow(_own_tile(k, d, names, lo, hi), KNN_PARTS).checkpoint(eager=True)
    asked = parts.where("tile is not null").select("tile", "src", "row", "hx", "far")
    told = asked.groupBy("tile").cogroup(tiles.select("tile", "x", "ids").groupBy("tile")) \
        .applyInArrow(_other_tile(k, d), "src long, row array<int>, d array<double>, ids array<array<string>>")
    found = parts.where("tile is null").select("src", "row", "d", "ids").union(told) \
        .select(F.col("src").alias("tile"), F.inline(F.arrays_zip("row", "d", "ids")))
    pairs = F.flatten(F.transform(F.collect_list(F.struct("d", "ids")), lambda c: F.transform(
        c["ids"], lambda i: F.struct(c["d"].alias("d"), F.nullif(i, F.lit(NO_ID)).alias("i")))))
    best = found.groupBy("tile", "row").agg(F.slice(F.array_sort(pairs), 1, k).alias("neighbors"))
    spots = tiles.select("tile", "x").mapInArrow(_rows_of(d, {}), "tile long, row int, x array<double>")
    return pts.join(spots.join(best, ["tile", "row"]).select("x", "neighbors"), "x").select(F.col("pid").alias(id_col), "neighbors")


def knn_self_join(df: DataFrame, id_col: str, cols: list[str], k: int = 5) -> DataFrame:
    """(id, rank, neighbor_id, dist) for the k nearest neighbours of every point."""
    nb = knn(df, id_col, cols, k)
    return nb.select(id_col, F.posexplode("neighbors").alias("r", "n")).select(
        id_col, (F.col("r") + 1).alias("rank"), F.col("n.i").alias("neighbor_id"), F.col("n.d").alias("dist"))


def k_distance(df: DataFrame, id_col: str, cols: list[str], k: int = 5) -> DataFrame:
    """Distance of every point to its k-th nearest neighbour (the elbow curve's data)."""
    nb = knn(df, id_col, cols, k)
    return nb.select(id_col, F.element_at("neighbors", -1)["d"].alias("k_distance"))


# --------------------------------------------------------------------------- eps neighbourhoods and DBSCAN

def _count_pair(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Points (weights) of the other side within ``eps`` of each place of either side."""
    na, nb = np.zeros(len(a)), np.zeros(len(b))
    ra, rb, screen = _Runs(a), _Runs(b), _Screen(b)
    total = np.add.reduceat(wb, rb.at)
    kind = np.float32 if max(wa.sum(), wb.sum()) < 1 << 24 else np.float64  # sums of whole numbers, exact in either
    xa, xb = wa.astype(kind), wb.astype(kind)
    for r, (lo, hi) in enumerate(zip(ra.lo, ra.hi)):
        home = slice(ra.at[r], ra.end[r])
        least, most = rb.gap(lo, hi)
        inside = most <= eps * (1 - SLACK)
        na[home] += total[inside].sum()
        if not same and inside.any():
            nb[rb.rows(np.flatnonzero(inside))] += wa[home].sum()
        look = np.flatnonzero(~inside & (least <= eps * (1 + SLACK)))
        for some in (look[i:i + 4] for i in range(0, len(look), 4)):  # blocks that stay in the processor's cache
            at = rb.rows(some)
            near = screen.within(a[home], at, eps).astype(kind)
            na[home] += near @ xb[at]
            if not same:
                nb[at] += xa[home] @ near
    return na, nb


def _count_task(eps: float, d: int):
    def fn(home: pa.Table, other: pa.Table) -> pa.Table:
        tiles, counts = [], []
        if home.num_rows:
            j = other.column("j")[0].as_py()
            x, w = _unpack(other.column("x")[0], d), _list_of(other.column("w")).to_numpy().astype(float)
            mine = np.zeros(len(x))
            for at in range(home.num_rows):
                i = home.column("i")[at].as_py()
                a, wa = (x, w) if i == j else (_unpack(home.column("x")[at], d), _list_of(home.column("w"), at).to_numpy().astype(float))
                na, nb = _count_pair(a, wa, x, w, eps, i == j)
                mine += na if i == j else nb
                if i != j:
                    tiles.append(i)
                    counts.append(na.astype(np.int64).tobytes())
            tiles.append(j)
            counts.append(mine.astype(np.int64).tobytes())
        return pa.table({"tile": pa.array(tiles, pa.int64()), "c": pa.array(counts, pa.binary())})
    return fn


def _sum_counts(rows: pa.Table) -> pa.Table:
    total = None
    for c in rows.column("c"):
        one = np.frombuffer(c.as_py(), np.int64)
        total = one if total is None else total + one
    return pa.table({"tile": rows.column("tile").slice(0, 1), "cnt": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _counted(pts: DataFrame, d: int, eps: float) -> DataFrame:
    """tile, x, lo, hi, ids (smallest id of each place) and cnt (points within ``eps`` of it)."""
    places = pts.groupBy("x").agg(F.min("pid").alias("ids"), F.count(F.lit(1)).alias("w"))
    tiles = _tiles(places, d, 8 * CHUNK_ROWS, {"ids": "string", "w": "long"})
    pairs = _boxes_within(tiles, tiles, eps).where("i <= j")
    rows = tiles.select("tile", "x", "w")
    counts = _meet(pairs, rows, rows, _count_task(eps, d), "tile long, c binary") \
        .groupBy("tile").applyInArrow(_sum_counts, "tile long, cnt array<long>")
    return tiles.drop("w").join(counts, "tile")


def eps_neighbor_counts(df: DataFrame, id_col: str, cols: list[str], eps: float = 1.2) -> DataFrame:
    """Number of points within ``eps`` of each point (itself included)."""
    d = len(cols)
    pts = _points(df, id_col, cols).checkpoint(eager=True)
    spots = _counted(pts, d, eps).select("tile", "x", "cnt").mapInArrow(_rows_of(d, {"cnt": pa.int64()}), "tile long, row int, x array<double>, cnt long")
    return pts.join(spots.select("x", "cnt"), "x").select(F.col("pid").alias(id_col), F.col("cnt").alias("neighbors"))


def _reached(front: np.ndarray, x: np.ndarray, eps: float) -> np.ndarray:
    """Whether each of the places ``x`` is within ``eps`` of any of ``front``."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(front), RUN):
        left = np.flatnonzero(~out)
        part = front[at:at + RUN]
        lo, hi = part.min(axis=0), part.max(axis=0)
        gap = np.maximum(np.maximum(x[left] - hi, lo - x[left]), 0.0)
        left = left[np.sqrt((gap ** 2).sum(axis=1)) <= eps * (1 + SLACK)]
        for k in range(0, len(left), 4096):
            some = left[k:k + 4096]
            out[some] = _Screen(x[some]).within(part, None, eps).any(axis=0)
    return out


def _local(x: np.ndarray, eps: float) -> np.ndarray:
    """Number of the component of each place, by steps of at most ``eps``."""
    comp, left, n = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left):
        front, left = left[:1], left[1:]
        comp[front] = n
        while len(front) and len(left):
            hit = _reached(x[front], x[left], eps)
            front, left = left[hit], left[~hit]
            comp[front] = n
        n += 1
    return comp


COMPONENTS = 1 << 16  # of a tile, at most


def _components(min_samples: int, eps: float, d: int):
    """Core places and others of a tile; the core places' components with their smallest ids."""
    def fn(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tile, x = batch.column("tile")[at].as_py(), _unpack(batch.column("x")[at], d)
                core = _list_of(batch.column("cnt"), at).to_numpy() >= min_samples
                comp = _local(x[core], eps)
                ids = np.array([v or "" for v in _list_of(batch.column("ids"), at).to_pylist()], dtype=object)[core]
                order = np.lexsort((np.argsort(np.argsort(ids, kind="stable"), kind="stable"), comp))
                first = order[np.flatnonzero(np.r_[True, np.diff(comp[order]) != 0])] if len(order) else order
                whole = np.full(len(x), -1)
                whole[core] = comp
                yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), _lists(whole.astype(np.int32)), _lists(pa.array(ids[first].tolist(), pa.string()))],
                                                 names=["tile", "comp", "least"])
    return fn


def _link_task(eps: float, d: int):
    """A spanning forest of the links between the components of two tiles."""
    def links(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray):
        lo, hi = b.min(axis=0), b.max(axis=0)
        near = np.sqrt((np.maximum(np.maximum(a - hi, lo - a), 0.0) ** 2).sum(axis=1)) <= eps * (1 + SLACK)
        a, ca = a[near], ca[near]
        for one in np.unique(ca):
            front, open_ = a[ca == one], np.arange(len(b))
            for at in range(0, len(front), RUN):
                hit = np.unique(cb[open_[_reached(front[at:at + RUN], b[open_], eps)]])
                yield from ((one, other) for other in hit)
                open_ = open_[~np.isin(cb[open_], hit)]
                if not len(open_):
                    break

    def fn(home: pa.Table, other: pa.Table) -> pa.Table:
        src, dst = [], []
        if home.num_rows:
            j = other.column("j")[0].as_py()
            cb, b = _list_of(other.column("comp")).to_numpy(), _unpack(other.column("x")[0], d)
            b, cb = b[cb >= 0], cb[cb >= 0]
            for at in range(home.num_rows):
                ca, a = _list_of(home.column("comp"), at).to_numpy(), _unpack(home.column("x")[at], d)
                a, ca = a[ca >= 0], ca[ca >= 0]
                if len(a) and len(b):
                    for p, q in links(a, ca, b, cb):
                        src.append(home.column("i")[at].as_py() * COMPONENTS + int(p))
                        dst.append(j * COMPONENTS + int(q))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})
    return fn


def _border_task(eps: float, d: int):
    """Smallest cluster among the core places of another tile, of places that aren't core."""
    def fn(home: pa.Table, other: pa.Table) -> pa.Table:
        tile, number, label = [], [], []
        if home.num_rows:
            lab, b = _list_of(other.column("label")).to_numpy(), _unpack(other.column("x")[0], d)
            b, lab = b[lab >= 0], lab[lab >= 0]
            for at in range(home.num_rows):
                i, rows, x = home.column("i")[at].as_py(), _list_of(home.column("border"), at).to_numpy(), _unpack(home.column("bx")[at], d)
                for cluster in np.unique(lab):  # ascending: what is reached first has the smallest
                    if not len(rows):
                        break
                    hit = _reached(b[lab == cluster], x, eps)
                    tile += [i] * int(hit.sum())
                    number += rows[hit].tolist()
                    label += [int(cluster)] * int(hit.sum())
                    rows, x = rows[~hit], x[~hit]
        return pa.table({"tile": pa.array(tile, pa.int64()), "row": pa.array(number, pa.int32()), "label": pa.array(label, pa.int64())})
    return fn


def _labelled(d: int):
    """Cluster of each core place (-1 for the others), and the places that aren't core."""
    def fn(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                comp, x = _list_of(batch.column("comp"), at).to_numpy(), _unpack(batch.column("x")[at], d)
                names = dict((m["comp"], m["label"]) for m in batch.column("names")[at].as_py() or [])
                tile = batch.column("tile")[at].as_py()
                number = np.full(len(names) + 1, -1, np.int64)
                for c, v in names.items():
                    number[c - tile * COMPONENTS] = v
                border = np.flatnonzero(comp < 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([tile], pa.int64()), _lists(number[np.where(comp < 0, len(names), comp)]),
                    _lists(border.astype(np.int32)), pa.array([x[border].tobytes()], pa.binary())], names=["tile", "label", "border", "bx"])
    return fn


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component = smallest node id reachable) over an undirected edge list.

    Each round takes the smallest label among a node's neighbours, then jumps pointers
    (a node takes its label's own label), so a long chain collapses in about
    log(diameter) rounds instead of one hop per round. Labels only ever decrease and
    stay inside the component, so the loop runs to convergence without a round cap
    and ends with every node labelled by its component's smallest id. The jump joins
    through the distinct labels only (one row per label), so a giant component is
    never one join key. Lineage is cut by a checkpoint per round."""
    e = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = e.checkpoint(eager=True)
    labels = e.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")) \
        .withColumnRenamed("src", "node").checkpoint(eager=True)
    while True:
        msg = e.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")) \
            .agg(F.min("label").alias("m"))
        new = labels.join(msg, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
        hop = new.select("label").distinct().join(
            new.select(F.col("node").alias("label"), F.col("label").alias("_up")), "label")
        new = new.join(hop, "label", "left").select(
            "node", F.least("label", F.coalesce("_up", "label")).alias("label")).checkpoint(eager=True)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1)
        labels = new
        if changed.isEmpty():
            return labels


def dense_order(keys: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out = 1-based position of each distinct ``key`` in ascending order) without a
    single-task window: keys are range-partitioned (written once, so both uses below see
    the same partitions), ranked inside each range, and offset by the row counts of the
    ranges before it (one row per partition)."""
    ranged = keys.repartitionByRange(key).withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select(
        "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))  # one row per partition
    return local.join(F.broadcast(offs), "_p").select(key, (F.col("_r") + F.col("_o")).alias(out))


def dbscan(df: DataFrame, id_col: str, cols: list[str], eps: float = 1.2, min_samples: int = 5) -> DataFrame:
    """DBSCAN labels: clusters numbered 0.. by their smallest point id, noise -1. A point
    is core with at least ``min_samples`` points within eps (itself included); a border
    point takes the smallest cluster among its core neighbours."""
    d = len(cols)
    pts = _points(df, id_col, cols).checkpoint(eager=True)
    tiles = _counted(pts, d, eps).checkpoint(eager=True)
    parts = tiles.select("tile", "x", "cnt", "ids").mapInArrow(_components(min_samples, eps, d), "tile long, comp array<int>, least array<string>").checkpoint(eager=True)
    cored = tiles.select("tile", "x", "lo", "hi").join(parts.where(F.size("least") > 0).select("tile", "comp"), "tile").checkpoint(eager=True)
    rows = cored.select("tile", "x", "comp")
    edges = _meet(_boxes_within(cored, cored, eps).where("i < j"), rows, rows, _link_task(eps, d), "src long, dst long").checkpoint(eager=True)
    comps = parts.select("tile", F.posexplode("least").alias("c", "least")).select((F.col("tile") * COMPONENTS + F.col("c")).alias("comp"), "least")
    joined = connected_components(edges).select(F.col("node").alias("comp"), F.col("label").alias("root"))
    comps = comps.join(joined, "comp", "left").withColumn("root", F.coalesce("root", "comp")).checkpoint(eager=True)
    roots = comps.groupBy("root").agg(F.min("least").alias("least"))
    order = dense_order(roots.select("least").distinct(), "least", "cid")
    named = comps.select("comp", "root").join(roots.join(order, "least").select("root", (F.col("cid") - 1).cast("long").alias("label")), "root")
    of_tile = named.groupBy(F.expr(f"comp div {COMPONENTS}").alias("tile")).agg(F.collect_list(F.struct("comp", "label")).alias("names"))
    labels = tiles.select("tile", "x").join(parts.select("tile", "comp"), "tile").join(of_tile, "tile", "left") \
        .mapInArrow(_labelled(d), "tile long, label array<long>, border array<int>, bx binary").checkpoint(eager=True)
    with_border = tiles.select("tile", "lo", "hi").join(labels.where(F.size("border") > 0).select("tile", "border", "bx"), "tile")
    border = _meet(_boxes_within(with_border, cored, eps), with_border.drop("lo", "hi"), cored.select("tile", "x").join(labels.select("tile", "label"), "tile"),
                   _border_task(eps, d), "tile long, row int, label long").groupBy("tile", "row").agg(F.min("label").alias("blab"))
    spots = tiles.select("tile", "x", "cnt").join(labels.select("tile", "label"), "tile") \
        .mapInArrow(_rows_of(d, {"cnt": pa.int64(), "label": pa.int64()}), "tile long, row int, x array<double>, cnt long, label long")
    spots = spots.join(border, ["tile", "row"], "left").select(
        "x", F.col("cnt").alias("neighbors"), (F.col("cnt") >= min_samples).alias("core"),
        F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("blab", F.lit(-1).cast("long"))).cast("int").alias("DBSCAN_Cluster"))
    return pts.join(spots, "x").select(F.col("pid").alias(id_col), "neighbors", "core", "DBSCAN_Cluster")
