"""Exact order statistics and ordered running sums without a single-task global sort.

``percentile`` (exact) keeps a value->count map of every distinct value in one
buffer per group, and a window ``ORDER BY`` without ``PARTITION BY`` moves every
row to one task. Neither scales. The two building blocks here avoid both:

* :func:`values_at_ranks` - the value at given 0-based ranks, per group, by selection in
  rounds, as a radix selection does: every round cuts the value range that still holds a
  wanted rank into parts (by sign and exponent first, then equal ones) and counts rows per
  part (with each part's smallest and largest value), so only counts are shuffled, a few
  thousand per group and range whatever the number of rows or of distinct values. The part that holds the rank is the next round's range, from
  its smallest to its largest value, until these are equal.
* :func:`cumulative_by_order` - running sums in value order, a prefix scan in two passes:
  rows are range-partitioned by value (equal values share a partition, the partitions
  follow the session's sizing) and written once; the partitions' totals give each its
  offset, and a window inside each partition finishes the sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal parts into which a round cuts a value range.
BUCKETS = 4096
#: Groups whose ranges travel to every task; more are joined through a shuffle.
BROADCAST_GROUPS = 4096
_INF = float("inf")


def _bucket(x: Column, lo: Column, hi: Column) -> Column:
    """Part of lo..hi that a value lies in; it never falls as the value grows.

    A range that spans zero or a factor above BUCKETS is cut by sign and binary exponent (4,200 parts), any other into
    BUCKETS equal parts, so 52 bits of mantissa take five rounds at most. Infinities and NaN have parts of their own."""
    power = F.floor(F.log2(F.abs(x))).cast("bigint") + 1080
    by_size = F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, power).otherwise(-power)
    equal = F.least(F.floor((x - lo) / (hi - lo) * F.lit(BUCKETS)), F.lit(BUCKETS - 1).cast("bigint"))
    near = ((lo > 0) & (hi / F.lit(BUCKETS) <= lo)) | ((hi < 0) & (lo / F.lit(BUCKETS) >= hi))
    inside = F.when(hi == lo, F.lit(0).cast("bigint")).when(near, equal).otherwise(by_size)
    return F.when(F.isnan(x), F.lit(10_001)).when(x == F.lit(_INF), F.lit(10_000)).when(x == F.lit(-_INF), F.lit(-10_000)).otherwise(inside)


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def values_at_ranks(df: DataFrame, value_col: str, specs: list[tuple[float, Callable[[Column], Column]]],
                    group_cols: list[str] | None = None) -> DataFrame:
    """``group_cols..., r_index, n, rank, value``: for each spec ``(p, rank_of)`` the value at
    0-based rank ``rank_of(n)`` (a Column expression of the group size ``n``) in ascending
    order of ``value_col`` (NULLs ignored, NaN last), per group. Runs its rounds when called;
    every round is one pass over ``df`` and one small written table."""
    g = list(group_cols or [])
    own, other = [f"_g{i}" for i in range(len(g))], [f"_h{i}" for i in range(len(g))]
    d = df.select(*[F.col(c).alias(k) for c, k in zip(g, own)], F.col(value_col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    finite = F.when(F.abs("_x") < F.lit(_INF), F.col("_x"))
    size = d.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).where("n > 0")
    n = F.col("n")
    want = size.select(*own, "n", "lo", "hi", F.inline(F.array(*[
        F.struct(F.lit(i).alias("r_index"), F.least(F.greatest(rank_of(n).cast("bigint"), F.lit(0).cast("bigint")), n - 1).alias("rank"))
        for i, (_, rank_of) in enumerate(specs)]))).withColumn("left", F.col("rank")).withColumn("value", F.lit(None).cast("double"))
    # a first range of equal values needs no round (unless infinities or NaN stand around it: the round settles that)
    want, first = want.checkpoint(), True
    while not (open_ := want.where("value is null")).isEmpty():
        ranges = open_.select(*[F.col(k).alias(h) for k, h in zip(own, other)], "lo", "hi").distinct() \
            .groupBy(*other).agg(F.collect_list(F.struct("lo", "hi")).alias("_iv"))
        few = not g or ranges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        ranges = F.broadcast(ranges) if few else ranges
        rows = d.join(ranges, _same(own, other)) if g else d.crossJoin(ranges)
        # a group's ranges don't overlap, so a row lies in one at most; the first round takes all rows
        mine = F.col("_iv") if first else F.filter("_iv", lambda e: (F.col("_x") >= e["lo"]) & (F.col("_x") <= e["hi"]))
        rows = rows.select(*[F.col(h) for h in other], "_x", F.inline(mine))
        counts = rows.groupBy(*other, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), _bucket(F.col("_x"), F.col("lo"), F.col("hi")).alias("_b")) \
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        upto = Window.partitionBy(*other, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_end", F.sum("_c").over(upto))
        hit = open_.join(counts, _same([*own, "lo", "hi"], [*other, "_lo", "_hi"]) & (F.col("_end") > F.col("left")) & (F.col("_end") - F.col("_c") <= F.col("left")))
        done = F.when(F.col("_min") == F.col("_max"), F.col("_min"))
        next_ = hit.select(*own, "n", F.col("_min").alias("lo"), F.col("_max").alias("hi"), "r_index", "rank",
                           (F.col("left") - F.col("_end") + F.col("_c")).alias("left"), done.alias("value"))
        want, first = want.where("value is not null").unionByName(next_).checkpoint(), False
    return want.select(*[F.col(k).alias(c) for c, k in zip(g, own)], "r_index", "n", "rank", "value")


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_cols: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles (NumPy default, SQL ``percentile_cont``):
    ``group_cols..., p_index, p, n, q``. Between order statistics floor(h) and
    floor(h)+1 with h = (n-1)·p."""
    g = list(group_cols or [])
    probs = [float(p) for p in probs]
    specs = []
    for p in probs:
        specs.append((p, lambda n, p=p: F.floor((n - 1).cast("double") * F.lit(p))))
        specs.append((p, lambda n, p=p: F.floor((n - 1).cast("double") * F.lit(p)) + 1))
    v = values_at_ranks(df, value_col, specs, g)
    wide = v.groupBy(*g).agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("r_index") == i, F.col("value"))).alias(f"_v{i}") for i in range(2 * len(probs))])
    rows = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(p)
        fr = h - F.floor(h)
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        q = F.when(fr == 0, lo).otherwise(lo + (hi - lo) * fr)
        rows.append(F.struct(F.lit(i).alias("p_index"), F.lit(p).alias("p"), q.alias("q")))
    return wide.select(*g, "n", F.explode(F.array(*rows)).alias("_s")).select(*g, "_s.p_index", "_s.p", "n", "_s.q")


def quantile_row(df: DataFrame, value_col: str, probs: list[float], names: list[str]) -> DataFrame:
    """Global quantiles as a single row with one named column per probability."""
    q = exact_quantiles(df, value_col, probs)
    return q.groupBy().agg(*[F.max(F.when(F.col("p_index") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])


def cumulative_by_order(df: DataFrame, order_col: str, sum_cols: list[str], group_cols: list[str] | None = None,
                        descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` = sum of ``c`` over rows whose ``order_col`` comes before or
    equals the current row's (RANGE frame: ties share the value), per group. Where very many
    rows share a value, sum them by value first (as the curves do): equal values share a task.
    ``ranges`` fixes the number of value ranges, which otherwise follows the session's sizing."""
    g = list(group_cols or [])
    o = F.col(order_col).cast("double")
    keys = [*g, "_k"]
    d = df.withColumn("_k", -o if descending else o)
    d = (d.repartitionByRange(ranges, *keys) if ranges else d.repartitionByRange(*keys)).withColumn("_p", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*g, "_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])  # one row per group and range
    offsets = totals.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(g)], F.col("_p").alias("_q"),
                            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    d = d.join(offsets, _same([*g, "_p"], [*(f"_h{i}" for i in range(len(g))), "_q"]))
    inside = Window.partitionBy(*g, "_p").orderBy("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sum_cols]
    return d.select(*df.columns, *sums)


def stack_columns(df: DataFrame, cols: list[str], key_cols: list[str] | None = None,
                  name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Unpivot ``cols`` to (name, value) rows, one pass, no shuffle."""
    keys = list(key_cols or [])
    pairs = F.array(*[F.struct(F.lit(c).alias(name_col), F.col(c).cast("double").alias(value_col)) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("_kv")).select(*keys, f"_kv.{name_col}", f"_kv.{value_col}")
