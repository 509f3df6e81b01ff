"""Top lists of a few rows per query: merged as a tree, so that no task sees all lists of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lists that one step of the tree merges.
FAN = 16


def merge_tree(lists: DataFrame, query: list[str], node: str, order: list[Column], k: int, nodes: int) -> DataFrame:
    """Best ``k`` rows of each ``query`` (columns), best first by ``order``, as column rank.

    ``node`` (0 to ``nodes`` - 1) numbers the part that a row's list comes from. Every step merges the lists of FAN
    neighbouring nodes, so a step's group holds FAN * k rows of a query at most, however many nodes there are."""
    rows, left = lists, nodes
    while left > FAN:
        left = -(-left // FAN)
        rows = rows.withColumn(node, F.floor(F.col(node) / FAN).cast("int"))
        step = Window.partitionBy(*query, node).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(step)).where(F.col("rank") <= k).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order))).where(F.col("rank") <= k)
