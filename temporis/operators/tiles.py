"""Tiles of a block search: which rows of both sides meet, planned from the counts of each group of `on`.

A large group (a video of many clips) is cut into blocks of about `block` rows on both sides, and each block of items meets each block of
queries of that group alone. Small groups are packed together, whole, to about a block. So a row is copied only
as often as its own group's other side has blocks, whatever else the tables hold, and a group that only one side has takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a tile: the group or pack, the block of items, the block of queries.
TILE = ["_g", "_a", "_b"]


def _blocks(n: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int")


def _share(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def _copies(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def plan(items: DataFrame, queries: DataFrame, on: list[str], block: int) -> DataFrame:
    """on, _g, _i (blocks of items), _q (blocks of queries) of the groups that both sides have; a null is no group."""
    both = items.groupBy(*on).agg(F.count("*").alias("_ni")).join(queries.groupBy(*on).agg(F.count("*").alias("_nq")), on)
    most = F.greatest("_ni", "_nq")
    small = most <= block
    packed = both.agg(F.sum(F.when(small, most))).first()[0] or 0
    place = F.xxhash64(*on)
    group = F.when(small, F.pmod(place, F.lit(max(1, -(-packed // block))))).otherwise(-1 - F.pmod(place, F.lit(1 << 62)))
    return both.select(*on, group.alias("_g"), _blocks(F.col("_ni"), block).alias("_i"), _blocks(F.col("_nq"), block).alias("_q"))


def dealt(items: DataFrame, queries: DataFrame, item: str, query: str, on: list[str] | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tiles."""
    if on:
        groups = plan(items, queries, on, block)
        left, right = items.join(groups, on), queries.join(groups, on)
    else:
        n_i, n_q = (_blocks(F.lit(x.count()), block) for x in (items, queries))
        left, right = (x.withColumns({"_g": F.lit(0).cast("long"), "_i": n_i, "_q": n_q}) for x in (items, queries))
    left = left.select(*items.columns, "_g", _share(item, F.col("_i")).alias("_a"), _copies(F.col("_q")).alias("_b"))
    right = right.select(*queries.columns, "_g", _copies(F.col("_i")).alias("_a"), _share(query, F.col("_q")).alias("_b"))
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, also where both sides come from one table
