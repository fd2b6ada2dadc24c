"""Closed intervals in seconds: predicates, widening, clamping, and joins on overlap or nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Touching counts."""
    return (b1 <= e2) & (b2 <= e1)


def widen_point(t: Column, by: float = 1.0) -> Column:
    return F.struct((t - by).alias("start_s"), (t + by).alias("end_s"))


def widen_short(b: Column, e: Column) -> Column:
    """An interval under a second grows by half a second on both sides, not below 0."""
    short = e - b < 1
    return F.struct(F.when(short, F.greatest(b - 0.5, F.lit(0.0))).otherwise(b).alias("start_s"), F.when(short, e + 0.5).otherwise(e).alias("end_s"))


def of_clip(clip_no: Column, seconds: float = 10) -> Column:
    return F.struct((clip_no * float(seconds)).alias("start_s"), (clip_no * float(seconds) + float(seconds)).alias("end_s"))


def clamp(b: Column, e: Column, duration: Column) -> Column:
    """Both ends within [0, duration]; an empty or turned interval begins a second before its end."""
    inside = lambda x: F.greatest(F.lit(0.0), F.least(x, duration))
    return F.struct(F.when(inside(e) <= inside(b), inside(e) - 1).otherwise(inside(b)).alias("start_s"), inside(e).alias("end_s"))


#: Cells of a level are as many times as wide as those of the level below; the highest level.
FACTOR, LEVELS = 4, 16


def _level(width: float) -> Column:
    """The lowest level whose cells are as wide as the interval is long."""
    sizes = (F.col("end_s") - F.col("start_s")) / F.lit(width)
    out = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(sizes <= float(FACTOR**level), F.lit(level)).otherwise(out)
    return out


def interval_cells(df: DataFrame, name: str, key: str, width: float, others: list[int]) -> DataFrame:
    """df once for each cell that an interval touches: cells of its own level, two at most, and of those `others` levels
    that are wider. Columns {name} (the row), {name}_key, {name}_own, {name}_level, {name}_cell."""
    level = F.col("_own")
    levels = F.array_union(F.array(level), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > level))
    cell = lambda t, x: F.floor(t / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), x))).cast("long")
    cells = F.flatten(F.transform(levels, lambda x: F.transform(F.sequence(cell(F.col("start_s"), x), cell(F.col("end_s"), x)), lambda c: F.struct(x.alias("level"), c.alias("cell")))))
    out = df.where(F.col("start_s") <= F.col("end_s")).withColumn("_own", _level(width))
    out = out.select(F.col(key).alias(f"{name}_key"), F.struct(*df.columns).alias(name), F.col("_own").alias(f"{name}_own"), F.explode(cells).alias("_x"))
    return out.select(name, f"{name}_key", f"{name}_own", F.col("_x.level").alias(f"{name}_level"), F.col("_x.cell").alias(f"{name}_cell"))


def interval_levels(df: DataFrame, width: float) -> list[int]:
    """The levels that a table's intervals have: LEVELS + 1 numbers at most."""
    return sorted(r[0] for r in df.where(F.col("start_s") <= F.col("end_s")).select(_level(width)).distinct().collect())


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of the same key whose intervals (start_s, end_s) overlap, as l and r structs; each pair once.

    Cells have several widths: `width` seconds, and powers of FACTOR of it. An interval goes to the one or two cells of its own size that it touches, and
    to cells of those wider sizes that intervals of the other side have; a pair meets in cells of the longer one's size,
    and is kept in the cell where the later of the two starts. So an equi join on (key, level, cell) spreads a long video over many tasks, and an
    interval of hours is a few rows, as one of seconds is. Null and turned intervals take no part.
    """
    l = interval_cells(left, "l", key, width, interval_levels(right, width))
    r = interval_cells(right, "r", key, width, interval_levels(left, width))
    cond = (F.col("l_key") == F.col("r_key")) & (F.col("l_level") == F.col("r_level")) & (F.col("l_cell") == F.col("r_cell"))
    longer = F.col("l_level") == F.greatest("l_own", "r_own")
    home = F.floor(F.greatest("l.start_s", "r.start_s") / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), F.col("l_level")))).cast("long")
    overlap = overlaps(F.col("l.start_s"), F.col("l.end_s"), F.col("r.start_s"), F.col("r.end_s"))
    return l.join(r, cond).where(longer & overlap & (F.col("l_cell") == home)).select("l", "r")


def nearest_join(points: DataFrame, items: DataFrame, key: str, point: str = "t", item: str = "t_s", width: float = 60.0) -> DataFrame:
    """points with struct `nearest`: the item of the same key nearest in time. Of two equally near the earlier; of items
    of one time the smallest. NULL without any item, and for a null point; items without a time take no part.

    Both sides go to cells of `width` seconds. A cell's first and last item are carried to the cells where the next points and items
    lie, past empty cells, so each cell is sorted by itself: a long or hot key spreads over as many tasks as it has cells, and
    only one row a cell meets the others of its key.
    """
    fields = [c for c in items.columns if c != key]
    cell = lambda t: F.floor(t / width)
    i = items.where(F.col(item).isNotNull()).select(F.col(key).alias("_k"), F.col(item).alias("_t"), F.struct(*fields).alias("_i"))
    i = i.groupBy("_k", "_t").agg(F.min("_i").alias("_i")).withColumn("_c", cell(F.col("_t")))
    p = points.select(F.col(key).alias("_k"), F.col(point).alias("_t"), F.struct(*points.columns).alias("_p")).withColumn("_c", cell(F.col("_t")))
    asked = p.where("_c is not null").select("_k", "_c").distinct()
    ends = i.groupBy("_k", "_c").agg(F.min(F.struct("_t", "_i")).alias("first"), F.max(F.struct("_t", "_i")).alias("last"))
    cells = ends.join(asked, ["_k", "_c"], "full")
    # what comes later is what came last in the opposite order: a frame that ends with its partition would be read again for each row
    order, back = Window.partitionBy("_k").orderBy("_c"), Window.partitionBy("_k").orderBy(F.desc("_c"))
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    beside = cells.select("_k", "_c", before.alias("before"), after.alias("after")).join(asked, ["_k", "_c"], "left_semi")
    carried = beside.select("_k", "_c", F.explode(F.array("before", "after")).alias("x")).where("x is not null").select("_k", "x._t", "x._i", "_c")
    here = i.join(asked, ["_k", "_c"], "left_semi").unionByName(carried)
    none, empty = F.lit(None).cast(i.schema["_i"].dataType), F.lit(None).cast(p.schema["_p"].dataType)
    both = p.select("_k", "_c", "_t", F.lit(1).alias("_side"), "_p", none.alias("_i")).unionByName(here.select("_k", "_c", "_t", F.lit(0).alias("_side"), empty.alias("_p"), "_i"))
    inner, turned = Window.partitionBy("_k", "_c").orderBy("_t", "_side"), Window.partitionBy("_k", "_c").orderBy(F.desc("_t"), F.desc("_side"))
    earlier = F.last("_i", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    later = F.last("_i", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0))
    out = both.select("*", earlier.alias("_b"), later.alias("_a")).where("_side = 1")
    closer = (F.col("_t") - F.col(f"_b.{item}")) <= (F.col(f"_a.{item}") - F.col("_t"))
    nearest = F.when(F.col("_t").isNotNull(), F.when(F.col("_a").isNull() | closer, F.col("_b")).otherwise(F.col("_a")))
    return out.select("_p.*", nearest.alias("nearest"))
