"""Frame sampling: points of time, the frames nearest to them, and thinning or repeating to a number of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temporis.functions.numeric import indices
from temporis.operators import interval

#: The most and the fewest frames of one reader call.
MAX_FRAMES, MIN_FRAMES = 32, 10


def _points(start: Column, n: Column, fps: float) -> Column:
    step = 1.0 / fps
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * F.lit(step))).otherwise(F.expr("cast(array() as array<double>)"))


def interval_points(start: Column, end: Column, fps: float = 2) -> Column:
    """Times in an interval, 1 / fps apart; an interval under a second is widened."""
    w = interval.widen_short(start, end)
    return _points(w["start_s"], F.floor((w["end_s"] - w["start_s"]) * fps).cast("int"), fps)


def clip_points(clip_no: Column, seconds: float = 10, fps: float = 2) -> Column:
    return _points(clip_no * float(seconds), F.lit(int(seconds * fps)), fps)


def nearest_frames(points: DataFrame, frames: DataFrame, key: str = "video_id") -> DataFrame:
    """points (key, t) with the nearest frame (t_s, and what else frames have), readable or not."""
    return interval.nearest_join(points, frames, key)


def readable_frames(points: DataFrame, frames: DataFrame, key: str = "video_id") -> DataFrame:
    """As nearest_frames, without the points whose nearest frame is missing or unreadable: no other frame takes its place."""
    return nearest_frames(points, frames, key).where("nearest.is_valid")


#: Seconds of a cell in which rows are numbered by themselves.
CELL = 300.0


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str = "_at", total: str | None = None, cell: float = CELL, size: str | None = None) -> DataFrame:
    """rows with their place (from 0) among those of their keys, by `order`, whose first column is a time; and, where named, how many there are. With
    `size` a row stands for as many as that column says.

    Rows are numbered within cells of time, and cells by the sums of the counts before them, so a long or hot video is as many tasks as it has cells: the
    only rows of a video that meet are a count for each of its cells. Rows without a time come first, as a cell of their own.
    """
    kinds = F.coalesce(F.floor(F.col(order[0]) / cell).cast("long"), F.lit(-(2**62)))
    rows = rows.withColumn("_cell", kinds)
    counts = rows.groupBy(*keys, "_cell").agg((F.sum(size) if size else F.count("*")).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    extra = [F.sum("_n").over(whole).cast("int").alias(total)] if total else []
    counts = counts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_cell").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), *extra)
    same = F.col("_cell") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inner = Window.partitionBy(*keys, "_cell").orderBy(*order)
    within = F.coalesce(F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if size else F.row_number().over(inner) - 1
    out = rows.withColumn("_own", within).join(counts, same)
    return out.withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_cell", "_of", "_before", "_own", *(f"_key{i}" for i in range(len(keys))))


def grid_runs(grids: DataFrame, frames: DataFrame, fps: float = 2, key: str = "video_id", cell: float = CELL) -> DataFrame:
    """What nearest_frames gives for the points start_s + i / fps, i from 0 to n - 1, of each row of grids (key, start_s, n), without the points: key,
    start_s, first, size, nearest, for each frame the run of points that it is the nearest of.

    Frames of a time are ordered within cells; a cell's first and last meet those of the cells beside it, so rows are frames, and one a cell of a video.
    """
    step, fields = 1.0 / fps, [c for c in frames.columns if c != key]
    asked = grids.where("n > 0 and start_s is not null").select(key, "start_s", F.col("n").cast("long").alias("n"))
    f = frames.where("t_s is not null").join(asked.select(key), key, "left_semi").groupBy(key, "t_s").agg(F.min(F.struct(*fields)).alias("nearest")).withColumn("_c", F.floor(F.col("t_s") / cell))
    ends = f.groupBy(key, "_c").agg(F.min("t_s").alias("_from"), F.max("t_s").alias("_to"))
    cells, inner = Window.partitionBy(key).orderBy("_c"), Window.partitionBy(key, "_c").orderBy("t_s")
    ends = ends.select(key, "_c", F.lag("_to").over(cells).alias("_to"), F.lead("_from").over(cells).alias("_from"))
    f = f.select("*", F.lag("t_s").over(inner).alias("_b"), F.lead("t_s").over(inner).alias("_a")).join(ends, [key, "_c"]).join(asked, key)
    f = f.withColumns({"_b": F.coalesce("_b", "_to"), "_a": F.coalesce("_a", "_from")})

    def upto(b: str, a: str) -> Column:
        """How many points are nearer to the earlier of two frames, or as near: close to their middle, then by the distances themselves."""
        about = F.floor(((F.col(b) + F.col(a)) / 2 - F.col("start_s")) / step)
        about = F.greatest(F.lit(-9.0), F.least(about.cast("double"), F.col("n").cast("double"))).cast("long") - 2
        t = lambda i: F.col("start_s") + i * F.lit(step)
        near = lambda i: (t(i) - F.col(b)) <= (F.col(a) - t(i))
        count = about + sum((near(about + j).cast("long") for j in range(5)), F.lit(0).cast("long"))
        return F.greatest(F.lit(0), F.least(count, F.col("n"))).cast("long")

    f = f.withColumn("first", F.when(F.col("_b").isNull(), F.lit(0).cast("long")).otherwise(upto("_b", "t_s")))
    f = f.withColumn("size", F.when(F.col("_a").isNull(), F.col("n")).otherwise(upto("t_s", "_a")) - F.col("first"))
    return f.where("size > 0").select(key, "start_s", "first", "size", "nearest")


def thinned_runs(runs: DataFrame, fps: float = 2, key: str = "video_id", how: str = "uniform", most: int = MAX_FRAMES, least: int = 0) -> DataFrame:
    """key, n, frames (structs of t, t_s): as thinned by t and t_s of the points of runs (see grid_runs), of which only those that are kept become rows."""
    t = lambda i: F.col("start_s") + i * F.lit(1.0 / fps)
    rows = runs.select(key, "start_s", "first", "size", F.col("nearest.t_s").alias("t_s"), t(F.col("first")).alias("t"))
    at = placed(rows, [key], ["t", "t_s"], "_at", "n", size="size")
    n = F.col("n")
    if how == "stride":
        places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: p * F.greatest(F.lit(1), F.floor(n / most).cast("int")))
    else:
        places = F.when(n > most, indices(n, most)).otherwise(F.sequence(F.lit(0), F.lit(most - 1)))
    own = F.filter(places, lambda p: (p >= F.col("_at")) & (p < F.col("_at") + F.col("size")))
    kept = at.select(key, "n", "start_s", "first", "_at", "t_s", F.explode(own).alias("_p"))
    kept = kept.select(key, "n", "_p", F.struct(t(F.col("first") + F.col("_p") - F.col("_at")).alias("t"), "t_s").alias("f"))
    out = kept.groupBy(key, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "f"))), lambda x: x["f"]).alias("frames"))
    return out.withColumn("frames", repeated(F.col("frames"), least)) if least else out


def thinned(frames: DataFrame, keys: list[str], order: list[str], how: str = "uniform", most: int = MAX_FRAMES, least: int = 0) -> DataFrame:
    """keys, n (of all frames) and frames: array of structs of `order`, by it, at most `most` of a key's, evenly (uniform) or every (n div most)-th
    (stride), and repeated up to `least`. Places to keep follow from the count, so no more than `most` frames of a key are gathered."""
    numbered = placed(frames.select(*keys, *order), keys, order, "_at", "n")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most).cast("int"))
    if how == "stride":
        kept = (F.col("_at") % step == 0) & (F.col("_at") / step < most)
    else:
        kept = (F.col("n") <= most) | F.array_contains(indices(F.col("n"), most), F.col("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.struct(*order).alias("f"))))
    out = numbered.where(kept).groupBy(*keys, "n").agg(F.transform(ordered, lambda x: x["f"]).alias("frames"))
    return out.withColumn("frames", repeated(F.col("frames"), least)) if least else out


def stride(frames: Column, most: int = MAX_FRAMES) -> Column:
    """Every (n div most)-th frame, at most `most` of them: the literal thinning, which keeps the head of 33 to 63 frames."""
    step = F.greatest(F.lit(1), F.floor(F.size(frames) / most).cast("int"))
    return F.slice(F.filter(frames, lambda x, i: i % step == 0), 1, most)


def uniform(frames: Column, most: int = MAX_FRAMES) -> Column:
    """`most` frames at even distances if there are more."""
    return F.when(F.size(frames) > most, F.transform(indices(F.size(frames), most), lambda i: F.get(frames, i))).otherwise(frames)


def repeated(frames: Column, least: int = MIN_FRAMES) -> Column:
    """Frames repeated evenly up to `least` if there are some, but fewer."""
    n = F.size(frames)
    return F.when((n > 0) & (n < least), F.transform(indices(n, least), lambda i: F.get(frames, i))).otherwise(frames)


def required(frames: Column, message: str = "no frames") -> Column:
    """The frames, or an error if there are none."""
    return F.when(F.size(frames) > 0, frames).otherwise(F.raise_error(F.lit(message)).cast("array<double>"))


def fixed_rate(frames: DataFrame, rate: float, fps: float, key: str = "video_id") -> DataFrame:
    """Every floor(rate / fps)-th frame of a video in order of time, numbered by ordinal."""
    step = max(1, int(rate // fps))
    out = placed(frames, [key], ["t_s", "frame_no"], "_pos").where(F.col("_pos") % step == 0)
    return out.withColumn("ordinal", F.floor(F.col("_pos") / step).cast("int")).drop("_pos")


def reader_frames(frames: Column, compat: str = "fixed") -> Column:
    """The frames that a reader call gets: thinned (literal: by stride; fixed: evenly) and filled up."""
    return repeated(stride(frames) if compat == "literal" else uniform(frames))
