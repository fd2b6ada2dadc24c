"""Arithmetic of sampling, resizing and signal preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indices(n: Column, k: int) -> Column:
    """k places spread over n rows: floor(i * n / k); empty for n = 0."""
    step = n.cast("double") / F.lit(float(k))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def linspace_indices(n: Column, k: int) -> Column:
    """k whole places from 0 to n - 1 at even distances."""
    step = (n - 1) / F.lit(float(k - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * step)).cast("int"))


def source_frame(seconds: Column, fps: Column) -> Column:
    """Frame number of a time: half-way cases go to the even number."""
    return F.bround(seconds * fps).cast("long")


def resize(width: Column, height: Column, longest: int = 748) -> Column:
    """struct(width, height) with the longer side at `longest` and the other in proportion, cut to whole pixels."""
    side = F.lit(longest)
    tall = height > width
    return F.struct(
        F.when(tall, F.floor(width * (side / height)).cast("int")).otherwise(side).alias("width"),
        F.when(tall, side).otherwise(F.floor(height * (side / width)).cast("int")).alias("height"),
    )


def centred(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
    return F.transform(values, lambda x: x.cast("double") - mean)


def repeat_to(values: Column, length: int) -> Column:
    """values repeated and cut to a length."""
    times = F.floor(F.lit(length) / F.size(values)).cast("int") + 1
    return F.when(F.size(values) > 0, F.slice(F.flatten(F.array_repeat(values, times)), 1, length))


def three_chunks(values: Column, length: int, seed: int = 0) -> Column:
    """Three parts of a length: from the front, the middle and the back third of the possible starts, drawn by seed; a short
    sequence is repeated to the length and used three times."""
    starts = F.size(values) - length + 1
    third, more = F.floor(starts / 3).cast("int"), (starts % 3).cast("int")
    sizes = [third + F.when(more > k, 1).otherwise(0) for k in range(3)]
    firsts = [F.lit(0), sizes[0], sizes[0] + sizes[1]]
    draw = [F.when(n > 0, f + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), values), F.greatest(n, F.lit(1))).cast("int")).otherwise(F.lit(0)) for k, (f, n) in enumerate(zip(firsts, sizes, strict=True))]
    cut = F.array(*[F.slice(values, d + 1, F.lit(length)) for d in draw])
    return F.when(starts > 1, cut).otherwise(F.array_repeat(repeat_to(values, length), 3))


def standardised(values: Column, mean: float, std: float) -> Column:
    return F.transform(values, lambda x: (x.cast("double") - mean) / (std * 2))


def depth(values: Column, least: float = 0.01, most: float = 10.0) -> Column:
    """Depths in metres, clipped and divided by the largest allowed (or found, where none is set)."""
    metres = F.transform(values, lambda x: F.greatest(x.cast("double") / 1000, F.lit(least)))
    if most:
        return F.transform(metres, lambda x: F.least(x, F.lit(most)) / most)
    return F.transform(metres, lambda x: x / F.array_max(metres))
