"""Functions of one's own over Arrow arrays: a scalar one, an aggregate in two steps, a table function over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.LongType())
def code_point_sum(text: pa.Array) -> pa.Array:
    """The sum of a text's code points; 0 of an empty text, null of null."""
    units = pc.fill_null(text.cast(pa.large_string()), "")
    lengths = pc.utf8_length(units).to_numpy()
    codes = np.frombuffer("".join(units.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.cumsum(lengths)
    sums = np.diff(np.r_[0, np.r_[0, np.cumsum(codes)][ends]])
    return pa.array(sums, mask=text.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def exp_mean(total: pa.Array, n: pa.Array) -> float:
    """From sums of logarithms and counts of a group's parts: the geometric mean; null of none."""
    count = pc.sum(n).as_py()
    return float(np.exp(pc.sum(total).as_py() / count)) if count else None


def geometric_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, mean: exp of the mean of ln(1 + |value|), null values left out, null keys a group; null where a group has no value.

    Each partition sums its own rows, a batch at a time, and sends one row a group; the aggregate function sees as many rows of a group as there
    are partitions, never the group.
    """
    kind = dict(rows.dtypes)[key]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            logs = pc.ln(pc.add(pc.abs(batch.column("v")), 1.0))
            own = pa.table([batch.column("k"), logs, pc.is_valid(logs).cast(pa.int64())], ["k", "s", "n"])
            held = own if held is None else pa.concat_tables([held, own])
            held = held.group_by("k").aggregate([("s", "sum"), ("n", "sum")]).rename_columns(["k", "s", "n"])
        if held is not None:
            yield from held.to_batches()

    parts = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).mapInArrow(sums, f"k {kind}, s double, n long")
    return parts.groupBy("k").agg(exp_mean(F.coalesce("s", F.lit(0.0)), F.col("n")).alias("mean")).withColumnRenamed("k", key)


@F.arrow_udtf(returnType=T.StructType([T.StructField(n, k) for n, k in (("conv_id", T.LongType()), ("turn", T.LongType()), ("place", T.LongType()), ("code", T.IntegerType()))]))
class CodePoints:
    """A row for each character of each row's text (conv_id, turn, text), a batch at a time; a null text has none."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        lengths = pc.utf8_length(text).to_numpy().astype(np.int64)
        codes = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int32)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = pa.array(row)
        yield pa.table({"conv_id": batch.column("conv_id").take(at), "turn": batch.column("turn").take(at), "place": pa.array(place), "code": pa.array(codes)})


def code_points(rows: DataFrame, text: str) -> DataFrame:
    """conv_id, turn, place, code of every character of a column."""
    asked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col(text).alias("text"))
    return CodePoints(asked.asTable())
