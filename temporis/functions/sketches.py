"""Approximate aggregates that merge: sketches of windows, kept as a table, and put together when they are read.

A sketch has a set size, whatever it has seen, and the sketch of several windows is the merge of theirs, so figures of any span of time follow from the kept
rows without the events. Stated errors (of one standard deviation, or of rank): distinct counts 1.04 / sqrt(2^bits), ranks about
2.3 / k^0.9, counts of the most frequent exact while there are no more different items than are tracked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a distinct-count register index, size of a quantile sketch, items tracked for the most frequent.
BITS, K, TRACKED = 12, 400, 10_000
#: Distinct counts off by more than this many standard deviations, and ranks by more than this, are no chance.
SIGMAS, RANK_ERROR = 4, 0.02


def sketched(rows: DataFrame, by: list[Column], who: str, amount: str, kind: str, bits: int = BITS, k: int = K, tracked: int = TRACKED) -> DataFrame:
    """by, users (distinct count of who), amounts (quantiles of amount), kinds (most frequent of kind): a row for each group."""
    return rows.groupBy(*by).agg(
        F.hll_sketch_agg(who, F.lit(bits)).alias("users"),
        F.kll_sketch_agg_double(F.col(amount).cast("double"), F.lit(k)).alias("amounts"),
        F.expr(f"approx_top_k_accumulate(`{kind}`, {tracked})").alias("kinds"),
    )


def merged(sketches: DataFrame, by: list[Column], tracked: int = TRACKED) -> DataFrame:
    """The same columns, for wider groups, from sketches of narrower ones."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("amounts").alias("amounts"), F.expr(f"approx_top_k_combine(kinds, {tracked})").alias("kinds"))


def read(sketches: DataFrame, by: list[str], quantiles: list[float], most: int) -> DataFrame:
    """by, users, n, quantiles, top (array of struct item, count): what sketches tell."""
    parts = F.array(*map(F.lit, quantiles))
    return sketches.select(
        *by, F.hll_sketch_estimate("users").alias("users"), F.kll_sketch_get_n_double("amounts").alias("n"),
        F.kll_sketch_get_quantile_double("amounts", parts).alias("quantiles"), F.expr(f"approx_top_k_estimate(kinds, {most})").alias("top"),
    )


def distinct_is_near(estimate: Column, exact: Column, bits: int = BITS) -> Column:
    return F.abs(estimate - exact) <= SIGMAS * 1.04 / 2 ** (bits / 2) * exact + 1
