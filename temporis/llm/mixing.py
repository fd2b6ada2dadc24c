"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

A document's size is its number of words. Sources, by code point with null last, weigh 5, 2, 1, repeating; they share
SHARE times all words in these proportions, and no source gets more than twice its own words: what is above is shared
again by weight. Blocks of BLOCK words go to sources by highest quotients (divisors 1, 3, 5, ...), then each source's blocks to its
shards in the same way by their words. A shard holds the source's documents in a seeded order, which is a sequence of words cut to
blocks; it gives them all as often as its quota holds them whole, and of the blocks once more those that come first in a
seeded permutation of the shard's blocks. What rounding to whole blocks adds to or leaves of a source's target, under a block or two, is
settled in words by its first shards, so a source's taken words are its target, rounded.

All steps but the apportionment are DataFrame operators. Apportionment sees one row for each source, then one
row for each shard: metadata, not documents. Shards hold at least SHARD_ROWS documents and about as many times
the square root of a source's documents more as it grows, so neither a shard nor the list of a source's shards outgrows a task.

Defined cases: a null text has size 0 and nothing is taken of it; a null source is a source of its own, the last;
repeated rows are documents of their own, null ids too (rows are dealt by id and text together, so only rows equal in both
meet in one shard); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temporis.llm import common

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2

BLOCK, SHARD_ROWS, SEED = 64, 4_000, 17


def sizes(docs: DataFrame) -> DataFrame:
    """docs with size: the number of words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long"))


def water_fill(size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shares of SHARE * sum(size) by weight, none above MOST * size."""
    left, out = SHARE * float(size.sum()), np.zeros(len(size))
    cap = MOST * size.astype(float)
    free = np.ones(len(size), bool)
    while free.any():
        want = left * weight / weight[free].sum()
        full = free & (want >= cap)
        if not full.any():
            out[free] = want[free]
            break
        out[full] = cap[full]
        left -= cap[full].sum()
        free &= ~full
    return out


def sainte_lague(share: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients share / (2 * own + 1), none above most; ties to the earlier row.

    The divisor between winning and losing quotients is bisected, and the few seats at it are then dealt one by one, so
    the cost doesn't depend on the number of seats.
    """
    most = np.where(share > 0, most, 0)  # a quotient of 0 wins nothing
    seats = int(min(seats, most.sum()))
    if not seats:
        return np.zeros(len(share), np.int64)

    def won(q: float) -> np.ndarray:
        """Seats whose quotients are at least q."""
        return np.floor(np.minimum(share / (2 * q) + 0.5, most)).astype(np.int64)

    low, high = 0.0, float(share.max()) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if won(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    own = won(high)
    while own.sum() < seats:
        quotient = np.where(own < most, share / (2 * own + 1), -1.0)
        own[int(np.argmax(quotient))] += 1
    return own


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> also target (words), seats (blocks), rest (words that these are under the target, or over it: below 0)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        key = p.source.map(lambda s: (s is None, s or ""))
        p = p.iloc[sorted(range(len(p)), key=lambda k: key.iloc[k])].reset_index(drop=True)
        size = p.source_size.to_numpy(np.int64)
        target = water_fill(size, np.array([WEIGHTS[k % len(WEIGHTS)] for k in range(len(p))], float))
        seats = sainte_lague(target, int(target.sum() // BLOCK), MOST * size // BLOCK)
        return p.assign(target=target, seats=seats, rest=np.clip(np.round(target), 0, MOST * size).astype(np.int64) - seats * BLOCK)

    return sources.groupBy().applyInPandas(run, "source string, source_size long, target double, seats long, rest long")


def stride(n: int) -> int:
    """A step that visits all of n blocks, spread evenly: the least number from the golden section on that has no divisor with n."""
    a = max(1, int(n * 0.6180339887498949))
    while gcd(a, n) > 1:
        a += 1
    return a


def shard_quotas(shards: DataFrame) -> DataFrame:
    """source, shard, shard_size, seats, rest of a source -> source, shard, shard_size, quota (words), step (of the order of blocks)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("shard").reset_index(drop=True)
        size = p.shard_size.to_numpy(np.int64)
        quota = BLOCK * sainte_lague(size.astype(float), int(p.seats.iloc[0]), MOST * size // BLOCK)
        left = int(p.seats.iloc[0]) * BLOCK - int(quota.sum()) + int(p.rest.iloc[0])
        for k in range(len(p)):
            if not left:
                break
            more = int(np.clip(left, -quota[k], MOST * size[k] - quota[k]))
            quota[k] += more
            left -= more
        return p[["source", "shard", "shard_size"]].assign(quota=quota, step=[stride(int(n) // BLOCK) for n in size])

    return shards.groupBy("source").applyInPandas(run, "source string, shard long, shard_size long, quota long, step long")


def chosen_words(at: Column, stop: Column, n: Column, rest: Column, step: Column, first: Column) -> Column:
    """array of (begin, end), words of a document that a shard's chosen blocks hold, counted in the document.

    The document holds the words [at, stop) of the shard's n; rest words are to be chosen: whole blocks in the order
    (step * block + first) mod blocks, and the words that are under a block from the next in this order (the words after the last
    whole block are its last).
    """
    blocks = F.floor(n / BLOCK)
    whole, more = F.floor(rest / BLOCK), rest % BLOCK

    def part(b: Column) -> Column:
        turn = F.when(b < blocks, F.pmod(step * b + first, F.greatest(blocks, F.lit(1)))).otherwise(blocks)
        held = F.when(turn < whole, F.lit(BLOCK)).when(turn == whole, more).otherwise(F.lit(0))
        return F.struct((F.greatest(at, b * BLOCK) - at).alias("begin"), (F.least(stop, b * BLOCK + held) - at).alias("end"))

    parts = F.transform(F.sequence(F.floor(at / BLOCK), F.floor((stop - 1) / BLOCK)), part)
    none = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")
    return F.when((stop > at) & (rest > 0), F.filter(parts, lambda p: p["begin"] < p["end"])).otherwise(none)


def mix(docs: DataFrame, key: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, source, size, source_size, target, and the words to take: whole (full copies), parts (begin, end: words taken once more)
    and taken, their number in all. docs has key, text and source."""
    draw = F.xxhash64(F.lit(SEED), key, F.xxhash64("text"))
    rows = common.materialize(sizes(docs).select(key, "source", "size", draw.alias("draw")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = common.materialize(
        source_targets(sources.select("source", "source_size")).join(sources.select(F.col("source").alias("s"), "n"), F.expr("source <=> s")).drop("s"), "mix-targets"
    )
    held = F.greatest(F.lit(shard_rows), F.sqrt("n") * 4)
    spread = targets.withColumn("shards", F.ceil(F.col("n") / held).cast("long"))
    same = F.expr("d.source <=> t.source")
    dealt = rows.alias("d").join(F.broadcast(spread.alias("t")) if _small(spread) else spread.alias("t"), same)
    dealt = dealt.select(f"d.{key}", "d.source", "d.size", "d.draw", "t.source_size", "t.target", "t.seats", "t.rest", F.pmod(F.xxhash64("d.draw"), F.col("t.shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), *[F.first(c).alias(c) for c in ("seats", "rest")])
    quotas = common.materialize(shard_quotas(shards), "mix-quotas")
    order = Window.partitionBy("source", "shard").orderBy("draw", key, "size")
    placed = dealt.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.alias("p").join(quotas.alias("q"), F.expr("p.source <=> q.source and p.shard = q.shard"))
    n, quota = F.col("q.shard_size"), F.col("q.quota")
    some = F.greatest(n, F.lit(1))
    first = F.pmod(F.xxhash64(F.lit(SEED + 1), "p.source", "p.shard"), F.greatest(F.floor(n / BLOCK), F.lit(1)))
    parts = chosen_words(F.col("p.stop") - F.col("p.size"), F.col("p.stop"), n, quota % some, F.col("q.step"), first)
    out = joined.select(f"p.{key}", "p.source", "p.size", "p.source_size", "p.target", F.floor(quota / some).alias("whole"), parts.alias("parts"))
    more = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["begin"])
    return out.withColumn("taken", F.col("whole") * F.col("size") + more)


def _small(sources: DataFrame) -> bool:
    """Whether there are so few sources that their rows may be broadcast; counted, as sources could grow."""
    return sources.limit(100_001).count() <= 100_000


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def words_of(text: Column, parts: Column) -> Column:
    """The words of text in parts (begin, end), each with the space before it as it stands there."""
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{common.WORD}"), F.lit(0))
    held = F.flatten(F.transform(parts, lambda p: F.slice(words, (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int"))))
    return F.regexp_replace(F.array_join(held, ""), r"^[\x20\x09-\x0D]+", "")


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each whole copy of a document, and one for the words that are taken once more, spaced
    as they stand in it; documents of which nothing is taken go. Equal rows are taken alike."""
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.xxhash64("doc_id", "text", "source").cast("string"))
    rows = docs.select(key.alias("key"), "text", "source", F.struct(*docs.columns).alias("row"))
    plan = mix(rows.select("key", "text", "source"), "key")
    plan = plan.groupBy("key").agg(*[F.first(c).alias(c) for c in ("size", "whole", "parts", "taken")])
    both = rows.join(plan, "key").where("taken > 0")
    some = F.when(F.col("taken") == (F.col("whole") + 1) * F.col("size"), F.col("text")).otherwise(words_of(F.col("text"), F.col("parts")))
    none = F.expr("cast(array() as array<string>)")
    texts = F.concat(F.array_repeat(F.col("text"), F.col("whole").cast("int")), F.when(F.size("parts") > 0, F.array(some)).otherwise(none))
    out = both.select("row", F.explode(texts).alias("taken_text"))
    own = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("taken_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
