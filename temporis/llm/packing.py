"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A document is its token ids and END; documents longer than LIMIT are cut to pieces of LIMIT ids, the last one shorter. Pieces are dealt
to shards of about SHARD pieces, so each shard is a bounded bin-packing problem. A genome is a grouping: the bin of each
piece. Each shard evolves on ISLANDS islands, tasks of their own, for EPOCHS epochs of CROSSINGS crossings, whatever the first
genomes reach: there is no early stop. The first genomes of an island are best fits of pieces in falling and in perturbed
order. Crossover injects a random part of one parent's well-filled bins whole into the other; that one's bins which hold
a duplicate of an injected piece go, and some ill-filled ones with them; the displaced pieces are put back by best fit. The
fewest bins win, then the largest sum of squared fills, which gathers the free space in few bins. Islands keep their
genomes between epochs; an island's elite then takes the place of the worst genome of the next.
Pieces in bins filled under LOOSE of a shard's best genome meet those of other shards in a last round of the same
search, so that shards leave no open bins behind.

Rows are told apart by a number that they get when the tokenised pieces are written, so repeated and null doc_ids spread
over shards as others do, and no group of them meets in a task.

Defined cases: a null text is empty, so one END; an empty text too; repeated rows are documents of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common

LIMIT, END = 4096, 1
SHARD, ISLANDS, EPOCHS, POPULATION, CROSSINGS, SEED = 2000, 3, 3, 6, 30, 23
#: Fills that count as well-filled and as loose; the largest share of the well-filled bins that a crossing injects.
FULL, LOOSE, INJECTED = 0.995, 0.97, 0.3
VOCABULARY = "word_bpe_49k.json"
_KNOWN_MAX = 700_000
#: Characters for which the vocabulary's own normalising and splitting equal lower() and _PIECES.
_OTHER = re.compile("[^\t-\r -~À-įĲ-ſ]").search
_PIECES = re.compile(r"[a-zß-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ſ0-9]+").findall
_PLAIN = bytes([*range(9, 14), *range(32, 127)])


class Encoder:
    """Token ids as little-endian bytes. Words are encoded by the tokenizer once and remembered, up to a fixed number.

    A text with characters whose splitting may differ, or with a special token's string, goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        odd = text.encode().translate(None, _PLAIN) if text.isascii() else _OTHER(text)
        if odd or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, pieces = self.known, _PIECES(text.lower())
        new = list(set(pieces).difference(known))
        if new:
            if len(known) + len(new) > _KNOWN_MAX:
                known.clear()
                new = list(set(pieces))
            for piece, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[piece] = array("I", got.ids).tobytes()
        return b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The Encoder of a worker process: tasks that run in it one after the other share what it remembers."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, path: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian bytes, if asked for in more)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(path or default_vocabulary()), np.array([END], "<u4").tobytes()
        for p in batches:
            out: list[tuple] = []
            for i, text in zip(p.doc_id, p.text, strict=True):
                ids = encode(text) + end
                for k, a in enumerate(range(0, len(ids), 4 * LIMIT)):
                    part = ids[a : a + 4 * LIMIT]
                    out.append((i, k, k * LIMIT, len(part) // 4, zlib.crc32(part), *[part] * len(more)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *more])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.spread(texts).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {m} binary" for m in more))


Genome = tuple[np.ndarray, np.ndarray]  # the bin of each piece, and the fill of each bin (0: no such bin)


def fill_in(own: np.ndarray, fills: np.ndarray, loose: np.ndarray, sizes: np.ndarray, unused: list[int]) -> None:
    """Put the pieces of loose, in order, into bins by best fit: the least free space that is enough, else an unused bin."""
    if not len(loose):
        return
    least, to = int(sizes[loose].min()), []
    open_ = np.flatnonzero((fills > 0) & (LIMIT - fills >= least))
    free = sorted(zip((LIMIT - fills[open_]).tolist(), open_.tolist(), strict=True))
    for length in sizes[loose].tolist():
        at = bisect_left(free, (length, -1))
        left, k = free.pop(at) if at < len(free) else (LIMIT, unused.pop())
        to.append(k)
        if left - length >= least:
            insort(free, (left - length, k))
    own[loose] = to
    np.add.at(fills, to, sizes[loose])


def best_fit(order: np.ndarray, sizes: np.ndarray) -> Genome:
    """The pieces, in order, put into bins by best fit."""
    own, fills = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    fill_in(own, fills, order, sizes, list(range(len(sizes) - 1, -1, -1)))
    return own, fills


def best_fit_decreasing(sizes: np.ndarray) -> Genome:
    return best_fit(np.argsort(-sizes, kind="stable"), sizes)


def fitness(g: Genome) -> tuple[int, float]:
    """The fewer bins the better, then the more uneven their fills; larger is better."""
    fills = g[1][g[1] > 0] / LIMIT
    return -len(fills), float((fills**2).sum())


def cross(a: Genome, b: Genome, sizes: np.ndarray, rng: np.random.Generator) -> Genome:
    """A child: some of b's well-filled bins go into a whole; a's bins that hold one of their pieces go, with some of its
    ill-filled bins, and what they held besides is put back by best fit, the longest first (half of the times about so)."""
    own, fills = a[0].copy(), a[1].copy()
    good = rng.permutation(np.flatnonzero(b[1] >= FULL * LIMIT))
    good = good[: int(rng.integers(1, max(2, int(INJECTED * len(good)) + 1)))]
    injected = np.zeros(len(sizes), bool)
    injected[good] = True
    taken = injected[b[0]]
    gone = np.zeros(len(sizes), bool)
    gone[own[taken]] = True
    ill = np.flatnonzero((fills > 0) & (fills < FULL * LIMIT) & ~gone)
    gone[rng.permutation(ill)[: max(1, len(ill) // 8)]] = True
    loose = np.flatnonzero(gone[own] & ~taken)
    fills[gone] = 0
    unused = np.flatnonzero(fills == 0)[::-1].tolist()
    place = np.zeros(len(sizes), np.int64)
    place[good] = [unused.pop() for _ in good]
    own[taken] = place[b[0][taken]]
    fills[place[good]] = b[1][good]
    weight = sizes[loose] * (rng.uniform(0.8, 1.25, len(loose)) if rng.random() < 0.5 else 1.0)
    fill_in(own, fills, loose[np.argsort(-weight, kind="stable")], sizes, unused)
    return own, fills


def evolve(sizes: np.ndarray, seed: list[int], people: list[np.ndarray], crossings: int = CROSSINGS) -> list[np.ndarray]:
    """One epoch of an island: its genomes after it, the fittest first. people: those it begins with, an immigrant among them;
    none in the first epoch."""
    rng, n = np.random.default_rng(seed), len(sizes)
    known = [(own, np.bincount(own, sizes, n).astype(np.int64)) for own in people] or [best_fit_decreasing(sizes)]
    while len(known) < POPULATION:
        known.append(best_fit(np.argsort(-(sizes * rng.uniform(0.6, 1.5, n)), kind="stable"), sizes))
    ranked = sorted(((*fitness(g), -k, g) for k, g in enumerate(known)), key=lambda x: x[:3], reverse=True)[:POPULATION]
    for k in range(crossings):
        a, b = (ranked[j][3] for j in rng.permutation(len(ranked))[:2])
        child = cross(a, b, sizes, rng)
        found = (*fitness(child), -POPULATION - k - 1, child)
        if found[:3] > ranked[-1][:3] and all(found[:2] != r[:2] for r in ranked):  # no twin: the genomes stay different
            ranked = sorted([*ranked[:-1], found], key=lambda x: x[:3], reverse=True)
    return [r[3][0] for r in ranked]


def offsets(own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece begins in its bin, and its bin's fill."""
    order = np.argsort(own, kind="stable")
    fills = np.bincount(own, sizes).astype(np.int64)
    offset = np.zeros(len(own), np.int64)
    offset[order] = np.cumsum(sizes[order]) - sizes[order] - np.r_[0, np.cumsum(fills)][own[order]]
    return offset, fills[own]


_STATE = "shard long, island long, sizes array<int>, people binary, bins int, squares double"


def _epoch(level: int, number: int, crossings: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for shard, island, lengths, people in zip(p.shard, p.island, p.sizes, p.people, strict=True):
                sizes = np.asarray(lengths, np.int64)
                begun = list(np.frombuffer(people, "<i4").astype(np.int64).reshape(-1, len(sizes))) if people is not None else []
                done = evolve(sizes, [SEED, level, number, shard, island], begun, crossings)
                bins, squares = fitness((done[0], np.bincount(done[0], sizes, len(sizes)).astype(np.int64)))
                out.append((shard, island, lengths, np.concatenate(done).astype("<i4").tobytes(), -bins, squares))
            yield pd.DataFrame(out, columns=["shard", "island", "sizes", "people", "bins", "squares"])

    return run


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island's worst genome gives way to the elite of the island before it."""
    genome = F.size("sizes") * 4
    elites = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.substring("people", F.lit(1), genome).alias("elite"))
    kept = F.expr("substring(people, 1, octet_length(people) - 4 * size(sizes))")
    return state.join(elites, ["shard", "island"]).select("shard", "island", "sizes", F.concat(kept, F.col("elite")).alias("people"))


def _packed_by_shard(rows: DataFrame, shard_rows: int, islands: int, epochs: int, crossings: int, level: int) -> DataFrame:
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // shard_rows))
    draw = F.pmod(F.xxhash64(F.lit(SEED + level), "uid"), F.lit(n))
    held = rows.groupBy(draw.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "ids_crc32", "uid", "start", "length"))).alias("items"))
    shards = common.materialize(held, "pack-shards")  # a shard has about shard_rows items, whatever their doc_ids
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    state = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))).alias("island"), lengths.alias("sizes"), F.lit(None).cast("binary").alias("people"))
    for number in range(epochs):
        if number and islands > 1:
            state = _migrate(state, islands)
        # a count of its own: the rows are small and heavy, so partitions must not be put together by their size
        dealt = state.repartition(common.partitions(spark), "shard", "island")
        state = common.replace(state, dealt.mapInPandas(_epoch(level, number, crossings), _STATE), "pack-islands")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for shard, lengths, elite in zip(p.shard, p.sizes, p.elite, strict=True):
                own, sizes = np.frombuffer(elite, "<i4").astype(np.int64), np.asarray(lengths, np.int64)
                out.append((shard, own, *offsets(own, sizes)))
            yield pd.DataFrame(out, columns=["shard", "own", "offset", "fill"])

    elite = F.struct((-F.col("bins")).alias("b"), "squares", (-F.col("island")).alias("i"), "sizes", F.substring("people", F.lit(1), F.size("sizes") * 4).alias("elite"))
    best = state.groupBy("shard").agg(F.max_by(elite, F.struct((-F.col("bins")), "squares", (-F.col("island")))).alias("x")).select("shard", "x.sizes", "x.elite")
    placed = best.mapInPandas(place, "shard long, own array<long>, offset array<long>, fill array<long>")
    both = shards.join(placed, "shard").select("shard", F.explode(F.arrays_zip("items", "own", "offset", "fill")).alias("x"))
    sequence = F.shiftleft(2 * F.col("shard") + level, 24) + F.col("x.own")
    return both.select("x.items.*", sequence.alias("sequence_id"), "x.offset", "x.fill")


def pack(rows: DataFrame, shard_rows: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, crossings: int = CROSSINGS) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, and uid, different in each) with sequence_id and offset."""
    first = common.materialize(_packed_by_shard(rows, shard_rows, islands, epochs, crossings, 0), "pack-first")
    loose = first.where(F.col("fill") < LOOSE * LIMIT).select(*rows.columns)
    again = _packed_by_shard(loose, shard_rows, islands, epochs, crossings, 1)
    return first.where(F.col("fill") >= LOOSE * LIMIT).unionByName(again).drop("fill")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = common.materialize(pieces(docs, path).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
