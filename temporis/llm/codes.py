"""Vector code compression: one byte a part, by codebooks that Heap Lloyd refines.

Each component becomes floor(256 * x); a vector is cut into 16 equal consecutive parts, and each part position has a
codebook of whole-number entries. The first assignment compares every part with every entry and keeps two bounds: the distance to
its own entry (upper) and to the next one (lower). Each block of vectors has a heap for each entry of each position, keyed by lower
minus upper plus what that entry had drifted by then. After an update an entry's own drift, and the largest drift of the others,
are added to what it has drifted; only parts whose key that sum has reached can have another nearest entry, so
only they are popped, compared with all entries anew, and pushed on the heap of the entry they then have. Others are never looked at. Bounds
are rounded towards popping, and comparing is in whole numbers, so the result is that of plain Lloyd rounds.

A block is an Arrow batch of rows of one partition, at most a few MB with its heaps. Blocks are written to the shared folder after
each assignment, so a lost executor costs its tasks only. An assignment sends what parts joined or left each entry: a row for each entry's
component and partition, summed by Spark to 16 * 64 * (components + 1) numbers, the only ones that the driver sees.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part, nor do vectors of another length than that of the
smallest vec_id; a length that isn't a multiple of 16 is filled up with zeros to one, which no result shows; with fewer than
64 kept rows each starts an entry; among equal vec_ids the smaller vector starts the earlier entry, null vec_ids come last; repeated
rows are rows of their own; zero vectors are vectors; null labels are one label; a component whose whole number has 24 bits or more is an error; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components below this keep every distance exact in 64-bit floats.
LARGEST = 1 << 24
_BLOCK = "ids array<long>, labels array<{}>, x binary, sizes binary, members binary, keys binary, moved binary, looked long"


class Books(NamedTuple):
    """entries[part, entry, component], and how far each entry's bounds have drifted since the first assignment."""

    entries: np.ndarray
    drifted: np.ndarray

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """Entries at the means of their parts, rounded down; unused ones stay."""
        used = np.maximum(counts, 1)[:, :, None]
        entries = np.where(counts[:, :, None] > 0, np.floor_divide(sums, used), self.entries)
        moved = np.sqrt(((entries - self.entries) ** 2).sum(2).astype(float))
        first = moved.argmax(1)
        others = np.repeat(moved.max(1)[:, None], moved.shape[1], 1)
        rest = moved.copy()
        rest[np.arange(len(moved)), first] = 0
        others[np.arange(len(moved)), first] = rest.max(1)
        return Books(entries, self.drifted + moved + others)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, whole numbers held exactly by floats."""
    a, c = x.astype(float), entries.astype(float)
    return (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower), and lower minus upper bound."""
    far = _distances(x, entries)
    own = far.argmin(1)
    at = np.arange(len(x))
    upper = far[at, own]
    far[at, own] = np.inf
    return own, np.sqrt(far.min(1)) - np.sqrt(upper)


class Block:
    """The vectors of one Arrow batch and their heaps: heaps[part][entry] is a list of (key, member) in heap order."""

    def __init__(self, x: np.ndarray, heaps: list[list[list[tuple[float, int]]]]) -> None:
        self.x, self.heaps = x, heaps  # x[member, part, component]

    @classmethod
    def assigned(cls, x: np.ndarray, books: Books) -> tuple[Block, np.ndarray]:
        """A block whose parts are all compared with all entries, and the sums and counts of the entries."""
        block, moved = cls(x, []), _nothing(books)
        for p in range(x.shape[1]):
            own, slack = _nearest(x[:, p], books.entries[p])
            keys = _down(slack + books.drifted[p][own])
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(books.entries[p]) + 1))
            heaps = [list(zip(keys[order[a:b]].tolist(), order[a:b].tolist(), strict=True)) for a, b in zip(cuts, cuts[1:], strict=False)]
            for heap in heaps:
                heapify(heap)
            block.heaps.append(heaps)
            _add(moved[p], own, x[:, p], 1)
        return block, moved

    def reassign(self, books: Books) -> tuple[np.ndarray, int]:
        """Pop the parts whose bounds the drift has violated and look at them again: what entries gained, and how many were looked at."""
        moved, looked = _nothing(books), 0
        for p, heaps in enumerate(self.heaps):
            reach = books.drifted[p] * (1 + 1e-9) + 1e-6
            popped, left = [], []
            for j, heap in enumerate(heaps):
                while heap and heap[0][0] <= reach[j]:
                    popped.append(heappop(heap)[1])
                    left.append(j)
            if not popped:
                continue
            looked += len(popped)
            x = self.x[popped, p]
            own, slack = _nearest(x, books.entries[p])
            for key, member, j in zip(_down(slack + books.drifted[p][own]).tolist(), popped, own.tolist(), strict=True):
                heappush(heaps[j], (key, member))
            _add(moved[p], own, x, 1)
            _add(moved[p], np.array(left), x, -1)
        return moved, looked

    def codes(self) -> np.ndarray:
        out = np.zeros(self.x.shape[:2], np.uint8)
        for p, heaps in enumerate(self.heaps):
            for j, heap in enumerate(heaps):
                out[[member for _, member in heap], p] = j
        return out

    def packed(self, moved: np.ndarray, looked: int) -> tuple:
        flat = [item for heaps in self.heaps for heap in heaps for item in heap]
        sizes = np.array([len(heap) for heaps in self.heaps for heap in heaps], "<i4")
        kind = "<i2" if np.abs(self.x).max(initial=0) < 1 << 15 else "<i4"
        keys, members = np.array([k for k, _ in flat], "<f4"), np.array([m for _, m in flat], "<i4")
        return kind.encode() + self.x.astype(kind).tobytes(), sizes.tobytes(), members.tobytes(), keys.tobytes(), moved.tobytes(), looked

    @classmethod
    def unpacked(cls, row: dict, parts: int, n: int) -> Block:
        x = np.frombuffer(row["x"][3:], row["x"][:3].decode()).reshape(n, parts, -1).astype(np.int64)
        sizes = np.frombuffer(row["sizes"], "<i4")
        items = list(zip(np.frombuffer(row["keys"], "<f4").tolist(), np.frombuffer(row["members"], "<i4").tolist(), strict=True))
        ends = np.cumsum(sizes)
        heaps = [items[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        entries = len(heaps) // parts
        return cls(x, [heaps[p * entries : (p + 1) * entries] for p in range(parts)])


def _nothing(books: Books) -> np.ndarray:
    """Sums of components, then a count, of each entry."""
    p, k, d = books.entries.shape
    return np.zeros((p, k, d + 1), np.int64)


def _add(moved: np.ndarray, own: np.ndarray, x: np.ndarray, sign: int) -> None:
    np.add.at(moved, own, sign * np.c_[x, np.ones(len(x), np.int64)])


def _down(keys: np.ndarray) -> np.ndarray:
    """Keys as 32-bit floats, never above what they were."""
    short = keys.astype(np.float32)
    return np.where(short > keys, np.nextafter(short, np.float32(-np.inf)), short)


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (array of bigint) of the rows that take part, whatever the length of their vectors."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e")).where(F.size("e") > 0).where(~F.exists("e", bad))
    return kept.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * SCALE)).alias("v"))


def _cut(v: np.ndarray, parts: int) -> np.ndarray:
    """[row, part, component] of rows of components, filled up with zeros."""
    if np.abs(v).max(initial=0) >= LARGEST:
        raise ValueError(f"components beyond {LARGEST} whole units can't be compared exactly")
    width = -(-v.shape[1] // parts) * parts
    return np.pad(v, ((0, 0), (0, width - v.shape[1]))).reshape(len(v), parts, width // parts)


def _summed(state: DataFrame, books: Books) -> tuple[np.ndarray, int]:
    """What entries gained in all blocks, and how many parts were looked at."""
    shape = books.entries.shape[:2] + (books.entries.shape[2] + 1,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, looked = np.zeros(int(np.prod(shape)), np.int64), 0
        for batch in batches:
            for moved, n in zip(batch.column("moved"), batch.column("looked"), strict=True):
                total += np.frombuffer(moved.as_py(), np.int64)
                looked += n.as_py()
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[slots, -1].astype(np.int32)), pa.array(np.r_[total[slots], looked])], ["slot", "n"])

    rows = state.select("moved", "looked").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, looked = np.zeros(int(np.prod(shape)), np.int64), 0
    for slot, n in rows:  # a number for each component of each entry
        if slot < 0:
            looked = n
        else:
            out[slot] = n
    return out.reshape(shape), looked


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, label, code (binary, a byte a part), error of each kept row of embeddings (vec_id, embedding, label); the codebooks
    [part, entry, component], filled up as vectors are; and how many parts each round after the first assignment looked at."""
    if entries > 256:
        raise ValueError("a code is a byte: at most 256 entries")
    kept = whole_numbers(rows)
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = kept.orderBy(*order).first()
    dim = len(first["v"]) if first else parts
    kept = kept.where(F.size("v") == dim)
    seeds = np.array([r["v"] for r in kept.orderBy(*order).limit(entries).collect()], np.int64).reshape(-1, dim)  # 64 rows
    books = Books(cut := _cut(seeds, parts).transpose(1, 0, 2).copy(), np.zeros(cut.shape[:2]))
    rounds = rounds if len(seeds) else 0
    label = dict(rows.dtypes)["label"]
    schema = _BLOCK.format(label)

    def row_of(ids: pa.Array, labels: pa.Array, packed: tuple) -> pa.RecordBatch:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([one(ids), one(labels), *(pa.array([b]) for b in packed)], ["ids", "labels", "x", "sizes", "members", "keys", "moved", "looked"])

    def begin(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                x = _cut(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim), parts)
                block, moved = Block.assigned(x, books)
                yield row_of(batch.column("vec_id"), batch.column("label"), block.packed(moved, n * parts))

    def again(books: Books):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, row in enumerate(batch.drop_columns(["ids", "labels"]).to_pylist()):
                    ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                    block = Block.unpacked(row, parts, len(ids))
                    yield row_of(ids, labels, block.packed(*block.reassign(books)))

        return run

    def end(books: Books):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, row in enumerate(batch.drop_columns(["ids", "labels"]).to_pylist()):
                    ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                    codes = Block.unpacked(row, parts, len(ids))
                    x, codes = codes.x, codes.codes()
                    off = x - books.entries[np.arange(parts), codes]
                    raw = codes.tobytes()
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary()), pa.array((off * off).sum((1, 2)))], ["vec_id", "label", "code", "error"])

        return run

    state = common.materialize(kept.select(F.col("vec_id").cast("long"), "label", "v").mapInArrow(begin, schema), "codes-blocks")
    total, looked = np.zeros_like(_nothing(books)), []
    for number in range(rounds):
        gained, n = _summed(state, books)
        total += gained
        looked += [n] if number else []
        books = books.updated(total[:, :, :-1], total[:, :, -1])
        state = common.replace(state, state.mapInArrow(again(books), schema), "codes-blocks")
    looked += [_summed(state, books)[1]] if rounds else []
    out = common.materialize(state.mapInArrow(end(books), f"vec_id long, label {label}, code binary, error long"), "codes-rows")
    common.drop(state)
    return out, books.entries, looked


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over equal labels, nulls together.

    A label that holds more than a share of the rows (one in as many as there are shuffle partitions) meets its sum by broadcast, of fewer rows
    than partitions; all others go through a join, in which none is hot.
    """
    share = coded.count() / common.partitions(coded.sparkSession)
    sums = common.materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("label", "_label"), "codes-labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    often = F.broadcast(sums.where(F.col("_n") > share))
    near = coded.join(often, same, "left")
    seldom = near.where("_n is null").drop("_label", "label_error", "_n").join(sums.where(F.col("_n") <= share), same)
    return near.where("_n is not null").unionByName(seldom).drop("_label", "_n")


def digest(entries: np.ndarray, dim: int) -> str:
    """SHA-256 of all components in decimal, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, entries[:, :, : max(1, dim // len(entries))].ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of embeddings."""
    coded, entries, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    out = with_label_error(coded)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(entries, entries.shape[0] * entries.shape[2])).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the entries of round k, and the entries of the next."""
    return f"""a{k} AS (SELECT r, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 64 + j) AS m FROM parts JOIN c{k} USING (p) GROUP BY r, p),
u{k} AS (SELECT p, j, list(s ORDER BY i) AS n FROM (SELECT p, m % 64 AS j, i, floor(sum(x[i]) / count(*)) AS s FROM a{k} JOIN parts USING (p, r), (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS (SELECT p, j, coalesce(n, c) AS c FROM c{k} LEFT JOIN u{k} USING (p, j))"""


ORACLE = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT CAST(any_value(len(v)) // 16 AS BIGINT) AS w FROM kept),
parts AS (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, width, range(16) t(p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY j < 64),
c0 AS (SELECT p, j, x AS c FROM parts JOIN seeds USING (r)),
{_round_sql(0)},
{_round_sql(1)},
a2 AS (SELECT r, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 64 + j) AS m FROM parts JOIN c2 USING (p) GROUP BY r, p),
done AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN done USING (r), sha"""
