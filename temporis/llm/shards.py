"""Counts of 64-bit keys: partial counts of each partition, sorted over all by ranges, summed by runs, kept in sorted shards.

A shard is a file of two rows of 64-bit numbers, keys in order and their counts, in the folder that driver and executors share. Where that folder is
mounted (file:) a task maps a shard into memory and touches only the pages that its searches meet; from another store it
reads one shard at a time. A file is written under a name of its attempt and then renamed, so a task that is run again
changes nothing. Shards hold about SHARD keys each, and only distinct keys, so there are few: the list of them
(first key, last key, path) is what the driver sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temporis.llm import common

#: Distinct keys of a shard, partial counts that a sorting task reads, and entries that a partition counts before it sends them.
SHARD, SORTED, HELD = 4_000_000, 2_000_000, 4_000_000


class Counter:
    """Partial counts in sorted order; `add` merges what is pending once it is as much as PENDING."""

    PENDING = 1_000_000

    def __init__(self) -> None:
        self.keys, self.counts, self.pending, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(keys)
        self.waiting += len(keys)
        if self.waiting > self.PENDING:
            self.merge()

    def merge(self) -> None:
        if self.pending:
            keys, counts = np.unique(np.concatenate(self.pending), return_counts=True)
            self.keys, self.counts = summed_runs(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
            self.pending, self.waiting = [], 0

    def taken(self) -> pa.RecordBatch:
        self.merge()
        out = _batch(self.keys, self.counts)
        self.keys = self.counts = np.zeros(0, np.int64)
        return out


def _batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])


def summed_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return (keys[starts], np.add.reduceat(counts, starts)) if len(keys) else (keys, counts)


def partial_counts(rows: DataFrame, column: str, read) -> DataFrame:
    """key, n: counts of the keys that read(cell) yields, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for cell in batch.column(column):
                counter.add(read(cell.as_py()))
                if len(counter.keys) > HELD:
                    yield counter.taken()
        yield counter.taken()

    return rows.select(column).mapInArrow(run, "key long, n long")


def totals(partial: DataFrame) -> DataFrame:
    """key, n of all distinct keys: a sort of the partial counts over all partitions by ranges of keys, then sums of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, counts = np.r_[last, batch.column("key").to_numpy()], np.r_[held, batch.column("n").to_numpy()]
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = np.add.reduceat(counts, starts)
            last, held = keys[starts[-1:]], sums[-1:]  # its run may go on in the next batch
            yield _batch(keys[starts[:-1]], sums[:-1])
        yield _batch(last, held)

    partial = common.materialize(partial, "shards-partial")
    n = max(common.partitions(partial.sparkSession), -(-partial.count() // SORTED))
    out = common.materialize(partial.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, n long"), "shards-totals")
    common.drop(partial)
    return out


class Shard(NamedTuple):
    first: int
    last: int
    path: str


def write_shards(counts: DataFrame, size: int = SHARD) -> list[Shard]:
    """The shards of distinct keys (key, n), in order of keys."""
    spark = counts.sparkSession
    folder = f"{common.shared_folder(spark)}/count-shards-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        keys, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
        if len(keys):
            task = TaskContext.get()
            store, at = fs.FileSystem.from_uri(folder)
            store.create_dir(at, recursive=True)
            path, own = f"{at}/{task.partitionId():06d}", f"{at}/.{task.partitionId():06d}-{task.taskAttemptId()}"
            with store.open_output_stream(own, compression=None) as out:
                out.write(np.stack([keys, n]).astype("<i8").tobytes())
            store.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), pa.array([int(keys[-1])]), pa.array([f"{folder}/{path.rpartition('/')[2]}"])], ["first", "last", "path"])

    parts = max(1, -(-counts.count() // size))
    listed = counts.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "first long, last long, path string")
    return sorted(Shard(*r) for r in listed.collect())  # a row a shard


def drop_shards(spark, shards: list[Shard]) -> None:
    """Delete the shards; no task may need them any more."""
    for folder in {s.path.rpartition("/")[0] for s in shards}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Lookup:
    """Counts of keys, from shards that are opened where keys fall and stay mapped while the task runs."""

    def __init__(self, shards: list[Shard]) -> None:
        self.shards, self.opened = shards, {}
        self.firsts = np.array([s.first for s in shards], np.int64)

    def _open(self, k: int) -> np.ndarray:
        if k not in self.opened:
            store, at = fs.FileSystem.from_uri(self.shards[k].path)
            if isinstance(store, fs.LocalFileSystem):
                self.opened[k] = np.memmap(at, "<i8", "r").reshape(2, -1)
            else:
                with store.open_input_file(at) as f:
                    self.opened = {k: np.frombuffer(f.read(), "<i8").reshape(2, -1)}
        return self.opened[k]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key of a sorted array; 0 of keys that no shard holds."""
        out = np.zeros(len(keys), np.int64)
        if not self.shards:
            return out
        own = np.searchsorted(self.firsts, keys, "right") - 1
        for k in np.unique(own[own >= 0]):
            a, b = np.searchsorted(own, [k, k + 1])
            held, counts = self._open(int(k))
            at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
            out[a:b] = np.where(held[at] == keys[a:b], counts[at], 0)
        return out
