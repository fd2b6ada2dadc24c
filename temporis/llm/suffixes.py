"""Removal of repeated passages by censuses of fingerprints of byte positions, in place of prefix doubling by sorted ranks.

A position's rank of length h is a hash of the h bytes from it, computed in its batch; nothing is sorted or reranked over all
positions. Ranks double: the first 8 bytes are a number; ranks of
16, 32 and then SPAN (50) bytes are those of the pairs (position, position + offset) at offsets 8, 16 and 18.
Documents whose whole text occurs in an earlier one go first. Positions of the others go on only until they are unique,
by two censuses of ranks over all documents:

1. Each SPAN-byte string is named by the least rank of 32 bytes within it, the same wherever the string occurs. A name
   that occurs in one document only proves its strings unique there; these positions end here, most of them at once.
2. The positions left, with full ranks of SPAN bytes: those whose rank also starts in a document of smaller doc_id are
   repeated, and their SPAN bytes go, on equal ranks, without a comparison of the bytes.

Ranks are numbers computed from the pair, not dense numbers from a global sort: equal strings have equal ranks. The first
census needs 64 bits, as equal names of different strings only leave positions for the second one. There a rank has 96 bits (64 of
the pair and 32 of a linear hash of the same bytes): n positions are expected to hold n * n / 2**97 pairs of different strings
of equal rank, one in some 1,500 runs over 10**13 positions. Whole ranks never leave a batch but as distinct sorted arrays (see
census.py); a passage that a third of all documents share costs one entry a batch. A batch is named once: its places left after the
first census come back to it with the answers of the second.

Defined cases: a null text is empty; texts under SPAN bytes are kept whole; a document may repeat itself freely; rows
that repeat a doc_id are judged alike, none against the other; a null doc_id is the smallest; other columns are
ignored; an empty table gives no rows. Rows of null ids spread over batches by their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common
from temporis.llm.census import ASKED, Layout, answer, bits, distinct, mix, pack, scatter, slices, unpack

SPAN, GRAM, SLICE = 50, 32, 1 << 15
_NONE = np.iinfo(np.int64).min
#: Where 8 bytes are read so that all SPAN are, and the odd numbers that they are multiplied by.
_READ = (0, 8, 16, 24, 18, 26, 34, 42)
_ODD = np.random.default_rng(0xC0DE).integers(0, 1 << 63, len(_READ), np.uint64) << np.uint64(1) | np.uint64(1)


class Batch:
    """The texts of a batch, end to end, in order of doc_id; positions are those from which SPAN bytes lie in one text.

    Names are kept as runs: neighbouring positions of a text mostly share theirs.
    """

    def __init__(self, p: pd.DataFrame, earlier: set[str], named: bool = True) -> None:
        p = p.assign(_id=p.doc_id.fillna(_NONE).astype("int64")).sort_values(["_id", "text"], kind="stable")
        self.lengths = p.text.map(len).to_numpy(np.int64)
        digests = p.text.map(lambda t: hashlib.md5(t).hexdigest())
        first = p["_id"].groupby(digests).transform("min")  # a null doc_id is the smallest
        copy = (digests.isin(earlier) & p.doc_id.notna() | (p["_id"] > first)).to_numpy() & (self.lengths >= SPAN)
        self.copies, self.rows, self.lengths = p[copy], p[~copy], self.lengths[~copy]
        self.ids = self.rows["_id"].to_numpy()
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.bytes = np.frombuffer(b"".join(self.rows.text) + bytes(2 * SPAN), np.uint8)
        self.n = int(self.starts[-1])
        self.eight = np.ndarray((self.n + SPAN,), "<u8", self.bytes, 0, (1,))  # rank of 8 bytes: overlapping views
        if named:
            self._name()

    def _name(self) -> None:
        whose = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        left = self.starts[1:][whose] - np.arange(self.n)
        first, names, docs, sizes = [], [], [], []
        for a, b in slices(self.n, SLICE):
            inside = np.flatnonzero(left[a:b] >= SPAN)
            if not len(inside):
                continue
            eight = self.eight[a : b + SPAN].copy()
            sixteen = mix(eight[:-8], eight[8:])
            gram = mix(sixteen[: b - a + SPAN - GRAM], sixteen[GRAM - 16 : b - a + SPAN - 16])
            width = 1
            while width < SPAN - GRAM + 1:  # least of `width` neighbours, doubled up to the window
                step = min(width, SPAN - GRAM + 1 - width)
                gram = np.minimum(gram[:-step], gram[step:])
                width += step
            n, w = gram[inside], whose[a:b][inside]
            run = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (w[1:] != w[:-1])])
            first.append(a + inside[run])
            names.append(n[run])
            docs.append(w[run])
            sizes.append(np.diff(np.r_[run, len(n)]))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.run_at, self.run_name, self.run_doc, self.run_size = join(first, np.int64), scatter(join(names, np.uint64)), join(docs, np.int32), join(sizes, np.int64)

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, whether each is in several documents, and the number of each run's name."""
        order, starts = distinct(self.run_name)
        ids = self.ids[self.run_doc][order]
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        return self.run_name[order][starts], several, number

    def left(self, shared: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places and sizes of the runs whose name is shared."""
        keep = shared[number]
        return self.run_at[keep], self.run_size[keep]

    def ranks(self, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in these runs, their ranks and more bits of these, and doc_ids."""
        at = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else first, sizes) + np.arange(sizes.sum())
        rank, extra = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
        for a, b in slices(len(at), SLICE):
            read = [self.eight[at[a:b] + k] for k in _READ]
            pairs = [mix(x, y) for x, y in zip(read[::2], read[1::2], strict=True)]
            rank[a:b] = mix(mix(*pairs[:2]), mix(*pairs[2:]))
            extra[a:b] = sum(x * odd for x, odd in zip(read, _ODD, strict=True)) >> np.uint64(32)
        return at, rank, extra, self.ids[np.searchsorted(self.starts, at, "right") - 1]


def _shared(several, starts, lengths):
    """An entry's name occurs in more than one document: of different batches, or of one."""
    return np.repeat((lengths > 1) | (np.maximum.reduceat(several, starts) > 0), lengths)


def _earlier(low, starts, lengths):
    """An entry's rank occurs in a document before the batch's own first."""
    return np.repeat(np.minimum.reduceat(low, starts), lengths) < low


def earlier_texts(dealt: DataFrame) -> DataFrame:
    """batch, digests: of a batch's texts those whose whole text occurs in another batch in a document of smaller doc_id.

    Digests are summed up by batch before they are joined, so copies of one text are as many rows as there are batches.
    """
    known = dealt.where("doc_id is not null").groupBy(F.md5("text").alias("digest"), "batch").agg(F.min("doc_id").alias("own"))
    firsts = known.groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = known.join(firsts, "digest").where("own > first")
    return later.groupBy("batch").agg(F.collect_set("digest").alias("digests"))  # no more than a batch has texts


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left), spans: array of (start, end) of what was removed."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    layout = Layout(texts, 0.25)
    dealt = layout.batched(texts)
    none = lambda kind: F.lit(None).cast(kind)
    copies = earlier_texts(dealt).select("batch", none("int").alias("bucket"), none("binary").alias("reply"), F.lit(0).alias("kind"), "digests")
    known = common.materialize(copies, "suffix-copies")

    def opened(p: pd.DataFrame, r: pd.DataFrame, named: bool = True) -> Batch:
        return Batch(p, {d for own in r[r.kind == 0].digests for d in own}, named)

    none_asked = pd.DataFrame({"bucket": [], "batch": [], "keys": [], "extra": [], "low": []})

    def ask_names(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return none_asked
        names, several, _ = opened(p, r).names()
        return layout.rows(int(p.batch.iloc[0]), names, several.astype(np.uint8))

    def ranked(batch: Batch, first: np.ndarray, sizes: np.ndarray):
        """Places left, the order of their ranks, where in it different ones begin, and doc_id, rank and more bits by it."""
        at, rank, extra, ids = batch.ranks(first, sizes)
        order, starts = distinct(rank, extra)
        return at, order, starts, ids[order], rank[order][starts], extra[order][starts]

    def ask_ranks(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return none_asked
        batch = opened(p, r)
        names, _, number = batch.names()
        first, sizes = batch.left(bits(r[r.kind == 1], layout, names), number)
        _, _, starts, ids, rank, extra = ranked(batch, first, sizes)
        low = np.minimum.reduceat(ids, starts) if len(starts) else ids
        return layout.rows(int(p.batch.iloc[0]), rank, low, extra, pack(np.r_[len(first), np.diff(first, prepend=0), sizes]))

    def told(asked: DataFrame, reply, kind: str, number: int) -> DataFrame:
        return answer(asked, reply, kind).select("batch", "bucket", "reply", F.lit(number).alias("kind"), none("array<string>").alias("digests"))

    for number, (ask, reply, kind) in enumerate(((ask_names, _shared, "u1"), (ask_ranks, _earlier, "<i8")), 1):
        asked = dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(ask, ASKED)
        found = common.materialize(told(asked, reply, kind, number), f"suffix-replies-{number}")
        known = known.where("kind = 0").unionByName(found)  # the second answers hold what was left after the first

    def cut(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "kept": [], "spans": []})
        batch = opened(p, r, named=False)
        r = r[r.kind == 2]
        state = unpack(r[r.bucket < 0].reply.iloc[0], "<i8")
        runs = int(state[0])
        first, sizes = np.cumsum(state[1 : runs + 1]), state[runs + 1 :]
        places, order, starts, ids, rank, _ = ranked(batch, first, sizes)
        low = np.minimum.reduceat(ids, starts) if len(starts) else ids
        n = np.diff(np.r_[starts, len(order)])
        gone = places[order[(ids > np.repeat(low, n)) | np.repeat(bits(r, layout, rank), n)]]
        edge = np.zeros(batch.n + SPAN + 1, np.int32)
        edge[gone] += 1  # places are distinct
        edge[gone + SPAN] -= 1
        covered = np.cumsum(edge)[: batch.n] > 0
        kept, spans = [], []
        for a, b in zip(batch.starts, batch.starts[1:], strict=False):
            c = np.diff(np.r_[0, covered[a:b].astype(np.int8), 0])
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(c == 1), np.flatnonzero(c == -1), strict=True)])
            kept.append(batch.bytes[a:b][~covered[a:b]].tobytes())
        out = pd.DataFrame({"doc_id": batch.rows.doc_id.to_numpy(), "n_bytes": batch.lengths, "kept": kept, "spans": spans})
        lengths = batch.copies.text.map(len).to_numpy(np.int64)
        whole = pd.DataFrame({"doc_id": batch.copies.doc_id.to_numpy(), "n_bytes": lengths, "kept": [b""] * len(lengths), "spans": [[{"start": 0, "end": int(n)}] for n in lengths]})
        return pd.concat([out, whole]) if len(whole) else out

    both = dealt.groupBy("batch").cogroup(known.groupBy("batch"))
    return both.applyInPandas(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
