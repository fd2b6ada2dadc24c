"""Prefix doubling by Spark's own joins and sorts: the plain form of what suffixes.py does by censuses of fingerprints.

A row for each byte position: its place and its rank, at first the 8 bytes from it as a number. At offsets 8, 16 and 18 ranks
become those of 16, 32 and SPAN bytes: a position's rank is paired with that of the position an offset further on (a join),
equal pairs come together and get one new rank, the number of the smallest position that has them. Positions whose pair occurs in one
document only are unique from there on and leave: a longer string from them is unique too. Ranks are exact, no bytes are hashed.

Every byte is a row that is shuffled for each join and each sort, which is why op2_suffix_dedup does not run on it (README has the
figures); for small tables it is the exact answer, against which tests hold the other.

Defined cases: as in suffixes.remove_repeats; rows of a null doc_id count as one document, the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temporis.llm import common

SPAN, OFFSETS = 50, (8, 16, 18)
_NONE = np.iinfo(np.int64).min


def positions(texts: DataFrame) -> DataFrame:
    """row, doc, at, rank, pos: every position of the texts that hold SPAN bytes, with the 8 bytes there and a number of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row, doc, text in zip(p["row"], p.doc, p.text, strict=True):
                if len(text) >= SPAN:
                    rank = np.ndarray((len(text) - 7,), ">i8", np.frombuffer(text, np.uint8), 0, (1,)).astype(np.int64)
                    yield pd.DataFrame({"row": row, "doc": doc, "at": np.arange(len(rank)), "rank": rank})

    return texts.mapInPandas(run, "row long, doc long, at long, rank long").withColumn("pos", F.monotonically_increasing_id())


def reranked(ranks: DataFrame, offset: int) -> DataFrame:
    """Positions by the pair of their rank and that an offset further on; those whose pair is in one document only are left out."""
    after = ranks.select("row", (F.col("at") - offset).alias("at"), F.col("rank").alias("then"))
    pairs = common.materialize(ranks.select("row", "doc", "at", "pos", "rank").join(after, ["row", "at"]), "doubling-pairs")
    names = pairs.groupBy("rank", "then").agg(F.min("pos").alias("name"), F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    out = pairs.join(names, ["rank", "then"]).select("row", "doc", "at", "pos", F.col("name").alias("rank"), "first")
    return common.materialize(out, "doubling-ranks")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left), spans: array of (start, end) of what was removed."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce("doc_id", F.lit(_NONE)).alias("doc"))
    texts = common.materialize(texts.withColumn("row", F.monotonically_increasing_id()), "doubling-texts")
    ranks = common.materialize(positions(texts.select("row", "doc", "text")), "doubling-ranks")
    for offset in OFFSETS:
        ranks = reranked(ranks, offset)
    gone = ranks.where("doc > first").groupBy("row").agg(F.collect_list("at").alias("gone"))  # as many as the document has bytes

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for i, text, at in zip(p.doc_id, p.text, p.gone, strict=True):
                edge = np.zeros(len(text) + SPAN + 1, np.int32)
                if at is not None:
                    edge[at] += 1
                    edge[np.asarray(at) + SPAN] -= 1
                covered = np.cumsum(edge)[: len(text)] > 0
                c = np.diff(np.r_[0, covered.astype(np.int8), 0])
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(c == 1), np.flatnonzero(c == -1), strict=True)]
                out.append((i, len(text), np.frombuffer(text, np.uint8)[~covered].tobytes(), spans))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "kept", "spans"]).astype({"doc_id": "Int64"})

    both = texts.join(gone, "row", "left").select("doc_id", "text", "gone")
    return both.mapInPandas(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
