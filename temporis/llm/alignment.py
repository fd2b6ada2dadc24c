"""Cross-tokenizer alignment: which tokens of one public tokenizer overlap which of another, and in how many documents.

Tokenizer A is byte-level and reads a space and the text; B reads the text and puts a space before it. Each token is a run of bytes of that
same string, so the ends of tokens, as running sums of their lengths, are compared by sorting: where both end a group ends, and between any two
neighbouring ends lies the overlap of just one token of A with one of B, which is a link. A link's key packs both ids in 64 bits.

A document's distinct keys are counted by np.unique, partition by partition; shards.py sorts the partial counts over all partitions,
sums them and writes sorted shards, in which each document's keys are then looked up by binary search in mapped memory. The highest count
of each id of A is a number for each entry of its vocabulary. Texts are read once: what a document's tokens gave is written as a table, its distinct keys as
packed differences.

A is encoded from the same vocabulary as ranks, four times as fast; texts with very long runs of white space, which
that encoder can't read, go to the other. Both give the same ids.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens: numbers are
0 and groups the empty string; repeated rows and ids are documents of their own, null ids too; texts of any length are read whole; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import census, common, shards

#: Bytes of text whose tokens are held at once (a longer text is held whole), and keys looked up at once.
CHUNK, KEYS = 1_000_000, 1_000_000
#: White space in a row from which the rank encoder isn't used.
LONG_SPACE = re.compile(r"\s{5000}")
_SPACE = "▁"


class Sides:
    """Both tokenizers in one worker."""

    def __init__(self, ranks: str, vocabulary: str, pieces: str) -> None:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.vocabulary, self.slow = vocabulary, None
        self.piece = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [b""] * (max(known.values()) + 2)
        for token, k in known.items():
            self.bytes_a[k] = token
        self.bytes_b = [self._bytes_of(k) for k in range(self.piece.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.said = [f"{k}{mark}".encode() for k in range(most) for mark in ("", ",", "|", ";")]  # an id and what follows it

    def _bytes_of(self, k: int) -> bytes:
        piece = self.piece.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.piece.is_byte(k) else piece.replace(_SPACE, " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        if not LONG_SPACE.search(text):
            return self.byte.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
            self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.piece.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def _sides(ranks: str, vocabulary: str, pieces: str) -> Sides:
    return Sides(ranks, vocabulary, pieces)


_DIGEST = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]


def align_texts(texts: list[str | None], sides: Sides) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, distinct link keys in order, and how often each occurs, of each text."""
    out: list[tuple] = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    asked = [k for k, t in enumerate(texts) if t]
    a_s, b_s, own, sizes = [], [], [], []
    for k, b in zip(asked, sides.encode_b([texts[k] for k in asked]) if asked else [], strict=True):
        raw = " " + texts[k]
        a, whole = sides.encode_a(raw), raw.encode()
        if b"".join([sides.bytes_a[x] for x in a.tolist()]) == whole == b"".join([sides.bytes_b[x] for x in b.tolist()]):
            own.append(k), a_s.append(a), b_s.append(b), sizes.append(len(whole))
    if not own:
        return out
    a, b = np.concatenate(a_s), np.concatenate(b_s)
    ends_a, ends_b, ends = np.cumsum(sides.sizes_a[a]), np.cumsum(sides.sizes_b[b]), np.cumsum(sizes)
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    again = np.r_[False, both[1:] == both[:-1]]
    groups, links = both[again], both[~again]
    keys = a[np.searchsorted(ends_a, links)] << 32 | b[np.searchsorted(ends_b, links)]
    doc = np.searchsorted(ends, links)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    times = np.diff(np.r_[starts, len(keys)])
    cuts = np.searchsorted(doc[starts], np.arange(len(own) + 1))
    # ids in order of their groups, A's before B's, each with the mark that follows it
    of_a, of_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
    said = np.empty(len(a) + len(b), np.int64)
    said[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = 4 * a + np.where(np.r_[of_a[1:] == of_a[:-1], False], 1, 2)
    said[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = 4 * b + np.where(np.r_[of_b[1:] == of_b[:-1], False], 1, np.where(np.isin(ends_b, ends), 0, 3))
    n_groups, n_links = np.diff(np.searchsorted(groups, np.r_[0, ends], "right")), np.bincount(doc, minlength=len(own))
    at = np.cumsum([0] + [len(x) + len(y) for x, y in zip(a_s, b_s, strict=True)])
    for j, k in enumerate(own):
        sha = hashlib.sha256(b"".join([sides.said[c] for c in said[at[j] : at[j + 1]].tolist()])).hexdigest()
        x, y = cuts[j], cuts[j + 1]
        out[k] = (len(a_s[j]), len(b_s[j]), int(n_groups[j]), int(n_links[j]), sha, keys[starts[x:y]], times[x:y])
    return out


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return census.pack(numbers.astype(kind)) if len(numbers) else b""


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return census.unpack(data, kind).astype(np.int64) if data else np.zeros(0, np.int64)


def read_keys(data: bytes) -> np.ndarray:
    """Sorted keys are held as differences."""
    return np.cumsum(_unpacked(data, "<i8"))


def linked(docs: DataFrame, ranks: str | None = None, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times of each document, written as a table."""
    import public_tokenizers

    paths = (ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*paths)
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1, len(sizes)]) if len(sizes) else []
            for x, y in zip(cuts, cuts[1:], strict=False):
                found = align_texts(batch.column("text")[x:y].to_pylist(), sides)
                rows = [(*f[:5], _packed(np.diff(f[5], prepend=0), "<i8"), _packed(f[6], "<i4")) for f in found]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*(pa.int64(),) * 4, pa.string(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[x:y], *columns], ["doc_id", *_DIGEST])
        common.trim()

    texts = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    return common.materialize(common.spread(texts).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"), "alignment-links")


def looked_up(found: DataFrame, kept: list[shards.Shard], best: np.ndarray) -> DataFrame:
    """found with n_best and count_sum, by the shards of counts and the highest count of each id of A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shards.Lookup(kept)
        for batch in batches:
            n = batch.num_rows
            sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
            data, times = batch.column("keys"), batch.column("times")
            a = 0
            while a < n:  # as many documents as hold about KEYS keys
                keys, often, size, b = [], [], 0, a
                while b < n and (b == a or size < KEYS):
                    keys.append(read_keys(data[b].as_py()))
                    often.append(_unpacked(times[b].as_py(), "<i4"))
                    size, b = size + len(keys[-1]), b + 1
                every, ends = np.concatenate(keys), np.cumsum([0, *map(len, keys)])
                once, back = np.unique(every, return_inverse=True)
                counts, k = lookup(once)[back], np.concatenate(often)
                of_best = k * (counts == best[every >> 32])
                sums[a:b], bests[a:b] = (np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (k * counts, of_best))
                a = b
            plain = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*plain[:5], pa.array(bests), pa.array(sums), plain[5]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, ranks: str | None = None, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document. Paths of the tokenizers' files are parameters."""
    spark = docs.sparkSession
    found = linked(docs, ranks, vocabulary, pieces)
    counts = shards.totals(shards.partial_counts(found, "keys", read_keys))
    tops = counts.groupBy(F.shiftright("key", 32).cast("int").alias("a")).agg(F.max("n").alias("n")).collect()  # a row an entry of A's vocabulary
    best = np.zeros(max((r["a"] for r in tops), default=0) + 1, np.int64)
    for a, n in tops:
        best[a] = n
    kept = shards.write_shards(counts)
    out = common.materialize(looked_up(found, kept, best), "alignment-rows")
    common.drop(found, counts)
    shards.drop_shards(spark, kept)
    return out


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of documents."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
