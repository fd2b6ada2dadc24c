"""Census: tell each batch of documents, for each of its keys, what all batches together know of that key.

Documents are dealt to batches by doc_id and text, so a later pass over the same documents meets the same batches. A batch sends its
distinct keys (64-bit numbers, with more bits where a census needs them) in sorted order, cut to buckets by their first bits, as packed differences: one row for each batch and
bucket that has keys. A bucket's task joins the rows of all batches and answers each with one value a key, in
the order the keys came. A key sends one entry a batch however often it occurs, so a hot key costs as much as there are
batches, and the answer is small. A task holds one batch's text, or one bucket's keys; both have set sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temporis.llm import common

BATCH_BYTES, BUCKET_KEYS, GROWS_FROM = 4_000_000, 1_000_000, 500_000_000
ASKED = "bucket int, batch long, keys binary, extra binary, low binary"


class Layout:
    """How many batches and buckets the documents take.

    Rows are batches times buckets, so both grow in size as well as in number: by the fourth root of the input beyond
    GROWS_FROM bytes, 21-fold at 100 TB, where a batch is 84 MB of text and a row still packs some 17 keys.
    """

    def __init__(self, docs: DataFrame, keys_per_byte: float) -> None:
        total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
        least = common.partitions(docs.sparkSession)
        grown = max(1.0, total / GROWS_FROM) ** 0.25
        self.batches = int(max(least, -(-total // (BATCH_BYTES * grown))))
        self.bits = int(max(least, total * keys_per_byte // (BUCKET_KEYS * grown) + 1) - 1).bit_length()

    def batched(self, docs: DataFrame) -> DataFrame:
        """docs with batch, by id and text: null and repeated ids spread as others do; only rows equal in both meet in one."""
        return docs.withColumn("batch", F.pmod(F.xxhash64(F.lit(29), "doc_id", F.xxhash64("text")), F.lit(self.batches)))

    def cuts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets (first bits of a key) that sorted keys fall in, and where each begins, with the end."""
        own = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        return own[starts], np.r_[starts, len(keys)]

    def rows(self, batch: int, keys: np.ndarray, value: np.ndarray, extra: np.ndarray | None = None, state: bytes | None = None) -> pd.DataFrame:
        """What a batch asks: sorted distinct keys, more bits of each (extra), and a number of each. state comes back with the
        answers as it is, in a row of its own."""
        used, cuts = self.cuts(keys)
        part = lambda x, k: _squeeze(x[cuts[k] : cuts[k + 1]]) if x is not None else None
        out = [(int(b), batch, _squeeze(np.diff(keys[cuts[k] : cuts[k + 1]], prepend=keys.dtype.type(0))), part(extra, k), part(value, k)) for k, b in enumerate(used)]
        if state is not None:
            out.append((-1 - batch % (1 << self.bits), batch, state, None, None))
        return pd.DataFrame(out, columns=["bucket", "batch", "keys", "extra", "low"])


def distinct(keys: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """order, starts: an order of positions by (key, extra), and where in it different ones begin."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]][: len(k)]
    if extra is not None and len(k):
        e = extra[order]
        if (~new[1:] & (e[1:] != e[:-1])).any():  # equal keys of different strings
            order = np.lexsort((extra, keys))
            k, e = keys[order], extra[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (e[1:] != e[:-1])]
    return order, np.flatnonzero(new)


def answer(asked: DataFrame, reply: Callable[..., np.ndarray], kind: str) -> DataFrame:
    """batch, bucket, reply (packed by the callable's result type). reply gets the numbers of all entries in key order, the
    starts of equal keys in that order and how many each has, and returns a value for each entry."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if p.bucket.iloc[0] < 0:
            return pd.DataFrame({"batch": p.batch, "bucket": p.bucket, "reply": p["keys"]})
        own = [np.cumsum(_widen(x, "<u8"), dtype=np.uint64) for x in p["keys"]]  # sorted keys come as differences
        ends, keys = np.cumsum([len(x) for x in own]), np.concatenate(own)
        del own
        extra = np.concatenate([_widen(x, "<u4") for x in p["extra"]]) if p["extra"].notna().all() else None
        order, starts = distinct(keys, extra)
        n = len(keys)
        del keys, extra
        values = np.concatenate([_widen(x, kind) for x in p["low"]])[order]
        got = reply(values, starts, np.diff(np.r_[starts, n]))
        out = np.empty(n, got.dtype)
        out[order] = got
        parts = np.split(out, ends[:-1])
        packed = [np.packbits(x).tobytes() if x.dtype == bool else _squeeze(x) for x in parts]
        common.trim()
        return pd.DataFrame({"batch": p.batch.to_numpy(), "bucket": p.bucket.to_numpy(), "reply": packed})

    return asked.groupBy("bucket").applyInPandas(run, "batch long, bucket int, reply binary")


def pack(x: np.ndarray) -> bytes:
    return _squeeze(x)


def unpack(data: bytes, kind: str) -> np.ndarray:
    return _widen(data, kind)


def _squeeze(x: np.ndarray) -> bytes:
    """Packed numbers, byte by byte of equal weight: sorted keys differ little in their first bytes, and doc_ids too."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _widen(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _filled(replies: pd.DataFrame, layout: Layout, keys: np.ndarray, dtype, read: Callable[[bytes, int], np.ndarray]) -> np.ndarray:
    used, cuts = layout.cuts(keys)
    out = np.zeros(len(keys), dtype)
    own = replies[replies.bucket >= 0]
    for k, r in zip(np.searchsorted(used, own.bucket.to_numpy(np.int64)), own.reply, strict=True):
        out[cuts[k] : cuts[k + 1]] = read(r, int(cuts[k + 1] - cuts[k]))
    return out


def bits(replies: pd.DataFrame, layout: Layout, keys: np.ndarray) -> np.ndarray:
    """A batch's answers of one bit, in the order of its sorted keys."""
    return _filled(replies, layout, keys, bool, lambda r, n: np.unpackbits(np.frombuffer(r, np.uint8), count=n).astype(bool))


def numbers(replies: pd.DataFrame, layout: Layout, keys: np.ndarray, dtype: str) -> np.ndarray:
    """A batch's answers of whole numbers, in the order of its sorted keys."""
    return _filled(replies, layout, keys, dtype, lambda r, n: _widen(r, dtype))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit number of an ordered pair."""
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def scatter(x: np.ndarray) -> np.ndarray:
    """Different numbers for different numbers, spread evenly over 64 bits: least ranks crowd near zero, buckets are ranges."""
    x = x * _A
    x ^= x >> np.uint64(32)
    return x * _C


def slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)
