"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words and their 4 and 5 letter prefixes (so that inflected insults share a term),
hashed to 2**BITS buckets. Training takes at most TRAIN_ROWS labelled rows outside the held-out fold (a documented
bound). Buckets whose class frequencies differ by SCREEN standard errors or more keep a weight, at most FEATURES of them. So do buckets that
matter only together: of the CANDIDATES most frequent ones all pairs are counted, and a pair whose rows are dealt to the classes otherwise than its
two buckets' own frequencies say, by LIFT times what pairs usually stray, brings both in, at most PAIRS pairs.
Of all of these the machine learns linear weights and pairwise interactions as factors of rank RANK.

score = sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)).

Defined cases: a null doc_id is not held out; training takes one of the rows that repeat a doc_id; a null or empty text scores as the bias alone; texts of any length are scored whole; repeated rows
score alike; other columns are ignored. With no labels, or labels of one class, every score is the smoothed base rate.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common

BITS, TRAIN_ROWS, FEATURES, SCREEN, RANK = 18, 20_000, 1024, 2.5, 6
CANDIDATES, PAIRS, LIFT, PAIR_ROWS = 2048, 256, 8.0, 20
#: Candidates whose pairs with all others are screened at once.
STRIPE = 128
EPOCHS, BATCH, RATE, DECAY, SEED = 15, 128, 0.1, 1e-4, 7
_WORDS = re.compile(r"[^\W\d_]+").findall
_CACHE_MAX = 100_000


class Terms:
    """Buckets of a text's terms; remembers those of frequent words up to a fixed number."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        mask = (1 << BITS) - 1
        terms = {word} | {f"{word[:n]}~" for n in (4, 5) if len(word) >= n}
        out = tuple(zlib.crc32(t.encode()) & mask for t in sorted(terms))
        if len(self.known) < _CACHE_MAX:
            self.known[word] = out
        return out

    def __call__(self, text: str) -> np.ndarray:
        known, found = self.known, set()
        for word in set(_WORDS(text.lower())):
            found.update(known.get(word) or self.of_word(word))
        return np.fromiter(found, np.int64, len(found))


def _screen(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Buckets whose document frequency differs between the classes (counts: 2 x buckets)."""
    smooth = counts + 0.5
    z = np.log(smooth[1] / (rows[1] + 1)) - np.log(smooth[0] / (rows[0] + 1))
    z = np.abs(z) / np.sqrt(1 / smooth[0] + 1 / smooth[1])
    z[counts.sum(0) < 5] = 0
    best = np.lexsort((np.arange(len(z)), -z))[:FEATURES]
    return np.sort(best[z[best] >= SCREEN])


def _strays(own: np.ndarray, a: int, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i, j of candidates that are frequent enough, i of those from a on, and how far each strays. own: rows of each class that hold both of a
    pair (2 x some candidates x candidates), counts: that hold one.

    In each class a pair is expected as often as its buckets' frequencies say. How a pair's rows should then be dealt to the two classes is a share;
    how far they stray from it is counted in standard errors of that share.
    """
    own = own.astype(float)
    expected = counts[:, a : a + STRIPE, None] * counts[:, None, :] / np.maximum(rows, 1)[:, None, None]
    n, usual = own.sum(0), expected.sum(0)
    share = expected[1] / np.maximum(usual, 1e-9)
    at = np.triu((n >= PAIR_ROWS) | (expected.min(0) >= PAIR_ROWS), 1 + a) & (share > 0) & (share < 1)
    i, j = np.nonzero(at)
    m, s = np.maximum(n, usual)[i, j], share[i, j]
    return (i + a).astype(np.int32), j.astype(np.int32), ((own[1][i, j] - n[i, j] * s) / np.sqrt(m * s * (1 - s))).astype(np.float32)


def _interacting(i: np.ndarray, j: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Candidates of the pairs that stray by LIFT times what pairs usually do, as long texts hold many pairs."""
    if not len(z):
        return np.zeros(0, np.int64)
    middle = np.median(z)
    usual = max(1.0, 1.4826 * np.median(np.abs(z - middle)))
    z = np.abs(z - middle) / usual
    best = np.lexsort((j, i, -z))[:PAIRS]
    best = best[z[best] >= LIFT]
    return np.unique(np.r_[i[best], j[best]]).astype(np.int64)


def _log_odds(i: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> float:
    """Log-odds of one row, given as its feature numbers."""
    own = v[i]
    return b + w[i].sum() + 0.5 * ((own.sum(0) ** 2).sum() - (own**2).sum())


def log_odds(x: list[np.ndarray], model: dict) -> np.ndarray:
    return np.array([_log_odds(np.sort(i), model["w"], model["v"], model["b"]) for i in x])


def train_machine(x: list[np.ndarray], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias by AdaGrad on logistic loss; x has the feature numbers of each row."""
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, RANK))
    b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    gw, gv = np.full(n, 1e-3), np.full((n, RANK), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            m = np.zeros((len(rows), n))
            for k, r in enumerate(rows):
                m[k, x[r]] = 1
            sums = m @ v
            z = b + m @ w + 0.5 * ((sums**2).sum(1) - (m @ v**2).sum(1))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            each = m.T @ slope
            dw = DECAY * w + each
            dv = DECAY * v + m.T @ (slope[:, None] * sums) - each[:, None] * v
            gw += dw**2
            gv += dv**2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
    return w, v, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> dict:
    """Train on a bounded sample; the model is a dict of arrays of at most FEATURES rows."""
    sample = common.training_rows(docs, labels, label, limit, SEED)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms()
        for p in batches:
            yield pd.DataFrame({"doc_id": p.doc_id, "label": p.label, "terms": [np.sort(of(t)).astype("<i4").tobytes() for t in p.text]})
        of.known.clear()
        common.trim()

    rows = common.materialize(common.one_a_document(sample.mapInPandas(terms, "doc_id long, label int, terms binary"), "terms", "label"), "toxicity-terms")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = np.zeros((2, 1 << BITS), "<i4"), [0, 0]
        for p in batches:
            for y, t in zip(p.label, p.terms, strict=True):
                counts[int(y > 0)][np.frombuffer(t, "<i4")] += 1
                seen[int(y > 0)] += 1
        yield pd.DataFrame({"counts": [zlib.compress(counts.tobytes(), 1)], "clean": [seen[0]], "toxic": [seen[1]]})

    counts, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(2)
    for r in rows.coalesce(8).mapInPandas(count, "counts binary, clean long, toxic long").toLocalIterator():
        counts += np.frombuffer(zlib.decompress(r.counts), "<i4").reshape(2, -1)
        seen += (r.clean, r.toxic)
    kept = _screen(counts, seen) if seen.all() else np.zeros(0, np.int64)
    if seen.all():
        total = counts.sum(0)
        often = np.lexsort((np.arange(len(total)), -total))[:CANDIDATES]
        often = np.sort(often[total[often] >= PAIR_ROWS])
        met = pair_screen(rows, often, counts[:, often], seen).toPandas()["place"] if len(often) else []
        kept = np.union1d(kept, often[np.asarray(met, np.int64)])

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            own = [np.searchsorted(kept, np.intersect1d(np.frombuffer(t, "<i4"), kept, assume_unique=True)).astype("<i2").tobytes() for t in p.terms]
            yield pd.DataFrame({"doc_id": p.doc_id, "label": p.label, "own": own})

    got = rows.mapInPandas(select, "doc_id long, label int, own binary").toPandas().sort_values("doc_id", kind="stable")
    if not len(kept):
        b = float(np.log((seen[1] + 1) / (seen[0] + 9)))
        return {"kept": kept, "w": np.zeros(0), "v": np.zeros((0, RANK)), "b": b}
    x = [np.frombuffer(o, "<i2").astype(np.int64) for o in got.own]
    w, v, b = train_machine(x, (got.label.to_numpy() > 0).astype(float), len(kept))
    return {"kept": kept, "w": w, "v": v, "b": b}


def pair_screen(rows: DataFrame, often: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> DataFrame:
    """place: of the buckets `often` (held by counts rows of each class) those of pairs that interact.

    Partitions count how many rows of each class hold both of each two buckets, as products of matrices. They send stripes of these squares; a
    stripe is summed and screened by itself, and of all that only the pairs that are frequent enough, a number that CANDIDATES bounds,
    meet to be ranked. No square reaches the driver.
    """
    n = len(often)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((2, n, n), np.float32)  # whole numbers far below 2^24: rows are bounded
        for p in batches:
            for a in range(0, len(p), 512):
                part = p.iloc[a : a + 512]
                m = np.zeros((len(part), n), np.float32)
                for k, t in enumerate(part.terms):
                    m[k, np.searchsorted(often, np.intersect1d(np.frombuffer(t, "<i4"), often, assume_unique=True))] = 1
                for y in (0, 1):
                    own = m[(part.label.to_numpy() > 0) == y]
                    both[y] += own.T @ own
        for a in range(0, n, STRIPE):
            yield pd.DataFrame({"stripe": [a], "both": [zlib.compress(both[:, a : a + STRIPE].astype("<i4").tobytes(), 1)]})
        del both
        common.trim()

    def screen(p: pd.DataFrame) -> pd.DataFrame:
        a = int(p.stripe.iloc[0])
        total = np.zeros((2, min(STRIPE, n - a), n), np.int32)
        for own in p.both:
            total += np.frombuffer(zlib.decompress(own), "<i4").reshape(total.shape)
        i, j, z = (x.tobytes() for x in _strays(total, a, counts, seen))
        return pd.DataFrame({"stripe": [a], "i": [i], "j": [j], "z": [z]})

    def rank(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("stripe")
        i, j, z = (np.frombuffer(b"".join(p[c]), kind) for c, kind in (("i", np.int32), ("j", np.int32), ("z", np.float32)))
        return pd.DataFrame({"place": _interacting(i, j, z)})

    stripes = rows.coalesce(8).mapInPandas(count, "stripe int, both binary").groupBy("stripe").applyInPandas(screen, "stripe int, i binary, j binary, z binary")
    return stripes.groupBy().applyInPandas(rank, "place long")


def scorer(model: dict):
    """A function of a text column: the score of each text."""
    place = np.full(1 << BITS, -1, np.int64)
    place[model["kept"]] = np.arange(len(model["kept"]))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Terms()
        for texts in batches:
            found = [place[of(t or "")] for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(log_odds([i[i >= 0] for i in found], model), -30, 30))), dtype="float64")
        of.known.clear()
        common.trim()

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row of docs."""
    return common.spread(docs.select("doc_id", "text")).select("doc_id", scorer(model)("text").alias("score"))


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that score under one half, with all their columns."""
    return docs.where(scorer(model)(F.col("text")) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
