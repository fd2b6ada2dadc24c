"""Quality: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1 outside the held-out fold; unlabelled text is a seeded sample of all
documents; rows labelled 0 are not read. The class prior is estimated from these two alone: a first network, fitted on half of
each, orders the other halves; above any score the unlabelled rows' share over the positives' share bounds the prior from above
(nearly no others are left where the score is high), and the bound is taken where it is least with the noise of both shares added.
A small network (one hidden layer) on text statistics minimises, with logistic loss,

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

and where the second term falls under -SLACK (the noise of a batch) a step ascends it, as the estimator asks. Both samples are bounded by
TRAIN_ROWS (a documented bound). Statistics are shares of letters, cases, digits and signs, repeats of words, neighbours
and lines, and lengths of words and texts; every text is read whole.

Defined cases: a null doc_id is not held out; training takes one of the rows that repeat a doc_id; a null or empty text has all-zero
statistics; repeated rows score alike; other columns are ignored; without trusted positives every score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common

TRAIN_ROWS, HIDDEN, STEPS, BATCH, RATE, DECAY, SLACK, NOISE, SEED = 12_000, 24, 1200, 2048, 0.01, 1e-5, 0.02, 0.1, 11
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_GROUPS = np.zeros((256, 6 + len(_SIGNS)))
_GROUPS[65:91, 0] = _GROUPS[97:123, 1] = _GROUPS[48:58, 2] = _GROUPS[128:, 3] = _GROUPS[10, 4] = _GROUPS[32, 5] = 1
for _i, _c in enumerate(_SIGNS):
    _GROUPS[_c, 6 + _i] = 1
WIDTH = _GROUPS.shape[1] + 9


def statistics(text: str) -> np.ndarray:
    out = np.zeros(WIDTH)
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return out
    k = _GROUPS.shape[1]
    out[:k] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUPS / len(raw))
    lines = text.split("\n")
    n, distinct = len(words), len(set(words))
    out[k:] = (
        distinct / n,
        np.log(distinct) / np.log(n + 1.0),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(sum(map(eq, words, words[2:])) / n),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        np.log1p(n),
        len(raw) / n / 10,
        max(map(len, words)) ** 0.5,
    )
    return out


def _forward(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ m["a"] + m["c"])
    return h @ m["u"] + m["d"], h


def train_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> dict:
    """Weights that minimise the non-negative risk, by Adam on seeded batches."""
    rng = np.random.default_rng(SEED)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((z - mean) / scale, -6, 6) for z in (positive, unlabelled))
    m = {"a": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "c": np.zeros(HIDDEN), "u": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(())}
    first, second = {k: np.zeros_like(z) for k, z in m.items()}, {k: np.zeros_like(z) for k, z in m.items()}
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.vstack([xp, xu])
        z, h = _forward(x, m)
        zp, zu = z[:BATCH], z[BATCH:]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # slopes of the loss: positive as +1; unlabelled as -1 less positive as -1
        gp, gu = -prior * sigmoid(-zp) / BATCH, np.zeros(BATCH)
        if negative >= -SLACK:
            gp, gu = gp - prior * sigmoid(zp) / BATCH, sigmoid(zu) / BATCH
        else:
            gp, gu = prior * sigmoid(zp) / BATCH, -sigmoid(zu) / BATCH
        g = np.concatenate([gp, gu])
        gh = np.outer(g, m["u"]) * (1 - h**2)
        grads = {"a": x.T @ gh, "c": gh.sum(0), "u": h.T @ g, "d": g.sum()}
        rate = RATE * (1 - step / (STEPS + 1))
        for k, d in grads.items():
            d = d + DECAY * m[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d**2
            m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "scale": scale, "prior": prior}


def _with_statistics(rows: DataFrame, *more: str) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[["doc_id", *more]].assign(stats=[statistics(t).astype("<f8").tobytes() for t in p.text])

    return rows.select("doc_id", *more, "text").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *more)) + ", stats binary")


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    rows = rows.sort_values(["doc_id", "stats"], kind="stable")
    return np.frombuffer(b"".join(rows.stats), "<f8").reshape(-1, WIDTH)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of rows that the scorer wasn't fitted on."""
    at = np.unique(positive)
    share = lambda z: 1 - np.searchsorted(np.sort(z), at, "left") / len(z)
    of_p, of_u = share(positive), share(unlabelled)
    noise = np.sqrt(np.log(4 / NOISE) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = int(np.argmin((of_u + noise) / of_p))
    return float(np.clip(of_u[best] / of_p[best], 1 / (len(unlabelled) + 2), 1 - 1 / (len(unlabelled) + 2)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> dict:
    """Train on bounded samples: trusted positives of the training fold, and as many documents at large."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trusted = labels.where(F.col(label) > 0)
    positive = common.one_a_document(_with_statistics(common.training_rows(docs, trusted, label, limit, SEED)), "stats").toPandas()
    ids = texts.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id").limit(limit)
    unlabelled = common.one_a_document(_with_statistics(texts.join(F.broadcast(ids), "doc_id")), "stats").toPandas()
    if not len(positive) or not len(unlabelled):
        return {"prior": 0.5}
    p, u = _matrix(positive), _matrix(unlabelled)
    rng = np.random.default_rng(SEED)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    first = train_network(p[::2], u[::2], 0.5)
    of = lambda x: _forward(np.clip((x - first["mean"]) / first["scale"], -6, 6), first)[0]
    prior = estimate_prior(of(p[1::2]), of(u[1::2])) if len(p) > 1 and len(u) > 1 else 0.5
    return train_network(p, u, prior)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row of docs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if "a" not in model or not len(texts):
                yield pd.Series(np.full(len(texts), float(model["prior"])))
                continue
            x = np.vstack([statistics(t or "") for t in texts])
            z, _ = _forward(np.clip((x - model["mean"]) / model["scale"], -6, 6), model)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return common.spread(docs.select("doc_id", "text")).select("doc_id", run("text").alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
