"""Approximate nearest neighbours by inner product: inverted lists of coarse centroids, product-quantised residuals,
asymmetric distance tables, exact reranking.

Coarse centroids (the square root of the number of vectors) and codebooks are fitted on at most TRAIN_ROWS vectors, or PER_LIST for
each list where that is more, in a seeded order (a documented bound); every vector is indexed. The number of lists to probe is the
least that finds RECALL of the sample's own nearest neighbours, and LOW_RECALL of those of all but LOW_SHARE of its queries,
so it follows the data; a query whose lists hold too few vectors for k others goes on to the next ones. Lists are gathered to cells of
about CELL vectors; a longer list is split over blocks of that size, and so are the queries that probe it, so neither a
hot list nor a hot query reaches one task whole.

Codes decide what is reranked, query by query: each cell scores its codes by the query's distance table and keeps those within
MARGIN of its own k-th best; then the k-th best score by table over all of a query's cells is known, and only codes within MARGIN of that
are reranked by exact double inner products. MARGIN is measured on the sample: of true neighbours, KEPT score by table
within it of the k-th best score by table. Of vectors that are equal number for number a block keeps the k + 1 of smallest vec_id, since no others can
be among a query's k.

Defined cases: vectors null, zero, or with null or non-finite components take no part, nor do those of another length
than most; ties go to the smaller vec_id; each row is a query or candidate of its own: a query row leaves out itself only, so other rows of its
vec_id are its candidates, and rows that repeat a query's vec_id each have their k results; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common, vectors

TRAIN_ROWS, PER_LIST, PARTS, CODES, RECALL, KEPT = 20_000, 16, 16, 256, 0.97, 0.995
LOW_RECALL, LOW_SHARE = 0.8, 0.01
CELL, QUERY_CELL, SEED = 4096, 4096, 3


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in slices of bounded size."""
    half = 0.5 * (c**2).sum(1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, int)])


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centroids from a seeded start; an empty one stays where it was."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(c)))
        n = np.diff(np.r_[starts, len(x)])
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]))]), starts, axis=0)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Model:
    """Centroids, codebooks, the number of lists to probe and the margin of scores by table."""

    def __init__(self, sample: np.ndarray, n: int, k: int) -> None:
        rng = np.random.default_rng(SEED)
        self.lists = int(min(max(1, round(n**0.5)), len(sample)))
        self.coarse = _means(sample, self.lists, 10, rng)
        dim = sample.shape[1]
        self.edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = [_means(rest[:, a:b], min(CODES, len(rest)), 6, rng) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.counts, self.least = np.zeros(self.lists, np.int64), 0
        self.probes, self.margin = self._calibrate(sample, rng, k)

    def hold(self, counts: np.ndarray, least: int) -> None:
        """How many vectors each list holds, and how many those probed for a query must hold at least."""
        self.counts, self.least = counts, least

    def _calibrate(self, sample: np.ndarray, rng: np.random.Generator, k: int) -> tuple[int, float]:
        """Lists to probe, and how far under the k-th best score by table the true neighbours of sampled queries score by table."""
        at = rng.permutation(len(sample))[:256]
        k = min(k, len(sample) - 1)
        if k < 1:
            return self.lists, 0.0
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        own, codes = self.encode(sample)
        by_table = self.table_scores(sample[at], own, codes)
        by_table[np.arange(len(at)), at] = -np.inf
        kth = np.partition(by_table, len(sample) - k, axis=1)[:, len(sample) - k]
        under = np.sort((kth[:, None] - np.take_along_axis(by_table, near, axis=1)).ravel())
        margin = max(0.0, float(under[int(np.ceil(KEPT * len(under))) - 1]))
        place = np.argsort(np.argsort(-(sample[at] @ self.coarse.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1), axis=1)
        each = np.sort(needed[:, int(np.ceil(LOW_RECALL * k)) - 1])
        low = each[int(np.ceil((1 - LOW_SHARE) * len(each))) - 1]
        needed = np.sort(needed.ravel())
        return int(max(low, needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])) + 1, margin

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.coarse)
        rest = x - self.coarse[own]
        return own, np.stack([_nearest(rest[:, a:b], c).astype(np.uint8) for (a, b), c in zip(self._parts(), self.books, strict=True)], axis=1)

    def _parts(self) -> list[tuple[int, int]]:
        return list(zip(self.edges.tolist(), self.edges[1:].tolist(), strict=False))

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Queries x lists: whether it is probed. The first lists are, and more while those before hold too few vectors."""
        order = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        n = self.counts[order]
        first = (np.arange(self.lists) < self.probes) | (np.cumsum(n, axis=1) - n < self.least)
        out = np.zeros(first.shape, bool)
        np.put_along_axis(out, order, first, axis=1)
        return out

    def table_scores(self, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Queries x vectors: coarse inner product and that of the residual's code, looked up part by part."""
        used, inverse = np.unique(own, return_inverse=True)
        out = (q @ self.coarse[used].T)[:, inverse].astype(np.float32)
        for j, ((a, b), book) in enumerate(zip(self._parts(), self.books, strict=True)):
            out += (q[:, a:b] @ book.T).astype(np.float32)[:, codes[:, j]]
        return out


def _layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each list, and over how many blocks of about CELL vectors that cell goes."""
    cell, blocks, held = np.zeros(len(counts), np.int64), [], CELL
    for k, n in enumerate(counts.tolist()):
        if held + n > CELL or n >= CELL:
            blocks.append(1)
            held = 0
        cell[k] = len(blocks) - 1
        held += n
        blocks[-1] = max(1, -(-held // CELL))
    return cell, np.array(blocks, np.int64)


def _distinct_enough(x: pd.DataFrame, k: int) -> pd.DataFrame:
    """x in order of vec_id, without rows that have k + 1 equal vectors before them (one of which may be the query)."""
    x = x.sort_values(["vec_id", "row"], kind="stable")
    return x[(x.groupby("own", sort=False).cumcount() <= k).to_numpy()]


def search(rows: DataFrame, is_query: F.Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k nearest found."""
    valid = common.materialize(vectors.clean(rows, False, is_query), "ann-vectors")
    lengths = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return vectors.best(rows.sparkSession.createDataFrame([], "query_row long, query_id long, vec_id long, score double"), k)
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    valid = valid.where(F.size("v") == dim)
    bound = max(TRAIN_ROWS, PER_LIST * round(n**0.5))
    sample = valid.select("v", "vec_id", "row").orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "row").limit(bound).toPandas()
    model = Model(np.stack(sample.v.to_list()).astype(float), n, k)

    def encode(batches):
        for p in batches:
            if len(p):
                x = np.stack(p.v.to_list()).astype(float)
                own, codes = model.encode(x)
                yield pd.DataFrame({"list": own, "vec_id": p.vec_id, "row": p["row"], "is_query": p.is_query, "codes": [c.tobytes() for c in codes], "own": [y.astype("<f8").tobytes() for y in x]})

    index = common.materialize(valid.mapInPandas(encode, "list int, vec_id long, row long, is_query boolean, codes binary, own binary"), "ann-index")
    counts = np.zeros(model.lists, np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    model.hold(counts, k + 1)  # a query is in a list itself
    cell, blocks = _layout(counts)

    def probe(batches):
        """A row for each cell that a query probes, with the lists of it that it does."""
        for p in batches:
            out = []
            if len(p):
                for i, r, v, lists in zip(p.query_id, p.query_row, p.v, model.probed(np.stack([np.frombuffer(v) for v in p.v])), strict=True):
                    at = np.flatnonzero(lists)
                    for c in np.unique(cell[at]):
                        out.append((int(c), r, i, v, at[cell[at] == c].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["cell", "query_row", "query_id", "v", "lists"])

    queries = index.where("is_query").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("own").alias("v"))
    probes = common.materialize(queries.mapInPandas(probe, "cell long, query_row long, query_id long, v binary, lists binary"), "ann-probes")
    asked = np.zeros(len(blocks), np.int64)
    for r in probes.groupBy("cell").count().collect():  # a row for each cell
        asked[r["cell"]] = r["count"]
    groups = np.maximum(1, -(-asked // QUERY_CELL))

    as_map = lambda a: F.split(F.lit(",".join(map(str, a.tolist()))), ",").cast("array<bigint>")
    of_cell = lambda a: F.get(as_map(a), F.col("cell").cast("int"))
    data = index.select(F.get(as_map(cell), F.col("list")).alias("cell"), "list", "vec_id", "row", "codes", "own")
    data = data.withColumn("block", vectors.spread(F.col("row"), of_cell(blocks)))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), (of_cell(groups) - 1).cast("int"))))
    dealt = probes.withColumn("part", vectors.spread(F.col("query_row"), of_cell(groups)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), (of_cell(blocks) - 1).cast("int"))))
    keys = ["cell", "block", "part"]

    def by_table(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """What may be reranked of a cell: rows and their scores by table, the best first."""
        columns = [*keys, "query_row", "query_id", "v", "near", "scores"]
        if not len(x) or not len(q):
            return pd.DataFrame([], columns=columns)
        x = _distinct_enough(x, k)
        rows_, own = x["row"].to_numpy(), x["list"].to_numpy()
        codes = np.frombuffer(b"".join(x.codes), np.uint8).reshape(len(x), -1)
        used, inverse = np.unique(own, return_inverse=True)
        out = []
        for a in range(0, len(q), 256):
            part = q.iloc[a : a + 256]
            scores = model.table_scores(np.frombuffer(b"".join(part.v)).reshape(len(part), -1), own, codes)
            for s, (c, b, g, i, r, v, lists) in zip(scores, part[[*keys, "query_id", "query_row", "v", "lists"]].itertuples(index=False), strict=True):
                s[~np.isin(used, np.frombuffer(lists, "<i4"))[inverse] | (rows_ == r)] = -np.inf
                kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                near = np.flatnonzero((s >= kth - model.margin) & (s > -np.inf))
                near = near[np.argsort(-s[near], kind="stable")]
                out.append((c, b, g, r, i, v, rows_[near], s[near]))
        return pd.DataFrame(out, columns=columns)

    kinds = "cell long, block int, part int, query_row long, query_id long, v binary"
    near = common.materialize(data.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(by_table, kinds + ", near array<long>, scores array<float>"), "ann-near")
    best = F.sort_array(F.flatten(F.collect_list(F.slice("scores", 1, k))), asc=False)
    bars = near.groupBy("query_row").agg(F.get(best, F.lit(k - 1)).alias("bar"))  # k numbers a cell
    above = F.size(F.filter("scores", lambda s: F.col("bar").isNull() | (s >= F.col("bar") - model.margin)))
    chosen = near.join(bars, "query_row").select(*keys, "query_row", "query_id", "v", F.slice(F.col("near"), F.lit(1), above).alias("near")).where(F.size("near") > 0)

    def rerank(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_row", "query_id", "ids", "scores"]
        if not len(x) or not len(q):
            return pd.DataFrame([], columns=columns)
        x = x.sort_values("row", kind="stable")
        rows_, ids = x["row"].to_numpy(), x.vec_id.to_numpy()
        vs, out = np.frombuffer(b"".join(x.own)).reshape(len(x), -1), []
        for i, r, v, own in zip(q.query_id, q.query_row, q.v, q.near, strict=True):
            at = np.searchsorted(rows_, own)
            exact = (vs[at] * np.frombuffer(v)).sum(1)
            first = np.lexsort((ids[at], -exact))[:k]
            out.append((r, i, ids[at[first]], exact[first]))
        return pd.DataFrame(out, columns=columns)

    found = data.drop("codes", "list").groupBy(*keys).cogroup(chosen.groupBy(*keys)).applyInPandas(rerank, "query_row long, query_id long, ids array<long>, scores array<double>")
    return vectors.best_of_arrays(found, k)


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
