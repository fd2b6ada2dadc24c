"""Exact top-k by integer inner product: no-random-access aggregation over sorted lists.

Candidates are dealt to blocks of about BLOCK rows. A block sorts a list for each component once. A query reads a list
from the top where its own component is positive, and from the bottom where it is negative, so that contributions fall; a
list whose component is zero isn't read. Reading is sequential, in steps of falling LEVELS: at each step every list is read on until what
it could still add to a row over its worst entry is at most the level, so that lists which matter more are read further and
those which can't add that much not at all. A row's lower bound is what was read of it, with the worst entry of each
list where it wasn't met; its upper bound adds the level for each list begun that hasn't shown it yet, and the whole range
of the lists not begun. Outsiders whose upper bound is below the k-th lower bound can't qualify; when few rows are left
(FEW of the block), or all is read, the query stops, and the rows left get their final scores from the integers.

Every query meets every block (a stated query set against all rows, in blocks); both sides of a cell are bounded.

Defined cases: vectors null, or with null or non-finite components, take no part (zero vectors do); vectors
meet those of their own length; ties go to the smaller vec_id; each row is a query or candidate of its own: a query row leaves out
itself only, so other rows of its vec_id are its candidates, and rows that repeat a query's vec_id each have their k results; scores
are exact below 2**53; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common, vectors

BLOCK, QUERY_BLOCK, FEW = 8192, 256, 1 / 16
#: As shares of the largest range that a component adds.
LEVELS = (0.4, 0.24, 0.144, 0.09, 0.06, 0.045, 0.035, 0.025, 0.015, 0.0)


class Lists:
    """The lists of a block: rows and values of each component, ascending."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, (self.n, self.dim) = x, x.shape
        self.rows = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        values = np.take_along_axis(x.T, self.rows, 1)
        self.over_least = np.ascontiguousarray(values - values[:, :1]).astype(float)
        self.under_most = np.ascontiguousarray(values[:, -1:] - values).astype(float)
        self.range, self.falling = self.over_least[:, -1], -self.under_most
        self._at, self._adds = np.empty(x.size, np.intp), np.empty(x.size)

    def top(self, ids: np.ndarray, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The rows and scores of the k best, ties to the smaller id, and how many entries of lists were read. own: the row
        left out, if it is in this block."""
        weight = np.abs(q).astype(float)
        ranges = weight * self.range
        read, seen, low, total = np.zeros(self.dim, np.int64), np.zeros(self.n), np.zeros(self.n), 0
        lists = np.flatnonzero(ranges > 0)
        for level in LEVELS if len(lists) else ():
            bar, n = level * ranges.max(), 0
            begun = lists[ranges[lists] > bar]
            for j in begun.tolist():
                a = read[j]
                if q[j] > 0:
                    b = self.n - int(np.searchsorted(self.over_least[j], bar / weight[j], "right"))
                    part, adds = slice(self.n - b, self.n - a), self.over_least[j]
                else:
                    b = int(np.searchsorted(self.falling[j], -bar / weight[j], "left"))
                    part, adds = slice(a, b), self.under_most[j]
                if b > a:
                    self._at[n : n + b - a] = self.rows[j, part]
                    np.multiply(adds[part], weight[j], out=self._adds[n : n + b - a])
                    read[j], n = b, n + b - a
            low += np.bincount(self._at[:n], self._adds[:n], self.n)
            seen += np.bincount(self._at[:n], minlength=self.n)
            total += n
            if own is not None:
                low[own] = -np.inf
            high = low + bar * (len(begun) - seen) + (ranges.sum() - ranges[begun].sum())
            kth = np.partition(low, self.n - k)[self.n - k] if self.n > k else -np.inf
            rest = np.flatnonzero(high >= kth - 0.5)  # scores are whole numbers, levels are not
            if len(rest) <= max(4 * k, FEW * self.n):
                break
        else:
            rest = rest if len(lists) else np.arange(self.n)
        rest = rest[rest != own] if own is not None else rest
        score = (self.x[rest] * q).sum(1)
        first = np.lexsort((ids[rest], -score))[:k]
        return rest[first], score[first], total


def search(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (long): the k highest of each row that is_query holds for."""
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("long"))
    valid = vectors.clean(rows, True, is_query)
    valid = common.materialize(valid.select("vec_id", whole.alias("v"), F.size("v").alias("dim"), "is_query", "row"), "topk-vectors")
    sizes = valid.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, parts = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-sizes["q"] // QUERY_BLOCK))
    data = valid.select("dim", "vec_id", "row", "v", vectors.spread(F.col("row"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = valid.where("is_query").select(
        "dim", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"),
        vectors.spread(F.col("row") + 1, F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    columns = ["query_row", "query_id", "vec_id", "score"]

    def local(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({c: [] for c in columns})
        place = {r: k for k, r in enumerate(x["row"])}
        ids, lists = x.vec_id.to_numpy(), Lists(np.stack(x.v.to_list()).astype(np.int64))
        out = []
        for i, r, v in zip(q.query_id, q.query_row, q.q, strict=True):
            at, scores, _ = lists.top(ids, np.asarray(v, np.int64), place.get(r), k)
            out.append(pd.DataFrame({"query_row": r, "query_id": i, "vec_id": ids[at], "score": scores}))
        return pd.concat(out)

    keys = ("dim", "block", "part")
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(local, "query_row long, query_id long, vec_id long, score long")
    return vectors.best(found, k)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
