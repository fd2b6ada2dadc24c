"""Exact vector search: top-k, thresholds, fused queries, exclusion of the query's own clip, merged sub-queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temporis.functions import vector
from temporis.operators import tiles
from temporis.operators.interval import of_clip

#: Fixed value: threshold modes look at this many candidates.
THRESHOLD_CANDIDATES = 100
#: Texts of a block whose logits a task holds at once.
SLICE = 256


def modes(top_k: int | None = None, threshold: float | None = None, top_k_similarity: int | None = None) -> tuple[int, float | None]:
    """Exactly one of the three modes -> (k, threshold). The last one is an alias of the first 100."""
    if sum(x is not None for x in (top_k, threshold, top_k_similarity)) != 1:
        raise ValueError("exactly one of top_k, threshold and top_k_similarity must be given")
    k = top_k if top_k is not None else THRESHOLD_CANDIDATES
    if k < 1:
        raise ValueError("top_k must be at least 1")
    return k, threshold


def search(queries: DataFrame, items: DataFrame, query: str = "query_id", item: str = "clip_no", on: list[str] | None = None, normalised: bool = True, **mode) -> DataFrame:
    """queries (query_id, query) x items (clip_no, embedding), of the same `on` values -> query_id, clip_no, score, rank."""
    k, threshold = modes(**mode)
    hits = search_blocks(queries, items, k, query=query, item=item, on=on, normalised=normalised)
    return hits if threshold is None else hits.where(F.col("score") > threshold)


def fused(queries: DataFrame) -> DataFrame:
    """query: the sum of the unit vectors of video_query and text_query, not normalised again."""
    return queries.withColumn("query", vector.add(vector.normalise(F.col("video_query")), vector.normalise(F.col("text_query")))).drop("video_query", "text_query")


def search_fused(queries: DataFrame, items: DataFrame, query: str = "query_id", item: str = "clip_no", on: list[str] | None = None, **mode) -> DataFrame:
    """As search for fused queries; scores lie in [-2, 2]. Scores equal to nine digits are ties: a query's own two rows, where
    they are items, each score one and their cosine."""
    k, threshold = modes(**mode)
    unit = items.withColumn("embedding", vector.normalise(F.col("embedding")))
    hits = search_blocks(fused(queries), unit, k, query=query, item=item, on=on, normalised=False, digits=9)
    return hits if threshold is None else hits.where(F.col("score") > threshold)


def excluding_own(hits: DataFrame, t: Column, seconds: float = 10) -> DataFrame:
    """Hits whose clip does not hold the query's own time; at a border two clips go."""
    own = of_clip(F.col("clip_no"), seconds)
    return hits.where(~((own["start_s"] <= t) & (t <= own["end_s"])))


def image_search(queries: DataFrame, items: DataFrame, k: int | None = None, seconds: float = 10, on: list[str] | None = None, query: str = "query_id") -> DataFrame:
    """Queries with their time t: one hit more than asked for, then without the query's own clip.

    What is asked for is k, or each query's own topk where queries have that column; where it is null, nine. Columns of queries but the vector stay.
    """
    asked = F.col("topk").cast("int") if k is None and "topk" in queries.columns else F.lit(k).cast("int")
    wanted = queries.withColumn("_most", F.greatest(F.lit(0), F.coalesce(asked + 1, F.lit(10))))
    most = wanted.agg(F.max("_most")).first()[0] or 1
    named = wanted.drop("query") if not on else wanted.drop("query", *on)
    hits = search_blocks(queries, items, max(1, most), query=query, on=on).join(named, query).where("rank <= _most").drop("_most")
    return excluding_own(hits, F.col("t"), seconds)


def merge_sub_queries(hits: DataFrame, call: list[str], start: str = "start_s") -> DataFrame:
    """Of hits of a call's sub-queries that start at the same time the first: by sub-query, then rank."""
    order = Window.partitionBy(*call, start).orderBy("sub_no", "rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _lengths(vectors: pd.Series) -> np.ndarray:
    return np.array([0 if v is None else len(v) for v in vectors], np.int64)


def _dims(vectors: pd.Series) -> list[int]:
    """The lengths that vectors have; null and empty ones have none."""
    return [d for d in np.unique(_lengths(vectors)).tolist() if d]


def _whole(vectors: pd.Series, dim: int, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be compared (of that length, finite, and with a direction if unit), and a row for each, of unit length if asked for."""
    at = np.flatnonzero(_lengths(vectors) == dim)
    rows = np.array([vectors.iloc[k] for k in at], float).reshape(len(at), dim)
    ok = np.isfinite(rows).all(1)
    if unit:
        with np.errstate(invalid="ignore", over="ignore"):
            n = np.sqrt((rows * rows).sum(1, keepdims=True))
            ok &= (n[:, 0] > 0) & np.isfinite(n[:, 0])
        return at[ok], rows[ok] / n[ok]
    return at[ok], rows[ok]


def logits(texts: DataFrame, images: DataFrame, logit_scale: float, block: int = 2048) -> DataFrame:
    """text_id, image_ids, logits: for each text and block of images the inner products of unit vectors times exp(logit_scale), by
    matrix products over blocks of texts and of images. Pairs with a zero, null or not finite vector, or of unequal lengths, have a null logit."""
    left, right = tiles.dealt(images.select("image_id", F.col("image_embedding").alias("e")), texts.select("text_id", F.col("text_embedding").alias("e")), "image_id", "text_id", None, block)

    def cell(i: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(i) or not len(t):
            return pd.DataFrame([], columns=["text_id", "image_ids", "logits"])
        i = i.sort_values("image_id")
        found = np.full((len(t), len(i)), np.nan)
        for dim in _dims(t.e):
            (a, x), (b, y) = _whole(t.e, dim, True), _whole(i.e, dim, True)
            found[np.ix_(a, b)] = x @ y.T * np.exp(logit_scale)
        return pd.DataFrame({"text_id": t.text_id, "image_ids": [i.image_id.to_numpy()] * len(t), "logits": list(found)})

    got = left.groupBy(*tiles.TILE).cogroup(right.groupBy(*tiles.TILE)).applyInPandas(cell, "text_id long, image_ids array<long>, logits array<double>")
    return got.withColumn("logits", F.transform("logits", lambda x: F.when(~F.isnan(x), x)))


def logit_pairs(blocks: DataFrame) -> DataFrame:
    """text_id, image_id, logit of every pair."""
    pairs = blocks.select("text_id", F.explode(F.arrays_zip("image_ids", "logits")).alias("x"))
    return pairs.select("text_id", F.col("x.image_ids").alias("image_id"), F.col("x.logits").alias("logit"))


def logit_rows(blocks: DataFrame) -> DataFrame:
    """text_id, n_images, best_image, best_logit, log_sum_exp: what softmax over all images needs of a text's row, summed up
    block by block, so that the square of texts and images never leaves its cells."""
    pairs = F.filter(F.arrays_zip("image_ids", "logits"), lambda x: x["logits"].isNotNull())
    each = blocks.select("text_id", pairs.alias("p")).where(F.size("p") > 0)
    first = F.array_min(F.transform("p", lambda x: F.struct((0.0 - x["logits"]).alias("below"), x["image_ids"].alias("image_id"))))
    each = each.select("text_id", "p", first.alias("first")).withColumn("most", 0.0 - F.col("first.below"))
    rest = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.exp(x["logits"] - F.col("most")))
    return _rows_of_blocks(each.select("text_id", F.size("p").cast("long").alias("n"), "first", F.struct("most", rest.alias("e")).alias("x")))


def _rows_of_blocks(each: DataFrame) -> DataFrame:
    """text_id, n, first (below, image_id), x (most, e) of each block -> the columns of logit_rows."""
    # a number or two a block, shifted by the largest logit of all blocks: no scale overflows
    out = each.groupBy("text_id").agg(F.sum("n").alias("n_images"), F.min("first").alias("first"), F.collect_list("x").alias("x")).withColumn("most", 0.0 - F.col("first.below"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["e"] * F.exp(x["most"] - F.col("most")))
    return out.select("text_id", "n_images", F.col("first.image_id").alias("best_image"), F.col("most").alias("best_logit"), (F.col("most") + F.log(total)).alias("log_sum_exp"))


def logit_sums(texts: DataFrame, images: DataFrame, logit_scale: float, block: int = 2048) -> DataFrame:
    """logit_rows of logits, without the logits: a cell sums up its own texts, a slice of them at a time, and yields a few numbers a text. So a
    task holds a slice of logits, not a block's square. Images that tie for a text's best are compared by sums in order of components; the smallest id wins."""
    left, right = tiles.dealt(images.select("image_id", F.col("image_embedding").alias("e")), texts.select("text_id", F.col("text_embedding").alias("e")), "image_id", "text_id", None, block)
    names = ["text_id", "n", "below", "image_id", "e"]

    def cell(i: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        i = i.sort_values("image_id")
        for dim in _dims(t.e) if len(i) and len(t) else []:
            (a, x), (b, y) = _whole(t.e, dim, True), _whole(i.e, dim, True)
            asks, ids = t.text_id.to_numpy()[a], i.image_id.to_numpy()[b]
            for k in range(0, len(asks) if len(ids) else 0, SLICE):
                found = x[k : k + SLICE] @ y.T * np.exp(logit_scale)
                for text, v, row in zip(asks[k : k + SLICE], x[k : k + SLICE], found, strict=True):
                    bar = row.max()
                    near = np.flatnonzero(row >= bar - 1e-9 * max(1.0, abs(bar)))
                    s = (y[near] * v).sum(1) * np.exp(logit_scale)
                    best = int(s.argmax())
                    out.append((text, len(ids), -s[best], ids[near[best]], np.exp(row - s[best]).sum()))
        return pd.DataFrame(out, columns=names)

    got = left.groupBy(*tiles.TILE).cogroup(right.groupBy(*tiles.TILE)).applyInPandas(cell, "text_id long, n long, below double, image_id long, e double")
    return _rows_of_blocks(got.select("text_id", "n", F.struct("below", "image_id").alias("first"), F.struct((0.0 - F.col("below")).alias("most"), "e").alias("x")))


def search_blocks(
    queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "clip_no", on: list[str] | None = None, normalised: bool = True, digits: int | None = None, block: int = 8192
) -> DataFrame:
    """query_id, clip_no, score, rank, and the `on` columns: the k best items of each query, of the same `on` values, by cosine (or the raw inner
    product). Scores that are equal when rounded to `digits`, where given, are ties; ties go to the smaller item.

    Both sides are dealt to tiles (see tiles.py): blocks of about `block` rows of a group, small groups together; a tile yields the k best
    of each of its queries, one packed row a query, so the shuffle carries blocks and short lists, never a score matrix. One matrix product a block of queries finds
    the candidates, whose scores are then summed in order of components. A query meets the items of its own length; null, zero (for
    cosines) and not finite vectors take no part.
    """
    on = on or []
    left = items.select(*on, item, F.col("embedding").cast("array<double>").alias("e"))
    right = queries.select(*on, query, F.col("query").cast("array<double>").alias("q"))
    left, right = tiles.dealt(left, right, item, query, on, block)
    kinds = dict(items.dtypes) | dict(queries.dtypes)
    names = [*on, query, "items", "scores"]
    slack = 10.0**-digits if digits is not None else 1e-9

    def group(i: pd.DataFrame, q: pd.DataFrame) -> Iterator[tuple]:
        for dim in _dims(q.q):
            (own, e), (asks, qs) = _whole(i.e, dim, normalised), _whole(q.q, dim, normalised)
            ids, names_of = i[item].to_numpy()[own], q[[*on, query]].iloc[asks]
            for a in range(0, len(qs) if len(ids) else 0, 256):
                near = qs[a : a + 256] @ e.T
                bars = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(near), -np.inf)
                for row, v, n, bar in zip(names_of.iloc[a : a + 256].itertuples(index=False), qs[a : a + 256], near, bars, strict=True):
                    at = np.flatnonzero(n >= bar - slack * max(1.0, abs(bar)))
                    s = (e[at] * v).sum(1)
                    s = s if digits is None else s.round(digits)
                    first = np.lexsort((ids[at], -s))[:k]
                    yield *row, ids[at[first]], s[first]

    def cell(i: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(i) or not len(q):
            return pd.DataFrame([], columns=names)
        i = i.sort_values(item)
        if not on:
            return pd.DataFrame(list(group(i, q)), columns=names)
        asked = dict(list(q.groupby(on, sort=False)))
        return pd.DataFrame([x for key, own in i.groupby(on, sort=False) if key in asked for x in group(own, asked[key])], columns=names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*on, query)), f"items array<{kinds[item]}>", "scores array<double>"])
    got = left.groupBy(*tiles.TILE).cogroup(right.groupBy(*tiles.TILE)).applyInPandas(cell, schema)
    pairs = F.transform(F.arrays_zip("scores", "items"), lambda x: F.struct((0.0 - x["scores"]).alias("below"), x["items"].alias("item")))
    first = got.groupBy(*on, query).agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("x"))
    return first.select(*on, query, F.posexplode("x").alias("at", "x")).select(*on, query, F.col("x.item").alias(item), (0.0 - F.col("x.below")).alias("score"), (F.col("at") + 1).alias("rank"))


def pool_mean(vectors: DataFrame, key: str) -> DataFrame:
    """key, embedding: the mean of a key's vectors, component by component; those that are null or empty take no part, and of several lengths each
    component is the mean of the vectors that have it.

    Each partition sums its own vectors, so what moves is a row for each key and component of a partition, not of a vector.
    """
    kind = dict(vectors.dtypes)[key]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for p in batches:
            for k, v in zip(p.k, p.e, strict=True):
                if v is not None and len(v):
                    total, n = held.get(k, (np.zeros(0), np.zeros(0, np.int64)))
                    grown = max(len(total), len(v))
                    total, n = np.pad(total, (0, grown - len(total))), np.pad(n, (0, grown - len(n)))
                    total[: len(v)] += v
                    n[: len(v)] += 1
                    held[k] = total, n
            if len(held) > 10_000:  # many keys: send what there is
                yield pd.DataFrame([(k, *x) for k, x in held.items()], columns=["k", "s", "n"])
                held = {}
        yield pd.DataFrame([(k, *x) for k, x in held.items()], columns=["k", "s", "n"])

    parts = vectors.select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("e")).where("k is not null").mapInPandas(sums, f"k {kind}, s array<double>, n array<long>")
    each = parts.select("k", F.posexplode(F.arrays_zip("s", "n")).alias("pos", "x")).groupBy("k", "pos").agg((F.sum("x.s") / F.sum("x.n")).alias("m"))
    return each.groupBy(F.col("k").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))


def encode(rows: DataFrame, encoder, column: str, out: str = "embedding") -> DataFrame:
    """rows with embedding and status, by an encoder plug-in (a callable of a list of values, returning a vector or None each)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encoder(batch.tolist()))

    # not deterministic, to the optimiser: a filter on what an encoder gives must not move below a join, where more rows would be encoded
    done = rows.withColumn(out, run.asNondeterministic()(F.col(column)))
    return done.withColumn("status", F.when(F.col(out).isNull(), "failed").otherwise("ok"))
