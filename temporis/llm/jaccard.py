"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, each pair verified once.

A text's set is its distinct word shingles. A census over all texts (see census.py) tells how many texts hold each
shingle; a text's shingles are ordered rarest first. Texts of similarity t or more share a shingle among the first
n - ceil(t * n) + 1 of each, so only these prefixes are joined, and of them only shingles that more than one text holds.
A pair must pass three filters before its sets are compared: sizes within t of each other; room for the needed overlap
after the places of the shared shingle; and, for the suffix filter, both sets dealt to PARTS ranges of the numbers: a
range in which their counts differ in parity holds a shingle of one set only, so the number of such ranges bounds the
Hamming distance from below and may not exceed what the needed overlap allows.

Texts with equal sets are one class, of which one text takes part. As links only have to connect, a group of m near copies
need not give m * m pairs: in rounds, the texts that share a shingle are dealt to chunks of about CHUNK, anew for each shingle and round, and
each is compared with its chunk's leader; linked texts become one component, and shingles all of whose texts are in one
component drop out. So a frequent shingle is as many small groups, not one large. Rounds go on while they join components and the
full join would still meet more than MEETS pairs for each row. The full join then ends it, between different
components only, so no link between components is lost: two texts are paired at the first shingle that both hold, by ranges of sizes, as the smaller
one of the two only where enough of it is left (see _all_pairs), and Spark can split a frequent shingle's rows on both sides.

Numbers of shingles are 64-bit. A number that stands for two shingles can only matter where both are in one text or one compared
pair: of m shingles about m * m / 2**65, one in a million over 10**9 texts of a thousand words. Counts that collide change the order
of prefixes, which is the same for all texts, and no link.

Defined cases: a null or empty text has no set and is linked with nothing; a text of fewer words has one shingle; a null
doc_id is linked with nothing and its component is null; rows that repeat a doc_id pool their links; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temporis.llm import common
from temporis.llm.census import ASKED, Layout, answer, mix, numbers

WORDS, PERCENT, PARTS = 5, 80, 1024
CHUNK, MEETS = 256, 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 1 << 12, np.uint64) << np.uint64(1) | np.uint64(1)
_TURN = _RNG.integers(0, 1 << 63, WORDS + 1, np.uint64) << np.uint64(1) | np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    return mix(x, x >> np.uint64(32))


def word_numbers(raw: bytes) -> np.ndarray:
    """A 64-bit number of each word of a text in lower-case A-Z."""
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[b]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(b)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(b)]))
    value = _BYTE[b]
    high = place >> 12
    value = value * _PLACE[place & 4095]
    if high.any():  # words over 4095 bytes: the part's number goes in too
        value = mix(value, high.astype(np.uint64))
    value[~inside] = 0
    return _finish(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct numbers of a text's shingles: of its whole sequence if it has fewer words, none without words."""
    w = word_numbers(raw)
    n = min(len(w), words)
    if not n:
        return w
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out += w[k : len(w) - n + 1 + k] * _TURN[k]
    return np.unique(_finish(out))


def prefix_length(n: np.ndarray, percent: int = PERCENT):
    """How many of the rarest shingles of n a text must share one of with any text it links to."""
    return n - -(-percent * n // 100) + 1


class Sets:
    """The sets of a batch's texts, and the distinct shingles of all of them with the number of texts that hold each."""

    def __init__(self, p: pd.DataFrame) -> None:
        p = p.assign(_id=p.doc_id.fillna(np.iinfo(np.int64).max).astype("int64")).sort_values(["_id", "text"], kind="stable")
        self.rows, self.sets = p, [shingles(t) for t in p.text]
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        self.keys, self.counts = every[starts], np.diff(np.r_[starts, len(every)]).astype("<u4")


def _total(low, starts, lengths):
    """The number of texts, of all batches, that hold an entry's shingle."""
    return np.repeat(np.add.reduceat(low, starts, dtype="<u4"), lengths)


def _parities(x: np.ndarray) -> np.ndarray:
    counts = np.bincount((x >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


PREFIXES = "doc_id long, n int, class binary, tokens array<long>, places array<int>, members array<long>, parts array<long>"


def prefixes(docs: DataFrame) -> DataFrame:
    """A row for each text: n (size of its set), class (a digest of the set) and, for the first text of a class in its batch that
    shares a shingle of its prefix with any text: tokens (these shingles), places, members (the set), parts (parities of its partition counts, as bits)."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    layout = Layout(texts, 0.16)
    dealt = layout.batched(texts)

    def ask(p: pd.DataFrame) -> pd.DataFrame:
        own = Sets(p)
        return layout.rows(int(p.batch.iloc[0]), own.keys, own.counts)

    counts = common.materialize(answer(dealt.groupBy("batch").applyInPandas(ask, ASKED), _total, "<u4"), "jaccard-counts")

    def order(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        out, seen = [], set()
        if len(p):
            own = Sets(p)
            total = numbers(r, layout, own.keys, "<u4")
            for i, x in zip(own.rows.doc_id, own.sets, strict=True):
                digest = xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None
                row = [i, len(x), digest, None, None, None, None]
                if len(x) and digest not in seen:
                    seen.add(digest)
                    held = total[np.searchsorted(own.keys, x)]
                    first = np.lexsort((x, held))[: int(prefix_length(len(x)))]
                    place = np.flatnonzero(held[first] > 1)
                    if len(place):
                        row[3:] = x[first][place].view(np.int64), place.astype(np.int32), x.view(np.int64), _parities(x)
                out.append(row)
        return pd.DataFrame(out, columns=["doc_id", "n", "class", "tokens", "places", "members", "parts"])

    return dealt.groupBy("batch").cogroup(counts.groupBy("batch")).applyInPandas(order, PREFIXES)


def _least_overlap(a: F.Column, b: F.Column) -> F.Column:
    """Shingles that two sets of these sizes share at least if they link."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))


def _reach(n: F.Column, place: F.Column) -> F.Column:
    """The largest set that one of n shingles can link with, if its first shingle that both hold is at this place."""
    return F.floor(F.lit(100 + PERCENT) * (n - place) / F.lit(PERCENT)) - n


def _may_link(a: str, b: str, first: bool = False) -> F.Column:
    """Length, positional and suffix filter of two rows that share a shingle. first: none that comes before it is shared."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = _least_overlap(n, m)
    room = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    room = room if first else room + F.least(F.col(f"{a}.place"), F.col(f"{b}.place"))
    differ = sum((F.bit_count(F.col(f"{a}.parts.b{k}").bitwiseXOR(F.col(f"{b}.parts.b{k}"))) for k in range(PARTS // 64)), F.lit(0))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (room >= need) & (differ <= n + m - 2 * need)


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: whether the sets' similarity is PERCENT or more."""
    sets = nodes.select("node", "n", "members")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("of_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    linked = (100 * shared >= PERCENT * (F.col("n_a") + F.col("n_b") - shared)).alias("linked")
    return both.select("a", "b", linked)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, least: the smallest node that each node of edges (a, b) reaches, by alternating large and small stars."""
    edges = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = common.replace(edges, small.distinct(), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
            out._written = edges._written
            return out
        state = now


def _apply(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """rows (with comp) after components moved: node -> least."""
    names = rows.columns
    out = rows.join(moved.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("least", "comp"))
    return out.select(*names)


def connect(nodes: DataFrame) -> DataFrame:
    """node, comp: for the nodes (node, n, tokens, places, members, parts) that links connect, the least node reachable."""
    parts = F.struct(*[F.get("parts", F.lit(k)).alias(f"b{k}") for k in range(PARTS // 64)]).alias("parts")
    rows = nodes.select("node", F.col("node").alias("comp"), "n", parts, F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    rows = rows.select(F.col("t.tokens").alias("token"), "node", "comp", "n", _range(F.col("n")).alias("range"), F.col("t.places").alias("place"), "parts")
    shared = rows.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("k")).where("a <> b").select("token", "k")
    # what is joined with the rows is a table of its own, so that Spark can split the rows of a frequent shingle
    found = common.materialize(shared, "jaccard-shared")
    rows = common.materialize(rows.join(found, "token"), "jaccard-tokens")
    common.drop(found)
    known = nodes.select("node").distinct().withColumn("comp", F.col("node"))
    tested, number, last = None, 0, rows.isEmpty()
    while not last:
        last = number > 0 and (not joined or _meets(rows) <= MEETS)
        if last:
            heads, met = _all_pairs(rows)
        else:
            chunk = F.pmod(F.xxhash64(F.lit(number), "token", "node"), F.ceil(F.col("k") / CHUNK)).alias("chunk")
            dealt = rows.select("*", chunk)
            draw = F.struct(F.xxhash64(F.lit(number), "node").alias("draw"), "node", "comp", "n", "place", "parts")
            heads = dealt.groupBy("token", "chunk").agg(F.min(draw).alias("h")).select("token", "chunk", "h.node", "h.comp", "h.n", "h.place", "h.parts")
            heads = common.materialize(heads, "jaccard-heads")
            met = dealt.alias("x").join(heads.alias("h"), F.expr("x.token = h.token and x.chunk = h.chunk and x.comp <> h.comp") & _may_link("x", "h"))
        pairs = met.select(F.least("x.node", "h.node").alias("a"), F.greatest("x.node", "h.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done = common.materialize(verify(pairs, nodes).groupBy("a", "b").agg(F.max("linked").alias("linked")), "jaccard-verified")
        tested = done.select("a", "b") if tested is None else tested.unionByName(done.select("a", "b"))
        common.drop(heads)
        links = done.where("linked").select("a", "b")
        joined = not links.isEmpty()
        if joined:
            of = known.select("node", "comp")
            between = links.join(of.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
            moved = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "jaccard-stars")
            known = common.replace(known, _apply(known, moved), "jaccard-components")
            if not last:
                now = common.materialize(_apply(rows, moved), "jaccard-moved")
                apart = common.materialize(now.groupBy("token").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("token"), "jaccard-apart")
                rows = common.replace(rows, now.join(apart, "token", "left_semi"), "jaccard-tokens")
                common.drop(now, apart)
                last = rows.isEmpty()
            common.drop(moved)
        number += 1
    return known


def _range(n: F.Column) -> F.Column:
    """Ranges of sizes, a little wider than the ratio of linked ones."""
    return F.floor(F.log(100 / PERCENT + 0.05, n))


def _all_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows against those (heads) outside of the largest component of the shingle: heads, and pairs x, h that may link.

    Two texts need to meet only at the first shingle that both hold, in the order that all texts share. There the smaller one must reach the larger
    one's size, and so its own, which a row whose place is far down its prefix doesn't: it meets no one as the smaller text. So rows that
    share frequent shingles only after rare ones of their own, as pages with one boilerplate do, are never paired.
    """
    size = rows.groupBy("token", "comp").agg(F.count("*").alias("m"))
    most = size.groupBy("token").agg(F.max(F.struct("m", "comp"))["comp"].alias("most"))
    heads = common.materialize(rows.join(most, "token").where("comp <> most").drop("most", "k", "range"), "jaccard-heads")
    reach, n = _reach(F.col("n"), F.col("place")), F.col("n")
    span = lambda least, largest: F.explode(F.sequence(_range(least), _range(largest))).alias("range")
    smaller = heads.where(reach >= n).select("*", span(n, reach))
    larger = heads.select("*", span(F.ceil(PERCENT * n / 100), n))
    same = F.expr("x.token = h.token and x.range = h.range and x.comp <> h.comp") & _may_link("x", "h", True)
    # of equal sizes both reach the other's, so the second join leaves them to the first, but where x is of the largest component, whose rows are no heads
    up = rows.alias("x").join(smaller.alias("h"), same & F.expr("x.n >= h.n"))
    down = rows.where(reach >= n).alias("x").join(larger.alias("h"), same & F.expr("x.n < h.n"))
    pair = lambda df: df.select(F.struct("x.node").alias("x"), F.struct("h.node").alias("h"))
    return heads, pair(up).unionByName(pair(down))


def _meets(rows: DataFrame) -> float:
    """Pairs that the full join would meet before its filters, as a multiple of the rows: of those that may be the smaller text with all others."""
    small = F.count_if(_reach(F.col("n"), F.col("place")) >= F.col("n"))
    size = rows.groupBy("token", "range", "comp").agg(F.count("*").alias("m"), small.alias("s"))
    outside = size.groupBy("token", "range").agg(F.sum("m").alias("all"), F.sum("s").alias("small"), (F.sum("m") - F.max("m")).alias("out"), (F.sum("s") - F.max("s")).alias("out_small"))
    pairs = F.col("all").cast("double") * F.col("out_small") + F.col("small").cast("double") * F.col("out")
    r = outside.agg(F.sum(pairs).alias("pairs"), F.sum("all").alias("rows")).first()
    return r["pairs"] / r["rows"] if r["rows"] else 0.0


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    small = common.materialize(prefixes(docs), "jaccard-prefixes")
    classes = common.materialize(small.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node")), "jaccard-classes")
    one = Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last())
    held = small.where("tokens is not null").withColumn("k", F.row_number().over(one)).where("k = 1").join(classes, "class")
    nodes = common.materialize(held.select("node", "n", "tokens", "places", "members", "parts"), "jaccard-nodes")
    found = connect(nodes)
    named = classes.join(found, "node", "left").select("class", F.coalesce("comp", "node").alias("component"))
    out = small.select("doc_id", "n", "class").join(named, "class", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, and those without one; all columns.

    Of rows that repeat a doc_id the one with the smallest text stays.
    """
    firsts = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    kept = rows.join(firsts, "doc_id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
