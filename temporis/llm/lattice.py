"""LM scoring by subword lattices: a text's probability is the sum over all ways to cut it into known units.

The units are the pieces of an existing public vocabulary (with its 256 byte pieces, so that every string can be cut) and an end.
Each has a probability: the vocabulary's own scores, which are ranks, give a first guess (one over the rank), which stays as
PRIOR tokens of smoothing; ROUNDS of expectation-maximisation over the training words count how often each unit is expected in
the lattices. The vocabulary itself is never changed. A text is its lower-cased words, each after a space, and an end. No unit but runs of
spaces, which can't occur, crosses into another word, so the lattice of a text is a chain of its words' lattices, and the forward recursion, in
log space, is run once for each distinct word of the corpus: log P(text) = sum of log P(word) + log P(end).

By Spark: partitions count their distinct words, sums by word follow; each round maps over the training words and sums expected
counts by unit, as decimals; the words' probabilities are a table. The most frequent short words, HEAD at most, are sent to all tasks, a bounded
table; a document's other words are joined with the table, and as there are more than HEAD words about as frequent as the first of them, no
key is hot. Words of a batch are coded as numbers by Arrow, so that no Python runs for each of them.

Defined cases: null and empty texts are an end alone; a null doc_id is in training; repeated rows count and score as often as they are there; without
training rows every unit keeps its first guess, and the base gives every token probability one; bytes that form no
piece are byte pieces; words of any length are scored whole; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm import common

ROUNDS, PRIOR = 2, 10_000
#: Words that all tasks know, and the bytes that these have at most; distinct words that a partition holds before it sends them; bytes of words whose lattices, and
#: of texts whose words, are worked on at once.
HEAD, HEAD_BYTES, HELD, CHUNK, TEXTS = 262_144, 64, 400_000, 400_000, 8_000_000
#: Expected counts are summed exactly, to as many places.
EXACT = "decimal(38,14)"


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, A-Z in lower case, one after the other, and how many each text has. Arrow splits at just the six
    characters that the contract names."""
    own = texts.cast(pa.large_string()).take(pa.array(range(len(texts))))  # a copy: ascii_lower reads a slice of an array from its wrong end
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
    flat, rows = split.flatten(), pc.list_parent_indices(split).to_numpy()
    whole = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty string
    return flat.filter(whole).dictionary_encode(), np.bincount(rows[whole.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _text_chunks(batch: pa.RecordBatch, size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of text; a longer text is one by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    cuts = np.r_[0, np.flatnonzero(np.diff(sizes // size)) + 1, batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Units:
    """The vocabulary's strings of bytes, each with the rank that its score gives it, and an automaton that finds them."""

    def __init__(self, pieces: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        ranks: dict[bytes, float] = {}
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k):
                continue
            piece = model.id_to_piece(k)
            raw = bytes([int(piece[1:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
            rank = model.get_piece_size() if model.is_byte(k) else 1 - model.get_score(k)  # a byte piece's score is no rank: it comes last
            ranks[raw] = ranks.get(raw, 0.0) + 1 / rank
        self.names = list(ranks)
        first = np.array([*ranks.values(), 1.0])  # the end, as the first rank
        self.first = first / first.sum()
        self.sizes = np.array([len(u) for u in self.names], np.int64)
        self.find = ahocorasick.Automaton()
        for k, u in enumerate(self.names):
            self.find.add_word(u.decode("latin-1"), k)
        self.find.make_automaton()


@lru_cache(maxsize=1)
def units(pieces: str) -> Units:
    return Units(pieces)


class Lattices:
    """The lattices of some words, one after the other: edge k is unit[k] from node start[k] to node end[k]."""

    def __init__(self, words: list[str], known: Units) -> None:
        raw = [(" " + w).encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        found = known.find.iter(b"".join(raw).decode("latin-1"))  # in order of ends; no unit crosses into the next word
        edges = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2)
        starts = np.cumsum(sizes) - sizes
        self.unit = edges[:, 1]
        self.word = np.searchsorted(starts, edges[:, 0], "right") - 1
        self.first = starts + np.arange(len(words))  # nodes: a word's bytes with the space before them, and one
        self.last = self.first + sizes
        level = edges[:, 0] + 1 - starts[self.word]
        self.end = self.first[self.word] + level
        self.start = self.end - known.sizes[self.unit]
        self.nodes = int(sizes.sum()) + len(words)
        most = int(sizes.max(initial=0))
        self._by_end, self._by_start = self._steps(level, self.end), self._steps(most - (level - known.sizes[self.unit]), self.start)

    @staticmethod
    def _steps(level: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges level by level, of all words at once, and where among them another node begins. Edges come word by word, so a sort that keeps
        the order of equals leaves those of a node together."""
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
        ranked = level[order]
        cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(order)])
        out = []
        for part in np.split(order, cuts[1:]):
            own = node[part]
            out.append((part, np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])))
        return out

    def _run(self, steps, begin: np.ndarray, source: np.ndarray, target: np.ndarray, logs: np.ndarray) -> np.ndarray:
        out = np.full(self.nodes, -np.inf)
        out[begin] = 0.0
        for part, starts in steps:
            if len(part):
                reached = out[source[part]] + logs[self.unit[part]]
                most = np.maximum.reduceat(reached, starts)
                sizes = np.diff(np.r_[starts, len(part)])
                safe = np.where(np.isfinite(most), most, 0.0)
                with np.errstate(divide="ignore"):
                    out[target[part[starts]]] = safe + np.log(np.add.reduceat(np.exp(reached - np.repeat(safe, sizes)), starts))
        return out

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log of the sum over all ways from a word's first node to each node."""
        return self._run(self._by_end, self.first, self.start, self.end, logs)

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        return self.forward(logs)[self.last]

    def expected(self, logs: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """How often each of n units is expected, where words occur so many times."""
        ahead, behind = self.forward(logs), self._run(self._by_start, self.last, self.end, self.start, logs)
        share = np.exp(ahead[self.start] + logs[self.unit] + behind[self.end] - ahead[self.last][self.word])
        return np.bincount(self.unit, share * times[self.word], n)


def _chunks(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words by length, in chunks of about CHUNK bytes: words of a chunk take about as many steps."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    part = np.cumsum(sizes[order] + 1) // CHUNK
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(own):
            yield own, [words[k] for k in own]


def in_training() -> Column:
    """Rows that the model learns from; those with a null doc_id are among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (times in training rows), f (times in all rows) of docs (text, training)."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum"), ("f", "sum")]).rename_columns(["word", "c", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in (p for batch in batches for p in _text_chunks(batch)):
            words, sizes = words_of(part.column("text"))
            codes, n = words.indices.to_numpy(), len(words.dictionary)
            learnt = np.repeat(part.column("training").to_numpy(zero_copy_only=False), sizes)
            counts = [pa.array(np.bincount(x, minlength=n).astype(np.int64)) for x in (codes[learnt], codes)]
            held.append(pa.table([words.dictionary.cast(pa.string()), *counts], ["word", "c", "f"]))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()
        common.trim()

    partial = docs.select("text", "training").mapInArrow(run, "word string, c long, f long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("f").alias("f"))


def frequent(words: DataFrame, most: int) -> Column:
    """Which words (f, word) all tasks are to know: short ones, from a frequency on above which there are no more than `most`. A count by eighths
    of powers of two tells that frequency: some hundreds of numbers, whatever the words."""
    short = F.octet_length("word") <= HEAD_BYTES
    step = F.floor(F.log2("f") * 8).cast("int")
    bars, held = None, 0
    for at, n in sorted(map(tuple, words.where(short).groupBy(step.alias("at")).count().collect()), reverse=True):
        held += n
        if held > most:
            break
        bars = at
    return short & (step >= bars) if bars is not None else F.lit(False)


def learn(words: DataFrame, texts: int, pieces: str, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log probability of each unit and, last, of the end, from words (word, c) of so many training texts."""
    known = units(pieces)
    n = len(known.names)
    p = known.first
    for _ in range(rounds):
        logs = np.log(p)

        def run(batches: Iterator[pa.RecordBatch], logs: np.ndarray = logs) -> Iterator[pa.RecordBatch]:
            found, total = units(pieces), np.zeros(n)
            for batch in batches:
                every, times = batch.column("word").to_pylist(), batch.column("c").to_numpy()
                for own, part in _chunks(every):
                    total += Lattices(part, found).expected(logs, times[own], n)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["unit", "n"])
            common.trim()

        got = words.where("c > 0").select("word", "c").mapInArrow(run, "unit long, n double").groupBy("unit").agg(F.sum(F.col("n").cast(EXACT)).cast("double").alias("n")).collect()
        counts = np.zeros(n + 1)
        counts[-1] = texts
        for unit, expected in got:  # a row a unit of the vocabulary
            counts[unit] = expected
        p = (counts + prior * known.first) / (counts.sum() + prior)
    return np.log(p)


def score(docs: DataFrame, pieces: str | None = None, rounds: int = ROUNDS, prior: float = PRIOR, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text); scores are log10 probabilities."""
    import public_tokenizers

    pieces = pieces or public_tokenizers.path("piece_bpe_32k.model")
    rows = common.spread(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("training", in_training())
    words = common.materialize(count_words(rows), "lattice-words")
    learnt = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    texts = rows.where("training").count()
    n, v = learnt["n"] + texts, learnt["v"] + (texts > 0)  # the end is a token
    logs = learn(words, texts, pieces, rounds, prior)
    unit = math.log10(n + v + 1)
    end = (math.log10(texts + 1) - unit, float(logs[-1]) / math.log(10))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = units(pieces)
        for batch in batches:
            every, out = batch.column("word").to_pylist(), np.zeros(batch.num_rows)
            for own, part in _chunks(every):
                out[own] = Lattices(part, found).scores(logs)
            base = np.log10(batch.column("c").to_numpy() + 1.0) - unit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(out / math.log(10))], ["word", "c", "f", "base", "log"])
        common.trim()

    words = common.replace(words, words.mapInArrow(spell, "word string, c long, f long, base double, log double"), "lattice-words")
    known = frequent(words, head)
    shown = words.where(known).select("word", "base", "log", (F.col("c") > 0).cast("long").alias("known")).toArrow()  # head short words at most
    others = words.where(~known)
    values = [shown.column(c).to_numpy() for c in ("base", "log", "known")]
    shown = shown.column("word").combine_chunks()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_kind = pa.struct([("word", pa.string()), ("n", pa.int64())])
        for part in (p for batch in batches for p in _text_chunks(batch)):
            words, sizes = words_of(part.column("text"))
            codes, rows = words.indices.to_numpy(), np.repeat(np.arange(part.num_rows), sizes)
            at = pc.fill_null(pc.index_in(words.dictionary.cast(pa.string()), value_set=shown), -1).to_numpy()[codes]
            told, rest = at >= 0, at < 0
            sums = [np.bincount(rows[told], v[at[told]], part.num_rows) for v in values]
            n_words = len(words.dictionary)
            pairs, times = np.unique(rows[rest] * n_words + codes[rest], return_counts=True)
            own = words.dictionary.take(pa.array(pairs % max(1, n_words))).cast(pa.string())
            cuts = np.searchsorted(pairs // max(1, n_words), np.arange(part.num_rows + 1))
            others = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([own, pa.array(times, pa.int64())], fields=list(rest_kind)))
            columns = [pa.array(sizes + 1, pa.int64()), pa.array(sums[2].astype(np.int64) + int(texts > 0)), pa.array(sums[0] + end[0]), pa.array(sums[1] + end[1]), others]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("training"), *columns], ["doc_id", "training", "n_tokens", "n_known", "base", "log", "rest"])
        common.trim()

    read_kinds = "doc_id long, training boolean, n_tokens long, n_known long, base double, log double, rest array<struct<word:string,n:long>>"
    done = common.materialize(rows.mapInArrow(read, read_kinds).withColumn("row", F.monotonically_increasing_id()), "lattice-rows")
    asked = done.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    exact = lambda c: F.sum((F.col(c) * F.col("n")).cast("decimal(38,15)"))  # noqa: E731  the same whatever the order
    sums = asked.join(others, "word").groupBy("row").agg(exact("base").alias("_base"), exact("log").alias("_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"))
    both = done.drop("rest").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b).cast("double"), F.lit(0.0))
    out = both.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"), plus("log", "_log").alias("score"),
    )
    out = common.materialize(out, "lattice-scores")
    common.drop(words, done)
    return out


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
