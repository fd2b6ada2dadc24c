"""Alignment, lattice scores and vector codes against plain versions, on small and on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from temporis.llm import alignment, codes, lattice, shards
from temporis.llm.queries import ORACLES, QUERIES

ODD = [
    (None, None), (5, ""), (7, "x▁y"), (8, "<s> </s> <|endoftext|> <0x41> Token"), (9, " " * 7000 + "a\n\n\n b"), (9, "\u0000\u0001é日本🙂 á"), (10, "   lead"), (11, " "),
    (12, "same words, same words"), (12, "same words, same words"), (None, "a null id"), (13, "q" * 3000), (14, "long words " * 40_000),
]
CLASH = {"keys": 1, "n": 2, "row": 3, "rest": 4, "training": 5, "word": "w", "label_error": 6, "code": "c", "_n": 7, "slot": 8}


def as_text(rows) -> list[str]:
    return sorted(repr([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


# --- alignment


def byte_table() -> dict[str, int]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(rows):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_table()

    def spans(tokens):
        out, at = [], 0
        for k, raw in tokens:
            out.append((k, at, at + len(raw)))
            at += len(raw)
        return out

    each, counts = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a = [(k, bytes(table[c] for c in slow.id_to_token(k))) for k in slow.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(k, bytes([int(piece.id_to_piece(k)[1:-1], 16)]) if piece.is_byte(k) else piece.id_to_piece(k).replace("▁", " ").encode()) for k in piece.encode(text or "")]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            each.append(None)
            continue
        a, b = spans(a), spans(b)
        links, j = [], 0
        for k, start, end in a:
            while b[j][2] <= start:
                j += 1
            m = j
            while m < len(b) and b[m][1] < end:
                links.append((k, b[m][0]))
                m += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, before = [], 0
        of = defaultdict(lambda: ([], []))
        for side, tokens in enumerate((a, b)):
            at = 0
            for k, _, end in tokens:
                while cuts[at] < end:
                    at += 1
                of[at][side].append(str(k))
        groups = ["|".join(",".join(x) for x in of[g]) for g in range(len(cuts))]
        each.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [(i, *((x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else none)) for (i, _), x in zip(rows, each, strict=True)]


def test_alignment_query(spark, sf, documents):
    assert as_text(QUERIES["op11_alignment"](spark, sf).collect()) == as_text(plain_alignment(documents))


def test_alignment_odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    assert as_text(alignment.align(df).collect()) == as_text(plain_alignment(ODD))
    assert alignment.align(df.limit(0)).count() == 0


def test_encoders_agree():
    """The rank encoder and the one that takes over at long white space."""
    sides = alignment.Sides(*(public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")))
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(chr(c) for c in rng.choice([*range(32, 127), 9, 10, 0x3000, 0xE9, 0x65E5, 0x1F642, 0x301, 0xA0, 0x660], 60))
        assert sides.encode_a(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert sides.encode_a("x" + "\n" * 6000 + "y").tolist() == slow.encode("x" + "\n" * 6000 + "y", add_special_tokens=False).ids


def test_shards_are_sums_in_order(spark):
    rng = np.random.default_rng(1)
    cells = [rng.integers(-50, 300, n).astype("<i8") for n in (0, 1, 500, 2000)] + [np.full(3000, 7, "<i8")]
    rows = spark.createDataFrame([(c.tobytes(),) for c in cells], "cell binary").repartition(3)
    counts = shards.totals(shards.partial_counts(rows, "cell", lambda b: np.frombuffer(b, "<i8")))
    want = Counter(np.concatenate(cells).tolist())
    assert {r["key"]: r["n"] for r in counts.collect()} == want
    kept = shards.write_shards(counts, size=40)
    assert len(kept) > 3 and all(a.last < b.first for a, b in zip(kept, kept[1:], strict=False))
    asked = np.arange(-60, 320)
    assert shards.Lookup(kept)(asked).tolist() == [want[k] for k in asked.tolist()]
    shards.drop_shards(spark, kept)
    assert shards.Lookup([])(asked).sum() == 0


def test_counter_merges_what_waits(monkeypatch):
    monkeypatch.setattr(shards.Counter, "PENDING", 5)
    counter = shards.Counter()
    for part in ([3, 1], [1, 1, 9, 9], [], [3]):
        counter.add(np.array(part, np.int64))
    assert counter.taken().to_pylist() == [{"key": 1, "n": 3}, {"key": 3, "n": 2}, {"key": 9, "n": 2}]
    assert counter.taken().num_rows == 0


# --- lattice scores


def tokens(text: str | None) -> list[str | None]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def is_held(i: int | None) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_lattice(rows, rounds, prior):
    """Every cut of each word is listed by recursion; the same first guess and smoothing."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    weight: dict[bytes, float] = defaultdict(float)
    for k in range(3, 32_000):
        if model.is_byte(k):
            weight[bytes([int(model.id_to_piece(k)[1:-1], 16)])] += 1 / 32_000
        else:
            weight[model.id_to_piece(k).replace("▁", " ").encode()] += 1 / (1 - model.get_score(k))
    weight[b"end"] = weight.pop(b"end", 0.0)  # a piece of that name keeps its place
    total = sum(weight.values()) + 1.0
    first = {u: w / total for u, w in weight.items()}
    p, p_end = dict(first), 1.0 / total

    def cuts(raw: bytes):
        if not raw:
            yield ()
        for n in range(1, len(raw) + 1):
            if raw[:n] in p and p[raw[:n]] > 0:
                for rest in cuts(raw[n:]):
                    yield (raw[:n], *rest)

    training = Counter(w for i, x in rows if not is_held(i) for w in tokens(x))
    ends = training.pop(None, 0)
    for _ in range(rounds):
        counts: dict[bytes, float] = defaultdict(float)
        for w, c in training.items():
            ways = [(cut, math.prod(p[u] for u in cut)) for cut in cuts(b" " + w.encode())]
            whole = sum(x for _, x in ways)
            for cut, x in ways:
                for u in cut:
                    counts[u] += c * x / whole
        size = sum(counts.values()) + ends + prior
        p = {u: (counts[u] + prior * first[u]) / size for u in first}
        p_end = (ends + prior * 1.0 / total) / size
    return {i: sum(math.log10(sum(math.prod(p[u] for u in cut) for cut in cuts(b" " + w.encode()))) for w in tokens(x)[:-1]) + math.log10(p_end) for i, x in rows}


def plain_base(rows):
    counts = Counter(w for i, x in rows if not is_held(i) for w in tokens(x))
    n = sum(counts.values())
    say = lambda w: math.log10((counts[w] + 1) / (n + 1 * (len(counts) + 1)))
    return [(i, is_held(i), len(tokens(x)), sum(counts[w] > 0 for w in tokens(x)), n, sum(map(say, tokens(x)))) for i, x in rows]


def test_lattice_base(spark, sf, documents):
    got = [tuple(r) for r in QUERIES["op12_lm_scoring"](spark, sf).collect()]
    assert as_text(r[:6] for r in got) == as_text(plain_base(documents))
    assert all(-1e7 < r[6] < 0 for r in got)


@pytest.mark.parametrize("head", [3, 65_536])
def test_lattice_odd(spark, head):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = [tuple(r) for r in lattice.score(df, head=head).collect()]
    assert as_text(r[:6] for r in got) == as_text(plain_base(ODD))
    assert as_text((r[0], r[6]) for r in got) == as_text((r[0], r[6]) for r in lattice.score(df.repartition(3)).collect())
    assert lattice.score(df.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_lattice_is_the_sum_over_all_cuts(spark, rounds):
    rows = [(1, "The cat sat"), (2, "the hat"), (3, ""), (4, "é cat"), (5, "cathat"), (6, "xyzzy the"), (7, None), (8, "end a")]
    assert any(is_held(i) for i, _ in rows)
    got = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds, prior=50).collect()}
    want = plain_lattice(rows, rounds, 50)
    assert got == pytest.approx(want, rel=1e-6)


def test_rounds_raise_held_out_probability(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = lambda r: lattice.score(docs, rounds=r).where("held_out").agg(F.sum("score")).first()[0]
    assert total(0) < total(1) < total(2)


def test_words_of_slices(documents):
    """Arrow's words are those of plain Python, in parts of a batch too."""
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in documents] + [x for _, x in ODD])], ["text"])
    for size in (1000, 50_000, 10**9):
        parts = list(lattice._text_chunks(batch, size))
        assert (len(parts) > 3) == (size < 10**9) and sum(p.num_rows for p in parts) == batch.num_rows
        got = [(w, n) for p in parts for words, sizes in [lattice.words_of(p.column("text"))] for w, n in [(words.to_pylist(), sizes.tolist())]]
        assert [w for words, _ in got for w in words] == [w for t in batch.column("text").to_pylist() for w in tokens(t)[:-1]]
        assert [n for _, sizes in got for n in sizes] == [len(tokens(t)) - 1 for t in batch.column("text").to_pylist()]


def test_long_word_does_not_underflow(spark):
    got = lattice.score(spark.createDataFrame([(1, "ab" * 20_000)], "doc_id long, text string")).first()
    assert -1e6 < got.score < -1000


# --- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows (vec_id, vector, label) in the order in which they start entries -> codes, errors, codebooks."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows]).reshape(len(rows), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        own, _ = assign()
        for p in range(parts):
            for j in range(book.shape[1]):
                if (mine := x[own[:, p] == j, p]).size:
                    book[p, j] = np.floor_divide(mine.sum(0), len(mine))
    own, far = assign()
    return own, far.sum(1), book


def test_codes_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = [tuple(r) for r in QUERIES["op13_vector_codes"](spark, sf).collect()]
    assert as_text(got) == as_text(con.execute(ORACLES["op13_vector_codes"]).fetchall())
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    own, far, book = plain_codes(rows)
    assert {r[0]: (r[1], r[2]) for r in got} == {r[0]: (bytes(o.tolist()).hex(), int(f)) for r, o, f in zip(rows, own, far, strict=True)}
    assert got[0][4] == hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vectors(n: int, seed: int, dim: int = 32) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    return [(k, (centres[rng.integers(12)] + rng.normal(0, 0.02, dim)).tolist(), int(k % 3) if k % 7 else None) for k in range(n)]


def test_heaps_equal_plain_rounds_and_look_at_few(spark):
    """In later rounds of vectors in groups most bounds hold, and only parts whose bounds are violated are looked at."""
    rows = vectors(900, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    for rounds in (1, 6):
        coded, book, looked = codes.compress(df, entries=24, rounds=rounds)
        own, far, want = plain_codes(rows, entries=24, rounds=rounds)
        assert (book == want).all()
        got = {r.vec_id: (bytes(r.code), r.error) for r in coded.collect()}
        assert got == {k: (bytes(own[k].tolist()), int(far[k])) for k in range(len(rows))}
    assert looked[-1] < 0.5 * len(rows) * 16


def test_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.5] * 18, 1), (1, [-0.25] * 18, None), (None, [0.125] * 18, None), (3, [0.5] * 18, 1), (2, [0.0] * 18, 2)]
    bad = [(0, None, 1), (4, [None] + [1.0] * 17, 1), (5, [nan] * 18, 1), (6, [inf] * 18, None), (7, [1.0] * 16, 1), (8, [], 1)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    coded, book, _ = codes.compress(df)
    got = sorted((r.vec_id if r.vec_id is not None else 99, r.label, r.error, r.label_error) for r in codes.with_label_error(coded).collect())
    assert got == [(1, None, 0, 0), (2, 2, 0, 0), (3, 1, 0, 0), (3, 1, 0, 0), (99, None, 0, 0)]
    assert book.shape == (16, 5, 2)
    none, book, _ = codes.compress(df.limit(0))
    assert codes.with_label_error(none).count() == 0 and book.size == 0
    with pytest.raises(Exception, match="exactly"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int"))


def test_label_errors_hot_and_cold(spark):
    rows = [(k, bytes([k % 5]), k, None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, code binary, error long, label int")
    want = Counter()
    for _, _, e, label in rows:
        want[label] += e
    assert {r.vec_id: r.label_error for r in codes.with_label_error(df).collect()} == {k: want[label] for k, _, _, label in rows}


def test_heap_pops_only_violated():
    x = np.array([[[0]], [[10]], [[4]], [[6]]], np.int64)
    books = codes.Books(np.array([[[0], [10]]], np.int64), np.zeros((1, 2)))
    block, moved = codes.Block.assigned(x, books)
    assert moved[0].tolist() == [[4, 2], [16, 2]] and block.codes().ravel().tolist() == [0, 1, 0, 1]
    books = books.updated(moved[:, :, :1], moved[:, :, 1])
    assert books.entries.ravel().tolist() == [2, 8] and books.drifted.ravel().tolist() == [4, 4]
    gained, looked = block.reassign(books)
    assert looked == 2 and not gained.any()  # those at 4 and 6 have a slack of 2; those at the ends have 10
    again = codes.Block.unpacked(dict(zip(["x", "sizes", "members", "keys"], block.packed(moved, 0)[:4], strict=True)), 1, 4)
    assert again.heaps == block.heaps and (again.x == x).all()
