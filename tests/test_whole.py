"""Queries over whole tables against brute force, and their operators on small cases."""

from __future__ import annotations

import numpy as np
import pytest

from temporis import catalog
from temporis.operators import retrieval


def unit_vectors(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    return ids, v / np.sqrt((v * v).sum(1, keepdims=True))


def test_logits_of_every_text_and_image(spark, sf):
    ids, v = unit_vectors(spark, sf)
    texts = np.flatnonzero(ids % 50 == 0)
    got = {r["text_id"]: r for r in catalog.QUERIES["vec11_contrastive_logits"](spark, sf).collect()}
    want = v[texts] @ v.T * np.exp(1.5)
    assert sorted(got) == ids[texts].tolist()
    for i, row in zip(ids[texts].tolist(), want, strict=True):
        assert got[i]["n_images"] == len(ids) and got[i]["best_image"] == ids[row.argmax()]
        assert abs(got[i]["best_logit"] - row.max()) < 1e-5 and abs(got[i]["log_sum_exp"] - np.log(np.exp(row).sum())) < 1e-4


def test_logits_by_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=3).tolist() for _ in range(40)] + [[0.0, 0.0, 0.0], None]
    texts = spark.createDataFrame(list(enumerate(vectors[25:])), "text_id long, text_embedding array<double>")
    images = spark.createDataFrame(list(enumerate(vectors)), "image_id long, image_embedding array<double>")
    unit = [np.full(3, np.nan) if v is None or not any(v) else np.array(v) / np.sqrt(np.dot(v, v)) for v in vectors]
    want = {(t, i): float(unit[25 + t] @ unit[i] * np.exp(1.5)) for t in range(17) for i in range(42)}
    blocks = retrieval.logits(texts, images, 1.5, block=8)
    got = {(r["text_id"], r["image_id"]): r["logit"] for r in retrieval.logit_pairs(blocks).collect()}
    assert set(got) == set(want)
    assert all(got[k] is None if np.isnan(w) else abs(got[k] - w) < 1e-9 for k, w in want.items())
    for r in retrieval.logit_rows(blocks).collect():
        own = [w for (t, _), w in want.items() if t == r["text_id"] and not np.isnan(w)]
        assert r["n_images"] == 40 and abs(r["best_logit"] - max(own)) < 1e-9 and abs(r["log_sum_exp"] - np.log(np.exp(own).sum())) < 1e-9


@pytest.mark.parametrize("name", ["vec3_topk", "vec4_threshold", "vec5_topk_similarity", "vec8_fused_query", "vec9_subtitle_topk", "vec7_fused_in_video"])
def test_every_query_is_answered(spark, sf, name):
    ids, v = unit_vectors(spark, sf)
    got = catalog.QUERIES[f"{name}"](spark, sf).collect()
    assert {r["query_id"] for r in got} == set(ids[ids % 50 == 0].tolist())
    if name == "vec3_topk":
        at = {i: k for k, i in enumerate(ids.tolist())}
        for q in ids[ids % 50 == 0].tolist():
            s = v @ v[at[q]]
            assert [r["clip_no"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == ids[np.lexsort((ids, -s.round(12)))][:8].tolist()


@pytest.mark.parametrize("name", ["vec14_multi_query", "set1_sub_query_union"])
def test_every_sub_query_is_answered(spark, sf, name):
    ids, _ = unit_vectors(spark, sf)
    got = {(r["call_id"], r["sub_no"]) for r in catalog.QUERIES[f"{name}"](spark, sf).collect()}
    assert got == {(i // 150, i // 50 % 3) for i in ids[ids % 50 == 0].tolist()}


def test_fused_queries_meet_every_item(spark, sf):
    assert {r["clip_no"] for r in catalog.QUERIES["vec8_fused_query"](spark, sf).collect()} & set(range(20))


def test_blocks_by_group_and_raw_product_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    own = [(i, i % 3, [round(x, 1) for x in rng.normal(size=3).tolist()]) for i in range(60)] + [(70, 0, None), (71, 0, [1.0]), (72, 1, [0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(own, "clip_no long, video_id int, embedding array<double>")
    queries = rows.where("clip_no < 20 or clip_no >= 70").selectExpr("clip_no AS query_id", "video_id", "embedding AS query")
    want = []
    for q, g, v in own:
        if q < 20 or q > 70:  # a query meets the items of its own length
            first = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, h, w in own if h == g and w and len(w) == len(v)), key=lambda t: (round(t[0], 9), t[1]))[:4]
            want += [(q, k, c, round(-s, 9)) for k, (s, c) in enumerate(first, 1)]
    got = retrieval.search_blocks(queries, rows, 4, block=16, on=["video_id"], normalised=False, digits=9)
    assert sorted((r["query_id"], r["rank"], r["clip_no"], round(r["score"], 9)) for r in got.collect()) == sorted(want)
    assert got.columns == ["video_id", "query_id", "clip_no", "score", "rank"]


def test_every_conversation_asks_by_image(spark, sf):
    asking = {r["conv_id"] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert {r["conv_id"] for r in catalog.QUERIES["tool4_image_query"](spark, sf).collect()} == asking & {r["vec_id"] for r in table.select("vec_id").collect()}


def test_conversations_from_twenty_on_ask_too(spark, tmp_path):
    vectors = np.random.default_rng(6).normal(size=(40, 4))
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, 0, "user", "x") for i in range(30)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    want = {(q, int(i), k + 1) for q in range(30) for k, i in enumerate(np.argsort(-(unit @ unit[q]))[: 3 + q % 3]) if not i <= q <= i + 1}
    assert {(r["conv_id"], r["clip_no"], r["rank"]) for r in catalog.QUERIES["tool4_image_query"](spark, str(tmp_path)).collect()} == want


def test_questions_of_equal_openings_differ(spark, tmp_path):
    docs = [(0, "the same opening, one", "a"), (1, "the same opening, two", "a"), (2, "the same opening, one", "a"), (3, "the same opening, one", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("join7_resume_anti") == [(1,), (3,)]
    assert run("eval2_resume_literal") == [(1,)]
    assert run("join6_cached_semi") == [("the same opening, one", "a")]


def test_every_word_of_a_document(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(100))
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["rel_lateral"](spark, str(tmp_path)).orderBy("word_no").collect()
    assert [(r["word_no"], r["word"]) for r in got] == list(enumerate(text.split(" ")))


def test_encoders_read_words_past_the_77th(spark, sf, monkeypatch):
    from temporis.plans import plugins

    seen, real = {}, plugins.encode_modalities
    monkeypatch.setattr(plugins, "encode_modalities", lambda rows, registry: seen.update(registry) or real(rows, registry))
    catalog.QUERIES["enc1_modalities"](spark, sf)
    same = " ".join(f"word{i}" for i in range(77))
    assert set(seen) == {"text", "subtitle"}
    for encoder in seen.values():
        a, b = encoder([same, same + " more"])
        assert a != b


def test_joins_and_sets_over_whole_tables(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 2, 3)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 3), (11, 3), (13, 1), (14, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: sorted((tuple(r) for r in catalog.QUERIES[f"rel_{name}"](spark, str(tmp_path)).collect()), key=repr)
    inner = [(1, 13), (3, 10), (3, 11)]
    assert run("join_inner") == inner
    assert run("join_left") == [(1, 13), (2, None), (3, 10), (3, 11)]
    assert run("join_full") == [(1, 13), (2, None), (3, 10), (3, 11), (None, 14)]
    assert run("union_all") == [(k,) for k in (1, 1, 2, 3, 3, 3, 9)]
    assert run("union") == [(k,) for k in (1, 2, 3, 9)]
    assert run("intersect") == [(1,), (3,)]
    assert run("except_all") == [(3,), (9,)]


def test_every_clip_has_its_neighbours(spark, sf):
    from temporis.plans import media_queries

    clips = {(r["video_id"], r["clip_no"]) for r in media_queries._clips(spark, sf).collect()}
    assert clips <= {(r["video_id"], r["clip_no"]) for r in catalog.QUERIES["win5_neighbours"](spark, sf).collect()}
