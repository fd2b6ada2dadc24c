"""The pipeline's stages, each on its own input, and the whole."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from temporis.llm import common


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == names, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_stages_take_odd_and_empty_tables(spark, sf):
    from test_operators import CLASH, DOCS, odd_rows

    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()})
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, sf), "test-stage")
            assert docs.columns == names, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0) == bool(rows)


def test_run(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_stages_equal_plain_versions(spark, sf):
    """Each stage on its own input, against plain Python: what stays, what is masked, what is taken, what is packed."""
    from test_operators import brute_components, gapless, plain_spans, words

    from temporis.llm import mixing, secrets, toxicity

    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = plain(docs)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    docs = common.materialize(stages["toxicity"](spark, docs, sf), "test-stage")
    after = plain(docs)
    assert set(after) == {i for i, s in scores.items() if s < 0.5} and all(after[i] == before[i] for i in after)
    before = after
    docs = common.materialize(stages["n-gram Jaccard join"](spark, docs, sf), "test-stage")
    after = plain(docs)
    assert set(after) == set(brute_components([(i, r.text) for i, r in before.items()]).values()) and all(after[i] == before[i] for i in after)
    before = after
    docs = common.materialize(stages["secret scans"](spark, docs, sf), "test-stage")
    after, trained = plain(docs), secrets.trained(spark)
    for i, r in before.items():
        text, at, out = r.text or "", 0, ""
        for start, _, end in plain_spans(text, *trained)[1]:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert (after[i].text or "") == out + text[at:]
    before = after
    docs = common.materialize(stages["mixing sources to target weights"](spark, docs, sf), "test-stage")
    rows, size, taken = docs.collect(), {}, {}
    for r in before.values():
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
        assert set(words(r.text)) <= set(words(before[r.doc_id].text)) and r.n_chars == len(r.text)
    order = sorted(size)
    target = mixing.water_fill(np.array([size[s] for s in order]), np.array([(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))]))
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(order, target, strict=True))
    packed = stages["best-fit packing"](spark, docs, sf).collect()
    gapless(packed, lambda r: r.doc_id)
    assert sum(r.piece == 0 for r in packed) == len(rows)
