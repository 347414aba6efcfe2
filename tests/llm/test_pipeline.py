"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import corpus_pipeline
from goldtally.llm import near_dedup, quality_rules, secret_scan, toxicity
from goldtally.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "quality_rules":
            judged, column = quality_rules.judged(table(spark, SF, "documents"))
            assert set(after) == {r.doc_id for r in judged.collect() if r[column].kept}
        if name == "near_dedup":
            rows = near_dedup.near_duplicates(spark.createDataFrame(list(before.values()), docs.schema)).collect()
            assert set(after) == {r.component_id for r in rows}
        if name == "secret_scan":
            assert set(after) == set(before) and not any(secret_scan.base_spans(r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for k, r in after.items() if r.text != before[k].text)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}


def test_one_row_of_each_group_stays_with_repeated_and_null_ids(spark):
    make = lambda seed: " ".join(f"w{(seed * 7919 + k * k) % 5003}" for k in range(80))
    a, b, c, d, e = map(make, range(5))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a + " more", "x"),  # one group
            (3, b, "x"), (3, a, "z"),  # a kept row's id on a copy
            (None, c, "x"), (None, c + " more", "x"),  # a group without ids
            (None, d, "x"), (4, d, "x"),  # a copy without an id
            (None, "", "x"), (None, None, "y"), (5, "", "x"), (5, "", "x"), (5, e, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    groups = {a: "a", a + " more": "a", b: "b", c: "c", c + " more": "c", d: "d", e: "e"}
    assert sorted((groups[t], k or 0) for k, t, _ in got if t) == [("a", 1), ("b", 3), ("c", 0), ("d", 4), ("e", 5)]
    assert {r for r in got if not r[1]} == {(None, "", "x"), (None, None, "y"), (5, "", "x")}


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_toxicity_stage_keeps_what_scores_low(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    low = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, SF).collect()} == low
