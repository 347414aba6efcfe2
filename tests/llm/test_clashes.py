"""Extra columns that are named as an operator's own, nulls and empty tables, in the stages of the pipeline and the operators behind them."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from goldtally.llm import components, embedding_dedup, near_dedup, packing, quality_rules, secret_scan, toxicity
from goldtally.llm.common import free_name

EXTRA = ["_bad", "_host", "_quality", "_spans", "score", "_score", "_row", "key", "sig", "n", "row", "_hash", "node", "piece", "start", "length"]
GOOD = "these are plain words in a text that goes on for a while and says a few things about weather and food"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, GOOD, "en", "a", 9), (2, GOOD + " too", "en", "b", 9), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "short", "en", "a", 5),
            (1, GOOD, "en", "a", 9), (5, "the secret is qZ8x-Vw3R_kT9mB2nL7p ok " + GOOD[::-1], "en", "b", 9)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in EXTRA)]
    return spark.createDataFrame([(*r, *["clash"] * len(EXTRA)) for r in rows], ", ".join(names)).repartition(2)


def test_quality_and_toxicity_keep_clashing_columns(docs):
    out, name = quality_rules.judged(docs)
    assert out.columns == [*docs.columns, name] and out.count() == 7
    kept = corpus_pipeline.quality_stage(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5}
    scored = toxicity.scored(docs, None)
    assert scored.columns == [*docs.columns, "score_"] and {r.score_ for r in scored.collect()} == {0.0}


@pytest.mark.parametrize("stage", ["near_dedup", "secret_scan", "packing"])
def test_stages_with_clashing_columns_nulls_and_repeats(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out, none = run(spark, docs, ""), run(spark, docs.limit(0), "")
    rows = out.collect()
    assert none.count() == 0
    if stage == "near_dedup":
        assert out.columns == docs.columns and sorted(r.doc_id for r in rows if r.doc_id) == [1, 3, 4, 5] and len(rows) == 5
    elif stage == "secret_scan":
        assert out.columns == docs.columns and len(rows) == 7 and any("[SECRET]" in (r.text or "") for r in rows)
    else:
        assert len(rows) == 7 and sum(r.length for r in rows) <= 1024 * len({r.sequence_id for r in rows})


def test_free_name():
    assert free_name("x", ["a"]) == "x" and free_name("x", ["X", "x_"]) == "x__"


def test_components_by_one_task_and_by_rounds(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    one = {tuple(r) for r in components.components(links).collect()}
    rounds = {tuple(r) for r in components.components(links, in_one_task=0).collect()}
    above = {x: x for p in pairs for x in p}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        above[b] = a
    want = {(x, root(x)) for a, b in pairs if a != b for x in (a, b)}
    assert one == rounds == want


def test_shared_workers_pack_alike(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sorted(map(repr, packing.pieces(docs, path, shared=True).collect())) == sorted(map(repr, packing.pieces(docs, path).collect()))


def test_vectors_of_every_length_link_with_their_own(spark):
    rng = np.random.default_rng(8)
    long_ones = rng.normal(size=(30, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(long_ones)] + [(100 + k, (v * 3).tolist()) for k, v in enumerate(long_ones[:5])]
    rows += [(200, [1.0, 2.0]), (201, [2.0, 4.0]), (202, [-1.0, 2.0]), (203, [5.0]), (204, []), (205, None), (206, [0.0, 0.0]), (207, [1.0, None])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and None not in v and any(v)}
    for k, _ in rows:
        links = [j for j in unit if k in unit and j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9]
        assert got[k][0] == len(links)
    assert got[201] == (1, 200) and got[202] == (0, 202) and got[203] == (0, 203) and got[100][1] == 0
