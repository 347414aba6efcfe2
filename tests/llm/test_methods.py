"""Single steps of operators against plain forms of them."""

import itertools
import re
import time

import numpy as np
import pytest

from goldtally.llm import embedding_dedup, pii_tagger


@pytest.mark.parametrize("pivots,spread", [(9, 9), (40, 40), (40, 10)])
def test_candidates_share_pivots_and_meet_once(pivots, spread):
    rng = np.random.default_rng(pivots + spread)
    near = np.array([rng.choice(spread if k % 2 else pivots, 8, replace=False) for k in range(60)], dtype=np.int32)
    seen = np.zeros((60, 60), dtype=int)
    for pivot in range(pivots):
        rows = np.flatnonzero((near == pivot).any(1))
        if len(rows):
            seen[np.ix_(rows, rows)] += embedding_dedup.candidates(pivot, near[rows], near[rows], 3)
    want = np.array([[len(set(a) & set(b)) >= 3 for b in near.tolist()] for a in near.tolist()])
    assert (seen == want).all()


def test_lists_in_blocks_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 32))
    x[:250] = x[0] + 0.2 * x[:250]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    whole = {r.vec_id: tuple(r) for r in embedding_dedup.embedding_duplicates(df).collect()}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    assert {r.vec_id: tuple(r) for r in embedding_dedup.embedding_duplicates(df).collect()} == whole
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sum(r[1] for r in whole.values()) >= 0.99 * ((unit @ unit.T >= 0.9).sum() - 600)


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(5)
    emit, move = rng.normal(size=(4, 6, pii_tagger.TAGS)), rng.normal(size=(pii_tagger.TAGS,) * 2)
    got = pii_tagger._best_paths(emit, move)
    for b in range(6):
        score = lambda p: sum(emit[t, b, k] for t, k in enumerate(p)) + sum(move[j, k] for j, k in zip(p, p[1:]))
        assert tuple(got[b]) == max(itertools.product(range(pii_tagger.TAGS), repeat=4), key=score)


@pytest.mark.parametrize("outside", [0, 1.5, 3, 6])
def test_decoder_equals_the_model(outside):
    rng = np.random.default_rng(6)
    model = pii_tagger.BiLstmCrf()
    model.w["move"] = rng.normal(0, 0.7, model.w["move"].shape)
    model.w["out"] *= 4
    model.w["bias"][0] = outside
    batch = rng.integers(0, pii_tagger.CHARS, (80, pii_tagger.WIDTH)).astype(np.uint8)
    decoder = pii_tagger.Decoder(model.w)
    assert np.allclose(decoder.scores(batch), model.scores(batch)[0], atol=1e-4)
    got, want = decoder.paths(batch), model.viterbi(batch)
    assert (got == want).mean() > 0.9999
    if outside == 6:
        assert not want.all(1).any() and (got[~want.any(1)] == 0).all()


def test_decoder_by_parts_and_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    model = pii_tagger.BiLstmCrf()
    model.w["move"] = rng.normal(0, 0.7, model.w["move"].shape)
    model.w["out"] *= 4
    model.w["bias"][0] = 2.5
    batch = rng.integers(0, pii_tagger.CHARS, (83, pii_tagger.WIDTH)).astype(np.uint8)
    decoder = pii_tagger.Decoder(model.w)
    scores, paths = decoder.scores(batch), decoder.paths(batch)
    assert paths.any(1).any() and not paths.any(1).all()
    monkeypatch.setattr(pii_tagger, "BATCH", 30)
    monkeypatch.setattr(pii_tagger, "BLOCK", 8)
    assert np.allclose(decoder.scores(batch), scores, atol=1e-5) and (decoder.paths(batch) == paths).mean() > 0.9999
    assert decoder.paths(batch[:0]).shape == (0, pii_tagger.WIDTH)


def test_decoder_costs_little_more_than_its_products_and_tanh():
    rng = np.random.default_rng(8)
    batch = rng.integers(0, pii_tagger.CHARS, (384, pii_tagger.WIDTH)).astype(np.uint8)
    decoder = pii_tagger.Decoder(pii_tagger.BiLstmCrf().w)
    assert decoder.paths(batch).any(1).all()  # so no window is spared the Viterbi recursion
    gates = 4 * pii_tagger.HIDDEN
    into, state = (rng.normal(size=(2, *shape)).astype(np.float32) for shape in ((gates, 29), (29, 384)))
    z = np.empty((2, gates, 384), dtype=np.float32)

    def least():
        for _ in range(pii_tagger.WIDTH):
            np.matmul(into, state, out=z)
            np.tanh(z, out=z)

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    took = [(seconds(lambda: decoder.paths(batch)), seconds(least)) for _ in range(5)]
    assert min(t for t, _ in took) < 7 * min(t for _, t in took)


def test_base_spans_by_the_patterns_alone():
    rng = np.random.default_rng(12)
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    card, phone = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda m: sum(c in "0123456789" for c in m[0])
    passes = (lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")),
              lambda m: 12 <= digits(m) <= 19 and pii_tagger._luhn(re.sub("[^0-9]", "", m[0])), lambda m: 9 <= digits(m) <= 15)
    seen = set()
    for _ in range(3000):
        text = "".join(rng.choice(list("0011223456789..- +()@ab"), rng.integers(0, 90)))
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(zip((email, ip, card, phone), passes)) for m in re.finditer(p, text) if ok(m))
        assert pii_tagger.base_spans(text) == want
        seen |= {k for _, k, _ in want}
    assert seen == {0, 1, 2, 3}


@pytest.mark.parametrize("length", [1, 255, 256, 257, 448, 449, 5000])
def test_windows_are_reconciled_over_whole_texts(length):
    text = "".join(chr(33 + k % 90) for k in range(length))
    w = pii_tagger.windows(text)
    assert (pii_tagger.reconciled(w, length) == pii_tagger.codes(text, length)).all()


def test_spans_of_tags():
    rng = np.random.default_rng(9)
    for _ in range(200):
        path = rng.choice([0, 0, 1, 2, 2, 2, 3, 4, 4], 30).astype(np.uint8)
        want = []
        for t in range(30):
            if path[t] % 2:
                e = t + 1
                while e < 30 and path[e] == path[t] + 1:
                    e += 1
                want.append((t, int(path[t]) // 2, e))
        assert pii_tagger.tag_spans(path) == want
    base = [(2, 0, 6), (4, 1, 9)]
    own = [(0, 0, 2), (1, 0, 3), (7, 1, 8), (9, 3, 12), (20, 3, 30)]
    assert pii_tagger.with_base(base, own, 30) == sorted(base + [own[0], own[3], own[4]])


def test_windows_to_learn_from():
    text = "x" * 1000 + " bob@mail.example.com " + "y" * 300
    spans, touched = pii_tagger._learnable(text)
    half = pii_tagger.LEARN // 2
    want = [any(s < k * half + pii_tagger.LEARN and e > k * half for s, _, e in spans) for k in range(len(touched))]
    assert touched.tolist() == want and any(want) and (len(touched) - 1) * half + pii_tagger.LEARN >= len(text)
