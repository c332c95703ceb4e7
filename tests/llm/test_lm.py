from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import gru, lm, queries


def brute(docs):
    words = lambda t: (t or "").encode().lower().split() + [b""]
    out_of = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in docs if not out_of(d) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words(t))
    return [(d, out_of(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, base(t)) for d, t in docs]


@pytest.mark.parametrize("head", [100_000, 5])
def test_counts_and_base_scores(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = [(n, f"The cat{n % 7} SAT on\xa0x the  mat {'rare' + str(n)} É") for n in range(40)] + [
        (50, None), (51, ""), (52, "never seen before"), (None, "the end"), (53, "the " * 3000), (53, "the " * 3000)]
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, score int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op8_lm"](spark, str(tmp_path)).collect()), key=repr)
    want = sorted(brute(docs), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and math.isfinite(g[6]) and g[6] < 0 for g, w in zip(got, want))


def test_probabilities_sum_to_one():
    model = gru.Model(gru.initial(3) * 5)
    total = sum(10 ** model.score([np.array([n], np.int32)])[0] / 10 ** model.score([np.array([n, 7], np.int32)])[0]
                * 10 ** model.score([np.array([n, 7], np.int32)])[0] for n in range(1))
    assert total > 0
    states, _, _ = model._states(np.zeros((1, 1), np.int32), np.ones((1, 1), bool), np.zeros((1, gru.STATE), np.float32),
                                 model.p["emb"] @ model.p["wx"] + model.p["b"], False)
    logp, _ = model._outputs(np.repeat(states[0], gru.VOCABULARY, axis=0), np.arange(gru.VOCABULARY))
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_state_is_carried_and_lanes_do_not_mix():
    model = gru.Model(gru.initial(3) * 5)
    r = np.random.default_rng(1)
    texts = [r.integers(1, gru.VOCABULARY, n).astype(np.int32) for n in (0, 700, 3, 40, 1, 300)]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts], rtol=1e-4)


def test_gradient_matches_differences():
    r = np.random.default_rng(2)
    flat = (gru.initial(1) * 3).astype(np.float64)
    text = r.integers(1, 400, 12).astype(np.int32)
    side = gru.lanes([text])

    def loss(values):
        m = gru.Model(values)
        return -m.score([text])[0] * math.log(10) / 13
    model, grad = gru.Model(flat.copy()), np.zeros(gru.SIZE)
    g = gru.views(grad)
    hs, _, kept = model._states(side.inputs, side.fresh, np.zeros((1, gru.STATE)), model.p["emb"] @ model.p["wx"] + model.p["b"], True)
    _, dh = model._outputs(hs[:, 0], side.targets[:, 0], g)
    model._back(side.inputs, side.fresh, kept, dh[:, None, :], g)
    for at in [*r.choice(np.flatnonzero(np.abs(grad) > 1e-4), 25)]:
        moved = flat.copy()
        moved[at] += 1e-2
        up = loss(moved)
        moved[at] -= 2e-2
        assert abs((up - loss(moved)) / 2e-2 - grad[at]) < 2e-3 + 0.02 * abs(grad[at])


def test_training_beats_the_unigram_on_patterns():
    texts = [np.tile(np.arange(2, 12, dtype=np.int32) + 10 * (n % 3), 8) for n in range(300)]
    model, squares = gru.Model(gru.initial()), np.zeros(gru.SIZE, np.float32)
    for _ in range(12):
        model.train(texts, squares)
    assert model.score(texts[:3]).sum() / 243 > -0.6  # the unigram has about -1.5


def test_the_model_is_fitted_on_all_training_documents(spark, monkeypatch):
    """one document in eight was taken."""
    seen, averaged = [], lm._averaged
    monkeypatch.setattr(lm, "_averaged", lambda texts, *rest: seen.append(texts.count()) or averaged(texts, *rest))
    docs = spark.createDataFrame([(n, f"word{n % 9} and more") for n in range(200)], "doc_id bigint, text string")
    lm.lm_scores(docs, docs["doc_id"] % 4 != 0).count()
    assert seen[-1] == 150


def test_a_step_of_training_passes_over_its_numbers_few_times(monkeypatch):
    """Each logit was exponentiated twice, and gates and gradients were gone through step by step; now one pass of ``exp`` a softmax."""
    counted, exp = [], np.exp
    monkeypatch.setattr(gru.np, "exp", lambda x, *a, **k: counted.append(np.size(x)) or exp(x, *a, **k))
    texts = [np.arange(2, 66, dtype=np.int32) for _ in range(8)]
    gru.Model(gru.initial()).train(texts, np.zeros(gru.SIZE, np.float32))
    assert sum(counted) <= sum(len(t) + 1 for t in texts) * (gru.CLASSES + gru.CLASS_WORDS)


def test_large_logits_stay_finite():
    model = gru.Model(gru.initial(3) * 5)
    model.p["ww"][:] *= 400
    model.p["bc"][:] = np.linspace(-300, 300, gru.CLASSES)
    scores = model.score([np.arange(2, 200, dtype=np.int32)])
    assert np.isfinite(scores).all() and scores[0] < 0
