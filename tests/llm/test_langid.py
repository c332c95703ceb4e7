from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from tidegauge.llm import langid as L
from tidegauge.llm.common import split_of

WORDS = {"aa": "the and tion hand here", "bb": "der und ung keit ein schaft", "cc": "les eau aire été deux"}


def corpus(spark, count=240):
    r = np.random.default_rng(1)
    data = []
    for n in range(count):
        lang = ["aa", "bb", "cc"][n % 3]
        data.append((n, " ".join(r.choice(WORDS[lang].split(), 12)), lang, "z", 0.5))
    data += [(1000, None, "aa", "z", 0.0), (1001, "", "bb", "z", 0.0), (1002, "12 -- !! ²", "cc", "z", 0.0), (1003, "x" * 2_500_000, None, "z", 0.0),
             (None, "der und", "bb", "z", 0.0), (5, data[5][1], None, "z", 0.0)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_defined_cases(spark):
    docs = corpus(spark).repartition(3)
    model = L.train(docs, split_of("doc_id", 4) != 2)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert all(got[n]["lang_pred"] == got[n]["lang"] or n == 5 for n in range(240))
    assert [tuple(got[n][c] for c in ("lang_pred", "score")) for n in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] in model.langs and got[None]["lang_pred"] == "bb" and got[5]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_counts_are_those_of_one_pass(spark):
    docs = corpus(spark).filter("lang is not null and text is not null")
    model = L.train(docs.repartition(7), F.lit(True))
    for k, lang in enumerate(model.langs):
        own = [t for (t,) in rows(docs.filter(F.col("lang") == lang), "text")]
        for order, table in zip(L.ORDERS, model.logp):
            counts = sum(np.bincount(L.ngrams(L.units([t])[0], order, model.bits), minlength=1 << model.bits) for t in own) + 0.5
            assert np.allclose(table[k], np.log(counts / counts.sum()), atol=1e-5)


def test_nothing_to_learn(spark):
    docs = corpus(spark, 9)
    model = L.train(docs, F.lit(False))
    assert set(rows(L.identify(docs, model), "lang_pred", "score")) == {("und", 0.0)}
    assert L.identify(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_neighbours():
    model = L.NaiveBayes(["a", "b"], np.log([0.5, 0.5]), [np.log(np.random.default_rng(k).random((2, 1 << 8)) + 0.1).astype(np.float32) for k in L.ORDERS], 8)
    texts = ["Hello wörld", "b", "ÀÉ 12 xx", "😀 z"]
    assert np.allclose(model.scores(texts), np.concatenate([model.scores([t]) for t in texts]))
