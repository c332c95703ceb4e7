from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from tidegauge.llm import toxicity as X
from tidegauge.llm.common import split_of


def corpus(spark, count=1200):
    r = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in "ba ro li mu te no".split() for b in "ran sel dom vit".split()]
    data, labels = [], []
    for n in range(count):
        words = list(r.choice(plain, 20))
        toxic = n % 6 == 0
        if toxic:  # one family of invented words, and one word that every lexicon has
            words[3:5] = [["idiot", f"zorga{plain[n % 7]}"][n % 2], f"zorga{plain[n % 5]}"]
        data.append((n, " ".join(words), 0.1))
        if n % 4 != 3:
            labels.append((n, int(toxic), n))
    data += [(5000, None, 0.0), (5001, "", 0.0), (None, "idiot zorgabaran", 0.0), (5002, "word " * 60_000, 0.0), (3, data[3][1], 0.0)]
    return (spark.createDataFrame(data, "doc_id bigint, text string, toxicity double").repartition(3),
            spark.createDataFrame(labels + [(None, 1, 0), (9999, None, 0), (1, 0, 5)], "doc_id bigint, toxic int, quality int"))


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    detector = X.fit(docs, labels, split_of("doc_id", 4) != 2)
    got = rows(X.score(docs, detector), "doc_id", "toxicity")
    for doc, value in got:
        assert 0 <= value <= 1
        if doc is not None and doc < 1200:
            assert (value >= 0.3) == (doc % 6 == 0), doc
    by = {d: v for d, v in got}
    assert by[5000] == by[5001] < 0.3 and by[None] >= 0.3 and len(got) == 1205
    again = X.fit(docs.repartition(5), labels, split_of("doc_id", 4) != 2)
    assert np.allclose([v for _, v in rows(X.score(docs, again), "doc_id", "toxicity")], [v for _, v in got], atol=1e-6)


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(0)
    n, prior, hit, miss = 60_000, 0.2, [0.8, 0.7, 0.6, 0.5, 0.6], [0.05, 0.1, 0.1, 0.05, 0.1]
    y = r.random(n) < prior
    votes = (r.random((n, 5)) < np.where(y[:, None], hit, miss)).astype(float)
    votes = np.column_stack([votes, np.where(r.random(n) < 0.8, votes[:, 4], r.random(n) < 0.2), -(votes[:, 0] == 0).astype(float)])
    model = X.fit_labels(n, votes.sum(axis=0), votes.T @ votes, prior)
    assert np.allclose(model.toxic[:4], hit[:4], atol=0.08) and np.allclose(model.clean[:4], miss[:4], atol=0.03)
    assert (4, 5) in model.correlated and (0, 1) not in model.correlated
    truth = [0.2 * a / (0.2 * a + 0.8 * b) for a, b in zip(hit[:4], miss[:4])]
    assert np.allclose(model.accuracy[:4], truth, atol=0.08)


def test_without_labels_the_lexicons_decide(spark):
    docs, labels = corpus(spark, 30)
    detector = X.fit(docs, labels.limit(0), F.lit(True))
    by = dict(rows(X.score(docs, detector), "doc_id", "toxicity"))
    assert by[None] > by[5000] and not detector.voters.mined
    assert X.score(docs.limit(0), detector).count() == 0


def test_posteriors_of_documents_without_labels_train(spark):
    r = np.random.default_rng(4)
    data = []
    for n in range(900):
        words = [f"plain{r.integers(50)}" for _ in range(15)]
        for word in ("idiot", "trash", "loser", "hate"):
            if r.random() < (0.8 if n % 5 == 0 else 0.04):
                words.append(word)
        data.append((n, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    detector = X.fit(docs, labels, F.lit(True))
    assert detector.labels.weight.any() and len(set(np.round(detector.weights[:-1], 3))) > 2  # not the lexicons as they are
    assert detector.score("plain1 idiot trash loser") >= 0.3 > detector.score("plain1 plain2")
