from __future__ import annotations

from collections import Counter

import pytest

from conftest import rows
from tidegauge.llm.mixing import mix, repeated


def filled(sizes, weights, budget, epochs):
    cap = {s: epochs * n for s, n in sizes.items()}
    free, target = set(sizes), {}
    while free:
        level = (budget - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > cap[s]}
        if not over:
            target |= {s: weights[s] * level for s in free}
            break
        target |= {s: cap[s] for s in over}
        free -= over
    return target


def sample(count=400):
    data = [(n, "w " * (n % 37), f"s{n % 5}" if n % 11 else None, 1) for n in range(count)]
    return data + [(7, "a b c", "hot", 2)] * 30 + [(None, "x y", "hot", 3), (900, None, "empty", 3), (901, "", "empty", 4)]


SCHEMA = "doc_id bigint, text string, source string, size int"


@pytest.mark.parametrize("cut", [True, False])
def test_targets_and_taken_words(spark, cut):
    data = sample()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = rows(mix(docs, cut_last=cut), "doc_id", "source", "size", "source_size", "target", "taken")
    sizes = Counter()
    for _, text, source, _ in data:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for _, source, size, whole, goal, words in got:
        taken[source] += words
        assert whole == sizes[source] and abs(goal - target[source]) < 1e-6 and 0 <= words <= 2 * size
    assert len(got) == len(data) and all(abs(taken[s] - target[s]) <= (0.5 if cut else 37) for s in sizes)
    assert got == rows(mix(docs.repartition(7), cut_last=cut), "doc_id", "source", "size", "source_size", "target", "taken")


def test_repeated_rows_are_what_the_mix_takes(spark):
    docs = spark.createDataFrame([r for r in sample() if r[2] != "hot"], SCHEMA)
    plan = {r[0]: r[1] for r in rows(mix(docs, cut_last=False), "doc_id", "taken")}
    got = Counter()
    for doc, text in rows(repeated(docs), "doc_id", "text"):
        got[doc] += len((text or "").split())
    assert {d: n for d, n in got.items() if n} == {d: n for d, n in plan.items() if n}
    assert repeated(docs).columns == docs.columns and repeated(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
