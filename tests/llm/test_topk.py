from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidegauge.llm.topk import SortedLists, top_k


def brute(data, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        for vector in [min(v for i, v in good if i == q)]:
            scored = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in good if i != q and len(v) == len(vector))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(10_000, 100), (7, 2)])
def test_matches_brute_force(spark, blocks):
    r = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.integers(-3, 4, (60, 4)) / 7)]  # many ties
    data += [(61, [0.0] * 4), (80, [0.0] * 4), (None, [1.0] * 4), (70, None), (71, [1.0, None, 0.0, 0.0]), (72, [float("nan")] * 4),
             (73, [float("inf")] * 4), (5, [0.3] * 4), (40, [0.1] * 4), (90, [9.0, 1.0]), (91, [1.0, 1.0]), (100, [])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in data], "vec_id bigint, embedding array<double>, score string, rank int")
    got = rows(top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=blocks[0], block_queries=blocks[1]), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == [x for x in brute(data, 5, 20)]
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_reading_stops_early():
    r = np.random.default_rng(4)
    vectors = np.floor(1024 * r.normal(size=(4000, 2))).astype(np.int64)
    lists = SortedLists(np.arange(4000), vectors)
    best, scored = lists.top(np.array([1000, 1]), 10, -1)
    assert [i for _, i in best] == np.lexsort((np.arange(4000), -(vectors @ [1000, 1])))[:10].tolist() and scored < 1000
