"""Ordered passes: the sliced plan for hot keys gives the same rows as one window."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidegauge.operators.ordered import (group_median, group_quantiles, latest, ordered, position, previous, running_max, running_min,
                                         running_sum)


def skewed(spark, n=600, seed=1):
    """One key holds most rows, many rows share one time, values have gaps; rows come shuffled."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        at = 50 if rng.random() < 0.4 else rng.randrange(100)
        data.append((key if rng.random() < 0.97 else None, at, i, rng.choice([None, rng.randrange(-20, 20)])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, at bigint, id bigint, v bigint")


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_sliced_scan_equals_window(spark, backward, keys):
    df = skewed(spark)
    def run(limit):
        g = ordered(df, keys, ["at", "id"], group_rows=limit)
        g = g.scan(backward=backward, n=position(), s=running_sum(F.col("v")), hi=running_max(F.col("v")), lo=running_min(F.col("v")),
                   last=latest(F.col("v")), lag=previous(F.struct("at", "v")), known=previous(F.col("v")))
        return g.splits, rows(g.df, "id", "n", "s", "hi", "lo", "last", "lag", "known")
    whole, sliced = run(10_000), run(25)
    assert whole[0] is None and sliced[0] is not None
    assert whole[1] == sliced[1]


def test_ties_are_sliced_by_the_next_column(spark):
    df = spark.range(400).selectExpr("1 AS k", "7 AS at", "id")
    g = ordered(df, ["k"], ["at", "id"], group_rows=50)
    sizes = [r["count"] for r in g.sliced_rows().groupBy("k", "__slice").count().collect()]
    assert max(sizes) <= 50
    assert rows(g.scan(n=position()).df, "id", "n") == sorted([(i, i + 1) for i in range(400)], key=repr)


def test_nearest_rank_definition(spark):
    df = spark.range(1, 101).selectExpr("'a' AS k", "id AS v")
    got = group_quantiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).first()
    assert (got.p0, got.p50, got.p99, got.p100) == (1, 50, 99, 100)
    one = spark.createDataFrame([("b", 5)], "k string, v bigint")
    assert group_quantiles(one, ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()[1:] == (5, 5)


def test_median_of_even_and_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 3.0), ("b", 5.0), ("b", 4.0), ("c", None)], "k string, v double")
    assert rows(group_median(df, ["k"], "v", "m"), "k", "m") == [("a", 2.0), ("b", 4.0)]


def test_slices_compare_values_exactly(spark):
    """Whole numbers beyond 2**53, text, NULL and decimals order the rows as a plain window does."""
    big = 1 << 60
    df = spark.range(300).selectExpr("1 AS k", f"CASE WHEN id % 50 = 0 THEN NULL ELSE {big} + (id * 7919) % 300 END AS revision",
                                     "concat('t', lpad(cast((id * 31) % 300 as string), 3, '0')) AS title", "cast(id % 3 as decimal(30, 2)) AS d", "id")
    for order in (["revision", "id"], ["title"], ["d", "title"]):
        whole = ordered(df, ["k"], order, group_rows=10_000).scan(n=position())
        sliced = ordered(df, ["k"], order, group_rows=20).scan(n=position())
        assert whole.splits is None and len(sliced.splits) > 10
        assert rows(whole.df, "id", "n") == rows(sliced.df, "id", "n")
        sizes = [r["count"] for r in sliced.sliced_rows().groupBy("__slice").count().collect()]
        assert max(sizes) <= 60


def test_fanout_needs_no_order_of_all_lines(spark):
    from tidegauge.plans import catalog

    plan = catalog.QUERIES["fanout_decision"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_long_lane_is_not_sorted_by_one_task(spark, monkeypatch):
    from tidegauge.operators import ranking

    monkeypatch.setattr(ranking, "LANE_ROWS", 40)
    records = spark.range(300).selectExpr("id", "concat('t', id * 7 % 100) AS title", "'guide' AS kind", "array('a') AS audiences", "array('a') AS primary")
    lane = ranking.lane_order(records, "a")
    assert "__slice" in lane._jdf.queryExecution().executedPlan().toString()
    want = sorted(range(300), key=lambda i: (f"t{i * 7 % 100}", i))
    assert [r.id for r in lane.orderBy("place").collect()] == want
