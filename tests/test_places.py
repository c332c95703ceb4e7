"""Spatial joins over crowded places: equal places are compared once, ties and counts stay those of all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from tidegauge.operators import interest as I, spatial as S
from tidegauge.plans.bindings import bind

FOLDER = "/root/testdata/sf0.01"
BOX = "cluster_id bigint, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double, center_x double, center_z double"


def test_positions_share_one_world(spark):
    """F8, F9, F13, F14: entities of all numbers lie among each other."""
    far = bind(spark, FOLDER, "b_positions").agg(F.max("x"), F.max("entity")).first()
    assert far[0] < 300 and far[1] >= 50


def test_boxes_cover_what_other_clusters_own(spark):
    """a box also counts the points of other clusters in its stripe; equal boxes and equal places keep their numbers."""
    boxes = [(1, 0.0, 9.0, 0.0, 1.0, 0.0, 9.0, 4.0, 4.0), (2, 0.0, 9.0, 0.0, 1.0, 0.0, 9.0, 5.0, 4.0), (3, 50.0, 51.0, 0.0, 1.0, 0.0, 9.0, 50.0, 4.0), (4, 500.0, 501.0, 0.0, 1.0, 0.0, 1.0, 500.0, 0.0)]
    points = [(3.0, 0.0, 2.0)] * 5 + [(17.0, 5.0, 17.0), (58.5, 0.0, 1.0), (17.1, 0.0, 0.0)]
    out = S.box_totals(spark.createDataFrame(points, "x double, y double, z double"), spark.createDataFrame(boxes, BOX), ["x"])
    assert rows(out, "cluster_id", "n", "sum_x") == [(1, 6, 32.0), (2, 6, 32.0), (3, 1, 58.5)]


def test_equal_rounded_distances_go_to_the_smaller_id(spark):
    """0.1 + 0.2 is further than 0.3 by less than the digits that count."""
    box = (-1.0, 1.0, 0.0, 1.0, -1.0, 1.0)
    boxes = spark.createDataFrame([(1, *box, 0.1 + 0.2, 0.0), (9, *box, 0.3, 0.0), (0, *box, 0.9, 0.0)], BOX)
    pieces = spark.createDataFrame([("a", "n", 0.0, 0.0, 0.0)] * 3 + [("b", "n", 0.0, 0.0, 0.0)], "category string, prefab_name string, x double, y double, z double")
    out = S.assign_nearest(pieces, boxes, "category", "prefab_name")
    assert rows(out, "category", "cluster_id", "d2") == [("a", 1, 0.09), ("b", 1, 0.09)]


def test_points_of_one_place_all_get_the_nearest(spark):
    """equal centres give the smallest id, points without a place none."""
    centers = spark.createDataFrame([(7, 0.0, 0.0), (3, 0.0, 0.0), (1, 9.0, 0.0)], "center_id bigint, center_x double, center_z double")
    points = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 0.0), (3, 90.0, 0.0), (4, None, 0.0)], "id bigint, x double, z double")
    assert rows(S.nearest_within(points, centers, "id", 10.0), "id", "center_id", "distance") == [(1, 3, 1.0), (2, 3, 1.0), (3, None, None), (4, None, None)]


def test_crowded_seats_end(spark):
    """20,000 seats and 200,000 things in four places would be a thousand million pairs."""
    at = lambda c: [(F.col(c) % 2).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col(c) % 4).cast("double").alias("z")]
    seats = spark.range(20_000).select(F.col("id").alias("seat_id"), *at("id"))
    things = spark.range(200_000).select("id", *at("id"))
    out = S.pair_nearest(seats, things, things, things)
    assert rows(out.groupBy((F.col("seat_id") % 4).alias("s"), "table_id", "distance", "near_fire", "crowding").count(), "s", "table_id", "distance", "near_fire", "crowding", "count") == [
        (n, 199_996 + n, 0.0, True, 150_000 if n in (1, 2) else 100_000, 5_000) for n in range(4)]


def test_bands_count_by_place(spark):
    """40,000 entities in 50 places would be some 10^9 pairs; counts stay those of all pairs, and a full group is cut."""
    at = [(F.col("id") % 10 * 15).cast("double").alias("x"), (F.expr("id div 10") % 5 * 60).cast("double").alias("z")]
    pos = spark.range(40_000).select((F.col("id") % 2).alias("tick"), F.col("id").alias("entity"), *at)
    ch, eyes = pos.select("tick", "entity"), pos.select("tick", F.col("entity").alias("observer"))
    got = I.interest_bands(ch, pos, eyes, 40.0, 100.0).groupBy("tick", (F.col("observer") % 50).alias("place"), "near", "mid", "far").count().collect()
    places = [(n % 10 * 15, n // 10 % 5 * 60, n % 2) for n in range(50)]
    for r in got:
        x, z, tick = places[r["place"]]
        d2 = [(x - a) ** 2 + (z - b) ** 2 for a, b, t in places if t == tick]
        near, mid = 800 * sum(d <= 1600 for d in d2) - 1, 800 * sum(1600 < d <= 10_000 for d in d2)
        assert (r["tick"], r["near"], r["mid"], r["far"], r["count"]) == (tick, near, mid, 20_000 - 1 - near - mid, 800)
    assert len(got) == 50
    few = pos.filter("entity < 300").unionByName(spark.createDataFrame([(0, 900, None, 1.0), (0, 901, float("inf"), 1.0), (0, 902, float("nan"), 1.0), (1, 903, -0.0, -0.5)], pos.schema))
    ways = [rows(S.places_around(few, few, "tick", 40.0, 100.0, n), "tick", "x", "z", "near", "mid") for n in (1 << 16, 3)]
    assert ways[0] == ways[1] and len(ways[0]) > 50
    eyes = few.select("tick", F.col("entity").alias("observer")).unionByName(spark.createDataFrame([(0, 999)], "tick bigint, observer bigint"))
    changed = few.select("tick", "entity").filter("entity % 3 > 0")
    near = {(r["tick"], r["observer"]): (r["near"], r["mid"], r["far"]) for r in I.interest_bands(changed, few, eyes, 40.0, 100.0).collect()}
    there, told = [tuple(r) for r in few.collect()], {tuple(r) for r in changed.collect()}
    for tick, who, x, z in there:
        others = [(a, b) for t, e, a, b in there if t == tick and e != who and (t, e) in told]
        d2 = [(x - a) ** 2 + (z - b) ** 2 for a, b in others if None not in (x, a)]
        want = sum(d <= 1600 for d in d2), sum(1600 < d <= 10_000 for d in d2)
        assert near[tick, who] == (*want, len(others) - sum(want))
    assert near[0, 999] == (0, 0, 0)


def test_subscriptions_shuffle_no_pairs(spark):
    """what changed is judged where a pair is formed; entities with several positions are compared as before."""
    draw = np.random.default_rng(4)
    data = [(2 * s, e, f"r{draw.integers(2)}", float(draw.integers(30)), float(draw.integers(30))) for s in range(4) for e in range(40) if draw.random() < 0.8]
    data += [(0, 90, None, 1.0, 1.0), (2, 90, "r0", 1.0, 1.0), (4, 90, "r0", None, 1.0), (2, 91, "r1", float("nan"), 1.0), (4, 91, "r1", 3.0, 3.0)]
    schema = "sample bigint, entity bigint, region string, x double, z double"

    def plain(data):
        pairs = {(s, a, b) for s, a, r, x, z in data for t, b, q, u, v in data if s == t and a != b and r == q and None not in (r, x, u) and (x - u) ** 2 + (z - v) ** 2 <= 144}
        there = {(s, a) for s, a, *_ in data}
        return sorted([(s, a, b, "added") for s, a, b in pairs if (s - 2, a, b) not in pairs] +
                      [(s + 2, a, b, "removed") for s, a, b in pairs if (s + 2, a, b) not in pairs and (s + 2, a) in there], key=repr)
    out = I.subscription_changes(spark.createDataFrame(data, schema), 12.0)
    assert rows(out, "sample", "observer", "target", "change") == plain(data)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    twice = data + [(0, 1, "r0", 2.0, 2.0), (2, 1, "r1", 2.0, 2.0)]
    twice = [r for n, r in enumerate(twice) if (r[0], r[1], r[2]) not in {t[:3] for t in twice[:n]}]
    assert sorted(set(rows(I.subscription_changes(spark.createDataFrame(twice, schema), 12.0), "sample", "observer", "target", "change")), key=repr) == plain(twice)
