"""Picks with memory: slice summaries compose to the plain walk, and the distributed forms match brute force."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st

from conftest import rows
from tidegauge.operators import interest as I
from tidegauge.operators.chain import applied, composed, spaced_picks, summarise, walk


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 90)), max_size=40), st.integers(0, 100))
def test_summary_is_the_walk_as_a_function(run, state):
    triggers, afters = [t for t, _ in run], [a for _, a in run]
    out = state
    for low, high, to in summarise(triggers, afters):
        if low < state <= high:
            out = to
    assert out == walk(state, triggers, afters)[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 90)), min_size=1, max_size=40), st.integers(0, 40), st.integers(0, 100), st.integers(0, 100))
def test_composed_summaries_are_the_walk_over_both(run, cut, state, most):
    state = min(state, most)
    halves = [([t for t, _ in part], [a for _, a in part]) for part in (run[:cut], run[cut:])]
    between = max([most, *halves[0][1]])
    both = composed(summarise(*halves[0], most), summarise(*halves[1], between))
    assert applied(both, state) == walk(state, [t for t, _ in run], [a for _, a in run])[1]
    assert all(a[1] != b[0] or a[2] != b[2] for a, b in zip(both, both[1:])), "neighbours with one outcome are one range"


def test_summary_of_a_hot_key_is_as_long_as_its_outcomes():
    gap, times = 60, list(range(1000, 21_000))
    made = summarise(times, [t + gap for t in times], most=999 + gap)
    assert len(made) == len({out for _, _, out in made}) == gap


def greedy(times, gap):
    last, picked = None, []
    for t in times:
        take = last is None or t - last >= gap
        last = t if take else last
        picked.append(take)
    return picked


def events(spark, n=900, seed=3):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(2000), i) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, at bigint, id bigint")


@pytest.mark.parametrize("limit", [None, 40])
@pytest.mark.parametrize("gap", [1, 60])
def test_spaced_picks(spark, limit, gap):
    data, df = events(spark)
    want = []
    for key in {d[0] for d in data}:
        mine = sorted((at, i) for k, at, i in data if k == key)
        want += [(i, take) for (_, i), take in zip(mine, greedy([at for at, _ in mine], gap))]
    assert rows(spaced_picks(df, ["k"], "at", ["id"], gap, limit), "id", "picked") == sorted(want, key=repr)


def merged(reports, window):
    """Brute force: one open action per basis with the set of its witnesses."""
    out, state = [], {}
    for basis, witness, at, rid in sorted(reports, key=lambda r: (r[2], r[3])):
        before, seen, action = state.get(basis, (None, set(), 0))
        if before is None or at - before > window or witness in seen:
            action, seen = action + 1, set()
        seen.add(witness)
        state[basis] = (at, seen, action)
        out.append((rid, action))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [None, 40])
def test_witness_merge(spark, limit):
    rng = random.Random(5)
    data = [(0 if rng.random() < 0.7 else rng.randrange(3), rng.randrange(6), rng.randrange(4000), i) for i in range(700)]
    df = spark.createDataFrame(data, "basis bigint, witness bigint, at bigint, report_id bigint")
    assert rows(I.witness_merge(df, 10, limit), "report_id", "action") == merged(data, 10)


@pytest.mark.parametrize("limit", [None, 30])
def test_first_hit_death_clears(spark, limit):
    data = [(1, 0, 1, "hit"), (1, 10, 2, "hit"), (1, 20, 3, "death"), (1, 25, 4, "hit"), (1, 40, 5, "death"), (1, 54, 6, "hit"), (1, 55, 7, "hit"), (1, 56, 8, "death")]
    df = spark.createDataFrame(data, "target_id bigint, at bigint, hit_id bigint, kind string")
    got = dict(rows(I.first_hit(df, 30, limit), "hit_id", "emitted"))
    # the second death comes 20 after the first: not a blow of its own, yet it still clears the first hit
    assert got == {1: "first_hit", 2: "none", 3: "killing_blow", 4: "first_hit", 5: "none", 6: "first_hit", 7: "none", 8: "killing_blow"}


def test_cooldown_fires_at_exactly_the_limit(spark):
    df = spark.createDataFrame([("q", 0, 1), ("q", 59, 2), ("q", 60, 3), ("q", 119, 4)], "quest string, at bigint, id bigint")
    assert rows(I.cooldown_fire(df, ["quest"], "at", ["id"], 60), "id", "fired") == [(1, True), (2, False), (3, True), (4, False)]


def test_drop_repeats_keeps_events_without_a_key(spark):
    df = spark.createDataFrame([("e", "a", 0, 1), ("e", "a", 900, 2), ("e", "a", 1000, 3), ("e", None, 5, 4), ("e", " ", 6, 5)], "name string, key string, at bigint, id bigint")
    assert [r[0] for r in rows(I.drop_repeats(df, ["name", "key"], "at", ["id"], 1000), "id")] == [1, 3, 4, 5]


def test_band_decision(spark):
    data = [("o", "x", 0, 1, 50.0, 0.0, False), ("o", "x", 5, 2, 50.0, 0.0, False), ("o", "x", 6, 3, 5.0, 0.0, False), ("o", "x", 12, 4, 50.0, 0.0, False),
            ("o", "x", 16, 5, 50.0, 0.0, False), ("o", "x", 17, 6, 99.0, 0.0, False), ("o", "x", 18, 7, 99.0, 120.0, False), ("o", "x", 19, 8, 99.0, 0.0, True)]
    df = spark.createDataFrame(data, "observer_id string, object_id string, at bigint, obs_id bigint, distance double, reach double, fast boolean")
    got = dict(rows(I.band_decision(df, 10.0, 60.0, 10), "obs_id", "action"))
    assert got == {1: "emit_thinned", 2: "hold_thinned", 3: "emit_full", 4: "hold_thinned", 5: "emit_thinned", 6: "drop", 7: "landmark", 8: "player_fast_lane"}


def test_hysteresis_edges_and_absence(spark):
    data = [(1, 9, t, d) for t, d in [(1, 64.0), (2, 72.0), (3, 72.1), (4, 66.0), (5, 64.0), (7, 70.0), (8, float("nan"))]] + [(1, 8, 6, 10.0)]
    df = spark.createDataFrame(data, "object_id bigint, peer_id bigint, tick bigint, distance double")
    got = [(r.tick, r.transition) for r in I.hysteresis(df, 64.0, 8.0).filter("peer_id = 9").orderBy("tick").collect()]
    assert got == [(1, "entered"), (2, "retained"), (3, "left"), (4, "outside"), (5, "entered"), (7, "outside"), (8, "outside")]
