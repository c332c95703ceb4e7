"""Ledgers, progress and ranked plans on hand fixtures."""

from __future__ import annotations

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidegauge.operators import ledger as L, progress as P, ranking as R
from tidegauge.operators.sets import nested_diff
from tidegauge.streaming.processors import Lease

RECEIPT = "window_id string, recipient_id string, seq bigint, empty_body boolean, us bigint"


def test_receipts_duplicates_gaps_and_unknown_acks(spark):
    receipts = spark.createDataFrame([("w", "r", s, s == 3, s) for s in (2, 3, 3, 6)], RECEIPT)
    acks = spark.createDataFrame([("w", "r", 3), ("w", "r", 3), ("w", "r", 99), ("w", "only-acks", 1)], "window_id string, recipient_id string, seq bigint")
    got = {r.recipient_id: r for r in L.receipt_status(receipts, acks).collect()}
    r = got["r"]
    # missing counts from 1, as sequences start there
    assert (r.receipts, r.distinct_seq, r.duplicates, r.min_seq, r.max_seq, r.missing, r.acked, r.pending, r.unknown_acks, r.empty_bodies) == (4, 3, 1, 2, 6, 3, 1, 2, 1, 2)
    assert (got["only-acks"].receipts, got["only-acks"].unknown_acks, got["only-acks"].missing) == (0, 1, 0)


def test_journal_equal_revision_is_stale_and_tombstones_stay(spark):
    data = [("e", 1, 5, False, False, 1), ("e", 1, 5, True, False, 2), ("e", 1, 6, True, False, 3), ("e", 1, 9, False, True, 4), ("old", 1, 10, False, False, 5), ("e", 2, 1, False, False, 6)]
    log = spark.createDataFrame(data, "world_epoch string, object_id bigint, object_revision bigint, tombstone boolean, delivery_only boolean, line bigint")
    got = L.journal_verdicts(log, "e", ["object_id"], ["line"], "object_revision")
    assert [v for _, v in rows(got, "line", "verdict")] == ["delta", "stale_journal_revision", "tombstone", "delivery_only", "world_epoch_not_active", "delta"]
    assert rows(L.journal_state(log, "e", ["object_id"], ["line"], "object_revision"), "object_id", "object_revision", "tombstone", "line") == [(1, 6, True, 3), (2, 1, False, 6)]


def test_interest_snapshot_replays_only_what_is_not_pending(spark):
    log = spark.createDataFrame([(1, 1, False, 0, 0, 10), (1, 2, False, 0, 0, 30), (2, 1, True, 5, 5, 12)],
                                "object_id bigint, revision bigint, tombstone boolean, zone_x bigint, zone_y bigint, at bigint")
    interests = spark.createDataFrame([("p", 0, 0, 1, False, 20), ("p", 5, 5, 1, False, 40), ("p", 0, 0, 1, False, 50), ("p", 0, 0, 1, True, 60), ("p", 0, 0, 1, False, 70)],
                                      "recipient string, zone_x bigint, zone_y bigint, radius int, refresh boolean, at bigint")
    acks = spark.createDataFrame([("p", 1, 1, 25), ("p", 9, 9, 26)], "recipient string, object_id bigint, revision bigint, at bigint")
    deliveries, verdicts = L.interest_deliveries(log, interests, acks)
    # at 50 revision 2 is still pending from the delta at 30; the refresh at 60 drops pending and replays; 70 changes nothing
    assert rows(deliveries, "seq", "object_id", "revision", "kind", "at") == [(1, 1, 1, "snapshot", 20), (2, 1, 2, "delta", 30), (3, 2, 1, "tombstone", 40), (4, 1, 2, "snapshot", 60)]
    assert rows(verdicts, "object_id", "known") == [(1, True), (9, False)]


def test_nested_diff_tells_a_lone_parent_once(spark):
    schema = "part string, field string, sub string, kind string"
    old = spark.createDataFrame([("a", "x", "1", "int"), ("a", "y", "1", "int"), ("b", "x", "1", "int"), ("b", "z", None, "int"), (None, "q", "1", "int"), ("e", None, None, None)], schema)
    new = spark.createDataFrame([("a", "x", "1", "text"), ("a", "w", "1", None), ("c", "x", "1", "int"), (None, "q", "2", "int"), ("e", "f", "1", "int")], schema)
    got = rows(nested_diff(old, new, ["part"], ["field", "sub"], "kind"), "part", "field", "sub", "change", "children", "old_value", "new_value")
    assert got == sorted([("b", None, None, "removed", 2, None, None), ("c", None, None, "added", 1, None, None), ("a", "x", "1", "retyped", None, "int", "text"),
                          ("a", "y", "1", "removed", None, "int", None), ("a", "w", "1", "added", None, None, None), (None, "q", "1", "removed", None, "int", None),
                          (None, "q", "2", "added", None, None, "int"), ("e", "f", "1", "added", None, None, "int")], key=repr)
    assert nested_diff(old.limit(0), new.limit(0), ["part"], ["field", "sub"], "kind").count() == 0


class Journal:
    """One gateway, row by row: objects, interests, pending deliveries and a sequence per recipient."""

    def __init__(self):
        self.epoch, self.objects, self.interests, self.pending, self.seq = None, {}, {}, set(), {}
        self.verdicts, self.deliveries, self.acks = [], [], []

    def send(self, to, obj, rev, kind, at):
        self.seq[to] = self.seq.get(to, 0) + 1
        self.deliveries.append((to, self.seq[to], obj, rev, kind, at))
        self.pending.add((to, obj, rev))

    def row(self, epoch, obj, rev, dead, only, to, zone, at):
        if not (epoch or "").strip():
            return self.verdicts.append((at, "world_epoch_invalid"))
        self.epoch = self.epoch or epoch
        if epoch != self.epoch:
            return self.verdicts.append((at, "world_epoch_not_active"))
        held = self.objects.get(obj)
        if not only and held and rev <= held[0]:
            if to and to in self.interests:
                self.send(to, obj, held[0], "tombstone" if held[1] else "snapshot", at)
                return self.verdicts.append((at, "targeted_replay"))
            return self.verdicts.append((at, "stale_journal_revision"))
        if not only:
            self.objects[obj] = (rev, dead, zone)
        kind = "tombstone" if dead else "delta"
        self.verdicts.append((at, "delivery_only" if only else kind))
        for recipient, area in sorted(self.interests.items()):
            if recipient == to if to else max(abs(area[0] - zone[0]), abs(area[1] - zone[1])) <= 1:
                self.send(recipient, obj, rev, kind, at)

    def register(self, to, zone, refresh, at):
        changed = self.interests.get(to) != zone
        self.interests[to] = zone
        if changed or refresh:
            for obj, (rev, dead, place) in sorted(self.objects.items()):
                if max(abs(zone[0] - place[0]), abs(zone[1] - place[1])) <= 1 and (refresh or (to, obj, rev) not in self.pending):
                    self.send(to, obj, rev, "tombstone" if dead else "snapshot", at)

    def ack(self, to, obj, rev, at):
        self.acks.append((to, obj, rev, at, (to, obj, rev) in self.pending))
        self.pending.discard((to, obj, rev))


@pytest.mark.parametrize("limit", [None, 25])
def test_journal_and_interests_match_one_gateway(spark, limit):
    rng, gate, log, regs, acks = random.Random(12), Journal(), [], [], []
    for at in range(1, 700):
        what, to = rng.random(), rng.choice("abc")
        if what < 0.75:
            obj = rng.randrange(30)
            row = (rng.choice(["e"] * 8 + ["old", " ", None]) if at > 1 else "e", obj, rng.randrange(60), rng.random() < 0.2, rng.random() < 0.15, rng.choice([None, "", "a", "b", "nobody", None]), obj % 5, obj % 3, at)
            log.append(row)
            gate.row(*row[:6], row[6:8], at)
        elif what < 0.83:
            zone, refresh = (rng.randrange(5), rng.randrange(3)), rng.random() < 0.2
            regs.append((to, *zone, 1, refresh, at))
            gate.register(to, zone, refresh, at)
        else:
            mark = rng.choice(gate.deliveries)[2:4] if gate.deliveries and rng.random() < 0.8 else (99, 99)
            acks.append((to, *mark, at))
            gate.ack(to, *mark, at)
    df = spark.createDataFrame(log, "world_epoch string, object_id bigint, revision bigint, tombstone boolean, delivery_only boolean, delivery_recipient string, zone_x bigint, zone_y bigint, at bigint")
    interests = spark.createDataFrame(regs, "recipient string, zone_x bigint, zone_y bigint, radius int, refresh boolean, at bigint")
    if limit:
        spark.conf.set("tidegauge.groupRows", limit)
    try:
        judged = L.journal_verdicts(df, None, ["object_id"], ["at"], "revision", interests)
        assert rows(judged, "at", "verdict") == sorted(gate.verdicts, key=repr) and len({v for _, v in gate.verdicts}) == 7
        sent, marks = L.interest_deliveries(L.journal_mutations(judged, "revision"), interests, spark.createDataFrame(acks, "recipient string, object_id bigint, revision bigint, at bigint"))
        assert rows(sent, *sent.columns) == sorted(gate.deliveries, key=repr)
        assert rows(marks, *marks.columns) == sorted(gate.acks, key=repr)
    finally:
        spark.conf.unset("tidegauge.groupRows")


def test_leases_match_the_step_by_step_walk(spark):
    rng = random.Random(8)
    Op = namedtuple("Op", "object_id op_id at op run_id holder epoch duration")
    ops = [Op(rng.randrange(3), i, rng.randrange(300), rng.choice(["issue", "validate", "validate", "complete", "reclaim"]), rng.choice("xxy"), rng.choice("ab"), rng.randrange(1, 12), 15)
           for i in range(500)]
    want, leases = [], {}
    for op in sorted(ops, key=lambda o: (o.at, o.op_id)):
        leases[op.object_id], reason = Lease.step(leases.get(op.object_id), op)
        want.append((op.op_id, reason))
    df = spark.createDataFrame(ops, "object_id bigint, op_id bigint, at bigint, op string, run_id string, holder string, epoch bigint, duration bigint")
    assert rows(L.lease_state(df), "op_id", "reason") == sorted(want, key=repr)


def test_live_while_younger_than_the_lease(spark):
    df = spark.createDataFrame([("a", 85), ("a", 70), ("b", 86)], "k string, at bigint")
    assert rows(L.liveness(df, ["k"], "at", F.lit(100), 15), "k", "last_touch", "live") == [("a", 85, False), ("b", 86, True)]


def test_consumers_fall_back_to_the_latest_one(spark):
    df = spark.createDataFrame([("w", "a", 10, 1, 5), ("w", "b", 12, 2, 7), ("v", "a", 90, 3, 1), ("v", "b", 85, 4, 2)], "window_id string, consumer_id string, seen bigint, beat_id bigint, applied bigint")
    assert rows(L.consumer_status(df, F.lit(100), 15, ["applied"]), "window_id", "active_consumers", "applied") == [("v", 2, 3), ("w", 0, 7)]


def test_links_are_checked_before_pairing(spark):
    objects = spark.createDataFrame([(i, "t") for i in range(1, 6)] + [(9, "u")], "object_id bigint, tag string")
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (4, 77)], "object_id bigint, target_id bigint")
    broken, pairs = L.session_pairs(links, objects)
    assert rows(broken, "object_id") == [(3,), (4,)]
    assert rows(pairs, "tag", "first_id", "second_id") == [("t", 3, 4)]


CHALLENGE = "challenge_id string, trigger_event string, filters string, window_start bigint, window_end bigint, mode string, target bigint, active boolean, rewards string"
EVENT = "event_id bigint, us bigint, event_type string, guild_id string, actor_id string, payload string"


def test_challenge_freezes_at_the_first_crossing(spark):
    events = spark.createDataFrame([(i, i, "kill", "g", "p", '{"w": %d}' % (i % 2)) for i in range(10)] + [(99, 99, "kill", "", "p", "{}")], EVENT)
    challenges = spark.createDataFrame([("all", "kill", "{}", None, None, "sum", 3, True, '[{"type":"guild_points","amount":7}]'), ("odd", "kill", '{"w": "1"}', 2, 8, "sum", 9, True, "[]"),
                                        ("off", "kill", "{}", None, None, "sum", 1, False, "[]")], CHALLENGE)
    got = P.challenge_progress(events, challenges)
    assert rows(got, "challenge_id", "current_value", "completed", "completed_by", "reward") == [("all", 3, True, 2, 7), ("odd", 3, False, None, 0)]
    assert rows(P.guild_points(events, got), "guild_id", "points", "challenges_completed") == [("g", 7, 1)]


def test_achievements_thresholds(spark):
    day = P.DAY
    placed = [(i, 1000 + i, "structure_placed", "g", f"p{i}", "{}") for i in range(24)]
    joined = [(100 + i, 2000 + i, "player_connected", "g", actor, "{}") for i, actor in enumerate(["a", "b", "", "c", "d", "a"])]
    def state(data, now):
        out = P.achievements(spark.createDataFrame(data, EVENT), F.lit(now))
        return {r.id: (r.unlocked_us, list(r.evidence_ids)) for r in out.collect() if r.unlocked}
    early = state(placed + joined, 1000 + 7 * day - 1)
    assert early == {"first_foundation": (1000, [0])}
    late = state(placed + joined + [(24, 5000, "structure_placed", "g", "z", "{}"), (200, 6000, "player_connected", "g", "e", "{}")], 1000 + 7 * day)
    assert late["community_builder"] == (5000, [0, 24])
    assert late["founding_members"] == (6000, [100, 101, 103, 104, 200])
    assert late["world_age_7_days"] == (1000 + 7 * day, [0])


def test_reliable_overflow_falls_through(spark):
    data = [("A", "portal", 1, 1, 1), ("a", "portal", 1, 2, 1), ("b", "portal", 1, 3, 1), ("c", "loose", 0, 1, 1), ("d", "loose", 2, 1, 1), ("e", "loose", 3, 1, 1)]
    plan = R.delivery_plan(spark.createDataFrame(data, "object_key string, tier string, rank bigint, order_no bigint, distance bigint"), 1, 2)
    assert rows(plan, "object_key", "lane", "lane_order") == [("a", "reliable", 1), ("b", "datagram", 2), ("c", "datagram", 1), ("d", "deferred", 3), ("e", "deferred", 4)]


def test_cursor_falls_back_step_by_step(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 5), (3, "c", 20)], "line bigint, id string, at bigint")
    pick = lambda **k: [r[0] for r in rows(R.cursor_increment(df, "line", "id", "at", 100, default=85, **k), "id")]
    assert pick(since=10) == ["a", "c"] and pick(last_id="a") == ["b", "c"] and pick(last_id="gone", last_at=10) == ["c"] and pick() == ["c"]


def test_nested_diff_sums_up_without_a_sort(spark):
    old = spark.range(20).selectExpr("id % 5 AS part", "id AS field", "id * 3 AS kind")
    new = spark.range(3, 23).selectExpr("id % 5 AS part", "id AS field", "CASE WHEN id % 4 > 0 THEN id * 3 END AS kind")
    got = nested_diff(old, new, ["part"], ["field"], "kind")
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(f, "removed", f * 3, None) for f in range(3)] + [(f, "added", None, f * 3 if f % 4 else None) for f in range(20, 23)]
    want += [(f, "retyped", f * 3, None) for f in range(3, 20) if f % 4 == 0]
    assert rows(got, "field", "change", "old_value", "new_value") == sorted(want, key=repr)


MUTATIONS = "object_id bigint, revision bigint, tombstone boolean, zone_x bigint, zone_y bigint, at bigint, target string, changes boolean, replay boolean"


def told_at_random(spark):
    """Mutations, registrations and acks; keys may be missing, acks repeat."""
    rng = random.Random(3)
    told = []
    for at in range(1, 400, 2):
        obj, kind = rng.choice([None, *range(8)]), rng.random()
        told.append((obj, at if kind < 0.7 else at - 2, rng.random() < 0.2, (obj or 0) % 4, (obj or 0) % 3, at, rng.choice("ab") if kind > 0.8 else None, kind < 0.7, kind > 0.9))
    regs = [(r, rng.randrange(4), rng.randrange(3), rng.randrange(2), rng.random() < 0.3, 2 * at) for at, r in zip(rng.sample(range(200), 24), [*"abc", None] * 6)]
    acks = [(rng.choice(["a", "b", "c", None, "z"]), *rng.choice(told)[:2], rng.randrange(400)) for _ in range(600)]
    return (spark.createDataFrame(told, MUTATIONS), spark.createDataFrame(regs, "recipient string, zone_x bigint, zone_y bigint, radius int, refresh boolean, at bigint"),
            spark.createDataFrame(acks + acks[:50], "recipient string, object_id bigint, revision bigint, at bigint"))


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]


def test_acks_look_up_what_was_told_and_are_not_moved(spark, monkeypatch):
    told, regs, acks = told_at_random(spark)
    found = L.interest_acks(told, regs, acks.repartition(5, "object_id", "revision"))
    assert len([e for e in exchanges(found) if "recipient" in e and "object_id" in e]) < 2, "only acks without an object or a revision are"
    names = ("recipient", "object_id", "revision", "at", "known")
    got = rows(found, *names)
    monkeypatch.setattr(L, "LOOKED_UP", 0)
    assert got == rows(L.interest_acks(told, regs, acks), *names)
    assert len(got) == 650 and {True, False} == {r[-1] for r in got}


def test_deliveries_are_shuffled_once(spark):
    told, regs, acks = told_at_random(spark)
    sent, _ = L.interest_deliveries(told, regs, acks)
    assert not [e for e in exchanges(sent) if "recipient" in e and "object_id" in e], "both passes keep to one layout by recipient"
    names = sent.columns
    spark.conf.set("tidegauge.groupRows", 20)
    try:
        assert rows(sent, *names) == rows(L.interest_deliveries(told, regs, acks)[0], *names)
    finally:
        spark.conf.unset("tidegauge.groupRows")
