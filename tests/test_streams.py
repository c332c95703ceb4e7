"""Streams cut into several micro-batches give the rows of the batch forms."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import oracle
from conftest import rows
from tidegauge.operators import interest as I, ledger as L, temporal as T
from tidegauge.operators.ordered import ordered, position
from tidegauge.plans import catalog
from tidegauge.streaming import processors as P, streams as S


STREAMS = ["stream_feed", "cooldown_stream", "quest_fire_stream", "first_hit_stream", "journal_stream", "receipt_ledger", "witness_stream", "hysteresis_stream",
           "lease_stream", "tick_stream", "liveness_stream"]


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Each task of a stateful operator starts a Python worker in each micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", STREAMS)
def test_queries_in_several_batches(spark, name):
    """In three micro-batches, with ``ORACLE_ALL`` in seven."""
    batches = 7 if os.environ.get("ORACLE_ALL") else 3
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    spark.conf.set("tidegauge.replayRows", -(-(6100 if name in ("journal_stream", "receipt_ledger", "lease_stream") else events) // batches))
    try:
        ok, note, _ = oracle.compare(spark, oracle.connect(folder), name, catalog.QUERIES[name], catalog.ORACLES[name], folder)
    finally:
        spark.conf.unset("tidegauge.replayRows")
    assert ok, note


def drained(df, tmp_path, at, make, batch_rows=60):
    stream = S.replay(df, str(tmp_path / "in"), at, batch_rows)
    return S.run_available(make(stream), str(tmp_path / "run"))


def test_cooldown(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randrange(3000), i) for i in range(300)], "k string, at bigint, id bigint")
    out = drained(df, tmp_path, "at", lambda s: S.spaced_stream(s, ["k"], "at", ["id"], 50))
    assert rows(out, "id", "picked") == [(i, f) for i, f in rows(I.cooldown_fire(df, ["k"], "at", ["id"], 50), "id", "fired")]


def test_witness(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(2), rng.randrange(5), rng.randrange(2000), i) for i in range(300)], "basis bigint, witness bigint, at bigint, report_id bigint")
    assert rows(drained(df, tmp_path, "at", lambda s: S.witness_stream(s, 9)), "report_id", "action") == rows(I.witness_merge(df, 9), "report_id", "action")


def test_first_hit(spark, tmp_path):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randrange(4), rng.randrange(2000), i, rng.choice(["hit", "hit", "hit", "death"])) for i in range(300)], "target_id bigint, at bigint, hit_id bigint, kind string")
    assert rows(drained(df, tmp_path, "at", lambda s: S.first_hit_stream(s, 30)), "hit_id", "emitted") == rows(I.first_hit(df, 30), "hit_id", "emitted")


def test_hysteresis(spark, tmp_path):
    rng = random.Random(3)
    data = {(rng.randrange(3), rng.randrange(4), rng.randrange(60)) for _ in range(300)}
    obs = spark.createDataFrame([(*d, rng.choice([30.0, 64.0, 68.0, 72.0, 80.0])) for d in sorted(data)], "object_id bigint, peer_id bigint, tick bigint, distance double")
    ticks = ordered(obs.select("object_id", "tick").distinct(), ["object_id"], ["tick"]).scan(tick_no=position()).df
    out = drained(obs.join(ticks, ["object_id", "tick"]), tmp_path, "tick", lambda s: S.hysteresis_stream(s, 64.0, 8.0))
    names = ("object_id", "peer_id", "tick", "transition")
    assert rows(out, *names) == rows(I.hysteresis(obs, 64.0, 8.0), *names)


def test_leases(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.randrange(3), i, rng.randrange(900), rng.choice(["issue", "validate", "complete", "reclaim"]), "run", rng.choice("ab"), rng.randrange(1, 30), 40) for i in range(300)]
    ops = spark.createDataFrame(data, "object_id bigint, op_id bigint, at bigint, op string, run_id string, holder string, epoch bigint, duration bigint")
    names = ("op_id", "lease_epoch", "reason")
    assert rows(drained(ops, tmp_path, "at", S.lease_stream), *names) == rows(L.lease_state(ops), *names)


def test_journal(spark, tmp_path):
    rng = random.Random(5)
    log = spark.createDataFrame([("now", False, rng.randrange(20), rng.randrange(40), rng.random() < 0.2, i) for i in range(300)],
                                "world_epoch string, delivery_only boolean, object_id bigint, object_revision bigint, tombstone boolean, line bigint")
    out = drained(log, tmp_path, "line", lambda s: S.journal_stream(s, ["object_id"], ["line"], "object_revision", "now"))
    assert rows(out, "line", "verdict") == rows(L.journal_verdicts(log, "now", ["object_id"], ["line"], "object_revision"), "line", "verdict")


def test_states_of_many_keys_lie_side_by_side(spark, tmp_path, monkeypatch):
    """A call and a state for a bucket of keys, not for each; keys with a missing part are keys like others."""
    monkeypatch.setattr(S, "BUCKETS", 3)
    df = spark.range(400).selectExpr("CASE WHEN id % 50 > 0 THEN id % 50 END AS a", "CASE WHEN id % 7 > 0 THEN 'x' || id % 7 END AS b", "id AS at", "id")
    out = drained(df, tmp_path, "at", lambda s: S.spaced_stream(s, ["a", "b"], "at", ["id"], 360), 150)
    last, want = {}, []
    for i in range(400):
        key = (i % 50, i % 7)
        take = key not in last or i - last[key] >= 360
        last[key] = i if take else last[key]
        want.append((i, take))
    assert rows(out, "id", "picked") == sorted(want, key=repr)
    kept = spark.read.format("statestore").load(str(tmp_path / "run" / "checkpoint"), stateVarName="states")
    assert 3 <= kept.count() <= 12, "three buckets for each pattern of missing parts"


def test_ledgers_of_many_recipients_lie_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 2)
    df = spark.range(600).selectExpr("'receipt' AS kind", "id div 20 * 2 + id % 20 % 3 AS seq", "id AS us", "id AS line", "id % 3 AS window_id", "id % 20 AS recipient_id")
    out = drained(df, tmp_path, "us", lambda s: S.receipt_ledger(s, 10), 200)
    last = out.groupBy("window_id", "recipient_id").agg(F.max("receipts").alias("receipts"), F.max("distinct_seq").alias("seqs"))
    want = df.groupBy("window_id", "recipient_id").agg(F.count("seq").alias("receipts"), F.countDistinct("seq").alias("seqs"))
    names = ("window_id", "recipient_id", "receipts", "seqs")
    assert rows(last, *names) == rows(want, *names)
    kept = spark.read.format("statestore").load(str(tmp_path / "run" / "checkpoint"), stateVarName="ledgers")
    assert kept.count() == 2


def test_ticks_wait_for_a_full_window(spark, tmp_path):
    ticks = spark.range(330).selectExpr("id % 2 AS stream", "id AS tick", "id AS us", "(id * 7) % 90 AS total_ms", "1L AS sent", "false AS degraded")
    out = drained(ticks, tmp_path, "us", lambda s: S.tick_stream(s.drop("degraded")), 70)
    names = ["stream", "window", "samples", "total_ms_p50", "total_ms_p99", "total_ms_max", "overruns", "sent"]
    assert rows(out, *names) == rows(T.tick_windows(ticks, "stream", ["us", "tick"], ["total_ms"], ["sent"], "total_ms"), *names)


def test_intervals_are_a_set():
    rng = random.Random(6)
    for _ in range(50):
        seen, ranges = set(), P.Intervals([])
        for n in [rng.randrange(60) for _ in range(80)]:
            assert ranges.add(n) == (n not in seen)
            seen.add(n)
        assert {n for a, b in zip(ranges.starts, ranges.ends) for n in range(a, b + 1)} == seen
        assert all(b + 1 < a for b, a in zip(ranges.ends, ranges.starts[1:]))


def test_ledger_sheds_once_a_batch_however_micro_batches_are_cut(spark, tmp_path):
    data = [("receipt", s, s // 10, s) for s in range(1, 60)] + [("ack", 59, 6, 0), ("ack", 59, 6, 1), ("ack", 1, 6, 2)]
    df = spark.createDataFrame(data, "kind string, seq bigint, us bigint, line bigint").selectExpr("1L AS window_id", "2L AS recipient_id", "*")
    found = set()
    for n in (4, 25, 1000):  # micro-batches end inside a batch
        out = drained(df, tmp_path / str(n), "us", lambda s: S.receipt_ledger(s, 20), n)
        found.add(tuple(out.orderBy(F.desc("receipts"), F.desc(F.col("acked") + F.col("unknown_acks"))).drop("batch_us").first()))
    # batches of ten: 29 wait after the third, so 9 and a tenth of the bound go; 28 after the fourth, and so on
    assert found == {(1, 2, 59, 59, 0, 1, 1, 41, 17, 1, 59, 0)}


def test_state_of_seen_sequences_grows_with_gaps(spark, tmp_path):
    df = spark.range(1, 2001).filter("id <> 700").selectExpr("'receipt' AS kind", "id AS seq", "id AS us", "id AS line", "1L AS window_id", "2L AS recipient_id")
    drained(df, tmp_path, "us", lambda s: S.receipt_ledger(s, 50), 500)
    kept = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "run" / "checkpoint"))
    assert sorted(tuple(r) for r in kept.selectExpr("user_map_key.first", "user_map_value.last").collect()) == [(1, 699), (701, 2000)]


def test_witnesses_and_cooldowns_are_forgotten(spark, tmp_path):
    hour = 3_600_000_000
    df = spark.createDataFrame([(b, w, t * hour + w, 10 * t + w) for t in range(1, 9) for b in range(3) for w in range(4)], "basis bigint, witness bigint, at bigint, report_id bigint")
    out = drained(df, tmp_path, "at", lambda s: S.witness_stream(s, 1_000_000), 30)
    assert rows(out, "report_id", "action") == rows(I.witness_merge(df, 1_000_000), "report_id", "action")
    kept = spark.read.format("statestore").option("stateVarName", "heard").load(str(tmp_path / "run" / "checkpoint"))
    assert kept.count() == 12, "the witnesses of the last action of three bases"
    quests = spark.createDataFrame([("q", "kill", "", None, False, None)], QUEST)
    events = spark.createDataFrame([("p", t * hour, t, "kill", f"key{t}") for t in range(1, 40)], "player string, us bigint, id bigint, event_name string, dedupe_key string").selectExpr(
        "*", "'x' AS target", "'y' AS weapon_skill", "true AS projectile", "map('a', 'b') AS fields")
    out = drained(events, tmp_path / "quest", "us", lambda s: S.quest_fire_stream(s, quests, ["player"], "us", ["id"], hour, hour), 8)
    assert dict(rows(out, "id", "fired")) == dict.fromkeys(range(1, 40), True)
    kept = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "quest" / "run" / "checkpoint"))
    assert kept.count() < 14, "keys of passed events are gone"


def test_quests_in_a_stream_and_in_batch(spark, tmp_path):
    rng = random.Random(8)
    data = [(rng.choice("ab"), rng.randrange(4000) * 1000, n, rng.choice(["Kill", "Slay", "Cut"]), rng.choice(["x", "y", " ", None])) for n in range(300)]
    events = spark.createDataFrame(data, "player string, us bigint, id bigint, event_name string, dedupe_key string").selectExpr(
        "*", "CASE id % 3 WHEN 0 THEN 'Troll(Clone)' ELSE 'Boar' END AS target", "'Bows' AS weapon_skill", "id % 2 = 0 AS projectile", "map('a', 'b') AS fields")
    quests = spark.createDataFrame([("q1", "kill", "troll_or_deer", "", False, None), ("q2", "slay", "any", "bows", True, {"a": "any"}), ("q3", "cut", "", None, False, {"c": "d"})], QUEST)
    want = quest_walk(sorted(data, key=lambda r: (r[1], r[2])), 60_000, 25_000)
    alias = {"slay": "kill"}
    for limit in (None, 25):
        assert rows(I.quest_fire(events, quests, ["player"], "us", ["id"], 60_000, 25_000, alias, limit), "id", "quest_id", "fired") == want
    out = drained(events, tmp_path, "us", lambda s: S.quest_fire_stream(s, quests, ["player"], "us", ["id"], 60_000, 25_000, alias))
    assert rows(out, "id", "quest_id", "fired") == want
    free = I.quest_fire(events, quests, ["player"], "us", ["id"], 0, 0, alias)
    assert free.filter("fired").count() == free.count() > len(want)


QUEST = "quest_id string, trigger_event string, trigger_target string, trigger_weapon string, trigger_projectile boolean, trigger_where map<string,string>"


def quest_walk(data, cooldown, window):
    """One player's evaluator after another, event by event."""
    used, fired, out = {}, {}, []
    for player, at, n, name, key in data:
        name = {"slay": "kill"}.get(name.lower(), name.lower())
        if key and key.strip():
            last = used.get((player, name, key))
            if last is not None and at - last < window:
                continue
            used[player, name, key] = at
        for quest, fits in (("q1", name == "kill" and n % 3 == 0), ("q2", name == "kill" and n % 2 == 0)):
            if fits:
                take = (player, quest) not in fired or at - fired[player, quest] >= cooldown
                fired[player, quest] = at if take else fired[player, quest]
                out.append((n, quest, take))
    return sorted(out, key=repr)


def test_ledger_sheds_the_oldest_in_batches(spark, tmp_path):
    data = [("receipt", s, s, s) for s in range(1, 24)] + [("ack", 23, 30, 0), ("ack", 1, 31, 0), ("receipt", 23, 40, 50)]
    df = spark.createDataFrame(data, "kind string, seq bigint, us bigint, line bigint").selectExpr("1L AS window_id", "2L AS recipient_id", "*")
    out = drained(df, tmp_path, "us", lambda s: S.receipt_ledger(s, 20), 1000)
    # the 21st pending row sheds 1 over the bound plus a tenth of it (2); 23 then fits
    r = out.first()
    assert (r.receipts, r.distinct_seq, r.duplicates, r.shed, r.acked, r.unknown_acks, r.pending) == (24, 23, 1, 3, 1, 1, 20)


def test_liveness_expires_by_event_time(spark, tmp_path):
    data = [("a", 1000), ("b", 1006), ("d", 1030), ("b", 1031), ("c", 1100), ("c", 1200)]
    df = spark.createDataFrame(data, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    out = drained(df, tmp_path, "s", lambda s: S.liveness_stream(s, "k", "ts", 15_000, "0 seconds"), 1)
    assert {r[0] for r in rows(out.filter("live"), "key")} == {"a", "b", "c", "d"}
    dead = rows(out.filter("not live"), "key", "ms")
    assert ("a", 1_015_000) in dead and ("d", 1_045_000) in dead and "c" not in {k for k, ms in dead if ms > 1_200_000}


def test_feed_has_no_actor(spark, tmp_path):
    df = spark.createDataFrame([(1, "quest_completed", "p", "r", "d", None), (2, "secret", "p", "r", "d", None)],
                               "capture_seq bigint, event_type string, actor_id string, region_id string, detail string, provenance string").withColumn("occurred_at", F.timestamp_seconds(F.lit(0)))
    out = drained(df, tmp_path, "capture_seq", S.stream_feed)
    assert "actor_id" not in out.columns and rows(out, "capture_seq", "provenance") == [(1, "observed")]


def test_replay_keeps_null_times_and_cuts_heavy_values(spark, tmp_path):
    df = spark.range(200).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 7 ELSE id END AS at", "'x' AS note")
    stream = S.replay(df, str(tmp_path / "in"), "at", 20)
    assert rows(S.run_available(stream, str(tmp_path / "run")), "id", "at") == rows(df, "id", "at")
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "in" / "arrived")).groupBy(F.col("_metadata.file_name")).count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 60


def test_no_task_of_a_replay_sorts_a_whole_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_FILE", 100)
    df = spark.range(4000).selectExpr("id DIV 3 AS at", "id")
    stream = S.replay(df, str(tmp_path), "at", 1000)
    cut = spark.read.parquet(f"{tmp_path}/cut").selectExpr("__batch", "at", "id", "_metadata.file_path AS file")
    assert max(r["count"] for r in cut.groupBy("file").count().collect()) < 400, "ten tasks a batch"
    ends = sorted(tuple(r) for r in cut.groupBy("__batch").agg({"at": "min", "id": "count"}).collect())
    assert len(ends) == 4 and sum(r[2] for r in ends) == 4000
    assert sorted(r["id"] for r in S.run_available(stream, str(tmp_path / "run")).collect()) == list(range(4000))
    assert [r["__batch"] for r in cut.orderBy("at", "id").select("__batch").distinct().orderBy("__batch").collect()] == [0, 1, 2, 3]
