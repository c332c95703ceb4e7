"""Streaming queries: the given tables are replayed through a stream and drained; results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.plans.bindings import bind, table
from tidegauge.plans.interest import HITS, HOUR, HYSTERESIS, QUEST_ALIASES, QUEST_FIRE, WITNESS, quest_inputs, spaced_sql
from tidegauge.plans.ledgers import LEASES, _lease_ops
from tidegauge.plans.registry import query
from tidegauge.sources.sinks import scratch
from tidegauge.streaming import streams as S


def _stream(spark, df, name, at):
    return S.replay(df, scratch(spark, name), at)


def _drain(spark, sdf, name):
    return S.run_available(sdf, scratch(spark, name))


@query("stream_feed", f"""
    SELECT event_id AS capture_seq, event_type, region_id, CASE WHEN k % 2 = 0 THEN 'observed' ELSE 'reported' END AS provenance FROM b_game
    WHERE event_type IN ('structure_placed', 'player_discovered_landmark', 'quest_completed')""")
def stream_feed(spark, sf):
    ev = bind(spark, sf, "b_game").select(F.col("event_id").alias("capture_seq"), "event_type", "occurred_at", "region_id", F.col("k").cast("string").alias("detail"),
                                          F.when(F.col("k") % 2 == 1, "reported").alias("provenance"), "actor_id")
    feed = S.stream_feed(_stream(spark, ev, "feed", "capture_seq"))
    return _drain(spark, feed, "feed-out").select("capture_seq", "event_type", "region_id", "provenance")


@query("cooldown_stream", f"""
    WITH RECURSIVE {spaced_sql("SELECT actor_id, event_type, us, event_id FROM b_events", "actor_id, event_type", 12 * HOUR)}
    SELECT s.event_id, p.us IS NOT NULL AS picked FROM src s LEFT JOIN p ON p.actor_id = s.actor_id AND p.event_type = s.event_type AND p.us = s.us""")
def cooldown_stream(spark, sf):
    ev = bind(spark, sf, "b_events").select("actor_id", "event_type", "us", "event_id")
    out = S.spaced_stream(_stream(spark, ev, "cooldown", "us"), ["actor_id", "event_type"], "us", ["event_id"], 12 * HOUR)
    return _drain(spark, out, "cooldown-out").select("event_id", "picked")


@query("quest_fire_stream", QUEST_FIRE)
def quest_fire_stream(spark, sf):
    events, quests = quest_inputs(spark, sf)
    out = S.quest_fire_stream(_stream(spark, events, "quests", "us"), quests, ["player"], "us", ["event_id"], 12 * HOUR, 20 * HOUR, QUEST_ALIASES)
    return _drain(spark, out, "quests-out").select("event_id", "quest_id", "player", "fired")


@query("first_hit_stream", f"""
    WITH RECURSIVE {spaced_sql(f"SELECT *, CASE WHEN death THEN -1 ELSE deaths END AS part FROM ({HITS}) h", "target_id, part", 6 * HOUR)}
    SELECT s.event_id AS hit_id, CASE WHEN p.us IS NULL THEN 'none' WHEN death THEN 'killing_blow' ELSE 'first_hit' END AS emitted
    FROM src s LEFT JOIN p ON p.target_id = s.target_id AND p.part = s.part AND p.us = s.us""")
def first_hit_stream(spark, sf):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "death").otherwise("hit")
    hits = bind(spark, sf, "b_events").select(F.col("k").alias("target_id"), F.col("us").alias("at"), F.col("event_id").alias("hit_id"), kind.alias("kind"))
    return _drain(spark, S.first_hit_stream(_stream(spark, hits, "hits", "at"), 6 * HOUR), "hits-out").select("hit_id", "emitted")


JOURNAL = """WITH t AS (SELECT *, MAX(object_revision) OVER (PARTITION BY object_id ORDER BY ship_us, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b_journal WHERE world_epoch = 'now' AND NOT delivery_only)"""


@query("journal_stream", JOURNAL + """SELECT CASE WHEN object_revision <= top THEN 'stale_journal_revision' WHEN tombstone THEN 'tombstone' ELSE 'delta' END AS verdict, COUNT(*) AS n,
      CAST(SUM(object_revision) AS BIGINT) AS revisions FROM t GROUP BY 1""")
def journal_stream(spark, sf):
    order = ["ship_us", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    log = bind(spark, sf, "b_journal").select("world_epoch", "delivery_only", "object_id", "object_revision", "tombstone", *order)
    out = S.journal_stream(_stream(spark, log, "journal", "ship_us"), ["object_id"], order, "object_revision", "now")
    return _drain(spark, out, "journal-out").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("object_revision").alias("revisions"))


# Sequences that may wait, so that many recipients shed some.
MAX_PENDING = 40


@query("receipt_ledger", f"""
    WITH RECURSIVE g AS (SELECT window_id, recipient_id, us, list(DISTINCT seq) AS seqs, ROW_NUMBER() OVER (PARTITION BY window_id, recipient_id ORDER BY us) AS n FROM b_receipts GROUP BY 1, 2, 3),
    w AS (SELECT window_id, recipient_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS waiting, CAST(0 AS BIGINT) AS shed FROM g WHERE n = 1
      UNION ALL SELECT window_id, recipient_id, n, CASE WHEN over > 0 THEN list_sort(pool)[over + {MAX_PENDING // 10 + 1}:] ELSE pool END, shed + CASE WHEN over > 0 THEN over + {MAX_PENDING // 10} ELSE 0 END
      FROM (SELECT g.window_id, g.recipient_id, g.n, w.shed, list_distinct(list_concat(waiting, seqs)) AS pool, len(list_distinct(list_concat(waiting, seqs))) - {MAX_PENDING} AS over
            FROM w JOIN g ON g.window_id = w.window_id AND g.recipient_id = w.recipient_id AND g.n = w.n + 1) x),
    last AS (SELECT window_id, recipient_id, arg_max(waiting, n) AS waiting, arg_max(shed, n) AS shed FROM w GROUP BY 1, 2),
    acks AS (SELECT window_id, recipient_id, list(DISTINCT seq) AS seqs FROM b_receipts WHERE acked GROUP BY 1, 2),
    t AS (SELECT window_id, recipient_id, COUNT(*) AS receipts, COUNT(DISTINCT seq) AS distinct_seq, MIN(seq) AS min_seq, MAX(seq) AS max_seq FROM b_receipts GROUP BY 1, 2)
    SELECT t.window_id, t.recipient_id, receipts, distinct_seq, receipts - distinct_seq AS duplicates, CAST(len(list_intersect(waiting, coalesce(seqs, []))) AS BIGINT) AS acked,
      CAST(len(coalesce(seqs, [])) - len(list_intersect(waiting, coalesce(seqs, []))) AS BIGINT) AS unknown_acks, CAST(len(waiting) - len(list_intersect(waiting, coalesce(seqs, []))) AS BIGINT) AS pending,
      min_seq, max_seq, GREATEST(0, max_seq - distinct_seq) AS missing, CAST(shed AS BIGINT) AS shed
    FROM t JOIN last USING (window_id, recipient_id) LEFT JOIN acks USING (window_id, recipient_id)""")
def receipt_ledger(spark, sf):
    """Status after all receipts and acks; each recipient's oldest pending sequences are shed whenever more than ``MAX_PENDING`` wait."""
    rows = bind(spark, sf, "b_receipts")
    receipts = rows.select("window_id", "recipient_id", "seq", "us", "line", F.lit("receipt").alias("kind"))
    acks = rows.filter("acked").select("window_id", "recipient_id", "seq").distinct().select(
        "window_id", "recipient_id", "seq", F.lit(4_000_000_000_000_000).alias("us"), F.lit(0).cast("bigint").alias("line"), F.lit("ack").alias("kind"))
    out = S.receipt_ledger(_stream(spark, receipts.unionByName(acks), "receipts", "us"), MAX_PENDING)
    # a row per key and micro-batch; these counts only grow, so the largest is the last
    last = F.max_by(F.struct("*"), F.struct("receipts", F.col("acked") + F.col("unknown_acks")))
    return _drain(spark, out, "receipts-out").groupBy("window_id", "recipient_id").agg(last.alias("r")).select("r.*").select(
        "window_id", "recipient_id", "receipts", "distinct_seq", "duplicates", "acked", "unknown_acks", "pending", "min_seq", "max_seq", "missing", "shed")


@query("witness_stream", WITNESS)
def witness_stream(spark, sf):
    reports = bind(spark, sf, "b_events").select(F.col("guild_id").alias("basis"), F.col("actor_id").alias("witness"), F.col("us").alias("at"), F.col("event_id").alias("report_id"))
    return _drain(spark, S.witness_stream(_stream(spark, reports, "witness", "at"), HOUR), "witness-out").select("report_id", "action")


@query("hysteresis_stream", HYSTERESIS.replace("AS transition, within FROM h", "AS transition FROM h"))
def hysteresis_stream(spark, sf):
    from tidegauge.operators.ordered import ordered, position

    obs = bind(spark, sf, "b_events").groupBy(F.col("guild_id").alias("object_id"), F.col("actor_id").alias("peer_id"), F.expr("us div 21600000000").alias("tick")).agg(F.min("value").alias("distance"))
    ticks = ordered(obs.select("object_id", "tick").distinct(), ["object_id"], ["tick"]).scan(tick_no=position()).df
    out = S.hysteresis_stream(_stream(spark, obs.join(ticks, ["object_id", "tick"]), "hysteresis", "tick"), 60.0, 30.0)
    return _drain(spark, out, "hysteresis-out")


@query("lease_stream", LEASES)
def lease_stream(spark, sf):
    return _drain(spark, S.lease_stream(_stream(spark, _lease_ops(spark, sf), "lease", "at")), "lease-out")


@query("tick_stream", """
    WITH n AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY stream ORDER BY us, tick) - 1) // 100 AS w FROM b_ticks),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream, w ORDER BY total_ms) AS rt FROM n)
    SELECT stream, w AS "window", COUNT(*) AS samples, MAX(us) AS end_at, MAX(CASE WHEN rt = 50 THEN total_ms END) AS total_ms_p50, MAX(CASE WHEN rt = 99 THEN total_ms END) AS total_ms_p99, MAX(total_ms) AS total_ms_max,
      CAST(SUM(CASE WHEN total_ms > 50 THEN 1 ELSE 0 END) AS BIGINT) AS overruns, CAST(SUM(sent) AS BIGINT) AS sent FROM o GROUP BY stream, w HAVING COUNT(*) = 100""")
def tick_stream(spark, sf):
    ticks = bind(spark, sf, "b_ticks").select("stream", "tick", "us", "total_ms", "sent")
    return _drain(spark, S.tick_stream(_stream(spark, ticks, "ticks", "us")), "ticks-out")


# A lease of so many milliseconds, so that most keys lose and renew theirs several times.
LEASE_MS = 5 * 86_400_000 + 1


@query("liveness_stream", f"""
    WITH t AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000 AS ms FROM events),
    g AS (SELECT key, ms, LAG(ms) OVER w AS before, LEAD(ms) OVER w AS after, MAX(ms) OVER () AS newest FROM t WINDOW w AS (PARTITION BY key ORDER BY ms))
    SELECT key, ms, TRUE AS live FROM g WHERE before IS NULL OR ms - before >= {LEASE_MS}
    UNION ALL SELECT key, ms + {LEASE_MS}, FALSE FROM g WHERE after - ms >= {LEASE_MS} OR (after IS NULL AND ms + {LEASE_MS} <= newest - 600000)""")
def liveness_stream(spark, sf):
    """Every life of a key: its first touch and the end of its lease, told by the next touch or by a timer of the watermark."""
    ev = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return _drain(spark, S.liveness_stream(_stream(spark, ev, "touches", "ms"), "user_id", "ts", LEASE_MS), "touches-out")
