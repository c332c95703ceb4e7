"""Queries over delivery ledgers, progress and ranked selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import ledger as L, progress as P, ranking as R, sets as D
from tidegauge.operators.ordered import ordered, position
from tidegauge.plans.bindings import bind, table
from tidegauge.plans.registry import query
from tidegauge.runtime import cut_lineage, literal_rows

ACKS = "(SELECT window_id, recipient_id, seq FROM b_receipts WHERE acked UNION ALL SELECT window_id, recipient_id, -recipient_id FROM b_receipts WHERE line % 1000 = 0)"

STATUS = f"""s AS (SELECT window_id, recipient_id, COUNT(*) AS receipts, COUNT(DISTINCT seq) AS distinct_seq, MIN(seq) AS min_seq, MAX(seq) AS max_seq,
        CAST(SUM(CASE WHEN empty_body THEN 1 ELSE 0 END) AS BIGINT) AS empty_bodies, MIN(us) AS first_us, MAX(us) AS last_us FROM b_receipts GROUP BY 1, 2),
    a AS (SELECT window_id, recipient_id, COUNT(DISTINCT CASE WHEN seq >= 0 THEN seq END) AS acked, COUNT(DISTINCT CASE WHEN seq < 0 THEN seq END) AS unknown_acks FROM {ACKS} x GROUP BY 1, 2),
    st AS (SELECT s.*, COALESCE(acked, 0) AS acked, COALESCE(unknown_acks, 0) AS unknown_acks, receipts - distinct_seq AS duplicates, distinct_seq - COALESCE(acked, 0) AS pending,
        GREATEST(0, max_seq - distinct_seq) AS missing, distinct_seq >= 1000000 AS saturated FROM s LEFT JOIN a USING (window_id, recipient_id))"""


def _status(spark, sf):
    receipts = bind(spark, sf, "b_receipts")
    acks = receipts.filter("acked").select("window_id", "recipient_id", "seq").unionByName(
        receipts.filter("line % 1000 = 0").select("window_id", "recipient_id", (-F.col("recipient_id")).alias("seq")))
    # sequence 0 is never used by the binding, so recipient 0 acks an unknown sequence only when it differs from one
    return L.receipt_status(receipts, acks)


@query("receipt_status", f"WITH {STATUS.replace('seq < 0', 'seq <= 0').replace('seq >= 0', 'seq > 0')} SELECT * FROM st")
def receipt_status(spark, sf):
    return _status(spark, sf)


@query("receipt_rollup", f"""
    WITH {STATUS.replace('seq < 0', 'seq <= 0').replace('seq >= 0', 'seq > 0')} SELECT window_id, COUNT(*) AS recipients, CAST(SUM(receipts) AS BIGINT) AS receipts, CAST(SUM(distinct_seq) AS BIGINT) AS distinct_seq,
      CAST(SUM(acked) AS BIGINT) AS acked, CAST(SUM(unknown_acks) AS BIGINT) AS unknown_acks, CAST(SUM(empty_bodies) AS BIGINT) AS empty_bodies, CAST(SUM(duplicates) AS BIGINT) AS duplicates,
      CAST(SUM(pending) AS BIGINT) AS pending, CAST(SUM(missing) AS BIGINT) AS missing, MIN(min_seq) AS min_seq, MAX(max_seq) AS max_seq, MIN(first_us) AS first_us, MAX(last_us) AS last_us,
      BOOL_OR(saturated) AS saturated FROM st GROUP BY window_id""")
def receipt_rollup(spark, sf):
    return L.receipt_rollup(_status(spark, sf))


@query("receipt_breakdown", """
    SELECT window_id, recipient_id, 'prefab' AS dimension, prefab AS key, COUNT(*) AS n FROM b_receipts GROUP BY 1, 2, 4
    UNION ALL SELECT window_id, recipient_id, 'source', source, COUNT(*) FROM b_receipts GROUP BY 1, 2, 4""")
def receipt_breakdown(spark, sf):
    return L.receipt_breakdown(bind(spark, sf, "b_receipts"), ["prefab", "source"])


@query("breakdown_rollup", """
    SELECT window_id, 'prefab' AS dimension, prefab AS key, COUNT(*) AS n FROM b_receipts GROUP BY 1, 3
    UNION ALL SELECT window_id, 'source', source, COUNT(*) FROM b_receipts GROUP BY 1, 3""")
def breakdown_rollup(spark, sf):
    return L.breakdown_rollup(L.receipt_breakdown(bind(spark, sf, "b_receipts"), ["prefab", "source"]))


@query("reject_rate", """
    SELECT COUNT(*) AS total, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS rejected,
           ROUND(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / COUNT(*), 9) AS reject_rate FROM b_events""")
def reject_rate(spark, sf):
    outcomes = bind(spark, sf, "b_events").groupBy(F.when(F.col("event_type") == "error", "invalid").otherwise("sent").alias("outcome")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return L.reject_rate(outcomes).withColumn("reject_rate", F.round("reject_rate", 9))


CHALLENGES = [
    ("c1", "click", "{}", None, None, "sum", 30, True, '[{"type": "guild_points", "amount": 50}]'),
    ("c2", "view", '{"k": "7"}', None, None, "sum", 2, True, '[{"type": "badge"}, {"type": "guild_points", "amount": 20}]'),
    ("c3", "purchase", "", 1704844800000000, 1705708800000000, "sum", 5, True, "[]"),
    ("c4", "error", "{}", None, None, "max", 99, True, '[{"type": "guild_points", "amount": 5}]'),
    ("c5", "signup", "{broken", None, None, "sum", 100000, True, "not json"),
    ("c6", "click", "{}", None, None, "max", 1, False, "[]"),
]
CHALLENGE_SCHEMA = ("challenge_id string, trigger_event string, filters string, window_start bigint, window_end bigint, mode string, "
                    "target bigint, active boolean, rewards string")

PROGRESS = """m AS (SELECT c.id AS challenge_id, c.mode, c.target, c.reward, e.guild_id, e.us, e.event_id, CASE WHEN c.mode = 'max' THEN k ELSE k % 3 END AS amount FROM b_events e JOIN
        (VALUES ('c1', 'click', -1, 0, 9e18, 'sum', 30, 50), ('c2', 'view', 7, 0, 9e18, 'sum', 2, 20), ('c3', 'purchase', -1, 1704844800000000, 1705708800000000, 'sum', 5, 0),
                ('c4', 'error', -1, 0, 9e18, 'max', 99, 5), ('c5', 'signup', -1, 0, 9e18, 'sum', 100000, 0)) c(id, ev, want, t0, t1, mode, target, reward)
        ON e.event_type = c.ev AND (c.want < 0 OR e.k = c.want) AND e.us BETWEEN c.t0 AND c.t1),
    v AS (SELECT *, CASE WHEN mode = 'max' THEN MAX(amount) OVER w ELSE SUM(amount) OVER w END AS value FROM m WINDOW w AS (PARTITION BY challenge_id, guild_id ORDER BY us, event_id)),
    p AS (SELECT challenge_id, guild_id, COALESCE(MIN_BY(value, us) FILTER (value >= target), MAX_BY(value, us)) AS current_value, BOOL_OR(value >= target) AS completed,
        MIN(us) FILTER (value >= target) AS completed_us, MIN_BY(event_id, us) FILTER (value >= target) AS completed_by, MAX(reward) AS reward FROM v GROUP BY 1, 2)"""


def _progress(spark, sf):
    challenges = literal_rows(spark, CHALLENGES, CHALLENGE_SCHEMA)
    amount = F.when(F.col("mode") == "max", F.col("k")).otherwise(F.col("k") % 3)
    return P.challenge_progress(bind(spark, sf, "b_events"), challenges, amount)


@query("challenge_progress", f"WITH {PROGRESS} SELECT challenge_id, guild_id, CAST(current_value AS BIGINT) AS current_value, completed, completed_us, completed_by, reward FROM p")
def challenge_progress(spark, sf):
    return _progress(spark, sf)


@query("guild_points", f"""
    WITH {PROGRESS}, u AS (SELECT guild_id, COUNT(*) AS points, 0 AS done FROM b_game WHERE event_type = 'structure_placed' GROUP BY 1
      UNION ALL SELECT guild_id, SUM(reward), COUNT(*) FROM p WHERE completed AND reward > 0 GROUP BY 1)
    SELECT guild_id, CAST(SUM(points) AS BIGINT) AS points, CAST(SUM(done) AS BIGINT) AS challenges_completed FROM u GROUP BY 1""")
def guild_points(spark, sf):
    return P.guild_points(bind(spark, sf, "b_game"), _progress(spark, sf))


@query("player_points", """
    WITH r AS (SELECT actor_id, k, ROW_NUMBER() OVER (PARTITION BY actor_id ORDER BY us DESC, event_id DESC) AS n FROM b_game
      WHERE event_type = 'player_rank_changed' AND k % 13 <> 0 AND k % 9 <> 0 AND k % 5 <> 0),
    p AS (SELECT actor_id, CAST(SUM(CASE WHEN event_type = 'structure_placed' THEN 1 ELSE 0 END) AS BIGINT) AS points FROM b_game GROUP BY 1)
    SELECT p.actor_id, points, CAST(COALESCE(r.k % 7, 0) AS INT) AS rank FROM p LEFT JOIN r ON r.actor_id = p.actor_id AND r.n = 1 WHERE points > 0 OR r.k IS NOT NULL""")
def player_points(spark, sf):
    return P.player_points(bind(spark, sf, "b_game"))


@query("achievements", """
    WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY us, event_id) AS n FROM b_game),
    pc AS (SELECT event_id, us, ROW_NUMBER() OVER (ORDER BY us, event_id) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY actor_id ORDER BY us, event_id) AS a FROM b_game WHERE event_type = 'player_connected') t WHERE a = 1),
    u AS (SELECT 'first_foundation' AS id, us, CAST(event_id AS VARCHAR) AS ids FROM o WHERE event_type = 'structure_placed' AND n = 1
      UNION ALL SELECT 'community_builder', MAX(us), string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FROM o WHERE event_type = 'structure_placed' AND n IN (1, 25)
      UNION ALL SELECT 'rising_ranks', us, CAST(event_id AS VARCHAR) FROM o WHERE event_type = 'player_rank_changed' AND n = 1
      UNION ALL SELECT 'landmark_explorers', us, CAST(event_id AS VARCHAR) FROM o WHERE event_type = 'player_discovered_landmark' AND n = 1
      UNION ALL SELECT 'founding_members', MAX(us), string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FROM pc WHERE n <= 5
      UNION ALL SELECT 'world_age_7_days', MIN(us) + 604800000000, CAST(MIN_BY(event_id, us) AS VARCHAR) FROM b_game),
    c(position, id, scope) AS (VALUES (0, 'first_foundation', 'community'), (1, 'community_builder', 'community'), (2, 'challenge_champions', 'community'), (3, 'guild_milestone', 'guild'),
      (4, 'rising_ranks', 'player'), (5, 'founding_members', 'community'), (6, 'landmark_explorers', 'community'), (7, 'world_age_7_days', 'community'))
    SELECT position, c.id, scope, u.id IS NOT NULL AS unlocked, us AS unlocked_us, COALESCE(ids, '') AS evidence FROM c LEFT JOIN u ON u.id = c.id""")
def achievements(spark, sf):
    out = P.achievements(bind(spark, sf, "b_game"), F.lit(1706659200000000))
    return out.select("position", "id", "scope", "unlocked", "unlocked_us",
                      F.array_join(F.transform("evidence_ids", lambda e: e.cast("string")), ",").alias("evidence"))


JOURNAL_ORDER = ["ship_us", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query("journal_state", """
    SELECT object_id, object_revision, tombstone, l_linenumber, l_suppkey, l_extendedprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id
      ORDER BY object_revision DESC, ship_us, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM b_journal WHERE world_epoch = 'now' AND NOT delivery_only) t WHERE n = 1""")
def journal_state(spark, sf):
    return L.journal_state(bind(spark, sf, "b_journal"), "now", ["object_id"], JOURNAL_ORDER, "object_revision").select(
        "object_id", "object_revision", "tombstone", "l_linenumber", "l_suppkey", "l_extendedprice")


DAY = 86_400_000_000
# Registrations of each recipient in the checking engine, and what becomes of each journal row.
JUDGED = f"""
    r AS (SELECT s_suppkey AS recipient, (s_suppkey + n % 2 * 3) % 12 AS ix, s_suppkey % 11 AS iy, n = 3 AS refresh, 788918400000000 + (n * 500 + s_suppkey % 97) * {DAY} + 100 AS since, n
        FROM supplier, (VALUES (0), (1), (2), (3)) v(n)),
    f AS (SELECT recipient, MIN(since) AS first_since FROM r GROUP BY recipient),
    l AS (SELECT *, ship_us + l_linenumber AS tm, trim(world_epoch) = 'now' AND NOT delivery_only AS counts FROM b_journal),
    l1 AS (SELECT *, MAX(CASE WHEN counts THEN object_revision END) OVER (PARTITION BY object_id ORDER BY tm, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM l),
    l2 AS (SELECT *, counts AND (top IS NULL OR object_revision > top) AS newer FROM l1),
    l3 AS (SELECT l2.*, LAST_VALUE(CASE WHEN newer THEN object_revision END IGNORE NULLS) OVER w AS cur_revision, LAST_VALUE(CASE WHEN newer THEN tombstone END IGNORE NULLS) OVER w AS cur_tombstone FROM l2
        WINDOW w AS (PARTITION BY object_id ORDER BY tm, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    j AS (SELECT l3.*, CASE WHEN trim(world_epoch) = '' THEN 'world_epoch_invalid' WHEN world_epoch <> 'now' THEN 'world_epoch_not_active' WHEN delivery_only THEN 'delivery_only' WHEN newer THEN CASE WHEN tombstone THEN 'tombstone' ELSE 'delta' END
        WHEN tm > first_since THEN 'targeted_replay' ELSE 'stale_journal_revision' END AS verdict FROM l3 LEFT JOIN f ON f.recipient = l3.delivery_recipient)"""


def _registrations(spark, sf):
    """Each recipient's four interests, the last of them a refresh."""
    regs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n"))
    return regs.select(F.col("s").alias("recipient"), ((F.col("s") + F.col("n") % 2 * 3) % 12).alias("zone_x"), (F.col("s") % 11).alias("zone_y"),
                       F.lit(1).alias("radius"), (F.col("n") == 3).alias("refresh"),
                       (F.lit(788918400000000) + (F.col("n") * 500 + F.col("s") % 97) * DAY + 100).alias("at"))


def _judged(spark, sf, epoch="now"):
    log = bind(spark, sf, "b_journal").withColumn("at", F.col("ship_us") + F.col("l_linenumber"))
    return L.journal_verdicts(log, epoch, ["object_id"], ["at", *JOURNAL_ORDER[2:]], "object_revision", _registrations(spark, sf))


@query("journal_verdicts", f"WITH {JUDGED} SELECT object_id, object_revision, tm AS \"at\", l_suppkey, l_extendedprice, verdict, cur_revision, cur_tombstone FROM j")
def journal_verdicts(spark, sf):
    return _judged(spark, sf).select("object_id", "object_revision", "at", "l_suppkey", "l_extendedprice", "verdict", F.col("current.revision").alias("cur_revision"),
                                     F.col("current.tombstone").alias("cur_tombstone"))


@query("journal_first_epoch", """
    WITH first AS (SELECT arg_min(world_epoch, (ship_us, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)) AS epoch FROM b_journal WHERE trim(world_epoch) <> '')
    SELECT object_id, object_revision, ship_us, l_linenumber, l_suppkey, CASE WHEN trim(world_epoch) = '' THEN 'world_epoch_invalid' ELSE 'world_epoch_not_active' END AS verdict
    FROM b_journal, first WHERE trim(world_epoch) = '' OR world_epoch <> epoch""")
def journal_first_epoch(spark, sf):
    """Rows turned away where no epoch is given and the first row of a valid one activates it."""
    rows = L.journal_verdicts(bind(spark, sf, "b_journal"), None, ["object_id"], JOURNAL_ORDER, "object_revision")
    return rows.filter("verdict LIKE 'world_epoch%'").select("object_id", "object_revision", "ship_us", "l_linenumber", "l_suppkey", "verdict")


def _interest_inputs(spark, sf):
    told = L.journal_mutations(_judged(spark, sf), "object_revision").select(
        "object_id", "revision", "tombstone", (F.col("object_id") % 12).alias("zone_x"), F.expr("object_id div 12 % 12").alias("zone_y"), "at", "target", "changes", "replay")
    told = cut_lineage(told)  # read by the deltas, the targeted rows, the snapshots and the acks
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    # laid out by object before acks are made of them, in pieces of about a million acks, so that acks need not be moved
    changed = told.filter("changes")
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), changed.count() * supplier.count() // 50_000_000)
    acks = changed.repartition(pieces, "object_id", "revision").join(supplier, F.pmod(F.col("revision"), F.lit(50)) == F.pmod(F.col("s"), F.lit(50))).select(
        F.col("s").alias("recipient"), "object_id", "revision", (F.col("at") + 40 * DAY + 7).alias("at"))
    return told, _registrations(spark, sf), acks


INTEREST = f"""
    WITH {JUDGED},
    t AS (SELECT object_id, CASE WHEN verdict = 'targeted_replay' THEN cur_revision ELSE object_revision END AS revision, CASE WHEN verdict = 'targeted_replay' THEN cur_tombstone ELSE tombstone END AS tombstone,
        object_id % 12 AS zx, object_id // 12 % 12 AS zy, tm, delivery_recipient AS target, verdict FROM j WHERE verdict IN ('delta', 'tombstone', 'delivery_only', 'targeted_replay')),
    m AS (SELECT * FROM t WHERE verdict IN ('delta', 'tombstone')),
    life AS (SELECT *, LEAD(tm) OVER (PARTITION BY object_id ORDER BY revision) AS gone FROM m),
    i AS (SELECT *, LEAD(since) OVER (PARTITION BY recipient ORDER BY since) AS until,
        refresh OR LAG(ix) OVER (PARTITION BY recipient ORDER BY since) IS NULL OR LAG(ix) OVER (PARTITION BY recipient ORDER BY since) <> ix AS replays FROM r),
    c AS (SELECT recipient, object_id, revision, tombstone, tm, 'delta' AS what, 1 AS phase, FALSE AS refresh FROM t JOIN i ON target IS NULL AND ABS(zx - ix) <= 1 AND ABS(zy - iy) <= 1 AND tm > since AND (until IS NULL OR tm <= until)
      UNION ALL SELECT recipient, object_id, revision, tombstone, tm, CASE WHEN verdict = 'targeted_replay' THEN 'replay' ELSE 'delta' END, 1, FALSE FROM t JOIN f ON recipient = target AND tm > first_since
      UNION ALL SELECT recipient, object_id, revision, tombstone, since, 'snapshot', 0, refresh FROM life JOIN i ON replays AND ABS(zx - ix) <= 1 AND ABS(zy - iy) <= 1 AND tm <= since AND (gone IS NULL OR gone > since)
      UNION ALL SELECT s_suppkey, object_id, revision, NULL, tm + 40 * {DAY} + 7, 'ack', 2, FALSE FROM m JOIN supplier ON revision % 50 = s_suppkey % 50),
    d AS (SELECT *, LAG(what) OVER (PARTITION BY recipient, object_id, revision ORDER BY tm, phase) AS b FROM c)"""


@query("interest_deliveries", INTEREST + """,
    k AS (SELECT *, CASE WHEN tombstone THEN 'tombstone' WHEN what = 'delta' THEN 'delta' ELSE 'snapshot' END AS kind FROM d WHERE what IN ('delta', 'replay') OR (what = 'snapshot' AND (refresh OR b IS NULL OR b = 'ack')))
    SELECT recipient, ROW_NUMBER() OVER (PARTITION BY recipient ORDER BY tm, phase, object_id, revision, kind) AS seq, object_id, revision, kind, tm AS "at" FROM k""")
def interest_deliveries(spark, sf):
    return L.deliveries(*_interest_inputs(spark, sf))


@query("interest_acks", INTEREST + " SELECT recipient, object_id, revision, tm AS \"at\", COALESCE(b <> 'ack', FALSE) AS known FROM d WHERE what = 'ack'")
def interest_acks(spark, sf):
    return L.interest_acks(*_interest_inputs(spark, sf))


# Leases in the checking engine: one step per operation, the state carried along.
LEASES = """
    WITH RECURSIVE o AS (SELECT event_id AS op_id, k % 20 AS object_id, us, CASE event_type WHEN 'click' THEN 'issue' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'reclaim' ELSE 'validate' END AS op,
        CAST(actor_id % 3 AS VARCHAR) AS holder, n, CAST(ROUND(n / 5.0) AS BIGINT) AS claim FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k % 20 ORDER BY us, event_id) AS n FROM b_events) e),
    s AS (SELECT object_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS epoch, CAST('' AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS expires, CAST('' AS VARCHAR) AS state, CAST(-1 AS BIGINT) AS op_id, CAST(0 AS BIGINT) AS us,
        CAST('' AS VARCHAR) AS op, CAST('' AS VARCHAR) AS reason FROM o WHERE n = 1
      UNION ALL SELECT object_id, n, CASE WHEN op = 'issue' THEN epoch + 1 ELSE epoch END, CASE WHEN op = 'issue' THEN claimant ELSE holder END, CASE WHEN op = 'issue' THEN us + 10800000000 ELSE expires END,
        CASE reason WHEN 'issued' THEN 'active' WHEN 'reclaimed' THEN 'reclaimed' WHEN 'lease_expired' THEN 'expired' WHEN 'accepted' THEN CASE WHEN op = 'complete' THEN 'completed' ELSE state END ELSE state END,
        op_id, us, op, reason FROM (SELECT o.object_id, o.n, s.epoch, s.holder, s.expires, s.state, o.op_id, o.us, o.op, o.holder AS claimant,
          CASE WHEN o.op = 'issue' THEN 'issued' WHEN s.epoch = 0 THEN 'lease_missing' WHEN o.op = 'reclaim' THEN CASE WHEN s.holder = o.holder AND s.state = 'active' THEN 'reclaimed' ELSE 'not_reclaimed' END
            WHEN s.holder <> o.holder THEN 'holder_mismatch' WHEN s.epoch <> o.claim THEN 'epoch_mismatch' WHEN s.state <> 'active' THEN 'lease_' || s.state WHEN o.us >= s.expires THEN 'lease_expired' ELSE 'accepted' END AS reason
          FROM s JOIN o ON o.object_id = s.object_id AND o.n = s.n + 1) x)
    SELECT object_id, op_id, us AS "at", op, epoch AS lease_epoch, reason FROM s WHERE n > 0"""


def _lease_ops(spark, sf):
    ev = bind(spark, sf, "b_events").withColumn("object_id", F.col("k") % 20)
    numbered = ordered(ev, ["object_id"], ["us", "event_id"]).scan(n=position()).df
    kind = F.col("event_type")
    op = F.when(kind == "click", "issue").when(kind == "purchase", "complete").when(kind == "error", "reclaim").otherwise("validate")
    return numbered.select(F.col("event_id").alias("op_id"), "object_id", F.col("us").alias("at"), op.alias("op"), F.lit("run").alias("run_id"),
                           (F.col("actor_id") % 3).cast("string").alias("holder"), F.round(F.col("n") / 5).cast("bigint").alias("epoch"),
                           F.lit(3 * 3_600_000_000).alias("duration"))


@query("lease_state", LEASES)
def lease_state(spark, sf):
    return L.lease_state(_lease_ops(spark, sf))


@query("reclaims_by_holder", """
    WITH i AS (SELECT DISTINCT actor_id % 3 AS holder, k % 20 AS object_id FROM b_events WHERE event_type = 'click')
    SELECT r.event_id AS op_id, r.actor_id % 3 AS holder, i.object_id FROM b_events r JOIN i ON i.holder = r.actor_id % 3 WHERE r.event_type = 'error'""")
def reclaims_by_holder(spark, sf):
    ev = bind(spark, sf, "b_events").select("event_id", "event_type", (F.col("actor_id") % 3).alias("holder"), (F.col("k") % 20).alias("object_id"))
    return L.reclaims_by_holder(ev.filter("event_type = 'error'").select(F.col("event_id").alias("op_id"), "holder"),
                                ev.filter("event_type = 'click'").select("holder", "object_id")).select("op_id", "holder", "object_id")


NOW = 1706659200000000


@query("liveness", f"SELECT actor_id, MAX(us) AS last_touch, {NOW} - MAX(us) < 43200000000 AS live FROM b_events GROUP BY actor_id")
def liveness(spark, sf):
    return L.liveness(bind(spark, sf, "b_events"), ["actor_id"], "us", F.lit(NOW), 43_200_000_000)


@query("consumer_status", f"""
    WITH b AS (SELECT guild_id AS window_id, actor_id AS consumer_id, us, event_id, k, ROW_NUMBER() OVER (PARTITION BY guild_id, actor_id ORDER BY us DESC, event_id DESC) AS n FROM b_events),
    l AS (SELECT *, {NOW} - us <= 3600000000 AS active, ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY us DESC, consumer_id DESC) AS m FROM b WHERE n = 1)
    SELECT window_id, CAST(SUM(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active_consumers, MAX(us) AS last_seen,
      CAST(CASE WHEN BOOL_OR(active) THEN SUM(CASE WHEN active THEN k END) ELSE MAX(CASE WHEN m = 1 THEN k END) END AS BIGINT) AS applied FROM l GROUP BY window_id""")
def consumer_status(spark, sf):
    beats = bind(spark, sf, "b_events").select(F.col("guild_id").alias("window_id"), F.col("actor_id").alias("consumer_id"), F.col("us").alias("seen"),
                                               F.col("event_id").alias("beat_id"), F.col("k").alias("applied"))
    return L.consumer_status(beats, F.lit(NOW), 3_600_000_000, ["applied"])


@query("coverage_status", """
    WITH t AS (SELECT o_custkey, COUNT(*) AS distinct_seq, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS covered,
      CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN distinct_seq - 3 > 0 THEN round_even(100.0 * covered / (distinct_seq - 3), 2) END AS percent,
           pending = 0 AND covered >= 1 AS complete FROM t""")
def coverage_status(spark, sf):
    status = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("distinct_seq"), F.count_if(status == "F").alias("covered"),
                                                               F.count_if(status == "P").alias("pending"))
    rows = rows.withColumns({"total": F.col("distinct_seq") - 3, "missing": F.lit(0), "saturated": F.lit(False), "store_healthy": F.lit(True),
                             "acked": F.col("distinct_seq"), "active_consumers": F.col("covered"), "rejected": F.lit(0), "consumer_pending": F.lit(0)})
    return L.coverage_status(rows).select("o_custkey", "percent", "complete")


@query("gate_compare", """
    WITH p AS (SELECT l_suppkey AS window_id, MAX(l_partkey) AS seq, COUNT(*) % 2 = 0 AS authoritative FROM lineitem GROUP BY 1),
    g AS (SELECT s_suppkey + 5 AS window_id, p.seq - s_suppkey % 2 AS distinct_seq, s_suppkey % 3 AS missing FROM supplier JOIN p ON p.window_id = s_suppkey + 5)
    SELECT COALESCE(p.window_id, g.window_id) AS window_id, p.seq, g.distinct_seq, g.missing, CASE WHEN authoritative AND p.seq <> 0 AND distinct_seq = p.seq AND missing = 0 THEN 'receipts_match_no_loss'
      WHEN NOT authoritative THEN 'inconclusive_counters_not_authoritative' WHEN p.seq = 0 THEN 'no_redirect_activity' ELSE 'mismatch' END AS verdict FROM p FULL JOIN g ON g.window_id = p.window_id""")
def gate_compare(spark, sf):
    producer = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("window_id")).agg(
        F.max("l_partkey").alias("seq"), (F.count(F.lit(1)) % 2 == 0).alias("authoritative"))
    gateway = table(spark, sf, "supplier").select((F.col("s_suppkey") + 5).alias("window_id"), (F.col("s_suppkey") % 2).alias("off"), (F.col("s_suppkey") % 3).alias("missing")) \
        .join(producer.select("window_id", "seq"), "window_id").select("window_id", (F.col("seq") - F.col("off")).alias("distinct_seq"), "missing")
    return L.gate_compare(producer, gateway)


@query("review_status", """
    WITH l AS (SELECT k AS submission_id, event_id AS line, us, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'in_review' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'needs_info' ELSE 'lost' END AS status,
        CASE WHEN actor_id % 2 = 0 THEN 'why' ELSE '' END AS reason FROM b_events),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY submission_id ORDER BY us DESC, line DESC) AS n FROM l WHERE status <> 'lost' AND (reason <> '' OR status NOT IN ('rejected', 'needs_info')))
    SELECT COALESCE(o.submission_id, i.p_partkey) AS submission_id, COALESCE(o.status, 'ready_for_review') AS status, COALESCE(o.reason, '') AS reason
    FROM (SELECT * FROM o WHERE n = 1) o FULL JOIN part i ON i.p_partkey = o.submission_id""")
def review_status(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "click", "approved").when(kind == "view", "in_review").when(kind == "error", "rejected").when(kind == "purchase", "needs_info").otherwise("lost")
    log = bind(spark, sf, "b_events").select(F.col("k").alias("submission_id"), F.col("event_id").alias("line"), F.col("us").alias("at"), status.alias("status"),
                                             F.when(F.col("actor_id") % 2 == 0, "why").otherwise("").alias("reason"))
    index = table(spark, sf, "part").select(F.col("p_partkey").alias("submission_id"), F.lit("ready_for_review").alias("status"))
    return L.review_status(log, index)[0]


LINKED = """(SELECT o_orderkey AS object_id, o_custkey AS tag, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_orderkey + 1 ELSE o_orderkey END AS target_id FROM orders)"""


@query("pair_by_tag", f"""
    WITH c AS (SELECT o.object_id, o.tag, o.target_id, o.target_id IS NULL OR t.tag IS NULL OR t.tag <> o.tag AS free FROM {LINKED} o LEFT JOIN {LINKED} t ON t.object_id = o.target_id),
    n AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY tag ORDER BY object_id) - 1) // 2 AS p FROM c WHERE free)
    SELECT tag, MIN(object_id) AS first_id, MAX(object_id) AS second_id FROM n GROUP BY tag, p HAVING COUNT(*) = 2""")
def pair_by_tag(spark, sf):
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    objects = orders.select(key.alias("object_id"), F.col("o_custkey").alias("tag"))
    links = orders.filter(key % 4 != 0).select(key.alias("object_id"), F.when(key % 4 == 1, key + 1).otherwise(key).alias("target_id"))
    return L.session_pairs(links, objects)[1]


@query("pair_by_hash", """
    WITH s AS (SELECT o_custkey AS hash, o_orderkey AS id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
    t AS (SELECT o_custkey AS hash, o_orderkey AS id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F')
    SELECT s.hash, s.id AS source_id, t.id AS target_id FROM s JOIN t USING (hash, n)""")
def pair_by_hash(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("hash"), "o_orderstatus")
    return L.pair_by_hash(orders.filter("o_orderstatus = 'F'").drop("o_orderstatus"), orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus"))


# --- ranked selection ----------------------------------------------------------------------------------------------

@query("score_rank", "SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def score_rank(spark, sf):
    return R.score_rank(table(spark, sf, "part"), "p_retailprice", "p_partkey").select("p_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("pending_order", """
    SELECT o_orderkey AS seq, NULLIF(CAST(SUBSTRING(o_orderpriority, 1, 1) AS BIGINT), 1) AS priority_rank, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS distance
    FROM orders ORDER BY priority_rank NULLS LAST, distance NULLS LAST, seq LIMIT 200""")
def pending_order(spark, sf):
    pending = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.nullif(F.substring("o_orderpriority", 1, 1).cast("bigint"), F.lit(1)).alias("priority_rank"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("distance"))
    return R.pending_order(pending, 200)


PLAN = """u AS (SELECT CAST(object_key AS VARCHAR) AS object_key, tier, rank, order_no, distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_key ORDER BY rank, order_no, distance, tier) AS n FROM b_priority) t WHERE n = 1),
    f AS (SELECT *, tier = 'portal' AS trusted, ROW_NUMBER() OVER (PARTITION BY tier = 'portal' ORDER BY rank, order_no, distance, object_key) AS n FROM u),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rank, order_no, distance, object_key) AS m FROM f WHERE NOT (trusted AND n <= 100)),
    plan AS (SELECT object_key, tier, rank, order_no, distance, 'reliable' AS lane, n AS lane_order FROM f WHERE trusted AND n <= 100
      UNION ALL SELECT object_key, tier, rank, order_no, distance, CASE WHEN m <= 300 THEN 'datagram' ELSE 'deferred' END, m FROM r)"""


@query("delivery_plan", f"WITH {PLAN} SELECT * FROM plan")
def delivery_plan(spark, sf):
    return R.delivery_plan(bind(spark, sf, "b_priority"), 100, 300)


@query("plan_summary", f"WITH {PLAN} SELECT lane, tier, COUNT(*) AS n, (SELECT COUNT(*) FROM b_priority) - (SELECT COUNT(*) FROM plan) AS duplicates_removed FROM plan GROUP BY lane, tier")
def plan_summary(spark, sf):
    objects = bind(spark, sf, "b_priority")
    return R.plan_summary(R.delivery_plan(objects, 100, 300), objects)


@query("recent_k", "SELECT event_id, us, event_type FROM b_events ORDER BY us DESC, event_id DESC LIMIT 80")
def recent_k(spark, sf):
    return R.recent_k(bind(spark, sf, "b_events"), "us", "event_id", 80).select("event_id", "us", "event_type")


@query("top_per_region", """
    SELECT c_custkey, c_mktsegment, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) t
    WHERE (c_mktsegment = 'MACHINERY' AND place <= 5) OR (c_mktsegment = 'HOUSEHOLD' AND place <= 3)""")
def top_per_region(spark, sf):
    return R.top_per_region(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", {"MACHINERY": 5, "HOUSEHOLD": 3}).select("c_custkey", "c_mktsegment", "place")


@query("cursor_increment", "SELECT event_id, us FROM b_events WHERE event_id > 9000")
def cursor_increment(spark, sf):
    return R.cursor_increment(bind(spark, sf, "b_events"), "event_id", "event_id", "us", NOW, last_id=9000, last_at=NOW).select("event_id", "us")


RECORDS = """(SELECT doc_id AS id, text AS title, CASE doc_id % 5 WHEN 0 THEN 'story' WHEN 1 THEN 'portal' WHEN 2 THEN 'guide' WHEN 3 THEN 'tool' ELSE 'dispatch' END AS kind, n_chars AS published,
      doc_id % 3 = 0 AS is_primary, lang = 'en' AS is_audience FROM documents)"""


def _records(spark, sf):
    key = F.col("doc_id") % 5
    kind = F.when(key == 0, "story").when(key == 1, "portal").when(key == 2, "guide").when(key == 3, "tool").otherwise("dispatch")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), kind.alias("kind"), F.col("n_chars").alias("published"),
        F.when(F.col("lang") == "en", F.array(F.lit("builders"))).otherwise(F.array(F.lit("keepers"))).alias("audiences"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("builders"))).otherwise(F.array(F.lit("keepers"))).alias("primary"))


@query("lane_order", f"""
    SELECT id, ROW_NUMBER() OVER (ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, CASE kind WHEN 'story' THEN 0 WHEN 'portal' THEN 1 WHEN 'guide' THEN 2 ELSE 3 END, title, id) AS place
    FROM {RECORDS} r WHERE is_audience AND kind <> 'dispatch'""")
def lane_order(spark, sf):
    return R.lane_order(_records(spark, sf), "builders").select("id", F.col("place").cast("bigint").alias("place"))


@query("lane_recent", f"SELECT id, published FROM {RECORDS} r WHERE is_audience AND kind = 'dispatch' ORDER BY published DESC, id DESC LIMIT 10")
def lane_recent(spark, sf):
    return R.lane_recent(_records(spark, sf), "builders", "dispatch", 10).select("id", "published")


@query("best_per_group", """
    SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_nationkey NOT IN (3, 7)) t
    WHERE n = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 6""")
def best_per_group(spark, sf):
    return R.best_per_group(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", "c_custkey", 6, [3, 7]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("stride_sample", """
    WITH r AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, GREATEST(1, (SELECT COUNT(*) FROM orders) // 60) AS step FROM orders)
    SELECT o_orderkey, rank FROM r WHERE (rank - 1) % step = 0 AND (rank - 1) // step < 60""")
def stride_sample(spark, sf):
    return R.stride_sample(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


SAMPLED = """(SELECT l_suppkey AS sample_id, l_partkey AS object_id, l_returnflag || l_linestatus AS name, CASE WHEN l_linenumber < 3 THEN 'portal' ELSE 'loose' END AS tier, l_linenumber AS rank, l_quantity AS distance FROM lineitem)"""


@query("priority_sample", f"""
    WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, object_id ORDER BY rank, distance, name, tier) AS d FROM {SAMPLED} x WHERE distance <= 40),
    p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY rank, distance, LOWER(name), object_id) AS place, COUNT(*) OVER (PARTITION BY sample_id) AS candidates FROM s WHERE d = 1)
    SELECT sample_id, object_id, rank, distance, name, tier, place, candidates, candidates > 20 AS capped FROM p WHERE place <= 20""")
def priority_sample(spark, sf):
    line = F.col("l_linenumber")
    objects = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("object_id"), F.concat("l_returnflag", "l_linestatus").alias("name"),
                                                  F.when(line < 3, "portal").otherwise("loose").alias("tier"), line.alias("rank"), F.col("l_quantity").alias("distance"))
    return R.priority_sample(objects, 40.0, 20)[0]


@query("recent_distinct", """
    SELECT name, last, ROW_NUMBER() OVER (ORDER BY last, name) AS place FROM (SELECT CAST(actor_id AS VARCHAR) AS name, MAX(us) AS last FROM b_events GROUP BY 1 ORDER BY last DESC, name LIMIT 10) t""")
def recent_distinct(spark, sf):
    ev = bind(spark, sf, "b_events").select(F.col("actor_id").cast("string").alias("name"), "us")
    return R.recent_distinct(ev, "name", "us").withColumn("place", F.col("place").cast("bigint"))


@query("minmax_blend", """
    WITH j AS (SELECT d.doc_id, d.lang, d.n_chars AS a, l.quality AS b, COALESCE(l.toxic, 0) AS veto FROM documents d LEFT JOIN labels l USING (doc_id)),
    e AS (SELECT lang, MIN(a) AS la, MAX(a) AS ha, MIN(b) AS lb, MAX(b) AS hb FROM j GROUP BY lang),
    m AS (SELECT j.lang, doc_id, 0.6 * CASE WHEN b IS NULL OR hb = lb THEN 0.5 ELSE (b - lb) / (hb - lb) END + 0.4 * CASE WHEN ha = la THEN 0.5 ELSE (a - la) / (ha - la) END AS blend FROM j JOIN e USING (lang) WHERE veto <= 0)
    SELECT lang, doc_id, ROUND(blend, 6) AS blend, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY blend DESC, doc_id) AS place FROM m""")
def minmax_blend(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    out = R.minmax_blend(docs.join(labels, "doc_id", "left"), "lang", "n_chars", "quality", 0.6, "toxic", 0, "doc_id")
    return out.withColumn("blend", F.round("blend", 6)).withColumn("place", F.col("place").cast("bigint"))


# --- sets ----------------------------------------------------------------------------------------------------------

@query("set_diff", """
    SELECT COALESCE(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'common' END AS side
    FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 40 AS k FROM orders) b ON a.k = b.k""")
def set_diff(spark, sf):
    return D.set_diff(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")),
                      table(spark, sf, "orders").select((F.col("o_custkey") + 40).alias("key")), "key")


@query("keyed_diff", """
    WITH n AS (SELECT CASE WHEN p_partkey % 10 = 1 THEN p_partkey + 10000000 ELSE p_partkey END AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part)
    SELECT COALESCE(p_partkey, n.k) AS key, CASE WHEN p_partkey IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'retyped' END AS change, p_size AS old_value, n.v AS new_value
    FROM part FULL JOIN n ON n.k = p_partkey WHERE p_partkey IS NULL OR n.k IS NULL OR p_size <> n.v""")
def keyed_diff(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    old = table(spark, sf, "part").select(key.alias("key"), size.alias("value"))
    new = table(spark, sf, "part").select(F.when(key % 10 == 1, key + 10_000_000).otherwise(key).alias("key"), F.when(key % 7 == 0, size + 1).otherwise(size).alias("value"))
    return D.keyed_diff(old, new, ["key"], "value")


@query("nested_diff", """
    WITH o AS (SELECT l_orderkey AS component, l_linenumber AS field, MAX(l_partkey) AS kind FROM lineitem GROUP BY 1, 2),
    n AS (SELECT CASE WHEN component % 10 = 1 THEN component + 100000000 ELSE component END AS component, field, CASE WHEN kind % 5 = 0 THEN kind + 1 ELSE kind END AS kind FROM o WHERE field <> 3 OR component % 7 <> 0
      UNION ALL SELECT component, 99, 7 FROM o WHERE component % 10 <> 1 GROUP BY component HAVING component % 4 = 0),
    p AS (SELECT component, MAX(a) AS a, MAX(b) AS b, COUNT(*) AS children FROM (SELECT component, 1 AS a, 0 AS b FROM o UNION ALL SELECT component, 0, 1 FROM n) u GROUP BY component)
    SELECT component, NULL AS field, CASE WHEN a = 1 THEN 'removed' ELSE 'added' END AS change, children, NULL AS old_value, NULL AS new_value FROM p WHERE a + b = 1
    UNION ALL SELECT component, field, CASE WHEN o.kind IS NULL THEN 'added' WHEN n.kind IS NULL THEN 'removed' ELSE 'retyped' END, NULL, o.kind, n.kind FROM o FULL JOIN n USING (component, field)
      WHERE component IN (SELECT component FROM p WHERE a + b = 2) AND (o.kind IS NULL OR n.kind IS NULL OR o.kind <> n.kind)""")
def nested_diff(spark, sf):
    """Components (orders) with fields (lines): some components renamed, some fields dropped, added or retyped."""
    old = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("component"), F.col("l_linenumber").cast("bigint").alias("field")).agg(F.max("l_partkey").alias("kind"))
    component, kind = F.col("component"), F.col("kind")
    new = old.filter((F.col("field") != 3) | (component % 7 != 0)).select(
        F.when(component % 10 == 1, component + 100_000_000).otherwise(component).alias("component"), "field", F.when(kind % 5 == 0, kind + 1).otherwise(kind).alias("kind"))
    more = old.filter((component % 10 != 1) & (component % 4 == 0)).select("component").distinct().select(
        "component", F.lit(99).cast("bigint").alias("field"), F.lit(7).cast("bigint").alias("kind"))
    return D.nested_diff(old, new.unionByName(more), ["component"], ["field"], "kind")


@query("array_set_diff", """
    WITH s AS (SELECT actor_id, list(DISTINCT k) FILTER (us >= 1705276800000000) AS c, list(DISTINCT k) FILTER (us < 1705276800000000) AS p FROM b_events GROUP BY actor_id),
    d AS (SELECT actor_id, list_sort(list_filter(c, lambda x: NOT list_contains(p, x))) AS a, list_sort(list_filter(p, lambda x: NOT list_contains(c, x))) AS r, LEN(c) AS total FROM s)
    SELECT actor_id, list_aggregate(a, 'string_agg', ',') AS added, list_aggregate(r, 'string_agg', ',') AS removed, CAST(total AS INT) AS total FROM d WHERE LEN(a) > 0 OR LEN(r) > 0""")
def array_set_diff(spark, sf):
    late = F.col("us") >= 1705276800000000
    sets = bind(spark, sf, "b_events").groupBy("actor_id").agg(F.collect_set(F.when(late, F.col("k"))).alias("cur"), F.collect_set(F.when(~late, F.col("k"))).alias("prev"))
    out = D.array_set_diff(sets, ["actor_id"], "cur", "prev")
    return out.withColumns({c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in ("added", "removed")})


@query("subset_check", """
    SELECT actor_id, k % 10 AS part, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type IN ('click', 'view')) AS seen, COUNT(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) = 2 AS complete
    FROM b_events GROUP BY 1, 2""")
def subset_check(spark, sf):
    out = D.subset_check(bind(spark, sf, "b_events").withColumn("part", F.col("k") % 10), ["actor_id", "part"], "event_type", ["click", "view"])
    return out.select("actor_id", "part", F.nullif(F.array_join("seen", ","), F.lit("")).alias("seen"), "complete")
