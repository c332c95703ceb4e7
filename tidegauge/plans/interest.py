"""Queries over interest management and rules with memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import interest as I
from tidegauge.plans.bindings import bind
from tidegauge.plans.registry import query
from tidegauge.runtime import literal_rows

HOUR = 3_600_000_000


def spaced_sql(source: str, keys: str, gap: int, src: str = "src", p: str = "p") -> str:
    """Greedy spacing in the checking engine: from each pick to the first row far enough behind it."""
    on = " AND ".join(f"e.{k.strip()} = {p}.{k.strip()}" for k in keys.split(","))
    each = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""{src} AS ({source}),
    {p} AS (SELECT {keys}, MIN(us) AS us FROM {src} GROUP BY {keys} UNION ALL SELECT {each}, MIN(e.us) FROM {p} JOIN {src} e ON {on} AND e.us >= {p}.us + {gap} GROUP BY {each})"""


@query("cooldown_fire", f"""
    WITH RECURSIVE {spaced_sql("SELECT actor_id, event_type, us, event_id FROM b_events", "actor_id, event_type", 12 * HOUR)}
    SELECT s.event_id, p.us IS NOT NULL AS fired FROM src s LEFT JOIN p ON p.actor_id = s.actor_id AND p.event_type = s.event_type AND p.us = s.us""")
def cooldown_fire(spark, sf):
    ev = bind(spark, sf, "b_events").select("actor_id", "event_type", "us", "event_id")
    return I.cooldown_fire(ev, ["actor_id", "event_type"], "us", ["event_id"], 12 * HOUR).select("event_id", "fired")


# Fixed parameters of the quest queries: which quests listen to a player's events.
QUESTS = [("q1", "click", "troll_or_dwarf", "", False, {"region": "region-1"}), ("q2", "Look", "any", None, True, None), ("q3", "purchase", "", "bows", False, {"region": "any"}),
          ("q4", "view", "", None, False, None), ("q5", "nothing", "", None, False, None)]
QUEST_ALIASES = {"look": "view"}
MATCHED = """SELECT fresh.*, quest_id FROM fresh JOIN (VALUES ('q1', 'click'), ('q2', 'view'), ('q3', 'purchase'), ('q4', 'view')) q(quest_id, name) ON event_type = name
      WHERE quest_id = 'q4' OR (quest_id = 'q1' AND k % 3 < 2 AND region_id = 'region-1') OR (quest_id = 'q2' AND k % 2 = 0) OR (quest_id = 'q3' AND actor_id % 2 = 0)"""
QUEST_FIRE = f"""
    WITH RECURSIVE ev AS (SELECT guild_id, event_type, us, event_id, k, region_id, actor_id, CASE WHEN k % 4 = 1 THEN '  ' WHEN k % 4 > 1 THEN 'v' || CAST(k % 23 AS VARCHAR) END AS dedupe_key
      FROM b_events WHERE event_type IN ('click', 'view', 'purchase')),
    {spaced_sql("SELECT * FROM ev WHERE trim(dedupe_key) <> ''", "guild_id, event_type, dedupe_key", 20 * HOUR, "keyed", "kept")},
    fresh AS (SELECT * FROM ev WHERE trim(coalesce(dedupe_key, '')) = '' UNION ALL SELECT keyed.* FROM keyed JOIN kept USING (guild_id, event_type, dedupe_key, us)),
    {spaced_sql(MATCHED, "guild_id, quest_id", 12 * HOUR, "matched", "fires")}
    SELECT m.event_id, m.quest_id, m.guild_id AS player, f.us IS NOT NULL AS fired FROM matched m LEFT JOIN fires f ON f.guild_id = m.guild_id AND f.quest_id = m.quest_id AND f.us = m.us"""


def quest_inputs(spark, sf):
    """Events of players and the quests."""
    k = F.col("k")
    events = bind(spark, sf, "b_events").select(
        F.col("guild_id").alias("player"), "us", "event_id", F.initcap("event_type").alias("event_name"),
        F.when(k % 3 == 0, "Troll(Clone)").when(k % 3 == 1, "Greydwarf").otherwise("Boar").alias("target"),
        F.when(F.col("actor_id") % 2 == 0, "Bows").otherwise("Swords").alias("weapon_skill"), (k % 2 == 0).alias("projectile"),
        F.create_map(F.lit("region"), F.upper("region_id")).alias("fields"),
        F.when(k % 4 == 1, "  ").when(k % 4 > 1, F.concat(F.lit("v"), (k % 23).cast("string"))).alias("dedupe_key"))
    quests = literal_rows(spark, QUESTS, "quest_id string, trigger_event string, trigger_target string, trigger_weapon string, trigger_projectile boolean, trigger_where map<string,string>")
    return events, quests


@query("quest_fire", QUEST_FIRE)
def quest_fire(spark, sf):
    return I.quest_fire(*quest_inputs(spark, sf), ["player"], "us", ["event_id"], 12 * HOUR, 20 * HOUR, QUEST_ALIASES).select("event_id", "quest_id", "player", "fired")


@query("drop_repeats", f"""
    WITH RECURSIVE {spaced_sql("SELECT event_type, guild_id, us, event_id FROM b_events WHERE guild_id <> 3", "event_type, guild_id", 2 * HOUR)}
    SELECT s.event_id FROM src s JOIN p ON p.event_type = s.event_type AND p.guild_id = s.guild_id AND p.us = s.us
    UNION ALL SELECT event_id FROM b_events WHERE guild_id = 3""")
def drop_repeats(spark, sf):
    ev = bind(spark, sf, "b_events").select("event_type", "us", "event_id", F.when(F.col("guild_id") != 3, F.col("guild_id").cast("string")).alias("dedupe_key"))
    return I.drop_repeats(ev, ["event_type", "dedupe_key"], "us", ["event_id"], 2 * HOUR).select("event_id")


HITS = """SELECT k AS target_id, us, event_id, event_type IN ('purchase', 'signup') AS death,
      CAST(SUM(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY us, event_id) AS BIGINT) AS deaths FROM b_events"""


@query("first_hit", f"""
    WITH RECURSIVE {spaced_sql(f"SELECT *, CASE WHEN death THEN -1 ELSE deaths END AS part FROM ({HITS}) h", "target_id, part", 6 * HOUR)}
    SELECT s.event_id AS hit_id, CASE WHEN p.us IS NULL THEN 'none' WHEN death THEN 'killing_blow' ELSE 'first_hit' END AS emitted
    FROM src s LEFT JOIN p ON p.target_id = s.target_id AND p.part = s.part AND p.us = s.us""")
def first_hit(spark, sf):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "death").otherwise("hit")
    hits = bind(spark, sf, "b_events").select(F.col("k").alias("target_id"), F.col("us").alias("at"), F.col("event_id").alias("hit_id"), kind.alias("kind"))
    return I.first_hit(hits, 6 * HOUR).select("hit_id", "emitted")


# Witness merging in the checking engine: one step per report, the witnesses of the open action carried as a list.
WITNESS = """
    WITH RECURSIVE o AS (SELECT guild_id AS basis, actor_id AS witness, us, event_id, ROW_NUMBER() OVER (PARTITION BY guild_id ORDER BY us, event_id) AS n FROM b_events),
    s AS (SELECT basis, n, us, event_id, CAST(1 AS BIGINT) AS action, [witness] AS seen FROM o WHERE n = 1
      UNION ALL SELECT basis, n, us, event_id, CASE WHEN fresh THEN action + 1 ELSE action END, CASE WHEN fresh THEN [witness] ELSE list_append(seen, witness) END
      FROM (SELECT o.*, s.action, s.seen, o.us - s.us > 3600000000 OR list_contains(s.seen, o.witness) AS fresh FROM s JOIN o ON o.basis = s.basis AND o.n = s.n + 1) x)
    SELECT event_id AS report_id, action FROM s"""


@query("witness_merge", WITNESS)
def witness_merge(spark, sf):
    reports = bind(spark, sf, "b_events").select(F.col("guild_id").alias("basis"), F.col("actor_id").alias("witness"), F.col("us").alias("at"), F.col("event_id").alias("report_id"))
    return I.witness_merge(reports, HOUR).select("report_id", "action")


@query("band_decision", f"""
    WITH RECURSIVE o AS (SELECT guild_id AS observer_id, event_type AS object_id, us, event_id, value, k, CASE WHEN k = 0 THEN 'player_fast_lane' WHEN k % 10 = 1 AND value <= 100 THEN 'landmark' WHEN value <= 5 THEN 'emit_full'
        WHEN value <= 60 THEN 'middle' ELSE 'drop' END AS action FROM b_events),
    src AS (SELECT *, CAST(SUM(CASE WHEN action <> 'middle' THEN 1 ELSE 0 END) OVER (PARTITION BY observer_id, object_id ORDER BY us, event_id) AS BIGINT) AS part FROM o WHERE action <> 'drop'),
    p AS (SELECT observer_id, object_id, part, MIN(us) AS us FROM src GROUP BY 1, 2, 3 UNION ALL SELECT e.observer_id, e.object_id, e.part, MIN(e.us) FROM p JOIN src e ON e.observer_id = p.observer_id
        AND e.object_id = p.object_id AND e.part = p.part AND e.us >= p.us + {24 * HOUR} GROUP BY 1, 2, 3)
    SELECT s.event_id AS obs_id, CASE WHEN action <> 'middle' THEN action WHEN p.us IS NOT NULL THEN 'emit_thinned' ELSE 'hold_thinned' END AS action
    FROM src s LEFT JOIN p ON p.observer_id = s.observer_id AND p.object_id = s.object_id AND p.part = s.part AND p.us = s.us UNION ALL SELECT event_id, action FROM o WHERE action = 'drop'""")
def band_decision(spark, sf):
    k = F.col("k")
    obs = bind(spark, sf, "b_events").select(F.col("guild_id").alias("observer_id"), F.col("event_type").alias("object_id"), F.col("us").alias("at"), F.col("event_id").alias("obs_id"),
                                             F.col("value").alias("distance"), F.when(k % 10 == 1, 100.0).otherwise(0.0).alias("reach"), (k == 0).alias("fast"))
    return I.band_decision(obs, 5.0, 60.0, 24 * HOUR).select("obs_id", "action")


HYSTERESIS = """
    WITH o AS (SELECT guild_id AS object_id, actor_id AS peer_id, us // 21600000000 AS tick, MIN(value) AS d FROM b_events GROUP BY 1, 2, 3),
    t AS (SELECT o.*, n FROM o JOIN (SELECT object_id, tick, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY tick) AS n FROM (SELECT DISTINCT object_id, tick FROM o) x) y USING (object_id, tick)),
    g AS (SELECT *, COALESCE(n - LAG(n) OVER (PARTITION BY object_id, peer_id ORDER BY tick) > 1, TRUE) AS gap FROM t),
    r AS (SELECT *, CAST(SUM(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY object_id, peer_id ORDER BY tick) AS BIGINT) AS run, CASE WHEN d <= 60 THEN TRUE WHEN d > 90 THEN FALSE END AS dec FROM g),
    w AS (SELECT *, COALESCE(LAST_VALUE(dec IGNORE NULLS) OVER (PARTITION BY object_id, peer_id, run ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS within FROM r),
    h AS (SELECT *, COALESCE(LAG(within) OVER (PARTITION BY object_id, peer_id, run ORDER BY tick), FALSE) AS had FROM w)
    SELECT object_id, peer_id, tick, CASE WHEN within AND had THEN 'retained' WHEN within THEN 'entered' WHEN had THEN 'left' ELSE 'outside' END AS transition, within FROM h"""


@query("hysteresis", HYSTERESIS)
def hysteresis(spark, sf):
    obs = bind(spark, sf, "b_events").groupBy(F.col("guild_id").alias("object_id"), F.col("actor_id").alias("peer_id"), F.expr("us div 21600000000").alias("tick")).agg(F.min("value").alias("distance"))
    return I.hysteresis(obs, 60.0, 30.0).drop("distance")


SUBS = """pairs AS (SELECT a.sample, a.entity AS observer, b.entity AS target FROM b_positions a JOIN b_positions b ON a.sample = b.sample AND a.region = b.region AND a.entity <> b.entity
      WHERE (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 6400)"""


@query("subscription_changes", f"""
    WITH {SUBS} SELECT sample, observer, target, 'added' AS change FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.sample = p.sample - 1 AND q.observer = p.observer AND q.target = p.target)
    UNION ALL SELECT sample + 1, observer, target, 'removed' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.sample = p.sample + 1 AND q.observer = p.observer AND q.target = p.target)
      AND EXISTS (SELECT 1 FROM b_positions o WHERE o.sample = p.sample + 1 AND o.entity = p.observer)""")
def subscription_changes(spark, sf):
    return I.subscription_changes(bind(spark, sf, "b_positions"), 80.0)


def _interest(spark, sf):
    pos = bind(spark, sf, "b_positions").withColumnRenamed("sample", "tick")
    k = F.col("entity")
    changed = pos.select("tick", "entity")
    return changed, pos.filter(k % 20 != 0).select("tick", "entity", "x", "z"), changed.withColumnRenamed("entity", "observer")


PAIRED = """pos AS (SELECT sample AS tick, entity, x, z FROM b_positions WHERE entity % 20 <> 0), ch AS (SELECT sample AS tick, entity FROM b_positions),
    pr AS (SELECT c.tick, o.entity AS observer, c.entity, (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) AS d2, a.x IS NULL AS blind, b.x IS NULL AS lost FROM ch o JOIN ch c ON c.tick = o.tick
      LEFT JOIN pos a ON a.tick = o.tick AND a.entity = o.entity LEFT JOIN pos b ON b.tick = c.tick AND b.entity = c.entity)"""


@query("interest_sends", f"WITH {PAIRED} SELECT tick, observer, entity FROM pr WHERE observer = entity OR blind OR lost OR d2 <= 1600 OR (d2 <= 10000 AND tick % 3 = 0)")
def interest_sends(spark, sf):
    return I.sends(*_interest(spark, sf), 40.0, 100.0, 3)


@query("interest_bands", f"""
    WITH {PAIRED} SELECT tick, observer, COUNT(*) FILTER (observer <> entity AND d2 <= 1600) AS near, COUNT(*) FILTER (observer <> entity AND d2 > 1600 AND d2 <= 10000) AS mid,
      COUNT(*) FILTER (observer <> entity AND d2 > 10000) AS far FROM pr GROUP BY tick, observer""")
def interest_bands(spark, sf):
    return I.interest_bands(*_interest(spark, sf), 40.0, 100.0)


@query("fanout_decision", """
    WITH r AS (SELECT l_partkey AS object_id, l_linenumber AS data_revision, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS line,
        CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE 'r' || CAST(l_suppkey % 10 AS VARCHAR) END AS recipient, l_quantity AS d, CASE WHEN l_returnflag = 'R' THEN 45 ELSE 0 END AS reach, l_tax > 0.07 AS native,
        CASE WHEN l_discount < 0.05 THEN 4 END AS dd FROM lineitem),
    t AS (SELECT *, CASE WHEN NOT (d <= reach OR d <= 30) THEN 'out_of_band' WHEN native THEN 'emit' WHEN dd >= data_revision THEN 'already_delivered' ELSE 'emit' END AS disposition FROM r),
    e AS (SELECT *, disposition = 'emit' AND recipient IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY object_id, data_revision, recipient, disposition ORDER BY line) = 1 AS emit FROM t)
    SELECT object_id, data_revision, disposition, emit, COUNT(*) AS n FROM e GROUP BY 1, 2, 3, 4""")
def fanout_decision(spark, sf):
    # the columns that number the lines order them as well as the number would
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("line")
    rows = bind(spark, sf, "lineitem")
    rows = rows.select(F.col("l_partkey").alias("object_id"), F.col("l_linenumber").alias("data_revision"), F.lit(0).alias("owner_revision"), line,
                       F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("r"), (F.col("l_suppkey") % 10).cast("string"))).alias("recipient"), F.col("l_quantity").alias("distance"),
                       F.when(F.col("l_returnflag") == "R", 45).otherwise(0).alias("reach"), F.when(F.col("l_discount") < 0.05, 4).alias("delivered_data"),
                       F.when(F.col("l_discount") < 0.05, 0).alias("delivered_owner"), (F.col("l_tax") > 0.07).alias("native"))
    return I.fanout_decision(rows, 30.0).groupBy("object_id", "data_revision", "disposition", "emit").agg(F.count(F.lit(1)).alias("n"))
