"""Challenge progress, points and achievements derived from the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.json import fields_match, json_fields
from tidegauge.operators.ordered import ordered, running_max, running_sum
from tidegauge.runtime import literal_rows, small_side

# Achievement id, title, scope, provenance, rule, event type, threshold.
ACHIEVEMENTS = [
    ("first_foundation", "First Foundation", "community", "observed", "first", "structure_placed", 1),
    ("community_builder", "Community Builder", "community", "observed", "nth", "structure_placed", 25),
    ("challenge_champions", "Challenge Champions", "community", "observed", "first", "challenge_completed", 1),
    ("guild_milestone", "Guild Milestone", "guild", "observed", "first", "guild_objective_completed", 1),
    ("rising_ranks", "Rising Ranks", "player", "observed", "first", "player_rank_changed", 1),
    ("founding_members", "Founding Members", "community", "observed", "actors", "player_connected", 5),
    ("landmark_explorers", "Landmark Explorers", "community", "observed", "first", "player_discovered_landmark", 1),
    ("world_age_7_days", "World Age: 7 Days", "community", "reconstructed", "age", None, 7),
]
DAY = 86_400_000_000


def challenge_matches(events: DataFrame, challenges: DataFrame) -> DataFrame:
    """Events that count for a challenge: active, same type, inside its window, filter met, guild present."""
    rules = small_side(challenges.filter("active").select(
        "challenge_id", F.col("trigger_event").alias("event_type"), json_fields(F.col("filters")).alias("__want"), "window_start", "window_end", "mode", "target",
        "rewards"))
    inside = ((F.col("window_start").isNull() | (F.col("window_start") <= F.col("us")))
              & (F.col("window_end").isNull() | (F.col("window_end") >= F.col("us"))))
    return (events.filter(F.col("guild_id").isNotNull() & (F.col("guild_id").cast("string") != ""))
            .withColumn("__have", json_fields(F.col("payload"))).join(rules, "event_type")
            .filter(inside & fields_match(F.col("__want"), F.col("__have"))).drop("__want", "__have"))


def challenge_progress(events: DataFrame, challenges: DataFrame, increment: Column | None = None) -> DataFrame:
    """Progress of each (challenge, guild): sum or maximum of increments, frozen at the first value reaching the target."""
    amount = F.lit(1) if increment is None else increment
    rows = challenge_matches(events, challenges).withColumn("__amount", amount.cast("bigint"))
    g = ordered(rows, ["challenge_id", "guild_id"], ["us", "event_id"]).scan(
        __sum=running_sum(F.col("__amount")), __max=running_max(F.col("__amount")))
    value = F.when(F.col("mode") == "max", F.col("__max")).otherwise(F.col("__sum"))
    at = F.struct("us", "event_id")
    reached = value >= F.col("target")
    done = F.min_by(F.struct(value.alias("value"), F.col("us"), F.col("event_id")), F.when(reached, at))
    out = g.df.groupBy("challenge_id", "guild_id").agg(
        done.alias("d"), F.max_by(value, at).alias("last_value"), F.first("rewards").alias("rewards"))
    return out.select("challenge_id", "guild_id", F.coalesce("d.value", "last_value").alias("current_value"),
                      F.col("d").isNotNull().alias("completed"), F.col("d.us").alias("completed_us"),
                      F.col("d.event_id").alias("completed_by"), F.coalesce(reward_points(F.col("rewards")), F.lit(0)).alias("reward"))


def reward_points(rewards: Column) -> Column:
    """Amount of the first guild points entry that has one; 0 when there is none or it is not a whole number."""
    entries = F.from_json(rewards, "array<map<string,string>>")
    points = F.filter(entries, lambda e: (F.element_at(e, "type") == "guild_points") & F.map_contains_key(e, "amount"))
    return F.coalesce(F.get(points, 0)["amount"].try_cast("int"), F.lit(0))


def player_points(events: DataFrame) -> DataFrame:
    """One point per structure placed and the last valid new rank, per player."""
    rank_json = F.get_json_object("payload", "$.new_rank")
    number = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.new_rank", "variant")) == "BIGINT", rank_json)
    placed = F.col("event_type") == "structure_placed"
    ranked = (F.col("event_type") == "player_rank_changed") & number.isNotNull()
    return (events.filter(F.col("actor_id").isNotNull() & (F.col("actor_id").cast("string") != "")).filter(placed | ranked)
            .groupBy("actor_id").agg(F.count_if(placed).alias("points"),
                                     F.coalesce(F.max_by(number.try_cast("int"), F.when(ranked, F.struct("us", "event_id"))), F.lit(0)).alias("rank")))


def guild_points(events: DataFrame, progress: DataFrame) -> DataFrame:
    """Structures placed plus challenge rewards per guild; only completions with a reward are counted."""
    built = events.filter((F.col("event_type") == "structure_placed") & F.col("guild_id").isNotNull()) \
        .groupBy("guild_id").agg(F.count(F.lit(1)).alias("points"), F.lit(0).cast("bigint").alias("done"))
    won = progress.filter("completed and reward > 0").groupBy("guild_id").agg(
        F.sum("reward").cast("bigint").alias("points"), F.count(F.lit(1)).alias("done"))
    return built.unionByName(won).groupBy("guild_id").agg(F.sum("points").alias("points"), F.sum("done").alias("challenges_completed"))


def achievements(events: DataFrame, now: Column) -> DataFrame:
    """All eight achievements, locked ones included, with unlock time and the events that prove them.

    Thresholds are small fixed numbers, so only top-k reads of the log are needed.
    """
    spark = events.sparkSession
    ev = events.select("event_id", "event_type", "us", "actor_id")
    proof = F.struct("us", "event_id", "event_type")
    parts = []
    firsts = ev.groupBy("event_type").agg(F.min(proof).alias("e"))
    names = [(a[0], a[5]) for a in ACHIEVEMENTS if a[4] == "first"]
    parts.append(firsts.join(F.broadcast(literal_rows(spark, names, "id string, event_type string")), "event_type")
                 .select("id", F.col("e.us").alias("unlocked_us"), F.array("e").alias("evidence")))
    for name, _, _, _, rule, kind, n in ACHIEVEMENTS:
        if rule == "nth":
            rows = ev.filter(F.col("event_type") == kind).orderBy("us", "event_id").limit(n)
            pick = F.sort_array(F.collect_list(proof))
            parts.append(_unlocked(rows, name, n, pick, F.array(F.element_at("all", 1), F.element_at("all", -1))))
        if rule == "actors":
            rows = ev.filter((F.col("event_type") == kind) & F.col("actor_id").isNotNull() & (F.col("actor_id").cast("string") != ""))
            rows = rows.groupBy("actor_id").agg(F.min(proof).alias("e")).select("e.*").orderBy("us", "event_id").limit(n)
            parts.append(_unlocked(rows, name, n, F.sort_array(F.collect_list(proof)), F.col("all")))
        if rule == "age":
            first = ev.agg(F.min(proof).alias("e"))
            parts.append(first.filter(now - F.col("e.us") >= n * DAY).select(
                F.lit(name).alias("id"), (F.col("e.us") + n * DAY).alias("unlocked_us"), F.array("e").alias("evidence")))
    unlocked = reduce(DataFrame.unionByName, parts)
    catalog = literal_rows(spark, [(i, a[0], a[1], a[2], a[3]) for i, a in enumerate(ACHIEVEMENTS)],
                           "position int, id string, title string, scope string, provenance string")
    return catalog.join(unlocked, "id", "left").select(
        "position", "id", "title", "scope", "provenance", F.col("unlocked_us").isNotNull().alias("unlocked"), "unlocked_us",
        F.transform(F.coalesce("evidence", F.array()), lambda e: e["event_id"]).alias("evidence_ids"))


def _unlocked(rows: DataFrame, name: str, n: int, every: Column, evidence: Column) -> DataFrame:
    gathered = rows.agg(every.alias("all")).filter(F.size("all") >= n)
    return gathered.select(F.lit(name).alias("id"), F.element_at("all", n)["us"].alias("unlocked_us"), evidence.alias("evidence"))
