"""Event log reads: paging, public feed, review rows, thinning, class ladders, privacy by projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.text import contains_any, slug
from tidegauge.operators.ordered import ordered, position
from tidegauge.runtime import ladder

# Event types a public feed may show.
PUBLIC_TYPES = [
    "structure_placed", "structure_removed", "item_picked_up", "item_stored", "container_opened",
    "road_segment_maintained", "settlement_signature_updated", "player_discovered_landmark",
    "player_followed_road_segment", "player_entered_region", "challenge_started", "challenge_completed",
    "guild_objective_progressed", "guild_objective_completed", "reward_granted", "region_activated",
    "region_deactivated", "interest_subscription_changed", "first_hit", "killing_blow", "weapon_used",
    "quest_completed", "transport_control_changed",
]


def event_page(events: DataFrame, event_type=None, actor=None, region=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the log, newest first, with the size of the whole filtered set on each row."""
    for name, value in (("event_type", event_type), ("actor_id", actor), ("region_id", region)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    total = events.agg(F.count(F.lit(1)))
    page = events.orderBy(F.col("occurred_at").desc(), F.col("event_id").desc()).offset(offset).limit(limit)
    return page.withColumn("total", total.scalar())


def redact(df: DataFrame, drop: list[str]) -> DataFrame:
    """Publish without the named columns."""
    return df.drop(*drop)


def publish(df: DataFrame, keep: list[str]) -> DataFrame:
    """Publish only the named columns; a missing one is an error at plan time."""
    return df.select(*keep)


def public_feed(events: DataFrame, now: Column, delay_s: float = 30, capacity: int = 200,
                types: list[str] | None = None) -> DataFrame:
    """Newest ``capacity`` public rows in capture order, then only those old enough to show; no actor column.

    ``dropped`` counts the public rows that aged out.
    """
    public = events.filter(F.col("event_type").isin(types or PUBLIC_TYPES))
    kept = public.orderBy(F.col("capture_seq").desc()).limit(capacity)
    dropped = public.agg(F.greatest(F.count(F.lit(1)) - capacity, F.lit(0)).cast("bigint"))
    return (kept.withColumn("dropped", dropped.scalar())
            .filter(F.col("occurred_at") <= now - F.make_dt_interval(secs=F.lit(delay_s)))
            .select("capture_seq", "event_type", "occurred_at", "region_id", "detail",
                    F.when(F.trim(F.coalesce("provenance", F.lit(""))) == "", "observed").otherwise(F.col("provenance"))
                    .alias("provenance"), "dropped"))


def submission_view(events: DataFrame, wanted: str = "quest_completed") -> tuple[DataFrame, DataFrame]:
    """Review rows of completed quests under a deterministic id, and the number of other rows."""
    fields = F.from_json("payload", "map<string,string>")
    p = F.coalesce(F.when(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), fields),
                   F.create_map().cast("map<string,string>"))
    rows = events.filter(F.col("event_type") == wanted).withColumn("p", p)
    quest = F.coalesce(F.element_at("p", "quest_id"), F.lit(""))
    stamp = F.substring(F.regexp_replace(F.coalesce(F.col("occurred_at").cast("string"), F.lit("")), "[^0-9]", ""), 1, 14)
    event_id = F.coalesce(F.nullif(F.col("event_id").cast("string"), F.lit("")), F.lit("unknown"))
    rows = rows.select(
        F.concat_ws("-", F.coalesce(F.nullif(stamp, F.lit("")), F.lit("0" * 14)), slug(quest, "-", "quest"),
                    slug(F.substring(F.regexp_replace(event_id, "-", ""), 1, 8), "-", "event")).alias("submission_id"),
        F.coalesce(F.nullif(quest, F.lit("")), event_id).alias("action_id"),
        quest.alias("quest_id"),
        F.coalesce(F.nullif(F.element_at("p", "quest_name"), F.lit("")), F.nullif(quest, F.lit("")), F.lit("unknown"))
        .alias("quest_name"),
        F.element_at("p", "guild").alias("guild"), F.element_at("p", "category").alias("category"),
        F.element_at("p", "creature").alias("creature"), F.element_at("p", "weapon").alias("weapon"),
        (F.coalesce(F.lower(F.element_at("p", "ranged")), F.lit("")).isin("", "false", "0", "null") == F.lit(False))
        .alias("ranged"),
        F.col("actor_id").alias("player_id"), F.lit("ready_for_review").alias("status"))
    skipped = events.agg(F.count_if(~F.col("event_type").eqNullSafe(F.lit(wanted))).alias("skipped"))
    return rows, skipped


def label_ladder(df: DataFrame) -> DataFrame:
    """Kind of a structure from its counts, first match wins; ``sky`` builds get a prefix."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    # Thresholds and names of the kinds.
    kind = ladder((c("portals") >= 30, "major hub"), (c("size_y") >= 90, "tower"), (c("item_stands") >= 200, "museum"),
                  (c("signs") >= 800, "sign-covered"), (c("portals") >= 10, "hub"), (c("beds") >= 10, "settlement"),
                  (c("footprint_m2") >= 50000, "sprawl"), (c("size_y") >= 60, "tall hall"),
                  (c("distinct_creators") >= 8, "shared build"), default="build")
    return df.withColumn("kind", F.when(F.col("sky"), F.concat(F.lit("sky "), kind)).otherwise(kind))


def vantage(variant: Column) -> Column:
    """Where the camera stood, from the variant name."""
    eye = F.lit(False)
    for head in ("hall_", "toproom_", "gate_", "court_"):
        eye = eye | variant.startswith(head)
    return ladder((variant.startswith("seat_"), "seated"), (eye, "eye level"), default="drone")


def reject_reason(df: DataFrame) -> DataFrame:
    """First capture rule a frame fails, NULL when it passes."""
    return df.withColumn("reject_reason", ladder(
        (F.coalesce("skipped", F.lit(False)), "skipped by the runner"),
        (F.coalesce(F.col("pieces_near_aim") == 0, F.lit(False)), "world never loaded"),
        (F.coalesce("occluded", F.lit(False)), "view obstructed")))


def fog_flag(df: DataFrame) -> DataFrame:
    """Bright and even, or nearly as bright with a flat depth picture. No measurement means no flag."""
    # Luma mean, luma spread, depth span, far mass.
    mean, spread, span, mass = 186.0, 60.0, 0.35, 0.10
    whiteout = (F.col("luma_mean") > mean) & (F.col("luma_spread") < spread)
    flat = ((F.col("luma_mean") > mean - 20) & (F.coalesce("depth_span", F.lit(1.0)) < span)
            & (F.coalesce("far_mass", F.lit(1.0)) < mass))
    return df.withColumn("fog", F.coalesce(whiteout | flat, F.lit(False)))


def load_estimate(frame_ms: Column, p95_ms: Column) -> Column:
    """Two clamped ramps, weighted."""
    def clamp(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return clamp((frame_ms - 16.0) / 50.0) * 0.45 + clamp((p95_ms - 20.0) / 60.0) * 0.55


def thin_log(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First four rows per key, then only counts that are powers of two; the row carries its exact count."""
    numbered = ordered(df, key, order).scan(seen=position()).df
    return numbered.filter((F.col("seen") <= 4) | (F.bit_count("seen") == 1))


def priority_class(df: DataFrame, name: Column, components: Column, distance: Column, radius: Column) -> DataFrame:
    """Delivery tier, rank and reason of an object from its name and component list; first rule wins.

    ``components`` is one lower-case text. The rank is not monotone in rule order.
    """
    name = F.lower(F.coalesce(name, F.lit("")))
    parts = F.lower(F.coalesce(components, F.lit("")))
    # Fixed values: (tier, rank, reason, words of the name, words of the components).
    rules = [
        ("player_critical", 0, "player_name_or_component", ["player"], ["player", "character"]),
        ("portal", 1, "portal_name_or_component", ["portal", "teleport"], ["teleportworld", "teleport"]),
        ("player_critical", 0, "spawn_protection_or_survival_component",
         ["bed", "guardstone", "ward", "piece_guardstone", "fire", "hearth", "bonfire", "shieldgenerator"],
         ["bed", "fireplace", "privatearea", "shieldgenerator"]),
        ("storage_crafting", 4, "storage_or_crafting_name_or_component",
         ["chest", "crate", "cart", "karve", "longship", "forge", "workbench", "artisan", "cauldron", "oven", "smelter",
          "kiln", "fermenter", "windmill", "spinningwheel", "sapcollector", "beehive"],
         ["container", "craftingstation", "smelter", "fermenter", "cookingstation", "beehive", "sapcollector"]),
        ("near_interactive", 3, "near_interactive_name_or_component",
         ["door", "gate", "sign", "itemstand", "chair", "table", "maptable", "raven", "ship"],
         ["door", "textreceiver", "itemstand", "chair", "ship", "maptable"]),
        ("structural_anchor", 2, "structural_piece_name",
         ["pole", "beam", "pillar", "column", "foundation", "floor", "wall", "roof", "stone", "marble", "blackmarble",
          "iron_"], []),
    ]
    decorative = ["rug", "banner", "curtain", "deco", "piece_banner", "piece_tapestry", "piece_xmas", "piece_maypole"]
    def outcome(tier: str, rank: int, reason: str) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))
    steps = [(contains_any(name, words) | contains_any(parts, comps), outcome(tier, rank, reason))
             for tier, rank, reason, words, comps in rules]
    steps.append(((distance > radius * 0.66) & contains_any(name, decorative),
                  outcome("decorative_far", 6, "far_decorative_name")))
    picked = ladder(*steps, default=outcome("support_piece", 5, "default_loaded_piece"))
    return df.withColumn("__class", picked).select(
        "*", F.col("__class.tier").alias("tier"), F.col("__class.rank").alias("rank"),
        F.col("__class.reason").alias("reason")).drop("__class")


def boundary_long(events: DataFrame) -> DataFrame:
    """Counts of boundary events by dimension: ``(dimension, key, n)``.

    ``events`` has ``event_type, schema_version, event_version`` and ``data`` as JSON text.
    """
    from tidegauge.functions.json import json_fields, lenient_str

    events = events.withColumn("__f", json_fields(F.col("data")))
    s = lambda k: lenient_str(F.col("__f"), k)
    kind = F.col("event_type")
    auth, ident = kind == "authorization.decided", kind == "identity.resolved"
    request, delivery = kind == "request.completed", kind.startswith("zdo.")
    def entry(dimension: str, key: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(dimension).alias("dimension"), key.alias("key"))
        return made if when is None else F.when(when, made)
    entries = F.array(
        entry("event_type", F.coalesce(kind, F.lit("<missing>"))),
        entry("version", F.concat_ws("/", "schema_version", "event_version")),
        entry("authorization", F.concat_ws("/", s("result"), s("reason")), auth),
        entry("capabilities", F.concat_ws(" -> ", s("required_capabilities"), s("granted_capabilities")), auth),
        entry("identity", F.concat_ws("/", s("principal_kind"), s("resolution_basis")), ident),
        entry("proxy", F.concat(F.lit("socket:"), s("socket_peer_class"), F.lit(" forwarded:"),
                                s("forwarded_peer_claim_class")), ident),
        entry("proxy_warning", F.lit("private socket, public claim"),
              ident & (s("socket_peer_class") == "private") & (s("forwarded_peer_claim_class") == "public")),
        entry("route_status", F.concat_ws(" ", s("status_code"), s("route")), request),
        entry("operation", kind, delivery), entry("window", s("window_id"), delivery),
        entry("recipient", s("recipient_id"), delivery), entry("release", s("observed_mod_release"), delivery),
        entry("consumer_result", s("last_operation_result"), kind == "zdo.consumer.heartbeat"))
    return (events.select(F.explode(F.array_compact(entries)).alias("e"))
            .groupBy(F.col("e.dimension").alias("dimension"), F.col("e.key").alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


def boundary_totals(events: DataFrame) -> DataFrame:
    """The twelve delivery totals; queued and polled envelopes count for their own event type only."""
    from tidegauge.functions.json import json_fields, lenient_long

    # Total -> (data field, event type it is limited to).
    fields = {
        "queued_envelopes": ("envelope_count", "zdo.batch.queued"), "accepted_envelopes": ("accepted_count", None),
        "request_bytes": ("request_bytes", None), "polled_envelopes": ("envelope_count", "zdo.batch.polled"),
        "ack_sequence_count": ("sequence_count", None), "acknowledged_count": ("acknowledged_count", None),
        "unknown_ack_count": ("unknown_count", None), "applied_count": ("applied", None),
        "superseded_count": ("superseded", None), "rejected_count": ("rejected", None),
        "pending_count": ("pending", None), "priority_fast_lane_applied": ("priority_fast_lane_applied", None),
    }
    def total(field: str, only: str | None) -> Column:
        value = lenient_long(F.col("__f"), field)
        return F.sum(value if only is None else F.when(F.col("event_type") == only, value).otherwise(0))
    rows = events.filter(F.col("event_type").startswith("zdo.")).withColumn("__f", json_fields(F.col("data")))
    return rows.agg(
        *[F.coalesce(total(f, only), F.lit(0)).alias(name) for name, (f, only) in fields.items()])


def unknown_types(events: DataFrame, known: list[str]) -> DataFrame:
    return events.filter(~F.col("event_type").isin(known)).select("event_type").distinct()


def duration_summary(events: DataFrame, duration: str, by: str = "event_type") -> DataFrame:
    """Count, extremes and mean of a duration per event type; rows without one are not counted.

    Aggregates skip NULL by themselves: a filter on the duration would be pushed down and parse it a second time.
    """
    return (events.groupBy(by).agg(F.count(duration).alias("n"), F.min(duration).alias("min_ms"), F.max(duration).alias("max_ms"),
                                   F.avg(duration).alias("mean_ms")).filter("n > 0"))


def missing_fields(events: DataFrame, fields: list[str]) -> DataFrame:
    """How often each data field is absent, null or blank, per ``type.field``."""
    from tidegauge.functions.json import json_fields, lenient_str

    events = events.withColumn("__f", json_fields(F.col("data")))
    marks = F.array(*[F.when(lenient_str(F.col("__f"), f).isin("<missing>", "<empty>", "<null>"), F.lit(f))
                      for f in fields])
    return (events.select("event_type", F.explode(F.array_compact(marks)).alias("f"))
            .groupBy(F.concat_ws(".", "event_type", "f").alias("field")).agg(F.count(F.lit(1)).alias("n")))


def session_mix(sessions: DataFrame) -> DataFrame:
    """Sessions by protocol (binary or other) and region."""
    return (sessions.groupBy(F.when(F.col("protocol") == "binary", "binary").otherwise("other").alias("protocol"),
                             F.coalesce("region_id", F.lit("unassigned")).alias("region_id"))
            .agg(F.count(F.lit(1)).alias("n")))


def session_union_count(logs: dict[str, DataFrame]) -> DataFrame:
    """Rows per session in each log and the time span over all of them."""
    tagged = None
    for name, log in logs.items():
        part = log.select("session_id", "ts", F.lit(name).alias("log"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (tagged.filter(F.col("session_id").isNotNull() & (F.col("session_id").cast("string") != ""))
            .groupBy("session_id")
            .agg(*[F.count_if(F.col("log") == name).alias(name) for name in logs],
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
