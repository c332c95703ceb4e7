"""Rules, anomalies and comparisons. Violations are rows; data is never dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.text import SENSITIVE


def scan_sensitive(docs: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """Every match of every rule: ``(key, rule, found)``. The rules ride along as expressions, no join."""
    rules = rules or SENSITIVE
    hits = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_extract_all(F.col(text), F.lit(pattern), 0).alias("found"))
                     for name, pattern in rules.items()])
    return (docs.select(F.col(key), F.explode(hits).alias("h"))
            .select(F.col(key), F.col("h.rule").alias("rule"), F.explode("h.found").alias("found")))


def validate_rules(df: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Violations ``(rule, key, message)`` of row rules; a rule is the condition that must hold, NULL fails it."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message")))
        for name, (ok, message) in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("b")).select("b.rule", "key", "b.message")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Set rule: keys used more than once, as violations."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.lit("duplicate_key").alias("rule"), F.col(key).cast("string").alias("key"),
                    F.concat(F.lit("used "), F.col("n").cast("string"), F.lit(" times")).alias("message")))


def unknown_references(df: DataFrame, key: str, values: str, known: DataFrame, known_id: str) -> DataFrame:
    """Set rule: array members that are not a known id."""
    each = df.select(F.col(key).cast("string").alias("key"), F.explode(values).alias("__v"))
    return (each.join(known.select(F.col(known_id).alias("__v")).distinct(), "__v", "left_anti")
            .select(F.lit("unknown_reference").alias("rule"), "key", F.col("__v").cast("string").alias("message")))


# Shapes of ids.
SLUG = r"^[a-z][a-z0-9-]*$"
RECORD_ID = r"^[a-z][a-z0-9-]*:[a-z0-9][a-z0-9-]*$"


def has_text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def disjoint(a: str, b: str) -> Column:
    return ~F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def dictionary_join(fields: DataFrame, notes: DataFrame, key: str, note: str) -> DataFrame:
    """Fields with their descriptions; those without one get the draft mark."""
    return (fields.join(notes.select(key, note), key, "left")
            .withColumn("missing", F.col(note).isNull()).withColumn(note, F.coalesce(F.col(note), F.lit("*(no draft)*"))))


def policy_coverage(facts: DataFrame, rules: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts with their rule, keys of facts without a rule, keys of rules without a fact."""
    return (facts.join(rules, key), facts.select(key).distinct().join(rules, key, "left_anti"),
            rules.select(key).distinct().join(facts, key, "left_anti"))


def append_new(batch: DataFrame, journal: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a batch whose id was never written in any status; of equal ids the first of the batch."""
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
    return first.join(journal.select(key), key, "left_anti")


def missing_actions(expected: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Expected actions without a completed or resume row."""
    return expected.join(receipts.filter(F.col("state").isin("completed", "resume_requested")), keys, "left_anti")


def tags_overlap(df: DataFrame, column: str, tags: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Rows with any wanted tag and a wanted kind; an empty wish matches all."""
    if tags:
        df = df.filter(F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in tags])), F.lit(False)))
    return df.filter(F.col(kind).isin(kinds)) if kinds else df


def tag_lookup(posts: DataFrame, tags: dict[int, str], audience_tags: dict[str, str], format_tags: list[str]) -> DataFrame:
    """Tag names of each post, its audiences and format, and what stops it from being published.

    ``posts``: ``(post_id, content, attachments, tag_ids)``. The tag dictionaries are configuration of a few dozen entries.
    """
    names = F.create_map(*[F.lit(x) for p in tags.items() for x in p])
    audiences = F.create_map(*[F.lit(x) for p in audience_tags.items() for x in p])
    named = posts.withColumn("tags", F.transform("tag_ids", lambda t: F.coalesce(names[t], F.concat(F.lit("unknown:"), t.cast("string")))))
    named = named.withColumn("audiences", F.array_compact(F.transform("tags", lambda t: audiences[t])))
    named = named.withColumn("formats", F.filter("tags", lambda t: t.isin(format_tags)))
    empty = (F.trim(F.coalesce("content", F.lit(""))) == "") & (F.coalesce("attachments", F.lit(0)) == 0)
    reasons = F.array_compact(F.array(
        F.when(empty, "starter post has no text, attachment, or embed"),
        F.when(F.size("audiences") == 0, "starter post needs at least one managed audience tag"),
        F.when(F.size("formats") != 1, F.concat(F.lit("starter post needs exactly one managed format tag (found "),
                                                F.size("formats").cast("string"), F.lit(")")))))
    return named.withColumn("reasons", reasons).select(
        "post_id", "tags", "audiences", F.when(F.size("formats") == 1, F.get("formats", 0)).alias("format"),
        (F.size("reasons") == 0).alias("publishable"), "reasons")


def canonical_event(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The lower-case name under which events and triggers meet; ``aliases`` maps other lower-case names to it."""
    low = F.lower(name)
    return F.coalesce(F.create_map(*[F.lit(x) for p in aliases.items() for x in p])[low], low) if aliases else low


def trigger_match(events: DataFrame, quests: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Quest x event pairs whose trigger fits.

    Events: ``event_name, target, weapon_skill, projectile, fields map``; quests: ``quest_id, trigger_event, trigger_target,
    trigger_weapon, trigger_projectile, trigger_where map``. They meet on the canonical event name.
    """
    from tidegauge.runtime import small_side

    want = small_side(quests.withColumn("__event", canonical_event(F.col("trigger_event"), aliases)))
    seen = events.withColumn("__event", canonical_event(F.col("event_name"), aliases))
    target = F.trim(F.regexp_replace(F.lower(F.coalesce("target", F.lit(""))), r"\(clone\)", ""))
    wish = F.lower(F.coalesce("trigger_target", F.lit("")))
    parts = F.filter(F.split(wish, "_or_"), lambda p: p != "")
    target_ok = (F.trim(wish) == "") | (wish == "any") | F.exists(parts, lambda p: F.contains(target, F.trim(p)))
    weapon = F.coalesce("trigger_weapon", F.lit(""))
    weapon_ok = (F.trim(weapon) == "") | F.coalesce(F.lower(weapon) == F.lower("weapon_skill"), F.lit(False))
    projectile_ok = ~F.coalesce("trigger_projectile", F.lit(False)) | F.coalesce("projectile", F.lit(False))
    where = F.coalesce(F.map_entries("trigger_where"), F.array())
    where_ok = F.forall(where, lambda e: F.map_contains_key(F.col("fields"), e["key"])
                        & ((F.lower(e["value"]) == "any") | F.coalesce(F.lower(e["value"]) == F.lower(F.element_at("fields", e["key"])), F.lit(False))))
    return seen.join(want, "__event").filter(target_ok & weapon_ok & projectile_ok & where_ok).drop("__event")


def two_side_attribution(summaries: DataFrame, side: str = "machine") -> DataFrame:
    """Verdict over the last roles of two machines: exactly one must apply and one observe, the observer must stand still.

    ``summaries``: ``(pair_id, machine, last_role, last_samples, applied, checks, over)``.
    """
    row = F.struct(F.col(side).alias("m"), "last_role", "last_samples", "applied", "checks", "over")
    both = summaries.groupBy("pair_id").agg(F.count(F.lit(1)).alias("sides"), F.count_if(F.col("last_role")).alias("apply_n"),
                                            F.count_if(~F.col("last_role")).alias("observe_n"),
                                            F.max(F.when(F.col("last_role"), row)).alias("a"), F.max(F.when(~F.col("last_role"), row)).alias("o"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    one_each = (F.col("apply_n") == 1) & (F.col("observe_n") == 1) & (F.col("sides") == 2)
    verdict = (F.when(F.col("sides") < 2, "bundle_analysis_incomplete").when(~one_each, "missing_or_ambiguous_apply_roles")
               .when((n("a.last_samples") < 2) | (n("o.last_samples") < 2), "insufficient_final_role_segment")
               .when((n("o.applied") > 0) | (n("o.checks") > 0) | (n("o.over") > 0), "observe_role_advanced_apply_counters")
               .when((n("a.applied") <= 0) | (n("a.checks") <= 0), "apply_role_has_no_measurable_apply_window")
               .when(n("a.over") > 0, "apply_only_large_interframe_displacement_observed")
               .otherwise("apply_only_no_large_interframe_displacement_observed"))
    status = (F.when(verdict == "bundle_analysis_incomplete", "unavailable").when(verdict == "observe_role_advanced_apply_counters", "contradictory")
              .when(verdict.startswith("apply_only"), "ready").otherwise("inconclusive"))
    return both.select("pair_id", status.alias("status"), verdict.alias("verdict"),
                       F.when(one_each, F.col("a.m")).alias("apply_machine"), F.when(one_each, F.col("o.m")).alias("observe_machine"))


def catalog_anomalies(quests: DataFrame) -> DataFrame:
    """Anomalies ``(kind, row, quest_id, message)`` of a quest catalog in row order.

    ``quests``: ``(row, quest_id, name, requirements, bot_command, evidence_note, auto_checked)``.
    """
    from tidegauge.functions.text import CAMERA, GROUP, LINK, credited_name, evidence_spec
    from tidegauge.operators.ordered import ordered, previous

    q = quests.withColumn("credited", credited_name(F.col("bot_command"))) \
        .withColumn("ev", evidence_spec(F.col("bot_command"), F.col("requirements")))
    def flag(rows: DataFrame, kind: str, message: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "row", "quest_id", message.alias("message"))
    by_id = ordered(q, ["quest_id"], ["row"]).scan(before=previous(F.col("name"))).df
    twice = flag(by_id.filter("before is not null"), "duplicate_id", F.concat(F.lit("collides with "), "before"))
    commands = q.filter(F.coalesce("bot_command", F.lit("")) != "")
    nameless = flag(commands.filter("credited is null"), "missing_name_param", F.lit("no parameter names what is turned in"))
    # the first quest to use a credited name keeps it: later quests of another name are flagged
    named = commands.filter("credited is not null")
    owner = named.groupBy("credited").agg(F.min_by("name", "row").alias("owner"))
    shared = flag(named.join(owner, "credited").filter("owner <> name"), "duplicate_credit", F.concat(F.lit("also credited by "), "owner"))
    differs = flag(named.filter(F.lower("credited") != F.lower("name")), "credit_mismatch", F.concat(F.lit("credits "), "credited"))
    text = F.coalesce("requirements", F.lit(""))
    cameras = F.size(F.split(text, CAMERA)) - 1
    shots = F.col("ev.screenshots")
    checks = F.array_compact(F.array(
        F.when((cameras > 0) & (shots > 0) & (cameras != shots), F.concat(F.lit("camera marks "), cameras.cast("string"), F.lit(", image slots "), shots.cast("string"))),
        F.when(text.contains(LINK) & ~F.col("ev.link"), "link mark without a url slot"),
        F.when(text.contains(GROUP) & ~F.col("ev.group_turnin"), "group mark without a participants slot"),
        F.when((shots == 0) & F.coalesce("evidence_note", F.lit("")).rlike("(?i)screenshot|photo|image"), "note asks for a photo without an image slot")))
    slots = q.filter(~F.coalesce("auto_checked", F.lit(False))).withColumn("m", F.explode(checks))
    return reduce(DataFrame.unionByName, [twice, nameless, shared, differs, flag(slots, "evidence_mismatch", F.col("m"))])


def manifest_objects(events: DataFrame, manifest_id: str, event_type: str = "priority_manifest") -> DataFrame:
    """Objects listed in the manifests of one id (case ignored), defaults filled in, keyed by name and place if unnamed."""
    j = lambda c, k: F.get_json_object(c, f"$.{k}")
    record = "array<string>"
    wanted = events.filter((F.col("event_type") == event_type) & (F.lower(j("payload", "manifest_id")) == manifest_id.lower()))
    rows = wanted.select("event_id", j("payload", "route_stop_id").alias("stop"), j("payload", "sample_id").alias("sample"),
                         F.posexplode(F.from_json(j("payload", "records"), record)).alias("pos", "r"))
    huge = (1 << 31) - 1
    num = lambda k: F.coalesce(j("r", k).try_cast("double"), F.lit(0.0))
    short = lambda k: F.regexp_replace(F.format_string("%.3f", num(k)), r"\.?0+$", "")
    name = F.coalesce(j("r", "object_name"), F.lit("unknown"))
    place = F.concat(name, F.lit("@"), short("object_x"), F.lit(","), short("object_y"), F.lit(","), short("object_z"))
    key = j("r", "object_stable_key")
    return rows.select(
        "event_id", "pos", F.when(F.trim(F.coalesce(key, F.lit(""))) == "", place).otherwise(key).alias("object_key"), name.alias("name"),
        F.coalesce(j("r", "object_kind"), F.lit("unknown")).alias("kind"),
        F.coalesce(j("r", "priority_tier"), F.lit("decorative_far")).alias("tier"),
        F.coalesce(j("r", "priority_rank").try_cast("int"), F.lit(huge)).alias("rank"),
        F.coalesce(j("r", "priority_order").try_cast("int"), F.lit(huge)).alias("order_no"),
        F.coalesce(j("r", "distance_meters").try_cast("double"), F.lit(1.7976931348623157e308)).alias("distance"),
        F.coalesce(j("r", "route_stop_id"), F.col("stop"), F.lit("")).alias("route_stop_id"),
        F.coalesce(j("r", "sample_id"), F.col("sample"), F.lit("")).alias("sample_id"))
