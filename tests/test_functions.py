"""Scalar helpers, rules and catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows
from tidegauge.functions import json as J, text as X
from tidegauge.operators import events as E, quality as Q, rollups as U, sets as D


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value if not isinstance(value, (str, int, float, type(None))) else F.lit(value))
    return df.select(column.alias("v")).first()["v"]


def test_lenient_reads(spark):
    doc = '{"s": "x", "blank": "  ", "nil": null, "n": 1.50, "t": true, "o": {"a": 1}, "a": [1], "big": "12", "brace": "{not json"}'
    f, data = J.json_fields(F.lit(doc)), F.lit(doc)
    want = {"s": "x", "blank": "<empty>", "nil": "<null>", "gone": "<missing>", "n": "1.5", "t": "true", "o": "object", "a": "array", "brace": "{not json"}
    for key, value in want.items():
        assert one(spark, J.lenient_str(f, key, data)) == value, key
    assert one(spark, J.lenient_long(f, "big")) == 12 and one(spark, J.lenient_long(f, "n")) == 0 and one(spark, J.lenient_long(f, "gone")) == 0
    assert one(spark, J.lenient_double(f, "n")) == 1.5 and one(spark, J.lenient_double(f, "s")) is None
    assert one(spark, J.first_present(J.lenient_str(f, "gone"), J.lenient_str(f, "nil"), J.lenient_str(f, "s"))) == "<null>"


def test_payload_match(spark):
    def match(want, have):
        return one(spark, J.payload_match(F.lit(want), F.lit(have)))
    assert match("{}", "{}") and match("", '{"a": 1}') and match("{bad", '{"a": 1}')
    assert match('{"a": 1}', '{"a": "1", "b": 2}') and match('{"a": "1"}', '{"a": 1}')
    assert not match('{"a": 1}', '{"b": 1}') and not match('{"a": 1}', '{"a": 2}') and match('{"a": 1}', "[1]")


def test_text_helpers(spark):
    assert one(spark, X.slug(F.lit("  Hello, World! "))) == "hello-world" and one(spark, X.slug(F.lit("!!"), "_", "none")) == "none"
    assert one(spark, X.clean_name(F.lit('  "The  Game  Old   Mill" '), "game")) == "Old Mill"
    assert one(spark, X.fold_key(F.lit("Odin's Halls · 1,200"))) == one(spark, X.fold_key(F.lit("odins hall")))
    assert one(spark, X.detail_kv(F.lit("a=1 seq=-5 b=x"), "seq", "bigint")) == -5 and one(spark, X.detail_kv(F.lit("xseq=5"), "seq")) is None
    assert one(spark, X.first_sentence(F.lit("One. Two"))) == "One." and one(spark, X.first_sentence(F.lit("v1.2 only"))) == "v1.2 only"
    letters = [one(spark, X.sheet_letter(F.lit(i))) for i in (0, 25, 26, 51, 701, 702, 703, 728, 1378, 16383, 18277, 18278, 475254, -1)]
    assert letters == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "AAB", "ABA", "BAA", "XFD", "ZZZ", "AAAA", "AAAAA", None]
    assert [one(spark, X.classify(F.lit(t))) for t in ("It BROKE?", "I wish", "ok?", "hi")] == ["bug", "feature", "question", None]
    keys = spark.createDataFrame([(k,) for k in ("M10", "M2", "M2b", "K", "x y")], "k string")
    assert [r.k for r in keys.orderBy(X.natural_key(F.col("k"))).collect()] == ["K", "M2", "M2b", "M10", "x y"]
    assert one(spark, X.browser_family(F.lit("Mozilla Edg/1 Chrome"))) == "Edge / Desktop"
    spec = one(spark, X.evidence_spec(F.lit("/t summons_type: Big Fish image1: image2: participants: a, b summons_notes:"), F.lit("clip " + X.FILM)))
    assert tuple(spec) == (2, True, False, True, True)
    assert one(spark, X.credited_name(F.lit("/t badge_name: Old Salt image1:"))) == "Old Salt" and one(spark, X.credited_name(F.lit("/t"))) is None


def test_sensitive_rules_find_planted_text(spark):
    text = "id 76561191234567890 password = abcdefghijkl1 see http://x/?token=12345678 C:\\Users\\me\\x 10.0.0.7"
    got = Q.scan_sensitive(spark.createDataFrame([(1, text), (2, "clean")], "id bigint, text string"), "id", "text")
    assert {r[1] for r in rows(got, "id", "rule")} == set(X.SENSITIVE) and {r[0] for r in rows(got, "id", "rule")} == {1}


def test_load_estimate_clamps(spark):
    assert one(spark, E.load_estimate(F.lit(16.0), F.lit(20.0))) == 0.0 and one(spark, E.load_estimate(F.lit(999.0), F.lit(999.0))) == 1.0


def test_public_outputs_carry_no_identity(spark):
    ev = spark.createDataFrame([(1, "quest_completed", "p1", "r", "d", " ")], "capture_seq bigint, event_type string, actor_id string, region_id string, detail string, provenance string") \
        .withColumn("occurred_at", F.timestamp_seconds(F.lit(0)))
    feed = E.public_feed(ev, F.timestamp_seconds(F.lit(30)))
    assert "actor_id" not in feed.columns and rows(feed, "capture_seq", "provenance", "dropped") == [(1, "observed", 0)]
    assert E.public_feed(ev, F.timestamp_seconds(F.lit(29))).count() == 0
    assert E.redact(ev, ["actor_id", "detail"]).columns == ["capture_seq", "event_type", "region_id", "provenance", "occurred_at"]


def test_feed_keeps_the_newest_and_counts_the_rest(spark):
    ev = spark.range(205).select(F.col("id").alias("capture_seq"), F.lit("first_hit").alias("event_type"), F.timestamp_seconds(F.lit(0)).alias("occurred_at"),
                                 F.lit("r").alias("region_id"), F.lit("d").alias("detail"), F.lit(None).cast("string").alias("provenance"))
    got = E.public_feed(ev, F.timestamp_seconds(F.lit(100)))
    assert got.count() == 200 and got.agg(F.min("capture_seq"), F.max("dropped")).first() == (5, 5)


def test_ladders(spark):
    df = spark.createDataFrame([(30, 95.0, True), (0, 95.0, False), (None, None, False)], "portals int, size_y double, sky boolean")
    df = df.selectExpr("*", "0 AS item_stands", "0 AS signs", "0 AS beds", "0 AS footprint_m2", "9 AS distinct_creators")
    assert [r.kind for r in E.label_ladder(df).collect()] == ["sky major hub", "tower", "shared build"]
    frames = spark.createDataFrame([(False, 0, True, 190.0, 50.0, None, None), (None, None, None, None, None, None, None), (True, 5, False, 170.0, 90.0, 0.3, 0.05)],
                                   "skipped boolean, pieces_near_aim int, occluded boolean, luma_mean double, luma_spread double, depth_span double, far_mass double")
    assert [(r.reject_reason, r.fog) for r in E.fog_flag(E.reject_reason(frames)).collect()] == [("world never loaded", True), (None, False), ("skipped by the runner", True)]


def test_trigger_fields(spark):
    events = spark.createDataFrame([(1, "kill", "Troll(Clone)", "Bows", True, {"biome": "Swamp"}), (2, "kill", None, None, False, {})],
                                   "id bigint, event_name string, target string, weapon_skill string, projectile boolean, fields map<string,string>")
    quests = spark.createDataFrame([("any", "slay", "any", "", False, None), ("or", "kill", "boar_or_troll", "", False, None), ("bow", "kill", "", "bows", True, {"biome": "SWAMP"}),
                                    ("far", "kill", "", "", False, {"zone": "any"})],
                                   "quest_id string, trigger_event string, trigger_target string, trigger_weapon string, trigger_projectile boolean, trigger_where map<string,string>")
    assert rows(Q.trigger_match(events, quests, {"slay": "kill"}), "quest_id", "id") == [("any", 1), ("any", 2), ("bow", 1), ("or", 1)]


def test_two_sides(spark):
    data = [(1, "x", True, 5, 9, 9, 1), (1, "y", False, 5, 0, 0, 0), (2, "x", True, 5, 9, 9, 0), (2, "y", False, 5, 1, 0, 0), (3, "x", True, 5, 9, 9, 0), (3, "y", None, 5, 0, 0, 0), (4, "x", True, 5, 9, 9, 0)]
    df = spark.createDataFrame(data, "pair_id bigint, machine string, last_role boolean, last_samples bigint, applied bigint, checks bigint, over bigint")
    assert [v for _, v in rows(Q.two_side_attribution(df), "pair_id", "verdict")] == [
        "apply_only_large_interframe_displacement_observed", "observe_role_advanced_apply_counters", "missing_or_ambiguous_apply_roles", "bundle_analysis_incomplete"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS v")
    same = U.table_fingerprint(df.orderBy(F.rand(3)), ["id", "v"]).first()
    assert same == U.table_fingerprint(df, ["id", "v"]).first()
    assert same != U.table_fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v"))), ["id", "v"]).first()
    parts = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc")], "id bigint, x string, y string")
    digests = [d for _, d in rows(U.part_digests(parts, "id", ["x", "y"]), "id", "digest")]
    assert digests[0] != digests[1]


def test_diffs_treat_null_as_a_value(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k bigint, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k bigint, v string")
    assert rows(D.keyed_diff(old, new, ["k"], "v"), "k", "change") == [(2, "retyped"), (3, "removed"), (4, "added")]


def test_results_do_not_depend_on_row_order(spark):
    """Rows in another order and another partitioning give the same result."""
    base = spark.range(500).selectExpr("id", "id % 7 AS key", "(id * 13) % 50 AS at", "concat('t', id % 11) AS name")
    other = base.orderBy(F.hash("id")).repartition(5)
    for run in (lambda d: E.thin_log(d, ["key"], ["at", "id"]), lambda d: Q.append_new(d, base.filter("id < 20"), "name", "id"), lambda d: U.facets(d, ["name", "key"])):
        a, b = run(base), run(other)
        assert rows(a, *a.columns) == rows(b, *a.columns)
