"""Queries over event logs and boundary events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import json as J, text as X
from tidegauge.operators import events as E
from tidegauge.plans.bindings import bind, table
from tidegauge.plans.registry import query


@query("event_page", """
    SELECT event_id, us, event_type, actor_id, region_id, guild_id, payload,
           (SELECT COUNT(*) FROM b_events WHERE event_type = 'purchase') AS total
    FROM b_events WHERE event_type = 'purchase' ORDER BY us DESC, event_id DESC LIMIT 50 OFFSET 20""")
def event_page(spark, sf):
    ev = bind(spark, sf, "b_events")
    return E.event_page(ev, event_type="purchase", limit=50, offset=20).select(
        "event_id", "us", "event_type", "actor_id", "region_id", "guild_id", "payload", "total")


@query("lenient_fields", """
    WITH f AS (SELECT event_id,
        CASE WHEN TRIM(json_extract_string(data, '$.recipient_id')) = '' THEN '<empty>'
             ELSE json_extract_string(data, '$.recipient_id') END AS recipient,
        COALESCE(json_extract_string(data, '$.reason'), '<missing>') AS reason,
        COALESCE(json_extract_string(data, '$.pending'), '<null>') AS pending,
        json_extract_string(data, '$.result') AS result,
        CAST(json_extract_string(data, '$.accepted_count') AS BIGINT) AS accepted,
        COALESCE(CAST(json_extract_string(data, '$.pending') AS BIGINT), 0) AS pending_n,
        CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE) AS duration_ms
      FROM b_boundary)
    SELECT *, CASE WHEN reason <> '<missing>' THEN reason ELSE result END AS first_of FROM f""")
def lenient_fields(spark, sf):
    f = F.col("f")
    return bind(spark, sf, "b_boundary").withColumn("f", J.json_fields(F.col("data"))).select(
        "event_id", J.lenient_str(f, "recipient_id", F.col("data")).alias("recipient"), J.lenient_str(f, "reason").alias("reason"),
        J.lenient_str(f, "pending").alias("pending"), J.lenient_str(f, "result").alias("result"),
        J.lenient_long(f, "accepted_count").alias("accepted"), J.lenient_long(f, "pending").alias("pending_n"),
        J.lenient_double(f, "duration_ms").alias("duration_ms"),
        J.first_present(J.lenient_str(f, "nothing"), J.lenient_str(f, "reason"), J.lenient_str(f, "result")).alias("first_of"))


@query("detail_kv", """
    SELECT event_id, SUBSTRING(detail, 6, STRPOS(detail, ' k=') - 6) AS kind, k,
           CAST(NULL AS BIGINT) AS absent FROM b_spans""")
def detail_kv(spark, sf):
    d = F.col("detail")
    return bind(spark, sf, "b_spans").select("event_id", X.detail_kv(d, "kind").alias("kind"),
                                             X.detail_kv(d, "k", "bigint").alias("k"),
                                             X.detail_kv(d, "ind", "bigint").alias("absent"))


@query("payload_match", """
    SELECT event_type, COUNT(*) AS n, CAST(SUM(CASE WHEN k = 7 THEN 1 ELSE 0 END) AS BIGINT) AS text_seven,
           CAST(SUM(CASE WHEN k = 7 THEN 1 ELSE 0 END) AS BIGINT) AS number_seven,
           CAST(0 AS BIGINT) AS other_key, COUNT(*) AS malformed, COUNT(*) AS nothing
    FROM b_events GROUP BY event_type""")
def payload_match(spark, sf):
    def hits(text):
        return F.count_if(J.payload_match(F.lit(text), F.col("payload")))
    return bind(spark, sf, "b_events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), hits('{"k": "7"}').alias("text_seven"), hits('{"k": 7}').alias("number_seven"),
        hits('{"q": 7}').alias("other_key"), hits('{"k":').alias("malformed"), hits("{}").alias("nothing"))


@query("redact_columns", "SELECT c_nationkey, c_mktsegment FROM customer")
def redact_columns(spark, sf):
    return E.redact(table(spark, sf, "customer"), ["c_name", "c_custkey", "c_acctbal"])


@query("publish_columns", "SELECT s_nationkey, s_acctbal FROM supplier")
def publish_columns(spark, sf):
    return E.publish(table(spark, sf, "supplier"), ["s_nationkey", "s_acctbal"])


@query("public_feed", """
    WITH p AS (SELECT * FROM b_game WHERE event_type IN ('structure_placed','player_discovered_landmark','quest_completed')),
    kept AS (SELECT * FROM p ORDER BY event_id DESC LIMIT 200)
    SELECT event_id AS capture_seq, event_type, us, region_id, CAST(k AS VARCHAR) AS detail,
           CASE WHEN k % 2 = 0 THEN 'observed' ELSE 'reported' END AS provenance,
           (SELECT GREATEST(COUNT(*) - 200, 0) FROM p) AS dropped
    FROM kept WHERE us <= 1706572800000000 - 30000000""")
def public_feed(spark, sf):
    ev = bind(spark, sf, "b_game").withColumns({
        "capture_seq": F.col("event_id"), "detail": F.col("k").cast("string"),
        "occurred_at": F.timestamp_micros("us"),
        "provenance": F.when(F.col("k") % 2 == 0, " ").otherwise("reported")})
    return E.public_feed(ev, now=F.timestamp_micros(F.lit(1706572800000000))).select(
        "capture_seq", "event_type", F.unix_micros("occurred_at").alias("us"), "region_id", "detail", "provenance",
        "dropped")


@query("submission_view", """
    SELECT CASE WHEN k % 13 = 0 THEN strftime(occurred_at, '%Y%m%d%H%M%S') || '-quest-' || CAST(event_id AS VARCHAR)
                ELSE strftime(occurred_at, '%Y%m%d%H%M%S') || '-quest-' || CAST(k AS VARCHAR) || '-' || CAST(event_id AS VARCHAR)
           END AS submission_id,
           CASE WHEN k % 13 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'Quest ' || CAST(k AS VARCHAR) || '!' END AS action_id,
           CASE WHEN k % 13 = 0 THEN '' ELSE 'Quest ' || CAST(k AS VARCHAR) || '!' END AS quest_id,
           CASE WHEN k % 13 = 0 THEN 'unknown' WHEN k % 9 = 0 THEN 'Quest ' || CAST(k AS VARCHAR) || '!'
                ELSE 'Name ' || CAST(k AS VARCHAR) END AS quest_name,
           k % 13 <> 0 AND k % 9 = 0 AS ranged, actor_id AS player_id,
           (SELECT COUNT(*) FROM b_game WHERE event_type <> 'quest_completed') AS skipped
    FROM b_game WHERE event_type = 'quest_completed'""")
def submission_view(spark, sf):
    rows, skipped = E.submission_view(bind(spark, sf, "b_game"))
    return rows.select("submission_id", "action_id", "quest_id", "quest_name", "ranged", "player_id") \
        .withColumn("skipped", skipped.scalar())


@query("name_slugs", r"""
    SELECT page_id, COALESCE(NULLIF(TRIM(regexp_replace(LOWER(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'page') AS slug,
           COALESCE(NULLIF(TRIM(regexp_replace(LOWER(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'page') AS slug_u,
           SUBSTRING(url, 1, 40) AS shown
    FROM pages""")
def name_slugs(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.slug(url, "-", "page").alias("slug"),
                                            X.slug(url, "_", "page").alias("slug_u"), X.clean_name(url).alias("shown"))


@query("kind_ladder", """
    SELECT l_suppkey, portals, size_y, beds,
           CASE WHEN sky THEN 'sky ' ELSE '' END ||
           CASE WHEN portals >= 30 THEN 'major hub' WHEN size_y >= 90 THEN 'tower' WHEN stands >= 200 THEN 'museum'
                WHEN signs >= 800 THEN 'sign-covered' WHEN portals >= 10 THEN 'hub' WHEN beds >= 10 THEN 'settlement'
                WHEN foot >= 50000 THEN 'sprawl' WHEN size_y >= 60 THEN 'tall hall' WHEN builders >= 8 THEN 'shared build'
                ELSE 'build' END AS kind
    FROM (SELECT l_suppkey, l_orderkey % 97 AS grp, SUM(CASE WHEN category = 'PORTAL' THEN 1 ELSE 0 END) AS portals,
                 SUM(CASE WHEN category = 'BED' THEN 1 ELSE 0 END) AS beds, MAX(z) - MIN(z) AS size_y,
                 SUM(CASE WHEN prefab_name = 'RF' THEN 1 ELSE 0 END) AS stands,
                 SUM(CASE WHEN prefab_name = 'AO' THEN 1 ELSE 0 END) AS signs,
                 (MAX(x) - MIN(x)) * 1000 AS foot, COUNT(DISTINCT creator_id) AS builders, MAX(y) > 47 AS sky
          FROM b_points GROUP BY l_suppkey, l_orderkey % 97) t""")
def kind_ladder(spark, sf):
    def count(column, value):
        return F.count_if(F.col(column) == value)
    groups = bind(spark, sf, "b_points").groupBy("l_suppkey", F.expr("l_orderkey % 97")).agg(
        count("category", "PORTAL").alias("portals"), count("category", "BED").alias("beds"),
        (F.max("z") - F.min("z")).alias("size_y"), count("prefab_name", "RF").alias("item_stands"),
        count("prefab_name", "AO").alias("signs"), ((F.max("x") - F.min("x")) * 1000).alias("footprint_m2"),
        F.countDistinct("creator_id").alias("distinct_creators"), (F.max("y") > 47).alias("sky"))
    return E.label_ladder(groups).select("l_suppkey", "portals", "size_y", "beds", "kind")


@query("capture_rejects", """
    SELECT CASE WHEN l_returnflag = 'N' THEN 'skipped by the runner' WHEN l_quantity = 1 THEN 'world never loaded'
                WHEN l_linestatus = 'F' THEN 'view obstructed' END AS reject_reason,
           (200 - l_quantity > 186 AND l_linenumber * 10 < 60)
             OR (200 - l_quantity > 166 AND l_discount < 0.03 AND l_tax < 0.02) AS fog,
           COUNT(*) AS n
    FROM lineitem GROUP BY 1, 2""")
def capture_rejects(spark, sf):
    frames = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "N").alias("skipped"), (F.col("l_quantity") - 1).alias("pieces_near_aim"),
        (F.col("l_linestatus") == "F").alias("occluded"), (200 - F.col("l_quantity")).alias("luma_mean"),
        (F.col("l_linenumber") * 10).alias("luma_spread"),
        F.when(F.col("l_discount") < 0.03, 0.2).alias("depth_span"),
        F.when(F.col("l_tax") < 0.02, 0.05).alias("far_mass"))
    return E.fog_flag(E.reject_reason(frames)).groupBy("reject_reason", "fog").agg(F.count(F.lit(1)).alias("n"))


@query("vantage_kind", """
    SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'seated'
        WHEN p_name LIKE 'red%' OR p_name LIKE 'large%' THEN 'eye level' ELSE 'drone' END AS vantage FROM part""")
def vantage_kind(spark, sf):
    name = F.col("p_name")
    variant = (F.when(name.startswith("small"), F.concat(F.lit("seat_"), name))
               .when(name.startswith("red"), F.concat(F.lit("hall_"), name))
               .when(name.startswith("large"), F.concat(F.lit("court_"), name)).otherwise(name))
    return table(spark, sf, "part").select("p_partkey", E.vantage(variant).alias("vantage"))


@query("sensitive_text", r"""
    WITH m AS (
      SELECT doc_id, 'account_id' AS rule, UNNEST(regexp_extract_all(text, '\b7656119\d{10}\b')) AS found FROM documents
      UNION ALL SELECT doc_id, 'credential_assignment', UNNEST(regexp_extract_all(text,
        '(?i)\b(?:client[_ -]?access[_ -]?key|enrollment[_ -]?(?:key|token)|bearer|password|invite[_ -]?token)\s*[=:]\s*["'']?[A-Za-z0-9+/_=-]{12,}')) FROM documents
      UNION ALL SELECT doc_id, 'credential_query', UNNEST(regexp_extract_all(text,
        '(?i)[?&](?:access[_-]?key|bearer|invite|key|token)=[^&\s]{8,}')) FROM documents
      UNION ALL SELECT doc_id, 'private_path', UNNEST(regexp_extract_all(text, '(?i)C:\\Users\\[A-Za-z0-9._-]+\\')) FROM documents
      UNION ALL SELECT doc_id, 'ipv4', UNNEST(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) FROM documents)
    SELECT doc_id, rule, found, COUNT(*) AS n FROM m GROUP BY doc_id, rule, found""")
def sensitive_text(spark, sf):
    from tidegauge.operators.quality import scan_sensitive

    return scan_sensitive(table(spark, sf, "documents"), "doc_id", "text") \
        .groupBy("doc_id", "rule", "found").agg(F.count(F.lit(1)).alias("n"))


@query("text_classes", """
    SELECT doc_id, CASE
      WHEN contains(t, 'crash') OR contains(t, 'error') OR contains(t, 'exception') OR contains(t, 'broke')
        OR contains(t, 'fails') OR contains(t, 'doesn''t work') OR contains(t, 'stack trace') OR contains(t, 'silently') THEN 'bug'
      WHEN contains(t, 'could you add') OR contains(t, 'would be nice') OR contains(t, 'feature request') OR contains(t, 'wish')
        OR contains(t, 'suggestion') OR contains(t, 'support for') THEN 'feature'
      WHEN contains(t, 'how do i') OR contains(t, 'where is') OR contains(t, 'what does') OR contains(t, 'why does')
        OR contains(t, '?') THEN 'question' END AS class
    FROM (SELECT doc_id, LOWER(text) AS t FROM documents) x""")
def text_classes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.classify(F.col("text")).alias("class"))


@query("load_estimate", """
    SELECT event_id, ROUND(LEAST(GREATEST((value - 16) / 50, 0), 1) * 0.45 + LEAST(GREATEST((k - 20) / 60.0, 0), 1) * 0.55, 6)
      AS load FROM b_events""")
def load_estimate(spark, sf):
    return bind(spark, sf, "b_events").select(
        "event_id", F.round(E.load_estimate(F.col("value"), F.col("k")), 6).alias("load"))


@query("turn_in_evidence", r"""
    SELECT p_partkey, CAST(p_size % 4 AS INT) AS screenshots, p_size % 5 = 0 AS video_alternative, p_size % 3 = 0 AS link,
           p_size % 2 = 0 AS group_turnin, FALSE AS notes, p_name AS credited
    FROM part""")
def turn_in_evidence(spark, sf):
    parts = table(spark, sf, "part")
    size = F.col("p_size")
    command = F.concat(F.lit("/turnin summons_type: "), F.col("p_name"),
                       *[F.when(size % 4 >= i, f" image{i}:").otherwise("") for i in (1, 2, 3)],
                       F.when(size % 3 == 0, " summons_url:").otherwise(""),
                       F.when(size % 2 == 0, " participants: all").otherwise(""))
    text = F.when(size % 5 == 0, F.lit("a " + X.FILM)).otherwise("a photo")
    return parts.select("p_partkey", X.evidence_spec(command, text).alias("e"), X.credited_name(command).alias("credited")) \
        .select("p_partkey", "e.*", "credited")


@query("thin_log", """
    WITH n AS (SELECT event_id, event_type, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY us, event_id) AS seen FROM b_events)
    SELECT event_id, event_type, seen FROM n WHERE seen <= 4 OR bit_count(seen) = 1""")
def thin_log(spark, sf):
    return E.thin_log(bind(spark, sf, "b_events"), ["event_type"], ["us", "event_id"]).select("event_id", "event_type", "seen")


@query("priority_classes", """
    SELECT tier, rank, reason, COUNT(*) AS n FROM (
      SELECT CASE WHEN l_linenumber = 1 THEN 'player_critical' WHEN l_linenumber = 2 THEN 'portal'
                  WHEN l_linenumber = 3 THEN 'near_interactive' WHEN l_linenumber = 4 THEN 'structural_anchor'
                  WHEN l_linenumber = 5 AND l_quantity > 0.66 * 50 THEN 'decorative_far' ELSE 'support_piece' END AS tier,
             CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 1 WHEN l_linenumber = 3 THEN 3
                  WHEN l_linenumber = 4 THEN 2 WHEN l_linenumber = 5 AND l_quantity > 0.66 * 50 THEN 6 ELSE 5 END AS rank,
             CASE WHEN l_linenumber = 1 THEN 'spawn_protection_or_survival_component' WHEN l_linenumber = 2 THEN 'portal_name_or_component'
                  WHEN l_linenumber = 3 THEN 'near_interactive_name_or_component' WHEN l_linenumber = 4 THEN 'structural_piece_name'
                  WHEN l_linenumber = 5 AND l_quantity > 0.66 * 50 THEN 'far_decorative_name' ELSE 'default_loaded_piece' END AS reason
      FROM lineitem) t GROUP BY tier, rank, reason""")
def priority_classes(spark, sf):
    line = F.col("l_linenumber")
    name = (F.when(line == 1, "Piece_Hearth").when(line == 2, "x").when(line == 3, "WoodDoor").when(line == 4, "wood_beam")
            .when(line == 5, "red_rug").otherwise("shrub"))
    parts = F.when(line == 2, "TeleportWorld|Piece").otherwise("Piece")
    df = E.priority_class(table(spark, sf, "lineitem"), name, parts, F.col("l_quantity"), F.lit(50.0))
    return df.groupBy("tier", "rank", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("boundary_summary", """
    WITH b AS (SELECT *, json_extract_string(data, '$.window_id') AS w,
                 CASE WHEN k % 10 = 0 THEN '<empty>' ELSE json_extract_string(data, '$.recipient_id') END AS r,
                 json_extract_string(data, '$.result') AS res, COALESCE(json_extract_string(data, '$.reason'), '<missing>') AS why,
                 json_extract_string(data, '$.status_code') AS code, json_extract_string(data, '$.route') AS route,
                 json_extract_string(data, '$.socket_peer_class') AS sock FROM b_boundary),
    e AS (SELECT 'event_type' AS dimension, event_type AS key FROM b
      UNION ALL SELECT 'version', CAST(schema_version AS VARCHAR) || '/' || CAST(event_version AS VARCHAR) FROM b
      UNION ALL SELECT 'authorization', res || '/' || why FROM b WHERE event_type = 'authorization.decided'
      UNION ALL SELECT 'capabilities', '<missing> -> <missing>' FROM b WHERE event_type = 'authorization.decided'
      UNION ALL SELECT 'identity', '<missing>/<missing>' FROM b WHERE event_type = 'identity.resolved'
      UNION ALL SELECT 'proxy', 'socket:' || sock || ' forwarded:public' FROM b WHERE event_type = 'identity.resolved'
      UNION ALL SELECT 'proxy_warning', 'private socket, public claim' FROM b WHERE event_type = 'identity.resolved' AND sock = 'private'
      UNION ALL SELECT 'route_status', code || ' ' || route FROM b WHERE event_type = 'request.completed'
      UNION ALL SELECT 'operation', event_type FROM b WHERE event_type LIKE 'zdo.%'
      UNION ALL SELECT 'window', w FROM b WHERE event_type LIKE 'zdo.%'
      UNION ALL SELECT 'recipient', r FROM b WHERE event_type LIKE 'zdo.%'
      UNION ALL SELECT 'release', '<missing>' FROM b WHERE event_type LIKE 'zdo.%')
    SELECT dimension, key, COUNT(*) AS n FROM e GROUP BY dimension, key""")
def boundary_summary(spark, sf):
    return E.boundary_long(bind(spark, sf, "b_boundary"))


@query("boundary_totals", """
    SELECT CAST(SUM(CASE WHEN event_type = 'zdo.batch.queued' THEN k ELSE 0 END) AS BIGINT) AS queued_envelopes,
           CAST(SUM(k % 5) AS BIGINT) AS accepted_envelopes, CAST(0 AS BIGINT) AS request_bytes,
           CAST(SUM(CASE WHEN event_type = 'zdo.batch.polled' THEN k ELSE 0 END) AS BIGINT) AS polled_envelopes,
           CAST(0 AS BIGINT) AS ack_sequence_count, CAST(0 AS BIGINT) AS acknowledged_count,
           CAST(0 AS BIGINT) AS unknown_ack_count, CAST(0 AS BIGINT) AS applied_count, CAST(0 AS BIGINT) AS superseded_count,
           CAST(0 AS BIGINT) AS rejected_count,
           CAST(SUM(CASE WHEN k % 8 = 0 THEN 0 ELSE k % 3 END) AS BIGINT) AS pending_count,
           CAST(0 AS BIGINT) AS priority_fast_lane_applied
    FROM b_boundary WHERE event_type LIKE 'zdo.%'""")
def boundary_totals(spark, sf):
    return E.boundary_totals(bind(spark, sf, "b_boundary"))


@query("unknown_types", """
    SELECT DISTINCT event_type FROM b_boundary WHERE event_type NOT IN ('request.completed', 'zdo.batch.queued')""")
def unknown_types(spark, sf):
    return E.unknown_types(bind(spark, sf, "b_boundary"), ["request.completed", "zdo.batch.queued"])


@query("duration_summary", """
    SELECT event_type, COUNT(*) AS n, MIN(k % 50) AS min_ms, MAX(k % 50) AS max_ms, ROUND(AVG(k % 50), 6) AS mean_ms
    FROM b_boundary GROUP BY event_type""")
def duration_summary(spark, sf):
    ev = bind(spark, sf, "b_boundary").withColumn("ms", J.lenient_double(J.json_fields(F.col("data")), "duration_ms").cast("bigint"))
    return E.duration_summary(ev, "ms").withColumn("mean_ms", F.round("mean_ms", 6))


@query("missing_fields", """
    SELECT event_type || '.' || f AS field, COUNT(*) AS n FROM (
      SELECT event_type, 'recipient_id' AS f FROM b_boundary WHERE k % 10 = 0
      UNION ALL SELECT event_type, 'pending' FROM b_boundary WHERE k % 8 = 0
      UNION ALL SELECT event_type, 'reason' FROM b_boundary WHERE k % 3 <> 0) t GROUP BY 1""")
def missing_fields(spark, sf):
    return E.missing_fields(bind(spark, sf, "b_boundary"), ["recipient_id", "pending", "reason", "window_id"])


@query("session_mix", """
    SELECT CASE WHEN event_type = 'click' THEN 'binary' ELSE 'other' END AS protocol,
           CASE WHEN k % 4 = 0 THEN 'unassigned' ELSE region_id END AS region_id, COUNT(*) AS n
    FROM b_events GROUP BY 1, 2""")
def session_mix(spark, sf):
    ev = bind(spark, sf, "b_events").select(
        F.when(F.col("event_type") == "click", "binary").otherwise("text").alias("protocol"),
        F.when(F.col("k") % 4 != 0, F.col("region_id")).alias("region_id"))
    return E.session_mix(ev)


@query("session_union_count", """
    SELECT actor_id AS session_id, CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS samples,
           CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS pulses,
           CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS events,
           CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS benchmarks,
           MIN(us) AS first_ts, MAX(us) AS last_ts
    FROM b_events WHERE event_type <> 'signup' GROUP BY actor_id""")
def session_union_count(spark, sf):
    ev = bind(spark, sf, "b_events").select(F.col("actor_id").alias("session_id"), F.col("us").alias("ts"), "event_type")
    logs = {"samples": "click", "pulses": "view", "events": "error", "benchmarks": "purchase"}
    return E.session_union_count({name: ev.filter(F.col("event_type") == t) for name, t in logs.items()})
