"""Queries over telemetry reports, access logs, catalogs and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.operators import quality as Q, rollups as U
from tidegauge.plans.bindings import bind, table
from tidegauge.plans.registry import query


@query("telemetry_report", """
    WITH s AS (SELECT actor_id, us, event_id, value, CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS rtt, ROW_NUMBER() OVER (PARTITION BY actor_id ORDER BY us DESC, event_id DESC) AS n FROM b_events WHERE event_type <> 'error')
    SELECT actor_id, COUNT(*) AS samples, ROUND(AVG(value), 3) AS mean_value, ROUND(AVG(rtt), 3) AS mean_rtt, MAX(CASE WHEN n = 1 THEN value END) AS latest_value, MAX(CASE WHEN n = 1 THEN rtt END) AS latest_rtt,
      COUNT(value) > 0 AS has_value, COUNT(rtt) > 0 AS has_rtt FROM s WHERE n <= 30 GROUP BY actor_id""")
def telemetry_report(spark, sf):
    samples = bind(spark, sf, "b_events").select("actor_id", "us", "event_id", "value", F.when(F.col("k") % 4 != 0, F.col("k")).alias("rtt"),
                                                 (F.col("event_type") != "error").alias("valid"))
    return U.telemetry_report(samples, ["actor_id"], ["us", "event_id"], ["value", "rtt"])


@query("compare_sessions", """
    WITH h AS (SELECT COUNT(*) AS n, ROUND(AVG(value * 40), 3) AS fps, ROUND(AVG(k), 3) AS rtt FROM b_events WHERE guild_id = 1),
    c AS (SELECT COUNT(*) AS n, ROUND(AVG(value), 3) AS fps, CAST(NULL AS DOUBLE) AS rtt FROM b_events WHERE guild_id = 2)
    SELECT h.n AS host_samples, CAST(0 AS BIGINT) AS host_pulses, c.n AS client_samples, (SELECT COUNT(*) FROM b_events WHERE guild_id = 2 AND event_type = 'view') AS client_pulses,
      h.fps AS host_fps, h.rtt AS host_rtt, c.fps AS client_fps, c.rtt AS client_rtt,
      'host bundle has no server pulses; ' || CASE WHEN ABS(h.fps - c.fps) >= 10 THEN 'large delta; ' ELSE '' END || 'client RTT is missing or zero; verify connected multiplayer session' AS findings FROM h, c""")
def compare_sessions(spark, sf):
    ev = bind(spark, sf, "b_events").withColumnRenamed("guild_id", "session_id")
    samples = ev.select("session_id", F.when(F.col("session_id") == 1, F.col("value") * 40).otherwise(F.col("value")).alias("fps"),
                        F.when(F.col("session_id") == 1, F.col("k")).alias("rtt_ms"))
    pulses = ev.filter("event_type = 'view' AND session_id <> 1").select("session_id")
    out = U.compare_sessions(samples, pulses, 1, 2)
    short = F.transform("findings", lambda f: F.when(f.startswith("large average"), "large delta").otherwise(f))
    return out.withColumn("findings", F.array_join(short, "; "))


@query("evidence_checks", """
    SELECT actor_id, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) >= 1 AS joined, SUM(CASE WHEN event_type = 'error' AND k = 7 THEN 1 ELSE 0 END) = 0 AS no_seven,
      SUM(CASE WHEN event_type = 'click' AND k % 10 = 3 THEN 1 ELSE 0 END) = 1 AS one_click, COUNT(DISTINCT region_id) = 1 AS one_region FROM b_events GROUP BY actor_id""")
def evidence_checks(spark, sf):
    kind, k = F.col("event_type"), F.col("k")
    return U.evidence_checks(bind(spark, sf, "b_events"), ["actor_id"], {
        "joined": ("some", kind == "signup"), "no_seven": ("none", (kind == "error") & (k == 7)),
        "one_click": ("once", (kind == "click") & (k % 10 == 3)), "one_region": ("one_value", F.col("region_id"))}).drop("failed", "passed")


ACCESS = """(SELECT event_id AS line, us AS ts, CASE WHEN k % 5 = 0 THEN 401 WHEN k % 7 = 0 THEN 304 ELSE 200 END AS status, CASE WHEN event_type = 'error' THEN '/a.js' ELSE '/' END AS uri,
      CASE WHEN actor_id % 10 = 0 THEN '-' ELSE 'u' || CAST(actor_id % 40 AS VARCHAR) END AS user, '10.0.0.' || CAST(k % 50 AS VARCHAR) AS ip,
      CASE WHEN k % 3 = 0 THEN 'Edge / Desktop' WHEN k % 3 = 1 THEN 'Chrome / Mobile' ELSE 'Safari / Mobile' END AS browser FROM b_events)"""


def _access(spark, sf):
    k = F.col("k")
    agent = F.when(k % 3 == 0, "Mozilla Chrome Safari Edg/1").when(k % 3 == 1, "Mozilla Android Chrome Safari").otherwise("Mozilla iPhone Safari")
    return bind(spark, sf, "b_events").select(
        F.col("event_id").alias("line"), F.col("us").alias("ts"), F.when(k % 5 == 0, 401).when(k % 7 == 0, 304).otherwise(200).alias("status"),
        F.when(F.col("event_type") == "error", "/a.js").otherwise("/").alias("uri"),
        F.when(F.col("actor_id") % 10 != 0, F.concat(F.lit("u"), (F.col("actor_id") % 40).cast("string"))).alias("user_id"),
        F.concat(F.lit("10.0.0."), (k % 50).cast("string")).alias("client_ip"), agent.alias("agent"))


@query("visit_summary", f"SELECT \"user\", COUNT(*) AS visits, MIN_BY(ts, line) AS first_seen, MAX_BY(ts, line) AS last_seen, (SELECT COUNT(*) FROM {ACCESS} b WHERE uri = '/' AND status = 401) AS refused FROM {ACCESS} a WHERE uri = '/' AND status = 200 GROUP BY \"user\"")
def visit_summary(spark, sf):
    users, _, refused = U.visit_summary(_access(spark, sf))
    return users.withColumn("refused", refused.scalar())


@query("visit_values", f"""SELECT "user", 'browser' AS field, browser AS value, COUNT(*) AS n FROM {ACCESS} a WHERE uri = '/' AND status = 200 GROUP BY 1, 3
    UNION ALL SELECT "user", 'client_ip', ip, COUNT(*) FROM {ACCESS} a WHERE uri = '/' AND status = 200 GROUP BY 1, 3""")
def visit_values(spark, sf):
    return U.visit_summary(_access(spark, sf))[1]


@query("recount_check", """
    WITH s AS (SELECT event_type, COUNT(*) + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS stored FROM b_events WHERE event_type <> 'click' GROUP BY 1), c AS (SELECT event_type, COUNT(*) AS counted FROM b_events GROUP BY 1)
    SELECT event_type, stored, counted FROM s FULL JOIN c USING (event_type) WHERE stored IS DISTINCT FROM counted""")
def recount_check(spark, sf):
    ev = bind(spark, sf, "b_events")
    stored = ev.filter("event_type <> 'click'").groupBy("event_type").agg((F.count(F.lit(1)) + F.max((F.col("event_type") == "view").cast("int"))).alias("stored"))
    return U.recount_check(stored, ev)


@query("conservation_check", """
    WITH t AS (SELECT l_suppkey, COUNT(*) AS n, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)
    SELECT l_suppkey, 'eligible_durable_acked' AS rule FROM t WHERE l_suppkey % 4 = 0 UNION ALL SELECT l_suppkey, 'applied_plus_superseded' FROM t WHERE l_suppkey % 3 = 0
    UNION ALL SELECT l_suppkey, 'nothing_pending' FROM t WHERE r % 2 = 1""")
def conservation_check(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    k = F.col("l_suppkey")
    rows = t.select("l_suppkey", F.col("n").alias("eligible"), F.when(k % 4 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("durable"), F.col("n").alias("acked"),
                    (F.col("n") - F.col("r")).alias("applied"), F.when(k % 3 == 0, F.col("r") + 1).otherwise(F.col("r")).alias("superseded"),
                    (F.col("r") % 2).alias("pending"), F.lit(0).alias("native"))
    return U.conservation_check(rows, "l_suppkey")


@query("busiest_window", """
    WITH s AS (SELECT stream, tick, sent, culled, total_ms AS p50, sim_ms + total_ms AS p99, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY sent + culled DESC, tick) AS n FROM b_ticks)
    SELECT stream, tick, sent, culled, p50, p99, CASE WHEN p50 = 0 THEN 0.0 ELSE ROUND(p99 / p50, 2) END AS tail_ratio, (sent + culled) / 100 AS pairs_per_tick, sent / 100 * 20 AS sent_per_s FROM s WHERE n = 1""")
def busiest_window(spark, sf):
    rows = bind(spark, sf, "b_ticks").select("stream", "tick", "sent", "culled", F.col("total_ms").alias("p50"), (F.col("sim_ms") + F.col("total_ms")).alias("p99"))
    return U.busiest_window(rows, ["stream"], "tick")


@query("histogram_buckets", """
    WITH b(bucket, lo, hi) AS (VALUES (0, -1, 5), (1, 5, 10), (2, 10, 25), (3, 25, 50), (4, 50, 75), (5, 75, 100), (6, 100, 150), (7, 150, 200), (8, 200, 300), (9, 300, 500), (10, 500, NULL))
    SELECT bucket, COUNT(*) AS n, CAST(hi AS DOUBLE) AS upper FROM b_events JOIN b ON value > lo AND (hi IS NULL OR value <= hi) GROUP BY bucket, hi""")
def histogram_buckets(spark, sf):
    return U.histogram_buckets(bind(spark, sf, "b_events"), "value")


CAPABILITY = """(SELECT p_partkey AS "row", p_name AS signature, p_type AS category, p_name AS method, p_brand AS profile_brand, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'maybe' ELSE 'yes' END AS usability FROM part)"""


def _capability(spark, sf):
    size = F.col("p_size") % 3
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("signature"), F.col("p_type").alias("category"), F.col("p_name").alias("method"),
                                           F.col("p_brand").alias("profile_brand"), F.when(size == 0, "none").when(size == 1, "maybe").otherwise("yes").alias("usability"))


RANKS = {"none": 0, "maybe": 1, "yes": 2}


@query("capability_rollup", f"""
    SELECT signature, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, COUNT(*) AS rows, MIN("row") AS first_row,
      CASE MAX(CASE usability WHEN 'none' THEN 0 WHEN 'maybe' THEN 1 ELSE 2 END) WHEN 0 THEN 'none' WHEN 1 THEN 'maybe' ELSE 'yes' END AS usability FROM {CAPABILITY} c GROUP BY signature""")
def capability_rollup(spark, sf):
    return U.capability_rollup(_capability(spark, sf), "signature", ["method"], RANKS)[0].withColumn("categories", F.array_join("categories", ","))


@query("capability_conflicts", f"SELECT signature, 'profile_brand' AS field FROM {CAPABILITY} c GROUP BY signature HAVING COUNT(DISTINCT profile_brand) > 1")
def capability_conflicts(spark, sf):
    return U.capability_rollup(_capability(spark, sf), "signature", ["method", "profile_brand"], RANKS)[1]


@query("capability_rows", f"SELECT signature, \"row\", ROW_NUMBER() OVER (PARTITION BY signature ORDER BY \"row\") AS n FROM {CAPABILITY} c")
def capability_rows(spark, sf):
    return U.capability_rows(_capability(spark, sf), "signature").withColumn("n", F.col("n").cast("bigint"))


@query("verdict_rollup", """
    WITH g AS (SELECT p_brand, p_size % 10 AS slot, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) FILTER (p_size > 45) AS ev, BOOL_OR(p_size > 20) AS enabled FROM part GROUP BY 1, 2)
    SELECT p_brand, slot, CASE WHEN ev IS NOT NULL THEN 'bindable: ' || ev WHEN enabled THEN 'diagnostic only — never bindable' ELSE 'intentionally disabled' END AS verdict FROM g""")
def verdict_rollup(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 10).alias("slot"), F.col("p_type").alias("event"), (F.col("p_size") > 45).alias("safe"),
                                           F.when(F.col("p_size") > 20, "diagnostic").otherwise("disabled").alias("profile"))
    keyed = rows.withColumn("key", F.struct("p_brand", "slot"))
    return U.verdict_rollup(keyed, "key").select("key.p_brand", "key.slot", "verdict")


@query("fate_tally", "SELECT CASE WHEN p_size % 3 = 0 THEN 'skipped' WHEN p_size % 3 = 1 THEN 'emitted' ELSE 'merged' END AS outcome, COUNT(*) AS n FROM part GROUP BY 1")
def fate_tally(spark, sf):
    return _fates(spark, sf)[0]


def _fates(spark, sf):
    size = F.col("p_size") % 3
    fates = table(spark, sf, "part").select(F.col("p_partkey").alias("quest_id"), F.when(size == 0, "skipped").when(size == 1, "emitted").otherwise("merged").alias("outcome"))
    entries = table(spark, sf, "part").filter("p_size % 6 = 1 OR p_size % 6 = 2").select(F.col("p_partkey").alias("quest_id"))
    return U.fate_tally(fates, entries)


@query("fate_mismatches", """
    SELECT p_partkey AS quest_id, CASE WHEN p_size % 3 = 1 THEN 'emitted_without_entry' ELSE 'entry_without_row' END AS rule FROM part
    WHERE (p_size % 3 = 1) <> (p_size % 6 = 1 OR p_size % 6 = 2)""")
def fate_mismatches(spark, sf):
    return _fates(spark, sf)[1]


@query("task_counts", """
    SELECT o_orderpriority AS tool, COUNT(*) AS present, CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END) AS BIGINT) AS actionable, CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS blocked
    FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def task_counts(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tool"), F.when(F.col("o_orderstatus") == "P", "blocked").otherwise("open").alias("state"))
    return U.task_counts(tasks)


@query("status_tally", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def status_tally(spark, sf):
    return U.status_tally(table(spark, sf, "orders"), "o_orderstatus")


def _mark(text: str) -> str:
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


LINE_COLUMNS = [*[f"CAST({c} AS VARCHAR)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                *[f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
                "l_returnflag", "l_linestatus", "CAST(epoch_us(l_shipdate) AS VARCHAR)"]


@query("table_fingerprint", f"""
    WITH h AS (SELECT CAST('0x' || substr(md5({' || '.join(map(_mark, LINE_COLUMNS))}), 1, 15) AS BIGINT) AS h FROM lineitem)
    SELECT COUNT(*) AS rows, bit_xor(h) AS xor, CAST(SUM(h % 1000003) AS BIGINT) AS sum FROM h""")
def table_fingerprint(spark, sf):
    return U.table_fingerprint(table(spark, sf, "lineitem"))


@query("part_digests", """
    SELECT doc_id, sha256(CAST(strlen(lang) AS VARCHAR) || ':' || lang || CAST(strlen(source) AS VARCHAR) || ':' || source || CAST(strlen(text) AS VARCHAR) || ':' || text) AS digest FROM documents""")
def part_digests(spark, sf):
    return U.part_digests(table(spark, sf, "documents"), "doc_id", ["lang", "source", "text"])


@query("facets", "SELECT 'lang' AS field, lang AS value, COUNT(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, COUNT(*) FROM documents WHERE source IS NOT NULL GROUP BY 2")
def facets(spark, sf):
    return U.facets(table(spark, sf, "documents"), ["lang", "source"])


@query("joined_counts", "SELECT COUNT(l.doc_id) AS joined, COUNT(*) - COUNT(l.doc_id) AS unjoined FROM documents d LEFT JOIN labels l USING (doc_id)")
def joined_counts(spark, sf):
    return U.joined_counts(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("decision_counts", """
    WITH e AS (SELECT guild_id AS window_id, k % 4 = 0 AS accept, k % 4 = 0 AND k % 3 = 0 AND guild_id <> 4 AS steady, CASE WHEN k % 4 <> 0 THEN 'check' || CAST(k % 5 AS VARCHAR) END AS failed FROM b_events),
    g AS (SELECT window_id, CAST(SUM(CASE WHEN accept THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(SUM(CASE WHEN accept THEN 0 ELSE 1 END) AS BIGINT) AS rejected, CAST(SUM(CASE WHEN steady THEN 1 ELSE 0 END) AS BIGINT) AS steady,
      string_agg(DISTINCT failed, ',' ORDER BY failed) FILTER (failed IN ('check0', 'check1', 'check2')) AS seen FROM e GROUP BY 1)
    SELECT window_id, accepted, rejected, steady, COALESCE(seen, '') AS seen, CASE WHEN steady >= 1 AND seen = 'check0,check1,check2' THEN 'handshake_satisfied' WHEN steady >= 1 THEN 'accept_only' WHEN rejected > 0 THEN 'reject_only' ELSE 'pending' END AS verdict FROM g""")
def decision_counts(spark, sf):
    k = F.col("k")
    ex = bind(spark, sf, "b_events").select(F.col("guild_id").alias("window_id"), (k % 4 == 0).alias("accept"), ((k % 4 == 0) & (k % 3 == 0) & (F.col("guild_id") != 4)).alias("steady"),
                                            F.when(k % 4 != 0, F.concat(F.lit("check"), (k % 5).cast("string"))).alias("failed_check"))
    return U.decision_counts(ex, ["check0", "check1", "check2"]).select("window_id", "accepted", "rejected", "steady", F.array_join("seen", ",").alias("seen"), "verdict")


@query("thread_bullets", """
    WITH n AS (SELECT conv_id * 100 + turn AS line, CASE WHEN role = 'system' THEN 'Unspecified' ELSE 'm' || CAST(conv_id % 7 AS VARCHAR) END AS milestone, trim(role) AS summary,
      trim(COALESCE(NULLIF(regexp_extract(trim(text), '(?s)^(.*?[.!?])(?:\\s|$)', 1), ''), trim(text))) AS impact FROM conversations)
    SELECT milestone, MIN(line) OVER (PARTITION BY milestone) AS group_line, line, CASE WHEN impact <> '' THEN '**' || summary || '** — ' || impact ELSE summary END AS bullet FROM n""")
def thread_bullets(spark, sf):
    notes = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("line"), F.col("conv_id").alias("id"), F.col("role").alias("summary"), F.col("text").alias("impact"),
        F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string")))).alias("milestones"))
    return U.thread_bullets(notes).drop("id")


@query("validate_rules", """
    SELECT 'title_required' AS rule, CAST(doc_id AS VARCHAR) AS key, 'text must not be blank' AS message FROM documents WHERE TRIM(text) = ''
    UNION ALL SELECT 'size_range', CAST(doc_id AS VARCHAR), 'size out of range' FROM documents WHERE n_chars > 2000
    UNION ALL SELECT 'slug_source', CAST(doc_id AS VARCHAR), 'source is not a slug' FROM documents WHERE NOT regexp_matches(source, '^[a-z][a-z0-9-]*$') OR source IS NULL""")
def validate_rules(spark, sf):
    return Q.validate_rules(table(spark, sf, "documents"), "doc_id", {
        "title_required": (Q.has_text("text"), "text must not be blank"), "size_range": (F.col("n_chars").between(0, 2000), "size out of range"),
        "slug_source": (F.col("source").rlike(Q.SLUG), "source is not a slug")})


@query("duplicate_keys", "SELECT 'duplicate_key' AS rule, p_name AS key, 'used ' || CAST(COUNT(*) AS VARCHAR) || ' times' AS message FROM part GROUP BY p_name HAVING COUNT(*) > 1")
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "part"), "p_name")


@query("unknown_references", """
    SELECT 'unknown_reference' AS rule, CAST(l_suppkey AS VARCHAR) AS key, CAST(v AS VARCHAR) AS message FROM (SELECT l_suppkey, UNNEST([l_partkey, l_partkey + 10]) AS v FROM lineitem) x WHERE v NOT IN (SELECT p_partkey FROM part)""")
def unknown_references(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.array("l_partkey", F.col("l_partkey") + 10).alias("refs"))
    return Q.unknown_references(rows, "l_suppkey", "refs", table(spark, sf, "part"), "p_partkey")


@query("dictionary_join", "SELECT d.doc_id, l.quality IS NULL AS missing, COALESCE(CAST(l.quality AS VARCHAR), '*(no draft)*') AS note FROM documents d LEFT JOIN labels l USING (doc_id)")
def dictionary_join(spark, sf):
    notes = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("note"))
    return Q.dictionary_join(table(spark, sf, "documents").select("doc_id"), notes, "doc_id", "note")


def _coverage(spark, sf):
    facts = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    rules = table(spark, sf, "customer").select((F.col("c_custkey") + 30).alias("key"), "c_mktsegment")
    return Q.policy_coverage(facts, rules, "key")


@query("policy_rows", "SELECT o_custkey AS key, o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey + 30 = o_custkey")
def policy_rows(spark, sf):
    return _coverage(spark, sf)[0]


@query("policy_drift", """
    SELECT DISTINCT o_custkey AS key, 'missing' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + 30 FROM customer)
    UNION ALL SELECT c_custkey + 30, 'extra' FROM customer WHERE c_custkey + 30 NOT IN (SELECT o_custkey FROM orders)""")
def policy_drift(spark, sf):
    _, missing, extra = _coverage(spark, sf)
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


@query("append_new", """
    SELECT k, event_id, us FROM (SELECT actor_id * 1000 + k AS k, event_id, us, ROW_NUMBER() OVER (PARTITION BY actor_id * 1000 + k ORDER BY event_id) AS n FROM b_events WHERE us >= 1705276800000000) b
    WHERE n = 1 AND k NOT IN (SELECT actor_id * 1000 + k FROM b_events WHERE us < 1705276800000000)""")
def append_new(spark, sf):
    ev = bind(spark, sf, "b_events").select((F.col("actor_id") * 1000 + F.col("k")).alias("k"), "event_id", "us")
    cut = 1705276800000000
    return Q.append_new(ev.filter(F.col("us") >= cut), ev.filter(F.col("us") < cut), "k", "event_id")


@query("missing_actions", """
    SELECT a.run_id, a.action_id FROM (SELECT DISTINCT run_id, action_id || CAST(k % 3 AS VARCHAR) AS action_id FROM b_spans) a WHERE NOT EXISTS
      (SELECT 1 FROM b_spans r WHERE r.run_id = a.run_id AND r.action_id || CAST(r.k % 3 AS VARCHAR) = a.action_id AND r.state = 'completed')""")
def missing_actions(spark, sf):
    rows = bind(spark, sf, "b_spans").withColumn("action_id", F.concat("action_id", (F.col("k") % 3).cast("string")))
    return Q.missing_actions(rows.select("run_id", "action_id").distinct(), rows, ["run_id", "action_id"])


@query("tags_overlap", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 4 IN (0, 1)")
def tags_overlap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"), F.concat(F.lit("k"), (F.col("doc_id") % 4).cast("string")).alias("kind"))
    return Q.tags_overlap(docs, "tags", ["en", "fr"], "kind", ["k0", "k1"]).select("doc_id")


@query("tag_lookup", """
    WITH p AS (SELECT doc_id AS post_id, doc_id % 5 AS t1, 3 + doc_id % 4 AS t2, doc_id % 9 = 0 AS blank FROM documents),
    n AS (SELECT *, CASE WHEN t1 <= 1 THEN 1 ELSE 0 END AS aud, CASE WHEN t1 IN (2, 3) THEN 1 ELSE 0 END + CASE WHEN t2 = 3 THEN 1 ELSE 0 END AS fmt FROM p)
    SELECT post_id, CASE WHEN fmt = 1 THEN CASE WHEN t1 = 2 THEN 'essay' ELSE 'note' END END AS format, NOT blank AND aud > 0 AND fmt = 1 AS publishable,
      CAST(blank AS INT) + CASE WHEN aud = 0 THEN 1 ELSE 0 END + CASE WHEN fmt <> 1 THEN 1 ELSE 0 END AS reasons FROM n""")
def tag_lookup(spark, sf):
    key = F.col("doc_id")
    posts = table(spark, sf, "documents").select(key.alias("post_id"), F.when(key % 9 == 0, " ").otherwise("text").alias("content"), F.lit(0).alias("attachments"),
                                                 F.array((key % 5).cast("int"), (3 + key % 4).cast("int")).alias("tag_ids"))
    out = Q.tag_lookup(posts, {0: "Builders", 1: "Keepers", 2: "essay", 3: "note"}, {"Builders": "builder", "Keepers": "keeper"}, ["essay", "note"])
    return out.select("post_id", "format", "publishable", F.size("reasons").alias("reasons"))


@query("trigger_match", """
    SELECT quest_id, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids FROM b_events JOIN (VALUES ('q1', 'click', 0, 10), ('q2', 'view', 10, 20), ('q3', 'purchase', 0, 99)) q(quest_id, ev, lo, hi)
      ON event_type = ev WHERE (quest_id = 'q1' AND k % 3 < 2 AND region_id = 'region-1') OR (quest_id = 'q2' AND k % 2 = 0) OR (quest_id = 'q3' AND actor_id % 2 = 0) GROUP BY quest_id""")
def trigger_match(spark, sf):
    from tidegauge.runtime import literal_rows

    k = F.col("k")
    events = bind(spark, sf, "b_events").select(
        "event_id", F.initcap("event_type").alias("event_name"), F.when(k % 3 == 0, "Troll(Clone)").when(k % 3 == 1, "Greydwarf").otherwise("Boar").alias("target"),
        F.when(F.col("actor_id") % 2 == 0, "Bows").otherwise("Swords").alias("weapon_skill"), (k % 2 == 0).alias("projectile"),
        F.create_map(F.lit("region"), F.upper("region_id")).alias("fields"))
    quests = literal_rows(spark, [("q1", "click", "troll_or_dwarf", "", False, {"region": "region-1"}), ("q2", "look", "any", None, True, None), ("q3", "purchase", "", "bows", False, {"region": "any"})],
                          "quest_id string, trigger_event string, trigger_target string, trigger_weapon string, trigger_projectile boolean, trigger_where map<string,string>")
    return Q.trigger_match(events, quests, {"look": "view"}).groupBy("quest_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("two_side_attribution", """
    WITH m AS (SELECT o_custkey AS pair_id, o_orderkey % 2 AS machine, BOOL_OR(o_totalprice > 450000) AS last_role, COUNT(*) AS last_samples, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS applied,
        SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS checks, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS over FROM orders GROUP BY 1, 2),
    p AS (SELECT pair_id, COUNT(*) AS sides, SUM(CASE WHEN last_role THEN 1 ELSE 0 END) AS a, MAX(CASE WHEN last_role THEN machine END) AS am, MAX(CASE WHEN NOT last_role THEN machine END) AS om,
        MAX(CASE WHEN last_role THEN last_samples END) AS asmp, MAX(CASE WHEN NOT last_role THEN last_samples END) AS osmp, MAX(CASE WHEN last_role THEN applied END) AS aapp, MAX(CASE WHEN last_role THEN checks END) AS achk,
        MAX(CASE WHEN last_role THEN over END) AS aover, MAX(CASE WHEN NOT last_role THEN applied + checks + over END) AS osum FROM m GROUP BY 1),
    v AS (SELECT *, CASE WHEN sides < 2 THEN 'bundle_analysis_incomplete' WHEN a <> 1 THEN 'missing_or_ambiguous_apply_roles' WHEN asmp < 2 OR osmp < 2 THEN 'insufficient_final_role_segment'
        WHEN osum > 0 THEN 'observe_role_advanced_apply_counters' WHEN aapp <= 0 OR achk <= 0 THEN 'apply_role_has_no_measurable_apply_window' WHEN aover > 0 THEN 'apply_only_large_interframe_displacement_observed'
        ELSE 'apply_only_no_large_interframe_displacement_observed' END AS verdict FROM p)
    SELECT pair_id, CASE WHEN verdict = 'bundle_analysis_incomplete' THEN 'unavailable' WHEN verdict = 'observe_role_advanced_apply_counters' THEN 'contradictory' WHEN verdict LIKE 'apply_only%' THEN 'ready' ELSE 'inconclusive' END AS status,
      verdict, CASE WHEN sides = 2 AND a = 1 THEN am END AS apply_machine, CASE WHEN sides = 2 AND a = 1 THEN om END AS observe_machine FROM v""")
def two_side_attribution(spark, sf):
    status = F.col("o_orderstatus")
    sides = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pair_id"), (F.col("o_orderkey") % 2).alias("machine")).agg(
        F.bool_or(F.col("o_totalprice") > 450000).alias("last_role"), F.count(F.lit(1)).alias("last_samples"), F.count_if(status == "F").alias("applied"),
        F.count_if(status == "P").alias("checks"), F.count_if(status == "O").alias("over"))
    return Q.two_side_attribution(sides)


@query("catalog_anomalies", """
    WITH q AS (SELECT p_partkey AS row, p_name AS quest_id, p_brand || p_name AS name, p_size, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'plain' ELSE CASE WHEN p_size % 5 = 2 THEN p_name ELSE p_brand || p_name END END AS credited FROM part),
    l AS (SELECT *, LAG(name) OVER (PARTITION BY quest_id ORDER BY row) AS before, CASE WHEN p_size % 5 > 1 THEN FIRST_VALUE(name) OVER (PARTITION BY p_size % 5 > 1, credited ORDER BY row) END AS owner FROM q)
    SELECT 'duplicate_id' AS kind, row, quest_id, 'collides with ' || before AS message FROM l WHERE before IS NOT NULL
    UNION ALL SELECT 'missing_name_param', row, quest_id, 'no parameter names what is turned in' FROM l WHERE p_size % 5 = 1
    UNION ALL SELECT 'duplicate_credit', row, quest_id, 'also credited by ' || owner FROM l WHERE p_size % 5 > 1 AND owner <> name
    UNION ALL SELECT 'credit_mismatch', row, quest_id, 'credits ' || credited FROM l WHERE p_size % 5 = 2
    UNION ALL SELECT 'evidence_mismatch', row, quest_id, 'camera marks 2, image slots 1' FROM l WHERE p_size % 5 > 1 AND p_size % 7 = 0
    UNION ALL SELECT 'evidence_mismatch', row, quest_id, 'link mark without a url slot' FROM l WHERE p_size % 11 = 0""")
def catalog_anomalies(spark, sf):
    size = F.col("p_size")
    credited = F.when(size % 5 == 2, F.col("p_name")).otherwise(F.concat("p_brand", "p_name"))
    command = F.when(size % 5 == 1, "plain").when(size % 5 > 1, F.concat(F.lit("/t summons_type: "), credited, F.lit(" image1:")))
    text = F.concat(F.when(size % 7 == 0, X.CAMERA * 2).otherwise(""), F.when(size % 11 == 0, X.LINK).otherwise(""))
    quests = table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("quest_id"), F.concat("p_brand", "p_name").alias("name"), text.alias("requirements"),
                                             command.alias("bot_command"), F.lit(None).cast("string").alias("evidence_note"), F.lit(False).alias("auto_checked"))
    return Q.catalog_anomalies(quests)


@query("manifest_objects", """
    SELECT event_id, CAST(pos AS INT) AS pos, CASE WHEN pos = 0 THEN 'key-' || CAST(k AS VARCHAR) ELSE 'unknown@' || CAST(k AS VARCHAR) || '.5,0,0' END AS object_key, CASE WHEN pos = 0 THEN 'portal' ELSE 'decorative_far' END AS tier,
      CASE WHEN pos = 0 THEN CAST(k % 7 AS INT) ELSE 2147483647 END AS rank, 'stop-1' AS route_stop_id FROM b_events, (VALUES (0), (1)) v(pos) WHERE event_type = 'click' AND k % 2 = 0""")
def manifest_objects(spark, sf):
    k = F.col("k").cast("string")
    payload = F.concat(F.when(F.col("k") % 2 == 0, '{"manifest_id": "M-One"').otherwise('{"manifest_id": "other"'), F.lit(', "route_stop_id": "stop-1", "records": [{"object_stable_key": "key-'), k,
                       F.lit('", "priority_tier": "portal", "priority_rank": '), (F.col("k") % 7).cast("string"), F.lit('}, {"object_x": '), k, F.lit('.5}]}'))
    events = bind(spark, sf, "b_events").filter("event_type = 'click'").select("event_id", F.lit("priority_manifest").alias("event_type"), payload.alias("payload"))
    return Q.manifest_objects(events, "m-one").select("event_id", "pos", "object_key", "tier", "rank", "route_stop_id")
