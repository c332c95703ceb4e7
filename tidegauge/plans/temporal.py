"""Queries over ordered rows: sessions, spans, as-of joins, counters, lifecycles, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import temporal as T
from tidegauge.operators.ordered import group_quantiles
from tidegauge.plans.bindings import bind
from tidegauge.plans.registry import query

HOUR = 3_600_000_000

BURSTS = """r AS (SELECT actor_id, us, event_id, k, value FROM b_events WHERE event_type = 'error'),
    f AS (SELECT *, CASE WHEN us - LAG(us) OVER w <= 43200000000 THEN 0 ELSE 1 END AS first FROM r WINDOW w AS (PARTITION BY actor_id ORDER BY us, event_id)),
    bursts AS (SELECT *, CAST(SUM(first) OVER (PARTITION BY actor_id ORDER BY us, event_id) AS BIGINT) AS burst FROM f)"""


def _bursts(spark, sf):
    rows = bind(spark, sf, "b_events").filter("event_type = 'error'").select("actor_id", "us", "event_id", "k", "value")
    return T.burst_sessions(rows, ["actor_id"], "us", ["event_id"], 12 * HOUR)


@query("burst_sessions", f"WITH {BURSTS} SELECT actor_id, event_id, burst FROM bursts")
def burst_sessions(spark, sf):
    return _bursts(spark, sf).select("actor_id", "event_id", "burst")


@query("span_bursts", f"""
    WITH {BURSTS} SELECT actor_id, burst, MIN(us) AS start, MAX(us) - MIN(us) AS span, COUNT(*) AS rows, COUNT(DISTINCT k) AS sequences,
      COUNT(DISTINCT k) = 1 AS single_sequence, ROUND(MAX(k) / 1000.0, 1) AS error_max_m FROM bursts GROUP BY actor_id, burst""")
def span_bursts(spark, sf):
    return T.span_bursts(_bursts(spark, sf), ["actor_id"], "us", "k", "k")


SPANS = """rel AS (SELECT *, LAG(state) OVER w AS s0, LAG(us) OVER w AS start, LAG(detail) OVER w AS d0 FROM b_spans
      WHERE state IN ('action_started', 'completed', 'failed') WINDOW w AS (PARTITION BY run_id, action_id ORDER BY us, event_id)),
    spans AS (SELECT run_id, action_id, start, us AS "end", 'view' AS kind, event_id AS end_event_id FROM rel
      WHERE state <> 'action_started' AND s0 = 'action_started')"""


@query("action_spans", f"WITH {SPANS} SELECT * FROM spans")
def action_spans(spark, sf):
    return T.action_spans(bind(spark, sf, "b_spans"))


def _located(spark, sf, shift: int = 0):
    rows = bind(spark, sf, "b_spans")
    spans = T.action_spans(rows).withColumnRenamed("end_event_id", "span_no")
    if shift:
        spans = spans.withColumn("run_id", F.col("run_id") + shift)
    return T.attribute_interval(rows, spans, grace=2 * HOUR)


def _located_sql(shift: int) -> str:
    return f"""(SELECT e.run_id, e.event_id, e.us, s.action_id, s.kind, COALESCE(s.relation, 'outside') AS relation FROM b_spans e LEFT JOIN (
      SELECT * FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY relation, CASE WHEN relation = 'inside' THEN 0 ELSE -"end" END, end_event_id) AS k
        FROM (SELECT e.event_id, s.action_id, s.kind, s."end", s.end_event_id, CASE WHEN e.us BETWEEN s.start AND s."end" THEN 'inside' ELSE 'just_after' END AS relation
          FROM b_spans e JOIN spans s ON e.run_id = s.run_id + {shift} AND e.us BETWEEN s.start AND s."end" + 7200000000) c) r WHERE k = 1) s
      ON s.event_id = e.event_id)"""


@query("attribute_interval", f"WITH {SPANS} SELECT * FROM {_located_sql(0)} l")
def attribute_interval(spark, sf):
    return _located(spark, sf)


@query("unexplained", f"""
    WITH {SPANS}, own AS (SELECT * FROM {_located_sql(0)} l), peer AS (SELECT * FROM {_located_sql(1)} l)
    SELECT o.event_id, o.relation, p.relation AS peer_relation, o.kind IS NULL AND p.kind IS NULL AS unexplained
    FROM own o JOIN peer p ON o.event_id = p.event_id""")
def unexplained(spark, sf):
    both = T.unexplained(_located(spark, sf), _located(spark, sf, 1), ["view"])
    return both.select("event_id", "relation", "peer_relation", "unexplained")


@query("first_after", """
    SELECT e.run_id, e.event_id, e.us, n.us - e.us AS delay, n.state FROM (SELECT * FROM b_spans WHERE state = 'signup') e LEFT JOIN LATERAL (
      SELECT us, state FROM b_spans n WHERE n.run_id = e.run_id AND n.us > e.us AND n.state IN ('completed', 'failed') ORDER BY us, event_id LIMIT 1) n ON TRUE""")
def first_after(spark, sf):
    rows = bind(spark, sf, "b_spans")
    return T.first_after(rows.filter("state = 'signup'"), rows.filter("state IN ('completed', 'failed')"), ["run_id"], "us", "event_id")


@query("attribute_share", """
    WITH h AS (SELECT event_id AS hitch_id, us AS at, CAST(FLOOR(value) AS BIGINT) * 60000000 AS frame_us FROM b_events WHERE event_type = 'error'),
    s AS (SELECT event_id AS line, us AS at, k * 30000000 AS elapsed_us, event_type AS section FROM b_events WHERE event_type <> 'error'),
    m AS (SELECT hitch_id, line, section, elapsed_us, ROW_NUMBER() OVER (PARTITION BY hitch_id ORDER BY line) AS n FROM h JOIN s
      ON s.at BETWEEN h.at - frame_us - 250000 AND h.at + 50000 AND elapsed_us >= 0.5 * frame_us)
    SELECT 1 AS session, hitch_id, line, section, elapsed_us FROM m WHERE n = 1""")
def attribute_share(spark, sf):
    ev = bind(spark, sf, "b_events").withColumn("session", F.lit(1))
    hitches = ev.filter("event_type = 'error'").select("session", F.col("event_id").alias("hitch_id"), F.col("us").alias("at"),
                                                       (F.floor("value") * 60_000_000).alias("frame_us"))
    sections = ev.filter("event_type <> 'error'").select("session", F.col("event_id").alias("line"), F.col("us").alias("at"),
                                                         (F.col("k") * 30_000_000).alias("elapsed_us"), F.col("event_type").alias("section"))
    return T.attribute_share(hitches, sections, ["session"])


SENDS = """sends AS (SELECT actor_id, us, ROW_NUMBER() OVER (PARTITION BY actor_id ORDER BY us, event_id) AS seq FROM b_events WHERE event_type = 'click'),
    acks AS (SELECT actor_id, us, ROW_NUMBER() OVER (PARTITION BY actor_id ORDER BY us, event_id) AS seq FROM b_events WHERE event_type = 'view')"""


def _sends(spark, sf):
    from tidegauge.operators.ordered import ordered, position

    ev = bind(spark, sf, "b_events").select("actor_id", "us", "event_id", "event_type")
    def numbered(kind):
        rows = ev.filter(F.col("event_type") == kind)
        return ordered(rows, ["actor_id"], ["us", "event_id"]).scan(seq=position()).df.select("actor_id", "us", "seq")
    return numbered("click"), numbered("view")


@query("ack_cover", f"""
    WITH {SENDS} SELECT actor_id, seq, us, (SELECT MIN(a.us) FROM acks a WHERE a.actor_id = s.actor_id AND a.seq >= s.seq) AS first_cover,
      EXISTS (SELECT 1 FROM acks a WHERE a.actor_id = s.actor_id AND a.seq >= s.seq AND a.us <= s.us + 86400000000) AS delivered FROM sends s""")
def ack_cover(spark, sf):
    return T.ack_cover(*_sends(spark, sf), ["actor_id"], 24 * HOUR)


@query("rtt_match", f"WITH {SENDS} SELECT s.actor_id, s.seq, MIN(a.us) - s.us AS rtt_us FROM sends s JOIN acks a USING (actor_id, seq) GROUP BY s.actor_id, s.seq, s.us")
def rtt_match(spark, sf):
    return T.rtt_match(*_sends(spark, sf), ["actor_id"])


@query("role_segments", """
    WITH r AS (SELECT *, LAG(is_apply) OVER w AS o, LEAD(is_apply) OVER w AS x FROM b_counters WHERE is_apply IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY sample)),
    s AS (SELECT *, SUM(CASE WHEN o <> is_apply THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sample) AS changes,
        SUM(CASE WHEN x <> is_apply THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sample DESC) AS from_end FROM r),
    t AS (SELECT run_id, sample, received, is_apply, us, received - LAG(received) OVER (PARTITION BY run_id ORDER BY sample) AS d FROM s WHERE from_end = 0),
    g AS (SELECT run_id, CAST(COUNT(*) AS BIGINT) AS last_samples, MIN(sample) AS last_first, MAX(sample) AS last_last,
        CAST(SUM(CASE WHEN d IS NULL THEN 0 WHEN d < 0 THEN received ELSE d END) AS BIGINT) AS received_delta,
        CAST(SUM(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS received_resets, BOOL_OR(is_apply) AS last_role FROM t GROUP BY run_id)
    SELECT run_id, role_samples, transitions, last_role, last_samples, last_first, last_last, received_delta, received_resets, last_samples >= 2 AS ready
    FROM (SELECT run_id, COUNT(*) AS role_samples, CAST(MAX(changes) AS BIGINT) AS transitions FROM s GROUP BY run_id) b JOIN g USING (run_id)""")
def role_segments(spark, sf):
    return T.role_summary(bind(spark, sf, "b_counters"), "run_id", ["sample"], "is_apply", ["received"])


@query("since_last_marker", """
    SELECT log_id, line_no, event FROM b_lifecycle l WHERE line_no >= COALESCE((SELECT MAX(line_no) FROM b_lifecycle m WHERE m.log_id = l.log_id AND m.event = 'start'), -1)""")
def since_last_marker(spark, sf):
    rows = bind(spark, sf, "b_lifecycle")
    return T.since_last_marker(rows, ["log_id"], "line_no", F.col("event") == "start").select("log_id", "line_no", "event")


@query("latest_per_key", """
    SELECT actor_id, event_type, event_id, us, superseded FROM (SELECT actor_id, event_type, event_id, us, COUNT(*) OVER (PARTITION BY actor_id, event_type) - 1 AS superseded,
      ROW_NUMBER() OVER (PARTITION BY actor_id, event_type ORDER BY us DESC, event_id DESC) AS n FROM b_events) t WHERE n = 1""")
def latest_per_key(spark, sf):
    ev = bind(spark, sf, "b_events").select("actor_id", "event_type", "event_id", "us")
    return T.latest_per_key(ev, ["actor_id", "event_type"], ["us", "event_id"])


@query("monotone_check", """
    WITH r AS (SELECT l_suppkey, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS line,
        epoch_us(l_shipdate) AS t, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
    b AS (SELECT *, LAG(t) OVER (PARTITION BY l_suppkey ORDER BY line) AS before FROM r)
    SELECT l_suppkey, 'time_went_back' AS rule, CAST(id AS VARCHAR) AS key FROM b WHERE t < before
    UNION ALL SELECT l_suppkey, 'duplicate_id', CAST(id AS VARCHAR) FROM r GROUP BY l_suppkey, id HAVING COUNT(*) > 1""")
def monotone_check(spark, sf):
    from tidegauge.operators.ordered import ordered, position

    items = bind(spark, sf, "lineitem")
    rows = ordered(items, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]) \
        .scan(line=position()).df.select("l_suppkey", "line", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return T.monotone_check(rows, ["l_suppkey"], "line", "l_shipdate", "id")


@query("sequence_gaps", """
    WITH d AS (SELECT DISTINCT recipient_id, seq FROM b_receipts), p AS (SELECT *, LAG(seq) OVER (PARTITION BY recipient_id ORDER BY seq) AS b FROM d)
    SELECT recipient_id, b + 1 AS first, seq - 1 AS last, seq - b - 1 AS missing FROM p WHERE seq - b > 1""")
def sequence_gaps(spark, sf):
    return T.sequence_gaps(bind(spark, sf, "b_receipts"), ["recipient_id"], "seq")


@query("missing_numbers", """
    SELECT actor_id, n AS number FROM (SELECT actor_id, UNNEST(range(MIN(k), MAX(k) + 1)) AS n FROM b_events GROUP BY actor_id) g
    WHERE NOT EXISTS (SELECT 1 FROM b_events e WHERE e.actor_id = g.actor_id AND e.k = g.n)""")
def missing_numbers(spark, sf):
    gaps = T.sequence_gaps(bind(spark, sf, "b_events"), ["actor_id"], "k")
    return T.missing_numbers(gaps, ["actor_id"])


@query("stage_elapsed", """
    SELECT event_id, LAG(event_type) OVER w AS prior_stage, COALESCE(us - LAG(us) OVER w, 0) AS elapsed FROM b_events WINDOW w AS (PARTITION BY actor_id ORDER BY us, event_id)""")
def stage_elapsed(spark, sf):
    return T.stage_elapsed(bind(spark, sf, "b_events"), "actor_id", ["us", "event_id"], "event_type", "us").select("event_id", "prior_stage", "elapsed")


@query("name_dedupe", """
    WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END || CASE WHEN p_partkey > 20 THEN ' ' || CAST(p_partkey // 2 AS VARCHAR) ELSE '' END AS name,
        p_partkey * 30 + 900 AS pieces FROM part),
    f AS (SELECT *, list_reduce(list_transform(string_split(LOWER(name), ' '), lambda w: CASE WHEN LENGTH(w) > 3 AND w[-1] = 's' THEN w[:-2] ELSE w END), lambda a, b: a || ' ' || b) AS fold FROM n)
    SELECT p_partkey, CASE WHEN COUNT(*) OVER (PARTITION BY fold) > 1 THEN name || ' · ' || format('{:,}', pieces) ELSE name END AS name FROM f""")
def name_dedupe(spark, sf):
    key = F.col("p_partkey")
    names = bind(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.when(key % 3 == 0, "s").otherwise(""),
                              F.when(key > 20, F.concat(F.lit(" "), F.expr("p_partkey div 2").cast("string"))).otherwise("")).alias("name"),
        (key * 30 + 900).alias("pieces"))
    return T.name_dedupe(names, "name", "pieces", "p_partkey").select("p_partkey", "name")


@query("percentile_nr", """
    WITH o AS (SELECT l_returnflag, l_quantity, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, MAX(CASE WHEN r = CEIL(0.5 * n) THEN l_quantity END) AS p50, MAX(CASE WHEN r = CEIL(0.95 * n) THEN l_quantity END) AS p95,
           MAX(CASE WHEN r = CEIL(0.99 * n) THEN l_quantity END) AS p99 FROM o GROUP BY l_returnflag""")
def percentile_nr(spark, sf):
    return group_quantiles(bind(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("tick_windows", """
    WITH n AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY stream ORDER BY us, tick) - 1) // 100 AS w FROM b_ticks),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream, w ORDER BY total_ms) AS rt, ROW_NUMBER() OVER (PARTITION BY stream, w ORDER BY sim_ms) AS rs FROM n)
    SELECT stream, w AS "window", COUNT(*) AS samples, MAX(us) AS end_at, MAX(CASE WHEN rt = 50 THEN total_ms END) AS total_ms_p50, MAX(CASE WHEN rt = 99 THEN total_ms END) AS total_ms_p99,
           MAX(total_ms) AS total_ms_max, MAX(CASE WHEN rs = 50 THEN sim_ms END) AS sim_ms_p50, MAX(CASE WHEN rs = 99 THEN sim_ms END) AS sim_ms_p99, MAX(sim_ms) AS sim_ms_max,
           CAST(SUM(CASE WHEN total_ms > 50 THEN 1 ELSE 0 END) AS BIGINT) AS overruns, CAST(SUM(CASE WHEN degraded THEN 1 ELSE 0 END) AS BIGINT) AS degraded_ticks,
           CAST(SUM(sent) AS BIGINT) AS sent, CAST(SUM(culled) AS BIGINT) AS culled, CAST(SUM(aborts) AS BIGINT) AS aborts
    FROM o GROUP BY stream, w HAVING COUNT(*) = 100""")
def tick_windows(spark, sf):
    return T.tick_windows(bind(spark, sf, "b_ticks"), "stream", ["us", "tick"], ["total_ms", "sim_ms"], ["sent", "culled", "aborts"], "total_ms")


@query("counter_deltas", """
    WITH s AS (SELECT run_id, sample, sent, sent - LAG(sent) OVER (PARTITION BY run_id ORDER BY sample) AS d FROM b_counters WHERE sent IS NOT NULL),
    r AS (SELECT run_id, sample, received, received - LAG(received) OVER (PARTITION BY run_id ORDER BY sample) AS d FROM b_counters)
    SELECT run_id, sent_delta, sent_resets, received_delta, received_resets FROM
      (SELECT run_id, CAST(SUM(CASE WHEN d IS NULL THEN 0 WHEN d < 0 THEN sent ELSE d END) AS BIGINT) AS sent_delta, CAST(SUM(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS sent_resets FROM s GROUP BY 1) a
      JOIN (SELECT run_id, CAST(SUM(CASE WHEN d IS NULL THEN 0 WHEN d < 0 THEN received ELSE d END) AS BIGINT) AS received_delta, CAST(SUM(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS received_resets FROM r GROUP BY 1) b USING (run_id)""")
def counter_deltas(spark, sf):
    return T.counter_deltas(bind(spark, sf, "b_counters"), "run_id", ["sample"], ["sent", "received"])


@query("counter_ratios", """
    WITH s AS (SELECT run_id, sample, applied, received, applied - LAG(applied) OVER w AS da, received - LAG(received) OVER w AS dr FROM b_counters WINDOW w AS (PARTITION BY run_id ORDER BY sample)),
    t AS (SELECT run_id, SUM(CASE WHEN da IS NULL THEN 0 WHEN da < 0 THEN applied ELSE da END) AS a, SUM(CASE WHEN dr IS NULL THEN 0 WHEN dr < 0 THEN received ELSE dr END) AS r FROM s GROUP BY 1)
    SELECT run_id, CASE WHEN r > 0 THEN ROUND(a / r, 3) END AS applied_per_received, CAST(NULL AS DOUBLE) AS per_nothing FROM t""")
def counter_ratios(spark, sf):
    deltas = T.counter_deltas(bind(spark, sf, "b_counters"), "run_id", ["sample"], ["applied", "received"]).withColumn("nothing", F.lit(0))
    return T.counter_ratios(deltas, {"applied_per_received": ("applied_delta", "received_delta"), "per_nothing": ("applied_delta", "nothing")}) \
        .select("run_id", "applied_per_received", "per_nothing")


@query("lifetime_maxima", """
    WITH f AS (SELECT run_id, MIN(sample) AS a, MAX(sample) AS z FROM b_counters WHERE sent IS NOT NULL GROUP BY run_id)
    SELECT f.run_id, x.sent AS sent_begin, y.sent AS sent_end, y.sent > x.sent AS sent_changed FROM f JOIN b_counters x ON x.run_id = f.run_id AND x.sample = f.a
      JOIN b_counters y ON y.run_id = f.run_id AND y.sample = f.z""")
def lifetime_maxima(spark, sf):
    return T.lifetime_maxima(bind(spark, sf, "b_counters"), "run_id", ["sample"], ["sent"])


@query("counter_rates", """
    SELECT run_id, sample, ROUND(COALESCE(GREATEST(0, received - LAG(received) OVER w) / GREATEST(0.001, (us - LAG(us) OVER w) / 1000000.0), 0), 6) AS received_per_s,
           CASE WHEN LAG(applied) OVER w > 0 THEN CAST(ABS(applied - LAG(applied) OVER w) AS DOUBLE) ELSE 0.0 END AS jitter
    FROM b_counters WINDOW w AS (PARTITION BY run_id ORDER BY sample)""")
def counter_rates(spark, sf):
    rates = T.counter_rates(bind(spark, sf, "b_counters"), ["run_id"], ["sample"], "us", ["received"], "applied")
    return rates.select("run_id", "sample", F.round("received_per_s", 6).alias("received_per_s"), F.col("jitter").cast("double").alias("jitter"))


@query("rolling_p95", """
    WITH n AS (SELECT stream, tick, total_ms, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY us, tick) AS n FROM b_ticks),
    l AS (SELECT stream, tick, list_sort(LIST(total_ms) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)) AS v FROM n)
    SELECT stream, tick, v[CAST(CEIL(LEN(v) * 0.95) AS BIGINT)] AS percentile FROM l""")
def rolling_p95(spark, sf):
    return T.rolling_percentile(bind(spark, sf, "b_ticks"), ["stream"], ["us", "tick"], "total_ms").select("stream", "tick", "percentile")


@query("lifecycle_summary", """
    WITH w AS (SELECT * FROM b_lifecycle l WHERE line_no >= COALESCE((SELECT MAX(line_no) FROM b_lifecycle m WHERE m.log_id = l.log_id AND m.event = 'start'), -1)),
    c AS (SELECT log_id, MAX(line_no) AS at FROM w WHERE event = 'stop' AND applied IS NOT NULL GROUP BY log_id),
    d AS (SELECT log_id, BOOL_OR(event = 'start') AS has_start, COUNT(*) AS window_rows,
        CAST(SUM(CASE WHEN event IN ('click', 'view') THEN 1 ELSE 0 END) AS BIGINT) AS detail_rows,
        CAST(SUM(CASE WHEN event IN ('click', 'view') AND via = 'local' THEN 1 ELSE 0 END) AS BIGINT) AS via_local,
        COUNT(DISTINCT CASE WHEN event IN ('click', 'view') THEN uid END) AS distinct_uids FROM w GROUP BY log_id)
    SELECT d.log_id, CASE WHEN c.at IS NOT NULL THEN w.applied ELSE d.via_local END AS applied, c.at IS NOT NULL AS authoritative, has_start, window_rows, detail_rows, via_local, distinct_uids,
           c.at IS NULL AS has_caveat
    FROM d LEFT JOIN c USING (log_id) LEFT JOIN w ON w.log_id = c.log_id AND w.line_no = c.at""")
def lifecycle_summary(spark, sf):
    spec = T.Lifecycle(counters=("applied",), detail=F.col("event").isin("click", "view"), floors={"applied": F.col("via") == "local"},
                       counts={"via_local": F.col("via") == "local"}, distinct={"distinct_uids": F.col("uid")})
    out = T.lifecycle_summary(bind(spark, sf, "b_lifecycle"), "log_id", "line_no", spec)
    return out.withColumn("has_caveat", F.col("caveat").isNotNull()).drop("caveat")


@query("trajectory_resample", """
    WITH e AS (SELECT entity, MIN(produced_s) AS t0, MAX(produced_s) AS t1 FROM b_motion GROUP BY entity),
    f AS (SELECT entity, t0, frame, t0 + frame * 7200 AS frame_at, GREATEST(t0 + frame * 7200 - 3600, t0) AS target_at FROM (SELECT *, UNNEST(range(0, (t1 - t0) // 7200 + 1)) AS frame FROM e) u),
    n AS (SELECT entity, sequence, produced_s AS t, x, y, LAG(produced_s) OVER w AS t_o, LAG(x) OVER w AS x_o, LAG(y) OVER w AS y_o FROM b_motion WINDOW w AS (PARTITION BY entity ORDER BY sequence)),
    j AS (SELECT f.*, n.*, SQRT((x - x_o) ** 2 + (y - y_o) ** 2) AS hop, (target_at - t_o) / (t - t_o) AS a FROM f JOIN n ON n.entity = f.entity AND f.target_at <= n.t AND (n.t_o IS NULL OR f.target_at > n.t_o))
    SELECT entity, frame, CAST(frame_at AS DOUBLE) AS frame_at, CAST(target_at AS DOUBLE) AS target_at, ROUND(CASE WHEN t_o IS NULL THEN x WHEN hop > 60 THEN x_o ELSE x_o + (x - x_o) * a END, 6) AS x,
           ROUND(CASE WHEN t_o IS NULL THEN y WHEN hop > 60 THEN y_o ELSE y_o + (y - y_o) * a END, 6) AS y, t_o IS NOT NULL AND hop > 60 AS guarded FROM j""")
def trajectory_resample(spark, sf):
    frames = T.trajectory_resample(bind(spark, sf, "b_motion"), "entity", "produced_s", 7200.0, 3600.0, 60.0)
    return frames.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("accepted_samples", """
    SELECT entity, sequence, arrived_s FROM (SELECT entity, sequence, arrived_s, MAX(sequence) OVER (PARTITION BY entity ORDER BY arrived_s, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b_motion) t
    WHERE m IS NULL OR sequence > m""")
def accepted_samples(spark, sf):
    return T.accepted_samples(bind(spark, sf, "b_motion"), "entity", "arrived_s", "sequence").select("entity", "sequence", "arrived_s")


@query("trajectory_metrics", """
    WITH p AS (SELECT entity, sequence, x, y, x + y % 3 AS tx, y AS ty, x - LAG(x, 1, x) OVER w AS dx, y - LAG(y, 1, y) OVER w AS dy,
        (x + y % 3) - LAG(x + y % 3, 1, x + y % 3) OVER w AS tdx FROM b_motion WINDOW w AS (PARTITION BY entity ORDER BY sequence)),
    q AS (SELECT *, SQRT(dx * dx + dy * dy) AS step, SQRT((dx - COALESCE(LAG(dx) OVER w, 0)) ** 2 + (dy - COALESCE(LAG(dy) OVER w, 0)) ** 2) AS change,
        SQRT((x - tx) ** 2 + (y - ty) ** 2) AS err, SQRT(tdx * tdx + dy * dy) AS moved FROM p WINDOW w AS (PARTITION BY entity ORDER BY sequence))
    SELECT entity, COUNT(*) AS frames, ROUND(AVG(err), 6) AS mean_error, ROUND(MAX_BY(err, sequence), 6) AS final_error, ROUND(AVG(step), 6) AS mean_step, ROUND(MAX(step), 6) AS max_step,
           ROUND(AVG(change), 6) AS mean_step_change, ROUND(MAX(change), 6) AS max_step_change, CAST(SUM(CASE WHEN step > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large_steps,
           CAST(SUM(CASE WHEN moved > 0.0001 AND step <= 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS stalled FROM q GROUP BY entity""")
def trajectory_metrics(spark, sf):
    frames = bind(spark, sf, "b_motion").select("entity", "sequence", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
                                                (F.col("x") + F.col("y") % 3).cast("double").alias("truth_x"), F.col("y").cast("double").alias("truth_y"))
    out = T.trajectory_metrics(frames, "entity", "sequence", 50.0)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_error", "final_error", "mean_step", "max_step", "mean_step_change", "max_step_change")})


@query("motion_error", """
    WITH l AS (SELECT entity, x, y, COALESCE(LAG(x) OVER w, 0) AS x1, COALESCE(LAG(x, 2) OVER w, 0) AS x2, COALESCE(LAG(y) OVER w, 0) AS y1, COALESCE(LAG(y, 2) OVER w, 0) AS y2
      FROM b_motion WINDOW w AS (PARTITION BY entity ORDER BY sequence))
    SELECT entity, ROUND(SUM(SQRT((x - 2 * x1 + x2) ** 2 + (y - 2 * y1 + y2) ** 2)), 6) AS error, COUNT(*) AS samples FROM l GROUP BY entity""")
def motion_error(spark, sf):
    return T.motion_error(bind(spark, sf, "b_motion"), "entity", ["sequence"]).withColumn("error", F.round("error", 6))
