"""Driver tables -> operator inputs, as SQL both Spark and the checking engine can run.

Derived coordinates are whole numbers, so sums and means compare exactly. Nothing is sampled or filtered away.
Two macros differ per engine: ``MICROS(ts)`` and ``JSON(col, 'field')``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidegauge.operators.ordered import ordered, position

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag",
              "l_linestatus", "l_shipdate"]

BINDINGS = {
    "b_event_rows": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events""",
    "b_line_rows": f"""
        SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}) AS n FROM lineitem""",
    "b_events": """
        SELECT event_id, ts AS occurred_at, MICROS(ts) AS us, event_type, user_id AS actor_id,
               'region-' || CAST(user_id % 5 AS VARCHAR(9)) AS region_id,
               CAST(JSON(props, 'k') AS BIGINT) % 10 AS guild_id,
               CAST(JSON(props, 'k') AS BIGINT) AS k, value, props AS payload
        FROM events""",
    "b_game": """
        SELECT event_id, occurred_at, us, actor_id, region_id, guild_id, k, value,
               CASE event_type WHEN 'click' THEN 'structure_placed' WHEN 'signup' THEN 'player_connected'
                    WHEN 'view' THEN 'player_discovered_landmark' WHEN 'purchase' THEN 'quest_completed'
                    ELSE 'player_rank_changed' END AS event_type,
               CASE WHEN k % 13 = 0 THEN '[1]'
                    WHEN k % 9 = 0 THEN '{"quest_id": "Quest ' || CAST(k AS VARCHAR(9)) || '!", "ranged": true}'
                    ELSE '{"quest_id": "Quest ' || CAST(k AS VARCHAR(9)) || '!", "quest_name": "Name ' || CAST(k AS VARCHAR(9))
                         || '", "guild": ' || CAST(guild_id AS VARCHAR(9)) || ', "new_rank": '
                         || CASE WHEN k % 5 = 0 THEN '"none"' ELSE CAST(k % 7 AS VARCHAR(9)) END || '}' END AS payload
        FROM b_events""",
    "b_boundary": """
        SELECT event_id, us, 1 AS schema_version, k % 3 AS event_version,
               CASE event_type WHEN 'click' THEN 'zdo.batch.queued' WHEN 'view' THEN 'zdo.batch.polled'
                    WHEN 'purchase' THEN 'request.completed' WHEN 'error' THEN 'authorization.decided'
                    ELSE 'identity.resolved' END AS event_type,
               '{"window_id": "w' || CAST(k % 4 AS VARCHAR(9)) || '", "recipient_id": "'
                 || CASE WHEN k % 10 = 0 THEN '  ' ELSE 'r' || CAST(k % 6 AS VARCHAR(9)) END
                 || '", "envelope_count": ' || CAST(k AS VARCHAR(9)) || ', "accepted_count": "' || CAST(k % 5 AS VARCHAR(9))
                 || '", "pending": ' || CASE WHEN k % 8 = 0 THEN 'null' ELSE CAST(k % 3 AS VARCHAR(9)) END
                 || ', "result": ' || CASE WHEN k % 2 = 0 THEN '"allow"' ELSE 'false' END
                 || CASE WHEN k % 3 = 0 THEN ', "reason": "policy"' ELSE '' END
                 || ', "status_code": ' || CAST(200 + k % 5 AS VARCHAR(9)) || ', "route": "/r' || CAST(k % 2 AS VARCHAR(9))
                 || '", "socket_peer_class": "' || CASE WHEN k % 2 = 0 THEN 'private' ELSE 'public' END
                 || '", "forwarded_peer_claim_class": "public", "duration_ms": ' || CAST(k % 50 AS VARCHAR(9)) || '}' AS data,
               k
        FROM b_events""",
    "b_points": """
        SELECT CASE WHEN l_linenumber <= 5 THEN 'BUILDING' WHEN l_linenumber = 6 THEN 'PORTAL' ELSE 'BED' END AS category,
               CAST(240 * (l_suppkey % 10) + l_partkey % 60 AS DOUBLE) AS x,
               CAST(8 * (l_linenumber - 1) AS DOUBLE) AS y,
               4.0 * l_quantity + CASE WHEN l_quantity > 25 THEN 120.0 ELSE 0.0 END AS z,
               l_returnflag || l_linestatus AS prefab_name, l_orderkey % 17 AS creator_id,
               l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice
        FROM lineitem""",
    "b_counters": """
        SELECT user_id AS run_id, n AS sample, us,
               CASE WHEN n % 7 = 0 THEN NULL ELSE (n - 1) % 50 + 1 END AS sent,
               ((n - 1) % 50 + 1) * 3 AS received,
               (n - 1) % 50 + 1 AS applied,
               CASE WHEN n % 11 = 0 THEN NULL ELSE CAST(FLOOR((n - 1) / 20.0) AS BIGINT) % 2 = 1 END AS is_apply
        FROM (SELECT user_id, MICROS(ts) AS us, n FROM b_event_rows) t""",
    "b_ticks": """
        SELECT user_id % 10 AS stream, event_id AS tick, MICROS(ts) AS us,
               CAST(ROUND(value) AS BIGINT) % 100 AS total_ms,
               CAST(FLOOR(value / 2) AS BIGINT) % 60 AS sim_ms,
               CAST(JSON(props, 'k') AS BIGINT) AS sent,
               CAST(JSON(props, 'k') AS BIGINT) * 2 AS culled,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS aborts,
               event_type = 'signup' AS degraded
        FROM events""",
    "b_receipts": """
        SELECT window_id, recipient_id, n + CAST(FLOOR((n - 1) / 12.0) AS BIGINT)
                 - CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS seq,
               prefab, source, distance, priority_rank, acked, empty_body, us, line
        FROM (SELECT l_suppkey % 10 AS window_id, l_suppkey AS recipient_id, n, l_returnflag || l_linestatus AS prefab,
                     CASE WHEN l_linenumber <= 3 THEN 'near' ELSE 'far' END AS source,
                     l_partkey % 300 AS distance,
                     CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS priority_rank,
                     l_returnflag = 'R' AS acked, l_discount = 0 AS empty_body, MICROS(l_shipdate) AS us,
                     l_orderkey AS line
              FROM b_line_rows) t""",
    "b_journal": """
        SELECT CASE WHEN l_partkey % 97 = 3 THEN ' ' WHEN l_partkey % 50 = 0 THEN 'old' ELSE 'now' END AS world_epoch,
               CASE WHEN l_quantity <= 10 THEN l_suppkey END AS delivery_recipient,
               l_partkey AS object_id, l_orderkey AS object_revision,
               l_linestatus = 'F' AND l_returnflag = 'R' AS tombstone, l_linenumber = 7 AS delivery_only,
               l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, MICROS(l_shipdate) AS ship_us
        FROM lineitem""",
    "b_priority": """
        SELECT o_custkey AS object_key, CAST(SUBSTRING(o_orderpriority, 1, 1) AS BIGINT) AS rank,
               o_orderkey % 100 AS order_no, o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS distance,
               CASE o_orderstatus WHEN 'F' THEN 'structure' WHEN 'O' THEN 'portal' ELSE 'loose_item' END AS tier
        FROM orders""",
    "b_spans": """
        SELECT user_id AS run_id, event_id, MICROS(ts) AS us, 'a' || CAST(user_id % 3 AS VARCHAR(9)) AS action_id,
               CASE event_type WHEN 'view' THEN 'action_started' WHEN 'purchase' THEN 'completed'
                    WHEN 'error' THEN 'failed' ELSE event_type END AS state,
               'kind=' || event_type || ' k=' || JSON(props, 'k') AS detail, CAST(JSON(props, 'k') AS BIGINT) AS k
        FROM events""",
    "b_lifecycle": """
        SELECT user_id AS log_id, event_id AS line_no,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE event_type END AS event,
               CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN event_id % 1000 END AS applied,
               CASE WHEN CAST(JSON(props, 'k') AS BIGINT) % 2 = 0 THEN 'local' ELSE 'remote' END AS via,
               CAST(JSON(props, 'k') AS BIGINT) AS uid
        FROM events""",
    "b_motion": """
        SELECT user_id AS entity, n AS sequence, us / 1000000 AS produced_s, us / 1000000 + k AS arrived_s,
               CAST(ROUND(value) AS BIGINT) AS x, k AS y
        FROM (SELECT user_id, n, CAST(FLOOR(MICROS(ts) / 1000000.0) AS BIGINT) * 1000000 AS us,
                     CAST(JSON(props, 'k') AS BIGINT) AS k, value FROM b_event_rows) t""",
    "b_positions": """
        SELECT l_linenumber AS sample, l_suppkey AS entity, 'r' || CAST(l_suppkey % 5 AS VARCHAR(9)) AS region,
               CAST(SUM(l_partkey) % 300 AS DOUBLE) AS x, CAST(SUM(l_orderkey) % 300 AS DOUBLE) AS z
        FROM lineitem GROUP BY l_linenumber, l_suppkey""",
}


#: Row numbers per key come from an ordered pass on Spark, so that one hot key does not end up in one task.
NUMBERED = {"b_event_rows": ("events", "user_id", ["ts", "event_id"]), "b_line_rows": ("lineitem", "l_suppkey", LINE_ORDER)}


def _dialect(text: str, engine: str) -> str:
    if engine == "spark":
        text = re.sub(r"JSON\((\w+), '(\w+)'\)", r"GET_JSON_OBJECT(\1, '$.\2')", text)
        # the tables hold times without a zone: measured from the epoch they do not depend on the session's zone
        return re.sub(r"MICROS\((\w+)\)", r"TIMESTAMPDIFF(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", text)
    text = re.sub(r"JSON\((\w+), '(\w+)'\)", r"json_extract_string(\1, '$.\2')", text)
    text = re.sub(r"us / 1000000\b", "us // 1000000", text)
    return re.sub(r"MICROS\((\w+)\)", r"epoch_us(\1)", text)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bind(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table or one of the bindings over it."""
    if name in TABLES:
        return table(spark, folder, name)
    if name in NUMBERED:
        source, key, order = NUMBERED[name]
        return ordered(table(spark, folder, source), [key], order).scan(n=position()).df
    text = _dialect(BINDINGS[name], "spark")
    text = re.sub(r"us / 1000000\b", "us div 1000000", text)
    text = text.replace("{", "{{").replace("}", "}}")
    needed = [t for t in (*TABLES, *BINDINGS) if re.search(rf"FROM {t}\b", text)]
    for t in needed:
        text = re.sub(rf"FROM {t}\b", "FROM {" + t + "}", text)
    return spark.sql(text, **{t: bind(spark, folder, t) for t in needed})


def oracle_text(sql: str) -> str:
    """Put the definitions of the bindings a statement reads in front of it."""
    names: list[str] = []
    def need(text: str) -> None:
        for name in re.findall(r"\bb_\w+", text):
            if name in BINDINGS and name not in names:
                need(BINDINGS[name])
                names.append(name)
    need(sql)
    sql = sql.strip()
    if not names:
        return _dialect(sql, "duckdb")
    recursive = bool(re.match(r"(?i)with recursive\b", sql))
    body = re.sub(r"(?i)^with( recursive)?\b", ",", sql, count=1)
    body = body if body.startswith(",") else "\n" + body
    ctes = ",\n".join(f"{n} AS ({_dialect(BINDINGS[n], 'duckdb')})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{_dialect(body, 'duckdb')}"
