"""Queries over the scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as X, values as V
from tidegauge.plans.bindings import bind, table
from tidegauge.plans.registry import query


@query("iso_times", """
    SELECT event_id, CASE WHEN k % 3 < 2 THEN us // 1000000 * 1000000 - CASE WHEN k % 3 = 1 THEN 7200000000 ELSE 0 END END AS us, strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS shown,
      date_diff('day', CAST(make_timestamp(us) AS DATE), DATE '2024-02-01') AS age FROM b_events""")
def iso_times(spark, sf):
    shown = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("k") % 3 == 0, F.concat(shown, F.lit("Z"))).when(F.col("k") % 3 == 1, F.concat(shown, F.lit("+02:00"))).otherwise(shown)
    return bind(spark, sf, "b_events").select(
        "event_id", F.unix_micros(V.parse_utc(text)).alias("us"), V.epoch_text(F.expr("us div 1000000")).alias("shown"),
        V.age_days(F.to_date(F.timestamp_micros("us")), F.lit("2024-02-01").cast("date")).cast("bigint").alias("age"))


@query("map_merge", """
    SELECT actor_id, COUNT(*) FILTER (event_type = 'click') AS clicks, COUNT(*) FILTER (event_type = 'view') AS views, COUNT(*) FILTER (event_type IN ('click', 'view')) AS total, 0 AS nothing FROM b_events GROUP BY actor_id""")
def map_merge(spark, sf):
    counts = bind(spark, sf, "b_events").groupBy("actor_id").agg(
        F.create_map(F.lit("click"), F.count_if(F.col("event_type") == "click")).alias("a"),
        F.create_map(F.lit("view"), F.count_if(F.col("event_type") == "view"), F.lit("click"), F.lit(0).cast("bigint")).alias("b"))
    merged = counts.withColumn("m", V.merge_counts(F.col("a"), F.col("b")))
    return merged.select("actor_id", V.get_or(F.col("m"), F.lit("click")).alias("clicks"), V.get_or(F.col("m"), F.lit("view")).alias("views"),
                         F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"), V.get_or(F.col("m"), F.lit("gone")).cast("int").alias("nothing"))


@query("canonical_json", """
    SELECT event_id, '{"a":"' || CAST(k AS VARCHAR) || '","b":"x"}' AS text, sha256('{"a":"' || CAST(k AS VARCHAR) || '","b":"x"}') AS digest FROM b_events""")
def canonical_json(spark, sf):
    k = F.col("k").cast("string")
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"b": "x", "a": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"a":"'), k, F.lit('" , "b":"x"}')))
    return bind(spark, sf, "b_events").select("event_id", V.canonical_json(raw).alias("text")).withColumn("digest", V.text_digest(F.col("text")))


@query("natural_order", """
    SELECT p_partkey, COALESCE(NULLIF(regexp_extract(code, '^([A-Za-z]*)(\\d*)([A-Za-z]*)$', 1), ''), '') AS head, CAST(p_size AS BIGINT) AS number FROM (SELECT p_partkey, p_size, 'M' || CAST(p_size AS VARCHAR) || 'b' AS code FROM part) t""")
def natural_order(spark, sf):
    code = F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit("b"))
    return table(spark, sf, "part").select("p_partkey", X.natural_key(code).alias("n")).select("p_partkey", "n.head", "n.number")


@query("sheet_letters", """
    WITH a AS (SELECT p_partkey, p_partkey * 977 AS n FROM part), b AS (SELECT *, n // 26 - 1 AS m FROM a), c AS (SELECT *, CASE WHEN m >= 0 THEN m // 26 - 1 ELSE -1 END AS l FROM b),
    d AS (SELECT *, CASE WHEN l >= 0 THEN l // 26 - 1 ELSE -1 END AS k FROM c), e AS (SELECT *, CASE WHEN k >= 0 THEN k // 26 - 1 ELSE -1 END AS j FROM d)
    SELECT p_partkey, CASE WHEN j >= 0 THEN chr(CAST(65 + j % 26 AS INT)) ELSE '' END || CASE WHEN k >= 0 THEN chr(CAST(65 + k % 26 AS INT)) ELSE '' END || CASE WHEN l >= 0 THEN chr(CAST(65 + l % 26 AS INT)) ELSE '' END
      || CASE WHEN m >= 0 THEN chr(CAST(65 + m % 26 AS INT)) ELSE '' END || chr(CAST(65 + n % 26 AS INT)) AS letters FROM e""")
def sheet_letters(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.sheet_letter(F.col("p_partkey") * 977).alias("letters"))
