"""Reports over telemetry, catalogs and access logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.functions.text import browser_family, first_sentence
from tidegauge.operators.ordered import ordered, position


def telemetry_report(samples: DataFrame, keys: list[str], order: list[str], metrics: list[str], n: int = 30) -> DataFrame:
    """Means of the latest ``n`` valid samples per key (3 digits, NULL if none) and the latest row.

    ``valid`` marks rows that parsed. Top-n per key is cut before the shuffle.
    """
    from pyspark.sql import Window as W

    window = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    kept = samples.filter("valid").withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= n)
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(m), 3).alias(f"mean_{m}") for m in metrics],
        *[F.max_by(m, F.struct(*order)).alias(f"latest_{m}") for m in metrics],
        *[(F.count(m) > 0).alias(f"has_{m}") for m in metrics])


def compare_sessions(samples: DataFrame, pulses: DataFrame, host: object, client: object) -> DataFrame:
    """Two sessions side by side with findings: no pulses, frame rates 10 apart, client round trip missing or zero."""
    side = F.when(F.col("session_id") == host, "host").when(F.col("session_id") == client, "client")
    s = samples.withColumn("side", side).filter("side is not null").groupBy("side").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("fps"), 3).alias("fps"), F.round(F.avg("rtt_ms"), 3).alias("rtt"))
    p = pulses.withColumn("side", side).filter("side is not null").groupBy("side").agg(F.count(F.lit(1)).alias("pulses"))
    def of(c: str, who: str) -> Column:
        return F.max(F.when(F.col("side") == who, F.col(c)))
    both = s.join(p, "side", "full_outer").agg(
        *[F.coalesce(of(c, w), F.lit(0)).alias(f"{w}_{c}") for w in ("host", "client") for c in ("samples", "pulses")],
        *[of(c, w).alias(f"{w}_{c}") for w in ("host", "client") for c in ("fps", "rtt")])
    apart = F.round(F.abs(F.col("host_fps") - F.col("client_fps")), 3)
    findings = F.array_compact(F.array(
        F.when(F.col("host_pulses") <= 0, "host bundle has no server pulses"),
        F.when(F.col("client_pulses") <= 0, "client bundle has no received server pulses"),
        F.when(apart >= 10, F.concat(F.lit("large average FPS delta: "), apart.cast("string"))),
        F.when(F.coalesce("client_rtt", F.lit(0)) == 0, "client RTT is missing or zero; verify connected multiplayer session")))
    return both.withColumn("findings", findings)


def evidence_checks(rows: DataFrame, keys: list[str], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """Named checks over row counts: ``once``, ``some``, ``none``, ``two`` of a condition or ``one_value`` of a column."""
    def verdict(kind: str, c: Column) -> Column:
        if kind == "one_value":
            return F.countDistinct(c) == 1
        n = F.count_if(c)
        return {"once": n == 1, "some": n >= 1, "none": n == 0, "two": n == 2}[kind]
    out = rows.groupBy(*keys).agg(*[verdict(k, c).alias(name) for name, (k, c) in checks.items()])
    failed = F.array_compact(F.array(*[F.when(~F.col(name), F.lit(name)) for name in checks]))
    return out.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def visit_summary(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Page opens per user, their browsers and addresses as ``(user, field, value, n)``, and refused opens.

    ``log``: ``(ts, line, status, uri, user_id, client_ip, agent)``; only the page itself counts.
    """
    page = log.filter(F.col("uri") == "/")
    opens = page.filter("status = 200").select(
        F.coalesce(F.nullif("user_id", F.lit("")), F.lit("-")).alias("user"), "ts", "line", "client_ip",
        browser_family(F.col("agent")).alias("browser"))
    users = opens.groupBy("user").agg(F.count(F.lit(1)).alias("visits"), F.min_by("ts", "line").alias("first_seen"),
                                      F.max_by("ts", "line").alias("last_seen"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("browser", "client_ip")]))
    values = opens.select("user", pairs.alias("p")).groupBy("user", "p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    refused = page.agg(F.count_if(F.col("status") == 401).alias("refused"))
    return users, values, refused


def recount_check(summary: DataFrame, events: DataFrame, key: str = "event_type") -> DataFrame:
    """Stored counts against a recount: one row per type that differs or is missing on a side."""
    counted = events.groupBy(key).agg(F.count(F.lit(1)).alias("counted"))
    return summary.join(counted, key, "full_outer").filter(~F.col("stored").eqNullSafe(F.col("counted"))) \
        .select(key, "stored", "counted")


def conservation_check(df: DataFrame, key: str) -> DataFrame:
    """Rows that break the delivery balance, one per broken rule."""
    rules = {
        "eligible_durable_acked": (F.col("eligible") == F.col("durable")) & (F.col("durable") == F.col("acked")),
        "applied_plus_superseded": F.col("applied") + F.col("superseded") == F.col("acked"),
        "nothing_pending": F.col("pending") == 0, "nothing_native": F.col("native") == 0,
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def busiest_window(samples: DataFrame, keys: list[str], tie: str, ticks: int = 100, hz: float = 20.0) -> DataFrame:
    """The sample with the most decisions per cell, with the tail ratio, pairs per tick and rate."""
    load = F.col("sent") + F.col("culled")
    rest = [c for c in samples.columns if c not in keys]
    best = samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(load, (-F.col(tie)).alias("t"))).alias("b")).select(*keys, "b.*")
    return best.select(*keys, tie, "sent", "culled", "p50", "p99",
                       F.when(F.col("p50") == 0, 0.0).otherwise(F.round(F.col("p99") / F.col("p50"), 2)).alias("tail_ratio"),
                       ((F.col("sent") + F.col("culled")) / ticks).alias("pairs_per_tick"),
                       (F.col("sent") / ticks * hz).alias("sent_per_s"))


# Round trip bucket bounds in ms.
RTT_BOUNDS = [5, 10, 25, 50, 75, 100, 150, 200, 300, 500]


def histogram_buckets(df: DataFrame, value: str, bounds: list[float] | None = None) -> DataFrame:
    """Counts per bucket ``(lower, upper]``; the last bucket has no upper bound."""
    bounds = bounds or RTT_BOUNDS
    bucket = reduce(lambda otherwise, n: F.when(F.col(value) <= bounds[n], n).otherwise(otherwise), reversed(range(len(bounds))),
                    F.lit(len(bounds)))
    upper = F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double"))
    return (df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upper", F.get(upper, F.col("bucket"))))


def capability_rollup(rows: DataFrame, signature: str, immutable: list[str], ranks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """One row per signature with its best usability, and signatures whose fixed fields disagree.

    Categories are a small closed set; the atlas rows of a signature stay rows (see ``capability_rows``).
    """
    level = F.element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col("usability"))
    out = rows.groupBy(signature).agg(
        F.array_sort(F.collect_set("category")).alias("categories"), F.count(F.lit(1)).alias("rows"),
        F.min("row").alias("first_row"), F.max_by("usability", F.struct(level, (-F.col("row")).alias("r"))).alias("usability"),
        *[F.min(F.struct(F.col(c).alias("v"))).alias(f"__lo_{c}") for c in immutable],
        *[F.max(F.struct(F.col(c).alias("v"))).alias(f"__hi_{c}") for c in immutable])
    clash = F.array_compact(F.array(*[F.when(F.col(f"__lo_{c}") != F.col(f"__hi_{c}"), F.lit(c)) for c in immutable]))
    marked = out.withColumn("clash", clash)
    bad = marked.select(signature, F.explode("clash").alias("field"))
    return marked.select(signature, "categories", "rows", "first_row", "usability"), bad


def capability_rows(rows: DataFrame, signature: str) -> DataFrame:
    """Row indexes of each signature, in order."""
    return ordered(rows.select(signature, "row"), [signature], ["row"]).scan(n=position()).df


def verdict_rollup(rows: DataFrame, key: str) -> DataFrame:
    """Group verdict: any safe event binds, else anything enabled is diagnostic, else disabled."""
    safe = F.array_join(F.array_sort(F.collect_set(F.when(F.col("safe"), F.col("event")))), ", ")
    out = rows.groupBy(key).agg(safe.alias("events"), F.bool_or(F.col("profile") != "disabled").alias("enabled"))
    return out.select(key, F.when(F.col("events") != "", F.concat(F.lit("bindable: "), "events"))
                      .when(F.col("enabled"), "diagnostic only — never bindable").otherwise("intentionally disabled").alias("verdict"))


def fate_tally(fates: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per outcome, and ids that were emitted without an entry or have an entry without being emitted."""
    tally = fates.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    emitted = fates.filter("outcome = 'emitted'").select("quest_id")
    lost = emitted.join(entries.select("quest_id"), "quest_id", "left_anti").select("quest_id", F.lit("emitted_without_entry").alias("rule"))
    extra = entries.select("quest_id").join(emitted, "quest_id", "left_anti").select("quest_id", F.lit("entry_without_row").alias("rule"))
    return tally, lost.unionByName(extra)


def task_counts(tasks: DataFrame) -> DataFrame:
    """Actionable and blocked tasks per tool and overall (tool NULL)."""
    blocked = F.count_if(F.col("state") == "blocked")
    return tasks.rollup("tool").agg(F.count(F.lit(1)).alias("present"), (F.count(F.lit(1)) - blocked).alias("actionable"),
                                    blocked.alias("blocked"))


def status_tally(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def _canonical(df: DataFrame, name: str) -> Column:
    """A value as text that any engine writes alike: doubles to six decimals, times in microseconds."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = value.cast("decimal(38,6)")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    return value.cast("string")


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-independent checksum: two mergeable folds of a row digest, and the row count.

    All columns count unless some are named. Values are length-delimited (NULL is a mark of its own), so moved boundaries change
    the digest.
    """
    parts = []
    for name in columns or df.columns:
        text = _canonical(df, name)
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    h = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"),
                  F.sum(F.pmod(h, F.lit(1_000_003)).cast("bigint")).alias("sum"))


def part_digests(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """SHA-256 of the length-delimited parts of each row, so that moved boundaries change the digest."""
    pieces = [F.concat(F.length(F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8")).cast("string"), F.lit(":"),
                       F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in parts]
    return df.select(key, F.sha2(F.concat(*pieces), 256).alias("digest"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values per column with their counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("field", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def joined_counts(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """How many rows of ``df`` have a partner in ``other``."""
    marked = df.select(key).join(other.select(key, F.lit(1).alias("__hit")).distinct(), key, "left")
    return marked.agg(F.count("__hit").alias("joined"), F.count_if(F.col("__hit").isNull()).alias("unjoined"))


def decision_counts(exchanges: DataFrame, required: list[str]) -> DataFrame:
    """Coverage of a window: distinct failed checks against the required ones, what is missing, verdict."""
    wanted = F.array(*[F.lit(c) for c in sorted(required)])
    failed = F.collect_set(F.when(~F.col("accept") & F.col("failed_check").isin(required), F.col("failed_check")))
    out = exchanges.groupBy("window_id").agg(
        F.count_if("accept").alias("accepted"), F.count_if(~F.col("accept")).alias("rejected"), F.count_if("steady").alias("steady"),
        F.array_sort(failed).alias("seen"))
    out = out.withColumn("missing", F.array_except(wanted, "seen"))
    accept, full = F.col("steady") >= 1, F.size("missing") == 0
    return out.withColumn("verdict", F.when(accept & full, "handshake_satisfied").when(accept, "accept_only")
                          .when(F.col("rejected") > 0, "reject_only").otherwise("pending"))


def thread_bullets(notes: DataFrame) -> DataFrame:
    """Notes grouped by first milestone, groups and notes in first-appearance order, with a one-line text."""
    group = F.coalesce(F.get("milestones", 0), F.lit("Unspecified"))
    rows = notes.withColumn("milestone", group)
    starts = rows.groupBy("milestone").agg(F.min("line").alias("group_line"))
    summary = F.trim(F.coalesce("summary", F.lit("")))
    impact = first_sentence(F.col("impact"))
    text = F.when((summary != "") & (impact != ""), F.concat(F.lit("**"), summary, F.lit("** — "), impact)) \
        .otherwise(F.concat(summary, impact))
    return rows.join(starts, "milestone").select("milestone", "group_line", "line", "id", text.alias("bullet"))
