"""Ranked and budgeted selection. Every rank has a total order; global ranks are sliced, not sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegauge.operators.ordered import ordered, position
from tidegauge.runtime import GROUP_ROWS, setting


def score_rank(df: DataFrame, score: str, key: str, top: int = 0, region: str | None = None) -> DataFrame:
    """Rank 1.. by score, highest first; ``top`` rows only when it is positive."""
    if region is not None:
        df = df.filter(F.col("region") == region)
    if top > 0:
        df = df.orderBy(F.col(score).desc(), F.col(key)).limit(top)
    return ordered(df.withColumn("__lead", -F.col(score)), [], ["__lead", key]).scan(rank=position()).df.drop("__lead")


def pending_order(pending: DataFrame, limit: int = 1024) -> DataFrame:
    """Pending rows by rank, distance (both with unknown last) and sequence; between 1 and 1024 of them."""
    return pending.orderBy(F.col("priority_rank").asc_nulls_last(), F.col("distance").asc_nulls_last(), "seq") \
        .limit(min(max(limit, 1), 1024))


# Tiers that may use the reliable lane.
RELIABLE_TIERS = ["player_critical", "portal", "structural_anchor", "storage_crafting"]


def delivery_plan(objects: DataFrame, reliable: int, datagram: int) -> DataFrame:
    """One lane and order per distinct object.

    ``objects``: ``(object_key, tier, rank, order_no, distance)``. Reliable tiers fill the reliable lane up to its
    budget, what does not fit falls through to the datagram lane, and the rest is deferred with continuing order.
    """
    key = F.lower(F.col("object_key").cast("string"))
    best = F.min(F.struct("rank", "order_no", "distance", "tier")).alias("b")
    unique = objects.groupBy(key.alias("object_key")).agg(best).select("object_key", "b.*")
    by = ["rank", "order_no", "distance", "object_key"]
    trusted = F.lower("tier").isin(RELIABLE_TIERS)
    first = ordered(unique.withColumn("__trusted", trusted.cast("int")), ["__trusted"], by).scan(n=position()).df
    kept = first.filter((F.col("__trusted") == 1) & (F.col("n") <= reliable)).select(
        "object_key", "tier", *by[:-1], F.lit("reliable").alias("lane"), F.col("n").alias("lane_order"))
    rest = first.filter((F.col("__trusted") == 0) | (F.col("n") > reliable)).drop("n", "__trusted")
    second = ordered(rest, [], by).scan(n=position()).df
    others = second.select("object_key", "tier", *by[:-1], F.when(F.col("n") <= datagram, "datagram").otherwise("deferred").alias("lane"),
                           F.col("n").alias("lane_order"))
    return kept.unionByName(others)


def plan_summary(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows per lane and tier, with the number of duplicates removed."""
    total = objects.agg(F.count(F.lit(1)))
    unique = plan.agg(F.count(F.lit(1)))
    return plan.groupBy("lane", "tier").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("duplicates_removed", total.scalar() - unique.scalar())


def recent_k(df: DataFrame, at: str, key: str, k: int) -> DataFrame:
    """Latest ``k`` rows."""
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(k)


def top_per_region(df: DataFrame, region: str, score: str, key: str, limits: dict[str, int]) -> DataFrame:
    """First rows of each region by score, a different number per region; other regions are left out."""
    window = W.partitionBy(region).orderBy(F.col(score).desc(), F.col(key))
    cap = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    ranked = (df.filter(F.col(region).isin(list(limits))).withColumn("place", F.row_number().over(window))
              .filter(F.col("place") <= max(limits.values())))
    return ranked.filter(F.col("place") <= F.element_at(cap, F.col(region)))


def cursor_increment(df: DataFrame, line: str, row_id: str, at: str, now, since=None, last_id=None, last_at=None,
                     default: int = 7 * 86_400_000_000) -> DataFrame:
    """Rows not seen yet: since a time (inclusive), else after the line of the last id, else after its time, else a week."""
    if since is not None:
        return df.filter(F.col(at) >= since)
    if last_id is not None:
        found = df.filter(F.col(row_id) == last_id).agg(F.min(line)).first()[0]
        if found is not None:
            return df.filter(F.col(line) > found)
        if last_at is not None:
            return df.filter(F.col(at) > last_at)
    return df.filter(F.col(at) >= now - default)


# Order of the record kinds in a lane.
KIND_ORDER = {"story": 0, "portal": 1, "guide": 2, "tool": 3}


#: Records one task may sort: they carry whole texts, and a lane has no key that would part them.
LANE_ROWS = 50_000


def lane_order(records: DataFrame, role: str) -> DataFrame:
    """Core records of an audience in reading order: primary ones first, then by kind and title."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in KIND_ORDER.items() for x in p]), F.col("kind")), F.lit(9))
    core = records.filter(F.array_contains("audiences", role) & F.col("kind").isin(list(KIND_ORDER)))
    core = core.withColumns({"__primary": (~F.array_contains("primary", role)).cast("int"), "__kind": kind})
    limit = min(LANE_ROWS, setting(core.sparkSession, GROUP_ROWS))
    return ordered(core, [], ["__primary", "__kind", "title", "id"], limit).scan(place=position()).df.drop("__primary", "__kind")


def lane_recent(records: DataFrame, role: str, kind: str, k: int) -> DataFrame:
    """Newest ``k`` records of a kind for an audience."""
    return recent_k(records.filter(F.array_contains("audiences", role) & (F.col("kind") == kind)), "published", "id", k)


def best_per_group(df: DataFrame, group: str, score: str, key: str, k: int = 6, skip: list | None = None) -> DataFrame:
    """Best row of each group, then the best ``k`` groups."""
    if skip:
        df = df.filter(~F.col(group).isin(skip))
    rest = [c for c in df.columns if c != group]
    best = df.groupBy(group).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(key)).alias("k"))).alias("b")).select(group, "b.*")
    return best.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def stride_sample(df: DataFrame, score: str, key: str, k: int = 60) -> DataFrame:
    """Every step-th row of the ranking, step = max(1, n div k), first ``k`` of them."""
    ranked = score_rank(df, score, key)
    n = df.count()
    step = max(1, n // k)
    return ranked.filter(((F.col("rank") - 1) % step == 0) & (F.col("rank") <= (k - 1) * step + 1))


def priority_sample(objects: DataFrame, radius: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Per sample the first ``n`` classed objects in radius by rank, distance and name, and counts per tier.

    ``objects``: ``(sample_id, object_id, name, tier, rank, distance)``; an object counts once per sample.
    """
    inside = objects.filter(F.col("distance") <= radius)
    seen = inside.groupBy("sample_id", "object_id").agg(F.min(F.struct("rank", "distance", "name", "tier")).alias("b")) \
        .select("sample_id", "object_id", "b.*")
    window = W.partitionBy("sample_id").orderBy("rank", "distance", F.lower("name"), "object_id")
    shown = seen.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n)
    counts = seen.groupBy("sample_id", "tier").agg(F.count(F.lit(1)).alias("n"))
    capped = counts.groupBy("sample_id").agg(F.sum("n").alias("candidates"), (F.sum("n") > n).alias("capped"))
    return shown.join(capped, "sample_id"), counts


def recent_distinct(df: DataFrame, name: str, at: str, k: int = 10) -> DataFrame:
    """Newest ``k`` distinct names, numbered from the oldest of them."""
    latest = df.filter(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "").groupBy(name).agg(F.max(at).alias("last"))
    kept = latest.orderBy(F.col("last").desc(), F.col(name)).limit(k)
    return ordered(kept, [], ["last", name]).scan(place=position()).df


def minmax_blend(df: DataFrame, group: str, a: str, b: str, weight: float, veto: str, limit: float, key: str) -> DataFrame:
    """Min-max normalise two scores per group (0.5 if constant or unknown), blend, drop vetoed rows, rank per group."""
    ends = df.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    def norm(c: str) -> Column:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(F.col(c).isNull() | F.coalesce(span == 0, F.lit(True)), 0.5).otherwise((F.col(c) - F.col(f"lo_{c}")) / span)
    kept = df.join(ends, group).filter(F.coalesce(F.col(veto), F.lit(0)) <= limit)
    blended = kept.withColumn("blend", weight * norm(b) + (1 - weight) * norm(a)).withColumn("__lead", -F.col("blend"))
    return ordered(blended, [group], ["__lead", key]).scan(place=position()).df.select(group, key, "blend", "place")
