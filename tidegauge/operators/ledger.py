"""Delivery ledgers: receipts, journals, interests, leases, liveness, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.operators.ordered import OrderedGroups, largest_group, ordered, position, previous, running_max, running_min
from tidegauge.runtime import GROUP_ROWS, setting, small_side

SATURATION = 1_000_000  # fixed value: distinct sequences tracked before a ledger calls itself saturated


def receipt_status(receipts: DataFrame, acks: DataFrame) -> DataFrame:
    """State of each (window, recipient): receipts, duplicates, gaps, acked and pending sequences.

    Receipts and acks are first merged per sequence, so a hot recipient is spread over its sequences and the rest is a
    mergeable aggregate.
    """
    both = receipts.select("window_id", "recipient_id", "seq", F.lit(1).alias("r"), F.lit(0).alias("a"),
                           F.col("empty_body").cast("int").alias("e"), "us").unionByName(
        acks.select("window_id", "recipient_id", "seq", F.lit(0).alias("r"), F.lit(1).alias("a"), F.lit(0).alias("e"),
                    F.lit(None).cast("bigint").alias("us")))
    per_seq = both.groupBy("window_id", "recipient_id", "seq").agg(
        F.sum("r").alias("r"), F.sum("a").alias("a"), F.sum("e").alias("e"), F.min("us").alias("first"), F.max("us").alias("last"))
    held = F.col("r") > 0
    out = per_seq.groupBy("window_id", "recipient_id").agg(
        F.sum("r").alias("receipts"), F.count_if(held).alias("distinct_seq"),
        F.min(F.when(held, F.col("seq"))).alias("min_seq"), F.max(F.when(held, F.col("seq"))).alias("max_seq"),
        F.count_if(held & (F.col("a") > 0)).alias("acked"), F.count_if(~held).alias("unknown_acks"),
        F.sum("e").alias("empty_bodies"), F.min("first").alias("first_us"), F.max("last").alias("last_us"))
    return (out.withColumn("duplicates", F.col("receipts") - F.col("distinct_seq"))
            .withColumn("pending", F.col("distinct_seq") - F.col("acked"))
            .withColumn("missing", F.greatest(F.lit(0), F.coalesce(F.col("max_seq"), F.lit(0)) - F.col("distinct_seq")))
            .withColumn("saturated", F.col("distinct_seq") >= SATURATION))


def receipt_breakdown(receipts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Receipts per (window, recipient) and value of each dimension, one row each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions]))
    return (receipts.select("window_id", "recipient_id", pairs.alias("p"))
            .groupBy("window_id", "recipient_id", F.col("p.dimension").alias("dimension"), F.col("p.key").alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


def receipt_rollup(status: DataFrame) -> DataFrame:
    """Statuses of all recipients of a window as one."""
    sums = ["receipts", "distinct_seq", "acked", "unknown_acks", "empty_bodies", "duplicates", "pending", "missing"]
    return status.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("recipients"), *[F.sum(c).alias(c) for c in sums], F.min("min_seq").alias("min_seq"),
        F.max("max_seq").alias("max_seq"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.max("saturated").alias("saturated"))


def breakdown_rollup(breakdown: DataFrame) -> DataFrame:
    """Breakdown counts summed over the recipients of a window."""
    return breakdown.groupBy("window_id", "dimension", "key").agg(F.sum("n").alias("n"))


def reject_rate(outcomes: DataFrame) -> DataFrame:
    """Share of invalid, unknown and failed sends; 0 when nothing was sent."""
    bad = F.coalesce(F.sum(F.when(F.col("outcome").isin("invalid", "unknown", "send_error"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return outcomes.agg(total.alias("total"), bad.alias("rejected"),
                        F.when(total > 0, bad / total).otherwise(0.0).alias("reject_rate"))


# --- journal ------------------------------------------------------------------------------------------------------

def journal_verdicts(log: DataFrame, active_epoch: str | None, keys: list[str], order: list[str], revision: str,
                     interests: DataFrame | None = None) -> DataFrame:
    """What happens to each journal row: accepted only when its revision is above everything applied before it.

    Verdicts, the first that applies: ``world_epoch_invalid`` (null or blank epoch), ``world_epoch_not_active``, ``delivery_only`` (told, but no state),
    ``targeted_replay`` or ``stale_journal_revision``, ``tombstone``, ``delta``. Without an ``active_epoch`` the first row with an epoch activates its own.

    With ``interests`` (``recipient, at``) a stale row that names a ``delivery_recipient`` who registered before ``order[0]`` is a replay of the current state to
    that recipient alone; a column ``current`` then holds the revision and tombstone of the state before each row.
    """
    epoch = F.col("world_epoch")
    valid = F.trim(F.coalesce(epoch, F.lit(""))) != ""
    first = log.filter(valid).agg(F.min_by("world_epoch", F.struct(*order)).alias("epoch")) if active_epoch is None else None
    rows = log.withColumn("__active", F.lit(active_epoch) if first is None else first.scalar())
    ours = valid & F.coalesce(epoch == F.col("__active"), F.lit(False))
    g = ordered(rows, keys, order).scan(__top=running_max(F.when(ours & ~F.col("delivery_only"), F.col(revision))))
    g = g.scan(__before=previous(F.col("__top")))
    stale = F.col("__before").isNotNull() & (F.col(revision) <= F.col("__before"))
    if interests is not None:
        applied = ours & ~F.col("delivery_only") & ~stale
        g = g.scan(current=previous(F.when(applied, F.struct(F.col(revision).alias("revision"), F.col("tombstone")))))
    verdict = (F.when(~valid, "world_epoch_invalid").when(~ours, "world_epoch_not_active").when(F.col("delivery_only"), "delivery_only")
               .when(stale, "stale_journal_revision").when(F.col("tombstone"), "tombstone").otherwise("delta"))
    judged = g.df.withColumn("verdict", verdict).drop("__top", "__before", "__active")
    if interests is None:
        return judged
    # only stale rows with a recipient are looked up, so rows without one never pile up on a null key
    asks = (F.col("verdict") == "stale_journal_revision") & (F.trim(F.coalesce(F.col("delivery_recipient").cast("string"), F.lit(""))) != "")
    known = interests.groupBy(F.col("recipient").alias("__recipient")).agg(F.min("at").alias("__since"))
    found = judged.filter(asks).join(known, F.col("delivery_recipient") == F.col("__recipient"), "left")
    replay = F.coalesce(F.col(order[0]) > F.col("__since"), F.lit(False))
    found = found.withColumn("verdict", F.when(replay, "targeted_replay").otherwise(F.col("verdict"))).drop("__recipient", "__since")
    return found.unionByName(judged.filter(~asks))


def journal_state(log: DataFrame, active_epoch: str, keys: list[str], order: list[str], revision: str) -> DataFrame:
    """Current state of each object, tombstones included: highest revision, of equal ones the first to arrive.

    A mergeable aggregate: no sort, and a hot object costs one partial row per task.
    """
    rows = log.filter((F.col("world_epoch") == active_epoch) & ~F.col("delivery_only"))
    rest = [c for c in log.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(revision)).alias("r"), *order))
    return rows.groupBy(*keys).agg(best.alias("s")).select(*keys, "s.*")


def journal_mutations(verdicts: DataFrame, revision: str) -> DataFrame:
    """Rows of ``journal_verdicts`` (with ``interests``) that are told to someone, as input of ``interest_deliveries``."""
    blank = F.trim(F.coalesce(F.col("delivery_recipient").cast("string"), F.lit(""))) == ""
    replay = F.col("verdict") == "targeted_replay"
    return verdicts.filter(F.col("verdict").isin("delta", "tombstone", "delivery_only", "targeted_replay")).withColumns({
        "target": F.when(~blank, F.col("delivery_recipient")), "replay": replay, "changes": F.col("verdict").isin("delta", "tombstone"),
        "revision": F.when(replay, F.col("current.revision")).otherwise(F.col(revision)),
        "tombstone": F.when(replay, F.col("current.tombstone")).otherwise(F.col("tombstone"))})


#: Rows of one object's revision, and registrations of one recipient, that are looked up as lists.
LOOKED_UP = 256
OPEN_END = 1 << 62


def _mutation_rows(mutations: DataFrame, interests: DataFrame) -> DataFrame:
    plain = {"target": F.lit(None).cast(interests.schema["recipient"].dataType), "changes": F.lit(True), "replay": F.lit(False)}
    return mutations.withColumns({c: v for c, v in plain.items() if c not in mutations.columns})


def _registered(interests: DataFrame) -> DataFrame:
    """Registrations with the moment ``until`` which they hold and whether they replay the state."""
    g = ordered(interests, ["recipient"], ["at"]).scan(
        old=previous(F.struct("zone_x", "zone_y", "radius")))
    g = g.scan(backward=True, until=previous(F.col("at")))
    area = F.struct("zone_x", "zone_y", "radius")
    return g.df.withColumn("replays", F.col("refresh") | F.col("old").isNull() | (F.col("old") != area)).select(
        "recipient", F.col("zone_x").alias("ix"), F.col("zone_y").alias("iy"), "radius", "refresh", "replays",
        F.col("at").alias("since"), "until")


def _lives(mutations: DataFrame) -> DataFrame:
    """Changes of state with what ``replaced`` them."""
    return ordered(mutations.filter("changes"), ["object_id"], ["revision"]).scan(
        backward=True, replaced=previous(F.struct(F.col("at").alias("t"), "zone_x", "zone_y"))).df


# what a line is, in one number: snapshots, then changes and replays, then acks; a refresh; a tombstone (null, no, yes)
SNAPSHOT, DELTA, REPLAY, ACK = 0, 6, 12, 18


def _lines(mutations: DataFrame, regs: DataFrame, acks: DataFrame) -> DataFrame:
    """``recipient, object_id, revision, at, code``: all that is told to anyone, by ``code`` in the order of one moment, and the acks."""
    # zones a registration covers, as equi-join keys; the radius is a small number of zones
    covered = (regs.withColumn("zone_x", F.explode(F.sequence(F.col("ix") - F.col("radius"), F.col("ix") + F.col("radius"))))
               .withColumn("zone_y", F.explode(F.sequence(F.col("iy") - F.col("radius"), F.col("iy") + F.col("radius")))))
    open_end = F.lit(OPEN_END).cast("bigint")
    last = mutations.agg(F.max("at").alias("at"))
    lasting = regs.withColumn("end", F.least(F.coalesce("until", open_end), F.coalesce(last.scalar(), F.lit(0)))).filter("end > since")
    # as many buckets as there are registrations, or fewer, in all
    width = lasting.agg(F.greatest(F.lit(1), F.avg(F.col("end") - F.col("since")).cast("bigint")).alias("width")).first()[0] or 1
    in_time = (covered.withColumn("end", F.least(F.coalesce("until", open_end), F.coalesce(last.scalar(), F.lit(0)))).filter("end > since")
               .withColumn("bucket", F.explode(F.sequence(F.expr(f"since div {width}"), F.expr(f"end div {width}")))))
    told = mutations.withColumn("bucket", F.expr(f"at div {width}"))
    gone = F.when(F.col("tombstone").isNull(), 0).when(F.col("tombstone"), 2).otherwise(1)
    deltas = (told.filter("target is null and not replay").join(in_time, ["zone_x", "zone_y", "bucket"])
              .filter((F.col("at") > F.col("since")) & (F.col("at") <= F.col("end")))
              .select("recipient", "object_id", "revision", "at", (DELTA + gone).alias("code")))
    known = regs.groupBy(F.col("recipient").alias("target")).agg(F.min("since").alias("since"))
    targeted = (mutations.filter("target is not null").join(known, "target").filter("at > since")
                .select(F.col("target").alias("recipient"), "object_id", "revision", "at",
                        (F.when(F.col("replay"), REPLAY).otherwise(DELTA) + gone).alias("code")))
    snapshots = (_lives(mutations).join(covered.filter("replays"), ["zone_x", "zone_y"])
                 .filter((F.col("at") <= F.col("since")) & (F.coalesce("replaced.t", open_end) > F.col("since")))
                 .select("recipient", "object_id", "revision", F.col("since").alias("at"), (SNAPSHOT + 2 * gone + F.coalesce("refresh", F.lit(False)).cast("int")).alias("code")))
    marks = acks.select("recipient", "object_id", "revision", "at", F.lit(ACK).alias("code"))
    return deltas.unionByName(targeted).unionByName(snapshots).unionByName(marks)


def interest_deliveries(mutations: DataFrame, interests: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deliveries with a sequence per recipient, and acks with whether they hit a pending delivery (``interest_acks``).

    ``mutations``: journal rows ``(object_id, revision, tombstone, zone_x, zone_y, at)`` that are told, and, if some are more than plain changes of
    state, ``target`` (told to this recipient only, wherever their interest lies, once they registered), ``changes`` (false: told, but no state) and
    ``replay`` (the row repeats the current state); see ``journal_mutations``.
    ``interests``: registrations ``(recipient, zone_x, zone_y, radius, refresh, at)``, valid until the next one of the
    recipient. ``acks``: ``(recipient, object_id, revision, at)``.
    A mutation goes to the interests around it at that time. A new, changed or refreshed interest replays the state as
    it was then, except what is still pending. ``at`` is a whole number and orders all inputs.

    Mutations meet registrations by zone and by a bucket of time about as long as a registration lasts, so a mutation does not meet the
    registrations its zone had at other times. Lines are shuffled once, by recipient, as long as a task can sort those of any recipient.
    """
    return deliveries(mutations, interests, acks), interest_acks(mutations, interests, acks)


def deliveries(mutations: DataFrame, interests: DataFrame, acks: DataFrame) -> DataFrame:
    """The deliveries alone; see ``interest_deliveries``."""
    line = _lines(_mutation_rows(mutations, interests), _registered(interests), acks)
    each, turn, code = ["recipient", "object_id", "revision"], ["at", "phase", "object_id", "revision", "kind"], F.col("code")
    small = largest_group(line, ("recipient",)) <= setting(line.sparkSession, GROUP_ROWS)
    # both passes keep to the layout by recipient
    h = OrderedGroups(line.repartition("recipient"), tuple(each), ("at", "code"), None) if small else ordered(line, each, ["at", "code"])
    h = h.scan(before=previous(code))
    waiting = F.coalesce(F.col("before") < ACK, F.lit(False))
    sent = h.df.filter(code.between(DELTA, ACK - 1) | ((code < DELTA) & ((code % 2 == 1) | ~waiting)))
    tombstone = F.when(code < DELTA, F.expr("code div 2")).otherwise(code % 6) == 2
    # numbered in the order of the kinds' names
    sent = sent.select(*each, "at", (code >= DELTA).alias("phase"), F.when(tombstone, 2).when(code.between(DELTA, REPLAY - 1), 0).otherwise(1).alias("kind"))
    n = OrderedGroups(sent, ("recipient",), tuple(turn), None) if small else ordered(sent, ["recipient"], turn)
    kind = F.when(F.col("kind") == 0, "delta").when(F.col("kind") == 1, "snapshot").otherwise("tombstone")
    return n.scan(seq=position()).df.select("recipient", "seq", "object_id", "revision", kind.alias("kind"), "at")


def interest_acks(mutations: DataFrame, interests: DataFrame, acks: DataFrame) -> DataFrame:
    """``acks`` with whether they hit a pending delivery, ``known``; see ``interest_deliveries``.

    An ack looks up the rows of its object's revision and the registrations of its recipient, so that deliveries without an ack are not made. It
    is not moved if ``acks`` is laid out by object and revision. Where a list would be longer than ``LOOKED_UP``, all lines are gone through.
    """
    rows, regs, key = _mutation_rows(mutations, interests), _registered(interests), ["object_id", "revision"]
    most = min(LOOKED_UP, setting(acks.sparkSession, GROUP_ROWS))
    acks = acks.select("recipient", *key, "at")
    if largest_group(rows, tuple(key)) > most or largest_group(interests, ("recipient",)) > most:
        line = ordered(_lines(rows, regs, acks), ["recipient", *key], ["at", "code"]).scan(before=previous(F.col("code")))
        return line.df.filter(F.col("code") == ACK).select("recipient", *key, "at", F.coalesce(F.col("before") < ACK, F.lit(False)).alias("known"))
    fact = F.struct("at", "zone_x", "zone_y", "target", (F.col("target").isNull() & ~F.col("replay")).alias("open"), "changes", F.coalesce("gone", F.lit(OPEN_END)).alias("gone"))
    held = _lives(rows).withColumn("gone", F.col("replaced.t")).drop("replaced").unionByName(
        rows.filter("changes is null or not changes").withColumn("gone", F.lit(None).cast("bigint")))
    facts = held.groupBy(*key).agg(F.collect_list(fact).alias("facts"), F.collect_set("target").alias("targets"), F.min("zone_x").alias("x1"),
                                   F.max("zone_x").alias("x2"), F.min("zone_y").alias("y1"), F.max("zone_y").alias("y2"))
    reach = F.abs("radius")
    sides = {"west": F.col("ix") - reach, "east": F.col("ix") + reach, "south": F.col("iy") - reach, "north": F.col("iy") + reach}
    areas = regs.withColumns(sides).groupBy("recipient").agg(
        F.collect_list(F.struct(*sides, "since", F.coalesce("until", F.lit(OPEN_END)).alias("until"), "replays")).alias("areas"), F.min("since").alias("first"),
        F.min("west").alias("west"), F.max("east").alias("east"), F.min("south").alias("south"), F.max("north").alias("north"))
    areas = small_side(areas.withColumnRenamed("recipient", "__recipient"))

    def told(m: Column, r: Column) -> Column:
        """Time at which row ``m`` is told to the recipient of registration ``r``, up to the ack's; null if it is not."""
        inside = m["zone_x"].between(r["west"], r["east"]) & m["zone_y"].between(r["south"], r["north"])
        delta = inside & m["open"] & (m["at"] > r["since"]) & (m["at"] <= r["until"]) & (m["at"] <= F.col("at"))
        snapshot = inside & m["changes"] & r["replays"] & (m["at"] <= r["since"]) & (m["gone"] > r["since"]) & (r["since"] <= F.col("at"))
        return F.greatest(F.when(delta, m["at"]), F.when(snapshot, r["since"]))

    mine = F.array_max(F.transform("facts", lambda m: F.when((m["target"] == F.col("recipient")) & (m["at"] > F.col("first")) & (m["at"] <= F.col("at")), m["at"])))
    around = F.array_max(F.transform("facts", lambda m: F.array_max(F.transform("areas", lambda r: told(m, r)))))
    meet = (F.col("x1") <= F.col("east")) & (F.col("x2") >= F.col("west")) & (F.col("y1") <= F.col("north")) & (F.col("y2") >= F.col("south"))

    def judged(found: DataFrame) -> DataFrame:
        met = found.join(areas, F.col("recipient").eqNullSafe(F.col("__recipient")), "left")
        heard = F.greatest(F.when(meet, around), F.when(F.array_contains("targets", F.col("recipient")), mine))
        met = met.select("recipient", *key, "at", heard.alias("heard"))
        # acks of one key lie in one task already
        g = OrderedGroups(met, (*key, "recipient"), ("at",), None) if small else ordered(met, [*key, "recipient"], ["at"])
        known = F.col("heard").isNotNull() & (F.col("before").isNull() | (F.col("heard") > F.col("before")))
        return g.scan(before=previous(F.col("at"))).df.select("recipient", *key, "at", known.alias("known"))

    small = largest_group(acks, tuple(key)) <= setting(acks.sparkSession, GROUP_ROWS)
    # keys without a value are keys like others
    whole, other = F.col("object_id").isNotNull() & F.col("revision").isNotNull(), facts.withColumnsRenamed({k: f"__{k}" for k in key})
    same = F.col("object_id").eqNullSafe(F.col("__object_id")) & F.col("revision").eqNullSafe(F.col("__revision"))
    return judged(acks.filter(whole).join(facts.hint("shuffle_hash"), key, "left")).unionByName(
        judged(acks.filter(~whole).join(other.filter("__object_id is null or __revision is null"), same, "left")))


# --- leases, liveness, review -------------------------------------------------------------------------------------

def lease_state(ops: DataFrame) -> DataFrame:
    """Verdict of each operation on leases, in order ``(at, op_id)`` per ``object_id``.

    ``op`` is issue, validate, complete or reclaim; ``run_id, holder, epoch`` are what the caller claims and
    ``duration`` belongs to issues. An issue raises the epoch and replaces what was there. Within one epoch the first
    operation that completes, reclaims or meets an expired lease settles its state, so no row-by-row walk is needed.
    """
    issue = F.col("op") == "issue"
    at = F.struct("at", "op_id")
    g = ordered(ops, ["object_id"], ["at", "op_id"]).scan(
        __issues=running_max(F.when(issue, F.struct(F.col("at"), F.col("op_id"), F.col("run_id"), F.col("holder"),
                                                    (F.col("at") + F.col("duration")).alias("expires")))))
    g = g.scan(__lease_epoch=_count_if(issue))
    lease = F.col("__issues")
    ours = (lease["run_id"] == F.col("run_id")) & (lease["holder"] == F.col("holder")) & (F.col("__lease_epoch") == F.col("epoch"))
    checks = F.col("op").isin("validate", "complete") & ours
    late = F.col("at") >= lease["expires"]
    end = (F.when(lease.isNull() | issue, None).when(checks & late, "expired")
           .when(checks & (F.col("op") == "complete"), "completed")
           .when((F.col("op") == "reclaim") & (lease["holder"] == F.col("holder")), "reclaimed"))
    rows = g.df.withColumn("__end", F.when(end.isNotNull(), F.struct(F.col("at"), F.col("op_id"), end.alias("state"))))
    h = ordered(rows, ["object_id", "__lease_epoch"], ["at", "op_id"]).scan(__first=running_min(F.col("__end")))
    settled = F.when(F.col("__first").isNotNull() & (F.struct(F.col("__first.at").alias("at"), F.col("__first.op_id").alias("op_id")) < at),
                     F.col("__first.state"))
    lease = F.col("__issues")
    reason = (F.when(issue, "issued").when(lease.isNull(), "lease_missing")
              .when(F.col("op") == "reclaim", F.when((lease["holder"] == F.col("holder")) & settled.isNull(), "reclaimed").otherwise("not_reclaimed"))
              .when(lease["run_id"] != F.col("run_id"), "run_mismatch").when(lease["holder"] != F.col("holder"), "holder_mismatch")
              .when(F.col("__lease_epoch") != F.col("epoch"), "epoch_mismatch")
              .when(settled.isNotNull(), F.concat(F.lit("lease_"), settled))
              .when(F.col("at") >= lease["expires"], "lease_expired").otherwise("accepted"))
    return h.df.select("object_id", "op_id", "at", "op", F.col("__lease_epoch").alias("lease_epoch"), reason.alias("reason"))


def _count_if(condition: Column):
    from tidegauge.operators.ordered import running_sum

    return running_sum(condition.cast("int"))


def reclaims_by_holder(reclaims: DataFrame, issues: DataFrame) -> DataFrame:
    """A reclaim names a holder only; spread it to the objects that holder was ever issued."""
    return reclaims.join(issues.select("holder", "object_id").distinct(), "holder")


def liveness(touches: DataFrame, keys: list[str], at: str, now: Column, lease: int) -> DataFrame:
    """Last touch per key; live while younger than the lease (an age equal to the lease is not live)."""
    return touches.groupBy(*keys).agg(F.max(at).alias("last_touch")).withColumn("live", now - F.col("last_touch") < lease)


def consumer_status(beats: DataFrame, now: Column, stale: int, counters: list[str]) -> DataFrame:
    """Counters of the consumers seen lately; without one, those of the latest consumer, but none counts as active."""
    last = beats.groupBy("window_id", "consumer_id").agg(F.max_by(F.struct("seen", *counters), F.struct("seen", "beat_id")).alias("b"))
    active = now - F.col("b.seen") <= stale
    at = F.struct(F.col("b.seen").alias("s"), F.col("consumer_id"))
    out = last.groupBy("window_id").agg(F.count_if(active).alias("active_consumers"), F.max("b.seen").alias("last_seen"),
                                        F.max_by("b", at).alias("latest"),
                                        *[F.sum(F.when(active, F.col(f"b.{c}"))).alias(f"__{c}") for c in counters])
    return out.select("window_id", "active_consumers", "last_seen",
                      *[F.when(F.col("active_consumers") > 0, F.col(f"__{c}")).otherwise(F.col(f"latest.{c}")).alias(c) for c in counters])


def coverage_status(df: DataFrame) -> DataFrame:
    """Percent covered (NULL without a total) and whether a window is complete on both sides."""
    percent = F.when(F.col("total") > 0, F.bround(100.0 * F.col("covered") / F.col("total"), 2))
    complete = ((F.col("distinct_seq") > 0) & (F.col("missing") == 0) & ~F.col("saturated") & F.col("store_healthy")
                & (F.col("pending") == 0) & (F.col("acked") >= F.col("distinct_seq")) & (F.col("active_consumers") >= 1)
                & (F.col("rejected") == 0) & (F.col("consumer_pending") == 0))
    return df.withColumn("percent", percent).withColumn("complete", F.coalesce(complete, F.lit(False)))


def gate_compare(producer: DataFrame, gateway: DataFrame) -> DataFrame:
    """Producer counters against consumer receipts per window, first verdict that applies."""
    both = producer.join(gateway, "window_id", "full_outer")
    sure = F.coalesce("authoritative", F.lit(False))
    count = F.coalesce("seq", F.lit(0))
    verdict = (F.when(sure & (count != 0) & F.coalesce(F.col("distinct_seq") == count, F.lit(False))
                      & F.coalesce(F.col("missing") == 0, F.lit(False)), "receipts_match_no_loss")
               .when(~sure, "inconclusive_counters_not_authoritative").when(count == 0, "no_redirect_activity")
               .otherwise("mismatch"))
    return both.select("window_id", F.col("seq"), "distinct_seq", "missing", verdict.alias("verdict"))


def review_status(log: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index overlaid by the latest valid transition of each submission, and the transitions that break the rules."""
    # Statuses a review may take and those that need a reason.
    valid = ["ready_for_review", "in_review", "approved", "rejected", "needs_info"]
    bad = (F.when(~F.col("status").isin(valid), "invalid_status")
           .when(F.col("status").isin("rejected", "needs_info") & (F.coalesce("reason", F.lit("")) == ""), "reason_required"))
    judged = log.withColumn("violation", bad)
    state = judged.filter("violation is null").groupBy("submission_id").agg(
        F.max_by(F.struct("status", F.coalesce("reason", F.lit("")).alias("reason")), F.struct("at", "line")).alias("s"))
    current = index.withColumnRenamed("status", "__old").join(state, "submission_id", "full_outer").select(
        "submission_id", F.coalesce("s.status", "__old").alias("status"), F.coalesce("s.reason", F.lit("")).alias("reason"))
    return current, judged.filter("violation is not null").select("submission_id", "line", "status", "violation")


def session_pairs(links: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check stored links, then pair what is unlinked: ``(disconnected, pairs)``.

    ``objects`` are ``(object_id, tag)``, ``links`` are ``(object_id, target_id)``. A link whose target is gone or has
    another tag is dropped; unlinked objects of a tag are then paired two by two in id order, an odd one stays single.
    """
    target = objects.select(F.col("object_id").alias("target_id"), F.col("tag").alias("target_tag"))
    stored = links.filter(F.col("target_id").isNotNull())
    # unlinked objects never enter the target join, so they cannot pile up on its NULL key
    checked = objects.join(stored, "object_id").join(target, "target_id", "left").withColumn(
        "broken", ~F.coalesce(F.col("target_tag") == F.col("tag"), F.lit(False)))
    free = objects.join(stored, "object_id", "left_anti").select("tag", "object_id").unionByName(
        checked.filter("broken").select("tag", "object_id"))
    numbered = ordered(free, ["tag"], ["object_id"]).scan(n=position()).df
    pairs = (numbered.groupBy("tag", F.expr("(n - 1) div 2").alias("pair"))
             .agg(F.min("object_id").alias("first_id"), F.max("object_id").alias("second_id"), F.count(F.lit(1)).alias("size"))
             .filter("size = 2").drop("size", "pair"))
    return checked.filter("broken").select("object_id", "target_id"), pairs


def pair_by_hash(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pair the sources of a hash with its targets in order; both are ``(object_id, hash)`` and share no object.

    Objects that are source and target of one hash at once are handled by the caller, as a portal never links to itself.
    """
    s = ordered(sources, ["hash"], ["object_id"]).scan(n=position()).df.withColumnRenamed("object_id", "source_id")
    t = ordered(targets, ["hash"], ["object_id"]).scan(n=position()).df.withColumnRenamed("object_id", "target_id")
    return s.join(t, ["hash", "n"]).select("hash", "source_id", "target_id")
