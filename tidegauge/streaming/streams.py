"""Streaming forms of the keyed operators: DataFrame in, DataFrame out, same rows as the batch forms.

Rows of one key within a micro-batch are sorted in memory, so the size of a micro-batch is the bound on a hot key: set
``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` (or the like) on the source. State per key is a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from tidegauge.operators.events import PUBLIC_TYPES
from tidegauge.operators.interest import SECOND, quest_events
from tidegauge.operators.quality import trigger_match
from tidegauge.runtime import REPLAY_ROWS, setting, ship
from tidegauge.streaming import processors as P

#: Rows a file of a replayed micro-batch holds, and files it has at most.
ROWS_PER_FILE, MOST_FILES = 250_000, 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store, which is set here, and this package on the Python workers."""
    ship(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _stateful(sdf: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, event_time: str = "") -> DataFrame:
    """``event_time`` names the watermarked column of a processor with timers; it has to be in the result, for a next one."""
    prepare(sdf.sparkSession)
    return sdf.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if event_time else "None",
        eventTimeColumnName=event_time)


#: Buckets of keys whose states lie side by side; fixed for the life of a stream. A task holds the rows and states of one bucket at a time.
BUCKETS = 512


def _bucket(keys: list[str]) -> Column:
    """Bucket of a key. Keys with different columns missing never share one, so a column of a bucket has all values or none."""
    missing = sum((F.when(F.col(k).isNull(), 1 << n).otherwise(0) for n, k in enumerate(keys)), F.lit(0))
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + missing * BUCKETS


def _side_by_side(sdf: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """One call of the processor for the keys of a bucket."""
    return _stateful(sdf.withColumn("bucket__", _bucket(keys)), ["bucket__"], processor, schema)


#: Event time that timers go by, and how far rows may come behind the newest one. Rows reach processors as named tuples, so names start with a letter.
EVENT_TIME, LATE = "event_time__", "10 minutes"


def _timed(sdf: DataFrame, at: str, late: str) -> DataFrame:
    """``sdf`` with a watermark on its microseconds ``at``. A watermark starts at 1970, so rows of that moment or before are late."""
    return sdf.withColumn(EVENT_TIME, F.timestamp_micros(at)).withWatermark(EVENT_TIME, late)


def _types(sdf: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sdf.select(*columns).schema.fields)


def stream_feed(sdf: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Public projection of the event stream: allowed types only, no actor, provenance filled in.

    The delay and the size of the feed are applied when it is read (``public_feed``).
    """
    provenance = F.when(F.trim(F.coalesce("provenance", F.lit(""))) == "", "observed").otherwise(F.col("provenance"))
    return sdf.filter(F.col("event_type").isin(types or PUBLIC_TYPES)).select(
        "capture_seq", "event_type", "occurred_at", "region_id", "detail", provenance.alias("provenance"))


def spaced_stream(sdf: DataFrame, keys: list[str], at: str, tie: list[str], gap: int, reset: str | None = None) -> DataFrame:
    """Cooldowns, first hits, repeats and thinning on a stream; see ``spaced_picks``."""
    columns = sdf.columns
    return _side_by_side(sdf, keys, P.Spaced(gap, keys, [at, *tie], columns, reset), _types(sdf, columns) + ", picked boolean")


def quest_fire_stream(sdf: DataFrame, quests: DataFrame, players: list[str], at: str, tie: list[str], cooldown: int = 60 * SECOND,
                      window: int = SECOND, aliases: dict[str, str] | None = None, late: str = LATE) -> DataFrame:
    """Quest firing on a stream of events; see ``quest_fire``. ``at`` is in microseconds, ``quests`` a table.

    Two stateful operators in one query: repeats go first, then each event meets the quests, then cooldowns hold back. Both forget a
    key when the watermark has passed its span, so state does not grow with the keys ever seen. Events more than ``late`` behind
    the newest of an earlier micro-batch are dropped; those without a time have no place in a stream and go too.
    """
    events = _timed(quest_events(sdf.filter(F.col(at).isNotNull()), quests, aliases), at, late)
    # events without a key are never repeats of each other
    events = events.withColumns({"key__": F.trim(F.coalesce("dedupe_key", F.lit(""))), "free__": F.lit(window <= 0) | (F.trim(F.coalesce("dedupe_key", F.lit(""))) == "")})
    columns = events.columns
    fresh = _stateful(events, [*players, "name__", "key__"], P.SpacedPicks(window, [at, *tie], columns, "free__", True),
                      _types(events, columns) + ", picked boolean", EVENT_TIME).filter("picked").drop("picked", "key__", "free__", "name__")
    matches = trigger_match(fresh, quests, aliases)
    columns = matches.columns
    fired = _stateful(matches, [*players, "quest_id"], P.SpacedPicks(cooldown, [at, *tie], columns, None, True),
                      _types(matches, columns) + ", picked boolean", EVENT_TIME)
    return fired.withColumnRenamed("picked", "fired").drop(EVENT_TIME)


def first_hit_stream(sdf: DataFrame, window: int) -> DataFrame:
    """First hits and killing blows on a stream; see ``first_hit``."""
    return _side_by_side(sdf, ["target_id"], P.FirstHit(window), _types(sdf, ["target_id", "at", "hit_id", "kind"]) + ", emitted string")


def journal_stream(sdf: DataFrame, keys: list[str], order: list[str], revision: str, active_epoch: str) -> DataFrame:
    """Verdicts of journal rows of the active epoch; delivery-only rows never change state."""
    rows = sdf.filter((F.col("world_epoch") == active_epoch) & ~F.col("delivery_only"))
    columns = rows.columns
    return _side_by_side(rows, keys, P.JournalState(keys, order, revision, columns), _types(rows, columns) + ", verdict string")


def receipt_ledger(sdf: DataFrame, max_pending: int) -> DataFrame:
    """Status of each touched (window, recipient) after every batch; ``sdf`` mixes receipts and acks by ``kind``."""
    schema = ("window_id bigint, recipient_id bigint, receipts bigint, distinct_seq bigint, duplicates bigint, acked bigint, unknown_acks bigint, "
              "shed bigint, pending bigint, min_seq bigint, max_seq bigint, missing bigint, batch_us bigint")
    return _side_by_side(sdf, ["window_id", "recipient_id"], P.ReceiptLedger(max_pending), schema)


def witness_stream(sdf: DataFrame, window: int, late: str = LATE) -> DataFrame:
    """Action numbers of reports on a stream; see ``witness_merge``. ``at`` is in microseconds.

    Reports more than ``late`` behind the newest of an earlier micro-batch are dropped.
    """
    rows = _timed(sdf.filter("at is not null"), "at", late)
    columns = ["basis", "witness", "at", "report_id", EVENT_TIME]
    return _stateful(rows, ["basis"], P.WitnessMerge(window, columns), _types(rows, columns) + ", action bigint", EVENT_TIME).drop(EVENT_TIME)


def hysteresis_stream(sdf: DataFrame, enter: float, slack: float) -> DataFrame:
    return _side_by_side(sdf, ["object_id", "peer_id"], P.Hysteresis(enter, slack), _types(sdf, ["object_id", "peer_id", "tick"]) + ", transition string")


def lease_stream(sdf: DataFrame) -> DataFrame:
    return _side_by_side(sdf, ["object_id"], P.Lease(), _types(sdf, ["object_id", "op_id", "at", "op"]) + ", lease_epoch bigint, reason string")


def tick_stream(sdf: DataFrame, n: int = 100, budget: float = 50.0) -> DataFrame:
    """Count-based tick windows on a stream."""
    schema = ("stream bigint, window bigint, samples bigint, end_at bigint, total_ms_p50 bigint, total_ms_p99 bigint, total_ms_max bigint, "
              "overruns bigint, sent bigint")
    return _stateful(sdf, ["stream"], P.TickWindow(n, budget, ["us", "tick"]), schema)


def liveness_stream(sdf: DataFrame, key: str, at: str, lease_ms: int, late: str = LATE) -> DataFrame:
    """``(key, ms, live)``: a row when a key comes to life and one when its lease ran out.

    A lease that runs out behind the last touch is told once the watermark, ``late`` behind the newest touch of all keys, is there.
    """
    rows = sdf.select(F.col(key).alias("key"), F.col(at).alias("ts"), F.unix_millis(at).alias("ms")).withWatermark("ts", late)
    prepare(sdf.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(P.Liveness(lease_ms), f"key {kind}, ms bigint, live boolean", "Append", "EventTime")


def run_available(sdf: DataFrame, folder: str) -> DataFrame:
    """Drain everything a stream holds into a table and read it back."""
    query = (sdf.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(f"{folder}/out")


def replay(df: DataFrame, folder: str, at: str, batch_rows: int | None = None) -> DataFrame:
    """A stream over a table, in order of ``at``, NULL first.

    A table of at most ``batch_rows`` (setting ``tidegauge.replayRows``) is one micro-batch. A larger one is range-partitioned once by ``at`` and, inside equal
    values, by the other columns; ranges of about ``batch_rows`` rows in all then arrive together, one such batch after the other, each as the same number of files, which is what
    a micro-batch takes. So a task sorts no more than a file's rows, and a micro-batch is written and read by as many tasks as it has files. No row is left out, whatever its ``at``.
    """
    spark = df.sparkSession
    batch_rows = batch_rows or setting(spark, REPLAY_ROWS)
    reader = spark.readStream.schema(df.schema)
    count = df.count()
    if count <= batch_rows:
        df.write.parquet(f"{folder}/arrived")
        return reader.parquet(f"{folder}/arrived")
    n, files = -(-count // batch_rows), min(MOST_FILES, max(1, batch_rows // ROWS_PER_FILE))
    others = [f.name for f in df.schema.fields if f.name != at and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    df.repartitionByRange(n * files, at, *others).withColumn("__batch", F.expr(f"spark_partition_id() div {files}")).write.partitionBy("__batch").parquet(f"{folder}/cut")
    cut = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.LongType())])).parquet(f"{folder}/cut")
    sizes = sorted((r["__batch"], r["count"]) for r in cut.groupBy("__batch").count().collect())  # a row a micro-batch
    held, rows = [], 0
    for number, size in sizes:  # a stream over files takes them by time, so each batch is put in place after the one before
        held, rows = [*held, number], rows + size
        if rows >= files * files or number == sizes[-1][0]:  # dealt in turn, so no file stays empty
            cut.filter(F.col("__batch").isin(held)).drop("__batch").repartition(files).write.mode("append").parquet(f"{folder}/arrived")
            held, rows = [], 0
    return reader.option("maxFilesPerTrigger", files).parquet(f"{folder}/arrived")
