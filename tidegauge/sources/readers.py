"""Tolerant readers: a bad row is counted or kept aside, never lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.operators.ordered import ordered, position
from tidegauge.runtime import ladder


def scan_objects(source: DataFrame | SparkSession, categories: list[str], path: str | None = None) -> DataFrame:
    """World object table limited to some categories; the predicate reaches the Parquet scan."""
    df = source.read.parquet(path) if isinstance(source, SparkSession) else source
    return df.filter(F.col("category").isin(categories))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files: ``(file, line, value)`` with 1-based line numbers.

    Files are split over tasks; a line's place is its block in the file and its position within the block, and numbers
    come from a scan over those places, so a large file never sits in one task.
    """
    return _numbered_lines(spark, path).select("file", "line", "value")


def _numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, file, line, value)``: files of one name in different folders are different; a BOM only starts a file."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    rows = ordered(raw, ["path"], ["block", "place"]).scan(line=position()).df
    first = F.when(F.col("line") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return rows.select("path", "file", "line", first.alias("value"))


def json_kind(value: Column) -> Column:
    """Type name of a JSON text's root, NULL when it does not parse."""
    return F.schema_of_variant(F.try_parse_json(value))


def read_jsonl(spark: SparkSession, path: str, schema: str, on_bad: str = "drop", run_id: str | None = None,
               order_by: str | None = None) -> DataFrame:
    """Typed rows of JSONL files. BOM stripped, blank lines skipped.

    ``on_bad='drop'`` leaves malformed lines out; ``'mark'`` keeps them with ``parse_error`` and the first 500
    characters in ``raw``. ``run_id`` keeps one run; ``order_by`` sorts by a timestamp text.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    good = F.coalesce(json_kind(F.col("value")).startswith("OBJECT"), F.lit(False))
    rows = lines.withColumn("good", good).withColumn("r", F.from_json("value", schema))
    if on_bad == "mark":
        out = rows.select(F.when(F.col("good"), F.col("r")).alias("r"), (~F.col("good")).alias("parse_error"),
                          F.when(~F.col("good"), F.substring("value", 1, 500)).alias("raw")).select("r.*", "parse_error", "raw")
        keep = F.col("parse_error")
    else:
        out = rows.filter("good").select("r.*")
        keep = F.lit(False)
    if run_id is not None:
        out = out.filter(keep | (F.col("run_id") == run_id))
    return out.orderBy(order_by) if order_by else out


# Fields every boundary event must have.
BOUNDARY_FIELDS = ["schema_version", "event_version", "event_id", "timestamp_utc", "event_type", "trace_id", "span_id", "source", "data"]


def judge_lines(lines: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Fate of each log line ``(file, line, value)``: good, blank, malformed or truncated, with an error text.

    A line that does not parse is truncated in an open segment and malformed in a sealed one.
    """
    required = required or BOUNDARY_FIELDS
    root = F.try_parse_json("value")
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(root, path, "variant"))
    absent = F.array_compact(F.array(*[F.when(kind(f"$.{f}").isNull(), F.lit(f)) for f in required]))
    shaped = kind("$.source").startswith("OBJECT") & kind("$.data").startswith("OBJECT")
    judged = lines.withColumn("absent", absent)
    at = F.concat_ws(":", "file", F.col("line").cast("string"))
    bad = json_kind(F.col("value")).isNull()
    fate = ladder((F.trim("value") == "", "blank"), (bad & F.col("file").endswith(".open.jsonl"), "truncated"), (bad, "malformed"),
                  (~json_kind(F.col("value")).startswith("OBJECT"), "malformed"), (F.size("absent") > 0, "malformed"),
                  (~shaped, "malformed"), default="good")
    error = ladder((F.trim("value") == "", None), (bad, F.concat(at, F.lit(": malformed JSON"))),
                   (~json_kind(F.col("value")).startswith("OBJECT"), None),
                   (F.size("absent") > 0, F.concat(at, F.lit(": missing "), F.array_join("absent", ","))))
    return judged.withColumns({"fate": fate, "error": error}).drop("absent")


def read_segments(spark: SparkSession, path: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, bad rows and statistics of a directory of log segments; the first 20 error texts are in the statistics."""
    judged = judge_lines(read_lines(spark, path), required)
    good = judged.filter("fate = 'good'").select("file", "line", "value")
    bad = judged.filter("fate IN ('malformed', 'truncated')").select("file", "line", "fate", "error", F.substring("value", 1, 500).alias("raw"))
    errors = bad.filter("error is not null").orderBy("file", "line").limit(20).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "error"))), lambda e: e["error"]).alias("errors"))
    stats = judged.agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("good", "blank", "malformed", "truncated")]) \
        .withColumn("errors", errors.scalar())
    return good, bad, stats


def judged_candidates(lines: DataFrame) -> DataFrame:
    """Fate of every line ``(line, value)``, with its reason (null for candidates) and event; each line is parsed once for its kind, once for its fields."""
    read = lines.select("line", "value", json_kind(F.col("value")).alias("kind"), F.json_tuple("value", "event", "event_type", "dir").alias("event", "event_type", "dir"))
    kind, event = F.col("kind"), F.lower(F.coalesce("event", "event_type", F.lit("")))
    # The two candidate events of a native log.
    candidate = (event == "object") | ((event == "zdo") & F.coalesce(F.lower("dir") == "send", F.lit(False)))
    fate = ladder((F.trim("value") == "", "ignored"), (kind.isNull(), "anomaly"), (~kind.startswith("OBJECT"), "anomaly"),
                  (candidate, "candidate"), default="ignored")
    reason = ladder((F.trim("value") == "", "blank_line"), (kind.isNull(), "malformed_json"), (~kind.startswith("OBJECT"), "root_not_object"),
                    (candidate, None), default="non_candidate_event")
    return read.select("line", "value", fate.alias("fate"), reason.alias("reason"), event.alias("event"))


def split_candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every line ``(line, value)`` is a candidate, ignored with a reason, or an anomaly with its raw text; to count them take ``judged_candidates``."""
    judged = judged_candidates(lines)
    return (judged.filter("fate = 'candidate'").select("line", "event", "value"),
            judged.filter("fate = 'ignored'").select("line", "reason", "event"),
            judged.filter("fate = 'anomaly'").select("line", "reason", F.col("value").alias("raw")))


def recent_files(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """The newest files of a directory by modification time, in name order."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return files.orderBy(F.col("modificationTime").desc(), "path").limit(max(1, max_files)).orderBy("path")


def scan_recent_files(spark: SparkSession, path: str, max_files: int = 8, max_rows: int = 20_000) -> DataFrame:
    """Lines of the newest files in name and line order, up to a total row limit; ``max_files`` is a small number."""
    names = [r["path"] for r in recent_files(spark, path, max_files).select("path").collect()]
    if not names:
        return spark.createDataFrame([], "file string, line bigint, value string, row bigint")
    rows = ordered(_numbered_lines(spark, names).filter(F.trim("value") != ""), [], ["path", "line"]).scan(row=position()).df
    return rows.filter(F.col("row") <= max_rows).drop("path")


# Chat message types that carry content.
CONTENT_TYPES = ["Default", "Reply"]


def read_chat_exports(spark: SparkSession, path: str) -> DataFrame:
    """Chat export documents, one per file."""
    author = "struct<name:string,nickname:string>"
    schema = (f"channel struct<id:string,type:string,category:string,name:string>, "
              f"messages array<struct<id:string,type:string,timestamp:string,content:string,author:{author}>>")
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))


def explode_messages(docs: DataFrame, operator: str = "") -> DataFrame:
    """One row per content message: thread name from the channel or the file stem, the operator's own left out."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = docs.select(F.coalesce(F.nullif("channel.name", F.lit("")), stem).alias("thread"), F.explode("messages").alias("m"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    shown = F.coalesce(F.nullif(text("m.author.nickname"), F.lit("")), F.nullif(text("m.author.name"), F.lit("")), F.lit("unknown"))
    own = F.lit(False) if not operator else (F.lower(text("m.author.name")) == operator.lower()) | (F.lower(text("m.author.nickname")) == operator.lower())
    return rows.filter(F.col("m.type").isin(CONTENT_TYPES) & ~own & F.col("m.id").isNotNull()).select(
        "thread", "m.id", F.col("m.timestamp").alias("at"), shown.alias("author"), F.col("m.content").alias("content"))


def scan_sheet_rows(df: DataFrame, row: str, columns: list[str], expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """Positional columns of a sheet export under their own names; a header that differs is an anomaly, not a failure.

    ``df`` has the row number and the cells in order; row 1 is the header.
    """
    cells = [c for c in df.columns if c != row]
    named = df.select(row, *[F.col(c).alias(n) for c, n in zip(cells, columns)])
    header = F.array(*[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in cells[:len(expected)]])
    wanted = F.array(*[F.lit(e.lower()) for e in expected])
    anomalies = df.filter(F.col(row) == 1).select(F.lit("header_mismatch").alias("kind"), F.col(row).alias("row"), header.alias("found")) \
        .filter(F.col("found") != wanted)
    blank = reduce(lambda a, b: a & b, [F.trim(F.coalesce(F.col(n), F.lit(""))) == "" for n in columns[:len(cells)]])
    return named.filter((F.col(row) > 1) & ~blank), anomalies


def union_sources(sources: dict[str, DataFrame | None], known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of all sources under one schema, and violations: unknown kinds and ids used twice.

    A missing optional source (None) is skipped. Callers order by id when they write.
    """
    parts = [df.withColumn("origin", F.lit(name)) for name, df in sources.items() if df is not None]
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    twice = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate_id").alias("rule"), F.col("id").cast("string").alias("key"))
    odd = records.filter(~F.col("kind").isin(known)).select(F.lit("unknown_kind").alias("rule"), F.col("id").cast("string").alias("key"))
    return records, twice.unionByName(odd)


def window_export(logs: DataFrame, receipts: DataFrame, pad: int = 45_000_000) -> tuple[DataFrame, DataFrame]:
    """Log rows inside the padded time window of a run's receipts, and a count per run and file.

    ``logs``: ``(file, at, ...)``, ``receipts``: ``(run_id, at)``. Windows meet log rows through time buckets as wide as
    the mean window.
    """
    bounds = receipts.groupBy("run_id").agg((F.min("at") - pad).alias("lo"), (F.max("at") + pad).alias("hi"))
    width = max(1, int(bounds.agg(F.avg(F.col("hi") - F.col("lo"))).first()[0] or 1))
    spread = bounds.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    rows = (logs.withColumn("__b", F.floor(F.col("at") / width)).join(spread, "__b")
            .filter(F.col("at").between(F.col("lo"), F.col("hi"))).drop("__b"))
    files = logs.select("file").distinct()
    counts = rows.groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("rows"))
    # files without a row in a window are listed with 0; there are few files per run directory
    listed = bounds.select("run_id", "lo", "hi").withColumn("files", files.agg(F.array_sort(F.collect_set("file"))).scalar()) \
        .select("run_id", "lo", "hi", F.explode("files").alias("file"))
    return rows.drop("lo", "hi"), listed.join(counts, ["run_id", "file"], "left").na.fill(0, ["rows"])


def runs_without_receipts(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Runs that cannot be bounded."""
    return runs.join(receipts, "run_id", "left_anti").select("run_id", F.lit("no_receipts").alias("rule"))
