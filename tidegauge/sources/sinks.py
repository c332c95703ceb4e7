"""Writers: append-only events, snapshots that replace a changelog, extracts for other tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.runtime import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name on the storage the cluster names for shared work; a local one only where none is named."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def append_event(events: DataFrame, path: str) -> DataFrame:
    """Append valid events and return the refused ones. ``event_id`` and ``event_type`` are required, payload defaults to {}."""
    def blank(c: str):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    refused = events.filter(blank("event_id") | blank("event_type"))
    good = events.filter(~blank("event_id") & ~blank("event_type")).withColumn("payload", F.coalesce("payload", F.lit("{}")))
    good.write.mode("append").parquet(path)
    return refused


def write_snapshot(state: DataFrame, path: str, order: list[str], version: int) -> str:
    """Write the current state as a new version, sorted by key, and publish it by one append to the pointer table.

    Readers follow the pointer, so they see the old state or the new one, never a mix; a job that dies half-way leaves
    the pointer as it was.
    """
    target = f"{path}/state/version={version}-{uuid.uuid4().hex}"
    state.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(target)
    pointer = state.sparkSession.createDataFrame([(version, target)], "version bigint, location string")
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return target


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest published version."""
    latest = spark.read.parquet(f"{path}/pointer").orderBy(F.col("version").desc(), F.col("location").desc()).first()
    return spark.read.parquet(latest["location"])


def write_extract(df: DataFrame, path: str, fmt: str, fields: list[str]) -> None:
    """JSON, CSV or tab-separated files with a fixed field order; tabs are taken out of tab-separated texts."""
    out = df.select(*fields)
    if fmt == "json":
        out.write.json(path)
    elif fmt == "csv":
        out.write.option("header", True).csv(path)
    elif fmt == "tsv":
        texts = {c: F.regexp_replace(c, "[\t\r\n]", " ") for c, t in out.dtypes if t == "string"}
        (out.withColumns(texts) if texts else out).write.option("sep", "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")
