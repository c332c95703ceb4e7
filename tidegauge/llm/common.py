"""Shared pieces of the corpus operators: reading tables, fixed splits, global prefix sums, tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidegauge import runtime
from tidegauge.runtime import cut_lineage, written  # noqa: F401 - written is taken from here by the operators

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(key: str | Column, parts: int) -> Column:
    """``crc32`` of the key's text modulo ``parts``; a null key counts as empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return (F.crc32(F.encode(text, "utf-8")) % parts).cast("int")


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the workers."""
    runtime.ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def global_prefix(rows: DataFrame, order: list[Column | str], **values: Column) -> tuple[DataFrame, dict[str, int]]:
    """Exclusive prefix sums over all rows in ``order``, and the grand totals.

    The rows are range-partitioned once and cut; each partition sums its values, the few partition totals are summed up
    in order, and rows add their partition's start to a running sum inside it. No task sees more than one range. Equal
    order keys stay in one range, so ``order`` should name enough columns to tell rows apart.
    """
    rows = rows.withColumns({f"__v_{k}": v.cast("bigint") for k, v in values.items()})
    parts = cut_lineage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    ends = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(sums.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(ends), F.lit(0)).alias(f"__s_{k}") for k in values],
                                     *[F.col(f"__t_{k}") for k in values]))
    total = starts.agg(*[F.sum(f"__t_{k}").alias(k) for k in values]).first()
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(starts.select("__part", *[f"__s_{k}" for k in values]), "__part").withColumns(
        {k: F.col(f"__s_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in values})
    drop = ["__part", *[f"__{c}_{k}" for k in values for c in "vs"]]
    return out.drop(*drop), {k: int(total[k] or 0) for k in values}
