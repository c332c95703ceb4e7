"""Session helpers: sizes that are checked before use, lineage cuts, settings."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A group at or under this many rows may be sorted by one task.
GROUP_ROWS = "tidegauge.groupRows"
#: A side at or under this many rows may be broadcast.
BROADCAST_ROWS = "tidegauge.broadcastRows"

#: A replayed table at or under this many rows is one micro-batch; a larger one comes in micro-batches of that size.
REPLAY_ROWS = "tidegauge.replayRows"

DEFAULTS = {GROUP_ROWS: 2_000_000, BROADCAST_ROWS: 200_000, REPLAY_ROWS: 5_000_000}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(DEFAULTS[name])))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which driver and executors share.

    A folder of our own is made only where the session names none and everything runs on this machine (tests, local runs).
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder: executors may be lost between rounds of an iterative job."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, columns pruned on each read, safe when executors go.

    Its size is that of its files. A checkpoint keeps the estimate of its plan, in which each join multiplies: over rounds that join what
    earlier rounds made, the digits of that number double or more each round, until the driver is filled by it. Such rounds are written.
    """
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that it needs no installation on the executors."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_tidegauge_shipped", False) or not root.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    context._tidegauge_shipped = True


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint, given only after the row count was found within the limit."""
    limit = limit or setting(df.sparkSession, BROADCAST_ROWS)
    return F.broadcast(df) if df.count() <= limit else df


def counted_side(df: DataFrame) -> DataFrame:
    """As ``small_side``, and beyond the limit a hint to shuffle: Spark takes what a Python function or an explode makes of a small table to be
    small too, and would broadcast it whatever its rows."""
    return F.broadcast(df) if df.count() <= setting(df.sparkSession, BROADCAST_ROWS) else df.hint("merge")


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A fixed list of rules or definitions as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def ladder(*rules: tuple[Column, object], default: object = None) -> Column:
    """First matching rule wins."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default)
