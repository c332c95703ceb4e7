"""Contiguous shards of equal size, by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import global_prefix
from tidegauge.runtime import cut_lineage

#: Bytes a stored row costs besides its text.
ROW_BYTES = 16


def byte_shards(docs: DataFrame, shards: int = 40, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: documents in ``doc_id`` order, cut into ``shards`` runs of near equal bytes.

    Size is the UTF-8 length of the text plus ``row_bytes``. With the bytes of all earlier documents known from partition
    totals, a document goes to the shard in which its middle byte falls, so no shard is off its target by more than half
    the documents at its two ends. ``slot`` counts from 0 inside a shard.

    Null text: ``row_bytes`` only, checksum of the empty text. Null ``doc_id`` comes first. Rows with equal ``doc_id``
    follow one another by checksum and size; full repeats are all kept. An empty table gives no rows. Other columns are
    not read. Only DataFrame operations; texts are read once and never shuffled, only 30 bytes a row are.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(row_bytes)).cast("bigint").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32")))  # range sampling reads these, not the texts
    order = ["doc_id", "text_crc32", "size"]
    placed, total = global_prefix(rows, order, start=F.col("size"), place=F.lit(1))
    whole = 2 * max(1, total["start"])
    shard = F.expr(f"least({shards - 1}, ((2 * start + size) * {shards}) div {whole})").cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")))
