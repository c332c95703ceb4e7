"""Mixture-controlled packing: deficit round-robin over source queues into windows of equal length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidegauge.llm.common import mapped, written
from tidegauge.llm.tokens import encoder
from tidegauge.runtime import cut_lineage

WINDOW = 2048
#: Tokens a queue is served at once; a smaller entitlement is carried as a deficit until it is worth a turn.
BURST = 128
#: Sources with a queue of their own (the largest); all others share this many further queues.
OWN_QUEUES, SHARED_QUEUES = 192, 64
#: Rows of (task, source) starts that may be broadcast, with names under 256 characters: some 15 MB at most.
STARTS_BROADCAST = 50_000
#: Ids that are placed at once, in bytes.
CHUNK = 2 << 20
#: Bytes of texts whose words are looked up at once.
TEXTS = 6 << 20
GOLDEN = 0.6180339887498949


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, key, part, before, n, ids``: ids of each text and ``end_id``; ``before`` counts the tokens of the same source
    earlier in the same task, ``part`` is that task. ``key`` stands for the source (null has one of its own)."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = tool.kind.type(end_id)
        for batch in batches:
            for piece in _slices(batch, TEXTS):
                found, counts = tool.encode_column(piece.column(2))
                sizes = counts + 1
                ids = np.insert(found, np.cumsum(counts), end)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * tool.kind.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                before = []
                for source, n in zip(piece.column(1).to_pylist(), sizes.tolist()):
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + n
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(0), "key": piece.column(1), "part": pa.array(np.full(len(sizes), part, np.int32)),
                    "before": pa.array(before, pa.int64()), "n": pa.array(sizes, pa.int64()), "ids": raw})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    return mapped(rows, encode, "doc_id bigint, key string, part int, before bigint, n bigint, ids binary")


def _slices(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose last column holds at most ``most`` bytes; a larger row is a run of its own."""
    size = start = 0
    for n, value in enumerate(batch.column(batch.num_columns - 1)):
        own = value.as_buffer().size if value.is_valid else 0
        if size and size + own > most:
            yield batch.slice(start, n - start)
            start, size = n, 0
        size += own
    if start < batch.num_rows:
        yield batch.slice(start)


@dataclass
class Rounds:
    """The service order of the queues in closed form.

    In every round queue q earns length_q / rounds tokens, so that all queues end together and every round has the mixture of the
    whole. What it has earned is served in whole bursts; the rest stays as its deficit. The first deficits are staggered
    so that small queues take turns. ``served(q, w)`` is what q got in the first w rounds, so any task knows where any token
    goes from the queue lengths alone, and nothing is carried by hand between tasks.
    """

    lengths: np.ndarray
    burst: int = BURST
    window: int = WINDOW

    def __post_init__(self) -> None:
        self.rounds = int(min(max(1, -(-int(self.lengths.sum()) // self.window)), 1 << 31))
        self.whole, self.part = self.lengths // self.rounds, self.lengths % self.rounds
        self.head_start = (self.burst * ((np.arange(len(self.lengths)) * GOLDEN) % 1.0)).astype(np.int64)

    def served(self, q, w) -> np.ndarray:
        earned = self.whole[q] * w + self.part[q] * w // self.rounds
        turns = (earned + self.head_start[q]) // self.burst * self.burst
        return np.where(w >= self.rounds, self.lengths[q], np.where(w <= 0, 0, np.minimum(turns, self.lengths[q])))

    def places(self, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The round in which burst ``k`` of queue ``q`` is served, and the place of its first token in the whole stream."""
        need = np.minimum((k + 1) * self.burst, self.lengths[q])
        w = np.floor((need - self.head_start[q]) / np.maximum(self.lengths[q], 1) * self.rounds).astype(np.int64)
        w = np.clip(w, 0, self.rounds - 1)
        while (late := self.served(q, w) >= need).any():
            w = w - late
        while (early := self.served(q, w + 1) < need).any():
            w = w + early
        place = np.empty(len(q), np.int64)
        every = np.arange(len(self.lengths))
        step = max(1, CHUNK // max(1, len(every)))
        for a in range(0, len(q), step):
            own, at = q[a:a + step, None], w[a:a + step, None]
            place[a:a + step] = self.served(every[None, :], at + (every[None, :] < own)).sum(axis=1)
        return w, place + k * self.burst - self.served(q, w)

    def pieces(self, q: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, first token in the row, length, and place in the stream of each piece of the given runs of queues."""
        first, last = start // self.burst, (start + size - 1) // self.burst
        count = last - first + 1
        row = np.repeat(np.arange(len(q)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        _, place = self.places(q[row], k)
        low = np.maximum(start[row], k * self.burst)
        length = np.minimum(start[row] + size[row], (k + 1) * self.burst) - low
        place = place + low - k * self.burst
        joined = np.concatenate([[False], (row[1:] == row[:-1]) & (place[1:] == place[:-1] + length[:-1])])
        heads = np.flatnonzero(~joined)
        row, low, place, length = row[heads], low[heads], place[heads], np.add.reduceat(length, heads)
        cuts = (place + length - 1) // self.window - place // self.window + 1
        at = np.repeat(np.arange(len(row)), cuts)
        n = np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.maximum(place[at], (place[at] // self.window + n) * self.window)
        end = np.minimum(place[at] + length[at], (place[at] // self.window + n + 1) * self.window)
        return row[at], low[at] - start[row[at]] + begin - place[at], end - begin, begin


def queues(totals: DataFrame) -> DataFrame:
    """``key, queue`` for ``(key, tokens)``: the largest sources have a queue each, the others share queues by hash."""
    top = [r["key"] for r in totals.orderBy(F.desc("tokens"), "key").limit(OWN_QUEUES).collect()]
    own = totals.sparkSession.createDataFrame([(k, n) for n, k in enumerate(sorted(top))], "key string, own int")
    return totals.join(F.broadcast(own), "key", "left").select(
        "key", F.coalesce("own", F.lit(OWN_QUEUES) + F.pmod(F.xxhash64("key"), F.lit(SHARED_QUEUES))).cast("int").alias("queue"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, burst: int = BURST, end_id: int = 1) -> DataFrame:
    """``doc_id, source_key, start, length, doc_tokens, sequence_id, offset, ids``: the pieces of all documents in their windows.

    Every source is a queue of tokens; the queues are merged by deficit round-robin (:class:`Rounds`) to the mixture of the
    whole corpus and the merged stream is cut every ``window`` tokens, so only the last sequence is short. ``ids`` are the piece's
    ids, little-endian unsigned 32-bit.

    Texts are tokenized once into a table in the shared folder; a second pass places them. Ids are not shuffled unless the
    table of (task, source) starts is too large to broadcast. At most ``OWN_QUEUES + SHARED_QUEUES`` numbers are collected.

    Null or empty text: the end id alone. Null source: a source of its own. Repeated rows and ids are packed each. An
    empty table gives no rows. Other columns are not read. A long text is cut, never shortened.
    """
    spark = docs.sparkSession
    rows = written(tokenized(docs, path, end_id))
    parts = cut_lineage(rows.groupBy("key", "part").agg(F.sum("n").alias("tokens")))
    named = cut_lineage(queues(parts.groupBy("key").agg(F.sum("tokens").alias("tokens"))))
    before = W.partitionBy("queue").orderBy("key", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(parts.join(named, "key").withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))))
    found = starts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()
    lengths = np.zeros(OWN_QUEUES + SHARED_QUEUES, np.int64)
    for r in found:
        lengths[r["queue"]] = r["tokens"]
    used = np.flatnonzero(lengths)
    number = np.zeros(len(lengths), np.int64)
    number[used] = np.arange(len(used))
    order = spark.sparkContext.broadcast((number, Rounds(lengths[used], burst, window)))
    wide = encoder(path).kind

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rounds = order.value
        for batch in batches:
            for part in _slices(batch):
                doc, key = part.column(0), part.column(1)
                queue, start, size = (part.column(c).to_numpy() for c in (2, 3, 4))
                row, low, length, at = rounds.pieces(number[queue], start, size)
                raw = [np.frombuffer(x.as_buffer(), wide).astype("<u4").tobytes() for x in part.column(5)]
                ids = [raw[r][4 * a:4 * (a + n)] for r, a, n in zip(row.tolist(), low.tolist(), length.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": doc.take(row), "source_key": key.take(row), "start": low, "length": length, "doc_tokens": size[row],
                    "sequence_id": at // rounds.window, "offset": at % rounds.window, "ids": pa.array(ids, pa.binary())})
    first = starts.select("key", "part", "queue", "first")
    if first.count() <= STARTS_BROADCAST and not first.filter(F.length("key") >= 256).limit(1).count():
        first = F.broadcast(first)  # else both sides are shuffled, ids included
    placed = rows.join(first, ["key", "part"]).select(
        "doc_id", "key", "queue", (F.col("first") + F.col("before")).alias("start"), "n", "ids")
    return mapped(placed, place, "doc_id bigint, source_key string, start bigint, length bigint, doc_tokens bigint, "
                                 "sequence_id bigint, offset bigint, ids binary")
