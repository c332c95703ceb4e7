"""Language-model scores of whole documents: corpus counts, a recurrent model, and exact counts for rare words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm import gru
from tidegauge.llm.common import mapped, written

#: Most frequent words whose counts every task gets; counts of all others are joined.
HEAD = 100_000
#: Distinct words a task counts before it hands the counts on.
HELD = 400_000
#: Tokens of the training documents that a replica of the recurrent model is fitted on.
REPLICA_TOKENS = 2_000_000
#: Documents of the common start of all replicas.
WARM_DOCS = 512
#: Tokens that are scored or trained on at once.
CHUNK = 1_500_000
TRAIN_CHUNK = 1_000_000


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush():
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "c": pa.array(held.values(), pa.int64())})
        held.clear()
    for batch in batches:
        for text in batch.column(0):
            held.update(tokens_of(text.as_py()))
            if len(held) > HELD:
                yield from flush()
        held[b""] += batch.num_rows  # the end of a text is the empty word
    yield from flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all whole texts, end tokens as the empty word; counted in each task before the shuffle."""
    counts = mapped(texts, _count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    return written(counts.filter("c > 0"))


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """The ``most`` words of largest count (then bytes). Counts per power of two show first from which count on they can
    lie, so that only few more rows than are wanted are sorted."""
    power = F.floor(F.log2("c")).cast("int")
    sizes = sorted(((r["p"], r["n"]) for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    seen, least = 0, 0
    for least, n in sizes:
        seen += n
        if seen >= most:
            break
    return counts.filter(power >= least).orderBy(F.desc("c"), "word").limit(most).toArrow()


@dataclass
class Vocabulary:
    """The most frequent words by falling count (then bytes), and their counts; ids of the recurrent model follow the rank."""

    rank: dict[bytes, int]
    log_count: np.ndarray
    end_log: float

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each word (-1: not among them), and its id in the model."""
        rank = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))
        return rank, np.where((rank >= 0) & (rank < gru.VOCABULARY - 2), rank + 2, gru.OTHER).astype(np.int32)


def _groups(sized: Iterator[tuple[object, np.ndarray]], limit: int) -> Iterator[list]:
    held, size = [], 0
    for item in sized:
        held.append(item)
        size += len(item[1]) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _trainer(vocabulary, start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, squares = start[:gru.SIZE].copy(), start[gru.SIZE:].copy()
        model, seen = gru.Model(flat), 0
        texts = ((None, vocabulary.value.read(tokens_of(t.as_py()))[1]) for b in batches for t in b.column(0))
        for group in _groups(texts, TRAIN_CHUNK):
            model.train([ids for _, ids in group], squares)
            seen += sum(len(ids) + 1 for _, ids in group)
        both = np.concatenate([model.flat, squares]).astype(np.float64) * seen
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, len(both)), pa.int32()),
                                          "value": pa.array(np.concatenate([[seen], both]), pa.float64())})
    return run


def _averaged(texts: DataFrame, vocabulary, start: np.ndarray) -> np.ndarray:
    """Every partition trains a replica from ``start``; the result is their mean by tokens. As many numbers as the model has
    reach the driver, whatever the number of replicas."""
    sums = np.zeros(2 * gru.SIZE + 1)
    for r in mapped(texts, _trainer(vocabulary, start), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().to_batches():
        sums[r.column(0).to_numpy() + 1] = r.column(1).to_numpy()
    return (sums[1:] / sums[0]).astype(np.float32) if sums[0] else start


def _scorer(vocabulary, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lm = vocabulary.value, gru.Model(model.value)
        base, number = TaskContext.get().partitionId() << 33, 0

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    tokens = tokens_of(text.as_py())
                    rank, ids = words.read(tokens)
                    head = rank >= 0
                    other = head & (ids == gru.OTHER)
                    rare = Counter(tokens[n] for n in np.flatnonzero(~head))
                    yield (doc, len(tokens) + 1, int(head.sum()), float(words.log_count[rank[head]].sum()), int((ids == gru.OTHER).sum()),
                           float(words.log_count[rank[other]].sum()), rare), ids
        for group in _groups(rows(), CHUNK):
            scores = lm.score([ids for _, ids in group])
            docs, n, head, head_log, others, other_log, rare = zip(*[facts for facts, _ in group])
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.arange(number, number + len(docs)) + base, pa.int64()), "doc_id": pa.array(docs, pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "head": pa.array(head, pa.int64()), "head_log": pa.array(head_log, pa.float64()),
                "others": pa.array(others, pa.int64()), "other_log": pa.array(other_log, pa.float64()), "model_log": pa.array(scores, pa.float64()),
                "rare": pa.array([list(r.keys()) for r in rare], pa.list_(pa.binary())),
                "times": pa.array([list(r.values()) for r in rare], pa.list_(pa.int64()))})
            number += len(docs)
    return run


def lm_scores(docs: DataFrame, learn: Column, seed: int = 5) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row; only rows where ``learn`` holds are learned from.

    ``base_score`` is the smoothed unigram log10 probability from the counts of all training tokens. ``score`` is that of the
    recurrent model over the most frequent words, a class for all others, and the smoothed counts among those; its state runs
    through the whole document.

    Counts cover all training texts. The model starts from ``WARM_DOCS`` documents; then all training documents train replicas of
    about ``REPLICA_TOKENS`` tokens each, which are averaged. The ``HEAD`` most frequent words go to all tasks; the counts of rarer ones are joined, once per document
    and word, so no task holds the vocabulary.

    Null or empty text: the end token only. Repeated rows each get a result. With nothing to learn from, counts are zero and the
    model is untrained. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    training = docs.filter(learn)
    counts = word_counts(training.select(text))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counts.filter(F.length("word") > 0), HEAD)
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    ends = counts.filter(F.length("word") == 0).first()
    ends = ends["c"] if ends else 0
    vocabulary = spark.sparkContext.broadcast(Vocabulary({w: n for n, w in enumerate(words)}, np.log10(c + 0.5), float(np.log10(ends + 0.5))))
    modelled = min(len(words), gru.VOCABULARY - 2)
    mass = float(total - ends - int(c[:modelled].sum()) + 0.5 * (distinct - (ends > 0) - modelled) + 0.5)

    dealt = F.xxhash64(F.lit(seed), "doc_id")
    flat = np.concatenate([gru.initial(seed), np.zeros(gru.SIZE, np.float32)])
    if total:
        few = min(1 << 30, -(-(1 << 30) * 3 * WARM_DOCS // max(1, ends)))  # a share that holds some more than are wanted
        warm = training.filter(F.pmod(dealt, F.lit(1 << 30)) < few).select(text, dealt.alias("h")).orderBy("h", "text").limit(WARM_DOCS).select("text").coalesce(1)
        flat = _averaged(warm, vocabulary, flat)
        replicas = max(1, round(total / REPLICA_TOKENS))
        flat = _averaged(training.select(text).repartition(replicas), vocabulary, flat)
    model = spark.sparkContext.broadcast(flat[:gru.SIZE])

    facts = written(mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text), _scorer(vocabulary, model),
                           "row bigint, doc_id bigint, n_tokens bigint, head bigint, head_log double, others bigint, other_log double, "
                           "model_log double, rare array<binary>, times array<bigint>"))
    single = facts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = single.join(counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    rare = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_log"),
                                  F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare_log, end_log = F.coalesce("rare_log", F.lit(0.0)), float(np.log10(ends + 0.5))
    all_log = float(np.log10(total + 0.5 * (distinct + 1)))
    return facts.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("head") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("head_log") + rare_log + end_log - F.col("n_tokens") * all_log).alias("base_score"),
        (F.col("model_log") + F.col("other_log") + rare_log - F.col("others") * float(np.log10(mass))).alias("score"))
