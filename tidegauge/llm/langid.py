"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.llm.common import mapped

ORDERS = (1, 2, 3)
#: Buckets per n-gram order.
BUCKET_BITS = 14
#: Largest log-probability matrix that is broadcast, in bytes.
MATRIX_BYTES = 256 << 20
#: Languages whose counts a task holds before it hands them on.
HELD = 64
#: Characters that are scored at once.
CHUNK = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """UTF-16 unit -> lower-case letter, or a space for anything else; halves of characters beyond 16 bits stay."""
    out = np.full(1 << 16, 32, np.uint16)
    for unit in range(1 << 16):
        if 0xD800 <= unit < 0xE000:
            out[unit] = unit
        elif chr(unit).isalpha():
            low = ord(chr(unit).lower()[0])
            out[unit] = low if low < 1 << 16 else unit
    return out


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in one array, each text within two spaces on either side; and where each text starts."""
    padded = ["  " + t + "  " for t in texts]
    raw = [np.frombuffer(t.encode("utf-16-le", "replace"), np.uint16) for t in padded]
    starts = np.cumsum([0, *map(len, raw)])
    return _letters()[np.concatenate(raw)], starts[:-1]


def ngrams(letters: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each position (spaces follow the last)."""
    count = len(letters)
    wide = np.concatenate([letters, np.full(order - 1, 32, letters.dtype)]).astype(np.uint32)
    mixed = wide[:count] * np.uint32(0x9E3779B1)
    for k in range(1, order):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) + wide[k:k + count]
    mixed *= np.uint32(0xC2B2AE3D)
    return (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about CHUNK characters; a longer text is a run of its own."""
    start = size = 0
    for n, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield start, n
            start, size = n, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class NaiveBayes:
    """Log-probabilities per language and bucket, and log priors; ``langs`` in code point order."""

    langs: list[str]
    prior: np.ndarray
    logp: list[np.ndarray]
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probability, one row a text and one column a language, sums over n-grams in numpy."""
        out = np.tile(self.prior, (len(texts), 1))
        for a, b in chunks(texts):
            letters, starts = units(texts[a:b])
            for order, table in zip(ORDERS, self.logp):
                at = ngrams(letters, order, self.bits)
                for k in range(len(self.langs)):
                    out[a:b, k] += np.add.reduceat(table[k][at], starts, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most probable language and its posterior. The evidence counts as if a text had at most 40 n-grams, because
        neighbouring n-grams are far from independent; texts without a letter are ``und`` with score 0."""
        names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [n for n, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not known or not self.langs:
            return names, sure
        joint = self.scores([texts[n] for n in known])
        size = np.array([3.0 * (len(texts[n]) + 4) for n in known])
        tempered = (joint - joint.max(axis=1, keepdims=True)) * np.minimum(1, 40 / size)[:, None]
        chance = np.exp(tempered)
        chance /= chance.sum(axis=1, keepdims=True)
        best = joint.argmax(axis=1)
        for row, n in enumerate(known):
            names[n], sure[n] = self.langs[best[row]], chance[row, best[row]]
        return names, sure


def _counted(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        docs: dict[str, int] = {}

        def flush():
            for lang, tables in held.items():
                for order, counts in zip(ORDERS, tables):
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "ord": pa.array([order] * len(at), pa.int32()),
                                                      "bucket": pa.array(at, pa.int32()), "n": counts[at]})
                yield pa.RecordBatch.from_pydict({"lang": [lang], "ord": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()),
                                                  "n": pa.array([docs[lang]], pa.int64())})
            held.clear()
            docs.clear()
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts) if x == lang]
                tables = held.setdefault(lang, [np.zeros(1 << bits, np.int64) for _ in ORDERS])
                docs[lang] = docs.get(lang, 0) + len(own)
                for a, b in chunks(own):
                    letters, _ = units(own[a:b])
                    for order, counts in zip(ORDERS, tables):
                        counts += np.bincount(ngrams(letters, order, bits), minlength=1 << bits)
                if len(held) > HELD:
                    yield from flush()
        yield from flush()
    return count


def train(docs: DataFrame, learn: Column, bits: int = BUCKET_BITS, smoothing: float = 0.5) -> NaiveBayes:
    """Fits on all rows where ``learn`` holds and text and lang are not null.

    Tasks count n-grams locally; only non-zero counts per (language, bucket) are shuffled and summed, and at most
    languages x buckets of them reach the driver. With so many languages that the matrix would pass ``MATRIX_BYTES``,
    fewer buckets are used.
    """
    rows = docs.filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = rows.select(F.count_distinct("lang")).first()[0]
    while found * len(ORDERS) * 4 << bits > MATRIX_BYTES and bits > 8:
        bits -= 1
    if found * len(ORDERS) * 4 << bits > MATRIX_BYTES:
        raise ValueError(f"{found} languages: too many for one matrix")
    counts = mapped(rows, _counted(bits), "lang string, ord int, bucket int, n bigint").groupBy("lang", "ord", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    row = np.array([{x: k for k, x in enumerate(langs)}[x] for x in names], np.int64)
    order, bucket, n = (counts.column(c).to_numpy() for c in ("ord", "bucket", "n"))
    prior = np.ones(len(langs))
    prior[row[order == 0]] = n[order == 0]
    logp = []
    for k in ORDERS:
        table = np.full((len(langs), 1 << bits), smoothing)
        of = order == k
        table[row[of], bucket[of]] += n[of]
        logp.append(np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))
    return NaiveBayes(langs, np.log(prior / max(prior.sum(), 1)), logp, bits)


def identify(docs: DataFrame, model: NaiveBayes, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus the predicted language and its score under ``names``; only the text is looked at. Columns of these
    names are replaced.

    Null text, or one without any letter: ``und``, score 0. Equal probabilities go to the first language in code point
    order. A model without languages answers ``und``. Whole texts are scored, a long one in a run of its own.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sure = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(sure, pa.float64())],
                                             [*batch.schema.names, *names])
    return mapped(docs, label, schema)
