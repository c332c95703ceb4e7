"""SimHash near-duplicates: pigeonring candidates, exact Hamming check, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidegauge.llm.common import mapped
from tidegauge.operators.graph import connected_components
from tidegauge.runtime import cut_lineage

BITS = 64
#: Fingerprints in one bucket that are compared pair by pair; larger buckets are linked through shared neighbours.
PAIRWISE = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of XXH64 over the word shingles of one text, as an unsigned number."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles: Iterator[bytes] = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)]))
    return majority(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8))


def majority(digests: np.ndarray) -> int:
    """Bits that are set in over half of the digests, 8 bytes each, as an unsigned number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), BLOCK):
        ones += np.unpackbits(digests[at:at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed BIGINT. Null and empty texts have fingerprint 0."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(texts, compute, "doc_id bigint, fp bigint")


def _rotated(value: str, bits: int) -> Column:
    """``value`` with its top ``bits`` moved to the end."""
    if not bits:
        return F.col(value)
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, BITS - bits))


def ring_keys(marks: DataFrame, segments: int, distance: int) -> tuple[DataFrame, int]:
    """Each fingerprint once per ring position: ``fp, at, turned, chain``; and the number of bits in ``chain``.

    The fingerprint is a ring of ``segments`` equal parts. If two differ in at most ``distance`` bits then from some
    position every chain of k parts differs in at most k * distance / segments bits. While that budget is below one the
    parts must be equal, so the longest such chain is an equi-join key.
    """
    width, free = BITS // segments, -(-segments // distance) - 1
    turned = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), _rotated("fp", n * width).alias("turned")) for n in range(segments)]))
    keyed = marks.select("fp", turned.alias("t")).select("fp", "t.at", "t.turned")
    return keyed.withColumn("chain", F.shiftrightunsigned("turned", BITS - free * width)), free * width


def within_budget(difference: Column, segments: int, distance: int) -> Column:
    """All chains from this ring position keep their proportional budget."""
    width, tests, seen = BITS // segments, [], set()
    for length in range(segments, 0, -1):  # the longest chain with a budget implies the shorter ones with the same
        budget = length * distance // segments
        if budget not in seen:
            seen.add(budget)
            tests.append(F.bit_count(F.shiftrightunsigned(difference, BITS - length * width)) <= budget)
    out = tests[-1]
    for test in reversed(tests[:-1]):
        out = out & test
    return out


def links(marks: DataFrame, distance: int = 2, segments: int = 16, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges ``src, dst`` over distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``.

    Candidates share an exact chain (:func:`ring_keys`) and must keep the budgets of all longer chains before the full
    Hamming check. In a bucket of more than ``pairwise`` fingerprints no pairs are made: every member lists itself and the
    values ``distance / 2`` flips away outside the shared chain, and two members are within ``distance`` exactly if their
    lists meet, so each list entry is linked to its smallest member. Both ways are exact; neither grows with the square of
    a bucket. ``distance`` must be even.
    """
    if distance < 2 or distance % 2 or BITS % segments or segments <= distance:
        raise ValueError("distance must be even and positive, segments a divisor of 64 above it")
    keyed, fixed = ring_keys(marks, segments, distance)
    keyed = cut_lineage(keyed)
    sizes = keyed.groupBy("at", "chain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(sizes, ["at", "chain"]))
    small = shared.filter(F.col("n") <= pairwise).select("at", "chain", "fp", "turned")
    other = small.select("at", "chain", F.col("fp").alias("fp2"), F.col("turned").alias("turned2"))
    difference = F.col("turned").bitwiseXOR(F.col("turned2"))
    met = (F.col("a.at") == F.col("b.at")) & (F.col("a.chain") == F.col("b.chain")) & (F.col("fp") < F.col("fp2"))
    pairs = small.alias("a").join(other.alias("b"), met & within_budget(difference, segments, distance)).select(
        F.col("fp").alias("src"), F.col("fp2").alias("dst"))
    flips = [0, *[sum(1 << b for b in c) for k in range(1, distance // 2 + 1) for c in combinations(range(BITS - fixed), k)]]
    flips = [f - (1 << BITS) if f >= 1 << (BITS - 1) else f for f in flips]
    near = shared.filter(F.col("n") > pairwise).select(
        "fp", "at", F.explode(F.transform(F.array(*[F.lit(f).cast("bigint") for f in flips]), lambda f: F.col("turned").bitwiseXOR(f))).alias("value"))
    # members of one list entry differ from it by at most distance / 2 flips, so their number is bounded
    stars = near.select(F.col("fp").alias("src"), F.min("fp").over(W.partitionBy("at", "value")).alias("dst")).filter("src <> dst")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3, segments: int = 16, seed: int = 42,
                    pairwise: int = PAIRWISE) -> DataFrame:
    """``doc_id, fp, component_id``: documents linked when their fingerprints differ in at most ``distance`` bits.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the document's own included. Equal fingerprints are one
    node, so copies are never expanded into pairs; the graph work is on distinct fingerprints only.

    Null or empty text: fingerprint 0, linked like any other. Fewer words than a shingle: the whole sequence is one.
    Repeated rows each get a result row. Null ``doc_id`` is ignored when the smallest id is sought (null if no other).
    An empty table gives no rows. Extra columns are not read. Whole texts are used whatever their length.
    """
    marks = cut_lineage(fingerprints(docs, words, seed))
    distinct = cut_lineage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut_lineage(links(distinct.select("fp"), distance, segments, pairwise))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    linked = connected_components(ends, edges).join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first")
    best = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(best, "root").select("fp", "least")
    label = cut_lineage(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marks.join(label, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, groups: Callable[..., DataFrame] = near_duplicates, mark: Callable[[str | None], int] = fingerprint,
                **options) -> DataFrame:
    """``docs`` with one document of each group that ``groups`` gives, the one whose id is the group's.

    Rows that repeat an id are told apart by ``mark``: those of other groups go, and of those that have their group's id one stays (if
    ``groups`` names no ``root``, one for each ``mark``). Rows without an id go if a document with an id is in their group; of
    the others one stays for each ``mark``, or for each group if ``groups`` names its ``root``.
    """
    near = cut_lineage(groups(docs, **options))
    rooted = "root" in near.columns
    named = near.filter(F.col("doc_id") == F.col("component_id"))
    repeats = near.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    kept = docs.join(named.join(repeats, "doc_id", "left_anti").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    unnamed = F.col("component_id").isNull() & (F.col("fp") == F.col("root") if rooted else F.lit(True))
    open_marks = near.filter(unnamed).select(F.col("fp").alias("__fp")).distinct()
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([mark(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], [*batch.schema.names, "__fp"])
    if repeats.limit(1).count():
        chosen = named.join(repeats, "doc_id", "left_semi")
        chosen = chosen.groupBy("doc_id", "root").agg(F.min("fp").alias("__fp")) if rooted else chosen.select("doc_id", F.col("fp").alias("__fp")).distinct()
        marked = mapped(docs.join(repeats, "doc_id", "left_semi").select(*docs.columns), add, schema)
        kept = kept.unionByName(marked.join(chosen, ["doc_id", "__fp"], "left_semi").dropDuplicates(["doc_id", "__fp"]).select(*docs.columns))
    if not open_marks.limit(1).count():
        return kept
    nameless = mapped(docs.filter(F.col("doc_id").isNull()), add, schema)
    return kept.unionByName(nameless.join(open_marks, "__fp", "left_semi").dropDuplicates(["__fp"]).select(*docs.columns))
