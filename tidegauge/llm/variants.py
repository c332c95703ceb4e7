"""Spelling variants: pairs of words at one edit, by frontiers of states that walk a trie held as a distributed edge table."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import mapped, written
from tidegauge.runtime import counted_side

#: Closes each word in the trie, so that no word is the start of another.
END = "$"
#: Different words a task counts before it hands them on.
COUNTED = 100_000
#: Rows that leave a task at once, about.
BATCH = 20_000


def word_counts(docs: DataFrame, least: int = 7, slip: int = 31) -> DataFrame:
    """``word, n``: how often each word of at least ``least`` letters occurs in all whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z lower-cased. Of an occurrence whose
    ``crc32("doc_id:word")`` is a multiple of ``slip``, the letter at that number modulo the length is left out. Words are counted
    inside the tasks before they are shuffled.

    Null and empty texts have no words; a null ``doc_id`` counts as empty text; repeated rows count each; bytes that are no UTF-8
    part words. Other columns are not read. An empty table gives no rows.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lower = text.as_py().encode().lower().decode()
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(map(re.Match.group, runs.finditer(lower))).items():
                    mark = zlib.crc32(word.encode(), start)
                    if mark % slip == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > COUNTED:
                    yield flushed(total)
                    total = Counter()
        if total:
            yield flushed(total)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    return mapped(texts.filter("text <> ''"), compute, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _paths(words: DataFrame) -> DataFrame:
    """``back, word, n, pos, node, next``: the trie nodes on each word's path, from a little before its middle.

    There is a trie of the words and one of the words read backwards. A node is the hash of the letters before it, ``next`` the
    code of the letter by which the word leaves it (``END`` at its end).
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for back in (False, True):
                    read, node = (word[::-1] if back else word) + END, xxhash.xxh64(seed=int(back))
                    first = max(0, len(word) - 1) // 2
                    node.update(read[:first].encode())
                    for pos in range(first, len(read)):
                        out.append((back, word, n, pos, node.intdigest() - (1 << 63), ord(read[pos])))
                        node.update(read[pos].encode())
                    if len(out) >= BATCH:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["back", "word", "n", "pos", "node", "next"])
    return mapped(words.select("word", "n"), compute, "back boolean, word string, n bigint, pos int, node bigint, next int")


def _read() -> Column:
    """A row's word as its trie reads it."""
    return F.concat(F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")), F.lit(END))


def _part(text: Column, start: Column, size: Column) -> Column:
    """``size`` letters from ``start``, counted from 0."""
    return F.substring(text, start + 1, size)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states without an edit, ``back, word, n, pos, node``, and the edge table, ``node, edges``.

    Nodes with one way on are left out, so an edge has a label of one letter or more and words share an edge where they
    share its letters. ``edges`` lists a node's edges ``(label, child, onward, target, target_n)``; the last two are set where a word ends,
    ``onward`` tells by which letters (their codes modulo 64, as bits) the child can be left. A node has no more edges than there are letters.
    """
    rows = _paths(words)
    forks = rows.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b"), F.bit_or(F.expr("shiftleft(1L, next % 64)")).alias("onward"))
    # there is a fork for every few rows: far more than the words' table lets Spark expect
    met = rows.drop("next").join(forks.filter("a <> b").select("node", "onward").hint("merge"), "node")
    path = written(met.groupBy("back", "word", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "onward"))).alias("path")))
    at, after = F.col("step"), F.get("path", F.col("i") + 1)
    size = F.coalesce(after["pos"], F.char_length("read")) - at["pos"]
    edge = F.struct(_part(F.col("read"), at["pos"], size).alias("label"), after["node"].alias("child"), after["onward"].alias("onward"),
                    F.when(after.isNull(), F.col("word")).alias("target"), F.when(after.isNull(), F.col("n")).alias("target_n"))
    steps = path.withColumn("read", _read()).select("*", F.posexplode("path").alias("i", "step"))
    edges = steps.select(at["node"].alias("node"), edge.alias("edge")).groupBy("node").agg(F.collect_set("edge").alias("edges"))
    states = path.select("back", "word", "n", F.explode("path").alias("step")).select(
        "back", "word", "n", "step.pos", "step.node").filter(F.col("pos") >= F.expr("char_length(word) div 2"))
    return states, written(edges)


def _advance(states: DataFrame, edges: DataFrame, first: bool) -> DataFrame:
    """One level: each state goes along its node's edges, by an edit on the edge's first letter if it is the ``first`` level.

    The edit is made where word and target first differ, so only edges that start with another letter than the word are taken
    then; afterwards all letters must agree. Of two words one finds the other: the shorter one by one more letter, of equal lengths the
    one whose letter comes first.
    """
    met = states.join(edges.hint("merge"), "node") if first else counted_side(states).join(edges, "node")
    met = met.withColumn("read", _read()).select("back", "word", "n", "pos", "read", F.explode("edges").alias("edge"))
    read, pos, label = F.col("read"), F.col("pos"), F.col("edge.label")
    size, rest = F.char_length(label), F.substring(label, F.lit(2), F.char_length(label) - 1)
    if first:
        letter, mine = F.substring(label, 1, 1), _part(read, pos, F.lit(1))
        met = met.filter(letter != mine)
        ends = F.array_compact(F.array(F.when((mine < letter) & (rest == _part(read, pos + 1, size - 1)), pos + size),  # another letter
                                       F.when(rest == _part(read, pos, size - 1), pos + size - 1)))  # one more letter
        met = met.withColumn("end", F.explode(ends))
    else:
        met = met.filter(label == _part(read, pos, size)).withColumn("end", pos + size)
    # a word goes on only where some word goes on by its next letter
    goes_on = F.expr("shiftright(edge.onward, ascii(substring(read, end + 1, 1)) % 64) & 1") == 1
    return met.filter(F.when(F.col("edge.target").isNotNull(), F.col("end") == F.char_length(read)).otherwise((F.col("end") < F.char_length(read)) & goes_on)).select(
        "back", "word", "n", F.col("end").alias("pos"), F.col("edge.child").alias("node"), "edge.target", "edge.target_n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of ``words`` (``word, n``, words distinct) at exactly one edit.

    States ``(word, pos, node, edits)`` are joined with the edge table, level by level, until none is left; one that reaches the end of
    word and target with one edit is a pair. A word's own path is in the trie, so all its states without an edit are known and
    enter at once. The half of a word before or behind the edit is equal in both; edits in the second half are found in the trie of the
    words, those in the first half in the trie of the words read backwards, so the frontier starts where the tries are thin.
    Levels are forks of the trie behind the middle of a word, not letters, and a state has at most as many ways on as there are
    letters. A pair is found from one of its words and given both ways. Nodes are hashes, so the pairs are checked once more, letter by letter.

    Words of any length, null words and an empty table are allowed; a null word is no one's neighbour.
    """
    words = words.filter("word is not null")
    states, edges = trie(words)
    found, level = [], 0
    while True:
        reached = written(_advance(states, edges, level == 0))
        found.append(reached.filter("target is not null"))
        states, level = reached.filter("target is null").select("back", "word", "n", "pos", "node"), level + 1
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    half = F.expr("char_length(word) div 2")
    in_front = F.substring("word", F.lit(1), half) != F.substring("target", F.lit(1), half)
    pairs = pairs.filter((~F.col("back") | in_front) & (F.levenshtein("word", "target", 1) == 1))
    both = F.array(F.struct(F.col("word"), F.col("target").alias("near"), F.col("target_n").alias("near_n")),
                   F.struct(F.col("target").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for links ``word, form`` without cycles, by pointer doubling."""
    roots = written(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(counted_side(beyond), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not roots.filter("moved").limit(1).count():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, slip: int = 31) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word with its likely right form.

    Words are those of :func:`word_counts` that occur ``occurrences`` times or more. A word's form is the most frequent of its
    :func:`neighbours` (of equal ones the first by code point), if it is ``ratio`` times as frequent or more, else null; ``root`` is the last form
    that is reached from form to form (the word itself if it has none). Counts rise by ``ratio`` from form to form, so there are
    few rounds. Nulls, repeated rows and empty tables as in :func:`word_counts`.
    """
    words = written(word_counts(docs, least, slip).filter(F.col("n") >= occurrences))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    far = F.col("best.near_n") >= ratio * F.col("n")
    named = written(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(far, F.col("best.near")).alias("form"),
        F.when(far, F.col("best.near_n")).alias("form_n")))
    roots = _roots(named.filter("form is not null"))
    return named.join(counted_side(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
