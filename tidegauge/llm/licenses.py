"""License scans: ordered signature rules behind keyword filters, overlaps settled by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import mapped
from tidegauge.llm.license_rules import RULES

#: Phrases whose places are always reported; the words must stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def signature(words: str) -> re.Pattern[bytes]:
    """Whole words in this order; a space stands for whatever is between words."""
    body = words.encode().replace(b" ?", b"\x00").replace(b" ", _GAP).replace(b"\x00", b"(?:" + _GAP + b")?")
    return re.compile(b"(?<!" + _WORD + b")(?:" + body + b")(?!" + _WORD + b")", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; equal ones in written order."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keywords, pattern = (x.strip() for x in line.split("|", 3))
        # spaces in a keyword are tested word by word, because anything may stand between words
        parts = tuple(k.encode() for part in keywords.split("+") for k in re.split(r"[^0-9a-z]+", part) if k)
        out.append(Rule(label, int(priority), parts, signature(pattern)))
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def phrases() -> tuple[tuple[bytes, re.Pattern[bytes], str], ...]:
    return tuple((max(p.split(), key=len).encode() if "cc" not in p else b"cc", signature(p), label) for p, label in PHRASES.items())


@cache
def gates() -> tuple[bytes, ...]:
    """The rarest keyword of each rule, once; a text without any of them is done after these tests."""
    return tuple(dict.fromkeys(max(r.keywords, key=len) for r in rules()))


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]
    found: list[tuple[int, int, str, int]]


def detections(low: bytes) -> list[tuple[int, int, str, int]]:
    """``(start, end, label, priority)`` in byte places, after overlaps are settled.

    Rules fire in order of priority, and a rule only if all its keywords occur. A detection is dropped if it lies inside
    one that was kept before it (equal priority: the longer one comes first); overlaps without containment both stay.
    """
    present = {k for k in gates() if k in low}
    if not present:
        return []
    raw = []
    for n, rule in enumerate(rules()):
        if max(rule.keywords, key=len) in present and all(k in low for k in rule.keywords):
            raw += [(-rule.priority, m.start() - m.end(), m.start(), n, m.end()) for m in rule.pattern.finditer(low)]
    kept: list[tuple[int, int, str, int]] = []
    starts = ends = np.empty(0, np.int64)
    for minus, _, start, n, end in sorted(raw):
        if len(kept) > 16 and len(starts) < len(kept):
            starts, ends = np.array([k[0] for k in kept]), np.array([k[1] for k in kept])
        tail = kept[len(starts):]
        if any(a <= start and end <= b for a, b, *_ in tail) or (len(starts) and ((starts <= start) & (end <= ends)).any()):
            continue
        kept.append((start, end, rules()[n].label, -minus))
    return sorted(kept)


def scan(text: str | None) -> Scan:
    """Words, base places and detections of a whole text; null is empty."""
    low = (text or "").encode("utf-8", "replace").lower()
    word = _WORD_BYTES[np.frombuffer(low, np.uint8)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    base = [(m.start(), label) for keyword, pattern, label in phrases() if keyword in low for m in pattern.finditer(low)]
    found = detections(low)
    if base or found:  # byte places -> word numbers
        at = np.flatnonzero(first)
        base = sorted((int(np.searchsorted(at, start)), label) for start, label in base)
        found = [(int(np.searchsorted(at, start)), int(np.searchsorted(at, end)), label, p) for start, end, label, p in found]
    return Scan(int(first.sum()), base, found)


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, detections`` per row: ``base`` has (word, label) of each base phrase place, ``detections``
    (start word, end word, label, priority) of the rules.

    Null or empty text: no words, empty lists. Repeated rows each get a result; an empty table gives none. Other columns are
    not read. Whole texts are scanned; a text's lists grow with what it holds.
    """
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([g.n_words for g in got], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in g.base] for g in got], pa.list_(place)),
                pa.array([[{"start": a, "stop": b, "label": x, "priority": p} for a, b, x, p in g.found] for g in got], pa.list_(span))],
                ["doc_id", "n_words", "base", "detections"])
    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                  "doc_id bigint, n_words bigint, base array<struct<word: bigint, label: string>>, "
                  "detections array<struct<start: bigint, stop: bigint, label: string, priority: int>>")
