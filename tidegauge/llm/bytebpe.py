"""Byte-level BPE in two tiers: whole pre-tokens through a minimal perfect hash, all others through a heap over linked bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import mapped

#: Characters of text that are encoded at once.
SPAN = 1 << 20
#: Missed pre-tokens that a worker remembers, in each of two generations; only those of at most ``LONG`` bytes.
REMEMBERED, LONG = 200_000, 64
#: Bits of a level of the perfect hash for each key that is still without a place.
GAMMA = 2
#: An odd factor of the rolling hash and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: A place behind a character that is not white space and before one that is; every pre-token ends there.
SAFE_CUT = regex.compile(r"(?<=\S)(?=\s)")


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """The hashes spread anew for each ``salt``."""
    h = h ^ np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(factor: int, count: int) -> np.ndarray:
    """1, ``factor``, ``factor`` ** 2, ... modulo 2**64."""
    out = np.full(count, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolling_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces of ``data`` (bytes) that end at ``ends``, from one pass of prefix sums."""
    powers, back = _powers(FACTOR, len(data) + 1), _powers(INVERSE, len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return (sums[ends] - sums[starts]) * back[starts]


class PerfectHash:
    """Minimal perfect hash by levels: a key stays on the first level on which no other open key has its bit.

    A key's number is the count of set bits before its own, so numbers run from 0 without a gap. A string that is no key may get
    a key's number; whoever looks up compares with the key of that number.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have the same 64-bit hash")
        self.sizes, self.starts, levels, start = [], [], [], 0
        while len(hashes):
            size = GAMMA * len(hashes)
            at = _mixed(hashes, len(levels)) % np.uint64(size)
            bits = np.bincount(at.astype(np.int64), minlength=size) == 1
            hashes = hashes[~bits[at.astype(np.int64)]]
            self.sizes.append(size)
            self.starts.append(start)
            levels.append(bits)
            start += size
        self.bits = np.concatenate([*levels, np.zeros(1, bool)])
        self.before = np.cumsum(self.bits) - self.bits

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The key number of each hash, -1 if it can be no key."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            at = (_mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64) + start
            hit = self.bits[at]
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbours the pair of lowest rank is joined, the leftmost first, until none is a token.

    Bytes are a linked list, pairs wait in a heap. An entry names where its pair starts and ends and is void once either part
    has been joined to something else. Entries are whole numbers: rank, start and end, one above the other.
    """
    size = len(piece)
    width = size.bit_length()
    low = (1 << width) - 1
    after = list(range(1, size + 2))  # where the part that starts here ends; 0: no part starts here any more
    before = list(range(-1, size))  # where the part before this one starts
    heap = [(ranks[pair] << width | n) << width | n + 2 for n in range(size - 1) if (pair := piece[n:n + 2]) in ranks]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        end, start = entry & low, entry >> width & low
        middle = after[start]
        if not middle or middle >= end or after[middle] != end:
            continue
        after[start], after[middle], before[end] = end, 0, start
        if end < size and (pair := piece[start:after[end]]) in ranks:
            heappush(heap, (ranks[pair] << width | start) << width | after[end])
        left = before[start]
        if left >= 0 and (pair := piece[left:end]) in ranks:
            heappush(heap, (ranks[pair] << width | left) << width | end)
    out, start = [], 0
    while start < size:
        out.append(ranks[piece[start:after[start]]])
        start = after[start]
    return out


class ByteBPE:
    """Encoder and decoder of a file of ranks (base64 token and rank a line), after splitting by ``pattern``."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        self.longest = max(map(len, tokens))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        hashes = rolling_hashes(data, np.cumsum(lengths))
        self.hash = PerfectHash(hashes)
        order = np.argsort(self.hash.numbers(hashes))
        self.lengths, self.starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(tokens))[order]
        self.data = data
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _known(self, pieces: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Ids of the pieces that are tokens as a whole, -1 for the others; byte by byte equal, not only by hash."""
        out = np.full(len(pieces), -1, np.int64)
        fits = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        if not len(fits):
            return out
        short = pieces if len(fits) == len(pieces) else [pieces[n] for n in fits.tolist()]
        data, sizes = np.frombuffer(b"".join(short), np.uint8), lengths[fits]
        ends = np.cumsum(sizes)
        number = self.hash.numbers(rolling_hashes(data, ends))
        same = (number >= 0) & (self.lengths[number] == sizes)
        fits, number, sizes, starts = fits[same], number[same], sizes[same], (ends - sizes)[same]
        if not len(fits):
            return out
        first = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        wrong = data[np.repeat(starts, sizes) + step] != self.data[np.repeat(self.starts[number], sizes) + step]
        equal = np.add.reduceat(wrong, first) == 0
        out[fits[equal]] = self.ids[number[equal]]
        return out

    def _missed(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of missed pre-tokens. What was met lately is remembered: at most two generations and the words of one group of texts."""
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set(pieces).difference(young)
        for piece in new:
            found = old.get(piece)
            young[piece] = np.array(merged(piece, self.ranks), "<u4").tobytes() if found is None else found
        out = list(map(young.__getitem__, pieces))
        for piece in new:
            if len(piece) > LONG:
                del young[piece]
        return out

    def _spans(self, text: str) -> Iterator[str]:
        """The text in spans of some ``SPAN`` characters; pre-tokens never cross from one into the next."""
        start = 0
        while len(text) - start > SPAN:
            cut = SAFE_CUT.search(text, start + SPAN)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some short texts."""
        split = [self.pattern.findall(t) for t in texts]
        pieces = [p.encode() for s in split for p in s]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self._known(pieces, lengths)
        counts = np.ones(len(pieces), np.int64)
        missed = np.flatnonzero(ids < 0)
        parts = self._missed([pieces[n] for n in missed.tolist()])
        counts[missed] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.repeat(ids, counts)
        flat[flat < 0] = np.frombuffer(b"".join(parts), "<u4")
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, split)])]
        return [flat[a:b].astype("<u4") for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, in order."""
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SPAN:
                yield from (ids.tobytes() for ids in self._encode(group))
                group, size = [], 0
                yield b"".join(self._encode([span])[0].tobytes() for span in self._spans(text))
                continue
            group.append(text)
            size += len(text)
            if size > SPAN:
                yield from (ids.tobytes() for ids in self._encode(group))
                group, size = [], 0
        yield from (ids.tobytes() for ids in self._encode(group))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each Python worker."""
    return ByteBPE(path, pattern)


#: Rows that leave a task at once.
BATCH = 256


def _with_column(df: DataFrame, source: str, name: str, values) -> DataFrame:
    """``df`` with a binary column computed from the column ``source`` of each batch by ``values(list) -> iterator``."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                column = pa.array(list(values(batch.column(at).to_pylist())), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=pa.schema([*batch.schema, pa.field(name, pa.binary())]))

    at = df.columns.index(source)
    schema = df.limit(0).withColumn(name, F.lit(None).cast("binary")).schema
    return mapped(df, compute, schema)


def _free_name(df: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the input already has a column {name}; choose another name")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``: little-endian unsigned 32-bit token ids of the whole text.

    Each match of ``pattern`` is encoded on its own: as one id if it is in the vocabulary, else by merges in the order of
    ranks. There are no special tokens; text that looks like one is ordinary text.

    Null and empty texts have no ids (an empty value). Texts of any length are taken in spans cut where no pre-token can cross.
    Bytes that are no UTF-8 count as U+FFFD. Repeated rows each get the same ids; an empty table gives no rows; other columns
    are kept as they are, and a column that already has the name ``ids`` is an error. Nothing is shuffled.
    """
    _free_name(docs, ids)
    clean = docs.withColumn(text, F.coalesce(F.make_valid_utf8(F.col(text).cast("string")), F.lit("")))
    return _with_column(clean, text, ids, lambda texts: coder(path, pattern).encode(texts))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with a binary column ``decoded``: the bytes that ``ids`` stand for. Null ids give an empty value."""
    _free_name(rows, decoded)
    return _with_column(rows, ids, decoded, lambda values: (coder(path, pattern).decode(v or b"") for v in values))
