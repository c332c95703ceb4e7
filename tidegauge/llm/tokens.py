"""Token ids of whole texts by Arrow columns: a batch's distinct words are looked up once, ids are gathered by offsets."""

from __future__ import annotations

import string
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: White space to the split but not to the tokenizer; such texts are encoded in one piece.
ODD_SPACE = r"[\x1c-\x1f]"
MARKS = string.punctuation.replace("'", "")
#: Words without a normalizer but lower case: Latin letters of one code point in either case.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
#: Words and other units a worker remembers, some 30 bytes each; when more are met, those of the last batch stay.
REMEMBERED = 1_000_000
#: Words that go to the tokenizer as one text.
GROUP = 200


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + size]`` one after the other."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class WordEncoder:
    """Ids of a tokenizer file without special tokens, equal to encoding the whole text.

    The tokenizer never joins characters across white space, so chunks between white space are encoded on their own. A
    chunk of plain letters, perhaps with marks after it, is two units, its lower-case word and the marks; words go to the model
    without the costly normalizers. Any other chunk is one unit and goes through the whole tokenizer. Ids of the units
    met are kept as one array with offsets.
    """

    def __init__(self, path: str) -> None:
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True  # their strings in a text are ordinary text
        self.quick = Tokenizer(self.full.model)
        self.quick.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.units = pa.array([""], pa.string())
        self.ids, self.start, self.size = np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, self.kind) for e in self.full.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(f) for f in found], np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words and how many each has; every word ends in a token that only stands at a word's end."""
        texts = [" ".join(words[a:a + GROUP]) for a in range(0, len(words), GROUP)]
        found = [np.array(e.ids, self.kind) for e in self.quick.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, self.kind), *found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("word ends are not marked as expected")
        return ids, np.diff(ends, prepend=0)

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where each of the distinct ``units`` stands among the remembered ones; new ones are encoded first."""
        at = pc.index_in(units, value_set=self.units)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if known.all():
            return places
        fresh = units.filter(pa.array(~known))
        plain = pc.match_substring_regex(fresh, PLAIN)
        words, rest = fresh.filter(plain), fresh.filter(pc.invert(plain))
        (ids, sizes), (ids2, sizes2) = self._words(words.to_pylist()), self._whole(rest.to_pylist())
        if len(self.units) + len(fresh) > REMEMBERED:
            places = self._keep(places)
        plain = plain.to_numpy(zero_copy_only=False)
        places[~known] = len(self.units) + np.where(plain, np.cumsum(plain) - 1, len(words) + np.cumsum(~plain) - 1)
        self.units = pa.concat_arrays([self.units, words, rest])
        self.ids = np.concatenate([self.ids, ids, ids2])
        self.size = np.concatenate([self.size, sizes, sizes2])
        self.start = np.cumsum(self.size) - self.size
        return places

    def _keep(self, places: np.ndarray) -> np.ndarray:
        """Forgets all units but those at ``places`` and the empty one; gives the new places."""
        kept, at = np.unique(np.append(places, 0), return_inverse=True)
        self.ids = gather(self.ids, self.start[kept], self.size[kept])
        self.units, self.size = self.units.take(pa.array(kept)), self.size[kept]
        return at[:-1].astype(np.int64)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has."""
        stems = pc.utf8_rtrim(chunks, characters=MARKS)
        plain = pc.match_substring_regex(stems, PLAIN)
        first = pc.if_else(plain, pc.utf8_lower(stems), chunks)
        left = np.where(plain.to_numpy(zero_copy_only=False), pc.binary_length(stems).to_numpy(), pc.binary_length(chunks).to_numpy())
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        size = np.diff(ends) - left
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(offsets), pa.py_buffer(gather(data, ends[:-1] + left, size)))
        units = pa.concat_arrays([first, tails]).dictionary_encode()
        at = self._places(units.dictionary)[units.indices.to_numpy()]
        at = np.stack([at[:len(chunks)], at[len(chunks):]], axis=1)
        return gather(self.ids, self.start[at.ravel()], self.size[at.ravel()]), self.size[at].sum(axis=1)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False))
        if len(odd):
            return self._mixed(texts, odd)
        split = pc.utf8_split_whitespace(texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        chunks = split.flatten().dictionary_encode()
        ids, size = self._chunks(chunks.dictionary)
        at = chunks.indices.to_numpy()
        counts = np.concatenate([[0], np.cumsum(size[at])])
        return gather(ids, (np.cumsum(size) - size)[at], size[at]), np.diff(counts[offsets - offsets[0]])

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        usual = np.setdiff1d(np.arange(len(texts)), odd)
        ids, counts = self.encode_column(texts.take(pa.array(usual)))
        ids2, counts2 = self._whole(texts.take(pa.array(odd)).to_pylist())
        order = np.argsort(np.concatenate([usual, odd]))
        counts = np.concatenate([counts, counts2])
        return gather(np.concatenate([ids, ids2]), (np.cumsum(counts) - counts)[order], counts[order]), counts[order]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``kind.itemsize`` bytes an id."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        raw, width, ends = ids.tobytes(), self.kind.itemsize, np.cumsum(counts)
        return [raw[a * width:b * width] for a, b in zip((ends - counts).tolist(), ends.tolist())]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
