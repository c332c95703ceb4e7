from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import rows
from tidegauge.llm.packing import Rounds, pack
from tidegauge.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The cat's   sat, on 12 MATS!! don't", "", "naïve café É́ ß Σίσυφος İstanbul", "<|endoftext|> a\x1cb\x85c d", None, "x" * 5000,
         "l'été... (foo-bar) a_b 日本語 😀 ½ ", "   \n\t", "word, word. Word; WORD! wörd,"]


def test_words_have_the_ids_of_the_whole_text():
    full = Tokenizer.from_file(PATH)
    full.encode_special_tokens = True
    tool = WordEncoder(PATH)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        got = [np.frombuffer(raw, tool.kind).tolist() for raw in tool.encode(texts)]
        assert got == [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]


def round_robin(lengths, burst, window):
    """The queues served one after another, with deficits, as one loop."""
    rounds = Rounds(np.array(lengths), burst, window)
    total, stream = rounds.rounds, []
    taken = [0] * len(lengths)
    for w in range(1, total + 1):
        for q, size in enumerate(lengths):
            deficit = size * w // total + int(rounds.head_start[q]) - taken[q]
            turn = deficit // burst * burst if w < total else size - taken[q]
            turn = max(0, min(turn, size - taken[q]))
            stream += [(q, taken[q] + k) for k in range(turn)]
            taken[q] += turn
    return stream


@pytest.mark.parametrize("lengths", [[1000, 3, 77, 250], [5], [64, 64, 64], [1, 1, 1, 1000], [700, 699]])
def test_closed_form_is_the_round_robin(lengths):
    rounds = Rounds(np.array(lengths), 8, 64)
    stream = round_robin(lengths, 8, 64)
    assert len(stream) == sum(lengths)
    q = np.array([q for q, size in enumerate(lengths) for _ in range(0, size, 5)])
    start = np.array([a for size in lengths for a in range(0, size, 5)])
    size = np.array([min(5, s - a) for s in lengths for a in range(0, s, 5)])
    row, low, length, at = rounds.pieces(q, start, size)
    got = {}
    for r, a, n, p in zip(row, low, length, at):
        assert p // 64 == (p + n - 1) // 64
        for k in range(n):
            got[int(p + k)] = (int(q[r]), int(start[r] + a + k))
    assert [got[p] for p in range(len(stream))] == stream


def test_windows_hold_the_mixture():
    lengths = [60_000, 30_000, 9_000, 1_000]
    stream = np.array([q for q, _ in round_robin(lengths, 32, 1000)])
    for w in range(100):
        for q, size in enumerate(lengths):
            assert abs((stream[w * 1000:(w + 1) * 1000] == q).sum() - size / 100) <= 2 * 32 + 4


def test_pack_loses_nothing(spark):
    data = [(n, t, None if n == 3 else f"s{n % 3}", n) for n, t in enumerate(TEXTS * 9)] + [(None, "again", "s0", 1)] * 2
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, length int").repartition(3)
    got = rows(pack(docs, PATH, window=256, burst=16), "sequence_id", "offset", "length", "doc_id", "start", "doc_tokens", "ids")
    full = Tokenizer.from_file(PATH)
    full.encode_special_tokens = True
    want = sorted(([d, *full.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _, _ in data), key=repr)
    total, place = sum(len(w) - 1 for w in want), 0
    held = {}
    for sequence, offset, length, doc, start, n, ids in sorted(got, key=lambda r: r[:2]):
        assert sequence * 256 + offset == place and offset + length <= 256 and len(ids) == 4 * length
        place += length
        held.setdefault((doc, n), {}).setdefault(start, []).append(np.frombuffer(ids, "<u4").tolist())
    assert place == total
    for doc, *ids in want:
        pieces = held[doc, len(ids)]
        assert [x for start in sorted(pieces) for x in pieces[start][0]] == ids or doc is None
    assert pack(docs.limit(0), PATH).count() == 0
