from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from conftest import rows
from tidegauge.llm import bytebpe
from tidegauge.llm.bytebpe import ByteBPE, PerfectHash, decode, encode, merged, rolling_hashes
from tidegauge.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODER = ByteBPE(PATH, PATTERN)
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})
TEXTS = ["", None, "it's 12  o'clock\n\n  <|endoftext|> ", "x" * 3000, "été ÿ 日本語 😀‍ ½", "\x00\x01 \x1c\x85　 a", " " * 700 + "a", "퟿￾́"]


def ids_of(texts):
    return [np.frombuffer(raw, "<u4").tolist() for raw in CODER.encode(texts)]


def plain_merge(piece, ranks):
    parts = [piece[n:n + 1] for n in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], n) for n, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        n = min(pairs)[1]
        parts[n:n + 2] = [parts[n] + parts[n + 1]]


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text_is_encoded_as_the_public_library_does(text):
    assert ids_of([text]) == [PUBLIC.encode_ordinary(text)]
    assert CODER.decode(next(CODER.encode([text]))) == text.encode()


@given(st.binary(min_size=1, max_size=60) | st.text("aeiou nt", min_size=1, max_size=60).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_heap_merges_as_repeated_search(piece):
    assert merged(piece, CODER.ranks) == plain_merge(piece, CODER.ranks)


def test_every_character_alone_and_among_others():
    texts = ["".join(f"a{c}b 1{c}2 {c} {c}{c}" for c in map(chr, range(a, a + 256))) for a in range(0, 0x30000, 256) if not 0xD800 <= a < 0xE000]
    assert ids_of(texts) == PUBLIC.encode_ordinary_batch(texts)


def test_perfect_hash_numbers_keys_without_gap():
    keys = list(CODER.ranks)
    hashes = rolling_hashes(np.frombuffer(b"".join(keys), np.uint8), np.cumsum([len(k) for k in keys]))
    numbers = PerfectHash(hashes).numbers(hashes)
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        PerfectHash(np.array([5, 5], np.uint64))


def test_spans_of_long_texts_change_nothing(monkeypatch):
    monkeypatch.setattr(bytebpe, "SPAN", 50)
    texts = ["word  and\n\n more it's " * 30, "x" * 400, " " * 300, "a " * 200 + " " * 99 + "z", ""]
    assert ids_of(texts) == PUBLIC.encode_ordinary_batch(texts)


def test_memory_of_missed_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 10)
    monkeypatch.setattr(bytebpe, "SPAN", 100)
    coder = ByteBPE(PATH, PATTERN)
    texts = [" ".join(f"zq{n}xvw{n}" for n in range(500)), "q" * 90] * 2
    assert [np.frombuffer(r, "<u4").tolist() for r in coder.encode(texts)] == PUBLIC.encode_ordinary_batch(texts)
    assert len(coder.young) + len(coder.old) <= 120 and max(map(len, [*coder.young, *coder.old])) <= bytebpe.LONG


def test_operator_on_odd_rows(spark):
    data = [(n, t, 7) for n, t in enumerate(TEXTS)] + [(2, TEXTS[2], 7), (None, "a b", 8)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, decoded int")
    got = decode(encode(docs, PATH, PATTERN), PATH, PATTERN, decoded="bytes")
    assert got.columns == ["doc_id", "text", "decoded", "ids", "bytes"]
    found = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"]), r["decoded"]) for r in got.collect()), key=repr)
    assert found == sorted(((d, PUBLIC.encode_ordinary(t or ""), (t or "").encode(), o) for d, t, o in data), key=repr)
    with pytest.raises(ValueError):
        decode(encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert encode(docs.limit(0), PATH, PATTERN).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert rows(decode(encode(broken, PATH, PATTERN), PATH, PATTERN), "decoded") == [(bytearray("a�b".encode()),)]


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    want = []
    for doc, text in rows(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text"):
        ids = np.array(PUBLIC.encode_ordinary(text or ""), "<u4")
        want.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows(QUERIES["op12_byte_bpe"](spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
