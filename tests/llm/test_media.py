from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from conftest import rows
from tidegauge.llm import media as M


def test_expansion_tables():
    # corner codes of G.711
    assert [int(M.TABLES["mulaw"][c]) for c in (0x00, 0x80, 0x7F, 0xFF, 0xF0)] == [-32124, 32124, 0, 0, 120]
    assert [int(M.TABLES["alaw"][c]) for c in (0x2A, 0xAA, 0x55, 0xD5, 0x80)] == [-32256, 32256, -8, 8, 5504]
    assert len(set(M.TABLES["alaw"].tolist())) == 256 and sorted(np.abs(M.TABLES["mulaw"]).tolist())[2] == 8


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(M.STEPS[index])
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
            out.append(value)
    return out


def test_blocks_decode_like_one_at_a_time():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, (5, M.BLOCK + 4)).astype(np.uint8)
    data[:, 2] %= 89
    assert M.decode_blocks(data.tobytes()).tolist() == [plain_adpcm(b.tobytes()) for b in data]


@pytest.mark.parametrize("codec", M.CODECS)
def test_files_round_trip(codec):
    for text in ("", "a" * 575, "é" * 288, "z" * 5000):
        payload = M.payload_of(text)
        kind, data = M.read_wav(M.wav(payload, codec))
        assert kind == codec and M.payload_in(kind, data) == payload and len(payload) % 576 == 0
    with pytest.raises(ValueError):
        M.read_wav(b"RIFF")


def test_doubling_keeps_samples_and_lines():
    x = np.arange(0, 2000, 100, dtype=np.int16)
    y = M.doubled(x)
    assert y[0::2].tolist() == x.tolist() and y[9:-9:2].tolist() == (x[4:-5] + 50).tolist()
    assert M.doubled(np.full(9, 77, np.int16)).tolist() == [77] * 18


def test_store(spark):
    texts = ["hello", "", None, "ü" * 3000, "hello", "w " * 40_000]
    docs = spark.createDataFrame([(n, t, 0) for n, t in enumerate(texts)], "doc_id bigint, text string, media int")
    got = {r["doc_id"]: r for r in M.store(docs).collect()}
    for n, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        r = got[n]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-32:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert len(r["pcm"]) == 4 * int(r["feature"].split("n=")[1].split()[0])
    assert got[0]["feature"] == got[4]["feature"] and got[1]["media"] == got[2]["media"]
    assert M.store(docs.limit(0)).count() == 0
