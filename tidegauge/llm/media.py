"""Telephony audio columns: mu-law, A-law and ADPCM payloads in WAV form, expanded, resampled, measured."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import mapped

#: Payloads are padded to a multiple of this many bytes.
UNIT = 576
#: Payload bytes in an ADPCM block, two samples a byte; a block also stores a start value.
BLOCK = 288
RATE = 8000
CODECS = ("mulaw", "alaw", "adpcm")
#: WAV format numbers (fixed values).
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Bytes of payload that are decoded at once.
CHUNK = 4 << 20
#: Step sizes and index moves of IMA ADPCM (fixed values).
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
                  157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
                  1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
                  10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Half-band filter for the samples between two samples, at distances 1/2, 3/2, 5/2, 7/2 on either side.
BETWEEN = np.array([0.6171875, -0.1640625, 0.0546875, -0.0078125], np.float32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, size + 8, size + 264 << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def _moves_by_code() -> np.ndarray:
    """Change of the predicted sample per (step index, 4-bit code)."""
    code = np.arange(16)
    size = (STEPS[:, None] >> 3) + sum(np.where(code >> bit & 1, STEPS[:, None] >> 2 - bit, 0) for bit in range(3))
    return np.where(code & 8, -size, size).astype(np.int32)


DELTAS = _moves_by_code()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def codec_of(payload: bytes) -> str:
    """The codec a payload is stored with: its content decides, so equal texts are stored alike."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def wav(payload: bytes, codec: str) -> bytes:
    """The payload as the sample bytes of a mono 8 kHz WAV file (ADPCM: as the codes of independent blocks)."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)  # start value 0, step index 0
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data, align, samples, bits = blocks.tobytes(), BLOCK + 4, 2 * BLOCK + 1, 4
        rate, more = RATE * align // samples, struct.pack("<HH", 2, samples)
        total = len(blocks) * samples
    else:
        data, align, bits, rate, more, total = payload, 1, 8, RATE, struct.pack("<H", 0), len(payload)
    head = struct.pack("<HHIIHH", FORMATS[codec], 1, RATE, rate, align, bits) + more
    data_chunk = b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, total) + data_chunk
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and sample bytes of a file; any chunk order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    names, at, codec, data = {n: c for c, n in FORMATS.items()}, 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at:at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec = names.get(struct.unpack_from("<H", media, at + 8)[0])
        elif kind == b"data":
            data = media[at + 8:at + 8 + size]
        at += 8 + size + size % 2
    if codec is None or data is None:
        raise ValueError("no known sample format or no samples")
    return codec, data


def payload_in(codec: str, data: bytes) -> bytes:
    if codec != "adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)[:, 4:].tobytes()


def decode_blocks(data: bytes) -> np.ndarray:
    """Samples of ADPCM blocks, one row a block: a loop over the samples of a block, each step over all blocks at once."""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * BLOCK, len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((2 * BLOCK + 1, len(blocks)), np.int16)
    out[0] = value
    for n, code in enumerate(codes, 1):
        value = np.clip(value + DELTAS[index, code], -32768, 32767)
        index = np.clip(index + MOVES[code], 0, len(STEPS) - 1)
        out[n] = value
    return np.ascontiguousarray(out.T)


def doubled(samples: np.ndarray) -> np.ndarray:
    """16 kHz from 8 kHz: the samples, and between each two the value of a half-band filter (the ends are repeated)."""
    x = np.concatenate([np.repeat(samples[:1], 3), samples, np.repeat(samples[-1:], 4)]).astype(np.float32)
    n = len(samples)
    mid = sum(w * (x[3 - k:3 - k + n] + x[4 + k:4 + k + n]) for k, w in enumerate(BETWEEN))
    out = np.empty(2 * n, np.int16)
    out[0::2], out[1::2] = samples, np.clip(np.rint(mid), -32768, 32767)
    return out


def features(codec: str, samples: np.ndarray, resampled: np.ndarray) -> str:
    """Codec, samples, loudness, peak, sign changes, and a checksum of the 16 kHz samples."""
    wide = samples.astype(np.int64)
    rms = float(np.sqrt((wide * wide).mean()))
    turns = int((np.signbit(samples[1:]) != np.signbit(samples[:-1])).sum())
    return (f"{codec} n={len(samples)} rms={rms:.3f} mean={wide.mean():.3f} peak={int(np.abs(wide).max())} "
            f"turns={turns} pcm16k={zlib.crc32(resampled.astype('<i2').tobytes()):08x}")


SCHEMA = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
          "media_sha256": pa.string(), "feature": pa.string()}
KEPT = {"media": pa.binary(), "pcm": pa.binary()}


def store(docs: DataFrame, keep: tuple[str, ...] = ("media", "pcm"), codec: str | None = None) -> DataFrame:
    """Each text as telephony audio: ``doc_id``, digests and features, and the columns in ``keep``: ``media`` (WAV bytes) and
    ``pcm`` (little-endian 16-bit samples at 16 kHz).

    A text's UTF-8 bytes, padded with 255 to a multiple of ``UNIT``, are the sample bytes of a WAV file. The file's bytes are read
    back; digests and features come from what was read. ``codec`` fixes the codec, else the payload decides it.

    Null or empty text: one unit of padding, ``n_bytes`` 0. Repeated rows each get a result. An empty table gives no rows.
    Other columns are not read. Long texts are stored whole; about ``CHUNK`` bytes are decoded at once, a longer text alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, start = [], 0, 0
            for n, text in enumerate(batch.column(1)):
                text = text.as_py()
                raw = payload_of(text)
                held.append((len((text or "").encode("utf-8", "replace")), raw))
                size += len(raw)
                if size > CHUNK:
                    yield _stored(batch.column(0).slice(start, len(held)), held, keep, codec)
                    held, size, start = [], 0, n + 1
            if held:
                yield _stored(batch.column(0).slice(start, len(held)), held, keep, codec)
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    fields = SCHEMA | {k: KEPT[k] for k in keep}
    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                  "doc_id bigint, " + ", ".join(f"{k} {kinds[t]}" for k, t in fields.items()))


def _stored(ids: pa.Array, held: list[tuple[int, bytes]], keep: tuple[str, ...], codec: str | None) -> pa.RecordBatch:
    files = [wav(raw, codec or codec_of(raw)) for _, raw in held]
    read = [read_wav(f) for f in files]
    packed = [data for kind, data in read if kind == "adpcm"]
    decoded = iter(np.split(decode_blocks(b"".join(packed)), np.cumsum([len(d) // (BLOCK + 4) for d in packed])[:-1]) if packed else [])
    columns: dict[str, list] = {k: [] for k in [*SCHEMA, *keep]}
    for (n_bytes, _), media, (kind, data) in zip(held, files, read):
        payload = payload_in(kind, data)
        samples = next(decoded).ravel() if kind == "adpcm" else TABLES[kind][np.frombuffer(data, np.uint8)]
        high = doubled(samples)
        row = {"n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
               "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
               "feature": features(kind, samples, high), "media": media, "pcm": high.astype("<i2").tobytes() if "pcm" in keep else b""}
        for name in columns:
            columns[name].append(row[name])
    types = SCHEMA | KEPT
    return pa.RecordBatch.from_arrays([ids, *[pa.array(v, types[k]) for k, v in columns.items()]], ["doc_id", *columns])
