from __future__ import annotations

import zlib

from conftest import rows
from tidegauge.llm.sharding import byte_shards


def test_contiguous_balanced_shards(spark):
    data = [(n * 7 % 300, "é" * (n % 50), n) for n in range(300)] + [(5, "same", 0)] * 20 + [(None, None, 1), (900, "", 2), (901, "x" * 3000, 0)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, shard int").repartition(5)
    got = rows(byte_shards(docs, shards=8), "shard", "slot", "doc_id", "size", "text_crc32")
    want = sorted((-1 if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t, _ in data)
    got = sorted(got, key=lambda r: r[:2])
    assert [(-1 if d is None else d, c, s) for _, _, d, s, c in got] == want
    total, start, slots = sum(s for *_, s in want), 0, {}
    for shard, slot, _, size, _ in got:
        assert shard == min(7, (2 * start + size) * 8 // (2 * total)) and slot == slots.get(shard, 0)
        slots[shard], start = slot + 1, start + size
    assert byte_shards(docs.limit(0)).count() == 0
