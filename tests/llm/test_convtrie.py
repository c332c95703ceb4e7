from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from conftest import rows
from tidegauge.llm import convtrie
from tidegauge.llm.convtrie import heads_taken_over, list_rank, prefix_trie, turn_digests

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 int"


def plain_trie(data, block=100, most=6):
    """The same by a dictionary of prefixes."""
    own = {}
    for conv, turn, role, text, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % most if block else 0
        built[conv] = (own.get(conv - conv % block, [])[:head] if block else []) + turns[head:]
    members, ends = {}, {}
    for conv in sorted(built):
        turns = tuple(built[conv])
        ends.setdefault(turns, []).append(conv)
        for depth in range(len(turns) + 1):
            members.setdefault(turns[:depth], []).append(conv)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((convs[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(convs),
                    sum(len(q) == len(prefix) + 1 and q[:-1] == prefix for q in members), len(childless), saved,
                    hashlib.sha256(",".join(map(str, ends.get(prefix, []))).encode()).hexdigest()))
    return sorted(out, key=repr)


def sample(seed=3, count=40):
    rng = random.Random(seed)
    data = [(conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ü€😀"]), 9)
            for conv in [*range(count), 100, 150, 151, 205, 1000] for turn in range(rng.choice([0, 1, 2, 3, 7]))]
    data += [(300, None, "user", "early", 9), (300, 5, "user", "late", 9), (None, 1, "user", "nobody", 9), (304, 1, "u", "x" * 5000, 9)]
    return data + [(301, n, "user", f"t{n}", 9) for n in range(90)]  # one conversation holds a good part of all rows


@pytest.fixture(params=[None, 10], ids=["windows", "slices"])
def limit(request, spark):
    if request.param:
        spark.conf.set("tidegauge.groupRows", request.param)
    yield request.param
    spark.conf.unset("tidegauge.groupRows")


def trie_of(spark, data, block=100, at_once=60):
    turns = turn_digests(spark.createDataFrame(data, SCHEMA).repartition(5))
    return prefix_trie(turns.select("conv_id").distinct(), heads_taken_over(turns, block, 6) if block else turns, at_once=at_once)


def test_nodes_equal_a_plain_trie(spark, limit):
    data = sample()
    got = rows(trie_of(spark, data), *COLUMNS)
    assert got == plain_trie(data)
    if not limit:
        assert got == rows(trie_of(spark, data, at_once=10_000), *COLUMNS)


def test_many_ends_at_one_node_are_digested_in_slices(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "SLICE", 7)
    data = [(c, 0, "user", "same", 1) for c in range(60)] + [(c, 0, "user", "other", 1) for c in range(60, 67)] + [(70, 0, "user", "other", 1)]
    assert rows(trie_of(spark, data, block=0), *COLUMNS) == plain_trie(data, block=0)


def test_empty_and_repeated_rows(spark):
    assert trie_of(spark, [], 100).count() == 0
    data = [(5, 1, "user", "a", 1)] * 3 + [(6, 1, "user", "a", 2), (None, None, None, None, None)]
    assert rows(trie_of(spark, data, block=0), *COLUMNS) == plain_trie(data, block=0)


@pytest.mark.parametrize("size", [0, 1, 2, 500])
def test_list_ranking(spark, size):
    order = random.Random(size).sample(range(10 * size), size)
    links = [(v, order[n - 1] if n else None, order[n + 1] if n + 1 < size else None) for n, v in enumerate(order)]
    df = spark.createDataFrame(links, "id bigint, prev bigint, next bigint")
    assert rows(list_rank(df, at_once=20), "rank", "id") == sorted(enumerate(order), key=repr)
    if size > 2:
        with pytest.raises(ValueError):
            list_rank(spark.createDataFrame(links[:2] + [(7001, 7002, 7002), (7002, 7001, 7001)], df.schema)).count()
