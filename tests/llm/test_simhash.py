from __future__ import annotations

import random

import xxhash
from pyspark.sql import types as T

from conftest import rows
from tidegauge.llm.simhash import fingerprint, fingerprints, links, near_duplicates

SCHEMA = "doc_id bigint, text string, fp string, component_id int"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x1c").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, distance):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def groups(labels):
    out = {}
    for n, label in enumerate(labels):
        out.setdefault(label, set()).add(n)
    return sorted(map(sorted, out.values()))


def test_fingerprint_is_the_majority_of_shingle_bits(spark):
    texts = ["a b c d e", "One", "two words", "", None, "É é\xa0x \x1c y\tz\x0bw", "tie tie tie tie tie", "x " * 50_000]
    got = rows(fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), "*")
    assert got == [(n, signed(brute_fingerprint(t))) for n, t in enumerate(texts)]
    assert fingerprint(None) == fingerprint(" \n") == 0


def planted(count, spread, seed):
    r = random.Random(seed)
    marks = set()
    while len(marks) < count:
        base = r.getrandbits(64)
        marks.add(base)
        for _ in range(spread):
            base ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3])))
            marks.add(base)
    return sorted(marks)


def check_links(spark, marks, **options):
    from tidegauge.operators.graph import connected_components

    distance = options.get("distance", 2)
    df = spark.createDataFrame([(signed(m),) for m in marks], "fp bigint")
    found = dict(rows(connected_components(df.select(df.fp.alias("node")), links(df, **options)), "*"))
    assert groups([found[signed(m)] for m in marks]) == groups(brute_components(marks, distance))


def test_links_have_the_components_of_all_near_pairs(spark):
    check_links(spark, planted(300, 6, 1))


def test_large_buckets_are_linked_without_pairs(spark):
    r = random.Random(2)
    low = {r.getrandbits(9) for _ in range(300)}  # one hot chain in most ring positions
    check_links(spark, sorted(low), pairwise=2)


def test_wider_distance(spark):
    check_links(spark, planted(120, 4, 3), distance=4, segments=16, pairwise=3)


def test_components_over_rows(spark):
    schema = T._parse_datatype_string(SCHEMA)
    data = [(5, "a b c d", "x", 1), (3, "A b\tc  d", "y", 2), (9, None, None, None), (8, "", "z", 0), (None, "a b c d", "n", 0),
            (7, "other words here now", "q", 1), (7, "other words here now", "q", 1)]
    got = rows(near_duplicates(spark.createDataFrame(data, schema)), "doc_id", "component_id")
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7), (7, 7)], key=repr)
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
