from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from conftest import rows
from tidegauge.llm import variants
from tidegauge.llm.variants import neighbours, spelling_variants, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else len(a) + 1 == len(b) and a[k:] == b[k + 1:])


def plain_counts(data, least=7, slip=31):
    out = Counter()
    for doc, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= least
    return {w: n for w, n in out.items() if n}


def plain_variants(data, ratio=10):
    n = {w: c for w, c in plain_counts(data).items() if c >= 2}
    form, near = {}, {w: [x for x in n if one_edit(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def sample(seed=1):
    rng = random.Random(seed)
    data, base = [], ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    base += ["a" * n for n in range(7, 16)] + ["straße" + x for x in "abcdé"] + ["Éclairage", "éclairage", "×÷×÷×÷×", "x" * 300, "x" * 301]
    for doc in range(80):
        words = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, range(1, len(base) + 1), k=60)]
        words += [w[:3] + rng.choice("abcd") + w[4:] for w in rng.choices(base, k=8)]
        data.append((doc, rng.choice([" ", "1", "ā", "_"]).join(words), "extra"))
    frequent = " ".join(["frequently"] * 2500 + ["frequentl"] * 150 + ["frequent"] * 4)
    return data + [(900, frequent, "z"), (None, "nothing nothing", "z"), (901, None, "z"), (902, "", "z")] + [(903, "repeated rows", "z")] * 3


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
SCHEMA = "doc_id bigint, text string, word string"


def test_variants_equal_brute_force(spark):
    data = sample()
    got = rows(spelling_variants(spark.createDataFrame(data, SCHEMA).repartition(4)), *COLUMNS)
    assert got == plain_variants(data)
    assert ("frequent", "frequentl", "frequently") in {r[:3] for r in got}, "a chain of forms was meant to be in the data"


@pytest.mark.parametrize("seed", [2, 3])
def test_neighbours_of_short_alphabets(spark, seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(250)} | {"c", "", "a" * 40, "a" * 41})
    df = spark.createDataFrame([(w, len(w)) for w in words] + [(None, 1)], "word string, n bigint")
    assert rows(neighbours(df), "word", "near", "near_n") == sorted(((a, b, len(b)) for a in words for b in words if one_edit(a, b)), key=repr)


def test_counts_leave_tasks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 5)
    data = sample()
    assert dict(rows(word_counts(spark.createDataFrame(data, SCHEMA)), "word", "n")) == plain_counts(data)


def test_empty_table_and_broken_bytes(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(concat(X'FF', encode('wordword', 'utf-8'), X'FE') AS string) AS text, 'w' AS word")
    assert rows(word_counts(broken), "word", "n") == sorted(plain_counts([(1, "wordword")]).items())


def test_nothing_is_broadcast_by_estimate(spark, monkeypatch):
    """the paths of a few words are many rows, which Spark takes to be as few bytes as the words' file."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)
    written = variants.written
    monkeypatch.setattr(variants, "written", kept)
    spark.conf.set("tidegauge.broadcastRows", 0)
    try:
        data = sample()
        assert rows(spelling_variants(spark.createDataFrame(data, SCHEMA)), *COLUMNS) == plain_variants(data)
    finally:
        spark.conf.unset("tidegauge.broadcastRows")
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
