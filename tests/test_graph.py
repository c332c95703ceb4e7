"""Graph rounds against plain union-find, walks and greedy lists."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from conftest import rows
from tidegauge.operators import graph as G, spatial as S


def components(nodes, edges):
    root = {n: n for n in nodes}
    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loners(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(70)]
    nodes = sorted({n for e in edges for n in e} | {9001, 9002})
    rng.shuffle(edges)
    got = G.connected_components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert dict(rows(got, "node", "root")) == components(nodes, edges)


def test_size_estimates_of_rounds_do_not_multiply(spark, capsys):
    """Each round joined tables whose estimates were products of earlier ones, so the number's digits tripled a round and filled the driver."""
    edges = spark.range(1500).select("id", (F.col("id") + 1).alias("dst")).toDF("src", "dst")
    got = G.connected_components(spark.range(1501).toDF("node"), edges)
    got.explain("cost")
    sizes = [int(e or 0) for e in re.findall(r"sizeInBytes=[\d.]+(?:E\+(\d+))?", capsys.readouterr().out)]
    assert sizes and max(sizes) < 1000
    assert got.filter("root = 0").count() == 1501


def test_cells_touch_in_26_directions_and_rank_by_size(spark):
    cells = [(0, 0, 0), (1, 1, 1), (2, 1, 0), (5, 5, 5), (-9, 0, 0), (-9, 0, 1), (7, 5, 5)]
    got = G.connected_cells(spark.createDataFrame([(*c, 4) for c in cells], "cx bigint, cy bigint, cz bigint, pieces bigint"))
    ids = {c[:3]: c[3] for c in rows(got, "cx", "cy", "cz", "cluster_id")}
    assert ids == {(0, 0, 0): 1, (1, 1, 1): 1, (2, 1, 0): 1, (-9, 0, 0): 2, (-9, 0, 1): 2, (5, 5, 5): 3, (7, 5, 5): 4}


def test_largest_patch_per_key(spark):
    cells = [(1, x, 0) for x in range(5)] + [(1, 9, 9)] + [(2, 0, 0), (2, 1, 1)] + [(3, 0, z) for z in range(4)] + [(3, 5, z) for z in range(4)]
    got = G.connected_patches(spark.createDataFrame(cells, "cid bigint, ix bigint, iz bigint"), "cid", 4)
    assert {r[:3] for r in rows(got, "cid", "ix", "iz")} == {(1, x, 0) for x in range(5)} | {(3, 0, z) for z in range(4)}


def test_layers_and_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "gone")], "node string, depends_on string")
    assert rows(G.dag_layers(nodes, edges), "node", "layer") == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", None), ("y", None), ("z", None)]


def test_spread_pick_is_the_greedy_list(spark):
    rng = random.Random(4)
    cells = {(rng.randrange(15), rng.randrange(15)) for _ in range(150)}
    data = [(x, z, rng.randrange(1, 30), rng.choice([None, "a", "b", "c", "d", "e", "f", "g"])) for x, z in cells]
    want, owners = [], set()
    for x, z, n, owner in sorted(data, key=lambda d: (-d[2], d[0], d[1])):
        if len(want) == 9:
            break
        if any(abs(x - a) <= 1 and abs(z - b) <= 1 for a, b in want) or (owner and owner in owners):
            continue
        want.append((x, z))
        owners.add(owner)
    df = spark.createDataFrame(data, "cx bigint, cz bigint, pieces bigint, owner string")
    for first in (None, 4):
        assert [(r.cx, r.cz) for r in G.spread_pick(df, 9, first).orderBy("pick").collect()] == want


def test_spread_pick_stops_at_the_last_pick(spark, monkeypatch):
    looked_at = []
    monkeypatch.setattr(G, "cut_lineage", lambda df, cut=G.cut_lineage: looked_at.append(cut(df)) or looked_at[-1])
    cells = spark.range(4000).selectExpr("3 * id AS cx", "0L AS cz", "id AS pieces", "CAST(NULL AS STRING) AS owner")
    assert [r.cx for r in G.spread_pick(cells, 5).orderBy("pick").collect()] == [3 * n for n in range(3999, 3994, -1)]
    # the list itself, one part of it, one round of takes and what is left of the part
    assert len(looked_at) == 4 and looked_at[1].count() == 64


def test_enclosure_matches_direct_check(spark):
    rng = random.Random(6)
    walls = [(1, float(rng.randrange(0, 60)), float(rng.choice([0, 4, 20])), float(rng.randrange(0, 60))) for _ in range(25)]
    base = spark.createDataFrame([(1, 0.0, 60.0, 0.0, 60.0, 0.0)], "cluster_id bigint, min_x double, max_x double, min_z double, max_z double, ground_y double")
    wall_df = spark.createDataFrame([(c, x, y, z, 0.0, 0.0, 0.0) for c, x, y, z in walls], "cluster_id bigint, x double, y double, z double, x0 double, z0 double, ground_y double")
    got = {r for r in rows(S.enclosed_cells(S.footprint_grid(base), wall_df), "ix", "iz")}
    want = set()
    for ix in range(30):
        for iz in range(30):
            px, pz = (ix + 0.5) * 2, (iz + 0.5) * 2
            if min(px, 60 - px, pz, 60 - pz) < 4:
                continue
            sides = 0
            for fx, fz in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                sides += any(abs(y) <= 8 and 0 < (x - px) * fx + (z - pz) * fz <= 20 and abs((x - px) * fz) + abs((z - pz) * fx) <= 6 for _, x, y, z in walls)
            if sides >= 3:
                want.add((ix, iz))
    assert got == want
