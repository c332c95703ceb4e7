"""Connected components, dependency layers and greedy spreading as rounds of joins and aggregates.

Every round works on a graph that got smaller, is cut by a reliable checkpoint or a written table, and uses only combinable aggregates, so
a hub node costs one partial aggregate per task instead of one huge group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.operators.ordered import ordered, position
from tidegauge.runtime import BROADCAST_ROWS, cut_lineage, setting, written

# Cell coordinates are packed three to a BIGINT; each must lie in (-HALF, HALF).
HALF = 1 << 20


def pack(a: Column, b: Column, c: Column) -> Column:
    """Three small integers as one BIGINT that sorts like the triple."""
    parts = [x.cast("bigint") for x in (a, b, c)]
    inside = reduce(lambda m, n: m & n, [F.abs(p) < HALF for p in parts])
    x, y, z = [p + HALF for p in parts]
    packed = F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)
    return F.when(inside, packed).otherwise(F.raise_error(F.lit("cell coordinate out of range")).cast("bigint"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for BIGINT nodes and undirected edges ``(src, dst)``; root is the smallest node of the component.

    Each round every vertex joins its neighbour of least hash (or stays, if it is the least itself), and the graph is
    rebuilt over the survivors. Hashed priorities keep the merge chains short whatever the ids look like, so the vertex
    count falls by a constant factor per round.
    """
    def priority(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    graph = written(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"),
                                                      F.greatest("src", "dst").alias("dst")).distinct())
    maps: list[DataFrame] = []
    limit = setting(edges.sparkSession, BROADCAST_ROWS)
    while (size := graph.count()) > 0:
        # vertices number at most twice the edges
        side = F.broadcast if 2 * size <= limit else lambda df: df
        both = graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hop = cut_lineage(both.groupBy("src").agg(F.min(priority("dst")).alias("best")).select(
            F.col("src").alias("node"), F.least(F.col("best"), priority("src"))["v"].alias("to")))
        maps.append(hop)
        left = side(hop.select(F.col("node").alias("src"), F.col("to").alias("a")))
        right = side(hop.select(F.col("node").alias("dst"), F.col("to").alias("b")))
        graph = written(graph.join(left, "src").join(right, "dst").filter("a <> b")
                        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if not maps:
        return nodes.select("node", F.col("node").alias("root"))
    total = maps.pop()
    while maps:
        hop = maps.pop()
        then = total.select(F.col("node").alias("to"), F.col("to").alias("end"))
        total = hop.join(then, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    labelled = nodes.select("node").join(total, "node", "left").select("node", F.coalesce("to", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("node").alias("root"))
    return labelled.join(smallest, "label").select("node", "root")


def neighbour_edges(cells: DataFrame, node: Column, shifted, offsets: list[tuple[int, ...]]) -> DataFrame:
    """Edges between occupied cells: each cell looks up its neighbours in half of the directions by equi-join."""
    tries = F.explode(F.array(*[shifted(o) for o in offsets]))
    return (cells.select(node.alias("src"), tries.alias("dst"))
            .join(cells.select(node.alias("dst")), "dst", "left_semi"))


def connected_cells(cells: DataFrame) -> DataFrame:
    """Clusters of occupied 3-D cells that touch (26 neighbours): ``cells`` plus ``cluster_id``.

    Ids run 1.. by number of cells, largest first, then by smallest cell.
    """
    cells = cut_lineage(cells)  # read by the edges, the labels and the result
    half = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    node = pack(F.col("cx"), F.col("cy"), F.col("cz"))
    edges = neighbour_edges(cells, node, lambda o: pack(F.col("cx") + o[0], F.col("cy") + o[1], F.col("cz") + o[2]), half)
    labels = cut_lineage(connected_components(cells.select(node.alias("node")), edges))
    sizes = labels.groupBy("root").agg((-F.count(F.lit(1))).alias("minus_size"))
    ids = ordered(sizes, [], ["minus_size", "root"]).scan(cluster_id=position()).df.select("root", "cluster_id")
    return cells.withColumn("node", node).join(labels, "node").join(ids, "root").drop("node", "root")


def connected_patches(cells: DataFrame, key: str, min_cells: int) -> DataFrame:
    """Largest 4-neighbour patch of distinct grid cells ``(key, ix, iz)`` per key, if it has at least ``min_cells`` cells.

    Cells are numbered in order of (key, ix, iz), so keys and coordinates may be of any orderable type and size. Equal sizes go to
    the patch with the smallest cell.
    """
    cells = cut_lineage(ordered(cells, [], [key, "ix", "iz"]).scan(node=position()).df)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (0, 1))])).alias("by")
    tries = cells.select(key, F.col("node").alias("src"), "ix", "iz", step).select(
        key, "src", (F.col("ix") + F.col("by.a")).alias("ix"), (F.col("iz") + F.col("by.b")).alias("iz"))
    edges = tries.join(cells.withColumnRenamed("node", "dst"), [key, "ix", "iz"]).select("src", "dst")
    marked = cut_lineage(cells.join(connected_components(cells.select("node"), edges), "node"))
    sizes = marked.groupBy(key, "root").agg(F.count(F.lit(1)).alias("n"))
    best = (sizes.groupBy(key).agg(F.min_by(F.struct("root", "n"), F.struct(-F.col("n"), "root")).alias("b"))
            .select(key, "b.root", F.col("b.n").alias("patch_cells")).filter(F.col("patch_cells") >= min_cells))
    return marked.join(best, [key, "root"]).drop("node", "root")


def dag_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path layer of each node; ``edges`` are ``(node, depends_on)``. NULL layer: in or behind a cycle.

    Each round resolves the nodes whose dependencies are all resolved and removes their edges. The number of rounds is
    the depth of the graph.
    """
    known = nodes.select("node")
    edges = cut_lineage(edges.select("node", "depends_on").distinct()
                        .join(known.withColumnRenamed("node", "depends_on"), "depends_on", "left_semi"))
    frontier = cut_lineage(known.join(edges.select("node").distinct(), "node", "left_anti"))
    layers = [frontier.withColumn("layer", F.lit(0))]
    while True:
        left = cut_lineage(edges.join(frontier.withColumnRenamed("node", "depends_on"), "depends_on", "left_anti"))
        frontier = cut_lineage(edges.select("node").distinct().join(left.select("node").distinct(), "node", "left_anti"))
        if frontier.isEmpty():
            break
        layers.append(frontier.withColumn("layer", F.lit(len(layers))))
        edges = left
    solved = reduce(DataFrame.unionByName, layers)
    return known.join(solved, "node", "left")


def early_completions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Complete items that depend on an incomplete one."""
    state = nodes.select("node", "complete")
    done = edges.join(state.filter("complete"), "node", "left_semi")
    open_ = state.filter("not complete").select(F.col("node").alias("depends_on"))
    return done.join(open_, "depends_on", "left_semi").select("node", "depends_on")


def spread_pick(cells: DataFrame, n: int, first: int | None = None) -> DataFrame:
    """Greedy choice by count: skip a cell touching an accepted one and a second cell of an owner, stop at ``n``.

    ``cells`` has ``cx, cz, pieces, owner``. A cell's fate hangs on cells before it alone, so the list is taken in parts, each twice as long as the one
    before (the first has ``first`` cells), until ``n`` cells are accepted: what lies behind the last accepted part is never looked at. Inside a part, taking,
    in rounds, every cell that comes first among its neighbours and its owner's cells gives the same set as walking the
    list in order. Owners are compared through a minimum per owner, not pair by pair.
    """
    around = F.explode(F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cz") + b).alias("cz"))
                                 for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    listed = ordered(cells.select("cx", "cz", "pieces", "owner").withColumn("lead", -F.col("pieces")), [], ["lead", "cx", "cz"])
    listed = cut_lineage(listed.scan(place=position()).df.drop("lead"))
    total, begin, size = listed.count(), 0, first or max(64, 8 * n)
    accepted: list[DataFrame] = []
    count = 0

    def free(rows: DataFrame, takes: DataFrame) -> DataFrame:
        """Rows that touch none of ``takes`` and have another owner."""
        blocked = takes.select(around.alias("at")).select("at.cx", "at.cz").distinct()
        return rows.join(blocked, ["cx", "cz"], "left_anti").join(takes.filter("owner is not null").select("owner"), "owner", "left_anti") \
            .select("cx", "cz", "pieces", "owner", "place")
    while begin < total and count < n:
        open_ = listed.filter((F.col("place") > begin) & (F.col("place") <= begin + size))
        if accepted:
            open_ = free(open_, reduce(DataFrame.unionByName, accepted))
        open_ = cut_lineage(open_)
        begin, size = begin + size, 2 * size
        while not open_.isEmpty():
            near = open_.select(around.alias("at"), "place").groupBy("at.cx", "at.cz").agg(F.min("place").alias("near"))
            own = open_.filter("owner is not null").groupBy("owner").agg(F.min("place").alias("own"))
            take = cut_lineage(open_.join(near, ["cx", "cz"]).join(own, "owner", "left")
                               .filter((F.col("place") == F.col("near")) & F.coalesce(F.col("place") == F.col("own"), F.lit(True)))
                               .select("cx", "cz", "pieces", "owner", "place"))
            accepted.append(take)
            count += take.count()
            open_ = cut_lineage(free(open_, take))
    if not accepted:
        return cells.select("cx", "cz", "pieces", "owner", F.lit(0).cast("bigint").alias("pick")).limit(0)
    picks = reduce(DataFrame.unionByName, accepted).orderBy("place").limit(n)
    return ordered(picks, [], ["place"]).scan(pick=position()).df.select("cx", "cz", "pieces", "owner", "pick")
