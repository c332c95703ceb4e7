"""World geometry: grid keys turn range conditions into equi-joins; sizes of broadcast sides are checked first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.operators.ordered import group_median, ordered, previous, running_sum
from tidegauge.runtime import cut_lineage, ship, small_side

#: Places of one cell, of either side, that are compared in one group.
PLACES = 1 << 16


def cell_of(coordinate: Column, size: float) -> Column:
    return F.floor(coordinate / F.lit(float(size))).cast("bigint")


def _around(x: Column, z: Column, size: float) -> Column:
    """The 3 x 3 cells around a point."""
    return F.explode(F.array(*[F.struct((cell_of(x, size) + a).alias("cx"), (cell_of(z, size) + b).alias("cz"))
                               for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def grid_count(points: DataFrame, cell: float, y_cell: float, min_cell: int = 4) -> DataFrame:
    """Pieces per 3-D cell, cells with fewer than ``min_cell`` left out."""
    return (points.groupBy(cell_of(F.col("x"), cell).alias("cx"), cell_of(F.col("y"), y_cell).alias("cy"),
                           cell_of(F.col("z"), cell).alias("cz"))
            .agg(F.count(F.lit(1)).alias("pieces")).filter(F.col("pieces") >= min_cell))


def cell_join(points: DataFrame, cells: DataFrame, cell: float, y_cell: float) -> DataFrame:
    """Points that lie in an occupied cell, with the columns of that cell."""
    keyed = points.withColumns({"cx": cell_of(F.col("x"), cell), "cy": cell_of(F.col("y"), y_cell),
                                "cz": cell_of(F.col("z"), cell)})
    return keyed.join(small_side(cells), ["cx", "cy", "cz"])


def footprint_join(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Points over the footprint of a cluster: x and z only, so stacked clusters both get the point."""
    prints = cells.select("cx", "cz", "cluster_id").distinct()
    keyed = points.withColumns({"cx": cell_of(F.col("x"), cell), "cz": cell_of(F.col("z"), cell)})
    return keyed.join(small_side(prints), ["cx", "cz"])


def box_join(points: DataFrame, boxes: DataFrame, pad: float = 8.0, y_pad: float = 4.0, tile: float = 64.0) -> DataFrame:
    """Points inside padded boxes, borders included. Boxes are spread over coarse tiles, then checked exactly."""
    padded = boxes.select(
        "cluster_id", (F.col("min_x") - pad).alias("lo_x"), (F.col("max_x") + pad).alias("hi_x"),
        (F.col("min_y") - y_pad).alias("lo_y"), (F.col("max_y") + y_pad).alias("hi_y"),
        (F.col("min_z") - pad).alias("lo_z"), (F.col("max_z") + pad).alias("hi_z"))
    tiles = (padded.withColumn("tx", F.explode(F.sequence(cell_of(F.col("lo_x"), tile), cell_of(F.col("hi_x"), tile))))
             .withColumn("tz", F.explode(F.sequence(cell_of(F.col("lo_z"), tile), cell_of(F.col("hi_z"), tile)))))
    keyed = points.withColumns({"tx": cell_of(F.col("x"), tile), "tz": cell_of(F.col("z"), tile)})
    inside = (F.col("x").between(F.col("lo_x"), F.col("hi_x")) & F.col("y").between(F.col("lo_y"), F.col("hi_y"))
              & F.col("z").between(F.col("lo_z"), F.col("hi_z")))
    return keyed.join(small_side(tiles), ["tx", "tz"]).filter(inside) \
        .drop("tx", "tz", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z")


def _one_box(boxes: DataFrame, columns: list[str]) -> DataFrame:
    """Boxes that are equal in ``columns`` once, under their smallest ``cluster_id``."""
    return boxes.groupBy(*columns).agg(F.min("cluster_id").alias("cluster_id"))


def box_totals(points: DataFrame, boxes: DataFrame, sums: list[str], pad: float = 8.0, y_pad: float = 4.0, tile: float = 64.0) -> DataFrame:
    """``cluster_id, n, sum_<axis>...``: number of points in each padded box and sums of their coordinates ``sums``.

    Points of one place and boxes of one extent are joined once, so the work goes with the places and extents there are.
    """
    extent = [f"{m}_{a}" for a in ("x", "y", "z") for m in ("min", "max")]
    one = cut_lineage(_one_box(boxes, extent))
    places = points.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("__n"))
    inside = box_join(places, one, pad, y_pad, tile).groupBy("cluster_id").agg(
        F.sum("__n").alias("n"), *[F.sum(F.col(a) * F.col("__n")).alias(f"sum_{a}") for a in sums])
    return (boxes.select(F.col("cluster_id").alias("__own"), *extent).join(one, extent).join(inside, "cluster_id")
            .select(F.col("__own").alias("cluster_id"), "n", *[f"sum_{a}" for a in sums]))


def assign_nearest(pieces: DataFrame, boxes: DataFrame, kind: str, name: str, digits: int = 4, tile: float = 64.0) -> DataFrame:
    """A piece in several boxes goes to the one with the nearest centre in plan; piece = kind, name, place to 2 digits.

    Distances are compared, and given as ``d2``, to ``digits`` digits; ties go to the smallest ``cluster_id``. Places are looked up
    once however many pieces lie there, and boxes equal in extent and centre once. The least distance comes first and then, among
    the boxes that have it, the smallest id: both are aggregates of plain numbers, so matches are neither sorted nor shuffled.
    """
    extent = [f"{m}_{a}" for a in ("x", "y", "z") for m in ("min", "max")]
    one = cut_lineage(_one_box(boxes, [*extent, "center_x", "center_z"]))
    distinct = cut_lineage(pieces.groupBy(kind, name, "x", "y", "z").agg(F.lit(1).alias("__one")).drop("__one"))
    centers = small_side(one.select("cluster_id", "center_x", "center_z"))
    d2 = (F.col("x") - F.col("center_x")) * (F.col("x") - F.col("center_x")) + (F.col("z") - F.col("center_z")) * (F.col("z") - F.col("center_z"))

    def near(places: DataFrame) -> DataFrame:
        return box_join(places, one.drop("center_x", "center_z"), tile=tile).join(centers, "cluster_id").withColumn("d2", d2)
    least = cut_lineage(near(distinct.select("x", "y", "z").distinct()).groupBy("x", "y", "z").agg(F.min("d2").alias("least")))
    step = 10.0 ** -digits
    rounded = lambda c: F.round(c, digits)
    tied = (F.col("d2") <= F.col("least") + step) & (rounded(F.col("d2")) == rounded(F.col("least")))
    best = near(least).filter(tied).groupBy("x", "y", "z").agg(
        F.min("cluster_id").alias("cluster_id"), rounded(F.min("d2")).alias("d2"))
    out = distinct.join(best, ["x", "y", "z"]).withColumns({a: F.round(a, 2) for a in ("x", "y", "z")})
    return out.groupBy(kind, name, "x", "y", "z").agg(F.min(F.struct("d2", "cluster_id")).alias("best")).select(
        kind, name, "x", "y", "z", F.col("best.cluster_id").alias("cluster_id"), F.col("best.d2").alias("d2"))


def nearest_within(points: DataFrame, centers: DataFrame, key: str, max_m: float) -> DataFrame:
    """Nearest centre in plan for each point (``key`` is unique), NULL when none lies within ``max_m``; ties go to the smallest id.

    Points of one place, and centres of one place, are compared once; so the pairs go with the places there are.
    """
    one = centers.groupBy("center_x", "center_z").agg(F.min("center_id").alias("center_id"))
    spread = one.select("center_id", "center_x", "center_z",
                        _around(F.col("center_x"), F.col("center_z"), max_m).alias("at")) \
        .select("center_id", "center_x", "center_z", F.col("at.cx").alias("cx"), F.col("at.cz").alias("cz"))
    keyed = points.select("x", "z").distinct().withColumns({"cx": cell_of(F.col("x"), max_m), "cz": cell_of(F.col("z"), max_m)})
    d2 = F.pow(F.col("x") - F.col("center_x"), 2) + F.pow(F.col("z") - F.col("center_z"), 2)
    best = (keyed.join(small_side(spread), ["cx", "cz"]).withColumn("d2", d2).filter(F.col("d2") <= max_m * max_m)
            .groupBy("x", "z").agg(F.min(F.struct("d2", "center_id")).alias("b")))
    return points.select(key, "x", "z").join(small_side(cut_lineage(best)), ["x", "z"], "left").select(
        key, F.col("b.center_id").alias("center_id"), F.sqrt("b.d2").alias("distance"))


def radius_pairs(positions: DataFrame, radius: float, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Pairs ``(observer, target, d2)`` of different entities within ``radius`` in plan, per ``keys`` (region, sample).

    The grid cell is as wide as the radius, so the 3 x 3 neighbourhood holds every partner. Columns named in ``carry`` come along, as
    ``o_<name>`` and ``t_<name>``.
    """
    mine, theirs = ([F.col(c).alias(f"{side}_{c}") for c in carry or []] for side in "ot")
    here = positions.select(*keys, F.col("entity").alias("observer"), F.col("x").alias("ox"), F.col("z").alias("oz"),
                            cell_of(F.col("x"), radius).alias("cx"), cell_of(F.col("z"), radius).alias("cz"), *mine)
    there = positions.select(*keys, F.col("entity").alias("target"), F.col("x").alias("tx"), F.col("z").alias("tz"), *theirs,
                             _around(F.col("x"), F.col("z"), radius).alias("at"))
    there = there.select("*", F.col("at.cx").alias("cx"), F.col("at.cz").alias("cz")).drop("at")
    d2 = F.pow(F.col("ox") - F.col("tx"), 2) + F.pow(F.col("oz") - F.col("tz"), 2)
    return (here.join(there, [*keys, "cx", "cz"]).withColumn("d2", d2)
            .filter((F.col("observer") != F.col("target")) & (F.col("d2") <= radius * radius))
            .select(*keys, "observer", "target", "d2", *[f"{side}_{c}" for side in "ot" for c in carry or []]))


def places_around(eyes: DataFrame, things: DataFrame, key: str, near: float, mid: float, group: int = PLACES) -> DataFrame:
    """``key, x, z, near, mid``: for each distinct place of ``eyes`` (``key, x, z``) how many ``things`` (``key, x, z``) lie within ``near``, and how many beyond it
    within ``mid``. Places without a thing within ``mid`` may be missing.

    No pair is formed: equal places are compared once, in arrays, cell by cell (as wide as ``mid``). A task holds at most about ``group`` places of either
    side; a cell with more is cut by hash.
    """
    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        x, z, n = (right.column(c).to_numpy() for c in ("x", "z", "n"))
        n, ex, ez = n.astype(np.float64), left.column("x").to_numpy(), left.column("z").to_numpy()
        out, step = np.zeros((2, len(ex))), max(1, (1 << 16) // max(1, len(x)))
        for at in range(0, len(ex) if len(x) else 0, step):
            dx, dz = ex[at:at + step, None] - x, ez[at:at + step, None] - z
            d2 = dx * dx + dz * dz
            out[0, at:at + step] = np.einsum("ij,j->i", (d2 <= min(near, mid) ** 2).astype(np.float64), n)
            out[1, at:at + step] = np.einsum("ij,j->i", (d2 <= mid ** 2).astype(np.float64), n)
        got = out.astype(np.int64)
        return left.select([key, "x", "z"]).append_column("near", pa.array(got[0])).append_column("mid", pa.array(got[1] - got[0]))

    ship(eyes.sparkSession)
    cell, part = [key, "cx", "cz"], [key, "cx", "cz", "of", "by"]
    placed_at = lambda df: df.filter((F.abs("x") < float("inf")) & (F.abs("z") < float("inf")))
    spread = placed_at(eyes).select(key, F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).distinct().select(
        key, "x", "z", _around(F.col("x"), F.col("z"), mid).alias("at")).select(key, "x", "z", "at.cx", "at.cz")
    placed = placed_at(things).groupBy(key, F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"cx": cell_of(F.col("x"), mid), "cz": cell_of(F.col("z"), mid)})
    pieces = lambda rows, name: rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias(name))
    sizes = pieces(spread, "ofs").join(pieces(placed, "bys"), cell)
    dealt = lambda n: F.pmod(F.xxhash64("x", "z"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread.join(sizes, cell).select(*cell, "x", "z", dealt("ofs").alias("of"), each("bys").alias("by"))
    right = placed.join(sizes, cell).select(*cell, "x", "z", "n", each("ofs").alias("of"), dealt("bys").alias("by"))
    right = right.select("x", "z", "n", *[F.col(c).alias(f"__{c}") for c in part])
    found = left.groupBy(*part).cogroup(right.groupBy(*[f"__{c}" for c in part])).applyInArrow(
        counted, T.StructType([left.schema[key], *[T.StructField(c, T.DoubleType()) for c in "xz"], *[T.StructField(c, T.LongType()) for c in ("near", "mid")]]))
    return found.groupBy(key, "x", "z").agg(F.sum("near").alias("near"), F.sum("mid").alias("mid"))


def around_center(positions: DataFrame, x: float, z: float, radius: float) -> DataFrame:
    """Everything within ``radius`` of one place, the place's own entity included."""
    d2 = F.pow(F.col("x") - x, 2) + F.pow(F.col("z") - z, 2)
    return positions.filter(d2 <= radius * radius)


def cluster_stats(pieces: DataFrame, min_pieces: int = 400) -> DataFrame:
    """Box, mean place, median height and variety per cluster, small clusters left out."""
    base = pieces.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("pieces"),
        *[f(axis).alias(f"{name}_{axis}") for axis in ("x", "y", "z")
          for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "cen"))],
        F.countDistinct("prefab_name").alias("distinct_prefabs"),
        F.countDistinct("creator_id").alias("distinct_creators")).filter(F.col("pieces") >= min_pieces)
    return base.join(group_median(pieces, ["cluster_id"], "y", "med_y"), "cluster_id")


def top_value(df: DataFrame, key: str, value: str, ignore=None) -> DataFrame:
    """Most frequent value per key and its count; ties go to the smallest value."""
    if ignore is not None:
        df = df.filter(F.col(value) != ignore)
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), "n"), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(f"top_{value}"),
                                                           F.col("b.n").alias(f"top_{value}_n"))


def category_pivot(df: DataFrame, key: str, category: str, values: list[str]) -> DataFrame:
    """Counts of fixed categories as columns; absent is 0."""
    return df.groupBy(key).agg(*[F.count_if(F.col(category) == v).alias(v.lower()) for v in values])


def cluster_features(stats: DataFrame, world_radius: float = 10_500.0) -> DataFrame:
    """Derived columns of a cluster: sizes, region, camera hints and the photo-worthiness score."""
    c = F.col
    # Score weights, standoff and camera heights.
    df = stats.withColumns({f"size_{a}": c(f"max_{a}") - c(f"min_{a}") for a in ("x", "y", "z")})
    df = df.withColumn("footprint", F.greatest(c("size_x"), F.lit(1.0)) * F.greatest(c("size_z"), F.lit(1.0)))
    df = df.withColumn("diagonal", F.sqrt(c("size_x") ** 2 + c("size_y") ** 2 + c("size_z") ** 2))
    radius = F.sqrt(c("cen_x") ** 2 + c("cen_z") ** 2)
    score = (F.log10(F.greatest(c("pieces"), F.lit(1))) * 2.0 + F.least(c("size_y"), F.lit(60.0)) / 20.0
             + F.least(c("distinct_prefabs"), F.lit(60)) / 30.0
             + F.least(c("pieces") / F.greatest(c("footprint"), F.lit(1.0)) * 4.0, F.lit(2.0)))
    return df.select(
        "cluster_id", F.when(radius <= world_radius, "in-world").otherwise("outland").alias("region"),
        F.round(radius, 1).alias("radius_m"), (c("med_y") > 500).alias("sky"), "pieces", F.round(score, 3).alias("score"),
        F.round("cen_x", 1).alias("center_x"), F.round("med_y", 1).alias("center_y"), F.round("cen_z", 1).alias("center_z"),
        *[F.round(f"{m}_{a}", 1).alias(f"{m}_{a}") for a in ("x", "y", "z") for m in ("min", "max", "size")],
        F.round("footprint", 1).alias("footprint_m2"), F.round("diagonal", 1).alias("diagonal_m"),
        F.round(F.greatest(c("diagonal") * 0.9, F.lit(20.0)), 1).alias("suggested_standoff_m"),
        F.round(c("med_y") + F.greatest(c("size_y") * 0.6, F.lit(8.0)), 1).alias("suggested_camera_y"),
        "distinct_prefabs", "distinct_creators")


def level_bands(floors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Storeys: half-metre bins (half to even), bins over 1 m apart start a band, tiny bands dropped."""
    level = F.bround(F.col("y") * 2.0, 0) / 2.0
    bins = floors.groupBy(key, level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"sum_{a}") for a in ("x", "y", "z")],
        *[f(a).alias(f"{m}_{a}") for a in ("x", "z") for f, m in ((F.min, "min"), (F.max, "max"))])
    g = ordered(bins, [key], ["level"]).scan(before=previous(F.col("level")))
    g = g.scan(band=running_sum(F.when(F.col("level") - F.col("before") > 1.0, 1).otherwise(0)))
    bands = g.df.groupBy(key, "band").agg(
        F.sum("n").alias("count"), *[F.sum(f"sum_{a}").alias(f"sum_{a}") for a in ("x", "y", "z")],
        *[f(f"{m}_{a}").alias(f"{m}_{a}") for a in ("x", "z") for f, m in ((F.min, "min"), (F.max, "max"))])
    totals = bins.groupBy(key).agg(F.sum("n").alias("floors"))
    enough = F.col("count") >= F.greatest(F.lit(8), F.floor(F.col("floors") * 0.02))
    return bands.join(totals, key).filter(enough).select(
        key, "band", F.round(F.col("sum_y") / F.col("count"), 2).alias("y"), "count",
        *[F.round(f"{m}_{a}", 1).alias(f"{m}_{a}") for a in ("x", "z") for m in ("min", "max")],
        F.round(F.col("sum_x") / F.col("count"), 1).alias("cx"), F.round(F.col("sum_z") / F.col("count"), 1).alias("cz"))


def thin_points(points: DataFrame, keys: list[str] = (), xz: float = 1.0, y: float = 2.0) -> DataFrame:
    """One point per cell of 1 m x 1 m x 2 m (nearest cell, half to even): the smallest (x, y, z)."""
    cell = [F.bround(F.col(a) / s, 0).alias(f"k{a}") for a, s in (("x", xz), ("z", xz), ("y", y))]
    return (points.groupBy(*keys, *cell).agg(F.min(F.struct("x", "y", "z")).alias("p"))
            .select(*keys, *[F.round(F.col(f"p.{a}"), 1).alias(a) for a in ("x", "y", "z")]))


def pair_nearest(seats: DataFrame, tables: DataFrame, fires: DataFrame, walls: DataFrame, reach: float = 3.0,
                 dy: float = 1.5) -> DataFrame:
    """Per seat: nearest table in reach (of equals the later id), whether a fire is near, how crowded the seat is.

    Seats of one place, and tables, fires or walls of one place, are compared once, so the pairs go with the places there are.
    """
    spots = cut_lineage(seats.select("x", "y", "z").distinct())

    def near(other: DataFrame, radius: float, height: float) -> DataFrame:
        mine = spots.withColumns({"cx": cell_of(F.col("x"), radius), "cz": cell_of(F.col("z"), radius)})
        places = other.groupBy("x", "y", "z").agg(F.max("id").alias("other"), F.count(F.lit(1)).alias("n"))
        theirs = places.select("other", "n", F.col("x").alias("bx"), F.col("y").alias("by"),
                               F.col("z").alias("bz"), _around(F.col("x"), F.col("z"), radius).alias("at")) \
            .select("other", "n", "bx", "by", "bz", F.col("at.cx").alias("cx"), F.col("at.cz").alias("cz"))
        d2 = F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("z") - F.col("bz"), 2)
        return (mine.join(theirs, ["cx", "cz"]).withColumn("d2", d2)
                .filter((F.col("d2") <= radius * radius) & (F.abs(F.col("y") - F.col("by")) <= height)))
    at = ["x", "y", "z"]
    table = near(tables, reach, dy).groupBy(*at).agg(
        F.min(F.struct("d2", (-F.col("other")).alias("late"))).alias("t"))
    fire = near(fires, 8.0, 3.0).select(*at).distinct().withColumn("fire", F.lit(True))
    crowd = near(walls, 1.6, 2.5).groupBy(*at).agg(F.sum("n").alias("crowding"))
    found = cut_lineage(spots.join(table, at, "left").join(fire, at, "left").join(crowd, at, "left").select(
        *at, (-F.col("t.late")).alias("table_id"), F.sqrt("t.d2").alias("distance"), "fire", "crowding"))
    return seats.select("seat_id", *at).join(small_side(found), at, "left").select(
        "seat_id", "table_id", "distance", F.coalesce("fire", F.lit(False)).alias("near_fire"),
        F.coalesce("crowding", F.lit(0)).alias("crowding"))


def sightline_hits(segments: DataFrame, walls: DataFrame, step: float = 0.5) -> DataFrame:
    """Samples of each line of sight (ends left out) with a wall within 1 m in plan and 2 m in height."""
    length = F.sqrt(sum((F.col(f"b{a}") - F.col(f"a{a}")) ** 2 for a in ("x", "y", "z")))
    steps = F.floor(length / step).cast("int")
    at = F.col("i") / F.col("steps")
    samples = (segments.withColumn("steps", steps)
               .withColumn("i", F.explode_outer(F.when(F.col("steps") > 1, F.sequence(F.lit(1), F.col("steps") - 1))))
               .withColumns({f"s{a}": F.col(f"a{a}") + (F.col(f"b{a}") - F.col(f"a{a}")) * at for a in ("x", "y", "z")})
               .withColumns({"cx": cell_of(F.col("sx"), 1.0), "cz": cell_of(F.col("sz"), 1.0)}))
    near = walls.select("x", "y", "z").distinct().select(
        F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("z").alias("wz"),
        _around(F.col("x"), F.col("z"), 1.0).alias("at")) \
        .select("wx", "wy", "wz", F.col("at.cx").alias("cx"), F.col("at.cz").alias("cz"))
    close = ((F.abs(F.col("wy") - F.col("sy")) <= 2.0)
             & (F.pow(F.col("wx") - F.col("sx"), 2) + F.pow(F.col("wz") - F.col("sz"), 2) <= 1.0))
    hit = samples.join(near, (samples.cx == near.cx) & (samples.cz == near.cz) & close, "left_semi")
    counts = hit.groupBy("segment_id").agg(F.count(F.lit(1)).alias("hits"))
    return segments.select("segment_id").join(counts, "segment_id", "left").na.fill(0, ["hits"])


def footprint_grid(clusters: DataFrame, cell: float = 2.0) -> DataFrame:
    """All cells ``(cluster_id, ix, iz)`` of the footprint boxes."""
    def cells(axis: str) -> Column:
        n = F.greatest(F.ceil((F.col(f"max_{axis}") - F.col(f"min_{axis}")) / cell), F.lit(1)).cast("int")
        return F.explode(F.sequence(F.lit(0), n - 1))
    return clusters.withColumn("ix", cells("x")).withColumn("iz", cells("z"))


def open_cells(clusters: DataFrame, roofs: DataFrame, floors: DataFrame, cell: float = 2.0) -> DataFrame:
    """Footprint cells with nothing overhead: no roof piece and no floor more than 2 m above the ground level.

    ``clusters`` has the box and ``ground_y``; roofs and floors carry ``cluster_id``.
    """
    base = clusters.select("cluster_id", F.col("min_x").alias("x0"), F.col("min_z").alias("z0"), "ground_y")
    def covered(pieces: DataFrame, over: Column) -> DataFrame:
        return (pieces.join(base, "cluster_id").filter(over)
                .select("cluster_id", cell_of(F.col("x") - F.col("x0"), cell).alias("ix"),
                        cell_of(F.col("z") - F.col("z0"), cell).alias("iz")))
    cover = covered(roofs, F.lit(True)).unionByName(covered(floors, F.col("y") > F.col("ground_y") + 2.0)).distinct()
    return footprint_grid(clusters, cell).join(cover, ["cluster_id", "ix", "iz"], "left_anti")


def enclosed_cells(open_: DataFrame, walls: DataFrame, cell: float = 2.0) -> DataFrame:
    """Open cells at least 4 m from the box edge with walls on three of four sides.

    A wall reaches at most the cells 20 m along and 6 m across, so each wall marks those cells with its side and the
    marks are merged per cell; no pairs of cells and walls are formed. ``walls`` carries the cluster's origin.
    """
    reach, across, height = 20.0, 6.0, 8.0
    span = int(reach / cell) + 1
    wide = int(across / cell) + 1
    sides = []
    for bit, (fx, fz) in enumerate(((0, 1), (0, -1), (1, 0), (-1, 0))):
        rx = (-wide, wide) if fz else ((-span, 1) if fx > 0 else (-1, span))
        rz = (-wide, wide) if fx else ((-span, 1) if fz > 0 else (-1, span))
        sides.append((bit, fx, fz, rx, rz))
    near = walls.filter(F.abs(F.col("y") - F.col("ground_y")) <= height).select(
        "cluster_id", "x", "z", "x0", "z0", cell_of(F.col("x") - F.col("x0"), cell).alias("wx"),
        cell_of(F.col("z") - F.col("z0"), cell).alias("wz")).distinct()
    marks = None
    for bit, fx, fz, rx, rz in sides:
        part = (near.withColumn("ix", F.explode(F.sequence(F.col("wx") + rx[0], F.col("wx") + rx[1])))
                .withColumn("iz", F.explode(F.sequence(F.col("wz") + rz[0], F.col("wz") + rz[1]))))
        dx = F.col("x") - (F.col("x0") + (F.col("ix") + 0.5) * cell)
        dz = F.col("z") - (F.col("z0") + (F.col("iz") + 0.5) * cell)
        along, side = dx * fx + dz * fz, F.abs(dx * fz) + F.abs(dz * fx)
        part = part.filter((along > 0) & (along <= reach) & (side <= across)) \
            .select("cluster_id", "ix", "iz", F.lit(1 << bit).alias("side"))
        marks = part if marks is None else marks.unionByName(part)
    held = (marks.groupBy("cluster_id", "ix", "iz").agg(F.bit_or("side").alias("sides"))
            .filter(F.bit_count("sides") >= 3))
    px = F.col("min_x") + (F.col("ix") + 0.5) * cell
    pz = F.col("min_z") + (F.col("iz") + 0.5) * cell
    inner = open_.filter((px - F.col("min_x") >= 4) & (F.col("max_x") - px >= 4)
                         & (pz - F.col("min_z") >= 4) & (F.col("max_z") - pz >= 4))
    return inner.join(held, ["cluster_id", "ix", "iz"], "left_semi")


def camera_fanout(clusters: DataFrame, elevation: float = 40.0, margin: float = 1.15, max_distance: float = 120.0,
                  clearance: float = 3.0) -> DataFrame:
    """Six shots per structure: four bearings off the long axis and two moods on the broad face."""
    c = F.col
    fov = 65.0
    base = F.when(c("size_x") >= c("size_z"), 0.0).otherwise(90.0)
    bearing = [(base + 45.0 + 90.0 * i) % 360.0 for i in range(4)]
    hero = F.when(c("size_x") >= c("size_z"), bearing[0]).otherwise(bearing[1])
    # Shot names, weather and time of day.
    shots = [*[(f"orbit{i + 1}", bearing[i], "Clear", 0.64) for i in range(4)],
             ("dawn", hero, "Clear", 0.32), ("weather", hero, "Misty", 0.66)]
    plan = F.explode(F.array(*[F.struct(F.lit(n).alias("shot"), a.alias("azimuth"), F.lit(e).alias("environment"),
                                        F.lit(t).alias("time_of_day")) for n, a, e, t in shots]))
    width = F.greatest(c("size_x"), c("size_z"), F.lit(1.0))
    tilt = F.greatest(F.lit(18.0), F.least(F.lit(elevation), elevation - 60.0 * c("size_y") / width))
    subject = F.greatest(c("size_y"), F.least(c("size_x"), c("size_z")), F.lit(8.0))
    ideal = subject / 2.0 / F.tan(F.radians(F.lit(fov / 2.0))) * margin
    df = (clusters.withColumn("s", plan)
          .withColumns({"shot": c("s.shot"), "azimuth": c("s.azimuth"), "environment": c("s.environment"),
                        "time_of_day": c("s.time_of_day"), "tilt": tilt, "ideal": ideal,
                        "aim_y": (c("min_y") + c("max_y")) / 2.0})
          .withColumn("far", F.least(c("ideal"), F.lit(max_distance)))
          .withColumns({"cam_x": c("center_x") + c("far") * F.cos(F.radians("tilt")) * F.sin(F.radians("azimuth")),
                        "cam_z": c("center_z") + c("far") * F.cos(F.radians("tilt")) * F.cos(F.radians("azimuth")),
                        "cam_y": F.greatest(c("aim_y") + c("far") * F.sin(F.radians("tilt")), c("min_y") + clearance)}))
    dx, dy, dz = c("center_x") - c("cam_x"), c("aim_y") - c("cam_y"), c("center_z") - c("cam_z")
    norm = F.sqrt(dx ** 2 + dy ** 2 + dz ** 2)
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    down = F.degrees(-F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dy / norm))))
    return df.select("cluster_id", "shot", F.round("azimuth", 1).alias("azimuth_deg"),
                     F.round("cam_x", 1).alias("cam_x"), F.round("cam_y", 1).alias("cam_y"), F.round("cam_z", 1).alias("cam_z"),
                     F.round("aim_y", 1).alias("aim_y"),
                     F.round(F.pmod(F.degrees(F.atan2(dx, dz)), F.lit(360.0)), 2).alias("yaw_deg"),
                     F.round(down, 2).alias("pitch_deg"), F.round("far", 1).alias("distance_m"),
                     F.round("tilt", 1).alias("elevation_deg"), (c("ideal") <= max_distance).alias("frames_whole_build"),
                     "environment", "time_of_day")
