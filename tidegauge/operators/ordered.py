"""Ordered passes over keyed rows that hold up when one key owns a third of the table.

``ordered(df, keys, order).scan(...)`` gives running counts, sums, extremes and "last seen" values per key.
If every key is small the plan is one window. If some key is larger than one task should sort, the order axis is
cut into slices of about equal row count (at order values of a sample of the hot keys' rows, compared exactly and whatever
their types, NULL first), each slice is scanned on its own and
what earlier slices hand over is added as one carry row per (key, slice). The carry comes from a pre-aggregated
summary with one row per (key, slice), so no task ever sees a whole hot key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidegauge.runtime import GROUP_ROWS, setting

SLICE = "__slice"
ROW = "__row"
CARRY = "__carry"
#: Rows of the sample from which a cut is taken, on average.
ROWS_PER_CUT = 16


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column | None = None


def position() -> Step:
    """1-based row number within the key."""
    return Step("count", F.lit(1))


def running_sum(value: Column) -> Step:
    return Step("sum", value)


def running_max(value: Column) -> Step:
    return Step("max", value)


def running_min(value: Column) -> Step:
    return Step("min", value)


def latest(value: Column) -> Step:
    """Last non-null value up to and including this row."""
    return Step("latest", value)


def previous(value: Column) -> Step:
    """Last non-null value strictly before this row; wrap in a struct to see nulls of the row just before."""
    return Step("previous", value)


@dataclass(frozen=True)
class OrderedGroups:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    #: Rows of order values at which a new slice starts, ascending; None if every key fits one task.
    splits: tuple[tuple, ...] | None

    def scan(self, backward: bool = False, **steps: Step) -> "OrderedGroups":
        """Add one column per step. ``backward`` runs from the last row to the first."""
        direction = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
        if self.splits is None:
            window = W.partitionBy(*self.keys).orderBy(*[direction(c) for c in self.order])
            cols = {name: _local(step, window) for name, step in steps.items()}
            return replace(self, df=self.df.withColumns(cols))
        return replace(self, df=self._sliced(backward, direction, steps))

    def with_df(self, df: DataFrame) -> "OrderedGroups":
        """Same layout over derived rows (keys, order columns and their values must be unchanged)."""
        return replace(self, df=df)

    def sliced_rows(self) -> DataFrame:
        """The rows with their slice number; slices of a key follow the order of its rows."""
        if self.splits is None:
            return self.df.withColumn(SLICE, F.lit(0).cast("bigint"))
        # two levels of cuts, so that a row is compared with about twice the root of their number
        block = max(1, math.isqrt(len(self.splits)))
        blocks = [list(self.splits[n:n + block]) for n in range(0, len(self.splits), block)]
        value = T.StructType([T.StructField(c, self.df.schema[c].dataType) for c in self.order])
        kind = T.StructType([T.StructField("heads", T.ArrayType(value)), T.StructField("blocks", T.ArrayType(T.ArrayType(value)))])
        cuts = self.df.sparkSession.createDataFrame([([b[0] for b in blocks], blocks)], kind)
        at = F.struct(*[F.col(c) for c in self.order])
        held = self.df.withColumns({"__heads": cuts.select("heads").scalar(), "__blocks": cuts.select("blocks").scalar()})
        outer = F.size(F.filter("__heads", lambda cut: cut <= at))
        inner = F.size(F.filter(F.element_at("__blocks", F.greatest(outer, F.lit(1))), lambda cut: cut <= at))
        number = F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * block + inner)
        return held.withColumn(SLICE, number.cast("bigint")).drop("__heads", "__blocks")

    def _sliced(self, backward: bool, direction, steps: dict[str, Step]) -> DataFrame:
        columns = self.df.columns
        rows = self.sliced_rows()
        # inputs of the steps become columns, so that carry rows can leave them null
        inputs = {f"__in_{name}": step.value for name, step in steps.items()}
        rows = rows.withColumns(inputs).withColumn(ROW, F.lit(1))
        at = F.struct(*[F.col(c) for c in self.order])
        summary = rows.groupBy(*self.keys, SLICE).agg(
            *[_handed_over(step, F.col(f"__in_{name}"), at, backward).alias(name) for name, step in steps.items()])
        earlier = W.partitionBy(*self.keys).orderBy(direction(SLICE)).rowsBetween(W.unboundedPreceding, -1)
        carry = summary.select(
            *self.keys, SLICE, F.lit(0).alias(ROW),
            F.struct(*[_join_slices(step, F.col(name), earlier).alias(name) for name, step in steps.items()])
            .alias(CARRY))
        both = rows.unionByName(carry, allowMissingColumns=True)
        window = W.partitionBy(*self.keys, SLICE).orderBy(F.col(ROW), *[direction(c) for c in self.order])
        handed = F.first(F.col(CARRY)).over(window.rowsBetween(W.unboundedPreceding, 0))
        both = both.withColumns({f"__c_{name}": handed[name] for name in steps})
        local = {f"__l_{name}": _local(Step(s.kind, F.col(f"__in_{name}")), window) for name, s in steps.items()}
        both = both.withColumns(local).filter(F.col(ROW) == 1)
        merged = {name: _merge(step, F.col(f"__l_{name}"), F.col(f"__c_{name}")) for name, step in steps.items()}
        kept = [c for c in columns if c not in steps]
        return both.withColumns(merged).select(*kept, *steps)


def _local(step: Step, window) -> Column:
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    if step.kind in ("count", "sum"):
        return F.sum(step.value).over(upto)
    if step.kind == "max":
        return F.max(step.value).over(upto)
    if step.kind == "min":
        return F.min(step.value).over(upto)
    if step.kind == "latest":
        return F.last(step.value, ignorenulls=True).over(upto)
    return F.last(step.value, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))


def _handed_over(step: Step, value: Column, at: Column, backward: bool) -> Column:
    if step.kind in ("count", "sum"):
        return F.sum(value)
    if step.kind == "max":
        return F.max(value)
    if step.kind == "min":
        return F.min(value)
    pick = F.min_by if backward else F.max_by
    return pick(value, F.when(value.isNotNull(), at))


def _join_slices(step: Step, value: Column, earlier) -> Column:
    if step.kind in ("count", "sum"):
        return F.sum(value).over(earlier)
    if step.kind == "max":
        return F.max(value).over(earlier)
    if step.kind == "min":
        return F.min(value).over(earlier)
    return F.last(value, ignorenulls=True).over(earlier)


def _merge(step: Step, local: Column, carry: Column) -> Column:
    if step.kind in ("count", "sum"):
        return F.when(local.isNotNull() | carry.isNotNull(),
                      F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    if step.kind == "max":
        return F.greatest(local, carry)
    if step.kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def largest_group(df: DataFrame, keys: tuple[str, ...]) -> int:
    """Rows of the most frequent key: one pre-aggregated pass over the key columns only."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def ordered(df: DataFrame, keys, order, group_rows: int | None = None) -> OrderedGroups:
    """Lay out ``df`` for ordered passes per key.

    ``order`` must be a total order within the key, of any orderable types.
    """
    keys, order = tuple(keys), tuple(order)
    limit = group_rows or setting(df.sparkSession, GROUP_ROWS)
    if largest_group(df, keys) <= limit:
        return OrderedGroups(df, keys, order, None)
    hot_rows = df
    if keys:
        hot = df.groupBy(*keys).count().filter(F.col("count") > limit).drop("count")
        same = F.lit(True)
        for key in keys:
            same = same & df[key].eqNullSafe(hot[key])
        hot_rows = df.join(hot, same, "left_semi")
    return OrderedGroups(df, keys, order, _cuts(hot_rows.select(*order), order, limit))


def _cuts(values: DataFrame, order: tuple[str, ...], limit: int) -> tuple[tuple, ...]:
    """Order values that cut ``values`` into slices of about half of ``limit`` rows.

    They are every so many-th row of a sorted sample, so their number follows the rows; where they fall only shifts the
    sizes of slices, never a result.
    """
    count = values.count()
    pieces = max(2, -(-2 * count // limit))
    share = min(1.0, ROWS_PER_CUT * pieces / count)
    sample = values.filter(F.rand(7) < share).orderBy(*order).collect()
    step = max(1, len(sample) // pieces)
    return tuple(dict.fromkeys(tuple(r) for r in sample[step::step])) or tuple(tuple(r) for r in sample[:1]) or (tuple(values.first()),)


def _ranked_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their count, the rank they reach and the size of the group.

    Both sums come from ordered passes over the counted values, so no join is needed and a NULL key is a group like any
    other.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    g = ordered(counts, keys, [value]).scan(__upto=running_sum(F.col("__n")))
    g = g.scan(backward=True, __down=running_sum(F.col("__n")))
    return g.df.withColumn("__total", F.col("__upto") + F.col("__down") - F.col("__n"))


def _at_rank(value: str, rank: Column) -> Column:
    inside = (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)
    return F.max(F.when(inside, F.col(value)))


def group_quantiles(df: DataFrame, keys, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles per key: the sorted value at position ceil(q*n), clamped to 1..n.

    Equal values are counted before the shuffle, then ranked by cumulative count.
    """
    keys = list(keys)
    def rank(q: float) -> Column:
        return F.least(F.greatest(F.ceil(F.lit(q) * F.col("__total")), F.lit(1)), F.col("__total"))
    return _ranked_counts(df, keys, value).groupBy(*keys).agg(
        *[_at_rank(value, rank(q)).alias(name) for name, q in quantiles.items()])


def group_median(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Exact median per key (mean of the two middle values for even counts), ranked like ``group_quantiles``."""
    keys = list(keys)
    low, high = F.expr("(__total + 1) div 2"), F.expr("(__total + 2) div 2")
    return _ranked_counts(df, keys, value).groupBy(*keys).agg(
        ((_at_rank(value, low) + _at_rank(value, high)) / 2).alias(name))
