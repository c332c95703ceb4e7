"""Rules of the kind "take a row if enough happened since the last row taken", per key and in order.

``threshold_picks`` walks the rows of a key with one number as state: a row is picked when its ``trigger`` reaches the
state, and the state then becomes the row's ``after``. Cooldowns, first hits, thinning and witness merging are all of
this form.

Small keys are walked in one pass over sorted batches. When one key is larger than a task should take, its rows are cut
into slices: each slice is first summarised as a function of the unknown incoming state, the summaries are chained in a tree of
two levels, and each slice is then walked with its true incoming state. The result is the same row by row.

A summary is a short list of ranges: neighbouring ranges with the same outcome are one, and states that no earlier row
can leave behind are not listed. For a cooldown these are the rows within one cooldown of the slice's start, however many rows
the slice has. Slices form blocks of about the root of their number; a block's summaries are composed to one, blocks are
followed per key, slices per block, so no task reads the summaries of all slices of a key.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegauge.operators.ordered import SLICE, ordered
from tidegauge.runtime import cut_lineage

NEVER = -(1 << 62)
BLOCK = "__block"


def walk(state: int, triggers, afters) -> tuple[list[bool], int]:
    """Picks over one run of rows and the state behind it."""
    picked = []
    for trigger, after in zip(triggers, afters):
        take = trigger >= state
        if take:
            state = after
        picked.append(take)
    return picked, state


Ranges = list[tuple[int, int, int]]


def _joined(ranges: Ranges) -> Ranges:
    """Sorted ranges with neighbours of equal outcome made one."""
    out: Ranges = []
    for low, high, end in ranges:
        if out and out[-1][1] == low and out[-1][2] == end:
            out[-1] = (out[-1][0], high, end)
        else:
            out.append((low, high, end))
    return out


def summarise(triggers, afters, most: int = -NEVER) -> Ranges:
    """A run of rows as a function of the incoming state: ``(low, high, out)`` for low < state <= high.

    States above every trigger pass through unchanged and are not listed, nor are states above ``most``, which do not occur.
    Incoming states that have led to the same pick stay together from then on, so they are carried as one class.
    """
    reached = NEVER - 1
    classes: list[tuple[int, int, list[tuple[int, int]]]] = []
    for n, (trigger, after) in enumerate(zip(triggers, afters)):
        merged: list[tuple[int, int]] = []
        if trigger > reached and reached < most:
            merged.append((reached, trigger))
            reached = trigger
        while classes and classes[0][0] <= trigger:
            part = heapq.heappop(classes)[2]
            # keep the longer list, so that repeated merging stays cheap
            if len(part) > len(merged):
                part, merged = merged, part
            merged.extend(part)
        if merged:
            heapq.heappush(classes, (after, n, merged))
    return _joined(sorted((low, high, out) for out, _, parts in classes for low, high in parts))


def applied(ranges: Ranges, state: int) -> int:
    """The state behind a run that ``ranges`` summarise."""
    at = bisect_left(ranges, state, key=lambda r: r[1])
    return ranges[at][2] if at < len(ranges) and ranges[at][0] < state else state


def composed(first: Ranges, then: Ranges) -> Ranges:
    """The summary of two runs one after the other."""
    top = first[-1][1] if first else NEVER - 1
    through = [(low, high, applied(then, end)) for low, high, end in first]
    return _joined(through + [(max(low, top), high, end) for low, high, end in then if high > top])


def threshold_picks(df: DataFrame, keys: list[str], order: list[str], trigger: Column, after: Column,
                    group_rows: int | None = None) -> DataFrame:
    """Add ``picked``. ``trigger`` and ``after`` are BIGINT and not null; the first row of a key is always picked."""
    spark = df.sparkSession
    rows = df.withColumns({"__trigger": trigger.cast("bigint"), "__after": after.cast("bigint")})
    layout = ordered(rows, keys, order, group_rows)
    if layout.splits is None:
        return _walk_rows(rows.withColumn("__in", F.lit(NEVER)), keys, order)
    sliced = layout.sliced_rows()
    group = [*keys, SLICE]
    types = ", ".join(f"`{k}` {sliced.schema[k].dataType.simpleString()}" for k in keys)
    types = types + ", " if types else ""

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, most, triggers, afters = None, NEVER, [], []

        def close() -> pd.DataFrame:
            made = [(*name, *step) for step in summarise(triggers, afters, most)] if name is not None else []
            return pd.DataFrame(made, columns=[*group, "low", "high", "out"])

        for pdf in batches:
            for now, lead, bound, trigger, after in zip(pdf[group].itertuples(index=False, name=None), pdf["__row"].tolist(), pdf["__most"].tolist(),
                                                        pdf["__trigger"].tolist(), pdf["__after"].tolist()):
                if now != name:
                    if name is not None:
                        yield close()
                    name, most, triggers, afters = now, NEVER, [], []
                if lead == 0:  # the row in front of a slice names the highest state that may come in
                    most = int(bound)
                    continue
                triggers.append(int(trigger))
                afters.append(int(after))
        yield close()

    narrow = sliced.select(*group, *[c for c in order if c not in group], "__trigger", "__after")
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    bounds = narrow.groupBy(*group).agg(F.max("__after").alias("__top")).select(
        *group, F.coalesce(F.max("__top").over(earlier), F.lit(NEVER)).alias("__most"), F.lit(0).alias("__row"))
    led = narrow.withColumn("__row", F.lit(1)).unionByName(bounds, allowMissingColumns=True).na.fill(0, ["__most", "__trigger", "__after"])
    steps = led.repartition(*group).sortWithinPartitions(*group, "__row", *order) \
        .mapInPandas(tabulate, f"{types}`{SLICE}` bigint, low bigint, high bigint, out bigint")
    side = max(1, math.isqrt(len(layout.splits)))
    steps = cut_lineage(steps.withColumn(BLOCK, F.expr(f"`{SLICE}` div {side}")))  # read once for the blocks and once more inside them
    block = [*keys, BLOCK]

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for made in _runs(batches, block, SLICE):
            name, total = made[0], []
            for _, ranges in made[1]:
                total = composed(total, ranges)
            yield pd.DataFrame([(*name, *step) for step in total], columns=[*block, "low", "high", "out"])

    def follow(names: list[str], part: str):
        def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for name, parts in _runs(batches, names, part):
                state, made = NEVER, []
                for at, ranges in parts:
                    if ranges and ranges[0][1] == NEVER - 2:  # the row in front carries the state that comes in
                        state, ranges = ranges[0][2], ranges[1:]
                    if at >= 0:
                        made.append((*name, at, state))
                    state = applied(ranges, state)
                yield pd.DataFrame(made, columns=[*names, part, "__in"])
        return entries

    blocks = steps.repartition(*block).sortWithinPartitions(*block, SLICE, "low").mapInPandas(compose, f"{types}`{BLOCK}` bigint, low bigint, high bigint, out bigint")
    into = (blocks.repartition(*keys) if keys else blocks.repartition(1)).sortWithinPartitions(*block, "low") \
        .mapInPandas(follow(keys, BLOCK), f"{types}`{BLOCK}` bigint, __in bigint")
    front = into.select(*block, F.lit(-1).cast("bigint").alias(SLICE), F.lit(NEVER - 3).alias("low"), F.lit(NEVER - 2).alias("high"), F.col("__in").alias("out"))
    chained = steps.unionByName(front).repartition(*block).sortWithinPartitions(*block, SLICE, "low") \
        .mapInPandas(follow(block, SLICE), f"{types}`{BLOCK}` bigint, `{SLICE}` bigint, __in bigint").drop(BLOCK)
    # the incoming state travels as one extra row in front of the slice, so hot slices are never matched row by row
    both = sliced.withColumn("__row", F.lit(1)).unionByName(chained.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    return _walk_rows(both, group, ["__row", *order]).drop(SLICE)


def _runs(batches: Iterator[pd.DataFrame], names: list[str], part: str) -> Iterator[tuple[tuple, list[tuple[int, Ranges]]]]:
    """Sorted summary rows, collected per ``names``: the parts in order, each with its ranges."""
    now, parts = None, []
    for pdf in batches:
        keys = pdf[names].itertuples(index=False, name=None) if names else iter([()] * len(pdf))
        for name, at, *step in zip(keys, pdf[part].tolist(), pdf["low"].tolist(), pdf["high"].tolist(), pdf["out"].tolist()):
            if name != now:
                if now is not None:
                    yield now, parts
                now, parts = name, []
            if not parts or parts[-1][0] != at:
                parts.append((at, []))
            parts[-1][1].append(tuple(step))
    if now is not None:
        yield now, parts


def _walk_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One pass over rows sorted within their key; state is kept across batches."""
    names = list(keys)
    kept = [c for c in rows.columns if c not in ("__in", "__trigger", "__after", "__row")]
    marked = "__row" in rows.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, NEVER
        for pdf in batches:
            groups = list(pdf[names].itertuples(index=False, name=None)) if names else [()] * len(pdf)
            entries, triggers, afters = pdf["__in"].tolist(), pdf["__trigger"].tolist(), pdf["__after"].tolist()
            lead = pdf["__row"].tolist() if marked else None
            picked = []
            for n, name in enumerate(groups):
                if lead is not None and lead[n] == 0:
                    key, state = name, int(entries[n])
                    picked.append(False)
                    continue
                if name != key:
                    key, state = name, NEVER
                take = triggers[n] >= state
                if take:
                    state = afters[n]
                picked.append(take)
            out = pdf[kept].assign(picked=picked)
            yield out[pdf["__row"] == 1] if marked else out

    spread = rows.repartition(*names) if names else rows.repartition(1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return spread.sortWithinPartitions(*names, *order).mapInPandas(fold, schema + ", picked boolean")


def spaced_picks(df: DataFrame, keys: list[str], at: str, tie: list[str], gap: int, group_rows: int | None = None) -> DataFrame:
    """Pick the first row of a key and then each row at least ``gap`` after the last picked one."""
    return threshold_picks(df, keys, [at, *tie], F.col(at), F.col(at) + gap, group_rows)
