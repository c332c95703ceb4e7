"""Set differences, array differences and diffs of keyed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each distinct key with ``removed`` (only in a), ``added`` (only in b) or ``common``."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s")))
    side = both.groupBy(key).agg(F.bit_or("s").alias("s"))
    return side.select(key, F.when(F.col("s") == 1, "removed").when(F.col("s") == 2, "added").otherwise("common").alias("side"))


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows added, removed or retyped between two snapshots; unchanged rows are left out."""
    a = old.select(*keys, F.struct(F.col(value).alias("v")).alias("old"))
    b = new.select(*keys, F.struct(F.col(value).alias("v")).alias("new"))
    both = a.join(b, keys, "full_outer")
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
              .when(~F.col("old.v").eqNullSafe(F.col("new.v")), "retyped"))
    return both.withColumn("change", change).filter("change is not null").select(
        *keys, "change", F.col("old.v").alias("old_value"), F.col("new.v").alias("new_value"))


def nested_diff(old: DataFrame, new: DataFrame, parent: list[str], child: list[str], value: str) -> DataFrame:
    """Differences of two snapshots by path: ``(*parent, *child, change, children, old_value, new_value)``.

    A parent on one side only is one row (``added`` or ``removed``, child keys null, with the number of its children); its children are not told one by
    one. Under parents on both sides each child that was added, removed or retyped is a row (``children`` null). A row whose child keys are all null is a parent
    without children. Parents are told apart by partial counts, so one with most of all children is no hot group; null keys meet null keys.
    """
    leaf = F.sign(F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in child])))).cast("int")
    sides = old.select(*parent, F.lit(1).alias("side"), leaf.alias("leaf")).unionByName(new.select(*parent, F.lit(2).alias("side"), leaf.alias("leaf")))
    parents = sides.groupBy(*parent).agg(F.bit_or("side").alias("side"), F.sum("leaf").alias("children"))
    kinds = {c: old.schema[c].dataType for c in child} | {"old_value": old.schema[value].dataType, "new_value": new.schema[value].dataType}
    whole = parents.filter("side < 3").withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()}).withColumn(
        "change", F.when(F.col("side") == 1, "removed").otherwise("added"))
    # both snapshots in one grouping, so that null keys are equal and no join multiplies rows; plain columns, which are summed up by hash without a sort
    v, none = F.col(value), F.lit(None).cast(old.schema[value].dataType)
    rows = old.filter(leaf == 1).select(*parent, *child, F.lit(1).alias("side"), v.alias("old_value"), none.alias("new_value")).unionByName(
        new.filter(leaf == 1).select(*parent, *child, F.lit(2).alias("side"), none.alias("old_value"), v.alias("new_value")))
    both = rows.groupBy(*parent, *child).agg(F.bit_or("side").alias("__side"), F.max("old_value").alias("old_value"), F.max("new_value").alias("new_value"))
    change = (F.when(F.col("__side") == 2, "added").when(F.col("__side") == 1, "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "retyped"))
    changed = both.withColumn("change", change).filter("change is not null")
    alone = parents.filter("side < 3").select(*[F.col(c).alias(f"__{c}") for c in parent])
    same = F.lit(True)
    for c in parent:
        same = same & changed[c].eqNullSafe(alone[f"__{c}"])
    inside = changed.join(alone, same, "left_anti").withColumn("children", F.lit(None).cast("bigint"))
    columns = [*parent, *child, "change", "children", "old_value", "new_value"]
    return whole.select(*columns).unionByName(inside.select(*columns))


def array_set_diff(df: DataFrame, keys: list[str], current: str, before: str) -> DataFrame:
    """Ids that came and went per key; rows without a change are left out, no earlier set means all came."""
    none = F.array().cast(df.schema[current].dataType)
    now, old = F.coalesce(F.col(current), none), F.coalesce(F.col(before), none)
    return (df.select(*keys, F.array_sort(F.array_except(now, old)).alias("added"),
                      F.array_sort(F.array_except(old, now)).alias("removed"), F.size(now).alias("total"))
            .filter((F.size("added") > 0) | (F.size("removed") > 0)))


def subset_check(df: DataFrame, keys: list[str], value: str, required: list[str]) -> DataFrame:
    """Distinct required values seen per key, which are missing, and whether all are there."""
    wanted = F.array(*[F.lit(v) for v in sorted(required)])
    seen = F.collect_set(F.when(F.col(value).isin(required), F.col(value)))
    out = df.groupBy(*keys).agg(F.array_sort(seen).alias("seen"))
    return out.withColumn("missing", F.array_except(wanted, "seen")).withColumn("complete", F.size("missing") == 0)
