"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidegauge.llm.common import WORD, global_prefix
from tidegauge.runtime import cut_lineage

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: A source's documents are dealt over so many slices by their seeded hash, so that no task sorts a whole source.
SLICES = 4096
#: A table of sources of at most so many bytes goes to all tasks.
BROADCAST_BYTES = 16 << 20


def seeded(key: Column, seed: int) -> Column:
    """60 bits of a seeded digest: the same order on every run and every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """``target`` per row of ``(weight, cap, ...)``: shares of ``budget`` by weight, clamped at ``cap``, the rest reshared.

    Each round hands what the clamped rows left to the free ones in proportion to their weights and clamps those that
    would go above their cap. A round only moves two sums to the driver, however many sources there are.
    """
    sources = cut_lineage(sources.withColumn("__capped", F.col("cap") <= 0))
    level = None
    while True:
        free = ~F.col("__capped")
        s = sources.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("cap"))).alias("c")).first()
        if not s["w"]:
            break
        level = (budget - float(s["c"] or 0)) / float(s["w"])
        over = free & (F.col("weight") * F.lit(level) > F.col("cap"))
        if not sources.filter(over).limit(1).count():
            break
        sources = cut_lineage(sources.withColumn("__capped", F.col("__capped") | over))
    share = F.lit(None).cast("double") if level is None else F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(F.col("__capped"), F.col("cap").cast("double")).otherwise(share)).drop("__capped")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, max_epochs: int = 2, seed: int = 7,
        cut_last: bool = True) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, epochs, place, extra, taken``.

    ``size`` is the number of words of the text. The sources share ``budget_share`` of all words by ``weights`` (dealt in
    code point order of the source, null last), no source above ``max_epochs`` passes over itself (water-filling). Of a
    target of 1.3 passes every document gets one whole repetition (``epochs``), and documents in a seeded random order
    get another (``extra`` words) until the target is reached. The last one may be cut so that the target is met to the word
    (``cut_last``); otherwise it counts in full if at least half of it fits. ``place`` is the document's seeded place.

    Null text has size 0. Null ``doc_id`` is hashed as empty text. Repeated rows each count. A source of size 0 has target
    0. An empty table gives no rows. Extra columns are not read. Reruns agree.
    """
    rows = cut_lineage(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                   F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                                   seeded(F.col("doc_id"), seed).alias("__h"))
                       .withColumn("__slice", F.expr(f"__h div {(1 << 60) // SLICES}").cast("int")))
    slices = cut_lineage(rows.groupBy("source", "__slice").agg(F.sum("size").alias("words")))
    sources = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked, total = global_prefix(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"],
                                  rank=F.lit(1), all=F.col("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    budget = budget_share * total["all"]
    goals = water_fill(ranked.select("source", "source_size", weight.alias("weight"),
                                     (F.col("source_size") * max_epochs).alias("cap")), budget)
    goals = cut_lineage(goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                         .otherwise(F.lit(0)).cast("bigint"))
                        .withColumn("__rest", F.round(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size"))
                        .select("source", "source_size", "target", "epochs", "__rest"))
    before = W.partitionBy("source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.withColumn("__before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = starts.alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source")).select(
        "s.*", "source_size", "target", "epochs", "__rest")
    inside = W.partitionBy("source", "__slice").orderBy("__h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("p").join(starts.alias("s"), F.expr("p.source <=> s.source AND p.__slice = s.__slice")).select(
        "p.doc_id", "p.source", "p.size", "source_size", "target", "epochs",
        F.col("p.__h").alias("place"), (F.col("__rest") - F.col("__before") - F.col("__in")).alias("__room"))
    extra = F.greatest(F.lit(0), F.least("size", "__room")) if cut_last else F.when(2 * F.col("__room") > F.col("size"), F.col("size")).otherwise(0)
    return placed.withColumn("extra", extra.cast("bigint")).drop("__room").withColumn(
        "taken", F.col("epochs") * F.col("size") + F.col("extra"))


def repeated(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as :func:`mix` says, whole documents only.

    The mix boils down to one bound per source, the place of the last document that gets one more repetition; rows
    meet the bounds of their source, so texts are not shuffled unless the table of sources is too large to broadcast.
    """
    mixed = mix(docs, seed=seed, cut_last=False, **options)
    at = F.struct("place", "doc_id", "size")
    bounds = cut_lineage(mixed.groupBy("source").agg(F.max("epochs").alias("__epochs"), F.max(F.when(F.col("extra") > 0, at)).alias("__last"))
                         .withColumnRenamed("source", "__source"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    own = F.struct(seeded(F.col("doc_id"), seed).alias("place"), F.col("doc_id"), size.alias("size"))
    weight = bounds.agg(F.sum(64 + F.coalesce(F.octet_length("__source"), F.lit(0)))).first()[0] or 0
    met = docs.join(F.broadcast(bounds) if weight <= BROADCAST_BYTES else bounds, F.expr("source <=> __source"))
    copies = F.col("__epochs") + F.coalesce((own <= F.col("__last")).cast("int"), F.lit(0))
    times = F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")
    return met.withColumn("__copies", copies.cast("int")).filter("__copies > 0").select(*docs.columns, times).drop("__copy")
