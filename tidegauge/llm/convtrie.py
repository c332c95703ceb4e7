"""Prefix trie of conversations: nodes by prefix digests, an Euler tour over them, list ranking, subtree sums by prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import global_prefix, mapped, written
from tidegauge.operators.ordered import ordered, position, previous, running_sum

#: Conversations that end at one node and are joined to one text by one task.
SLICE = 4096
#: A list of so many elements is ranked in one go; longer ones are contracted first.
AT_ONCE = 4096
TURN = ["h1", "h2", "letters"]
KEY = ["k1", "k2"]


def _two(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit hashes; the seed comes first, so a clash in one is none in the other."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, h1, h2, letters``: each turn's place in its conversation (from 1), digest and length; texts stay behind.

    Turns are ordered by ``turn``, null first; equal ones by digest. Null role and text count as empty, rows without ``conv_id`` are
    left out, repeated rows count each, other columns are not read. A conversation may hold most of all rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    h1, h2 = _two(role, text)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", h1.alias("h1"), h2.alias("h2"), F.char_length(text).cast("bigint").alias("letters"))
    return ordered(rows, ["conv_id"], ["turn", "h1", "h2"]).scan(place=position()).df.select("conv_id", "place", *TURN)


def heads_taken_over(turns: DataFrame, block: int, most: int) -> DataFrame:
    """``turns`` with the first turns of each conversation replaced by those of the first conversation of its block.

    How many is ``crc32(conv_id) % most``; of the own turns so many are left out, of the block's first conversation so many taken, as
    far as there are any. Places then have gaps, but keep their order.
    """
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % most
    own = turns.filter(F.col("place") > head)
    leads = (turns.filter((F.col("conv_id") % block == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.collect_list(F.struct("place", *TURN)).alias("lead")))  # fewer than ``most`` turns
    ids = turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    taken = ids.join(leads, "base").select("conv_id", head.alias("head"), F.explode("lead").alias("turn")).filter("turn.place <= head")
    return own.unionByName(taken.select("conv_id", "turn.*"))


def _members(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, u1, u2, letters``: each conversation at each node on its path, the root included.

    ``k`` is the node's key, ``u`` its parent's. The key of a prefix is made of the sums of its turns' hashes, which cover the turns'
    places, so it comes from prefix sums and no task needs a whole conversation.
    """
    layout = ordered(turns, ["conv_id"], ["place"]).scan(depth=position())
    a, b = _two("depth", "h1", "h2")
    halves = {"s1": F.shiftright(a, 32), "s2": a.bitwiseAND(0xFFFFFFFF), "s3": F.shiftright(b, 32), "s4": b.bitwiseAND(0xFFFFFFFF)}
    layout = layout.with_df(layout.df.withColumns(halves)).scan(**{f"p{s}": running_sum(F.col(s)) for s in halves})
    k1, k2 = _two("depth", *[F.col(f"p{s}") for s in halves])
    u1, u2 = _two((F.col("depth") - 1).cast("bigint"), *[F.col(f"p{s}") - F.col(s) for s in halves])
    deeper = layout.df.select("conv_id", F.col("depth").cast("bigint").alias("depth"), k1.alias("k1"), k2.alias("k2"), u1.alias("u1"), u2.alias("u2"), "letters")
    zero = F.lit(0).cast("bigint")
    r1, r2 = _two(zero, *[zero] * len(halves))
    none = F.lit(None).cast("bigint")
    return ids.select("conv_id", zero.alias("depth"), r1.alias("k1"), r2.alias("k2"), none.alias("u1"), none.alias("u2"), zero.alias("letters")).unionByName(deeper)


def _streamed_digests(parts: DataFrame) -> DataFrame:
    """``k1, k2, digest`` of nodes with more than one slice: slices pass in order through one running digest per node."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            for k1, k2, text in zip(*[batch.column(n).to_pylist() for n in range(3)]):
                if (k1, k2) != now:
                    if running is not None:
                        yield made(now, running)
                    now, running = (k1, k2), hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
        if running is not None:
            yield made(now, running)

    def made(key: tuple[int, int], running) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([running.hexdigest()])], [*KEY, "digest"])
    dealt = parts.repartition(*KEY).sortWithinPartitions(*KEY, "slice").select(*KEY, "text")
    return mapped(dealt, compute, "k1 bigint, k2 bigint, digest string")


def _ends(members: DataFrame) -> DataFrame:
    """``k1, k2, digest``: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined in slices. A digest has one order, so the slices of a node pass one task, but as a stream of long texts.
    """
    ends = members.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("key")).select("conv_id", "key.*")
    places = ordered(ends, KEY, ["conv_id"]).scan(place=position()).df
    parts = written(places.groupBy(*KEY, F.expr(f"(place - 1) div {SLICE}").alias("slice"))
                    .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text")))
    long = parts.filter("slice = 1").select(*KEY)
    short = parts.join(long, KEY, "left_anti").select(*KEY, F.sha2("text", 256).alias("digest"))
    return short.unionByName(_streamed_digests(parts.join(long, KEY, "left_semi")))


def list_rank(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``id, rank``: the place, from 0, of each element of one doubly linked list ``id, prev, next`` (BIGINT, null at its ends).

    Each round takes out all elements whose hash is above that of both neighbours, a third of all and never two in a row, and closes the gaps;
    a row knows by itself whether it goes, and one shuffle tells its neighbours. A list of at most ``at_once`` elements is ranked by a
    walk. Then the elements come back in reverse: a rank is the rank of the element before plus the distance to it. So work is
    some six times the list in all, in rounds that grow with the logarithm of its length.

    An empty list gives no rows; rows that are no single list are an error.
    """
    def goes(level: int) -> Column:
        own = F.xxhash64(F.lit(level), "id")
        return F.coalesce((own > F.xxhash64(F.lit(level), "prev")) & (own > F.xxhash64(F.lit(level), "next")) &
                          F.col("prev").isNotNull() & F.col("next").isNotNull(), F.lit(False))
    levels = [written(links.select("id", "prev", "next", F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("gap")))]
    none = F.lit(None).cast("bigint")
    while levels[-1].count() > at_once:
        now, out = levels[-1], goes(len(levels) - 1)
        told = F.explode(F.array(F.struct(F.col("prev").alias("id"), none.alias("new_prev"), F.col("next").alias("new_next"), none.alias("more")),
                                 F.struct(F.col("next").alias("id"), F.col("prev").alias("new_prev"), none.alias("new_next"), F.col("gap").alias("more"))))
        both = now.filter(~out).unionByName(now.filter(out).select(told.alias("m")).select("m.*"), allowMissingColumns=True)
        levels.append(written(both.groupBy("id").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"), F.coalesce(F.max("new_next"), F.max("next")).alias("next"),
            (F.max("gap") + F.coalesce(F.sum("more"), F.lit(0))).alias("gap"))))
    rest = {r["prev"]: r for r in levels[-1].collect()}  # at most ``at_once``
    ranks, rank, row = [], 0, rest.get(None)
    while row is not None:
        rank += row["gap"]
        ranks.append((row["id"], rank))
        row = rest.get(row["id"])
    if len(ranks) != len(rest) or len(rest) != levels[-1].count():
        raise ValueError("the rows are not one list")
    found = links.sparkSession.createDataFrame(ranks, "id bigint, rank bigint")
    for level in reversed(range(len(levels) - 1)):
        before = found.select(F.col("id").alias("prev"), "rank")
        back = levels[level].filter(goes(level)).join(before, "prev").select("id", (F.col("rank") + F.col("gap")).alias("rank"))
        found = found.unionByName(written(back))
    return found


def _tree(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their number, parent, neighbours among its children, and first and last child."""
    numbered, _ = global_prefix(nodes, ["conv_id", "depth"], num=F.lit(1))
    numbered = written(numbered)
    above = numbered.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("num").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = written(numbered.join(above, ["u1", "u2"], "left").drop("u1", "u2"))
    children = placed.filter("parent is not null").select("parent", "num")
    family = children.groupBy("parent").agg(F.min("num").alias("first"), F.max("num").alias("last"), F.count(F.lit(1)).alias("n_children"))
    beside = ordered(children, ["parent"], ["num"]).scan(before=previous(F.col("num"))).scan(backward=True, after=previous(F.col("num"))).df.drop("parent")
    return written(placed.join(beside, "num", "left").join(family.withColumnRenamed("parent", "num"), "num", "left"))


def _tour(tree: DataFrame) -> DataFrame:
    """``id, prev, next`` of the Euler tour: the arc into node n has id 2n, the arc out of it 2n + 1."""
    def into(c: str) -> Column:
        return 2 * F.col(c)

    def out_of(c: str) -> Column:
        return 2 * F.col(c) + 1
    enter = F.struct(into("num").alias("id"), F.coalesce(out_of("before"), into("parent")).alias("prev"), F.coalesce(into("first"), out_of("num")).alias("next"))
    leave = F.struct(out_of("num").alias("id"), F.coalesce(out_of("last"), into("num")).alias("prev"), F.coalesce(into("after"), out_of("parent")).alias("next"))
    return tree.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*")


def prefix_trie(ids: DataFrame, turns: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Nodes of the trie of all conversations ``ids`` (``conv_id``) with their ``turns`` (as of :func:`turn_digests`).

    A node is a distinct sequence of first turns; ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``:
    its smallest conversation, its length, its parent's smallest conversation (null at the root), the conversations that start with it, its
    children, the childless nodes of its subtree, the letters saved in its subtree if equal prefixes are stored once, and the digest of the
    conversations that end here.

    The tour enters and leaves every node once. With its arcs ranked, the leaves and savings of a subtree are what the running sums
    gain between both arcs of its top. Nodes and conversations of any size are split; nothing but a list of ``at_once`` arcs is ever in
    one place. Prefixes are told apart by 128 bits of hash sums. Conversations without turns end at the root. No conversation: no rows.
    """
    members = written(_members(ids, turns))
    grouped = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
                                        F.max("letters").alias("letters"), F.max("u1").alias("u1"), F.max("u2").alias("u2"))
    tree = _tree(grouped)
    leaf = F.col("n_children").isNull().cast("bigint")
    weights = tree.select("num", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("letters")).alias("saved"))
    arcs = list_rank(_tour(tree), at_once).select("rank", F.expr("id div 2").alias("num"), (F.col("id") % 2 == 1).alias("out")).join(weights, "num")
    at, _ = global_prefix(arcs, ["rank"], leaves=F.when(~F.col("out"), F.col("leaf")).otherwise(0), savings=F.when(~F.col("out"), F.col("saved")).otherwise(0))

    def gained(c: str) -> Column:
        return F.sum(F.when(F.col("out"), F.col(c)).otherwise(-F.col(c)))
    sums = at.groupBy("num").agg(gained("leaves").alias("n_leaves"), gained("savings").alias("saved_tokens"))
    return tree.join(sums, "num").join(_ends(members), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
