"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegauge import runtime
from tidegauge.runtime import cut_lineage

#: Vectors in a block, whose lists one task sorts, and queries that meet it there together.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
#: List entries read between two looks at the bound, doubling up to the larger number.
FIRST_DEPTH, MOST_DEPTH = 16, 512


def quantized(embeddings: DataFrame, scale: int = 1024, column: str = "embedding") -> DataFrame:
    """``vec_id, vec, dims`` with each component floor(scale * x); null vectors, and null or non-finite components, drop a row."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.filter(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint")).alias("vec"),
        F.size(x).alias("dims"))


class SortedLists:
    """One block of vectors, and for each dimension the rows in ascending order of the component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]  # equal scores: the smaller id first
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.ordered = np.take_along_axis(self.vectors, self.lists, axis=0)

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (score, id) without rows of id ``own``, and how many rows were scored.

        All lists are read from their good end (the high one where the query is positive). No unread row can score more than the
        sum of query times current component, the bound; reading stops when that is below the k-th best score. A bound
        equal to it does not stop, because an unread row may tie with a smaller id.
        """
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if not len(dims):  # every score is 0
            best = [(0, int(v)) for v in self.ids[self.ids != own][:k]]
            return best, n
        weights, up = query[dims], query[dims] > 0
        seen = self.ids == own
        scores, rows = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step, scored = 0, FIRST_DEPTH, 0
        while depth < n:
            stop = min(n, depth + step)
            fresh = np.unique(np.concatenate([self.lists[depth:stop][:, dims[~up]].ravel(), self.lists[n - stop:n - depth][:, dims[up]].ravel()]))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            scored += len(fresh)
            scores, rows = np.append(scores, self.vectors[fresh] @ query), np.append(rows, fresh)
            best = np.lexsort((rows, -scores))[:k]
            scores, rows = scores[best], rows[best]
            edge = np.where(up, self.ordered[n - stop, dims], self.ordered[stop - 1, dims])
            if len(scores) == k and int(weights @ edge) < scores[-1]:
                break
            depth, step = stop, min(2 * step, MOST_DEPTH)
        return [(int(s), int(self.ids[r])) for s, r in zip(scores, rows)], scored


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, column: str = "embedding",
          block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (over ``vec_id``) holds, the ``k`` rows of largest inner
    product of quantized vectors among all rows but those of the query's own id; ties to the smaller id.

    Vectors and queries are dealt into blocks of bounded size by hash. Every block of queries meets every block of vectors
    in a task of its own, which sorts the lists and runs the threshold algorithm; at most ``k`` rows a query leave it, and the best
    ``k`` of all blocks are kept. The work is queries x vectors in the worst case, as the question is; no task holds
    more than one block of either.

    Null vectors, vectors with null or non-finite components and null ids take no part. Vectors of different lengths do not
    meet. Rows with equal ids: each is a candidate, a repeated query is asked once with its smallest vector. Components
    must be small enough that scores fit 64 bits. An empty table gives no rows; extra columns are not read.
    """
    spark = embeddings.sparkSession
    runtime.ship(spark)
    rows = cut_lineage(quantized(embeddings, scale, column))
    asked = cut_lineage(rows.filter(is_query).groupBy("vec_id", "dims").agg(F.min("vec").alias("vec")))
    n, q = rows.count(), asked.count()
    parts, turns = max(1, -(-n // block_rows)), max(1, -(-q // block_queries))
    salt = F.xxhash64("vec_id", "vec")
    held = rows.withColumn("part", F.pmod(salt, F.lit(parts)).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asks = asked.withColumn("turn", F.pmod(salt, F.lit(turns)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries) and vectors["dims"].iloc[0]:
            lists = SortedLists(vectors["vec_id"].to_numpy(), np.stack(vectors["vec"].to_list()).astype(np.int64))
            for own, vector in zip(queries["vec_id"], queries["vec"]):
                out += [(own, vec, score) for score, vec in lists.top(np.asarray(vector, np.int64), k, own)[0]]
        elif len(vectors):  # vectors without components score 0
            ids = np.sort(vectors["vec_id"].to_numpy())
            out = [(own, vec, 0) for own in queries["vec_id"] for vec in ids[ids != own][:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    found = held.groupBy("part", "turn", "dims").cogroup(asks.groupBy("part", "turn", "dims")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
