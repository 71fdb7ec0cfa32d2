"""Exact top-k search by Fagin's threshold algorithm over sorted lists, one for each dimension.

Candidates are dealt into blocks by a hash of their id, queries likewise, and every query block meets every candidate
block once. A block sorts its candidates by each dimension. A query goes down the lists of its dimensions
together, each from the end where the query's component makes the product large, and scores what it meets for the first time
in full. Nothing unseen can score more than the query's components times the values the lists have reached; when
the k-th result beats that bound, the search ends. Results of all blocks are merged. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

K = 5
SCALE = 256
QUERY_STEP = 50
BLOCK = 4_096
QUERY_BLOCK = 2_048
#: Share of each list that the first round reads; later rounds read twice as much each.
FIRST_DEPTH = 64


def whole(vector: str, scale: int = SCALE) -> Column:
    """The components as whole numbers: floor(scale * x), in doubles; null where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Block:
    """Candidates with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that positions break ties as ids do
        self.ids, self.vectors = ids[order], vectors[order]
        self.exact = self.vectors.astype(np.float64)
        self.lists = np.argsort(-self.exact, axis=0, kind="stable").astype(np.int32)

    def search(self, own_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Score and id of the best candidates but the query's own, best first; of equal scores the smaller id."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        down = query[used] > 0
        weight = query.astype(np.float64)
        seen = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        depth, step = 0, max(1, n // FIRST_DEPTH)
        while depth < n:
            upto = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.lists[depth:upto, used[down]].ravel()] = True
            fresh[self.lists[n - upto:n - depth, used[~down]].ravel()] = True
            if not len(used):
                fresh[depth:upto] = True
            fresh &= ~seen
            seen |= fresh
            met = np.flatnonzero(fresh)
            got = self.exact[met] @ weight
            other = self.ids[met] != own_id
            places, scores = np.concatenate([places, met[other]]), np.concatenate([scores, got[other]])
            if len(places) > k:
                best = self._best(places, scores, k)
                places, scores = places[best], scores[best]
            reached = np.where(down, self.lists[upto - 1, used], self.lists[n - upto, used])
            bound = float(self.exact[reached, used] @ weight[used])
            # An unseen candidate with the k-th score could have a smaller id, so the bound must be beaten.
            if len(places) == k and scores.min() > bound:
                break
            depth, step = upto, step * 2
        order = np.lexsort((places, -scores))
        return [(int(scores[i]), int(self.ids[places[i]])) for i in order]

    @staticmethod
    def _best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        close = np.flatnonzero(scores >= least)
        return close[np.lexsort((places[close], -scores[close]))[:k]]


def matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def search(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best candidates of every query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Queries are the rows whose id is divisible
    by ``query_step``; all rows but those of the query's id are candidates; the score is the inner product of the whole
    numbers of ``whole``. Ties go to the smaller id. Rows with a null id, a null vector, or a null or infinite component take no part;
    a shorter vector counts as filled with zeros, an empty one scores 0. Repeated rows are a candidate each and a query once.
    Sums must stay under 2**53, which 64 components under 11 million do.
    """
    rows = staged(vectors.select("vec_id", whole("embedding").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL"))
    count = rows.count()
    queries = rows.filter(F.col("vec_id") % query_step == 0).distinct()
    blocks, query_blocks = max(1, -(-count // block)), max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(deal(blocks).alias("block"), every(query_blocks).alias("query_block"), "vec_id", F.col("v").cast("array<double>").alias("v"))
    asked = queries.select(every(blocks).alias("block"), deal(query_blocks).alias("query_block"), "vec_id", F.col("v").cast("array<double>").alias("v"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            dims = max(max(map(len, left["v"])), max(map(len, right["v"])))
            part = Block(left["vec_id"].to_numpy(), matrix(list(left["v"]), dims))
            for own, query in zip(right["vec_id"], matrix(list(right["v"]), dims), strict=True):
                found += [(own, vec, score) for score, vec in part.search(own, query, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    best = candidates.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block")).applyInPandas(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows from each block
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
