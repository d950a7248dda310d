"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

A shard keeps, for each dimension, its rows sorted by that component. A query walks all lists at once from the end that its sign favours,
scores every new row it meets in full, and stops as soon as the best score that an unmet row could have is below its kth score.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written
from quillon.llm.vectors import BLOCK_QUERIES, SHARD_ROWS, best, packed, searched, usable


def sorted_lists(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """A shard: ids, components, and for each dimension the row numbers by rising component."""
    return pickle.dumps((ids, matrix, np.ascontiguousarray(np.argsort(matrix, 0, kind="stable").T.astype(np.int32))))


def threshold_top(ids: np.ndarray, matrix: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers and scores of the k best rows but the one with id ``own``, ties to the smaller id, and how many rows were scored.

    After the rows at depth t of all lists have been met, an unmet row can score at most the sum of query * component at depth t. The
    walk goes on while that bound is not below the kth score: an unmet row of an equal score could have a smaller id.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    up = query[used] > 0
    met = np.zeros(n, bool)
    met[ids == own] = True
    rows, scores = np.zeros(0, np.int64), np.zeros(0, matrix.dtype)
    depth, scored = 0, 0
    if not len(used):  # every score is 0
        rows = np.flatnonzero(~met)[:k]
        return rows, np.zeros(len(rows), matrix.dtype), len(rows)

    def bound(t: int) -> float:
        at = lists[used, np.where(up, n - t, t - 1)]
        return float((query[used] * matrix[at, used]).sum())

    while depth < n:
        to = min(n, max(step, depth * 2))
        if len(scores) >= k:  # how deep the walk must go if no better row turns up; the bound falls with depth
            low, high = depth + 1, n
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if bound(mid) < scores[k - 1] else (mid + 1, high)
            to = min(to, low)
        seen = np.concatenate([lists[d, n - to : n - depth] if u else lists[d, depth:to] for d, u in zip(used, up, strict=True)])
        fresh = np.zeros(n, bool)
        fresh[seen] = True
        fresh &= ~met
        new = np.flatnonzero(fresh)
        met |= fresh
        scored += len(new)
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, matrix[new] @ query])
        order = np.lexsort((ids[rows], -scores))[:k] if len(rows) <= 4 * k else _first(ids, rows, scores, k)
        rows, scores = rows[order], scores[order]
        depth = to
        if met.all() or (len(scores) >= k and bound(depth) < scores[k - 1]):
            break
    return rows, scores, scored


def _first(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[rows[some]], -scores[some]))[:k]]


def exact_top_k(vectors: DataFrame, queries_every: int = 20, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of every query, a row whose id ``queries_every`` divides.

    Components become floor(scale * x). Rows without an id, and vectors that are null, empty, of another than the commonest size, or hold
    null or non-finite components take no part; zero vectors score 0. Ties go to the smaller id; fewer candidates give fewer rows; equal
    vectors are rows like any other; of rows that repeat a query's id none is its candidate, and the least vector asks. Other columns are not read. An empty table
    gives an empty one. No score, and no part of one, exceeds the largest squared integer length, so scores
    are exact in double precision below 2**53; a table that reaches this is refused with ValueError.
    """
    rows = usable(vectors, vec_id, embedding).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    is_query = F.col("vec_id") % queries_every == 0
    n, q, most = rows.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if (most or 0) >= 2.0**53:
        raise ValueError("a vector's squared integer length reaches 2**53, beyond which scores in double precision are not exact")
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_queries))
    index = written(packed(rows, F.pmod(F.xxhash64("vec_id"), F.lit(shards)), sorted_lists, shards), "lists")
    asked = packed(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), lambda ids, m: pickle.dumps((ids, m)), blocks)

    def find(shard: tuple[np.ndarray, np.ndarray, np.ndarray], qs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ids, matrix, lists), (own, questions) = shard, pickle.loads(qs)
        got = [threshold_top(ids, matrix, lists, x, int(i), k)[:2] for i, x in zip(own, questions, strict=True)]
        return np.repeat(own, [len(r) for r, _ in got]), ids[np.concatenate([r for r, _ in got])], np.concatenate([s for _, s in got]).astype(np.int64)

    return best(searched(index, asked, find, shards, blocks, "long"), k, F.desc("score"))
