"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays, shard results merged."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import mix64, written
from quillon.llm.vectors import BLOCK_QUERIES, SHARD_ROWS, packed, searched, usable

#: Links that a new node gets (a node holds twice as many), the beam of a search, that of an insertion, and that on the upper levels.
NEIGHBOURS, BEAM, INSERT_BEAM, UPPER_BEAM = 24, 160, 64, 32
#: Nodes inserted at a time, and rows of a step of array work.
BATCH, ROWS = 512, 512


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass
class Graph:
    """levels: from the bottom, which holds all nodes, up, the neighbours of every node [nodes, width] as node numbers, -1 where there is none; top: the nodes of the highest level."""

    ids: np.ndarray
    matrix: np.ndarray
    levels: list[np.ndarray]
    top: np.ndarray


def diverse(x: np.ndarray, base: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each base node's candidates [base, some], nearest first, those that are nearer to it than to any chosen before; -1 beyond them."""
    out = np.full((len(base), width), -1, np.int32)
    for at in range(0, len(base), ROWS):
        some = near[at : at + ROWS]
        y = x[np.maximum(some, 0)]
        norm = (y * y).sum(2)
        own = x[base[at : at + ROWS]]
        d = np.where(some >= 0, norm + (own * own).sum(1)[:, None] - 2 * np.matmul(y, own[:, :, None])[:, :, 0], np.inf)
        order = np.argsort(d, 1, kind="stable")
        some, d, norm, y = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(norm, order, 1), np.take_along_axis(y, order[:, :, None], 1)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        chosen = np.zeros(some.shape, bool)
        for j in range(some.shape[1]):
            chosen[:, j] = np.isfinite(d[:, j]) & ~(chosen & (between[:, j] < d[:, j, None])).any(1) & (chosen.sum(1) < width)
        first = np.argsort(~chosen, 1, kind="stable")[:, :width]
        out[at : at + ROWS, : first.shape[1]] = np.where(np.take_along_axis(chosen, first, 1), np.take_along_axis(some, first, 1), -1)
    return out


def walk(x: np.ndarray, norm: np.ndarray, links: np.ndarray, ask: np.ndarray, entries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and squared distances of the ``beam`` nearest nodes met from the entries [queries, some], nearest first (-1 and inf where fewer). All queries step together."""
    q, n = len(ask), len(x)
    own = (ask * ask).sum(1)
    beam = max(beam, entries.shape[1], wide + 1)
    found, dist = np.full((q, beam), -1, np.int64), np.full((q, beam), np.inf)
    e = entries.shape[1]
    found[:, :e] = entries
    dist[:, :e] = np.where(entries >= 0, np.maximum(own[:, None] + norm[entries] - 2 * np.matmul(x[entries], ask[:, :, None])[:, :, 0], 0), np.inf)
    done = ~np.isfinite(dist)
    seen = np.zeros((q, n), bool)
    r, c = np.nonzero(entries >= 0)
    seen[r, entries[r, c]] = True
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_, wide - 1, 1)[:, :wide]  # so many nodes are expanded a step
        fine = np.isfinite(np.take_along_axis(open_, pick, 1))
        go = fine.any(1)
        live, pick, fine = live[go], pick[go], fine[go]
        if not len(live):
            break
        done[live[:, None], pick] = True
        around = np.where(fine[:, :, None], links[np.maximum(found[live[:, None], pick], 0)], -1).reshape(len(live), -1)
        around.sort(1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        around[seen[live[:, None], np.maximum(around, 0)]] = -1
        r, c = np.nonzero(around >= 0)
        seen[live[r], around[r, c]] = True
        d = np.full(around.shape, np.inf)
        d[r, c] = np.maximum(own[live[r]] + norm[around[r, c]] - 2 * (ask[live[r]] * x[around[r, c]]).sum(1), 0)
        nodes, dists, closed = np.concatenate([found[live], around], 1), np.concatenate([dist[live], d], 1), np.concatenate([done[live], np.zeros(d.shape, bool)], 1)
        best = np.argpartition(dists, beam - 1, 1)[:, :beam]
        found[live], dist[live], done[live] = (np.take_along_axis(v, best, 1) for v in (nodes, dists, closed))
        done[live] |= ~np.isfinite(dist[live])
    order = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)


def descended(x: np.ndarray, norm: np.ndarray, above: list[np.ndarray], top: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Entries for a level [queries, some]: the nearest nodes met on the levels above it, from the highest down."""
    first = top[: 4 * UPPER_BEAM]
    near = np.argsort(squared(ask, x[first]), 1, kind="stable")[:, :UPPER_BEAM]
    entries = first[near]
    for links in reversed(above):
        entries = walk(x, norm, links, ask, entries, UPPER_BEAM)[0][:, :UPPER_BEAM]
    return entries


def inserted(x: np.ndarray, norm: np.ndarray, nodes: np.ndarray, known: int, above: list[np.ndarray], top: np.ndarray, width: int) -> np.ndarray:
    """One level's links after inserting ``nodes`` in order; the first ``known`` of them are those of the level above, through which the others enter.

    A batch of nodes searches the graph so far, and takes as neighbours the diverse ones of what it meets and of its own members. Links go
    both ways; a node that holds too many keeps the diverse ones. At last every part that the first node does not reach is linked to it.
    """
    links = np.full((len(x), 2 * width), -1, np.int32)
    at = 0
    while at < len(nodes):
        size = min(BATCH, len(nodes) - at) if at >= known else min(BATCH, known - at)
        new, ask = nodes[at : at + size], x[nodes[at : at + size]]
        gap = squared(ask, ask)
        np.fill_diagonal(gap, np.inf)
        some = min(2 * width, size - 1)
        inner = np.argsort(gap, 1, kind="stable")[:, :some]
        near = new[inner] if some else np.zeros((size, 0), np.int64)
        if at:
            entries = descended(x, norm, above, top, ask) if at >= known else np.repeat(nodes[None, : min(at, UPPER_BEAM)], size, 0)
            near = np.concatenate([near, walk(x, norm, links, ask, entries, INSERT_BEAM)[0]], 1)
        chosen = diverse(x, new, near, width)
        links[new, :width] = chosen
        a, b = np.repeat(new, width), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        for target, source in _by_target(b, a):
            _linked(x, links, target, source, width)
        at += size
    return _reached(x, links, nodes)


def _by_target(to: np.ndarray, source: np.ndarray, most: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """The back links grouped by their target, in rounds of at most ``most`` a target: (targets, sources [targets, most], -1 beyond them)."""
    order = np.lexsort((source, to))
    to, source = to[order], source[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    out = []
    for r in range(0, int(place.max(initial=-1)) + 1, most):
        here = (place >= r) & (place < r + most)
        targets, row = np.unique(to[here], return_inverse=True)
        table = np.full((len(targets), most), -1, np.int64)
        table[row, place[here] - r] = source[here]
        out.append((targets, table))
    return out


def _linked(x: np.ndarray, links: np.ndarray, target: np.ndarray, source: np.ndarray, width: int) -> None:
    """Adds the sources to the targets' links, in place; where they do not fit, the diverse ones of all stay."""
    both = np.concatenate([links[target], source], 1)
    both = -np.sort(-both, 1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    both = -np.sort(-both, 1)
    full = (both >= 0).sum(1) > 2 * width
    links[target[~full]] = both[~full, : 2 * width]
    if full.any():
        links[target[full]] = diverse(x, target[full], both[full], 2 * width)


def _reached(x: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The links, and one more both ways between each part that the first node does not reach and the nearest of what it does."""
    seen = np.zeros(len(x), bool)
    new = nodes[:1]
    while True:
        while len(new):
            seen[new] = True
            new = np.unique(links[new])
            new = new[new >= 0]
            new = new[~seen[new]]
        rest = nodes[~seen[nodes]]
        if not len(rest):
            return links
        inside = nodes[seen[nodes]]
        near = inside[squared(x[rest[:1]], x[inside]).argmin()]
        for a, b in ((near, rest[0]), (rest[0], near)):
            free = np.flatnonzero(links[a] < 0)
            if not len(free):  # room for it
                links = np.concatenate([links, np.full((len(links), 1), -1, np.int32)], 1)
                free = np.array([links.shape[1] - 1])
            links[a, free[0]] = b
        new = rest[:1]


def build(ids: np.ndarray, matrix: np.ndarray, width: int = NEIGHBOURS) -> Graph:
    """Levels thin out by a factor of ``width``, by a hash of the id; each is built by insertion, from the highest down, in the order of another hash."""
    x = matrix.astype(np.float64)  # near copies differ by less than single precision leaves of a difference of squares
    norm = (x * x).sum(1)
    share = mix64(ids.astype(np.int64).view(np.uint64)).astype(np.float64) / 2.0**64
    height = np.minimum(np.floor(-np.log(np.maximum(share, 1e-18)) / np.log(width)).astype(np.int64), int(np.log(max(1, len(ids))) / np.log(width)))
    order = np.lexsort((mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(1)), -height))
    above: list[np.ndarray] = []
    top, known = np.zeros(0, np.int64), 0
    for level in range(int(height.max(initial=0)), -1, -1):
        nodes = order[: int((height >= level).sum())]
        top = top if len(top) else nodes
        above.insert(0, inserted(x, norm, nodes, known, above, top, width if not level else max(4, width // 2)))
        known = len(nodes)
    return Graph(ids, matrix, above, top)


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and squared distances of the ``beam`` nearest found for each query, nearest first (-1 and inf where fewer)."""
    x, ask = graph.matrix.astype(np.float64), queries.astype(np.float64)
    norm = (x * x).sum(1)
    return walk(x, norm, graph.levels[0], ask, descended(x, norm, graph.levels[1:], graph.top, ask), beam)


def nearest_neighbours(vectors: DataFrame, queries_every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = 256, width: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every query, a row whose id ``queries_every`` divides; score is the Euclidean distance.

    Every row is indexed: equal vectors are one node that carries its k + 1 smallest ids, which are all that a result can hold of it. Rows
    without an id, and vectors that are null, empty, zero, of another than the commonest size, or hold null or non-finite components take
    no part. Ties go to the smaller id; fewer candidates give fewer rows; of rows that repeat a query's id none is its candidate, and the
    least vector asks. Other columns are not read. An empty table gives an empty one. Distances are recomputed in double precision on the original vectors.
    """
    rows = usable(vectors, vec_id, embedding, zero=False)
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    least = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = written(least.select(F.col("ids")[0].alias("vec_id"), "v", "ids"), "nodes")
    asked = rows.where(F.col("vec_id") % queries_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, q = nodes.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_queries))
    index = written(packed(nodes, F.pmod(F.xxhash64("vec_id"), F.lit(shards)), lambda ids, m: pickle.dumps(build(ids, m, width)), shards), "graphs")
    ask = packed(asked, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), lambda ids, m: pickle.dumps((ids, m)), blocks)

    def find(graph: Graph, qs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, questions = pickle.loads(qs)
        found, _ = search(graph, questions, beam)
        found = found[:, : 2 * k + 8]
        exact = np.sqrt(((questions[:, None, :] - graph.matrix[np.maximum(found, 0)]) ** 2).sum(2))
        exact[found < 0] = np.inf
        ids = graph.ids[np.maximum(found, 0)]
        order = np.lexsort((ids, exact), axis=1)
        exact, ids = np.take_along_axis(exact, order, 1), np.take_along_axis(ids, order, 1)
        mine = ids == own[:, None]  # nodes of the query's own id take no other's place
        r, c = np.nonzero(np.isfinite(exact) & (mine | (np.cumsum(~mine, 1) <= k + 1)))
        return own[r], ids[r, c], exact[r, c]

    near = searched(index, ask, find, shards, blocks, "double")
    top = near.withColumn("at", F.row_number().over(W.partitionBy("query_id", F.col("vec_id") == F.col("query_id")).orderBy("score", "vec_id"))).where((F.col("at") <= k + 1) | (F.col("vec_id") == F.col("query_id")))
    every = top.join(nodes.select("vec_id", "ids"), "vec_id").select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
