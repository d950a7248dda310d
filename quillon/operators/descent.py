"""An approximate nearest-neighbour graph by neighbour descent: neighbours of neighbours are likely neighbours.

Documents begin with the neighbours of their blocks along hashed orders. In a round each document's neighbours, and a bounded number of
those it is a neighbour of, meet at it and are compared with each other, unless both were there before. Work of a round grows with the rows:
a meeting has at most four times ``pool`` members, and a document that very many name takes in a bounded, hashed few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions.vec import cos
from quillon.sources.shared import dropped, kept

#: Documents of a first block, hashed orders to begin with, and planes that make an order.
BLOCK, ORDERS, PLANES = 96, 3, 24
#: Digits to which weights are compared, so that equal pairs of different tasks are equal.
DIGITS = 9
EDGES = "docid long, neighbour long, weight double"


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def pairs(ids: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docid, neighbour, weight) of each row's ``k`` best columns of a symmetric table that reach the row's floor."""
    at = np.argpartition(-sims, min(k, sims.shape[1]) - 1, 1)[:, :k] if sims.shape[1] > k else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    i, j = np.repeat(np.arange(len(ids)), at.shape[1]), at.ravel()
    s = sims[i, j]
    good = s > floor[i]
    return ids[i[good]], ids[j[good]], s[good]


def edges_batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["docid", "neighbour", "weight"])


def signature(v: Column, size: int, seed: int) -> Column:
    """The sides of hashed planes on which a vector lies, as a number: vectors of a small angle often share its first digits."""
    planes = np.random.default_rng(seed).standard_normal((PLANES, size))

    def sides(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in parts:
            yield pa.array((matrix(x, len(x)) @ planes.T > 0) @ (1 << np.arange(PLANES)[::-1]))

    sides.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(sides, "long")(v)


def first_edges(rows: DataFrame, size: int, pool: int, orders: int, seed: int) -> DataFrame:
    """Edges within blocks of ``BLOCK`` rows along the orders of their signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), matrix(batch.column(1), batch.num_rows)
            found = []
            for at in range(0, len(ids), BLOCK):
                own, x = ids[at : at + BLOCK], v[at : at + BLOCK]
                sims = np.round(x @ x.T, DIGITS)
                np.fill_diagonal(sims, -np.inf)
                found.append(pairs(own, sims, pool, np.full(len(own), -np.inf)))
            if found:
                yield edges_batch(found)

    out = None
    for i in range(orders):
        key = signature(F.col("v"), size, seed + i)
        part = rows.withColumn("key", key).repartitionByRange("key", "docid").sortWithinPartitions("key", "docid").select("docid", "v").mapInArrow(work, EDGES)
        out = part if out is None else out.unionByName(part)
    return out


def best(edges: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` best of each document, each once; ``fresh`` only where no older edge is equal. What a task holds is cut before it is shuffled."""
    place = F.dense_rank().over(W.partitionBy("docid").orderBy(F.desc("weight"), "neighbour"))
    near = edges.withColumn("place", place).where(F.col("place") <= pool)
    return near.groupBy("docid", "place").agg(F.first("neighbour").alias("neighbour"), F.first("weight").alias("weight"), F.min("fresh").alias("fresh")).drop("place")


def compared(members: DataFrame, pool: int) -> DataFrame:
    """Edges between the members (at, docid, fresh, v, worst) of each meeting of which at least one is fresh, better than the worst that a document has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meeting(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.concatenate([p.column(1).to_numpy() for p in parts])
            fresh = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
            x = np.concatenate([matrix(p.column(3), p.num_rows) for p in parts])
            worst = np.concatenate([p.column(4).to_numpy() for p in parts])
            sims = np.round(x @ x.T, DIGITS)
            sims[~(fresh[:, None] | fresh[None])] = -np.inf
            np.fill_diagonal(sims, -np.inf)
            return pairs(ids, sims, pool, np.where(np.isfinite(worst), worst - 2 * 10.0**-DIGITS, -np.finfo(float).max))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            found = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                if held and held[0].column(0)[0] != part.column(0)[0]:
                    found.append(meeting(held))
                    held = []
                held.append(part)
            if found:
                yield edges_batch(found)
        if held:
            yield edges_batch([meeting(held)])

    dealt = members.select("at", "docid", "fresh", "v", "worst").repartition("at").sortWithinPartitions("at", "docid")
    return dealt.mapInArrow(work, EDGES)


def approximate_graph(vectors: DataFrame, k: int = 16, pool: int | None = None, rounds: int = 12, least_change: float = 0.002, seed: int = 7, orders: int = ORDERS) -> DataFrame:
    """(docid, slot, neighbour, weight): for each document (docid, doc_vec) about its k nearest by cosine, best first, weights exact.

    ``pool`` neighbours are held on the way, three times k and 24 at least by default. Ends when a round changes less than ``least_change``
    of all edges, or after ``rounds``. Zero vectors and null ones take no part; a table of one document has no edge.
    """
    pool = max(24, 3 * k) if pool is None else pool
    length = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("docid", F.col("doc_vec").cast("array<double>").alias("v")).where(length > 0)
    rows = kept(rows.select("docid", F.transform("v", lambda x: x / length).alias("v")), "descent")
    one = rows.head(1)
    edges = kept(best(first_edges(rows, len(one[0]["v"]) if one else 1, pool, orders, seed).withColumn("fresh", F.lit(True)), pool), "descent")
    for turn in range(rounds):
        back = edges.select(F.col("neighbour").alias("at"), "docid", "fresh")
        nth = F.row_number().over(W.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("docid", F.lit(turn)), "docid"))
        back = back.withColumn("nth", nth).where(F.col("nth") <= pool).drop("nth")
        own = edges.select(F.col("docid").alias("at"), F.col("neighbour").alias("docid"), "fresh")
        meet = own.unionByName(back).groupBy("at", "docid").agg(F.max("fresh").alias("fresh"))
        worst = edges.groupBy("docid").agg(F.min("weight").alias("worst"), F.count("*").alias("n")).select("docid", F.when(F.col("n") >= pool, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("worst"))
        members = meet.join(rows.join(worst, "docid"), "docid")
        new = compared(members, pool).withColumn("fresh", F.lit(True))
        old, edges = edges, kept(best(edges.withColumn("fresh", F.lit(False)).unionByName(new), pool), "descent")
        changed, total = edges.agg(F.sum(F.col("fresh").cast("long")), F.count("*")).first()
        dropped(old)
        if not total or changed <= least_change * total:
            break
    nth = F.row_number().over(W.partitionBy("docid").orderBy(F.desc("weight"), "neighbour"))
    near = edges.withColumn("nth", nth).where(F.col("nth") <= k + 4).select("docid", "neighbour")
    both = near.join(vectors.select("docid", F.col("doc_vec").alias("a")), "docid").join(vectors.select(F.col("docid").alias("neighbour"), F.col("doc_vec").alias("b")), "neighbour")
    exact = both.select("docid", "neighbour", cos("a", "b").alias("weight"))
    return exact.withColumn("slot", (nth - 1).cast("int")).where(F.col("slot") < k).select("docid", "slot", "neighbour", "weight")
