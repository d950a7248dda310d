"""What the two vector searches share: usable vectors, shards packed into rows, queries in blocks, and the merge of shard results."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a shard and queries of a block at most, about; both are packed into one row each, so the sizes bound a task's memory.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: Query blocks for which a shard's row is sent once.
TASK_BLOCKS = 32


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, v) of the rows whose vectors have only finite components (and, unless ``zero``, one other than 0) and the commonest size.

    Rows without an id take no part: nothing could name them.
    """
    v = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").head(1)
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def packed(rows: DataFrame, group: Column, build: Callable[[np.ndarray, np.ndarray], bytes], groups: int) -> DataFrame:
    """One row (part, blob) for each group of about equal size: ``build`` makes the blob from ids and a matrix."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table.column("v").combine_chunks()
        matrix = np.asarray(flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).reshape(len(ids), -1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([build(ids[order], matrix[order])], pa.binary())})

    return rows.select("vec_id", "v", group.cast("long").alias("part")).repartition(max(1, groups), "part").groupBy("part").applyInArrow(work, "part long, blob binary")


def searched(index: DataFrame, blocks: DataFrame, find: Callable[[Any, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]], shards: int, n_blocks: int, score: str) -> DataFrame:
    """Rows (query_id, vec_id, score) that ``find`` makes of every query block and every shard, a stated query set against all rows.

    A shard's row is dealt once for every ``TASK_BLOCKS`` query blocks. It comes first in its group of a task, is unpacked once and kept
    while the group's query blocks pass by one at a time.
    """
    copies = max(1, -(-n_blocks // TASK_BLOCKS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.select(F.col("part").alias("shard"), every(copies).alias("copy"), F.lit(-1).cast("long").alias("block"), "blob")
    right = blocks.select(every(shards).alias("shard"), F.pmod("part", F.lit(copies)).cast("long").alias("copy"), F.col("part").alias("block"), "blob")
    dealt = left.unionByName(right).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, graph = None, None
        for batch in batches:
            for shard, copy, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if block < 0:
                    own, graph = (shard, copy), pickle.loads(blob.as_buffer())
                elif own == (shard, copy):  # a shard without rows has no index
                    q, v, s = find(graph, blob.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s)], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(work, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first ``k`` rows of each query by ``order`` then vec_id, with rank from 1. Only so many rows of a query and task are shuffled."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
