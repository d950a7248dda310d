"""Streams of documents into a store, and streams of queries against one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.shared import dropped, kept
from quillon.sources.store import VectorStore, exists, new_meta, read_meta, rows_of, with_docids, write_meta


def stream_name(checkpoint: str) -> str:
    """A stream is its checkpoint: a second one of its own numbers its batches from 0 again."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _counted(rows: DataFrame, meta: dict) -> int:
    """The number of rows, whose vectors need the store's size; the first rows give the store its size."""
    low, high, n = rows.agg(F.min(F.size("doc_vec")), F.max(F.size("doc_vec")), F.count("*")).first()
    if n and (low != high or low <= 0 or meta["size"] not in (0, high)):
        raise ValueError(f"vectors of sizes {low} to {high} for a store of {meta['size']}")
    meta["size"] = meta["size"] or high or 0
    return n


def _started(docs: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _opened(spark: SparkSession, path: str, sim: str, stream: str, number: int) -> dict:
    """The properties for a batch; what it may have added before, if it runs again, does not count."""
    meta = read_meta(spark, path) if exists(spark, path) else new_meta(sim)
    last = meta["streams"].get(stream)
    if last and last[0] == number and last[3]:
        meta["count"] -= last[2]
        last[3] = False
    return meta


def _reserved(spark: SparkSession, path: str, meta: dict, stream: str, number: int, n: int) -> int:
    """The first docid of a batch of ``n`` new ones: the one it had before, if it runs again. Written down before any row is."""
    last = meta["streams"].get(stream)
    first = last[1] if last and last[0] == number else meta["next"]
    meta["next"] = max(meta["next"], first + n)
    meta["streams"][stream] = [number, first, n, False]
    write_meta(spark, path, meta)
    return first


def _done(spark: SparkSession, path: str, meta: dict, stream: str) -> None:
    """The batch's rows are there: from now on they are read."""
    meta["streams"][stream][3] = True
    meta["count"] += meta["streams"][stream][2]
    write_meta(spark, path, meta)


def append_vectors(docs: DataFrame, path: str, checkpoint: str, sim: str = "dot") -> StreamingQuery:
    """Append a stream of (docno, doc_vec) to a store, which is begun where there is none; docids go on where the store ends.

    Any number of streams may append, one after the other: batches are named by stream and number. A batch's docids are reserved in the
    store's properties before its rows are written, and its rows are read once the properties say that it is done. So a batch that runs
    again takes the same docids and replaces its own rows, and nothing else can take them meanwhile. All vectors need the size of the
    store's. No folder stays behind a batch, even one that fails.
    """
    stream = stream_name(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        meta = _opened(spark, path, sim, stream, number)
        rows = with_docids(batch.select("docno", F.col("doc_vec").cast("array<float>").alias("doc_vec")), "docno")
        try:
            n = _counted(rows, meta)
            if n:
                first = _reserved(spark, path, meta, stream, number, n)
                rows.withColumn("docid", F.col("docid") + first).select("docid", "docno", "doc_vec").write.mode("overwrite").parquet(f"{path}/vectors/batch={stream}-{number}")
                _done(spark, path, meta, stream)
        finally:
            dropped(rows)

    return _started(docs, checkpoint, add)


def upsert_vectors(docs: DataFrame, path: str, checkpoint: str, sim: str = "dot", delay: str = "1 hour") -> StreamingQuery:
    """Put a stream of (docno, doc_vec, version) into a store: of each docno the row of the latest version stays, with the docid of its first.

    ``version`` is the rows' event time. Rows that repeat docno and version within ``delay`` are taken once by Spark's state, which the
    watermark bounds; Spark drops rows that come later than that. A late row within the delay takes its place if it is newer than the stored
    version or its docno is new; else it is superseded already. Of rows of one docno and version the one of the least vector stays. A batch
    that runs again gives the same rows and docids. One stream at a time may write to a store.
    """
    stream = stream_name(checkpoint)

    def put(batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, f"batch={stream}-{number}"
        meta = _opened(spark, path, sim, stream, number)
        rows = batch.select("docno", F.col("doc_vec").cast("array<float>").alias("doc_vec"), F.col("version").cast("timestamp").alias("version"))
        latest = F.min_by(F.struct("doc_vec", "version"), F.struct(-F.unix_micros("version"), F.col("doc_vec"))).alias("x")
        last = kept(rows.groupBy("docno").agg(latest).select("docno", "x.*"), "upserts")
        if _counted(last, meta):
            known = rows_of(spark, path, meta).select("docno", F.col("docid").alias("old"), F.col("version").alias("had")) if meta["next"] else spark.createDataFrame([], "docno string, old long, had timestamp")
            found = kept(last.join(known, "docno", "left"), "upserts")
            fresh = with_docids(found.where(F.col("old").isNull()).select("docno", "doc_vec", "version"), "docno")
            newer = found.where(F.col("old").isNotNull() & (F.col("had").isNull() | (F.col("version") > F.col("had"))))
            first = _reserved(spark, path, meta, stream, number, fresh.count())
            both = fresh.withColumn("docid", F.col("docid") + first).select("docid", "docno", "doc_vec", "version").unionByName(newer.select(F.col("old").alias("docid"), "docno", "doc_vec", "version"))
            both.write.mode("overwrite").parquet(f"{path}/vectors/{place}")
            newer.select(F.col("old").alias("docid"), F.col("had").alias("version")).write.mode("overwrite").parquet(f"{path}/superseded/{place}")
            meta["replaces"] = True
            _done(spark, path, meta, stream)
            dropped(fresh, found)
        dropped(last)

    once = docs.withWatermark("version", delay).dropDuplicatesWithinWatermark(["docno", "version"])
    return _started(once, checkpoint, put)


def search_stream(queries: DataFrame, path: str, out: str, checkpoint: str, k: int = 1000) -> StreamingQuery:
    """Search a store for a stream of queries (qid, query_vec, ...): hits go to ``out``, a folder for each batch, which a rerun replaces.

    Each batch sees the store as it is when the batch begins.
    """
    stream = stream_name(checkpoint)

    def find(batch: DataFrame, number: int) -> None:
        asked = kept(batch, "asked")
        VectorStore.open(batch.sparkSession, path).retrieve(asked, k).write.mode("overwrite").parquet(f"{out}/batch={stream}-{number}")
        dropped(asked)

    return _started(queries, checkpoint, find)
