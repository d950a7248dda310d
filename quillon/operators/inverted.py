"""Inverted-list search: documents in the list of their nearest centroid, queries against the lists they probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vec import doubles
from quillon.operators.blocks import best_in_block, folded, met_by_value, rows_of
from quillon.operators.ranking import top_k
from quillon.operators.training import sampled


def list_count(n: int) -> int:
    """The root of n, rounded up to a power of two; 4 at least."""
    return max(4, 1 << max(0, int(np.ceil(np.log2(max(1, n) ** 0.5)))))


def assigned(rows: DataFrame, vec: str, centroids: np.ndarray, keep: list[str], name: str = "list", probes: int = 1) -> DataFrame:
    """The kept columns and the ``probes`` centroids of the highest inner product, the first ones of equals; a row for each. The centroids are a bounded table."""
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(keep).dtypes)
    vector = "_vector"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(len(keep)).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            s = np.concatenate([folded(part[:, None], centroids[None]) for part in np.array_split(x, max(1, x.size * len(centroids) // 4_000_000 + 1)) if len(part)])
            best = np.argsort(-s, 1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(x)), best.shape[1])
            table = batch.select(list(range(len(keep)))).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(best.ravel().astype(np.int64))], names=[*keep, name])

    return rows.select(*keep, F.col(vec).cast("array<double>").alias(vector)).mapInArrow(work, f"{fields}, {name} long")


def sampled_centroids(vectors: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """The vectors of ``n`` documents, sampled from the whole table by a hash of docid and seed."""
    return np.array([r["v"] for r in sampled(vectors, "docid", n, seed).select(F.col("doc_vec").cast("array<double>").alias("v")).collect()])


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids moved to the means of their documents; an empty list keeps its own."""
    for _ in range(rounds):
        lists = assigned(vectors, "doc_vec", centroids, ["docid", "doc_vec"]).select("list", F.posexplode(F.col("doc_vec").cast("array<double>")).alias("i", "x"))
        means = lists.groupBy("list", "i").agg(F.avg("x").alias("x")).collect()  # lists times dimensions
        centroids = centroids.copy()
        for r in means:
            centroids[r["list"], r["i"]] = r["x"]
    return centroids


def inverted_search(queries: DataFrame, vectors: DataFrame, centroids: np.ndarray, k: int = 1000, n_probe: int = 1, sim: str = "dot", lists: DataFrame | None = None) -> DataFrame:
    """(qid, docid, score, rank) of the k best documents of the lists that each query probes; fewer where these hold fewer. A list's documents and its queries meet in blocks, so no list is one task."""
    lists = assigned(vectors, "doc_vec", centroids, ["docid", "doc_vec"]) if lists is None else lists
    probed = assigned(queries, "query_vec", centroids, ["qid", "query_vec"], probes=n_probe)

    def work(asking: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        qids, docids = asking.column("qid").combine_chunks(), held.column("docid").combine_chunks()
        for q, d, s in best_in_block(rows_of(asking.column("v"), np.float64), rows_of(held.column("v"), np.float64), k, sim):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), docids.take(pa.array(d)), pa.array(s, pa.float64())], names=["qid", "docid", "score"])

    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "qid"), (lists, "docid"))]
    asked, dealt = (df.select(key, doubles(vec).alias("v"), "list") for df, key, vec in ((probed, "qid", "query_vec"), (lists, "docid", "doc_vec")))
    return top_k(met_by_value(asked, dealt, "list", ["qid", "v"], ["docid", "v"], work, f"{', '.join(kinds)}, score double"), k)
