"""Late interaction: texts as several vectors each; a document's score sums, over the query's vectors, the best product with one of its own.

Document vectors lie in the list of their nearest centroid. A query's vectors probe lists; documents with a vector in one of these are the
candidates, and their whole vector sets decide. Blocks of documents know their lists, so candidates are told apart inside a pair of blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vec import dot, total
from quillon.operators.blocks import CELLS, folds, gathered, met_by_value, rows_of
from quillon.operators.inverted import assigned
from quillon.operators.ranking import top_k
from quillon.operators.training import sampled

FORMAT = "quillon-token-vectors"


def best_matches(query: Column | str, doc: Column | str) -> Column:
    """The sum over the query's vectors of their largest product with a vector of the document; null where either has none."""
    q, d = (F.col(x) if isinstance(x, str) else x for x in (query, doc))
    found = total(F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))))
    return F.when((F.size(q) > 0) & (F.size(d) > 0), found)


def exploded(rows: DataFrame, key: str, embs: str, name: str) -> DataFrame:
    """(key, n, name): a row for each vector."""
    return rows.select(key, F.posexplode(F.col(embs).cast("array<array<double>>")).alias("n", name)).where(F.col(name).isNotNull() & (F.size(name) > 0))


def token_centroids(docs: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """``n`` vectors of the documents (docid, doc_embs), sampled from all by a hash of docid and place."""
    keyed = exploded(docs, "docid", "doc_embs", "v").withColumn("key", F.concat_ws(".", F.col("docid").cast("string"), F.col("n").cast("string")))
    return np.array([r["v"] for r in sampled(keyed, "key", n, seed).select("v").collect()])


def token_lists(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, docid): the lists that hold a vector of a document, each once."""
    return assigned(exploded(docs, "docid", "doc_embs", "v"), "v", centroids, ["docid"]).distinct()


def bits(rows: DataFrame, lists: DataFrame, key: str, embs: str) -> DataFrame:
    """(key, sizes, v, lists): of rows with vectors their number, the vectors in a row, and the lists (key, list) that they lie in or probe."""
    held = rows.select(key, F.filter(F.col(embs).cast("array<array<double>>"), lambda x: x.isNotNull() & (F.size(x) > 0)).alias("v")).where(F.size("v") > 0)
    return held.join(lists.groupBy(key).agg(F.array_sort(F.collect_set("list")).alias("lists")), key)


def best_of_block(asking: pa.Table, held: pa.Table, n_lists: int, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, doc row, score) of each query's k best docs that share a list with it, and of all that tie with the last in the score rounded to ``digits``."""

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, v = table.column("lists").combine_chunks(), table.column("v").combine_chunks()
        has = np.zeros((len(table), n_lists), np.float32)
        has[np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
        return has, np.diff(v.offsets.to_numpy()), rows_of(v.flatten(), np.float64)

    (qhas, qn, q), (dhas, dn, d) = read(asking), read(held)
    starts, ends = np.concatenate([[0], np.cumsum(dn)[:-1]]), np.cumsum(qn)
    even = dn.min() == dn.max()
    for i in range(len(qn)):
        near = np.flatnonzero(dhas @ qhas[i] > 0)
        if not len(near):
            continue
        own = q[ends[i] - qn[i] : ends[i]]
        if even:
            cut = (d if len(near) == len(dn) else d.reshape(len(dn), dn[0], -1)[near].reshape(-1, d.shape[1]))
            best = (own @ cut.T).reshape(len(own), len(near), dn[0]).max(2)
        else:
            best = np.maximum.reduceat(own @ d.T, starts, 1)[:, near]
        rough = best.sum(0)
        last = np.partition(rough, len(rough) - k)[len(rough) - k] if k < len(rough) else -np.inf
        keep = near[rough >= last - 2 * 10.0**-digits - 1e-9 * abs(last)] if np.isfinite(last) else near
        for part in np.array_split(keep, -(-len(keep) * len(own) * int(dn.max()) * d.shape[1] // CELLS) or 1):
            if len(part):
                yield np.full(len(part), i), part, exact(own, d, starts[part], dn[part])


def exact(own: np.ndarray, d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of docs whose vectors begin at ``starts``: products summed from the left, then each query vector's best from the left."""
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    products = np.maximum.reduceat(folds(own, d[at]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), 1)
    return np.cumsum(products, 0)[-1]


def late_interaction(queries: DataFrame, docs: DataFrame, centroids: np.ndarray, k: int = 1000, n_probe: int = 4, lists: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(qid, docid, score, rank) of the k best candidates of every query (qid, query_embs) among documents (docid, doc_embs).

    Scores of candidates are exact, rounded to ``digits``; a document none of whose vectors lies in a probed list is not found. With as many
    probes as centroids all documents are candidates. Rows without vectors take no part. Documents and queries meet in blocks: a block of
    documents with their lists is sent once for ``TASK_BLOCKS`` blocks of queries, and each query's candidates in it are one matrix product.
    """
    lists = token_lists(docs, centroids) if lists is None else lists
    probed = assigned(exploded(queries, "qid", "query_embs", "v"), "v", centroids, ["qid"], probes=n_probe).distinct()
    asked, held = (bits(*x).withColumn("one", F.lit(0)) for x in ((queries, probed, "qid", "query_embs"), (docs, lists, "docid", "doc_embs")))

    def work(asking: pa.Table, own: pa.Table) -> Iterator[pa.RecordBatch]:
        qids, docids = asking.column("qid").combine_chunks(), own.column("docid").combine_chunks()
        for q, d, s in gathered(best_of_block(asking, own, len(centroids), k, digits)):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), docids.take(pa.array(d)), pa.array(s, pa.float64())], names=["qid", "docid", "score"])

    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "qid"), (docs, "docid"))]
    scored = met_by_value(asked, held, "one", ["qid", "v", "lists"], ["docid", "v", "lists"], work, f"{', '.join(kinds)}, score double")
    return top_k(scored.select("qid", "docid", F.round("score", digits).alias("score")), k)


@dataclass(frozen=True)
class TokenStore:
    """Documents (docid, doc_embs) with their lists and centroids on disk."""

    docs: DataFrame
    lists: DataFrame
    centroids: np.ndarray

    @classmethod
    def write(cls, docs: DataFrame, path: str, n_lists: int, seed: int = 42, mode: str = "create") -> TokenStore:
        """Write documents, a row each, and the lists of their vectors. The centroids, a bounded table, go with the properties, which come last."""
        save = {"create": "errorifexists", "overwrite": "overwrite"}[mode]
        spark = docs.sparkSession
        docs.select(F.col("docid").cast("long").alias("docid"), F.col("doc_embs").cast("array<array<float>>").alias("doc_embs")).write.mode(save).parquet(f"{path}/docs")
        own = spark.read.parquet(f"{path}/docs")
        centroids = token_centroids(own, n_lists, seed)
        token_lists(own, centroids).write.mode(save).partitionBy("list").parquet(f"{path}/lists")
        meta = json.dumps({"format": FORMAT, "centroids": centroids.tolist()})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenStore:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        if meta["format"] != FORMAT:
            raise ValueError(f"{path} holds {meta['format']}")
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.schema("docid long, list long").parquet(f"{path}/lists"), np.array(meta["centroids"], np.float64))

    def retrieve(self, queries: DataFrame, k: int = 1000, n_probe: int = 4) -> DataFrame:
        return late_interaction(queries, self.docs, self.centroids, k, n_probe, self.lists)
