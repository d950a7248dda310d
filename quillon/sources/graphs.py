"""Stored nearest-neighbour graphs, one folder for each number of neighbours, and the rule by which one is used again."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import corpus_graph, truncated

FORMAT = "quillon-graph"
EDGES = "docid long, slot int, neighbour long, weight double"


@dataclass(frozen=True)
class GraphStore:
    """Edges (docid, slot, neighbour, weight), best first, of ``k`` neighbours at most, over ``count`` documents."""

    edges: DataFrame
    k: int
    count: int

    @classmethod
    def write(cls, graph: DataFrame, root: str, k: int, count: int, mode: str = "create") -> GraphStore:
        """Write a graph of ``k`` neighbours below ``root``. ``create`` fails where there is one of that k, ``overwrite`` replaces it. The properties are written last."""
        if mode not in ("create", "overwrite"):
            raise ValueError("mode is create or overwrite")
        spark, path = graph.sparkSession, f"{root}/k={k}"
        kinds = [f.split() for f in EDGES.split(", ")]
        graph.select(*(F.col(c).cast(t).alias(c) for c, t in kinds)).write.mode("errorifexists" if mode == "create" else "overwrite").parquet(f"{path}/edges")
        meta = json.dumps({"format": FORMAT, "k": k, "count": count})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls.open(spark, root, k)

    @classmethod
    def open(cls, spark: SparkSession, root: str, k: int) -> GraphStore:
        meta = json.loads(spark.read.text(f"{root}/k={k}/meta").first()["value"])
        if meta["format"] != FORMAT or meta["k"] != k:
            raise ValueError(f"{root}/k={k} holds {meta}")
        return cls(spark.read.schema(EDGES).parquet(f"{root}/k={k}/edges"), k, meta["count"])

    def first(self, k: int) -> DataFrame:
        """The edges of the ``k`` first slots; the bound reaches the scan as a filter."""
        return self.edges if k >= self.k else truncated(self.edges, k)


def stored(spark: SparkSession, root: str) -> list[int]:
    """The numbers of neighbours of the finished graphs below ``root``, ascending."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    found = [re.fullmatch(r"k=(\d+)", x.getPath().getName()) for x in fs.listStatus(place)]
    done = lambda k: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/k={k}/meta/_SUCCESS"))
    return sorted(int(m[1]) for m in found if m and done(m[1]))


def graph_of(vectors: DataFrame, root: str, k: int = 16, build=corpus_graph) -> DataFrame:
    """The graph of ``k`` neighbours of ``vectors`` (docid, doc_vec): a stored one of that k, else the least larger one cut off, else built and stored.

    A stored graph of another number of documents is refused: it belongs to another state of the corpus. ``build`` may be any function of
    vectors and k, such as ``approximate_graph``.
    """
    spark, n = vectors.sparkSession, vectors.count()
    larger = [x for x in stored(spark, root) if x >= k]
    store = GraphStore.open(spark, root, larger[0]) if larger else GraphStore.write(build(vectors, k), root, k, n)
    if store.count != n:
        raise ValueError(f"{root} holds a graph of {store.count} documents, not {n}")
    return store.first(k)
