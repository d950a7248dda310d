"""The code store: product-quantisation codes of a corpus in Parquet, beside their codebook, rotation and properties."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vec import squared_distance
from quillon.operators import pq
from quillon.sources.store import VectorStore

FORMAT = "quillon-codes"
SCHEMA = "docid long, docno string, codes array<int>"


@dataclass(frozen=True)
class CodeStore:
    codes: DataFrame
    book: np.ndarray
    rotation: np.ndarray | None = None
    count: int | None = None

    @classmethod
    def write(cls, codes: DataFrame, book: np.ndarray, path: str, rotation: np.ndarray | None = None, mode: str = "create") -> CodeStore:
        """Write (docid, docno, codes) with a codebook [parts, codes, width]. ``create`` fails where the path exists, ``overwrite`` replaces it.

        Every row needs one code a part, and every code must be in the codebook; a rotation is square, of the vectors' size.
        """
        if mode not in ("create", "overwrite"):
            raise ValueError("mode is create or overwrite")
        if book.ndim != 3 or book.shape[1] < 1 or book.shape[1] & (book.shape[1] - 1):
            raise ValueError(f"codebook {book.shape}: it needs three dimensions, and a power of two of codes a part")
        if (rotation is not None and rotation.shape != (book.shape[0] * book.shape[2],) * 2):
            raise ValueError(f"codebook {book.shape} with rotation {None if rotation is None else rotation.shape}")
        fits = (F.size("codes") == book.shape[0]) & F.forall("codes", lambda c: (c >= 0) & (c < book.shape[1]))
        n, bad = codes.agg(F.count("*"), F.coalesce(F.sum((~F.coalesce(fits, F.lit(False))).cast("long")), F.lit(0))).first()
        if bad:
            raise ValueError(f"{bad} rows whose codes do not fit the codebook {book.shape}")
        save = "errorifexists" if mode == "create" else "overwrite"
        codes.select(F.col("docid").cast("long"), "docno", F.col("codes").cast("array<int>").alias("codes")).write.mode(save).parquet(f"{path}/codes")
        meta = {"format": FORMAT, "count": n, "shape": book.shape, "book": book.ravel().tolist(), "rotation": None if rotation is None else rotation.ravel().tolist()}
        codes.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls.open(codes.sparkSession, path)

    @classmethod
    def build(cls, store: VectorStore, book: np.ndarray, path: str, rotation: np.ndarray | None = None, mode: str = "create", assign: str = "l2") -> CodeStore:
        """The store's vectors under a codebook. It may come from another corpus: nothing is trained here."""
        return cls.write(pq.encoded(store.vectors, book, assign, rotation), book, path, rotation, mode)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CodeStore:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        if meta["format"] != FORMAT:
            raise ValueError(f"{path} holds {meta['format']}")
        book = np.array(meta["book"], np.float64).reshape(meta["shape"])
        size = book.shape[0] * book.shape[2]
        rotation = None if meta["rotation"] is None else np.array(meta["rotation"], np.float64).reshape(size, size)
        return cls(spark.read.schema(SCHEMA).parquet(f"{path}/codes"), book, rotation, meta["count"])

    def __len__(self) -> int:
        return self.codes.count() if self.count is None else self.count

    def scan(self, start: int | None = None, stop: int | None = None) -> DataFrame:
        """Codes of docids from ``start`` to before ``stop``; the bounds reach the scan as filters."""
        out = self.codes if start is None else self.codes.where(F.col("docid") >= start)
        return out if stop is None else out.where(F.col("docid") < stop)

    def vectors(self) -> VectorStore:
        """The vectors that the codes stand for, rotated back."""
        return VectorStore(pq.decoded(self.codes, self.book, self.rotation), count=self.count)

    def rebuild(self, original: VectorStore, path: str, mode: str = "create") -> tuple[VectorStore, float]:
        """Writes the vectors that the codes stand for as a store of the same docids order, and tells their mean squared error against the originals, a document at a time."""
        made = self.vectors().vectors
        both = made.select("docid", F.col("doc_vec").alias("a")).join(original.vectors.select("docid", F.col("doc_vec").alias("b")), "docid")
        error = both.agg(F.avg(squared_distance("a", "b"))).first()[0]
        return VectorStore.write(made, path, "docid", original.sim, mode), float(error or 0.0)

    def retrieve(self, queries: DataFrame, k: int = 1000, prune: bool = False, inflation: float = 1.0) -> DataFrame:
        """(qid, docid, docno, score, rank from 1) of the k best documents by table lookup."""
        return pq.code_search(queries, self.codes, self.book, k, self.rotation, prune, inflation, n_docs=self.count)
