"""A context cache: a bounded sample of a corpus, encoded once and kept, for encoders that look at the corpus beside each text."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.encode import Encoder, encode_docs
from quillon.operators.training import sampled

FORMAT = "quillon-context"


class ContextEncoder(Protocol):
    """An encoder whose vectors depend on a matrix of sampled vectors."""

    sim: str

    def encode_queries(self, texts: list[str], context: np.ndarray) -> np.ndarray: ...

    def encode_docs(self, texts: list[str], context: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class InContext:
    """A context encoder with its matrix, as a plain encoder; the matrix travels to the tasks with it."""

    model: ContextEncoder
    context: np.ndarray

    @property
    def sim(self) -> str:
        return self.model.sim

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        return self.model.encode_queries(texts, self.context)

    def encode_docs(self, texts: list[str]) -> np.ndarray:
        return self.model.encode_docs(texts, self.context)


@dataclass(frozen=True)
class ContextCache:
    sample: DataFrame
    model: str
    shape: tuple[int, int]

    @classmethod
    def write(cls, docs: DataFrame, first_stage: Encoder, path: str, size: int = 512, model: str = "", seed: int = 42, text: str = "text", mode: str = "create") -> ContextCache:
        """Encode ``size`` documents (docno, ``text``), or all if fewer, sampled from all by a hash of docno, and keep them; the properties come last."""
        save = {"create": "errorifexists", "overwrite": "overwrite"}[mode]
        encode_docs(sampled(docs.select("docno", text), "docno", size, seed), first_stage, text).select("docno", "doc_vec").write.mode(save).parquet(f"{path}/sample")
        spark = docs.sparkSession
        own = spark.read.parquet(f"{path}/sample")
        n, width = own.agg(F.count("*"), F.coalesce(F.max(F.size("doc_vec")), F.lit(0))).first()
        meta = json.dumps({"format": FORMAT, "model": model, "shape": [n, width]})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ContextCache:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        if meta["format"] != FORMAT:
            raise ValueError(f"{path} holds {meta['format']}")
        return cls(spark.read.parquet(f"{path}/sample"), meta["model"], tuple(meta["shape"]))

    def matrix(self) -> np.ndarray:
        """The sample in the order of docno: as many rows as the cache was written with, a bounded table."""
        return np.array([r["doc_vec"] for r in self.sample.orderBy("docno").collect()], np.float32).reshape(self.shape)

    def encoder(self, model: ContextEncoder) -> InContext:
        return InContext(model, self.matrix())
