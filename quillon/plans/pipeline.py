"""Stages that compose with >> and cut with %, and the rewrites that Spark's optimizer cannot make through them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import encode, prf
from quillon.operators.encode import Encoder
from quillon.operators.ranking import cut
from quillon.sources.store import VectorStore


@dataclass(frozen=True)
class Stage:
    """A function of frames. Equal stages, by their fields, give equal results."""

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __rshift__(self, other: Stage) -> Stage:
        return Pipeline((*steps_of(self), *steps_of(other)))

    def __mod__(self, k: int) -> Stage:
        return self >> Cut(k)

    def search(self, spark: SparkSession, text: str) -> DataFrame:
        """One query, as qid 1."""
        return self(spark.createDataFrame([("1", text)], "qid string, query string"))

    def compiled(self) -> Stage:
        return compiled(self)


def steps_of(stage: Stage) -> tuple[Stage, ...]:
    return stage.steps if isinstance(stage, Pipeline) else (stage,)


@dataclass(frozen=True)
class Pipeline(Stage):
    steps: tuple[Stage, ...]

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s(df)
        return df


@dataclass(frozen=True)
class Cut(Stage):
    k: int

    def __call__(self, df: DataFrame) -> DataFrame:
        return cut(df, self.k)


@dataclass(frozen=True)
class Apply(Stage):
    function: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.function(df)


@dataclass(frozen=True)
class Retrieve(Stage):
    store: VectorStore
    k: int = 1000
    drop_query_vec: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.store.retrieve(df, self.k, self.drop_query_vec)


@dataclass(frozen=True)
class LoadVectors(Stage):
    store: VectorStore

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.store.load(df)


@dataclass(frozen=True)
class Score(Stage):
    store: VectorStore
    k: int | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.store.score(df, self.k)


@dataclass(frozen=True)
class AveragePrf(Stage):
    k: int = 3

    def __call__(self, df: DataFrame) -> DataFrame:
        return prf.average_prf(df, self.k)


@dataclass(frozen=True)
class VectorPrf(Stage):
    alpha: float = 1.0
    beta: float = 0.2
    k: int = 3

    def __call__(self, df: DataFrame) -> DataFrame:
        return prf.vector_prf(df, self.alpha, self.beta, self.k)


def by_shape(store: VectorStore, df: DataFrame) -> Stage:
    """What a store does with a frame: score hits, or retrieve for queries."""
    if {"qid", "query_vec"} <= set(df.columns):
        return Score(store) if {"docno", "docid"} & set(df.columns) else Retrieve(store)
    raise ValueError(f"neither queries nor hits: {df.columns}")


@dataclass(frozen=True)
class EncodeQueries(Stage):
    model: Encoder
    batch_size: int = 32

    def __call__(self, df: DataFrame) -> DataFrame:
        return encode.encode_queries(df, self.model, self.batch_size)


@dataclass(frozen=True)
class EncodeDocs(Stage):
    model: Encoder
    text: str = "text"
    batch_size: int = 32

    def __call__(self, df: DataFrame) -> DataFrame:
        return encode.encode_docs(df, self.model, self.text, self.batch_size)


@dataclass(frozen=True)
class ScoreTexts(Stage):
    model: Encoder
    text: str = "text"

    def __call__(self, df: DataFrame) -> DataFrame:
        return encode.score_texts(df, self.model, self.text)


@dataclass(frozen=True)
class AttachText(Stage):
    docs: DataFrame
    text: str = "text"
    missing: str = "null"

    def __call__(self, df: DataFrame) -> DataFrame:
        return encode.attach_text(df, self.docs, "docno", self.text, self.missing)


@dataclass(frozen=True)
class ByShape(Stage):
    """An encoder as one stage: what it does depends on the columns that it meets, decided when the plan is made."""

    model: Encoder
    text: str = "text"
    batch_size: int = 32

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.stage_for(df)(df)

    def stage_for(self, df: DataFrame) -> Stage:
        """Score pairs that have a query and a document, each as text or vector; else encode queries; else encode documents."""
        has = set(df.columns)
        asked, told = {"query", "query_vec"} & has, {self.text, "doc_vec"} & has
        if "qid" in has and asked and told:
            return ScoreTexts(self.model, self.text)
        if "query" in has and not told:
            return EncodeQueries(self.model, self.batch_size)
        if self.text in has and not asked:
            return EncodeDocs(self.model, self.text, self.batch_size)
        raise ValueError(f"neither queries nor documents nor pairs: {df.columns}")


def compiled(stage: Stage) -> Stage:
    """Rewritten until nothing changes: feedback takes only its first k; cuts move ahead of vector loading, meet, and lower a retriever's k.

    Only methods whose answer does not depend on k are touched, so results stay the same.
    """
    steps = [x for s in steps_of(stage) for x in ([Cut(s.k), s] if isinstance(s, (AveragePrf, VectorPrf)) else [s])]
    changed = True
    while changed:
        changed = False
        for i in range(len(steps) - 1):
            a, b = steps[i], steps[i + 1]
            if not isinstance(b, Cut):
                continue
            if isinstance(a, Cut):
                steps[i : i + 2] = [Cut(min(a.k, b.k))]
            elif isinstance(a, LoadVectors):
                steps[i : i + 2] = [b, a]
            elif isinstance(a, Retrieve):
                steps[i : i + 2] = [Retrieve(a.store, min(a.k, b.k), a.drop_query_vec)]
            elif isinstance(a, Score):
                steps[i : i + 2] = [Score(a.store, b.k if a.k is None else min(a.k, b.k))]
            else:
                continue
            changed = True
            break
    return steps[0] if len(steps) == 1 else Pipeline(tuple(steps))
