"""Text to vectors: encoders as adapters, a deterministic hashing encoder, pair scoring, passages and token weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions.vec import dot
from quillon.operators.ranking import add_ranks
from quillon.operators.training import hashed


class Encoder(Protocol):
    """A model behind the encoding stages; it is pickled to the tasks and may load its weights lazily there."""

    sim: str

    def encode_queries(self, texts: list[str]) -> np.ndarray: ...

    def encode_docs(self, texts: list[str]) -> np.ndarray: ...


def _encoded(rows: DataFrame, text: str, name: str, encode: Callable[[list[str]], np.ndarray], batch_size: int) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = pdf[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch_size) for v in np.asarray(encode(texts[i : i + batch_size]), np.float32)]
            yield pdf.assign(**{name: vectors})

    return rows.mapInPandas(work, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"{name} array<float>"]))


@dataclass(frozen=True)
class Options:
    """An encoder with prompts before its texts, vectors scaled to length 1 (zero ones stay), and a space before texts that begin with http."""

    model: Encoder
    query_prompt: str = ""
    doc_prompt: str = ""
    normalise: bool = False
    guard_urls: bool = False

    @property
    def sim(self) -> str:
        return self.model.sim

    def _run(self, encode: Callable[[list[str]], np.ndarray], prompt: str, texts: list[str]) -> np.ndarray:
        texts = [prompt + (" " + x if self.guard_urls and x.startswith("http") else x) for x in texts]
        v = np.asarray(encode(texts), np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if self.normalise and len(v) else v

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        return self._run(self.model.encode_queries, self.query_prompt, texts)

    def encode_docs(self, texts: list[str]) -> np.ndarray:
        return self._run(self.model.encode_docs, self.doc_prompt, texts)


def encode_queries(queries: DataFrame, model: Encoder, batch_size: int = 32) -> DataFrame:
    """Queries with query_vec. Each distinct text is encoded once."""
    distinct = queries.select("query").distinct()
    return queries.join(_encoded(distinct, "query", "query_vec", model.encode_queries, batch_size), "query")


def encode_docs(docs: DataFrame, model: Encoder, text: str = "text", batch_size: int = 32) -> DataFrame:
    return _encoded(docs, text, "doc_vec", model.encode_docs, batch_size)


def score_texts(pairs: DataFrame, model: Encoder, text: str = "text") -> DataFrame:
    """Pairs (qid, query or query_vec, text or doc_vec) with score and rank; vectors that are there are used."""
    if "query_vec" not in pairs.columns:
        pairs = encode_queries(pairs, model)
    if "doc_vec" not in pairs.columns:
        pairs = encode_docs(pairs, model, text)
    return add_ranks(pairs.withColumn("score", dot("query_vec", "doc_vec")))


def cross_score(pairs: DataFrame, score: Callable[[list[str], list[str]], np.ndarray], text: str = "text", batch_size: int = 16) -> DataFrame:
    """Pairs (qid, query, text) scored together by a model and ranked; a query's pairs are kept together in its partition."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            q, d = pdf["query"].tolist(), pdf[text].fillna("").tolist()
            yield pdf.assign(score=np.concatenate([np.asarray(score(q[i : i + batch_size], d[i : i + batch_size]), float) for i in range(0, len(q), batch_size)] or [np.zeros(0)]))

    rows = pairs.drop("score", "rank")
    return add_ranks(rows.repartition("qid").sortWithinPartitions("qid").mapInPandas(work, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "score double"])))


def attach_text(hits: DataFrame, docs: DataFrame, key: str = "docno", text: str = "text", missing: str = "null") -> DataFrame:
    """Hits with the text of their documents (``key``, ``text``), in place of one they have. A hit of an unknown document keeps a null text, or is dropped or raises, as ``missing`` says."""
    if missing not in ("null", "drop", "raise"):
        raise ValueError("missing is null, drop or raise")
    known = docs.select(key, text)
    if missing == "raise" and (lost := hits.join(known, key, "left_anti").head(1)):
        raise KeyError(lost[0][key])
    return hits.drop(text).join(known, key, "left" if missing == "null" else "inner")


def packed_pairs(pairs: DataFrame, budget: int, parts: int = 64, score: Callable[[list[str], list[list[str]]], list[np.ndarray]] | None = None, text: str = "text") -> DataFrame:
    """Pairs (qid, query, ``text``, ...) with part and batch, and with score if a model is given: whole queries share a batch of at most ``budget`` pairs.

    Queries are dealt to parts by a hash of their text and taken in its order. A query joins the batch under way unless that holds pairs and
    would exceed the budget; one with more pairs than the budget is a batch of its own. A query's pairs stay together however they arrive.
    The model takes a batch's queries and, for each, its texts, in the order of the texts, and gives an array of scores for each query. A
    null query counts as empty, as does a null text. An empty table gives an empty one.
    """
    names = [c for c in pairs.columns if c not in ("part", "batch", "score", "rank")]
    part = F.pmod(hashed(F.coalesce(F.col("query"), F.lit(""))), F.lit(parts)).cast("int").alias("part")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    rows = pairs.select(*names, part).repartition("part").sortWithinPartitions("part", F.coalesce("query", F.lit("")), text, "qid")

    def work(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finished(groups: list[tuple[str, pd.DataFrame]], part: int, batch: int) -> pd.DataFrame:
            out = pd.concat([g for _, g in groups]).assign(batch=batch)
            if score:
                found = score([q for q, _ in groups], [g[text].fillna("").tolist() for _, g in groups])
                out = out.assign(score=np.concatenate([np.asarray(x, float) for x in found]))
            return out

        at, batch, held, size = None, 0, [], 0  # the part, its batch under way, that batch's whole queries, and their pairs
        key, open_ = None, []  # the query that is still arriving

        def closed() -> Iterator[pd.DataFrame]:
            nonlocal batch, held, size
            own = pd.concat(open_)
            if held and size + len(own) > budget:
                yield finished(held, at, batch)
                batch, held, size = batch + 1, [], 0
            held.append((key, own))
            size += len(own)

        for pdf in tables:
            for (p, q), group in pdf.assign(_q=pdf["query"].fillna("")).groupby(["part", "_q"], sort=False):
                if (p, q) != (at, key):
                    if open_:
                        yield from closed()
                    if p != at:
                        if held:
                            yield finished(held, at, batch)
                        at, batch, held, size = p, 0, [], 0
                    key, open_ = q, []
                open_.append(group.drop(columns="_q"))
        if open_:
            yield from closed()
            yield finished(held, at, batch)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "part int", "batch int", *(["score double"] if score else [])])
    return rows.mapInPandas(work, schema)


def cross_score_packed(pairs: DataFrame, score: Callable[[list[str], list[list[str]]], list[np.ndarray]], budget: int = 64, parts: int = 64, text: str = "text") -> DataFrame:
    """Pairs scored by a model that takes whole queries, packed by a budget of pairs, and ranked."""
    return add_ranks(packed_pairs(pairs, budget, parts, score, text).drop("part", "batch"))


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def hashed_components(rows: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, dim, value): tokens hashed by md5 to a dimension and a sign, summed, and scaled to length 1. Zeros are left out."""
    each = rows.select(key, F.explode(tokens(text)).alias("t")).groupBy(key, "t").count()
    h = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long")
    sums = each.select(key, (h % size).cast("int").alias("dim"), (F.when(F.floor(h / size) % 2 == 0, 1).otherwise(-1) * F.col("count")).alias("x"))
    sums = sums.groupBy(key, "dim").agg(F.sum("x").alias("x")).where(F.col("x") != 0)
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)).cast("double"))  # at most ``size`` rows
    return sums.select(key, "dim", (F.col("x") / length).alias("value"))


def hashed_vectors(rows: DataFrame, key: str, text: str, name: str, size: int = 64) -> DataFrame:
    """Rows with the hashing encoder's vector; null where the text has no token."""
    parts = hashed_components(rows, key, text, size).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.join(parts.select(key, dense.alias(name)), key, "left")


def token_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): the share of each token among the text's tokens."""
    each = rows.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").count()
    total = F.sum("count").over(W.partitionBy(key))
    return each.select(key, "token", (F.col("count") / total).alias("weight"))


def passages(docs: DataFrame, key: str = "docno", text: str = "text", length: int = 50, stride: int = 25) -> DataFrame:
    """Sliding passages of ``length`` words, ``stride`` apart, named key%p0, key%p1, .... A passage that would only repeat the end of the one before is left out."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(key), words.alias("_w"))
    last = F.greatest(F.ceil((F.size("_w") - length) / stride).cast("int"), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col("_w"), i * stride + 1, length), " "))
    return rows.where(F.size("_w") > 0).select(F.col(key).alias("parent"), F.posexplode(cut).alias("n", "text")).select("parent", F.concat(F.col("parent").cast("string"), F.lit("%p"), F.col("n").cast("string")).alias("docno"), "text")
