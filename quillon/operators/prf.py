"""Pseudo-relevance feedback on query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vec import axpy, scaled, vector_sum
from quillon.operators.ranking import query_columns


def _feedback(hits: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    names = query_columns(hits)
    grouped = hits.where(F.col("rank") < k).groupBy("qid").agg(*(F.first(c).alias(c) for c in names if c != "qid"), F.array_sort(F.collect_list(F.struct("rank", "doc_vec"))).alias("_docs"))
    return grouped.withColumn("_docs", F.transform("_docs", lambda d: d["doc_vec"])), names


def average_prf(hits: DataFrame, k: int = 3) -> DataFrame:
    """One row a query: its vector becomes the mean of itself and its first k documents' vectors."""
    df, names = _feedback(hits, k)
    every: Column = vector_sum(F.concat(F.array(F.col("query_vec").cast("array<double>")), F.col("_docs").cast("array<array<double>>")))
    return df.withColumn("query_vec", scaled(every, 1 / (F.size("_docs") + 1).cast("double"))).select(*names)


def vector_prf(hits: DataFrame, alpha: float = 1.0, beta: float = 0.2, k: int = 3) -> DataFrame:
    """One row a query: alpha times its vector plus beta times the mean of its first k documents' vectors."""
    df, names = _feedback(hits, k)
    mean = scaled(vector_sum(F.col("_docs")), 1 / F.size("_docs").cast("double"))
    return df.withColumn("query_vec", axpy(alpha, "query_vec", beta, mean)).select(*names)
