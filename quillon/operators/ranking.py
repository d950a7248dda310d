"""Ranks, cut-offs and column rules of result frames. Ranks start at 0; ties go to the smaller docid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def order_of(df: DataFrame, by: str = "score") -> list:
    return [F.col(by).desc(), F.col("docid" if "docid" in df.columns else "docno")]


def add_ranks(df: DataFrame, by: str = "score", first: int = 0) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(*order_of(df, by)))
    return df.drop("rank").withColumn("rank", (rank - 1 + first).cast("int"))


def top_k(df: DataFrame, k: int, by: str = "score", first: int = 0) -> DataFrame:
    """The k best rows of each query. The filter is on the row number itself, so only k rows of a query and task are shuffled."""
    nth = F.row_number().over(W.partitionBy("qid").orderBy(*order_of(df, by)))
    return df.drop("rank").withColumn("_nth", nth).where(F.col("_nth") <= k).withColumn("rank", (F.col("_nth") - 1 + first).cast("int")).drop("_nth")


def cut(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("rank") < k)


def query_columns(df: DataFrame, drop_query_vec: bool = False) -> list[str]:
    """Columns that describe the query: those whose names begin with q."""
    return [c for c in df.columns if c.startswith("q") and not (drop_query_vec and c == "query_vec")]


def memoised(queries: DataFrame, search, on: str = "query") -> DataFrame:
    """What ``search`` finds, run once for each distinct value of ``on`` and joined back to all queries (qid, ...) that hold it.

    ``search`` takes queries (qid, ``on``) and returns hits with qid; hits of all queries with the value are equal.
    """
    one = queries.groupBy(on).agg(F.min("qid").alias("qid"))
    hits = search(one.select("qid", on)).drop(on)
    each = queries.select(F.col("qid").alias("_own"), on).join(one.withColumnRenamed("qid", "_one"), on)
    return hits.join(each.drop(on), hits["qid"] == each["_one"]).drop("qid", "_one").withColumnRenamed("_own", "qid")
