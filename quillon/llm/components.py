"""Connected components of a link table, and bounded filters of ids, as DataFrame programs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, written

FILTER_BITS = 1 << 23
#: Places among which the rows of one key are dealt.
SPREAD = 8


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """The inner join on ``key``, which ``one`` holds once: each of its rows is dealt to ``SPREAD`` places, and the rows of ``many`` among them by a hash of ``by``, so that no key is hot."""
    left = many.withColumn("spread", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    right = one.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return left.join(right, [key, "spread"]).drop("spread")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each end of a link reaches. Links are rows (a, b) of longs; repeats, loops and either order are fine.

    Alternating large-star and small-star steps; each needs one partial aggregation and one join, so a node with very many links is
    aggregated before it is shuffled. The number of rounds grows with the logarithm of the longest path.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both, least, "a", "b").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, down, "a", "b").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, edges = edges, written(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(old)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").toDF("node", "root").distinct())


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of hashed ids, of a fixed size: it never lacks an id it was built from, and may hold others."""
    h = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select((h / 64).cast("long").alias("word"), (h % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).collect()
    out = np.zeros(bits // 64, np.uint64)
    for r in words:
        out[r["word"]] = r["set"] & 0xFFFFFFFFFFFFFFFF
    return out


def may_hold(bitmap: np.ndarray, column: Column | str) -> Column:
    bits = len(bitmap) * 64

    def test(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in parts:
            x = h.fillna(0).to_numpy().astype(np.uint64)
            yield pd.Series((bitmap[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    test.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(test, "boolean")(F.pmod(F.xxhash64(column), F.lit(bits)))
