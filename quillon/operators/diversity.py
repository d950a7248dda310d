"""Diversity: maximal marginal relevance and intra-list similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vec import cos


def mmr_order(scores: np.ndarray, sims: np.ndarray, weight: float, norm_rel: bool, norm_sim: bool) -> list[int]:
    """Greedy order: relevance against the largest similarity to what has been taken, which is never below 0."""

    def scaled(x: np.ndarray) -> np.ndarray:
        low, high = x.min(), x.max()
        return (x - low) / (high - low) if high > low else np.zeros_like(x)

    rel = scaled(scores) if norm_rel else scores
    near = scaled(sims) if norm_sim else sims
    worst, left, out = np.zeros(len(rel)), np.ones(len(rel), bool), []
    for _ in range(len(rel)):
        value = np.where(left, weight * rel - (1 - weight) * worst, -np.inf)
        pick = int(value.argmax())
        out.append(pick)
        left[pick] = False
        worst = np.maximum(worst, near[pick])
    return out


def mmr(hits: DataFrame, weight: float = 0.5, norm_rel: bool = False, norm_sim: bool = False, drop_doc_vec: bool = True) -> DataFrame:
    """Hits (qid, score, doc_vec, ...) in marginal-relevance order: score 0, -1, ..., rank 0, 1, .... A group is one query's list.

    Ties go to the earlier rank where there is one, else to the smaller docno.
    """
    first = "rank" if "rank" in hits.columns else "docno"
    keep = [c for c in hits.columns if c not in ("score", "rank") and not (drop_doc_vec and c == "doc_vec")]
    types = dict(hits.dtypes)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(first, kind="stable").reset_index(drop=True)
        v = np.array(pdf["doc_vec"].tolist(), np.float64)
        n, sims = np.zeros(len(v)), np.zeros((len(v), len(v)))
        for x in v.T:  # summed from the left, one component at a time: no array of all components of all pairs
            n += x * x
            sims += x[:, None] * x
        n = np.sqrt(n)
        sims = sims / np.where(n > 0, n, np.inf)[:, None] / np.where(n > 0, n, np.inf)[None]
        out = pdf.loc[mmr_order(pdf["score"].to_numpy(float), sims, weight, norm_rel, norm_sim), keep]
        return out.assign(score=0.0 - np.arange(len(out), dtype=float), rank=np.arange(len(out), dtype=np.int32))

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double, rank int"])
    return hits.groupBy("qid").applyInPandas(work, schema)


def ils(hits: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, ils): mean cosine of all pairs of a query's list (qid, rank, doc_vec), cut at ``k`` if given; 0 for a list of one."""
    rows = hits if k is None else hits.where(F.col("rank") < k)
    a, b = rows.select("qid", F.col("rank").alias("ra"), F.col("doc_vec").alias("va")), rows.select("qid", F.col("rank").alias("rb"), F.col("doc_vec").alias("vb"))
    pairs = a.join(b, "qid").where(F.col("ra") < F.col("rb")).groupBy("qid").agg(F.avg(cos("va", "vb")).alias("ils"))
    return rows.select("qid").distinct().join(pairs, "qid", "left").select("qid", F.coalesce("ils", F.lit(0.0)).alias("ils"))
