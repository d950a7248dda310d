"""Sparse search: weighted tokens against an inverted index of impact-ordered postings.

Documents are dealt to shards of bounded size. A shard's row holds each token's postings by falling weight, in blocks with the block's
largest weight, and the same entries by document. A shard stays in its task while all queries stream past; for each, a walk reads blocks by
their largest possible share of a score and ends when no block left can bring a document that reaches the kth score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.blocks import TASK_BLOCKS, met, pairs_met, steps
from quillon.operators.ranking import top_k

#: Postings of a shard, about, of a block at most, and queries of a block at most.
SHARD_POSTINGS, BLOCK_POSTINGS, BLOCK_QUERIES = 2_000_000, 128, 256
#: Scores closer than this count as equal while walking; final scores decide.
NEAR = 2e-9


class Shard:
    """The postings of some documents: (docid, token, weight) with positive weights; tokens are numbers of ``names``."""

    def __init__(self, docids: np.ndarray, tokens: np.ndarray, names: list[str], weights: np.ndarray, block: int = BLOCK_POSTINGS) -> None:
        self.ids, doc = np.unique(docids, return_inverse=True)
        self.block, self.names = block, {t: i for i, t in enumerate(names)}
        order = np.lexsort((doc, -weights, tokens))
        self.bounds = np.searchsorted(tokens[order], np.arange(len(names) + 1))
        self.doc, self.weight = doc[order].astype(np.int32), weights[order]
        key = self.doc.astype(np.int64) * max(1, len(names)) + tokens[order]
        by = np.argsort(key, kind="stable")
        self.pairs, self.values = key[by], self.weight[by]  # by document, then token

    def scores(self, docs: np.ndarray, terms: list[tuple[int, float]]) -> np.ndarray:
        """Exact scores of documents, summed in the order of the terms."""
        out = np.zeros(len(docs))
        for token, q in terms:
            key = docs.astype(np.int64) * max(1, len(self.names)) + token
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out += np.where(self.pairs[at] == key, q * self.values[at], 0.0)
        return out

    def search(self, query: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(docids, scores, blocks read, blocks of the query's tokens) of the k best documents that share a token, and all that tie with the last of them.

        In a step the walk reads the open block of the largest possible share, and more while they are few. A document that no block read so
        far holds has all its tokens in unread blocks. So a block is read only if its own largest weight, with the largest unread ones of
        the other tokens, reaches the kth score; and a set of tokens that together cannot reach it is never read for its own sake.
        """
        terms = sorted((self.names[t], q) for t, q in query if t in self.names and q > 0)
        first = np.array([self.bounds[t] for t, _ in terms], np.int64)
        last = np.array([self.bounds[t + 1] for t, _ in terms], np.int64)
        q = np.array([x for _, x in terms])
        at, total = first.copy(), int((-(-(last - first) // self.block)).sum())
        seen, docs, scores, read, floor, step = np.zeros(len(self.ids), bool), [], [], 0, -np.inf, 1
        found, value = np.zeros(0, np.int64), np.zeros(0)
        while len(terms):
            open_ = at < last
            top = np.where(open_, q * self.weight[np.minimum(at, len(self.weight) - 1)], 0.0)
            if not open_.any() or top.sum() < floor - NEAR:
                break
            rising = np.argsort(top, kind="stable")
            idle = rising[np.cumsum(top[rising]) < floor - NEAR]  # these alone cannot reach the kth score
            take = open_.copy()
            take[idle] = False
            chosen = np.flatnonzero(take)
            chosen = chosen[np.argsort(-top[chosen], kind="stable")][:step]
            new = []
            for i in chosen:
                end = min(at[i] + self.block, last[i])
                new.append(self.doc[at[i] : end])
                at[i] = end
                read += 1
            fresh = np.unique(np.concatenate(new))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            if len(fresh):
                docs.append(fresh)
                scores.append(self.scores(fresh, terms))
                found, value = np.concatenate(docs), np.concatenate(scores)
                if len(value) >= k:
                    floor = np.partition(value, len(value) - k)[len(value) - k]
                    good = value >= floor - NEAR
                    docs, scores = [found[good]], [value[good]]
                    found, value = docs[0], scores[0]
            step = min(2 * step, max(1, len(terms)))
        return self.ids[found], value, read, total


def sparse_index(weights: DataFrame, n_postings: int | None = None, shard_postings: int = SHARD_POSTINGS) -> tuple[DataFrame, int]:
    """(shards, their number): a row (at, blob) for each shard of documents' weights (docid, token, weight). Weights that are not above 0, and nulls, are left out."""
    good = weights.where((F.col("weight") > 0) & F.col("docid").isNotNull() & F.col("token").isNotNull())
    n = max(1, -(-(good.count() if n_postings is None else n_postings) // shard_postings))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        coded = table.column("token").combine_chunks().dictionary_encode()
        shard = Shard(table.column("docid").to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), table.column("weight").to_numpy())
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(shard)], pa.binary())})

    at = F.pmod(F.xxhash64("docid"), F.lit(n)).cast("long").alias("at")
    return good.select(F.col("docid").cast("long").alias("docid"), F.col("token").cast("string").alias("token"), F.col("weight").cast("double").alias("weight"), at).groupBy("at").applyInArrow(work, "at long, blob binary"), n


def sparse_search(queries: DataFrame, index: tuple[DataFrame, int], k: int = 1000, digits: int = 9) -> DataFrame:
    """(qid, docid, score, rank) of the k best documents of every query (qid, token, weight): the score is the sum of the products of equal tokens' weights.

    Only documents that share a token are found. Scores are rounded to ``digits``, then ties go to the smaller docid. Repeated tokens of a
    query count as often as they occur.
    """
    return top_k(_walked(queries, index, k).select("qid", "docid", F.round("score", digits).alias("score")), k)


def blocks_read(queries: DataFrame, index: tuple[DataFrame, int], k: int = 1000) -> DataFrame:
    """(qid, blocks, total): how many blocks the walks of a query read, of how many."""
    return _walked(queries, index, k, True).groupBy("qid").agg(F.sum("docid").alias("blocks"), F.sum("score").cast("long").alias("total"))


def _walked(queries: DataFrame, index: tuple[DataFrame, int], k: int, count: bool = False) -> DataFrame:
    """(qid, docid, score) found in each shard; or, to count, (qid, blocks read, blocks)."""
    shards, n = index
    rows = queries.where(F.col("token").isNotNull()).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("token", F.col("weight").cast("double").alias("weight")))).alias("terms"))
    qb = max(1, -(-queries.select("qid").distinct().count() // BLOCK_QUERIES))
    copies = -(-qb // TASK_BLOCKS)
    kind = queries.schema["qid"].dataType.simpleString()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        held = [(q, [(t["token"], t["weight"]) for t in terms]) for q, terms in zip(table.column("qid").to_pylist(), table.column("terms").to_pylist(), strict=True)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(held)], pa.binary())})

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("long")).groupBy("block").applyInArrow(pack, "block long, blob binary")
    resident = shards.select("at", steps(copies).alias("copy"), "blob")
    streamed = blocks.select(steps(n).alias("at"), F.pmod("block", F.lit(copies)).cast("long").alias("copy"), "block", "blob")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, shard, held in pairs_met(batches):
            qids, ids, scores = [], [], []
            for qid, terms in held:
                d, s, read, total = shard.search(terms, k)
                qids += [qid] * (1 if count else len(d))
                ids.append(np.array([read]) if count else d)
                scores.append(np.array([float(total)]) if count else s)
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64() if kind == "bigint" else pa.string()), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(scores).astype(float))], names=["qid", "docid", "score"])

    return met(resident, streamed, n * copies).mapInArrow(work, f"qid {kind}, docid bigint, score double")
