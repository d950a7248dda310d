"""The nearest-neighbour graph of a corpus, and the retrieval that walks it."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions.vec import similarity
from quillon.operators.blocks import self_top_k
from quillon.operators.ranking import add_ranks, query_columns, top_k
from quillon.sources.shared import dropped, kept


def corpus_graph(vectors: DataFrame, k: int = 16, n_docs: int | None = None) -> DataFrame:
    """(docid, slot, neighbour, weight): each document's k nearest by cosine, itself left out, best first. Exact; lists may be shorter."""
    found = self_top_k(vectors.select("docid", "doc_vec"), k, "cos", n_docs=n_docs)
    return found.select(F.col("qid").alias("docid"), F.col("rank").alias("slot"), F.col("docid").alias("neighbour"), F.col("score").alias("weight"))


def truncated(graph: DataFrame, k: int) -> DataFrame:
    """A graph of fewer neighbours from one of more."""
    return graph.where(F.col("slot") < k)


def scored(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, sim: str, k: int | None) -> DataFrame:
    """Candidates (qid, docid) with query columns, docno, score and rank."""
    out = candidates.join(vectors, "docid").join(queries, "qid").withColumn("score", similarity(sim)("query_vec", "doc_vec")).where(F.col("score").isNotNull()).drop("doc_vec")
    return add_ranks(out) if k is None else top_k(out, k)


def queries_of(hits: DataFrame) -> DataFrame:
    names = query_columns(hits)
    return hits.groupBy("qid").agg(*(F.first(c).alias(c) for c in names if c != "qid"))


def ladr_proactive(seeds: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = 16, hops: int = 1, num_results: int = 1000, budget: int | None = None, sim: str = "dot") -> DataFrame:
    """Seeds (qid, query_vec, docid, rank) and their neighbours within ``hops``, scored. A budget keeps the first met: seeds by rank, then by hop and slot."""
    near = truncated(graph, k).select(F.col("docid").alias("at"), "slot", "neighbour")
    level = seeds.select("qid", "docid", F.array(F.col("rank").cast("int")).alias("path"))
    every = level.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        level = level.join(near, F.col("docid") == F.col("at")).select("qid", F.col("neighbour").alias("docid"), F.concat("path", F.array("slot")).alias("path"))
        if budget is None:  # order does not matter, so each document is expanded once a hop
            level = level.groupBy("qid", "docid").agg(F.min("path").alias("path"))
        every = every.unionByName(level.withColumn("hop", F.lit(hop)))
    first = every.groupBy("qid", "docid").agg(F.min(F.struct("hop", "path")).alias("met"))
    if budget is not None:
        first = first.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("met"))).where(F.col("n") <= budget)
    return scored(first.select("qid", "docid"), queries_of(seeds), vectors, sim, num_results)


def ladr_adaptive(seeds: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = 16, depth: int = 100, num_results: int = 1000, max_hops: int | None = None, budget: int | None = None, sim: str = "dot") -> DataFrame:
    """Seeds, then again and again the neighbours of the ``depth`` best so far, until these bring nothing new, or hops or budget are used up. A budget keeps the smallest docids."""
    near = kept(truncated(graph, k).select(F.col("docid").alias("at"), "neighbour"), "near")  # read in every hop, as seeds and queries are
    seeds = kept(seeds, "seeds")
    queries = queries_of(seeds)
    start = seeds.select("qid", "docid").distinct()
    if budget is not None:
        start = start.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("docid"))).where(F.col("n") <= budget).drop("n")
    have = kept(scored(start, queries, vectors, sim, None).select("qid", "docid", "score"), "ladr")
    hop = 0
    while max_hops is None or hop < max_hops:
        best = top_k(have, depth).select("qid", F.col("docid").alias("at"))
        new = best.join(near, "at").select("qid", F.col("neighbour").alias("docid")).distinct().join(have, ["qid", "docid"], "left_anti")
        if budget is not None:
            room = have.groupBy("qid").agg((F.lit(budget) - F.count("*")).alias("room"))
            new = new.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("docid"))).join(room, "qid").where(F.col("n") <= F.col("room")).select("qid", "docid")
        new = kept(scored(new, queries, vectors, sim, None).select("qid", "docid", "score"), "ladr")
        if not new.head(1):
            dropped(new)
            break
        old, have = have, kept(have.unionByName(new), "ladr")
        dropped(old, new)
        hop += 1
    dropped(near)
    return top_k(have, num_results).join(queries, "qid").join(vectors.drop("doc_vec"), "docid")


def turns(states: DataFrame, vectors: DataFrame, graph: DataFrame, sim: str, pick: Callable[[dict], list[int]], take: Callable[[dict, list], None], most: int) -> DataFrame:
    """Queries that walk the graph side by side: (qid, query_vec, state), a row each.

    In a turn each query picks documents from its state; joins fetch their vectors' scores and neighbours for all queries at once; and the
    state takes them in. A state holds what the query has scored, never the graph. Ends when no query picks any; raises after ``most`` turns.
    """
    near = graph.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("slot", "neighbour"))).alias("near")).select("docid", F.transform("near", lambda x: x["neighbour"]).alias("near"))
    near = kept(near, "near")
    schema = f"qid {states.schema['qid'].dataType.simpleString()}, query_vec array<double>, state binary, batch array<long>"

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            held = [pickle.loads(s) for s in pdf["state"]]
            batch = [pick(s) for s in held]
            yield pd.DataFrame({"qid": pdf["qid"], "query_vec": pdf["query_vec"], "state": [pickle.dumps(s) for s in held], "batch": batch})

    def absorb(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for s, got in zip(pdf["state"], pdf["got"], strict=True):
                held = pickle.loads(s)
                take(held, [] if got is None else [(r["docid"], r["score"], [] if r["near"] is None else list(r["near"])) for r in got])
                out.append(pickle.dumps(held))
            yield pd.DataFrame({"qid": pdf["qid"], "query_vec": pdf["query_vec"], "state": out})

    for _ in range(most):
        chosen = kept(states.mapInPandas(choose, schema), "turn")
        asked = chosen.select("qid", "query_vec", F.explode("batch").alias("docid"))
        if not asked.head(1):
            dropped(near)
            return chosen.drop("batch")
        got = asked.join(vectors.select("docid", "doc_vec"), "docid").join(near, "docid", "left").withColumn("score", similarity(sim)("query_vec", "doc_vec"))
        by = got.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("docid", "score", "near"))).alias("got"))
        old, states = states, kept(chosen.drop("batch").join(by, "qid", "left").mapInPandas(absorb, schema.rpartition(",")[0]), "turn")
        dropped(old, chosen)
    raise RuntimeError(f"queries still walk after {most} turns")


def results_of(states: DataFrame, k: int) -> DataFrame:
    """(qid, docid, score, rank) of the scored documents of the states."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(q, d, s) for q, state in zip(pdf["qid"], pdf["state"], strict=True) for d, s in pickle.loads(state)["scored"].items()]
            yield pd.DataFrame(rows, columns=["qid", "docid", "score"])

    return top_k(states.select("qid", "state").mapInPandas(spread, f"qid {states.schema['qid'].dataType.simpleString()}, docid long, score double"), k)


def gar(hits: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = 16, batch_size: int = 128, num_results: int = 1000, sim: str = "dot") -> DataFrame:
    """Alternate batches of hits (qid, query_vec, docid, score) by their score, and of neighbours of the best scored, until ``num_results`` are scored."""

    def start(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            states = []
            for seeds in pdf["seeds"]:
                heap = [(-s["score"], s["docid"]) for s in seeds]
                heapq.heapify(heap)
                states.append(pickle.dumps({"seeds": heap, "frontier": [], "near": {}, "left": [], "scored": {}, "turn": 0}))
            yield pd.DataFrame({"qid": pdf["qid"], "query_vec": pdf["query_vec"], "state": states})

    def pick(s: dict) -> list[int]:
        for _ in range(2):  # a turn whose queue is empty passes
            room, batch = min(batch_size, num_results - len(s["scored"])), []
            if room <= 0:
                return []
            if s["turn"] % 2 == 0:
                while s["seeds"] and len(batch) < room:
                    d = heapq.heappop(s["seeds"])[1]
                    if d not in s["scored"]:
                        batch.append(d)
            else:
                while len(batch) < room and (s["left"] or s["frontier"]):
                    if not s["left"]:
                        d = heapq.heappop(s["frontier"])[1]
                        s["left"] = [x for x in s["near"].pop(d) if x not in s["scored"]]
                    more = room - len(batch)
                    batch += s["left"][:more]
                    s["left"] = s["left"][more:]
            s["turn"] += 1
            if batch:
                return [int(d) for d in batch]
        return []

    def take(s: dict, got: list) -> None:
        for d, score, near in got:
            if d not in s["scored"]:
                heapq.heappush(s["frontier"], (-score, d))
                s["near"][d] = near
            s["scored"][d] = score

    queries = queries_of(hits)
    seeds = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("docid", "score"))).alias("seeds")).join(queries.select("qid", F.col("query_vec").cast("array<double>").alias("query_vec")), "qid")
    states = seeds.mapInPandas(start, f"qid {hits.schema['qid'].dataType.simpleString()}, query_vec array<double>, state binary")
    done = turns(states, vectors, truncated(graph, k), sim, pick, take, 4 * num_results)
    return results_of(done, num_results).join(queries, "qid").join(vectors.drop("doc_vec"), "docid")


def beam_search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, num_results: int = 10, ef: int = 64, entries: int = 16, width: int = 8, sim: str = "dot", most_turns: int = 1000) -> DataFrame:
    """Walk the graph from ``entries`` hashed documents, expanding the best ``width`` unexpanded of the ``ef`` best, until all of these are expanded."""
    roots = [r["docid"] for r in vectors.select("docid").orderBy(F.md5(F.col("docid").cast("string")), "docid").limit(entries).collect()]

    def start(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"qid": pdf["qid"], "query_vec": pdf["query_vec"], "state": [pickle.dumps({"ask": roots, "scored": {}, "near": {}}) for _ in range(len(pdf))]})

    def pick(s: dict) -> list[int]:
        return s["ask"]

    def take(s: dict, got: list) -> None:
        for d, score, near in got:
            s["scored"][d] = score
            s["near"][d] = near
        best = sorted(s["scored"], key=lambda d: (-s["scored"][d], d))[:ef]
        ask: dict[int, None] = {}
        while not ask:
            open_ = [d for d in best if d in s["near"]][:width]
            if not open_:
                break
            for d in open_:
                ask |= dict.fromkeys(int(x) for x in s["near"].pop(d) if x not in s["scored"])
        s["ask"] = list(ask)

    first = queries.select("qid", F.col("query_vec").cast("array<double>").alias("query_vec")).mapInPandas(start, f"qid {queries.schema['qid'].dataType.simpleString()}, query_vec array<double>, state binary")
    return results_of(turns(first, vectors, graph, sim, pick, take, most_turns), num_results).join(queries, "qid").join(vectors.drop("doc_vec"), "docid")
