"""Graphs: every pair of blocks once, stored graphs and their reuse, and neighbour descent against the exact graph."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators.blocks import ring, self_top_k
from quillon.operators.descent import approximate_graph
from quillon.operators.graph import beam_search, corpus_graph, ladr_adaptive, turns
from quillon.sources.graphs import GraphStore, graph_of, stored
from quillon.sources.store import VectorStore


def frame(spark, x):
    return spark.createDataFrame([(i, f"d{i}", [float(c) for c in v]) for i, v in enumerate(x)], "docid long, docno string, doc_vec array<double>")


def exact(x, k):
    n = np.linalg.norm(x, axis=1)
    s = x @ x.T / np.maximum(n[:, None] * n[None], 1e-300)
    np.fill_diagonal(s, -np.inf)
    s[n == 0], s[:, n == 0] = -np.inf, -np.inf
    return s, np.argsort(-np.round(s, 12), 1, kind="stable")[:, :k]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10])
def test_every_pair_of_blocks_meets_once(spark, n):
    met = ring(spark.range(n).select(F.col("id").alias("block"), F.lit(b"x").alias("blob")), n).collect()
    assert len(met) == n * (n + 1) // 2  # against n * n products of both triangles
    assert {tuple(sorted((r["at"], r["block"]))) for r in met} == {(i, j) for i in range(n) for j in range(i, n)}


@pytest.mark.parametrize("rows", [7, 40, 1000])
def test_one_triangle_gives_the_whole_graph(spark, rows):
    x = np.random.default_rng(rows).standard_normal((90, 6))
    x[5] = x[17]
    x[30] = 0
    got = self_top_k(frame(spark, x), 4, "cos", doc_rows=rows).collect()
    s, near = exact(x, 4)
    want = {(i, r, j) for i in range(90) if i != 30 for r, j in enumerate(near[i])}
    assert {(r["qid"], r["rank"], r["docid"]) for r in got} == want
    assert all(abs(r["score"] - s[r["qid"], r["docid"]]) < 1e-12 for r in got)


def test_stored_graphs_are_used_again(spark, tmp_path):
    root, built = str(tmp_path / "graphs"), []
    x = np.random.default_rng(0).standard_normal((50, 5))
    docs = frame(spark, x)

    def build(v, k):
        built.append(k)
        return corpus_graph(v, k)

    assert stored(spark, root) == []
    for k, more in ((6, [6]), (6, [6]), (4, [6]), (9, [6, 9]), (7, [6, 9]), (5, [6, 9])):
        got = graph_of(docs, root, k, build)
        assert built == more
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corpus_graph(docs, k).collect()))
    assert stored(spark, root) == [6, 9] and GraphStore.open(spark, root, 6).count == 50
    with pytest.raises(ValueError):
        graph_of(docs.limit(10), root, 4)
    with pytest.raises(Exception, match="(?i)exist"):
        GraphStore.write(corpus_graph(docs, 6), root, 6, 50)


def test_a_query_walks_a_stored_graph(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((60, 5))
    docs = frame(spark, x)
    near = graph_of(docs, str(tmp_path / "graphs"), 6)
    asked = docs.where("docid < 3").select(F.concat(F.lit("q"), F.col("docid")).alias("qid"), F.col("doc_vec").alias("query_vec"))
    seeds = VectorStore(docs).retrieve(asked, 3)
    assert ladr_adaptive(seeds, docs, near, 6, 5, 60).count() > 9
    with pytest.raises(RuntimeError):
        beam_search(asked, docs, near, 5, 60, 2, 1, most_turns=1)
    assert turns is not None


def recall(rows, x, k):
    """Of each document's k places, how many hold a neighbour as near as the exact one there."""
    s, near = exact(x, k)
    floor = s[np.arange(len(x)), near[:, -1]]
    return sum(s[r["docid"], r["neighbour"]] >= floor[r["docid"]] - 1e-12 for r in rows) / near.size


SHAPES = {
    "even": lambda g: g.standard_normal((1500, 24)),
    "clusters": lambda g: np.repeat(g.standard_normal((30, 32)), 50, 0) + 0.15 * g.standard_normal((1500, 32)),
    "copies": lambda g: np.concatenate([np.repeat(g.standard_normal((1, 16)), 500, 0), g.standard_normal((900, 16))]),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_descent_finds_nearly_all_edges(spark, shape):
    x = SHAPES[shape](np.random.default_rng(3))
    docs = frame(spark, x)
    rows = approximate_graph(docs, 8).collect()
    assert len(rows) == 8 * len(x) and recall(rows, x, 8) >= 0.9
    assert all(r["docid"] != r["neighbour"] for r in rows) and len({(r["docid"], r["neighbour"]) for r in rows}) == len(rows)
    edges = [(r["docid"], r["slot"], r["neighbour"], r["weight"]) for r in rows]
    import pandas as pd

    e, v = pd.DataFrame(edges, columns=["docid", "slot", "neighbour", "weight"]), pd.DataFrame({"docid": range(len(x)), "v": x.tolist()})
    db = duckdb.connect()
    db.register("e", e), db.register("v", v)
    wrong = db.sql("""SELECT count(*) FROM (SELECT e.*, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS w,
        row_number() OVER (PARTITION BY e.docid ORDER BY weight DESC, neighbour) - 1 AS place FROM e JOIN v a ON a.docid = e.docid JOIN v b ON b.docid = e.neighbour) WHERE abs(w - weight) > 1e-9 OR place <> slot""").fetchall()[0][0]
    assert wrong == 0


def test_descent_of_few_zero_and_no_rows(spark):
    x = np.array([[1.0, 0], [0, 0], [0.9, 0.1], [0, 1]])
    rows = approximate_graph(frame(spark, x), 8).collect()
    assert {(r["docid"], r["neighbour"]) for r in rows} == {(i, j) for i in (0, 2, 3) for j in (0, 2, 3) if i != j}
    assert approximate_graph(frame(spark, x[:1]), 3).collect() == [] and approximate_graph(frame(spark, x[:0]), 3).collect() == []
