"""Sparse search and late interaction against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators.interaction import TokenStore, late_interaction, token_centroids
from quillon.operators.sparse import Shard, blocks_read, sparse_index, sparse_search


def zipf(rng, docs, words, mean):
    """{docid: {token: weight}} with some tokens in nearly all documents."""
    share = 1 / np.arange(1, words + 1)
    share /= share.sum()
    return {d: {f"t{t}": float(w) for t, w in zip(rng.choice(words, rng.integers(1, mean), False, share), rng.exponential(1, mean), strict=False)} for d in range(docs)}


def brute(query, docs, k):
    found = [(round(s, 9), d) for d, own in docs.items() if (s := sum(q * own[t] for t, q in sorted(query) if t in own))]
    return [(d, s) for s, d in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("seed", range(6))
def test_the_walk_is_exact_and_skips_blocks(seed):
    rng = np.random.default_rng(seed)
    docs = zipf(rng, 3000, 400, 30)
    names = sorted({t for own in docs.values() for t in own})
    code = {t: i for i, t in enumerate(names)}
    flat = [(d, code[t], w) for d, own in docs.items() for t, w in own.items()]
    ids, tokens, weights = (np.array(c) for c in zip(*flat, strict=True))
    shard = Shard(ids, tokens, names, weights, 32)
    read = total = 0
    for _ in range(20):
        query = [(f"t{t}", float(w)) for t, w in zip(rng.choice(400, 6, False), rng.exponential(1, 6), strict=True)]
        d, s, r, n = shard.search(query, 10)
        got = sorted(zip(np.round(s, 9), d, strict=True), key=lambda x: (-x[0], x[1]))[:10]
        assert [(int(b), pytest.approx(float(a), abs=2e-9)) for a, b in got] == [(b, a) for b, a in brute(query, docs, 10)]
        read, total = read + r, total + n
    assert read < 0.7 * total


def test_sparse_search_over_shards(spark):
    rng = np.random.default_rng(9)
    docs = zipf(rng, 400, 120, 20)
    docs[900], docs[901] = dict(docs[3]), dict(docs[3])  # ties
    rows = [(d, t, w) for d, own in docs.items() for t, w in own.items()] + [(1, "t1x", 0.0), (2, None, 1.0), (None, "t3", 1.0), (5, "t2x", -1.0)]
    asked = {f"q{i}": [(f"t{t}", float(w)) for t, w in zip(rng.choice(150, 5, False), rng.exponential(1, 5), strict=True)] for i in range(8)}
    queries = spark.createDataFrame([(q, t, w) for q, own in asked.items() for t, w in own] + [("nothing", "unknown", 1.0), ("null", None, 1.0)], "qid string, token string, weight double")
    index = sparse_index(spark.createDataFrame(rows, "docid long, token string, weight double"), shard_postings=900)
    assert index[1] > 3
    got = sparse_search(queries, index, 7).collect()
    for q, own in asked.items():
        mine = sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])
        assert [(r["docid"], pytest.approx(r["score"], abs=2e-9)) for r in mine] == brute(own, docs, 7)
    assert {r["qid"] for r in got} <= set(asked)
    counts = blocks_read(queries, index, 7).collect()
    assert all(0 <= r["blocks"] <= r["total"] for r in counts)
    empty = sparse_index(spark.createDataFrame([], "docid long, token string, weight double"))
    assert sparse_search(queries, empty, 3).collect() == []


def late(q, d):
    return sum(max(float(np.dot(a, b)) for b in d) for a in q)


def test_late_interaction_and_the_recall_of_its_candidates(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 8))
    docs = {i: [centres[rng.integers(20)] + 0.3 * rng.standard_normal(8) for _ in range(int(rng.integers(1, 7)))] for i in range(400)}
    asked = {f"q{i}": [v + 0.1 * rng.standard_normal(8) for v in docs[i * 7][:4]] for i in range(15)}
    lists = lambda vs: [[float(x) for x in v] for v in vs]
    rows = spark.createDataFrame([(i, lists(v)) for i, v in docs.items()] + [(900, []), (901, None)], "docid long, doc_embs array<array<double>>")
    queries = spark.createDataFrame([(q, lists(v)) for q, v in asked.items()] + [("none", [])], "qid string, query_embs array<array<double>>")
    centroids = token_centroids(rows, 16)
    want = {q: sorted(((round(late(v, d), 9), i) for i, d in docs.items()), key=lambda x: (-x[0], x[1]))[:10] for q, v in asked.items()}
    whole = late_interaction(queries, rows, centroids, 10, 16).collect()
    for q in asked:
        assert [(r["docid"], pytest.approx(r["score"], abs=2e-9)) for r in sorted(whole, key=lambda r: r["rank"]) if r["qid"] == q] == [(i, s) for s, i in want[q]]
    store = TokenStore.write(rows, str(tmp_path / "tokens"), 16)
    some = TokenStore.open(spark, str(tmp_path / "tokens")).retrieve(queries, 10, 3).collect()
    found = sum((r["qid"], r["docid"]) in {(q, i) for q in want for _, i in want[q]} for r in some) / 150
    assert found >= 0.95 and len(store.centroids) == 16
    assert late_interaction(queries, rows.where(F.lit(False)), centroids, 5).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_late_interaction_multiplies_blocks_and_no_rows(spark, monkeypatch):
    from quillon.operators import blocks

    for name, size in (("VALUE_ROWS", 40), ("QUERY_ROWS", 5), ("TASK_BLOCKS", 2), ("CELLS", 300)):
        monkeypatch.setattr(blocks, name, size)
    rng = np.random.default_rng(1)
    docs = {i: rng.standard_normal((3, 4)).round(1) for i in range(150)}  # rounded, so scores tie
    asked = {f"q{i}": rng.standard_normal((2, 4)).round(1) for i in range(23)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in docs.items()], "docid long, doc_embs array<array<double>>")
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked.items()], "qid string, query_embs array<array<double>>")
    centroids = token_centroids(rows, 6)
    nearest = lambda v, n: set(np.argsort(-(v @ centroids.T), 1, kind="stable")[:, :n].ravel().tolist())
    for probes in (1, 6):
        found = late_interaction(queries, rows, centroids, 7, probes)
        assert "array_max" not in plan_of(found)  # a product for each pair of rows, before
        got = sorted((r["qid"], r["rank"], r["docid"], round(r["score"], 8)) for r in found.collect())
        want = []
        for q, v in asked.items():
            near = [(round(late(v, d), 9), i) for i, d in docs.items() if nearest(v, probes) & nearest(d, 1)]
            want += [(q, n, i, round(s, 8)) for n, (s, i) in enumerate(sorted(near, key=lambda x: (-x[0], x[1]))[:7])]
        assert got == sorted(want)


def test_inverted_search_multiplies_blocks_and_no_rows(spark, monkeypatch):
    from quillon.operators import blocks, inverted

    for name, size in (("VALUE_ROWS", 40), ("QUERY_ROWS", 5), ("TASK_BLOCKS", 2)):
        monkeypatch.setattr(blocks, name, size)
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((150, 4)).round(1), rng.standard_normal((23, 4)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "docid long, doc_vec array<double>")
    queries = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(q)], "qid string, query_vec array<double>")
    centroids = inverted.sampled_centroids(rows, 3)
    own, asked = np.argmax(x @ centroids.T, 1), np.argsort(-(q @ centroids.T), 1, kind="stable")
    for probes in (2, 3):
        found = inverted.inverted_search(queries, rows, centroids, 6, probes)
        assert "zip_with" not in plan_of(found)
        got = [(r["qid"], r["docid"]) for r in found.orderBy("qid", "rank").collect()]
        want = []
        for i in range(len(q)):
            near = [(-round(float(sum(a * b for a, b in zip(q[i], x[j], strict=True))), 12), j) for j in range(150) if own[j] in asked[i, :probes]]
            want += [(f"q{i:02d}", j) for _, j in sorted(near)[:6]]
        assert sorted(got) == sorted(want)
