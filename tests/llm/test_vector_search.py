import numpy as np
import pytest

from quillon.llm.hnsw import build, nearest_neighbours, search
from quillon.llm.threshold_search import exact_top_k, sorted_lists, threshold_top

SCHEMA = "vec_id long, embedding array<float>, score string"


def rows_of(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 12)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], "old") for i in range(n)]
    rows += [(n + i, rows[3][1], "old") for i in range(copies)]
    odd = [(9001, None, "x"), (9002, [1.0, None] + [0.0] * 10, "x"), (9003, [float("nan")] * 12, "x"), (9004, [float("inf")] * 12, "x"), (9005, [], "x"), (9006, [1.0], "x"), (None, rows[0][1], "x")]
    return rows, odd


def top(rows, every, k, score, largest):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = []
    for q in np.unique(ids[ids % every == 0]):
        s = score(x, x[ids == q][0])
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep] if largest else s[keep]))[:k]
        out += [(int(q), j + 1, int(ids[keep][o]), s[keep][o]) for j, o in enumerate(order)]
    return out


@pytest.mark.parametrize("shard_rows", [40, 1000])
def test_threshold_search_against_brute_force(spark, shard_rows):
    rows, odd = rows_of(150, 1, copies=40)
    rows.append((7000, [0.0] * 12, "zero"))
    got = exact_top_k(spark.createDataFrame(rows + odd, SCHEMA), k=7, shard_rows=shard_rows, block_queries=4).collect()
    want = top([(i, np.floor(64 * np.array(v, np.float32).astype(float)), n) for i, v, n in rows], 20, 7, lambda x, q: x @ q, True)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((a, b, c, int(d)) for a, b, c, d in want)


def test_the_walk_stops_early_on_skewed_lists():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.pareto(1.2, (4000, 3)))
    import pickle

    ids, m, lists = pickle.loads(sorted_lists(np.arange(4000), x))
    rows, scores, scored = threshold_top(ids, m, lists, np.array([3.0, 1, 2]), -1, 10)
    assert scores.tolist() == sorted((x @ [3.0, 1, 2]).tolist(), reverse=True)[:10] and scored < 2000


def test_graph_search_recall_and_exactness(spark):
    rows, odd = rows_of(1200, 3, copies=50)
    got = nearest_neighbours(spark.createDataFrame([*rows, *odd, (8000, [0.0] * 12, "zero"), rows[0]], SCHEMA), queries_every=100, k=10, shard_rows=500, block_queries=5).collect()
    want = top(rows, 100, 10, lambda x, q: np.sqrt(((x - q) ** 2).sum(1)), False)
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    hits = [(a, c) in found for a, _, c, _ in want]
    assert len(got) == len(want) and np.mean(hits) >= 0.95
    for a, _, c, d in want:
        if (a, c) in found:
            assert found[a, c] == pytest.approx(d, abs=1e-12)


def test_small_graphs_find_everything():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        x = rng.standard_normal((n, 5))
        found, dist = search(build(np.arange(n), x), x[:1], beam=64)
        assert sorted(found[0][found[0] >= 0]) == list(range(n)) and found[0][0] == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(empty).count() == 0 and nearest_neighbours(empty).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "few clusters", "near copies", "spread"])
def test_recall_on_clustered_near_and_spread_vectors(kind):
    rng = np.random.default_rng(11)
    many, each, noise = {"clusters": (40, 60, 0.05), "few clusters": (6, 400, 0.05), "near copies": (3, 800, 1e-4), "spread": (2400, 1, 0.0)}[kind]
    x = np.repeat(rng.standard_normal((many, 64)), each, 0) + rng.standard_normal((many * each, 64)) * noise
    graph = build(np.arange(len(x)), x)
    asked = np.arange(0, len(x), 40)
    found, _ = search(graph, x[asked])
    hits = []
    for q, f in zip(asked, found, strict=True):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(set(np.argsort(d, kind="stable")[:10]) & set(f[f != q][:10])) / 10)
    assert np.mean(hits) >= 0.97 and min(hits) >= 0.7


def test_every_node_is_reached_from_the_first():
    rng = np.random.default_rng(12)
    x = np.repeat(rng.standard_normal((30, 8)) * 100, 90, 0) + rng.standard_normal((2700, 8))
    graph = build(np.arange(len(x)), x, width=4)
    links, seen, new = graph.levels[0], set(), [int(graph.top[0])]
    while new:
        seen.update(new)
        new = list({int(j) for i in new for j in links[i] if j >= 0} - seen)
    assert len(seen) == len(x)


def test_scores_beyond_double_precision_are_refused(spark):
    with pytest.raises(ValueError, match="2\\*\\*53"):
        exact_top_k(spark.createDataFrame([(0, [2.0e6, 1.0], "x"), (1, [1.0, 1.0], "x")], SCHEMA))


def test_a_shard_is_kept_for_its_blocks(spark, monkeypatch):
    from quillon.llm import vectors

    monkeypatch.setattr(vectors, "TASK_BLOCKS", 2)
    rows, _ = rows_of(150, 6)
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), queries_every=10, k=5, shard_rows=40, block_queries=2).collect()
    want = top([(i, np.floor(64 * np.array(v, np.float32).astype(float)), n) for i, v, n in rows], 10, 5, lambda x, q: x @ q, True)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((a, b, c, int(d)) for a, b, c, d in want)


def test_of_repeated_query_ids_the_least_vector_asks(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(1, 90)]
    twice = [(0, [float(x) for x in rng.standard_normal(6)]) for _ in range(5)]
    least = min(v for _, v in twice)
    kinds = "vec_id long, embedding array<double>"
    for search in (exact_top_k, nearest_neighbours):
        want = sorted(map(tuple, search(spark.createDataFrame([*rows, (0, least)], kinds)).where("query_id = 0").collect()))
        for order in (twice, twice[::-1]):
            got = search(spark.createDataFrame([*order, *rows], kinds).repartition(6)).where("query_id = 0")
            assert sorted(map(tuple, got.collect())) == want
