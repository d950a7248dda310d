import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.operators import diversity, encode, evaluation, graph, inverted, pq, prf, training
from quillon.operators.ranking import add_ranks, cut
from quillon.plans.pipeline import Apply, AveragePrf, Cut, LoadVectors, Pipeline, Retrieve, Score, VectorPrf, by_shape
from quillon.sources.store import VectorStore
from quillon.streaming.ingest import append_vectors


def corpus(spark, n=60, size=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size))
    df = spark.createDataFrame([(i, f"d{i}", [float(v) for v in r]) for i, r in enumerate(x)], "docid long, docno string, doc_vec array<double>")
    return df, x


def asked(spark, x, ids=(3, 7)):
    return spark.createDataFrame([(f"q{i}", f"text {i}", [float(v) for v in x[i]]) for i in ids], "qid string, query string, query_vec array<double>")


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(vec.dot("a", "b").alias("dot"), vec.norm("a").alias("norm"), vec.cos("a", "z").alias("none"), vec.axpy(2, "a", -1, "b").alias("axpy"), vec.times_matrix("a", [[1, 0], [0, 1], [1, 1]]).alias("m"), vec.sub_vectors("a", 3, 1).alias("s")).first()
    assert (r["dot"], r["norm"], r["none"], r["axpy"], r["m"], r["s"]) == (4.0, 3.0, None, [0.0, 4.0, 3.0], [3.0, 4.0], [[1.0], [2.0], [2.0]])
    vec.register_functions(spark)
    assert spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_cos(array(0D), array(1D)) AS c").first()[:] == (11.0, None)


@pytest.mark.parametrize("sim", ["dot", "cos"])
def test_exact_search_against_numpy(spark, sim):
    df, x = corpus(spark)
    got = VectorStore(df, sim).retrieve(asked(spark, x), 9).collect()
    for q in (3, 7):
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]) if sim == "cos" else 1)
        own = sorted((r for r in got if r["qid"] == f"q{q}"), key=lambda r: r["rank"])
        assert [r["docid"] for r in own] == np.argsort(-s)[:9].tolist() and [r["rank"] for r in own] == list(range(9))
        assert {r["query"] for r in own} == {f"text {q}"}
    assert VectorStore(df, sim).retrieve(asked(spark, x), 1000).count() == 2 * 60
    assert VectorStore(df.where("false"), sim).retrieve(asked(spark, x), 5).count() == 0


def test_the_store_keeps_order_and_refuses(spark, tmp_path):
    df, x = corpus(spark, 200)
    path = str(tmp_path / "store")
    made = VectorStore.write(df.select(F.lpad(F.col("docid").cast("string"), 4, "0").alias("docno"), "doc_vec"), path)
    assert len(made) == 200 and [tuple(r) for r in made.docnos().orderBy("docid").collect()] == [(i, f"{i:04d}") for i in range(200)]
    assert made.scan(10, 13).count() == 3 and VectorStore.open(spark, path).sim == "dot"
    with pytest.raises(Exception, match="exists"):
        VectorStore.write(df, path)
    with pytest.raises(ValueError, match="sizes"):
        VectorStore.write(df.unionByName(spark.createDataFrame([(1, "x", [1.0])], df.schema)), str(tmp_path / "other"))
    with pytest.raises(KeyError):
        made.load(spark.createDataFrame([("nobody",)], "docno string"), strict=True)
    assert made.load(spark.createDataFrame([("0005",), ("0199",)], "docno string")).count() == 2


FEEDBACK = [
    ("q1", "a", [1.0, 2.0, 3.0], "d0", 0, [4.0, 5.0, 6.0]),
    ("q1", "a", [1.0, 2.0, 3.0], "d1", 1, [1.0, 4.0, 2.0]),
    ("q1", "a", [1.0, 2.0, 3.0], "d2", 2, [8.0, 7.0, 1.0]),
    ("q1", "a", [1.0, 2.0, 3.0], "d3", 3, [100.0, 100.0, 100.0]),
    ("q2", "b", [4.0, 6.0, 1.0], "d0", 0, [9.0, 4.0, 2.0]),
]


def test_feedback_vectors(spark):
    hits = spark.createDataFrame(FEEDBACK, "qid string, query string, query_vec array<double>, docno string, rank int, doc_vec array<double>")
    average = {r["qid"]: r["query_vec"] for r in prf.average_prf(hits, 3).collect()}
    assert average == {"q1": [3.5, 4.5, 3.0], "q2": [6.5, 5.0, 1.5]}
    mixed = {r["qid"]: r["query_vec"] for r in prf.vector_prf(hits, 0.5, 0.5, 3).collect()}
    assert mixed["q1"] == pytest.approx([2.666667, 3.666667, 3.0], abs=1e-6) and prf.average_prf(hits, 3).columns == ["qid", "query", "query_vec"]
    assert {r["qid"]: r["query_vec"] for r in prf.average_prf(hits, 1).collect()}["q1"] == [2.5, 3.5, 4.5]


def test_marginal_relevance_and_list_similarity(spark):
    v = {"a": [0.0, 1.0, 0.0], "b": [0.0, 1.0, 1.0], "c": [1.0, 1.0, 1.0], "d": [1.0, 1.0, 0.0]}
    rows = [("q0", "d0", 1.0, v["a"]), ("q0", "d1", 0.5, v["b"]), ("q0", "d2", 0.5, v["c"]), ("q0", "d3", 0.1, v["d"]), ("q1", "d0", 0.6, v["a"]), ("q2", "d0", 0.4, v["a"]), ("q2", "d1", 0.3, v["b"])]
    hits = spark.createDataFrame(rows, "qid string, docno string, score double, doc_vec array<double>")
    got = sorted(tuple(r) for r in diversity.mmr(hits).select("qid", "rank", "docno", "score").collect())
    assert got == [("q0", 0, "d0", 0.0), ("q0", 1, "d2", -1.0), ("q0", 2, "d1", -2.0), ("q0", 3, "d3", -3.0), ("q1", 0, "d0", 0.0), ("q2", 0, "d0", 0.0), ("q2", 1, "d1", -1.0)]
    same = diversity.mmr(hits, 1.0, norm_rel=True, norm_sim=True)
    assert same.count() == 7
    near = {r["qid"]: r["ils"] for r in diversity.ils(add_ranks(hits)).collect()}
    assert near["q1"] == 0.0 and near["q2"] == pytest.approx(math.sqrt(0.5))


def test_graph_walks_against_plain_loops(spark):
    df, x = corpus(spark, 80, 5, 2)
    n = x / np.linalg.norm(x, axis=1)[:, None]
    c = n @ n.T
    np.fill_diagonal(c, -np.inf)
    near = np.argsort(-c, 1)[:, :4]
    g = graph.corpus_graph(df, 4).persist()
    assert {(r["docid"], r["slot"]): r["neighbour"] for r in g.collect()} == {(i, j): int(near[i, j]) for i in range(80) for j in range(4)}
    store = VectorStore(df)
    seeds = store.retrieve(asked(spark, x), 4).persist()
    for q in (3, 7):
        s, first = x @ x[q], [r["docid"] for r in sorted((r for r in seeds.collect() if r["qid"] == f"q{q}"), key=lambda r: r["rank"])]
        have = set(first)
        while True:
            best = sorted(have, key=lambda i: (-s[i], i))[:3]
            new = {int(m) for b in best for m in near[b]} - have
            if not new:
                break
            have |= new
        got = graph.ladr_adaptive(seeds, df, g, 4, 3, 50).where(F.col("qid") == f"q{q}").orderBy("rank").collect()
        assert [r["docid"] for r in got] == sorted(have, key=lambda i: (-s[i], i))[:50]
        order = [*first, *(int(m) for b in first for m in near[b])]
        within = list(dict.fromkeys(order))[:7]
        got = graph.ladr_proactive(seeds, df, g, 4, 1, 50, budget=7).where(F.col("qid") == f"q{q}").orderBy("rank").collect()
        assert [r["docid"] for r in got] == sorted(within, key=lambda i: (-s[i], i))
        want = gar_loop(s, first, near, 3, 15)
        got = graph.gar(seeds, df, g, 4, 3, 15).where(F.col("qid") == f"q{q}").orderBy("rank").collect()
        assert [r["docid"] for r in got] == want
    found = graph.beam_search(asked(spark, x), df, g, 5, ef=80, entries=40, width=20)
    exact = {(r["qid"], r["docid"]) for r in store.retrieve(asked(spark, x), 5).collect()}
    assert len({(r["qid"], r["docid"]) for r in found.collect()} & exact) >= 9


def gar_loop(s, first, near, batch, most):
    seeds, frontier, left, have, turn = sorted(first, key=lambda i: (-s[i], i)), [], [], [], 0
    while len(have) < most and (seeds or frontier or left):
        room, now = min(batch, most - len(have)), []
        if turn % 2 == 0:
            while seeds and len(now) < room:
                d = seeds.pop(0)
                if d not in have:
                    now.append(d)
        else:
            while len(now) < room and (left or frontier):
                if not left:
                    frontier.sort(key=lambda i: (-s[i], i))
                    left = [int(m) for m in near[frontier.pop(0)] if m not in have]
                now, left = now + left[: room - len(now)], left[room - len(now) :]
        for d in now:
            if d not in have:
                have.append(d)
                frontier.append(d)
        turn += 1
    return sorted(have, key=lambda i: (-s[i], i))


def test_inverted_lists(spark):
    df, x = corpus(spark, 90, 4, 3)
    centroids = inverted.lloyd(df, inverted.sampled_centroids(df, 5), 2)
    every = inverted.inverted_search(asked(spark, x), df, centroids, 6, 5)
    exact = VectorStore(df).retrieve(asked(spark, x), 6)
    key = lambda rows: sorted((r["qid"], r["rank"], r["docid"]) for r in rows.collect())
    assert key(every) == key(exact)
    some = inverted.inverted_search(asked(spark, x), df, centroids, 90, 1)
    assert 0 < some.count() < 180 and inverted.list_count(500) == 32 and inverted.list_count(3) == 4


def test_quantisation(spark):
    df, x = corpus(spark, 120, 8, 4)
    book = pq.trained(df, 4, 8, 2)
    codes = pq.encoded(df, book).persist()
    own = {r["docid"]: r["codes"] for r in codes.collect()}
    parts = x.reshape(120, 4, 2)
    assert all(own[i][m] == int(((parts[i, m] - book[m]) ** 2).sum(1).argmin()) for i in range(120) for m in range(4))
    near = {r["docid"]: r["doc_vec"] for r in pq.decoded(codes, book).collect()}
    back = np.stack([near[i] for i in range(120)])
    first = pq.sampled_codebook(df, 4, 8)
    rough = np.stack([np.concatenate([first[m, pq.nearest_codes(x, first, "l2")[i, m]] for m in range(4)]) for i in range(120)])
    assert ((back - x) ** 2).sum() < ((rough - x) ** 2).sum()
    ask = asked(spark, x)
    key = lambda rows: sorted((r["qid"], r["rank"], r["docid"], round(r["score"], 9)) for r in rows.collect())
    assert key(pq.code_search(ask, codes, book, 7)) == key(pq.code_search(ask, codes, book, 7, prune=True)) == key(pq.flat_search(ask, codes, book, 7))
    packed = {r["docid"]: bytes.fromhex(r["packed"]) for r in pq.packed_codes(codes, 3).collect()}
    for i in range(120):
        assert int.from_bytes(packed[i], "little") == sum(c << (3 * m) for m, c in enumerate(own[i])) and len(packed[i]) == 2
    lists = pq.inverted_codes(codes, 50).collect()
    assert {r["block"] for r in lists} == {0, 1, 2} and all(r["docids"] == sorted(r["docids"]) for r in lists)
    assert sorted((d, r["part"], r["code"]) for r in lists for d in r["docids"]) == sorted((i, m, c) for i in own for m, c in enumerate(own[i]))
    rotation, rotated = pq.learned_rotation(df, 4, 8, 2)
    assert np.allclose(rotation @ rotation.T, np.eye(8)) and rotated.shape == (4, 8, 2)
    assert pq.code_search(ask, pq.encoded(df, rotated, "l2", rotation), rotated, 5, rotation).count() == 10
    with pytest.raises(ValueError, match="multiple"):
        pq.sampled_codebook(df, 3, 4)


class Lengths:
    sim = "dot"

    def encode_queries(self, texts):
        return np.array([[len(t), 1.0] for t in texts])

    encode_docs = encode_queries


def test_encoders_and_passages(spark):
    rows = spark.createDataFrame([("q1", "ab", "d1", "xyz"), ("q1", "ab", "d2", None), ("q2", "ab", "d1", "xyz")], "qid string, query string, docno string, text string")
    got = {(r["qid"], r["docno"]): (r["score"], r["rank"]) for r in encode.score_texts(rows, Lengths()).collect()}
    assert got == {("q1", "d1"): (7.0, 0), ("q1", "d2"): (1.0, 1), ("q2", "d1"): (7.0, 0)}
    crossed = encode.cross_score(rows, lambda q, d: np.array([len(a) - len(b) for a, b in zip(q, d, strict=True)]))
    assert {(r["qid"], r["docno"]): r["rank"] for r in crossed.collect()} == {("q1", "d1"): 1, ("q1", "d2"): 0, ("q2", "d1"): 0}
    docs = spark.createDataFrame([("a", " ".join(map(str, range(7)))), ("b", ""), ("c", "one"), ("d", None)], "docno string, text string")
    cutted = [tuple(r) for r in encode.passages(docs, length=4, stride=2).orderBy("docno").collect()]
    assert cutted == [("a", "a%p0", "0 1 2 3"), ("a", "a%p1", "2 3 4 5"), ("a", "a%p2", "4 5 6"), ("c", "c%p0", "one")]
    v = encode.hashed_vectors(docs, "docno", "text", "v", 16).where("docno = 'a'").first()["v"]
    assert sum(x * x for x in v) == pytest.approx(1) and len(v) == 16


def test_training_data_and_losses(spark):
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 0), ("q1", "c", 0), ("q2", "a", 1), ("q3", "a", 0)], "qid string, docno string, label int")
    names = spark.createDataFrame([("q1", "x"), ("q2", "y"), ("q3", "z")], "qid string, query string")
    pairs = training.pairs_of(qrels, names, 1)
    assert [tuple(r) for r in pairs.collect()] == [("q1", "x", "a", "b")]
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "e")], "docid long, docno string")
    assert training.random_negatives(qrels, docs, 4).count() == 5 + 12
    assert training.within(training.pairs_of(qrels, names), docs).count() == 1
    kept, asked_ = training.validation(qrels, names, docs)
    assert {r["qid"] for r in asked_.collect()} == {"q1", "q2"} and kept.count() == 3
    run = spark.createDataFrame([("q1", d, i) for i, d in enumerate("bdaef")], "qid string, docno string, rank int")
    hard = sorted(tuple(r) for r in training.hard_negatives(pairs, run, 2).select("docno", "neg_rank", "pos_rank", "given_rank").collect())
    assert hard == [("d", 1, 2, 0), ("e", 3, 2, 0)]
    scores = spark.createDataFrame([(1.0, 0.0), (2.0, 2.5)], "pos double, neg double")
    assert training.pairwise_loss(scores).first()[0] == pytest.approx((math.log1p(math.exp(-1)) + math.log1p(math.exp(0.5))) / 2)
    assert training.sampled(docs, "docno", 2).count() == 2


def test_relevance_by_an_equal_value(spark):
    queries = spark.createDataFrame([("q1", 1), ("q2", 2), ("q3", None)], "qid string, label int")
    docs = spark.createDataFrame([(f"d{i}", None if i % 7 == 0 else i % 3) for i in range(40)], "docno string, label int")
    found = training.same_value(queries, docs, "label", 4)
    want = {(f"q{v}", f"d{i}") for i in range(40) for v in (1, 2) if i % 7 and i % 3 == v}
    assert sorted((r["qid"], r["docno"]) for r in found.collect()) == sorted(want)
    run = spark.createDataFrame([("q1", "d1"), ("q1", "d0"), ("q3", "d2")], "qid string, docno string")
    rows = sorted(tuple(r) for r in training.judged(found, run).collect())
    assert rows == sorted([(q, d, 1) for q, d in want] + [("q1", "d0", 0), ("q3", "d2", 0)])


def test_measures_by_hand(spark):
    run = spark.createDataFrame([("q1", d, i) for i, d in enumerate("xayb")], "qid string, docno string, rank int")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 1)], "qid string, docno string, label int")
    got = {r["qid"]: r for r in evaluation.measures(run, qrels, 10).collect()}
    ideal = 3 / math.log2(2) + 1 / math.log2(3)
    assert got["q1"]["rr"] == 0.5 and got["q1"]["recall"] == 1 and got["q1"]["ap"] == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert got["q1"]["ndcg"] == pytest.approx((1 / math.log2(3) + 3 / math.log2(5)) / ideal) and got["q2"]["rr"] == 0
    both = evaluation.experiment({"a": run, "b": cut(run, 1)}, qrels)
    t = evaluation.paired_t(both, "a", "rr").first()
    assert t["difference"] == -0.25 and t["t"] == pytest.approx(-0.25 / (np.std([0.5, 0], ddof=1) / math.sqrt(2)))


def test_pipelines_compile_and_keep_their_answer(spark):
    df, x = corpus(spark, 50, 4, 6)
    s = VectorStore(df)
    line = Retrieve(s, 20) >> LoadVectors(s) >> VectorPrf(k=3) >> Retrieve(s, 10)
    assert line.compiled() == Pipeline((Retrieve(s, 3), LoadVectors(s), VectorPrf(k=3), Retrieve(s, 10)))
    assert (Retrieve(s, 20) % 9 % 4).compiled() == Retrieve(s, 4) and (Score(s) % 3).compiled() == Score(s, 3)
    key = lambda rows: sorted((r["qid"], r["rank"], r["docno"]) for r in rows.collect())
    q = asked(spark, x)
    assert key(line(q)) == key(line.compiled()(q))
    assert key((Retrieve(s, 20) % 4)(q)) == key(Retrieve(s, 4)(q))
    assert isinstance(by_shape(s, q), Retrieve) and isinstance(by_shape(s, q.withColumn("docno", F.lit("d1"))), Score)
    assert (Apply(lambda d: d.withColumn("query_vec", F.array(*[F.lit(1.0)] * 4))) >> Retrieve(s, 2)).search(spark, "hello").count() == 2
    assert (Retrieve(s, 5) >> AveragePrf(2)).compiled().steps[0] == Retrieve(s, 2) and Cut(3) == Cut(3)


def test_streams_append_without_gaps(spark, tmp_path):
    random.seed(1)
    source = str(tmp_path / "in")
    for part in range(2):
        rows = [(f"{part}-{i}", [float(i), 1.0]) for i in range(5)]
        spark.createDataFrame(rows, "docno string, doc_vec array<double>").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("docno string, doc_vec array<double>").parquet(source)
        append_vectors(stream, str(tmp_path / "store"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store") + "/vectors").collect()
    assert sorted(r["docid"] for r in got) == list(range(10)) and len({r["docno"] for r in got}) == 10


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "exact_dot" in e.queries()
    assert e.entry(spark).columns == ["qid", "docid", "docno", "score", "rank"]


@pytest.mark.parametrize("k", [3, 4000])
@pytest.mark.parametrize("sim", ["dot", "cos"])
def test_a_pair_of_blocks_is_worked_through_in_bounded_memory(k, sim):
    import tracemalloc

    from quillon.operators.blocks import best_in_block, folded

    rng = np.random.default_rng(k)
    q, d = rng.standard_normal((300, 64)), rng.standard_normal((2000, 64))
    d[7] = 0
    d[90:140] = d[90]  # ties
    same = lambda part: np.arange(300)[part, None] == np.arange(2000)[None]
    tracemalloc.start()
    most = max(len(a) for a, _, _ in best_in_block(q, d, k, sim, same, 1 << 15))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 1 << 15 and peak < 20e6  # all scores' factors at once are 307 MB
    found = np.zeros((300, 2000), bool)
    for a, b, s in best_in_block(q, d, k, sim, same, 1 << 15):
        want = folded(q[a], d[b])
        if sim == "cos":
            want = want / (np.sqrt(folded(q, q))[a] * np.sqrt(folded(d, d))[b])
        assert (s == want).all() and not found[a, b].any()
        found[a, b] = True
    exact = q @ d.T / (np.linalg.norm(q, axis=1)[:, None] * np.maximum(1e-300, np.linalg.norm(d, axis=1))[None] if sim == "cos" else 1)
    exact[np.arange(300), np.arange(300)] = -np.inf
    if sim == "cos":
        exact[:, 7] = -np.inf
    kth = np.sort(exact, 1)[:, -min(k, 2000)]
    assert (found == ((exact >= kth[:, None] - 1e-9 * np.maximum(1, abs(kth))[:, None] if k < 2000 else True) & (exact > -np.inf))).all()
