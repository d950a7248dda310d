"""Numbered batches, gradient sums, training and its saved states; packed pairs; measures as objects and saved runs."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import book_training as bt
from quillon.operators.encode import cross_score_packed, packed_pairs
from quillon.operators.evaluation import experiment, fingerprint, ils_measure, means, saved_run

PAIRS = "qid string, doc_id_a string, doc_id_b string, query_vec array<double>"


def problem(spark, n=240, docs=60, parts=3, codes=5, width=2, seed=0):
    rng = np.random.default_rng(seed)
    book = rng.standard_normal((parts, codes, width))
    truth = book + 0.8 * rng.standard_normal(book.shape)
    own = rng.integers(0, codes, (docs, parts))
    at = np.arange(parts)
    rows = []
    for i in range(n):
        q = rng.standard_normal((parts, width))
        a, b = rng.choice(docs, 2, False)
        s = lambda d: float((truth[at, own[d]] * q).sum())  # noqa: E731, B023
        a, b = (a, b) if s(a) > s(b) else (b, a)
        rows.append((f"q{i}", f"d{a}", f"d{b}", q.ravel().tolist()))
    coded = spark.createDataFrame([(f"d{i}", [int(x) for x in c]) for i, c in enumerate(own)], "docno string, codes array<int>")
    return spark.createDataFrame(rows, PAIRS), coded, book, rows, own


def plain_gradient(rows, own, book):
    parts, _, width = book.shape
    out, loss = np.zeros_like(book), 0.0
    for _, a, b, q in rows:
        q, a, b = np.array(q).reshape(parts, width), own[int(a[1:])], own[int(b[1:])]
        x = sum(float(np.dot(q[m], book[m, b[m]] - book[m, a[m]])) for m in range(parts))
        loss += np.log1p(np.exp(x))
        for m in range(parts):
            out[m, b[m]] += q[m] / (1 + np.exp(-x))
            out[m, a[m]] -= q[m] / (1 + np.exp(-x))
    return loss / len(rows), out / len(rows)


def test_every_pair_has_one_place_an_epoch(spark):
    rows = spark.createDataFrame([(f"q{i % 7}", f"a{i % 50}", f"b{i}") for i in range(333)] + [("x", "y", "z")] * 5 + [(None, "y", "z")], "qid string, doc_id_a string, doc_id_b string")
    saved = bt.BUCKET_ROWS
    try:
        bt.BUCKET_ROWS = 20  # many buckets
        got = bt.numbered(rows.repartition(5), 50, 3).collect()
        bt.BUCKET_ROWS = saved
        one = bt.numbered(rows.coalesce(1), 50, 3).collect()
    finally:
        bt.BUCKET_ROWS = saved
    for e in range(3):
        assert sorted(r["batch"] * 50 + r["position"] for r in got if r["epoch"] == e) == list(range(339))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(one, key=key)
    order = lambda e: [r["doc_id_b"] for r in sorted((r for r in got if r["epoch"] == e), key=lambda r: (r["batch"], r["position"]))]
    assert order(0) != order(1)
    assert bt.numbered(rows.where(F.lit(False)), 50, 2).collect() == []


def test_gradient_sums_are_exact_and_independent_of_partitions(spark):
    pairs, coded, book, rows, own = problem(spark)
    loss, slope, n = bt.gradient(bt.with_codes(pairs, coded), book, 16)
    want = plain_gradient(rows, own, book)
    assert n == len(rows) and loss == pytest.approx(want[0], abs=1e-12) and np.allclose(slope, want[1], atol=1e-12)
    again = bt.gradient(bt.with_codes(pairs.repartition(13), coded), book, 16)
    assert again[0] == loss and (again[1] == slope).all()
    step = 1e-6  # against differences
    moved = book.copy()
    moved[1, 2, 0] += step
    assert (plain_gradient(rows, own, moved)[0] - want[0]) / step == pytest.approx(slope[1, 2, 0], abs=1e-4)
    assert bt.gradient(bt.with_codes(pairs.where(F.lit(False)), coded), book)[::2] == (0.0, 0)


def same(a, b):
    return all((getattr(a, k) == getattr(b, k)).all() for k in ("book", "first", "second", "best")) and (a.step, a.epoch, a.best_loss, a.stale, a.history) == (b.step, b.epoch, b.best_loss, b.stale, b.history)


def test_training_lowers_the_loss_and_goes_on_where_it_was_killed(spark, tmp_path):
    pairs, coded, book, rows, _ = problem(spark, 160)
    train, valid = pairs.where(F.substring("qid", 2, 9).cast("int") < 120), pairs.where(F.substring("qid", 2, 9).cast("int") >= 120)
    how = {"codes": lambda _: coded, "batch_size": 60, "rate": 0.05}
    straight = bt.train_book(train, valid, book, epochs=4, path=str(tmp_path / "straight"), **how)
    assert straight.epoch == 4 and straight.step == 8 and straight.history[-1][2] < straight.history[0][2] < 5
    assert straight.best_loss < bt.gradient(bt.with_codes(valid, coded), book)[0]
    bt.train_book(train, valid, book, epochs=2, path=str(tmp_path / "killed"), **how)
    shutil.copytree(tmp_path / "killed" / "state", tmp_path / "broken" / "state")
    (tmp_path / "killed" / "state" / "v99").mkdir()  # a commit that broke off
    resumed = bt.train_book(train.repartition(3), valid, book, epochs=4, path=str(tmp_path / "killed"), **how)
    assert same(resumed, straight) and same(bt.saved_state(spark, str(tmp_path / "killed")), straight)
    with pytest.raises(ValueError, match="other settings"):
        bt.train_book(train, valid, book, epochs=4, path=str(tmp_path / "killed"), **{**how, "rate": 0.1})


def test_training_stops_when_nothing_gets_better(spark):
    pairs, coded, book, *_ = problem(spark, 60)
    state = bt.train_book(pairs, pairs, book, lambda _: coded, epochs=9, batch_size=60, rate=50.0, patience=1, recode=True)
    assert state.epoch < 9 and state.stale == 1 and (state.best == book).all()


def packed(sizes, budget):
    out, batch, held = {}, 0, 0
    for q, n in sizes:
        if held and held + n > budget:
            batch, held = batch + 1, 0
        out[q], held = batch, held + n
    return out


def test_whole_queries_share_batches(spark):
    rng = np.random.default_rng(0)
    sizes = {f"q{i:02d}": int(rng.integers(1, 30)) for i in range(40)} | {"q99": 150}
    rows = [(q, f"text {q}", f"{q} {j:03d}", f"d{j}") for q, n in sizes.items() for j in range(n)] + [("none", None, "a", "d0"), ("none", None, None, "d1")]
    pairs = spark.createDataFrame(rows, "qid string, query string, text string, docno string").repartition(9)

    def score(queries, lists):
        assert len(queries) == len(set(queries)) == len(lists)
        return [np.array([len(q) + len(t) / 100 for t in texts]) for q, texts in zip(queries, lists, strict=True)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # queries span Arrow batches
    try:
        got = packed_pairs(pairs, 40, 3, score).collect()
        ranked = cross_score_packed(pairs, score, 40, 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(ranked) == len(rows)
    assert all(r["score"] == pytest.approx(len(r["query"] or "") + len(r["text"] or "") / 100) for r in got)
    for part in range(3):
        own = sorted({r["query"] or "" for r in got if r["part"] == part})
        count = {q: sum((r["query"] or "") == q for r in got) for q in own}
        assert {(r["query"] or "", r["batch"]) for r in got if r["part"] == part} == set(packed([(q, count[q]) for q in own], 40).items())
    assert packed_pairs(pairs.where(F.lit(False)), 40).collect() == []


def test_diversity_is_a_measure_and_runs_are_saved(spark, tmp_path):
    vectors = {"d0": (0.0, 1.0, 0.0), "d1": (0.0, 1.0, 1.0), "d2": (1.0, 1.0, 0.0), "d3": (1.0, 1.0, 1.0)}
    place = str(tmp_path / "vectors")
    spark.createDataFrame([(k, list(v)) for k, v in vectors.items()], "docno string, doc_vec array<double>").coalesce(1).write.parquet(place)
    docs = spark.read.parquet(place)
    hits = [("q0", d, i) for i, d in enumerate(vectors)] + [("q1", "d0", 0), ("q2", "d0", 0), ("q2", "d1", 1)]
    run = spark.createDataFrame(hits, "qid string, docno string, rank int")
    qrels = spark.createDataFrame([(q, "d0", 1) for q in ("q0", "q1", "q2", "q3")], "qid string, docno string, label int")
    ils = ils_measure(docs)
    got = {r["qid"]: (r["ils"], r["ils@2"]) for r in experiment({"a": run}, qrels, more=[ils, ils @ 2]).collect()}
    assert got == {"q0": (pytest.approx(0.6874, abs=1e-4), pytest.approx(0.7071, abs=1e-4)), "q1": (0, 0), "q2": (pytest.approx(0.7071, abs=1e-4),) * 2, "q3": (0, 0)}
    mean = means(experiment({"a": run}, qrels.where("qid <> 'q3'"), more=[ils, ils @ 2])).first()
    assert mean["ils"] == pytest.approx(0.4648, abs=1e-4) and mean["ils@2"] == pytest.approx(0.4714, abs=1e-4)

    made = []

    def make():
        made.append(1)
        return docs.select("docno", F.size("doc_vec").alias("n"))

    root = str(tmp_path / "runs")
    for _ in range(2):
        found = saved_run(root, "sizes", [docs], make)
    assert len(made) == 1 and not any("/vectors/" in f for f in found.inputFiles()) and found.count() == 4  # the second run reads no vectors
    assert saved_run(root, "other", [docs], make).count() == 4 and len(made) == 2
    before = fingerprint("x", docs)
    spark.createDataFrame([("d9", [1.0])], "docno string, doc_vec array<double>").write.mode("append").parquet(place)
    assert fingerprint("x", spark.read.parquet(place)) != before
    assert fingerprint("x", run) == fingerprint("x", run) != fingerprint("x", run.limit(2))


def test_runs_of_batches_step_as_single_batches_do_in_few_jobs(spark, monkeypatch):
    pairs, coded, book, *_ = problem(spark, 160)
    coded = coded.where(F.col("docno") != "d7")  # some pairs have no codes
    jobs = []
    for name in ("gradient", "stepped"):
        monkeypatch.setattr(bt, name, lambda *a, f=getattr(bt, name), name=name, **b: jobs.append(name) or f(*a, **b))
    how = {"epochs": 1, "batch_size": 20, "rate": 0.05}
    states, counts = [], []
    for rows in (19, 60, 1 << 17):  # no runs, runs of 3 batches of 8, one run
        monkeypatch.setattr(bt, "RUN_ROWS", rows)
        jobs.clear()
        states.append(bt.train_book(pairs, pairs, book, lambda _: coded, **how))
        counts.append((jobs.count("gradient"), jobs.count("stepped")))
    assert counts == [(8 + 2, 0), (2, 3), (2, 1)]
    assert all(s.step == 8 and np.allclose(s.book, states[0].book, atol=1e-10) and np.allclose(s.history, states[0].history, atol=1e-10) for s in states)
    assert same(states[1], states[2])


def test_products_of_positives_and_negatives_need_no_row_for_a_pair(spark, monkeypatch):
    from quillon.operators import blocks, training
    from quillon.sources.store import VectorStore

    for name, size in (("VALUE_ROWS", 9), ("QUERY_ROWS", 3), ("TASK_BLOCKS", 2), ("CELLS", 40)):
        monkeypatch.setattr(blocks, name, size)
    monkeypatch.setattr(bt, "CELLS", 40)
    monkeypatch.setattr(training, "CELLS", 40)
    rng = np.random.default_rng(5)
    parts, codes, width = 3, 4, 2
    book = rng.standard_normal((parts, codes, width))
    label = lambda i: None if i % 13 == 0 else i % 3
    docs = spark.createDataFrame([(i, f"d{i:02d}", rng.standard_normal(6).round(1).tolist(), label(i), [int(c) for c in rng.integers(0, codes, parts)]) for i in range(80)], "docid long, docno string, doc_vec array<double>, label int, codes array<int>")
    queries = spark.createDataFrame([(f"q{i}", rng.standard_normal(6).tolist(), label(i)) for i in range(22)], "qid string, query_vec array<double>, label int")
    store = VectorStore(docs.select("docid", "docno", "doc_vec"))
    hits = store.retrieve(queries.select("qid", "query_vec"), 7)
    qrels = training.judged(training.same_value(queries, docs.select("docid", "docno", "label"), "label"), hits)
    pairs = training.pairs_of(qrels, queries.select("qid", F.col("qid").alias("query")), 4)
    negatives = training.beside(hits, queries, docs, "label", 4)
    assert sorted((r["qid"], r["docno"]) for r in negatives.collect()) == sorted({(r["qid"], r["doc_id_b"]) for r in pairs.collect()} | {(r["qid"], r["docno"]) for r in negatives.collect() if r["qid"] in ("q0", "q13")})

    made = training.value_pairs(queries, docs, "label", negatives)
    triples = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id_a", "doc_id_b").collect())
    assert triples(made) == triples(pairs)
    own = negatives.join(docs.select("docno", "codes"), "docno").groupBy("qid").agg(F.collect_list("codes").alias("negatives"))
    loss, slope, n = bt.product_gradient(queries.join(own, "qid"), docs, "label", book)
    want = bt.gradient(bt.with_codes(pairs.join(queries.select("qid", "query_vec"), "qid"), docs), book, 4)
    assert n == want[2] == pairs.count() and loss == pytest.approx(want[0], abs=1e-12) and np.allclose(slope, want[1], atol=1e-12)

    scores = store.score(qrels.join(queries.select("qid", "query_vec"), "qid")).select("qid", "docno", "score")
    both = pairs.join(scores.select("qid", F.col("docno").alias("doc_id_a"), F.col("score").alias("pos")), ["qid", "doc_id_a"]).join(scores.select("qid", F.col("docno").alias("doc_id_b"), F.col("score").alias("neg")), ["qid", "doc_id_b"])
    got = training.value_losses(queries.join(negatives.groupBy("qid").agg(F.collect_list("score").alias("negatives")), "qid"), docs, "label").first()
    assert got["pairwise"] == pytest.approx(training.pairwise_loss(both).first()["loss"], abs=1e-12)
    assert got["hard"] == pytest.approx(training.hard_negative_loss(both.withColumn("qid", F.concat("qid", "doc_id_a"))).first()["loss"], abs=1e-12)
    assert training.value_losses(queries.withColumn("negatives", F.expr("array(0D)")).where("label > 7"), docs, "label").first()["hard"] is None

    same = training.same_value(queries, docs.select("docid", "docno", "label"), "label")
    for k in (None, 4):
        rows = lambda df: sorted((r["qid"], r["rank"], r["docid"], r["docno"], r["score"]) for r in df.collect())
        assert rows(store.score_same(queries, docs, "label", k)) == rows(store.score(same, k))

    hits = hits.withColumn("rank", F.col("rank") + 2)
    rows = lambda df: sorted(tuple(r[c] for c in ("qid", "doc_id_a", "doc_id_b", "docno", "neg_rank", "pos_rank", "given_rank")) for r in df.collect())
    for k in (2, 6, 9):
        found = training.value_hard_negatives(queries, docs, "label", negatives, hits, k)
        assert rows(found) == rows(training.hard_negatives(pairs, hits, k))
