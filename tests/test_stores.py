"""Stores that streams append to, stores of codes, and options of encoders."""

import numpy as np
import pytest

from quillon.operators import encode, pq
from quillon.operators.ranking import memoised
from quillon.sources.codes import CodeStore
from quillon.sources.store import VectorStore, exists, with_docids
from quillon.streaming.ingest import append_vectors

KINDS = "docno string, doc_vec array<double>"


def vectors(spark, n=60, size=6, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, size))
    return spark.createDataFrame([(i, f"d{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "docid long, docno string, doc_vec array<double>"), x


def appended(spark, tmp_path, rows, store):
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(source)
    append_vectors(spark.readStream.schema(KINDS).parquet(source), store, str(tmp_path / "log")).awaitTermination()


def test_a_stream_goes_on_where_a_written_store_ends(spark, tmp_path):
    path = str(tmp_path / "store")
    VectorStore.write(vectors(spark, 7, 2)[0].select("docno", "doc_vec"), path)
    for part in range(2):
        appended(spark, tmp_path, [(f"s{part}{i}", [float(i), 1.0]) for i in range(4)], path)
    store = VectorStore.open(spark, path)
    rows = store.vectors.collect()
    assert len(store) == 15 and store.vectors.columns == ["docid", "docno", "doc_vec"]
    assert sorted(r["docid"] for r in rows) == list(range(15)) and {r["docno"] for r in rows if r["docid"] < 7} == {f"d{i:03d}" for i in range(7)}


def test_a_stream_begins_a_store_and_refuses_other_sizes(spark, tmp_path):
    path = str(tmp_path / "store")
    assert not exists(spark, path)
    appended(spark, tmp_path, [("a", [1.0, 2.0]), ("b", [1.0, 3.0])], path)
    assert exists(spark, path) and len(VectorStore.open(spark, path)) == 2
    with pytest.raises(Exception, match="sizes 3 to 3"):
        appended(spark, tmp_path, [("c", [1.0, 2.0, 3.0])], path)


def test_docids_are_dense_with_ties(spark):
    docs = spark.createDataFrame([("same", float(i % 5)) for i in range(200)] + [(None, 1.0)], "docno string, x double").repartition(7)
    got = with_docids(docs, "docno").collect()
    assert sorted(r["docid"] for r in got) == list(range(201)) and next(r["docid"] for r in got if r["docno"] is None) == 0


def test_codes_on_disk(spark, tmp_path):
    docs, x = vectors(spark)
    book = pq.trained(docs, 3, 8, 3, start=pq.sampled_codebook(docs, 3, 8))
    path = str(tmp_path / "codes")
    made = CodeStore.build(VectorStore(docs), book, path)
    store = CodeStore.open(spark, path)
    assert len(store) == len(made) == 60 and store.scan(10, 20).count() == 10 and np.array_equal(store.book, book)
    want = pq.nearest_codes(x, book, "l2")
    assert {r["docid"]: r["codes"] for r in store.codes.collect()} == dict(enumerate(want.tolist()))
    near = {r["docid"]: r["doc_vec"] for r in store.vectors().vectors.collect()}
    rebuilt = np.concatenate([book[m][want[:, m]] for m in range(3)], 1)
    assert np.allclose([near[i] for i in range(60)], rebuilt)
    asked = spark.createDataFrame([("q", [float(v) for v in x[5]])], "qid string, query_vec array<double>")
    for prune in (False, True):
        hits = sorted((r["rank"], r["docid"], r["score"]) for r in store.retrieve(asked, 7, prune).collect())
        order = np.lexsort((np.arange(60), -(rebuilt @ x[5])))[:7]
        assert [d for _, d, _ in hits] == order.tolist() and np.allclose([s for *_, s in hits], (rebuilt @ x[5])[order])
    with pytest.raises(Exception, match="(?i)exist"):
        CodeStore.build(VectorStore(docs), book, path)
    with pytest.raises(ValueError, match="do not fit"):
        CodeStore.write(spark.createDataFrame([(0, "a", [0, 0, 9]), (1, "b", [0, 0]), (2, "c", None)], "docid long, docno string, codes array<int>"), book, path, mode="overwrite")
    other, _ = vectors(spark, 9, seed=4)  # another corpus under the same codebook
    assert len(CodeStore.build(VectorStore(other), book, path, mode="overwrite")) == 9


def test_rotated_codes_on_disk(spark, tmp_path):
    docs, x = vectors(spark)
    rotation, book = pq.learned_rotation(docs, 3, 8, 2)
    store = CodeStore.build(VectorStore(docs), book, str(tmp_path / "codes"), rotation)
    assert np.allclose(store.rotation @ store.rotation.T, np.eye(6))
    near = {r["docid"]: r["doc_vec"] for r in store.vectors().vectors.collect()}
    codes = pq.nearest_codes(x @ rotation, book, "l2")
    rebuilt = np.concatenate([book[m][codes[:, m]] for m in range(3)], 1) @ rotation.T
    assert np.allclose([near[i] for i in range(60)], rebuilt)


class Lengths:
    sim = "dot"

    def encode_queries(self, texts):
        return np.array([[len(x), 1.0] for x in texts])

    def encode_docs(self, texts):
        return np.array([[len(x), 0.0] for x in texts])


def test_prompts_scaling_and_addresses(spark):
    model = encode.Options(Lengths(), "ask: ", "", True, True)
    assert model.sim == "dot" and model.encode_queries(["ab"]).tolist() == [[7 / 50**0.5, 1 / 50**0.5]]
    assert model.encode_docs(["", "http://x"]).tolist() == [[0.0, 0.0], [1.0, 0.0]] and len(model.encode_docs([])) == 0
    got = encode.encode_queries(spark.createDataFrame([("a", "x"), ("b", "x")], "qid string, query string"), model).collect()
    assert len(got) == 2 and got[0]["query_vec"] == got[1]["query_vec"]


def test_equal_queries_are_searched_once(spark):
    seen = []

    def search(one):
        seen.append(one.count())
        return one.selectExpr("qid", "upper(query) AS docno")

    queries = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "qid string, query string")
    got = memoised(queries, search).collect()
    assert seen == [2] and sorted((r["qid"], r["docno"]) for r in got) == [("a", "X"), ("b", "X"), ("c", "Y")]
