"""Vector files as a data source, rebuilt stores, context caches, and stages that go by the columns they meet."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import pq
from quillon.operators.encode import attach_text
from quillon.plans.pipeline import AttachText, ByShape, EncodeDocs, EncodeQueries, ScoreTexts
from quillon.sources.codes import CodeStore
from quillon.sources.context import ContextCache
from quillon.sources.store import VectorStore
from quillon.sources.vectorfile import Reader, compact, expanded, read_vector_file, write_vector_file


def corpus(spark, n=300, size=6, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, size)).astype(np.float32)
    return spark.createDataFrame([(f"doc{i:04d}" if i % 3 else f"other {i}", [float(c) for c in v]) for i, v in enumerate(x)], "docno string, doc_vec array<double>")


@pytest.mark.parametrize("names", [[], ["a"], [f"d{i}" for i in range(500)], [f"d{i:05d}" for i in range(95, 12000)], ["d1", "d3", "d5", "d100", "d7"], ["x1", "y"], ["07", "08", "9", "10"], ["99", "100", "101"], ["d", "d1"], ["a00", "a01", "a1"], ["7"] * 5, ["12345678901234567890"]])
def test_docnos_come_back_from_runs(names):
    held = json.loads(json.dumps(compact(names)))
    assert list(expanded(held)) == names
    for a, b in ((0, 1), (2, 4), (1, None), (3, 3)):
        assert list(expanded(held, a, b)) == names[a:b]
    if len(names) > 400:
        assert len(json.dumps(held)) < 100


def test_vector_files_equal_the_store(spark, tmp_path):
    store = VectorStore.write(corpus(spark), str(tmp_path / "store"))
    path = str(tmp_path / "files")
    write_vector_file(store.vectors, path)
    rows = lambda df: sorted((r["docid"], r["docno"], tuple(r["doc_vec"])) for r in df.collect())
    back = read_vector_file(spark, path)
    assert rows(back) == rows(store.vectors) and back.count() == 300
    for cond in ("docid >= 40 and docid < 77", "docid = 3", "docid > 290", "docid <= 5 and docno like 'doc%'", "docid > 500", "docid < 9 or docid > 295"):
        assert rows(back.where(cond)) == rows(store.vectors.where(cond)), cond
    assert back.select("docno").where("docid = 7").first()[0] == store.vectors.where("docid = 7").first()["docno"]
    assert rows(back) == rows(store.vectors)  # filters leave nothing behind in the frame
    for a, b in ((40, 77), (None, 5), (290, None), (17, 17), (500, None)):
        some = read_vector_file(spark, path, a, b)
        assert rows(some) == rows(store.scan(a, b)) and rows(some.where("docid % 2 = 0")) == rows(store.scan(a, b).where("docid % 2 = 0"))
        assert sum(p.stop - p.start for p in Reader(path, a or 0, b).partitions()) == some.count()  # no other byte is read
    with pytest.raises(Exception, match="FileExists"):
        write_vector_file(store.vectors, path)
    write_vector_file(store.vectors.where("docid < 10"), path, "overwrite")
    assert read_vector_file(spark, path).count() == 10 and len(list((tmp_path / "files").glob("*.f4"))) == len(json.loads((tmp_path / "files" / "manifest.json").read_text())["files"])
    with pytest.raises(Exception, match="gaps|consecutive"):
        write_vector_file(store.vectors.where("docid <> 5"), str(tmp_path / "gap"))
    write_vector_file(store.vectors.limit(0), str(tmp_path / "none"))
    assert read_vector_file(spark, str(tmp_path / "none")).collect() == []


def test_a_store_is_rebuilt_from_codes_with_its_error(spark, tmp_path):
    store = VectorStore.write(corpus(spark), str(tmp_path / "store"))
    book = pq.sampled_codebook(store.vectors, 3, 8)
    coded = CodeStore.build(store, book, str(tmp_path / "codes"))
    rebuilt, error = coded.rebuild(store, str(tmp_path / "rebuilt"))
    a, b = ({r["docid"]: (r["docno"], np.array(r["doc_vec"])) for r in s.vectors.collect()} for s in (store, VectorStore.open(spark, str(tmp_path / "rebuilt"))))
    assert {i: x[0] for i, x in a.items()} == {i: x[0] for i, x in b.items()} and len(rebuilt) == 300
    assert error == pytest.approx(np.mean([((a[i][1] - b[i][1]) ** 2).sum() for i in a]), rel=1e-5)
    with pytest.raises(ValueError, match="power of two"):
        CodeStore.write(coded.codes, book[:, :7], str(tmp_path / "seven"))


class Counting:
    """Vectors of a text's length and vowels; in context, measured from its mean."""

    sim = "dot"

    def encode_queries(self, texts, context=None):
        x = np.array([[len(t), sum(c in "aeiou" for c in t)] for t in texts], float).reshape(len(texts), 2)
        return x if context is None else x - context.mean(0)

    encode_docs = encode_queries


def test_an_encoder_in_the_context_of_a_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "a" * i) for i in range(50)], "docno string, text string")
    cache = ContextCache.write(docs, Counting(), str(tmp_path / "cache"), 20, "counting")
    again = ContextCache.open(spark, str(tmp_path / "cache"))
    assert again.shape == (20, 2) and again.model == "counting" and (again.matrix() == cache.matrix()).all()
    assert ContextCache.write(docs.repartition(7), Counting(), str(tmp_path / "other"), 20).matrix().tolist() == cache.matrix().tolist()
    got = EncodeDocs(again.encoder(Counting()))(docs).where("docno = 'd9'").first()["doc_vec"]
    assert np.allclose(got, np.array([9, 9]) - cache.matrix().mean(0))
    assert ContextCache.write(docs, Counting(), str(tmp_path / "all"), 99).shape == (50, 2)


def test_an_encoder_goes_by_the_columns(spark):
    stage = ByShape(Counting())
    q = spark.createDataFrame([("1", "aei")], "qid string, query string")
    d = spark.createDataFrame([("d", "xo")], "docno string, text string")
    both = q.crossJoin(d)
    assert isinstance(stage.stage_for(q), EncodeQueries) and isinstance(stage.stage_for(d), EncodeDocs) and isinstance(stage.stage_for(both), ScoreTexts)
    vectors = both.withColumn("query_vec", F.array(F.lit(1.0), F.lit(0.0))).drop("query")
    assert isinstance(stage.stage_for(vectors), ScoreTexts) and isinstance(stage.stage_for(vectors.withColumn("doc_vec", F.col("query_vec")).drop("text")), ScoreTexts)
    assert stage(q).first()["query_vec"] == [3.0, 3.0] and stage(d).first()["doc_vec"] == [2.0, 1.0]
    assert [stage(x).first()["score"] for x in (both, vectors)] == [9.0, 2.0]
    with pytest.raises(ValueError):
        stage.stage_for(spark.createDataFrame([("x",)], "other string"))


def test_texts_are_attached_to_hits(spark):
    hits = spark.createDataFrame([("q", "a", "old"), ("q", "b", "old"), ("r", "z", "old")], "qid string, docno string, text string")
    docs = spark.createDataFrame([("a", "A"), ("b", None)], "docno string, text string")
    assert sorted(tuple(r) for r in AttachText(docs)(hits).select("qid", "docno", "text").collect()) == [("q", "a", "A"), ("q", "b", None), ("r", "z", None)]
    assert attach_text(hits, docs, missing="drop").count() == 2
    with pytest.raises(KeyError):
        attach_text(hits, docs, missing="raise")
