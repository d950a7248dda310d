"""Streams into stores and against them: several streams, late and repeated rows, batches that run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.sources.properties import read_properties, versions, write_properties
from quillon.sources.shared import shared_dir
from quillon.sources.store import VectorStore, read_meta
from quillon.streaming import ingest
from quillon.streaming.ingest import append_vectors, search_stream, upsert_vectors

ROWS = "docno string, doc_vec array<double>"
VERSIONED = ROWS + ", version timestamp"


def fed(spark, source, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)


def appended(spark, tmp_path, name, rows, path):
    append_vectors(fed(spark, str(tmp_path / f"in-{name}"), rows, ROWS), path, str(tmp_path / f"log-{name}")).awaitTermination()


def contents(spark, path):
    store = VectorStore.open(spark, path)
    rows = sorted((r["docid"], r["docno"], tuple(r["doc_vec"])) for r in store.vectors.collect())
    assert len(store) == len(rows)
    return rows


def test_two_streams_keep_each_others_rows(spark, tmp_path):
    import os

    path = str(tmp_path / "store")
    for turn in range(2):
        for name in "ab":
            appended(spark, tmp_path, name, [(f"{name}{turn}{i}", [float(i), 1.0]) for i in range(3)], path)
    rows = contents(spark, path)
    assert [r[0] for r in rows] == list(range(12)) and {r[1] for r in rows} == {f"{n}{t}{i}" for n in "ab" for t in range(2) for i in range(3)}
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("docids")]


def run_again(spark, monkeypatch, function, rows, kind, path, log, fail):
    """Runs a batch that fails at ``fail``, if given; returns the function that a stream would call for each batch."""
    caught = {}
    monkeypatch.setattr(ingest, "_started", lambda docs, checkpoint, each: caught.update(each=each))
    batch = spark.createDataFrame(rows, kind)
    monkeypatch.setattr(type(batch), "withWatermark", lambda self, *a: self)
    monkeypatch.setattr(type(batch), "dropDuplicatesWithinWatermark", lambda self, *a: self)
    function(batch, path, log)
    return lambda number, rows=rows: caught["each"](spark.createDataFrame(rows, kind), number)


def test_a_batch_that_runs_again_takes_its_own_place(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "store"), [(f"a{i}", [float(i), 0.0]) for i in range(4)]
    one = run_again(spark, monkeypatch, append_vectors, rows, ROWS, path, "log-one", None)
    two = run_again(spark, monkeypatch, append_vectors, rows, ROWS, path, "log-two", None)
    one(0)
    first = contents(spark, path)
    one(0)
    assert contents(spark, path) == first
    two(0, [("b0", [1.0, 1.0])])
    one(0)  # once more, after another stream has gone on
    assert contents(spark, path) == [*first, (4, "b0", (1.0, 1.0))]
    one(1, [("a9", [9.0, 9.0])])
    assert contents(spark, path)[-1] == (5, "a9", (9.0, 9.0))


def test_a_batch_that_breaks_off_is_not_read(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "store"), [(f"a{i}", [float(i), 0.0]) for i in range(3)]
    one = run_again(spark, monkeypatch, append_vectors, rows, ROWS, path, "log-one", None)
    two = run_again(spark, monkeypatch, append_vectors, rows, ROWS, path, "log-two", None)
    one(0)
    done = ingest._done
    monkeypatch.setattr(ingest, "_done", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        one(1, [("x", [7.0, 7.0])])  # written, but not yet done
    monkeypatch.setattr(ingest, "_done", done)
    assert len(contents(spark, path)) == 3
    two(0, [("b0", [1.0, 1.0])])
    assert [r[:2] for r in contents(spark, path)][-1] == (4, "b0")  # docid 3 is kept for the batch that broke off
    one(1, [("x", [7.0, 7.0])])
    assert [r[:2] for r in contents(spark, path)][-2:] == [(3, "x"), (4, "b0")]


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_upserts_keep_the_latest_version_and_its_docid(spark, tmp_path):
    path, source, log = (str(tmp_path / x) for x in ("store", "in", "log"))
    batches = [
        [("a", [1.0, 0.0], at(1)), ("b", [2.0, 0.0], at(2)), ("a", [1.5, 0.0], at(3)), ("b", [2.0, 0.0], at(2))],  # a twice, b repeated
        [("b", [2.0, 0.0], at(2)), ("c", [3.0, 0.0], at(4)), ("a", [0.5, 0.0], at(2))],  # b again, an older a
        [("a", [9.0, 0.0], at(5)), ("d", [4.0, 0.0], at(1))],  # a newer a; d is late, within the delay
    ]
    for rows in batches:  # each a run of its own: the stream starts again from its log
        upsert_vectors(fed(spark, source, rows, VERSIONED), path, log).awaitTermination()
    rows = contents(spark, path)
    assert sorted((r[1], r[2][0]) for r in rows) == [("a", 9.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)]
    assert sorted(r[0] for r in rows) == [0, 1, 2, 3] and {r[1]: r[0] for r in rows}["a"] == 0


def test_an_upsert_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    put = run_again(spark, monkeypatch, upsert_vectors, [("a", [1.0], at(1)), ("b", [2.0], at(1))], VERSIONED, path, "log", None)
    put(0)
    put(1, [("a", [5.0], at(2)), ("c", [3.0], at(2))])
    first = contents(spark, path)
    put(1, [("a", [5.0], at(2)), ("c", [3.0], at(2))])
    assert contents(spark, path) == first and [(r[1], r[2]) for r in first] == [("a", (5.0,)), ("b", (2.0,)), ("c", (3.0,))]
    VectorStore.write(spark.createDataFrame([("old", [1.0])], ROWS), path, mode="overwrite")
    put = run_again(spark, monkeypatch, upsert_vectors, [], VERSIONED, path, "other", None)
    put(0, [("old", [2.0], at(0)), ("new", [3.0], at(0))])  # a written row has no version, so any is newer
    assert [(r[1], r[2]) for r in contents(spark, path)] == [("old", (2.0,)), ("new", (3.0,))]


def test_a_stream_of_queries(spark, tmp_path):
    path, out = str(tmp_path / "store"), str(tmp_path / "hits")
    VectorStore.write(spark.createDataFrame([(f"d{i}", [float(i), 1.0]) for i in range(6)], ROWS), path)
    kind = "qid string, query_vec array<double>, query string"
    for turn in range(2):
        search_stream(fed(spark, str(tmp_path / "asked"), [(f"q{turn}", [1.0, 0.0], "text"), (f"r{turn}", [-1.0, 0.0], "text")], kind), path, out, str(tmp_path / "log"), 2).awaitTermination()
    got = spark.read.parquet(out)
    assert {(r["qid"], r["docno"], r["rank"]) for r in got.collect()} == {(f"{q}{t}", d, k) for t in range(2) for q, ds in (("q", ("d5", "d4")), ("r", ("d0", "d1"))) for k, d in enumerate(ds)}
    assert got.where(F.col("query") == "text").count() == 8


def test_properties_survive_a_broken_write(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_properties(spark, path) is None
    for i in range(4):
        write_properties(spark, path, {"i": i})
    assert versions(spark, path) == [3, 4] and read_properties(spark, path)["i"] == 3
    (tmp_path / "store" / "meta" / "v5").mkdir()
    (tmp_path / "store" / "meta" / "v5" / "part-0").write_text("{")  # no success file
    assert read_properties(spark, path)["i"] == 3 and write_properties(spark, path, {"i": 9}) == 5
    assert read_properties(spark, path)["i"] == 9
    with pytest.raises(ValueError):
        read_meta(spark, path)
