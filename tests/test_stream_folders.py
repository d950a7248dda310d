"""A batch that fails leaves no folder in the shared place."""

import os

import pytest

from quillon.sources.shared import shared_dir
from quillon.streaming import ingest
from quillon.streaming.ingest import append_vectors


def test_a_refused_batch_leaves_no_folder(spark, tmp_path, monkeypatch):
    caught = {}
    monkeypatch.setattr(ingest, "_started", lambda docs, checkpoint, each: caught.update(each=each))
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "docno string, doc_vec array<double>")
    append_vectors(rows, str(tmp_path / "store"), "log")
    folders = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("docids")}
    before = folders()
    with pytest.raises(ValueError, match="sizes 1 to 2"):
        caught["each"](rows, 0)
    assert folders() == before
