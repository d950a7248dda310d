"""The pipeline sends whole texts to Python in short batches."""

import pyarrow as pa

import corpus_pipeline
from quillon.llm.common import TEXT_ROWS

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_send_short_batches_of_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "a", 6) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(NAME)
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "secret scans":  # no Python
                continue
            spark.conf.set(NAME, "10000")
            stage(spark, docs, "/root/testdata/sf0.001")
            assert max(r["n"] for r in spark.range(0, 3000, 1, 1).mapInArrow(rows, "n long").collect()) <= TEXT_ROWS, name
        spark.conf.set(NAME, "50")
        corpus_pipeline.best_fit_packing(spark, docs, "")
        assert spark.conf.get(NAME) == "50"
    finally:
        spark.conf.set(NAME, before)
