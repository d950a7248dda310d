import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.ngram_join import ngram_components
from quillon.llm.piece_bpe import MODEL, PieceEncoder, encode_documents, round_trips
from quillon.llm.quality import GOOD, JUNK, NONE, LabelModel, expectation_maximisation, fit_quality, score_quality, votes_of
from quillon.llm.subword import ByteBpe

DOCS = "doc_id long, text string, quality string"
TEXTS = ["Hello world, hello worlds", "", None, "  two  spaces ", "tab\tand\nline\n\n", "é😀 中文字 naïve", "<s> </s> <0x41> <unk>", "x" * 400, "The thing that thinks thoroughly " * 300, "tie", "tie"]


def test_ids_are_the_librarys_and_come_back(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (0, TEXTS[0], "old")]
    docs = spark.createDataFrame(rows, DOCS)
    got = encode_documents(docs, rule="merges").collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "")
        assert r["piece_ids"] == want and r["n_pieces"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    for rule in ("scores", "merges"):
        assert all(r["exact"] for r in round_trips(docs, keep=["doc_id"], rule=rule).collect())
    assert encode_documents(docs.where(F.lit(False))).count() == 0


def test_shared_prefixes_change_nothing():
    words = sorted({"▁the", "▁then", "▁thereby", "▁therefore", "▁thin", "a", "ab", "abc", "▁▁▁x", "▁é", "▁éa", "▁zzzzzz"})
    for rule in ("scores", "merges"):
        assert PieceEncoder(rule=rule).walk(words) == [PieceEncoder(rule=rule).walk([w])[0] for w in words]


def test_best_paths_against_all_segmentations():
    encoder = PieceEncoder()
    piece_of = {i: p for p, i in encoder.id_of.items()}

    def cuts(word):
        yield from [[word], *([word[:i], *rest] for i in range(1, len(word)) for rest in cuts(word[i:]))]

    total = lambda parts: sum(encoder.score.get(p, encoder.unknown) for p in parts)
    words = sorted({"▁the", "▁theory", "▁thermos", "▁unbeliev", "naïvety", "▁▁▁x", "▁q\u0e01z", "zzzzzzz", "▁is", "▁island"})
    for word, ids in zip(words, encoder.walk(words), strict=True):
        best = max(total(c) for c in cuts(word) if all(len(p) == 1 or p in encoder.score for p in c))
        got, at = 0.0, 0
        while at < len(ids):  # bytes spell one character
            if ids[at] in piece_of:
                got, at = got + encoder.score[piece_of[ids[at]]], at + 1
            else:
                raw = bytes([encoder.byte_of[ids[at]]])
                while not raw.decode("utf-8", "ignore"):
                    at += 1
                    raw += bytes([encoder.byte_of[ids[at]]])
                got, at = got + encoder.unknown, at + 1
        assert got == pytest.approx(best, abs=1e-9), word


def test_given_scores_decide_the_path():
    scores = {"▁": -3.0, "a": -3.0, "b": -3.0, "▁a": -1.0, "ab": -1.5, "▁ab": -9.0}
    encoder = PieceEncoder(scores=scores)
    assert encoder.walk(["▁ab"]) == [[encoder.id_of["▁a"], encoder.id_of["b"]]]


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    votes = np.zeros((20000, 5), np.int8)
    for j, accuracy in enumerate((0.95, 0.9, 0.85, 0.8, 0.7)):
        right = rng.random(20000) < accuracy
        votes[:, j] = np.where(rng.random(20000) < 0.2, NONE, np.where(truth == right, GOOD, JUNK))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = expectation_maximisation(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.04) and model.right[0] == pytest.approx([0.95, 0.9, 0.85, 0.8, 0.7], abs=0.07)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93
    assert votes_of(np.array([0, 3**9 - 1])).tolist() == [[-1] * 9, [1] * 9] and LabelModel(0.5, np.full((2, 9), 0.7)).posterior(np.zeros((1, 9)))[0] == 0.5


def test_long_words_and_long_texts_are_looked_at_whole():
    from quillon.llm.quality import WordShapes, shape

    start = "a" * 64
    assert shape(start + "9Z" * 50) == "x" + "9X" * 50
    look = WordShapes().look
    assert look(start + "bc")[1].tolist() != look(start + "9Z")[1].tolist()
    vote = lambda words: look(" ".join(words))[0][1]
    assert vote([f"w{i % 60}" for i in range(400)]) == vote([f"w{i // 400 * 60 + i % 60}" for i in range(2000)]) == JUNK
    assert vote([f"w{i}" for i in range(2000)]) == GOOD


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "elo", "iter", "ond", "usk")]
    prose = lambda n: " ".join((w.capitalize() + "." if i % 9 == 8 else w) for i, w in enumerate(rng.choice(words, n)))
    rows = [(i, prose(60), "old") for i in range(200)] + [(1000 + i, " ".join([str(rng.choice(words))] * 50), "old") for i in range(25)] + [(2000 + i, prose(50).upper().replace(" ", "!! "), "old") for i in range(25)]
    rows += [(3000, None, "old"), (3001, "", "old"), (3002, prose(30000), "old"), (None, prose(20), None), (0, rows[0][1], "old")]
    docs = spark.createDataFrame(rows, DOCS)
    got = score_quality(docs, fit_quality(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 3000:
            assert r["kept"] == int(r["doc_id"] < 1000), r["text"]
    assert score_quality(docs.where(F.lit(False)), fit_quality(docs.where(F.lit(False)))).count() == 0


def test_the_pipeline_stage_by_stage(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        place = str(tmp_path / str(i))
        stage(spark, docs, d).write.parquet(place)
        after = spark.read.parquet(place)
        counts.append(after.count())
        if i == 0:
            kept = {r["doc_id"] for r in after.collect()}
            assert len(kept & toxic) <= 0.5 * len(toxic) and len(kept) >= 0.9 * (counts[0] - len(toxic))
        if i == 2:
            of = {r["doc_id"]: r["component_id"] for r in ngram_components(docs).collect()}
            assert {r["doc_id"] for r in after.collect()} == set(of.values())
        if i == 3:
            assert counts[4] == counts[3] and after.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
        if i < 4:
            assert after.columns == columns, name
        before, docs = docs, after
    bpe, sequences = ByteBpe(), defaultdict(int)
    total = sum(len(bpe.ids(r["text"] or "")) + 1 for r in before.collect())
    for r in docs.collect():
        sequences[r["sequence_id"]] += r["length"]
    assert sum(sequences.values()) == total and max(sequences.values()) <= 1024 and len(sequences) <= -(-total // 1024) * 1.02 + 1
    assert pq.read_schema(next((tmp_path / "0").glob("*.parquet"))).names == columns


def test_names_that_stages_use_are_left_alone(spark):
    rows = [(1, "token=abcdef0 and more", "a", "b", "c", "d"), (2, None, "a", "b", "c", "d"), (None, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_in string, `_text_in` string, `all` string, score string")
    out = score_quality(docs, fit_quality(docs)).collect()
    assert sorted((r["doc_id"], r["text_in"], r["_text_in"], r["all"]) for r in out if r["doc_id"]) == [(1, "a", "b", "c"), (2, "a", "b", "c")] and len(out) == 3


def test_the_pipeline_on_nothing_and_on_nulls(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `all` string, `_text` string"
    for rows in ([], [(1, None, None, None, None, None, None), (None, "", "x", None, 0, "x", "y"), (None, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, kinds)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), schema=stage(spark, docs, "/root/testdata/sf0.001").schema)
            assert i == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
