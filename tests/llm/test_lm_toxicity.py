import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm.attention import END, IDS, Attention, vocabulary, windows
from quillon.llm.common import crc_mod
from quillon.llm.lm import score_language
from quillon.llm.toxicity import fit_toxicity, labelled_sample, score_toxicity
from quillon.llm.trees import BoostedTrees, isotonic

DOCS = "doc_id long, text string, score string"


def small_model():
    rng = np.random.default_rng(0)
    seqs = [rng.choice(40, 30) for _ in range(40)]
    counts = np.bincount(np.concatenate(seqs), minlength=IDS)
    counts[END] = 40
    return Attention(vocabulary(counts, seqs, classes=8, rows=300)).start(width=8, hidden=8, classes=8, rows=300), seqs


def test_windows_score_each_id_once():
    seqs = [np.arange(n) for n in (0, 1, 23, 24, 25, 100)]
    inputs, targets, each = windows(seqs)
    assert (targets >= 0).sum() == sum(len(s) + 1 for s in seqs) and each.sum() == len(inputs)
    at = 0
    for s, n in zip(seqs, each, strict=True):
        own = targets[at : at + n].ravel()
        assert own[own >= 0].tolist() == [*s, END]
        before = inputs[at : at + n, -24:].ravel()[: len(s) + 1]
        assert before.tolist() == [END, *s]
        at += n


def test_gradients_are_those_of_the_loss():
    net, seqs = small_model()
    inputs, targets, _ = windows(seqs[:3])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, g = net.loss_and_gradients(inputs, targets)
    rng = np.random.default_rng(1)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(g[k].reshape(-1)), 3):
            old = flat[i]
            flat[i] = old + 1e-5
            up = net.loss_and_gradients(inputs, targets)[0]
            flat[i] = old - 1e-5
            down = net.loss_and_gradients(inputs, targets)[0]
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k].reshape(-1)[i], rel=2e-2, abs=1e-6)


def test_probabilities_add_up_and_look_only_back():
    net, seqs = small_model()
    net.train(seqs, steps=60, batch=16)
    inputs, targets, _ = windows([seqs[0]])
    every = np.repeat(inputs[:1], IDS, 0)
    goal = np.full((IDS, 24), -1)
    goal[:, 5] = np.arange(IDS)
    p = np.concatenate([net.log10(every[i : i + 4096], goal[i : i + 4096])[:, 5] for i in range(0, IDS, 4096)])
    assert (10**p).sum() == pytest.approx(1, abs=1e-4)
    changed = inputs.copy()
    changed[0, 20:] = 3
    assert np.allclose(net.log10(inputs, targets)[0, :11], net.log10(changed, targets)[0, :11])


def test_base_scores_against_brute_force(spark):
    texts = ["The cat the DOG", "a b", None, "", "É cat\x0bdog  x", "the " * 400, "the cat <|endoftext|> é"]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(0, texts[0], "old"), (None, "no id", None)]
    got = score_language(spark.createDataFrame(rows, DOCS), lambda i: i == 1, steps=5).collect()
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t, _ in rows]
    counts = Counter(w for (i, _, _), t in zip(rows, tokens, strict=True) if i != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((str(i), i == 1, len(t), sum(counts[w] > 0 for w in t), n), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for (i, _, _), t in zip(rows, tokens, strict=True))
    have = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"]) for r in got)
    assert [h[0] for h in have] == [w[0] for w in want] and [h[1] for h in have] == pytest.approx([w[1] for w in want])
    assert all(r["score"] < 0 for r in got)
    assert score_language(spark.createDataFrame([], DOCS), lambda i: crc_mod(i, 7) == 2, steps=1).count() == 0


def test_model_learns_from_every_training_text(spark):
    from quillon.llm import lm

    rng = np.random.default_rng(5)
    seqs = [rng.choice(40, int(n)) for n in rng.integers(0, 90, 3000)] + [rng.choice(40, 2_600_000)]  # more texts than 2,500, one of more ids than 2,500,000
    counts = np.bincount(np.concatenate(seqs), minlength=IDS)
    counts[END] = len(seqs)
    rows = spark.createDataFrame([(i, s.astype("<u2").tobytes()) for i, s in enumerate(seqs)], "uid long, ids binary").repartition(8, "uid")
    net, met = lm.fitted(rows, counts, 1)
    assert met == sum(-(-(len(s) + 1) // net.stride) for s in seqs)
    words = lm.classes_of(rows, counts)
    want = vocabulary(counts, seqs)
    assert (words.of_class == want.of_class).all() and np.allclose(words.share, want.share)


def test_every_id_is_scored_behind_half_a_window():
    from quillon.llm.lm import CONTEXT, NEW

    _, seqs = small_model()
    counts = np.bincount(np.concatenate(seqs), minlength=IDS)
    net = Attention(vocabulary(counts, seqs), CONTEXT, NEW).start()
    assert net.p["w2"].shape == (64, 192) and CONTEXT - NEW >= max(64, CONTEXT // 2)
    inputs, targets, _ = windows([np.arange(300) % 40], CONTEXT, NEW)
    changed = inputs.copy()
    changed[1, 0] = 39
    assert net.log10(inputs, targets)[1, 0] != net.log10(changed, targets)[1, 0]


def test_isotonic_pools_violators():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(y) >= 0).all() and np.interp([2, 3], x, y).tolist() == [0.5, 0.5] and y[-1] == 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.5)).astype(float)
    assert ((BoostedTrees().fit(x, y, np.ones(2000)).raw(x) > 0) == y).mean() > 0.98


def test_toxic_texts_are_found_and_odd_ones_scored(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(240):
        w = list(rng.choice(words, 30))
        if i % 4 == 0:
            w[3:6] = ["you", "FOOL!", "ugh"]
        rows.append((i, " ".join(w), "old"))
        if i < 200:
            labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, "old"), (901, "", "old"), (902, "w1 " * 20000, "old"), (None, "you fool! ugh", "old"), (0, rows[0][1], "old")]
    docs = spark.createDataFrame(rows, DOCS)
    model = fit_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    assert "fool" in model.lexicon
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and docs.columns[:2] == ["doc_id", "text"]
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
        assert 0 <= r["score"] <= 1
    bare = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in score_toxicity(docs, bare).select("predicted").distinct().collect()} == {0}
    assert score_toxicity(docs.where(F.lit(False)), model).count() == 0
    toxic = fit_toxicity(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in score_toxicity(docs, toxic).select("predicted").distinct().collect()} == {1}


def test_equal_texts_with_different_labels_are_one_toxic_row(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}", "x") for i in range(8)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    sample, total = labelled_sample(docs, labels, lambda i: F.lit(True))
    assert sorted(map(tuple, sample.collect())) == [(1, f"text {i}") for i in range(4)] and total == {0: 4, 1: 4}
