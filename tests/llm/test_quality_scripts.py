"""The quality classifier on texts without spaces, and its estimate and scorer against plain versions."""

import base64
import random

import numpy as np
import pytest

from quillon.llm.quality import DIMENSIONS, GOOD, JUNK, LABELLERS, NONE, WordShapes, expectation_maximisation, fit_quality, score_quality, words_of

HAN = [chr(0x4E00 + i * 7) for i in range(400)]
THAI = [chr(0x0E01 + i) for i in range(44)] + ["า", "ะ", "ี", "่", "้"]
LATIN = "the a river house green walks over under quiet morning people often read letters and small boats near old stone bridges while rain falls slowly on gardens".split()


def han(r, n=300):
    return "".join(r.choice(HAN) + (r.choice("，。，。！") if i % r.randint(9, 16) == 8 else "") for i in range(n)) + "。"


def thai(r):
    return " ".join("".join(r.choice(THAI) for _ in range(r.randint(20, 60))) for _ in range(12))


def latin(r):
    return " ".join(" ".join(r.choice(LATIN) for _ in range(r.randint(6, 14))).capitalize() + "." for _ in range(12))


KINDS = {
    "latin": latin,
    "han": han,
    "thai": thai,
    "advert": lambda r: r.choice(["便宜买", "免费领取", "点击这里"]) * 500,
    "thai advert": lambda r: "ราคาถูก" * 300,
    "base64": lambda r: base64.b64encode(bytes(r.randrange(256) for _ in range(1500))).decode(),
    "spam": lambda r: " ".join(["BUY NOW!!"] * 120),
}
CLEAN = ("latin", "han", "thai")


def test_texts_without_spaces_are_told_apart(spark):
    r = random.Random(7)
    rows = [(f"{k} {i}", KINDS[k](r)) for k in KINDS for i in range(120 if k == "latin" else 30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = score_quality(docs, fit_quality(docs), keep=["doc_id"]).collect()
    share = {k: np.mean([x["kept"] for x in got if x["doc_id"].rsplit(" ", 1)[0] == k]) for k in KINDS}
    assert all(share[k] == 1 for k in CLEAN) and all(share[k] == 0 for k in KINDS if k not in CLEAN), share


def test_runs_are_cut_whole():
    assert words_of("plain words only") [0] == ["plain", "words", "only"]
    words, cut, long = words_of("我们iPhone好的。")
    assert words == ["我们", "iPhone", "好的", "。"] and cut.tolist() == [True, False, True, False] and long == 0
    text = "".join(chr(97 + i % 26) for i in range(5003))
    words, cut, long = words_of(text)
    assert words[0] == text[:12] and words[-1].endswith(text[-5:]) and long == 5003 and cut.all()
    assert len(words) == len(range(0, 5003 - 12 + 6, 6))
    words, _, _ = words_of("ก" * 7)
    assert words == ["กกก"] * 5


def plain_estimate(votes, counts, rounds=100):
    """The same estimate, text by text, in loops."""
    rows = [(v, c) for v, c in zip(votes.tolist(), counts.tolist(), strict=True)]
    k = votes.shape[1]
    p = [1 / (1 + np.exp(-(1.0 + 0.5 * v.count(GOOD) - 3.0 * v.count(JUNK)))) for v, _ in rows]
    for _ in range(rounds):
        prior = min(max((sum(c * x for (_, c), x in zip(rows, p, strict=True)) + 1) / (sum(c for _, c in rows) + 2), 0.02), 0.98)
        right = [[0.0] * k, [0.0] * k]
        for side, vote, plus, of in ((0, JUNK, 2, 4), (1, GOOD, 9, 10)):
            for j in range(k):
                own = [(v[j], c * (x if side else 1 - x)) for (v, c), x in zip(rows, p, strict=True)]
                right[side][j] = min(max((sum(w for v, w in own if v == vote) + plus) / (sum(w for v, w in own if v != NONE) + of), 0.05), 0.999)
        q = []
        for v, _ in rows:
            good, junk = prior, 1 - prior
            for j, x in enumerate(v):
                if x != NONE:
                    good *= right[1][j] if x == GOOD else 1 - right[1][j]
                    junk *= right[0][j] if x == JUNK else 1 - right[0][j]
            q.append(good / (good + junk))
        done = max(abs(a - b) for a, b in zip(p, q, strict=True)) < 1e-6
        p = q
        if done:
            break
    return p, prior, right


def test_estimate_and_scorer_against_loops(spark):
    rng = np.random.default_rng(2)
    truth = rng.random(400) < 0.7
    votes = np.where(rng.random((400, len(LABELLERS))) < 0.3, NONE, np.where(rng.random((400, len(LABELLERS))) < 0.85, np.where(truth, GOOD, JUNK)[:, None], np.where(truth, JUNK, GOOD)[:, None])).astype(np.int8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = expectation_maximisation(patterns, counts.astype(float))
    p, prior, right = plain_estimate(patterns, counts)
    assert np.allclose(model.posterior(patterns), p, atol=1e-9) and model.prior == pytest.approx(prior) and np.allclose(model.right, right)
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.95

    docs = spark.createDataFrame([(i, latin(random.Random(i)) if i % 3 else "BUY!! " * 60) for i in range(60)] + [(97, None), (98, "")], "doc_id long, text string")
    quality = fit_quality(docs)
    look = WordShapes()
    for r in score_quality(docs, quality).collect():
        places = look.look(r["text"] or "")[1] if "text" in r.asDict() else None
        share = np.bincount(places, minlength=DIMENSIONS) / max(1, len(places))
        z = quality.bias + float((share * quality.weights).sum())
        assert r["quality"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-5) and r["kept"] == int(r["quality"] >= 0.5)
