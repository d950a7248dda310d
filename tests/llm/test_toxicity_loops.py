"""Toxicity against plain versions: the features of a text, one boosted tree, and the calibration."""

import math
import re

import numpy as np
import pytest

from quillon.llm.toxicity import FEATURES, LEET, NEAR, PREFIXES, SECOND_PERSON, WordFeatures
from quillon.llm.trees import BoostedTrees, isotonic, sigmoid

LEXICON = {"fool": 3.0, "idio*": 2.5, "stink*": 4.0, "ugh": 2.6}


def stripped(word):
    return re.sub(r"^[\W_]+|[\W_]+$", "", word)


def weight(low):
    own = [LEXICON[t] for t in [low, *(low[:n] + "*" for n in PREFIXES if len(low) > n)] if t in LEXICON]
    return max(own, default=0.0)


def plain_features(text):
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, rows = len(words), []
    for w in words:
        low = stripped(w).lower()
        plain = weight(low) if low else 0.0
        hidden = 0.0
        if low and not plain and not low.isalpha():
            hidden = weight(stripped(re.sub(r"[*._-]", "", low.translate(LEET))))
        odd = bool(re.search(r"[^\W\d_][^\w\s'’.,-]+[^\W\d_]", w) or re.search(r"[^\W\d_]\d+[^\W\d_]", w))
        rows.append({"w": w, "hit": max(plain, hidden), "plain": plain > 0, "hidden": hidden > 0, "you": low in SECOND_PERSON, "caps": len(w) > 1 and w.isupper(), "signs": sum(not c.isalnum() for c in w), "odd": odd, "run": bool(re.search(r"(\w)\1\1", low))})
    hits, you = [i for i, r in enumerate(rows) if r["hit"]], [i for i, r in enumerate(rows) if r["you"]]
    gaps = [min(abs(i - j) for j in you) for i in hits] if you else []
    total = lambda k: sum(r[k] for r in rows) / n
    return [
        math.log1p(n), len(hits) / n, total("hit"), float(bool(hits)), max(r["hit"] for r in rows), total("plain"), sum(g <= NEAR for g in gaps) / n, 1 / (1 + min(gaps)) if gaps else 0.0, total("you"), total("caps"),
        sum("!" in w for w in words) / n, sum("?" in w for w in words) / n, total("signs"), total("odd"), total("run"), sum(map(len, words)) / n, float(len({rows[i]["w"] for i in hits})),
    ]


TEXTS = ["", "plain words here", "You FOOL! you idiots, st1nker", "f.o.o.l and st!nky and 1d10t for YOU?", "soooo ugh " * 30 + "you", "é ñ «fool» a1b c'est l’eau x-y", "du fool " + "w " * 40 + "fool", "!!! ??? ...", "fool", "ten you ten fool"]


def test_features_against_loops():
    look = WordFeatures(LEXICON)
    for _ in range(2):  # words known and new
        for t in TEXTS:
            assert look.features(t).tolist() == pytest.approx(plain_features(t), rel=1e-5), t
    look.most = 3  # the table of words starts anew, again and again
    assert look.matrix(TEXTS * 3).tolist() == [pytest.approx(plain_features(t), rel=1e-5) for t in TEXTS * 3]


def plain_stump(x, y, rate, ridge, least, bins):
    """The best first split by trying every cut of every feature, and its two leaves."""
    p = y.mean()
    base = math.log(p / (1 - p))
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(np.append(np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])), 0.0)):
            right = x[:, f] > cut
            if right.sum() < least or (~right).sum() < least:
                continue
            side = lambda m: ((p - y[m]).sum(), p * (1 - p) * m.sum())
            (gl, hl), (gr, hr) = side(~right), side(right)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut, -rate * gl / (hl + ridge), -rate * gr / (hr + ridge))
    return base, best


def test_one_tree_against_every_split():
    rng = np.random.default_rng(8)
    for _ in range(5):
        x = np.round(rng.random((300, 4)), 2)
        y = (x[:, 1] + 0.3 * rng.standard_normal(300) > 0.6).astype(float)
        model = BoostedTrees(trees=1, depth=1).fit(x, y, np.ones(300))
        base, (_, f, cut, low, high) = plain_stump(x, y, model.rate, model.ridge, model.least, model.bins)
        want = base + np.where(x[:, f] > cut, high, low)
        assert np.allclose(model.raw(x), want)
        assert np.allclose(sigmoid(model.raw(x)), 1 / (1 + np.exp(-want)))


def test_calibration_against_pooling_by_hand():
    rng = np.random.default_rng(9)
    for _ in range(20):
        raw, y = np.sort(rng.choice(50, 30, False)).astype(float), rng.integers(0, 2, 30).astype(float)
        x, fit = isotonic(raw, y, np.ones(30))
        blocks = [[v, 1] for v in y]
        i = 0
        while i + 1 < len(blocks):  # pool neighbours that fall, and look back
            if blocks[i][0] > blocks[i + 1][0] + 1e-12:
                (a, n), (b, m) = blocks[i], blocks.pop(i + 1)
                blocks[i] = [(a * n + b * m) / (n + m), n + m]
                i = max(0, i - 1)
            else:
                i += 1
        want = [v for v, n in blocks for _ in range(n)]
        assert np.interp(raw, x, fit) == pytest.approx(want, abs=1e-9)
