"""Quality classifier by weak labels: overlapping heuristic labellers, expectation-maximisation of their accuracies, and a hashed linear scorer.

No gold label is read. The vote patterns of all documents are counted, so the estimate covers the whole corpus; the scorer learns the
posteriors on a bounded sample and scores every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import doc_groups, hash_sample, with_text_columns

#: Bound of the sample that the linear scorer is fitted on.
SAMPLE_DOCS = 4000
DIMENSIONS, THRESHOLD = 4096, 0.5
GOOD, JUNK, NONE = 1, -1, 0
#: Words of a window in which distinct ones are counted.
SPAN = 400
LABELLERS = ("adjacent repeats", "distinct words", "capitals", "trailing signs", "delimiters", "letters", "sentence ends", "word length", "repeated lines")
#: A run between white space that is longer is cut into pieces; one that is much longer is no word of any spaced script.
LONG_WORD, LONG_RUN = 24, 40
#: Pieces of a long run, and how far the next one begins.
PIECE, STEP = 12, 6
#: Scripts written without spaces, in pieces of two and of three characters; their signs.
PAIRED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TRIPLED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff"
WIDE_SIGNS = "\u3000-\u303f\uff01-\uff0f\uff1a-\uff20"
UNSPACED = re.compile(f"[{PAIRED}{TRIPLED}]")
SEGMENT = re.compile(rf"([{PAIRED}]+)|([{TRIPLED}]+)|[{WIDE_SIGNS}]|[^{PAIRED}{TRIPLED}{WIDE_SIGNS}]+")
TRIPLES = re.compile(f"[{TRIPLED}]+")
#: How far back a piece of a run is looked for.
LAGS = 8
RUN = re.compile(r"(.)\1+")
SIGNS = re.compile(r"[^\w\s.,;:?'\"()»«…-]$|!!$")


class Classes(dict):
    """For each character met so far what stands for it: letters by case, digits as 9, others as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if is_letter(c) else "9" if c.isdigit() else c
        return out


def is_letter(c: str) -> bool:
    """Letters, and the vowel signs and tone marks of scripts that write them as marks."""
    return c.isalpha() or (c > "\x7f" and unicodedata.category(c)[0] == "M")


CLASSES = Classes()


def shape(word: str) -> str:
    """Letters by case, digits as 9, signs as they are; runs are one."""
    return RUN.sub(r"\1", word.translate(CLASSES))


def words_of(text: str) -> tuple[list[str], np.ndarray, int]:
    """(words, which of them are pieces of a run, characters in long runs).

    Words lie between white space. A run that holds a script without spaces, or is longer than a word, is cut where the script changes; a
    stretch of such a script becomes overlapping pieces of two or three characters, any other long stretch pieces of ``PIECE``.
    """
    return cut_words(text.split())


def cut_words(words: list[str]) -> tuple[list[str], np.ndarray, int]:
    out, cut, long = [], [], 0
    for word in words:
        if len(word) <= LONG_WORD and (word.isascii() or not UNSPACED.search(word)):
            out.append(word)
            cut.append(False)
            continue
        for m in SEGMENT.finditer(word):
            s, size = m[0], 2 if m[1] else 3 if m[2] else PIECE
            step = 1 if size < PIECE else STEP
            whole = len(s) <= (size if size < PIECE else LONG_WORD)
            pieces = [s] if whole else [s[i : i + size] for i in range(0, len(s) - size + step, step)]
            out += pieces
            cut += [size < PIECE or not whole] * len(pieces)
            long += len(s) if size == PIECE and len(s) > LONG_RUN else 0
    return out, np.array(cut, bool), long


def distinct_share(at: np.ndarray) -> float:
    """The share of distinct words within consecutive windows of ``SPAN`` words, over all words of the text."""
    return sum(len(np.unique(at[i : i + SPAN])) for i in range(0, len(at), SPAN)) / len(at)


class WordShapes:
    """Per distinct word its class (letters by case, digits as 9, signs as they are), and per class its shape's hash, some counts, and whether the word is to be cut."""

    most = 200_000

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.classes: dict[str | tuple, int] = {}
        self.kinds = np.zeros(1 << 12, np.int64)
        self.shapes, self.counts, self.unusual = np.zeros(1 << 10, np.int64), np.zeros((1 << 10, 6), np.float32), np.zeros(1 << 10, bool)

    def kind(self, word: str) -> int:
        """The row of a word's class. Of an ASCII word the class says all; of others some facts are the word's own."""
        c = word.translate(CLASSES)
        if word.isascii():
            key, upper, sign, wide = c, "x" not in c and c.isupper(), bool(SIGNS.search(c)), False
        else:
            key = c, upper, sign, wide = c, word.isupper(), bool(SIGNS.search(word)), bool(UNSPACED.search(word))
        k = self.classes.get(key)
        if k is None:
            self.classes[key] = k = len(self.classes)
            if k == len(self.shapes):
                self.shapes, self.counts, self.unusual = (np.concatenate([x, np.zeros_like(x)]) for x in (self.shapes, self.counts, self.unusual))
            n = c.count("x") + c.count("X")
            self.shapes[k] = zlib.crc32(RUN.sub(r"\1", c).encode("utf-8", "replace"))
            self.counts[k] = n > 1 and upper, n > 0 and sign, n == 0 and "9" not in c, n, len(c), c[-1] in ".!?…。！？"
            self.unusual[k] = len(c) > LONG_WORD or wide
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.index.clear()
            self.classes.clear()
        new = list(set(words).difference(self.index))
        if new:
            k = len(self.index)
            while k + len(new) > len(self.kinds):
                self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.index.update(zip(new, range(k, k + len(new)), strict=True))
            classes, own = self.classes.get, []
            for w in new:
                at = classes(w.translate(CLASSES)) if w.isascii() else None
                own.append(self.kind(w) if at is None else at)
            self.kinds[k : k + len(new)] = own
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def look(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The labellers' votes, and the hashed features (places, one a word) of a text."""
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(len(LABELLERS), np.int8), np.zeros(0, np.int64)
        at, cut, long, size = self.rows(words), None, 0, sum(map(len, words))
        kinds = self.kinds[at]
        if self.unusual[kinds].any():
            words, cut, long = cut_words(words)
            n, at = len(words), self.rows(words)
            kinds = self.kinds[at]
        again = np.concatenate([[False], at[1:] == at[:-1]])
        if cut is not None and cut.any():  # a word that is written again and again comes back some pieces later
            for lag in range(2, LAGS + 1):
                again[lag:] |= cut[lag:] & (at[lag:] == at[:-lag])
        caps, signs, delimiters, letters, chars, ends = self.counts[kinds].sum(0, dtype=np.float64)
        distinct = distinct_share(at)
        runs = long / max(1, size)
        spoken = runs <= 0.3  # of mere runs the pieces are no words to be judged
        ended = cut is None or len("".join(TRIPLES.findall(text))) <= 0.5 * size  # scripts that end no sentence by a sign
        lines = [x for x in text.split("\n") if x.strip()]
        twice = 1 - len(set(lines)) / max(1, len(lines))

        def vote(value: float, junk: bool, good: bool, enough: bool) -> int:
            return NONE if not enough else JUNK if junk else GOOD if good else NONE

        repeats = again.mean()
        votes = (
            vote(repeats, repeats > 0.3, repeats < 0.1, n >= 8 and spoken),
            vote(distinct, distinct < 0.2, distinct > 0.4, n >= 8 and spoken),
            vote(caps, caps > 0.5 * n, caps < 0.2 * n, n >= 4 and spoken),
            vote(signs, signs > 0.3 * n, signs < 0.08 * n, n >= 4 and spoken),
            vote(delimiters, delimiters > 0.25 * n, delimiters < 0.1 * n, n >= 4 and spoken),
            vote(letters, letters < 0.6 * chars, letters > 0.8 * chars, chars >= 12 and spoken),
            vote(ends, ends < 0.01 * n, ends > 0.03 * n, n >= 40 and ended),
            vote(chars, runs > 0.3 or not 1.5 * n <= chars <= 20 * n, 2.5 * n <= chars <= 12 * n, n >= 4 or runs > 0.3),
            vote(twice, twice > 0.5, twice < 0.2, len(lines) >= 4),
        )
        s = self.shapes[kinds]
        before = np.concatenate([[0], s[:-1]])
        return np.array(votes, np.int8), (s * 31 + before * 17 + again * 7919) % DIMENSIONS


def pattern_of(votes: np.ndarray) -> int:
    out = 0
    for v in votes.tolist():
        out = 3 * out + v + 1
    return out


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**i % 3 - 1 for i in range(len(LABELLERS) - 1, -1, -1)], 1)


@dataclass
class LabelModel:
    """prior: share of good texts; right[c, j]: how often labeller j, when it votes, is right on texts of class c (0 junk, 1 good)."""

    prior: float
    right: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        good = np.where(votes == GOOD, np.log(self.right[1]), np.where(votes == JUNK, np.log(1 - self.right[1]), 0)).sum(1) + np.log(self.prior)
        junk = np.where(votes == JUNK, np.log(self.right[0]), np.where(votes == GOOD, np.log(1 - self.right[0]), 0)).sum(1) + np.log(1 - self.prior)
        return 1 / (1 + np.exp(np.clip(junk - good, -500, 500)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Accuracies and prior from vote patterns and how often each occurs, starting from any junk vote against two good ones."""
    p = 1 / (1 + np.exp(-(1.0 + 0.5 * (votes == GOOD).sum(1) - 3.0 * (votes == JUNK).sum(1))))
    model = LabelModel(0.5, np.full((2, votes.shape[1]), 0.7))
    for _ in range(rounds):
        good, junk = (counts * p)[:, None], (counts * (1 - p))[:, None]
        right = np.stack([((votes == JUNK) * junk).sum(0) + 2, ((votes == GOOD) * good).sum(0) + 9]) / np.stack([((votes != NONE) * junk).sum(0) + 4, ((votes != NONE) * good).sum(0) + 10])
        new = LabelModel(float(np.clip((good.sum() + 1) / (counts.sum() + 2), 0.02, 0.98)), np.clip(right, 0.05, 0.999))
        q = new.posterior(votes)
        done = np.abs(q - p).max() < 1e-6 if len(p) else True
        model, p = new, q
        if done:
            break
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray) -> float:
        """Probability of good text; a text without words has the bias alone."""
        z = self.bias + (float(self.weights[places].mean()) if len(places) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, steps: int = 300, rate: float = 0.4, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on shares of hashed features, a row a text, and soft targets, by Adam on all rows."""
    x = np.stack(rows)
    w, b = np.zeros(DIMENSIONS + 1, np.float32), float(np.log(target.mean() / (1 - target.mean())))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        e = ((p - target) / len(target)).astype(np.float32)
        g = np.append(x.T @ e + np.float32(ridge) * w[:-1], e.sum()).astype(np.float32)
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        w -= np.float32(rate * (1 - 0.9 * t / steps)) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-9))
    return w[:-1], float(w[-1])


def fit_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """The label model from all documents' votes (at most 3 ** 9 patterns reach the driver), the scorer from a bounded sample in one task."""
    votes = with_text_columns(docs, lambda: lambda texts, w=WordShapes(): [pa.array([pattern_of(w.look(x)[0]) for x in texts], pa.int32())], "pattern int", text, keep=[])
    found = votes.groupBy("pattern").count().orderBy("pattern").collect()
    patterns, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["count"] for r in found], float)
    if not len(found):
        return QualityModel(LabelModel(0.5, np.full((2, len(LABELLERS)), 0.7)), np.zeros(DIMENSIONS, np.float32), 1.0)
    labels = expectation_maximisation(votes_of(patterns), counts)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, target = WordShapes(), [], []
        for _, texts in doc_groups(batches):
            for x in texts:
                v, places = words.look(x)
                if len(places):
                    rows.append((np.bincount(places, minlength=DIMENSIONS) / len(places)).astype(np.float32))
                    target.append(float(labels.posterior(v[None])[0]))
        weights, bias = fit_linear(rows, np.clip(np.array(target), 0.001, 0.999)) if rows else (np.zeros(DIMENSIONS, np.float32), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights, bias))], pa.binary())], names=["model"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    chosen = hash_sample(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text")), sample_docs, int(counts.sum()), "doc_id", "text").select("text")
    weights, bias = pickle.loads(chosen.coalesce(1).mapInArrow(fit, "model binary").first()["model"])
    return QualityModel(labels, weights, bias)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns and quality (score from 0 to 1), posterior (the label model's, of the votes alone) and kept (1 where the score reaches the threshold).

    Null and empty texts get no votes and the scorer's bias; long texts are read whole; repeated rows score alike; kept columns of the new
    names are replaced; an empty table gives an empty one.
    """

    def make() -> Callable[[list[str]], list]:
        words = WordShapes()

        def compute(texts: list[str]) -> list:
            seen = [words.look(x) for x in texts]
            scores = np.array([model.score(places) for _, places in seen])
            posterior = model.labels.posterior(np.stack([v for v, _ in seen])) if seen else np.zeros(0)
            return [pa.array(scores, pa.float64()), pa.array(posterior, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]

        return compute

    return with_text_columns(docs, make, "quality double, posterior double, kept int", text, keep)
