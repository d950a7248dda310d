"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

Labels are read from a bounded sample; every document is scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, doc_groups, with_text_columns, written
from quillon.llm.trees import BoostedTrees, isotonic, sigmoid

#: Bounds of the labelled sample that a model is fitted on.
MOST_TOXIC, MOST_CLEAN = 4000, 8000
LEXICON_SIZE, PREFIXES, LEAST_DOCS, LEAST_LOG_ODDS = 400, (4, 5), 3, 2.5
THRESHOLD = 0.3
#: Words that address a reader, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oleastasil")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INNER_SIGN, INNER_DIGIT, RUN = re.compile(r"[^\W\d_][^\w\s'’.,-]+[^\W\d_]"), re.compile(r"[^\W\d_]\d+[^\W\d_]"), re.compile(r"(\w)\1\1")
NEAR = 5
FEATURES = ("log_words", "lexicon", "weight", "any", "most", "plain", "near", "nearest", "second", "caps", "shout", "question", "signs", "digits", "runs", "length", "distinct_hits")


def terms_of(word: str) -> list[str]:
    """What the lexicon can hold of a bare lower-case word: itself and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def bare(word: str) -> str:
    return EDGES.sub("", word).lower()


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Callable[[Column], Column], most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most so many labelled documents of either kind, by hash order of the id, and how many labels there are of each.

    Equal texts are one row, toxic if any of them is.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & use(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    part = lambda t, n: rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(part(1, most_toxic).unionByName(part(0, most_clean)))  # bounded by the two limits
    return written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "toxic-sample"), total


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings of words that mark toxic texts, with their log odds; only the ``LEXICON_SIZE`` best reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = (Counter(), Counter()), [0, 0]
        for batch, texts in doc_groups(batches):
            for toxic, x in zip(batch.column(0).to_pylist(), texts, strict=True):
                n[toxic] += 1
                seen[toxic].update({t for w in {bare(w) for w in x.split()} if w for t in terms_of(w)})
        terms = [t for t in {*seen[0], *seen[1]} if len(t) > 1]
        yield pa.RecordBatch.from_arrays([pa.array(["", *terms], pa.string()), pa.array([n[1], *(seen[1][t] for t in terms)], pa.int64()), pa.array([n[0], *(seen[0][t] for t in terms)], pa.int64())], names=["term", "toxic", "clean"])

    counts = written(sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= LEAST_DOCS) | (F.col("term") == "")), "toxic-terms")
    total = counts.where(F.col("term") == "").first()
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    best = counts.where(F.col("term") != "").withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS).orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(LEXICON_SIZE)
    return {r["term"]: r["odds"] for r in best.collect()}


class WordFeatures:
    """Per word the numbers that a text's features are sums of; distinct words are looked at once."""

    most = 100_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.index, self.used = lexicon, {}, 0
        self.table = np.zeros((1 << 12, 11), np.float32)

    def weight(self, word: str) -> float:
        return max((self.lexicon[t] for t in terms_of(word) if t in self.lexicon), default=0.0)

    def add(self, word: str) -> int:
        low = bare(word)
        plain = self.weight(low) if low else 0.0
        hidden = self.weight(EDGES.sub("", re.sub(r"[*._-]", "", low.translate(LEET)))) if low and not plain and not low.isalpha() else 0.0
        k = self.used
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        signs = sum(not c.isalnum() for c in word)
        self.table[k] = (max(plain, hidden), plain > 0, hidden > 0, low in SECOND_PERSON, len(word) > 1 and word.isupper(), "!" in word, "?" in word, signs, bool(INNER_SIGN.search(word) or INNER_DIGIT.search(word)), bool(RUN.search(low)), len(word))
        self.index[word] = k
        self.used += 1
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        if self.used > self.most:
            self.index, self.used = {}, 0
        get, add = self.index.get, self.add
        for w in set(words).difference(self.index):
            add(w)
        return np.fromiter(map(get, words), np.int64, len(words))

    def features(self, text: str) -> np.ndarray:
        words = text.split()
        n = len(words)
        out = np.zeros(len(FEATURES))
        if not n:
            return out
        at = self.rows(words)
        own = self.table[at]
        sums = own.sum(0, dtype=np.float64)
        hit = np.flatnonzero(own[:, 0])
        you = np.flatnonzero(own[:, 3])
        near, nearest = 0, 0.0
        if len(hit) and len(you):
            k = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(hit - you[np.minimum(k, len(you) - 1)]), np.abs(hit - you[np.maximum(k - 1, 0)]))
            near, nearest = int((gap <= NEAR).sum()), 1 / (1 + float(gap.min()))
        out[:] = (math.log1p(n), len(hit) / n, sums[0] / n, len(hit) > 0, own[:, 0].max(), sums[1] / n, near / n, nearest, sums[3] / n, sums[4] / n, sums[5] / n, sums[6] / n, sums[7] / n, sums[8] / n, sums[9] / n, sums[10] / n, len(np.unique(at[hit])))
        return out

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.features(x) for x in texts]) if texts else np.zeros((0, len(FEATURES)))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a hundredth of the uncalibrated one breaks the ties of the isotonic steps."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 * sigmoid(raw), 0, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Callable[[Column], Column] = lambda i: F.lit(True), folds: int = 4, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> ToxicityModel:
    """A model from the labels that ``use`` admits. Only (toxic, text) of a bounded sample is read, and its features, some numbers a text, reach the driver.

    Calibration is fitted on scores of trees that have not seen the rows, with the weights of the whole label table. With labels of one
    kind or none the score is constant: the share of toxic labels, smoothed by one more label that is toxic by a twentieth.
    """
    sample, total = labelled_sample(docs, labels, use, most_toxic, most_clean)
    prior = (total.get(1, 0) + 0.05) / (sum(total.values()) + 1)
    if not (total.get(0) and total.get(1)):
        return ToxicityModel({}, None, (np.zeros(1), np.zeros(1)), prior)
    lexicon = learned_lexicon(sample)
    rows = with_text_columns(sample, lambda: lambda texts, w=WordFeatures(lexicon): [pa.array(list(w.matrix(texts)), pa.list_(pa.float64()))], "features array<double>", keep=["toxic"]).collect()
    if len({r["toxic"] for r in rows}) < 2:
        return ToxicityModel({}, None, (np.zeros(1), np.zeros(1)), prior)
    rows.sort(key=lambda r: (r["toxic"], r["features"]))
    x, y = np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    share = np.where(y == 1, total[1] / y.sum(), total[0] / (1 - y).sum())
    weight = share / share.mean()
    fold, apart = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        apart[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k], weight[fold != k]).raw(x[fold == k])
    return ToxicityModel(lexicon, BoostedTrees().fit(x, y, weight), isotonic(apart, y, weight), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of ``docs`` with score (0 to 1) and predicted (1 where it reaches the threshold), for every whole text.

    Null and empty texts have zero features and get the model's score of those. Long texts are read whole, repeated rows score alike,
    kept columns named score or predicted are replaced, and an empty table gives an empty one.
    """

    def make() -> Callable[[list[str]], list]:
        words = WordFeatures(model.lexicon)

        def compute(texts: list[str]) -> list:
            s = model.scores(words.matrix(texts))
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

        return compute

    return with_text_columns(docs, make, "score double, predicted int", text, keep)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))
