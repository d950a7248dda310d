import random
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import ngram_join
from quillon.llm.common import WordHashes, shingle_sets
from quillon.llm.components import components
from quillon.llm.ngram_join import ngram_components, signatures, without_near_copies

DOCS = "doc_id long, text string, component_id string"


def brute(rows, n=5, percent=75):
    def grams(t):
        w = [x.lower() for x in (t or "").encode().split()]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in g]
    return sorted(out, key=str)


def corpus(seed, size):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, texts = make(40), []
    for _ in range(size):
        texts.append(make(r.choice([1, 3, 5, 6, 8, 12, 30, 80])))
        for _ in range(r.choice([0, 0, 1, 3])):
            w = list(texts[-1])
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(w)
        if r.random() < 0.4:
            texts.append(make(r.choice([0, 2, 8])) + passage + make(r.choice([0, 2, 8])))
    return [(i, r.choice([" ", "\n", "\t "]).join(w), "x") for i, w in enumerate(texts)]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 24), (2, 2)])
def test_components_against_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", 5 * seed)
    rows = corpus(seed, 60)
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "  \n ", "x"), (9003, "a B", "x"), (9004, "A b", "x"), rows[0], (None, rows[1][1], "x"), (None, "alone without an id", None), (9005, "long " * 3000 + "text", "x")]
    got = ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_many_near_copies_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    r = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(90)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "x"))
    rows += [(1000 + i, " ".join([*base[:60], *(f"o{r.randrange(10**6)}" for _ in range(60))]), "x") for i in range(60)]
    got = ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    kept = without_near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted({x[2] for x in brute(rows)})


def test_an_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        pool = rng.integers(0, 2**63, 3 * n + 8).astype(np.uint64)
        x = np.unique(pool[:n])
        y = x[rng.random(len(x)) < rng.uniform(0.75, 1)]
        y = np.unique(np.concatenate([y, pool[n : n + int(rng.integers(0, max(1, n // 6) + 1))]]))
        both = len(np.intersect1d(x, y))
        frequent = np.sort(pool[rng.random(len(pool)) < rng.choice([0, 0.3, 0.8, 0.95, 1])])
        if 100 * both >= 75 * (len(x) + len(y) - both):
            assert len(np.intersect1d(signatures(x, frequent), signatures(y, frequent)))


@pytest.mark.parametrize("seed", range(10))
def test_bitmaps_never_overstate_what_is_missing(seed):
    rng = np.random.default_rng(seed)
    for _ in range(50):
        pool = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
        x, y = pool[rng.random(len(pool)) < rng.random()], pool[rng.random(len(pool)) < rng.random()]
        if len(x) and len(y):
            a, b = ngram_join.least_missing(ngram_join.bitmap_of(x), ngram_join.bitmap_of(y))
            assert a <= len(np.setdiff1d(x, y)) and b <= len(np.setdiff1d(y, x))


def test_shingles_of_short_and_spaced_texts():
    texts = ["", "one two", "A b\tC d\x0be f", "a  B c D\ne F ", "a b c d e f", "a b c d e", " \n ", "é É x", "one two", "x" * 70000 + " y"]
    sets = shingle_sets(texts, WordHashes())
    assert [len(s) for s in sets] == [0, 1, 2, 2, 2, 1, 0, 1, 1, 1]
    assert (sets[2] == sets[3]).all() and (sets[2] == sets[4]).all() and sets[1] == sets[8]
    many = [f"w{i}" for i in range(50000)]
    words, counts = WordHashes()([" ".join(many).encode(), b"", b"w7"])
    assert len(set(words.tolist())) == 50000 and counts.tolist() == [50000, 0, 1] and words[7] == words[-1]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 300)] + [(500, 500), (501, 500), (500, 501)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 300)) and got[501] == 500 == got[500]


def test_blocks_give_every_possible_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [pool[rng.random(len(pool)) < 0.9] for _ in range(20)] + [pool[:30][rng.random(30) < 0.95] for _ in range(9)]
    bits = [bytearray(ngram_join.bitmap_of(s)) for s in sets]
    rows = [(1, i % 2, i, i % 25) for i in range(29)] + [(1, 1 - i % 2, i, i % 25) for i in range(29)] + [(2, 0, i, i) for i in range(4)]
    nodes = spark.createDataFrame([(i, len(s), len(s), b, b) for i, (s, b) in enumerate(zip(sets, bits, strict=True))], "k long, n long, f long, whole binary, common binary")
    got = [tuple(r) for r in ngram_join._apart(spark.createDataFrame(rows, "hub long, kind int, k long, root long"), nodes, 75).collect()]
    assert len(got) == len(set(got)) and all(a < b and a % 25 != b % 25 for a, b in got)
    for i in range(29):
        for j in range(i + 1, 29):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and i % 25 != j % 25:
                assert (i, j) in got


def test_frequent_tokens_bound_those_who_share_pairs_only(spark, monkeypatch):
    """Documents of one passage and own words, which link or not by how many own words they have."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    r = random.Random(8)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join([*passage, *(f"o{r.randrange(10**9)}" for _ in range(i % 40))]), "x") for i in range(120)]
    rows += [(500 + i, " ".join([*(f"z{r.randrange(10**9)}" for _ in range(i)), *passage[i // 2 :]]), "x") for i in range(40)]
    got = ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_clashing_names_and_integer_ids(spark):
    rows = [(1, "a b c d e f g", 1, 2, "k"), (2, "a b c d e f g", 3, 4, "m"), (None, "a b c d e f g", 5, 6, None), (3, None, 7, 8, "n")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, gone int, may int, _may string")
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
