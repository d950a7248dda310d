"""Words of one class are judged once, and as each would be alone."""

import random
import zlib

from quillon.llm.quality import CLASSES, LONG_WORD, RUN, SIGNS, UNSPACED, WordShapes

POOL = list("abzABZ019.!?,;:'\"()-_#@$%…。！？»«ⅷⅧⒶé́ÉßǅΣσ中文字กาะ้日ゟ한ـعा१²½")


def test_words_of_a_class_are_judged_once_and_alike():
    r = random.Random(1)
    words = sorted({"".join(r.choice(POOL) for _ in range(r.randint(1, 30))) for _ in range(3000)} | {f"w{i}" for i in range(10_000, 14_000)} | {"!!", "A!!", "x" * 25, "x" * 24})
    shapes = WordShapes()
    rows = shapes.rows(words)
    kinds = shapes.kinds[rows]
    for w, k in zip(words, kinds.tolist(), strict=True):
        c = w.translate(CLASSES)
        n = c.count("x") + c.count("X")
        want = [n > 1 and w.isupper(), n > 0 and bool(SIGNS.search(w)), n == 0 and "9" not in c, n, len(w), w[-1] in ".!?…。！？"]
        assert shapes.counts[k].tolist() == [float(x) for x in want], w
        assert shapes.shapes[k] == zlib.crc32(RUN.sub(r"\1", c).encode("utf-8", "replace"))
        assert shapes.unusual[k] == (len(w) > LONG_WORD or (not w.isascii() and bool(UNSPACED.search(w))))
    assert len(set(kinds[[i for i, w in enumerate(words) if w[0] == "w"]].tolist())) == 1
