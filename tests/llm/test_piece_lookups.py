"""The piece search looks up fewer stretches and finds the same paths."""

import math
import random

import numpy as np

from quillon.llm.piece_bpe import PieceEncoder

POOL = list("abzABZ019.!?,;:'\"()-_#@$%…。！？»«ⅷⅧⒶé́ÉßǅΣσ中文字กาะ้日ゟ한ـعा१²½")


class Counted(dict):
    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def plain(encoder, word):
    """The best path by every stretch that is a piece, in loops."""
    best, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, at = best[end - 1] + encoder.score.get(word[end - 1], encoder.unknown), end - 1
        for start in range(end - 2, -1, -1):
            s = encoder.score.get(word[start:end])
            if s is not None and best[start] + s >= top:
                top, at = best[start] + s, start
        best.append(top)
        back.append(at)
    ids, end = [], len(word)
    while end:
        piece = word[back[end] : end]
        ids = ([encoder.id_of[piece]] if piece in encoder.id_of else [encoder.bytes[b] for b in piece.encode()]) + ids
        end = back[end]
    return ids


def test_stretches_that_end_no_piece_are_not_looked_up():
    encoder = PieceEncoder()
    r = random.Random(2)
    words = sorted({"▁" * r.randint(0, 2) + "".join(r.choice(POOL + list("etaoinshr") * 6) for _ in range(r.randint(1, 25))) for _ in range(1500)} | {"ก" * 40, "▁the", "q" * 30})
    encoder.ending = Counted(encoder.ending)
    assert encoder.walk(words) == [plain(encoder, w) for w in words]
    encoder.ending.asked = 0
    encoder.walk(["ก" * 400])
    assert encoder.ending.asked <= 800  # 400 characters by up to 16 stretches each before
    assert all(v > -math.inf for v in encoder.score.values())
    assert np.array_equal(np.concatenate(encoder.encode(["the  thing", ""])), np.concatenate([x for w in ("▁the", "▁▁thing") for x in [encoder.walk([w])[0]]]))
