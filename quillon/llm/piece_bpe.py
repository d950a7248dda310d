"""SentencePiece encoding and decoding by a Viterbi search with shared prefixes.

Texts are cut into marked words (a run of word marks and what follows to the next). The distinct words of a batch are sorted, so they are
the leaves of a trie in depth-first order, and a forward pass runs along it: at each position it holds the best score of the prefix up to
there and where its last piece begins, and a word takes over both for the prefix that it shares with the word before.

The scores are log probabilities of the pieces. A file of the merging kind has ranks in their place, and by Zipf's law a piece's probability
falls as its rank, so there a piece scores minus the logarithm of its rank. Merging itself, which is what the library does with such a file,
is not the path of the highest score sum; under the rule "merges" the forward state is decided by it instead: exactly one piece that ends at
a position can follow the state at its beginning, namely the one whose pair with that state's piece merging leaves as it is. Then ids equal
the library's.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quillon.llm.common import with_text_columns

MODEL, MARK = "piece_bpe_32k.model", "▁"
#: By how much a character that is no piece scores less than the worst piece.
UNKNOWN = 10.0
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceEncoder:
    """Ids by marked word, and texts by ids. At most ``most`` words are remembered between batches.

    ``scores`` gives log probabilities of pieces; without it they come from the file. A character that is no piece is spelled in bytes and
    scores ``UNKNOWN`` less than the worst piece. Of equal paths the one whose last piece is longer wins, at every position.
    """

    def __init__(self, path: str = "", most: int = 200_000, rule: str = "scores", scores: Mapping[str, float] | None = None):
        if rule not in ("scores", "merges"):
            raise ValueError(f"no such rule: {rule}")
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.odd = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in self.odd and not model.is_byte(i)}
        self.rank = {p: -model.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        own = {p: model.get_score(i) for p, i in self.id_of.items()}
        if all(v == int(v) for v in own.values()):  # ranks
            own = {p: -math.log(1 - v) for p, v in own.items()}
        self.score = own if scores is None else dict(scores)
        self.unknown = min(self.score.values()) - UNKNOWN
        # the ends of pieces too, which score nothing: where no piece ends like a stretch, none ends like a longer one
        self.ending = {p[i:]: -math.inf for p in self.score for i in range(1, len(p))} | self.score
        self.walk = self.best_paths if rule == "scores" else self.merge_paths
        self.raw = [b"" if i in self.odd else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.pairs: dict[str, dict[str, bool]] = {}
        self.held = 0
        self.whole: dict[str, bool] = {}  # whether merging makes a piece of these characters
        self.most, self.words = most, {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: again and again the neighbours of the best piece, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            i = int(np.argmin(ranks))
            if ranks[i] == np.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces side by side; the answer is remembered."""
        if self.held > 1_000_000:
            self.pairs.clear()
            self.held = 0
        self.held += 1
        known = self.pairs.setdefault(right, {})[left] = self.merged(left + right) == [left, right]
        return known

    def makes_one(self, piece: str) -> bool:
        known = self.whole[piece] = len(piece) == 1 or (piece in self.id_of and self.merged(piece) == [piece])
        return known

    def best_paths(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of sorted words by the highest sum of scores: best[i] is that of the first i characters, back[i] where their last piece begins; those of a shared prefix are kept."""
        best, back, out, before, longest, ending, unknown = [0.0], [0], [], "", max(map(len, self.score)), self.ending.get, self.unknown
        id_of, nothing = self.id_of.get, -math.inf
        for word in words:
            shared, limit = 0, min(len(word), len(before), len(best) - 1)
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at = end - 1
                s = ending(word[at])
                if s is None:
                    best.append(best[at] + unknown)
                    back.append(at)
                    continue
                top = best[at] + (unknown if s == nothing else s)
                for start in range(at - 1, (end - longest if end > longest else 0) - 1, -1):
                    s = ending(word[start:end])
                    if s is None:
                        break
                    s += best[start]
                    if s >= top:
                        top, at = s, start
                best.append(top)
                back.append(at)
            ids: list[int] = []
            end = len(word)
            while end:
                start = back[end]
                piece = word[start:end]
                own = id_of(piece)
                if own is not None:
                    ids.append(own)
                else:
                    ids += [self.bytes[b] for b in reversed(piece.encode("utf-8", "replace"))]
                end = start
            out.append(ids[::-1])
            before = word
        return out

    def merge_paths(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of sorted words by merging: states[i] is the last piece of the first i characters; those of a shared prefix are kept."""
        states: list[str] = [""]
        out, before, longest, whole, pairs, none = [], "", self.longest, self.whole.get, self.pairs.get, {}
        for word in words:
            shared, limit = 0, min(len(word), len(before), len(states) - 1)
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):
                    piece = word[start:end]
                    one = whole(piece)
                    if one is None:
                        if end - start > 1 and piece not in self.id_of:
                            continue  # not remembered: there are too many of these
                        one = self.makes_one(piece)
                    if one:
                        left = states[start]
                        if not left:
                            states.append(piece)
                            break
                        fit = pairs(piece, none).get(left)
                        if fit or (fit is None and self.fits(left, piece)):
                            states.append(piece)
                            break
            ids: list[int] = []
            end = len(word)
            while end:
                piece = states[end]
                own = self.id_of.get(piece)
                ids += [own] if own is not None else [self.bytes[b] for b in reversed(piece.encode("utf-8", "replace"))]
                end -= len(piece)
            out.append(ids[::-1])
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        cut = [WORD.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        if len(self.words) > self.most:
            self.words.clear()
        new = sorted({w for c in cut for w in c}.difference(self.words))
        for w, ids in zip(new, self.walk(new), strict=True):
            self.words[w] = array("i", ids).tobytes()
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids: control pieces vanish, byte pieces are joined, the first mark is dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str = "", text: str = "text", keep: list[str] | None = None, rule: str = "scores") -> DataFrame:
    """The kept columns and piece_ids (array of int), n_pieces and ids_crc32 of every whole text. One pass, no shuffle.

    Null and empty texts have no pieces; repeated rows get equal ids; kept columns of the new names are replaced; an empty table gives an
    empty one. A mark in the text itself is encoded like a space, as in the library.
    """

    def make() -> Callable[[list[str]], list]:
        encoder = PieceEncoder(path, rule=rule)

        def compute(texts: list[str]) -> list:
            ids = encoder.encode(texts)
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())]

        return compute

    return with_text_columns(docs, make, "piece_ids array<int>, n_pieces bigint, ids_crc32 bigint", text, keep)


def round_trips(docs: DataFrame, path: str = "", text: str = "text", keep: list[str] | None = None, rule: str = "scores") -> DataFrame:
    """The kept columns, n_pieces, ids_crc32 and exact: whether the decoded ids are the text again."""

    def make() -> Callable[[list[str]], list]:
        encoder = PieceEncoder(path, rule=rule)

        def compute(texts: list[str]) -> list:
            ids = encoder.encode(texts)
            exact = [encoder.decode(i.tolist()) == x.replace(MARK, " ") for i, x in zip(ids, texts, strict=True)]
            return [pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(exact, pa.bool_())]

        return compute

    return with_text_columns(docs, make, "n_pieces bigint, ids_crc32 bigint, exact boolean", text, keep)
