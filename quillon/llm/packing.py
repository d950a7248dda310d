"""Best-fit packing: documents' subword ids cut into pieces and packed into fixed-length sequences by bin completion.

Only the histogram of piece lengths (one count for each length up to the capacity) reaches the driver. Bin completion works on it, so a
plan covers any number of pieces; the pieces then look up their places in parallel by length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import doc_groups, written
from quillon.llm.subword import ByteBpe

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ranks within a length are counted in so many parts, so that no length meets in one task.
RANK_PARTS = 256
#: Bounds of the search, the same for any number of pieces: fillings of a branch, steps to find them, branches after the first leaf.
FILLINGS, STEPS, NODES = 4, 400, 1500
#: Steps of the fractional packing at most; its bound holds wherever it ends.
PIVOTS = 4000
#: Share of sequences above the first bound that is not worth a fractional packing.
TOLERANCE = 1e-3


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids. Only the first piece may be shorter than the capacity."""
    first = (total - 1) % capacity + 1 if total else 0
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))] if total else []


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "", ranks: str = "", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, by their whole texts; null text is empty, so each document has its end id at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer, ranks)
        for batch, texts in doc_groups(batches):
            ids, rows = batch.column(0).to_pylist(), []
            for i, x in zip(ids, texts, strict=True):
                tokens = np.append(bpe.ids(x), np.uint32(END_ID)).astype("<u4")
                raw = memoryview(tokens).cast("B")
                rows += [(i, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(tokens), capacity))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, PIECES)


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each filled with the same lengths: (length, count) from the longest down."""

    times: int
    filling: tuple[tuple[int, int], ...]


def fillings(counts: np.ndarray, room: int, most: int = FILLINGS, steps: int = STEPS) -> list[tuple[tuple[int, int], ...]]:
    """Undominated ways to fill ``room`` from the counted lengths, least waste first and then longest pieces first: (length, count) pairs.

    A filling is maximal, and it is dominated if one or two of its pieces can give way to one longer piece that is left over and still fits.
    A step decides how many pieces of one length go in. The search ends after so many steps or at the first ``most`` fillings without waste.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1] if x]
    below = [-x for x in lengths]
    found: dict[tuple[tuple[int, int], ...], int] = {}
    stack: list[tuple[int, tuple[tuple[int, int], ...], int]] = [(0, (), room)]
    perfect = taken = 0
    while stack and perfect < most and taken < steps:
        k, chosen, rest = stack.pop()
        taken += 1
        k = max(k, bisect_left(below, -rest))
        if k < len(lengths):
            x = lengths[k]
            for n in range(min(int(counts[x]), rest // x) + 1):  # the most pieces are tried first
                stack.append((k + 1, (*chosen, (x, n)) if n else chosen, rest - n * x))
            continue
        used = dict(chosen)
        if chosen not in found and not any(counts[x] > used.get(x, 0) for x in lengths[bisect_left(below, -rest) :]):
            found[chosen] = rest
            perfect += not rest

    def dominated(chosen: tuple[tuple[int, int], ...], waste: int) -> bool:
        own = dict(chosen)
        spare = np.array([x for x in lengths if counts[x] > own.get(x, 0)])
        sums = {x for x in own} | {a + b for a in own for b in own if a < b} | {2 * a for a, n in chosen if n > 1}
        return bool(waste and len(spare)) and any(((spare > s) & (spare <= s + waste)).any() for s in sums)

    kept = [(w, c) for c, w in found.items() if not dominated(c, w)] or [(w, c) for c, w in found.items()]
    return [c for _, c in sorted(kept, key=lambda x: (x[0], [(-a, -n) for a, n in x[1]]))[:most]] or [()]


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: by total length, and by pieces of which no two fit together with what the shorter ones must add, for every least length of those."""
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    big, middle = n[capacity] - n[capacity - k], n[capacity - k] - n[half]
    free = capacity * middle - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0) - free
    return int(max(-(-total[capacity] // capacity), (big + middle + np.maximum(0, -(-small // capacity))).max()))


def richest(counts: np.ndarray, room: int, price: np.ndarray) -> tuple[tuple[int, int], ...]:
    """A filling of ``room`` of high worth: the longest pieces first among those of the most worth for their length, as (length, count) pairs, maximal."""
    own: dict[int, int] = {}
    lengths = np.flatnonzero(counts[: room + 1])[::-1]
    for x in lengths[np.argsort(-(price[lengths] / np.maximum(lengths, 1)), kind="stable")]:
        n = min(int(counts[x]), room // int(x))
        if n:
            own[int(x)] = n
            room -= n * int(x)
    return tuple(sorted(own.items(), reverse=True))


class Relaxation:
    """Fractional sequences for counted lengths: the linear program over all fillings, solved by making fillings as they are needed.

    ``price`` says what a piece of each length is worth at most, in sequences, so that no filling is worth more than one; any such prices
    bound the number of sequences from below. ``columns`` are the fillings in use, ``amounts`` how often. A basis of at most ``capacity``
    lengths is all there is, whatever the number of pieces.
    """

    def __init__(self, counts: np.ndarray, capacity: int, pivots: int = PIVOTS, gap: float = 2e-4) -> None:
        self.lengths = np.flatnonzero(counts)
        self.demand = counts[self.lengths].astype(float)
        m, fits = len(self.lengths), capacity // self.lengths
        self.columns = np.diag(fits).astype(np.int64)  # column j is the j-th filling
        self.amounts, inverse = self.demand / fits, np.diag(1.0 / fits)
        self.bound, self.price = 0.0, np.zeros(len(counts))
        for _ in range(pivots):
            y = inverse.sum(0)
            value, column = self.best_filling(np.maximum(y, 0), capacity)
            floor = float(np.maximum(y, 0) @ self.demand) / max(value, 1.0)
            if floor > self.bound:
                self.bound = floor
                self.price[self.lengths] = np.maximum(y, 0) / max(value, 1.0)
            total = self.amounts.sum()
            if value <= 1 + 1e-9 or np.ceil(total - 1e-6) <= np.ceil(self.bound - 1e-6) or total <= self.bound * (1 + gap):
                break
            step = inverse @ column
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-9, self.amounts / step, np.inf)
            out = int(ratio.argmin())
            self.amounts = np.maximum(0, self.amounts - ratio[out] * step)
            self.amounts[out] = ratio[out]
            self.columns[:, out] = column
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row

    def best_filling(self, y: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
        """The filling of the highest worth at the prices, and that worth."""
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(self.lengths, np.arange(capacity + 1), "right")
        for c in range(int(self.lengths[0]), capacity + 1):
            worth = best[c - self.lengths[: upto[c]]] + y[: upto[c]]
            i = int(worth.argmax())
            if worth[i] > best[c - 1]:
                best[c], took[c] = worth[i], i
            else:
                best[c] = best[c - 1]
        column, c = np.zeros(len(self.lengths), np.int64), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= int(self.lengths[took[c]])
        return float(best[capacity]), column

    def least(self) -> int:
        return int(np.ceil(self.bound - 1e-6))

    def whole(self) -> tuple[list[Pattern], np.ndarray]:
        """The whole parts of the fillings in use as patterns, and the counts that these leave over."""
        rest, out = self.demand.astype(np.int64).copy(), []
        for j in np.argsort(-self.amounts, kind="stable"):
            column = self.columns[:, j]
            used = column > 0
            times = int(min(np.floor(self.amounts[j] + 1e-9), (rest[used] // column[used]).min()))
            if times:
                rest -= times * column
                out.append(Pattern(times, tuple((int(self.lengths[i]), int(column[i])) for i in np.flatnonzero(used)[::-1])))
        counts = np.zeros(len(self.price), np.int64)
        counts[self.lengths] = rest
        return out, counts


def bins_of(patterns: list[Pattern]) -> int:
    return sum(p.times for p in patterns)


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, tolerance: float = TOLERANCE) -> list[Pattern]:
    """Sequences for ``counts[length]`` pieces of each length, as patterns.

    The best-fit packing is the first incumbent. Where it misses the lower bound by more than ``tolerance``, the fractional packing gives a stronger bound and prices;
    its whole fillings are kept, and what they leave over is completed bin by bin, once by waste and once by price. The fewest sequences stay.
    """
    counts = np.asarray(counts, np.int64).copy()
    counts[0] = 0
    best = completed(counts, capacity, nodes)
    if bins_of(best) > least_bins(counts, capacity) * (1 + tolerance):
        relaxed = Relaxation(counts, capacity)
        kept, rest = relaxed.whole()
        for price in (None, relaxed.price):
            if bins_of(best) > relaxed.least():
                best = min(best, kept + completed(rest, capacity, nodes, price, relaxed.least() - bins_of(kept)), key=bins_of)
    return best


def completed(counts: np.ndarray, capacity: int, nodes: int, price: np.ndarray | None = None, bound: int = 0) -> list[Pattern]:
    """Bin completion: depth first, the longest piece left gets each undominated filling in turn, best fit first (or, with prices, the most worth first).

    A filling is used as often as the counts allow or, as a second branch, once. So the first leaf is the best-fit packing, and later ones
    replace it as incumbent only with fewer sequences. A branch ends when the sequences so far and the lower bound of the rest, that is its
    unavoidable waste or worth, cannot beat the incumbent; the search ends when the incumbent meets the lower bound, the tree is done, or
    ``nodes`` branches follow the first leaf.
    """
    least = lambda state: max(least_bins(state, capacity), 0 if price is None else int(np.ceil(price @ state - 1e-6)))
    bound = max(bound, least(counts))
    best: list[Pattern] = []
    best_bins = np.iinfo(np.int64).max
    stack: list[tuple[np.ndarray, tuple | None, int, Pattern | None]] = [(counts, None, 0, None)]
    seen = 0
    while stack and best_bins > bound and seen <= nodes:
        state, trail, used, pattern = stack.pop()
        trail = (trail, pattern) if pattern else trail
        longest = np.flatnonzero(state)
        if not len(longest):
            if used < best_bins:
                best_bins, best = used, []
                while trail:
                    best.append(trail[1])
                    trail = trail[0]
            continue
        if best:
            seen += 1
            if used + least(state) >= best_bins:
                continue
        top = int(longest[-1])
        rest = state.copy()
        rest[top] -= 1
        children = []
        ways = fillings(rest, capacity - top)
        if price is not None:
            ways = sorted({*ways, richest(rest, capacity - top, price)}, key=lambda way: -sum(price[x] * n for x, n in way))
        for way in ways:
            filling = dict(way)
            filling[top] = filling.get(top, 0) + 1
            often = min(int(state[x]) // n for x, n in filling.items())
            for times in {often: 0, 1: 0}:
                after = state.copy()
                for x, n in filling.items():
                    after[x] -= n * times
                children.append((after, trail, used + times, Pattern(times, tuple(sorted(filling.items(), reverse=True)))))
        stack += children[::-1]
    return best[::-1]


def runs_of(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces of this length a sequence, offset of the first) by length and rank."""
    out, taken, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, n in p.filling:
            rank = taken.get(length, 0)
            out.append((length, rank, sequence, n, offset))
            taken[length] = rank + n * p.times
            offset += n * length
        sequence += p.times
    return sorted(out)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    stored = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    part = F.pmod(F.xxhash64("uid"), F.lit(RANK_PARTS))
    full, partial = stored.where(F.col("length") == capacity), stored.where(F.col("length") < capacity).withColumn("part", part)
    names = [*pieces.columns, "sequence_id", "offset"]
    whole = full.withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long")).select(*names)
    by_part = partial.groupBy("length", "part").count().orderBy("length", "part").collect()  # at most capacity * RANK_PARTS rows
    counts, offsets = np.zeros(capacity + 1, np.int64), []
    for r in by_part:
        offsets.append((int(r["length"]), int(r["part"]), int(counts[r["length"]])))
        counts[r["length"]] += r["count"]
    if not offsets:
        return whole
    runs = np.array(runs_of(bin_completion(counts, capacity)), np.int64)
    step = int(counts.max()) + 1
    keys = runs[:, 0] * step + runs[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = runs[np.searchsorted(keys, length * step + rank, "right") - 1]
            slot = rank - r[:, 1]
            columns = [b.column(c) for c in names[:-2]] + [pa.array(r[:, 2] + slot // r[:, 3]), pa.array(r[:, 4] + slot % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    first = F.broadcast(spark.createDataFrame(offsets, "length long, part long, first long"))
    ranked = partial.withColumn("nth", F.row_number().over(W.partitionBy("length", "part").orderBy("uid"))).join(first, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("nth") - 1).select(*pieces.columns, "rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return whole.unionByName(ranked.mapInArrow(work, f"{fields}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "", ranks: str = "", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give a piece of the end id alone; a null doc_id stays null; long texts are cut, never shortened; repeated rows are
    packed each; ties in length are ranked by where the row was written. Other columns are not read. An empty table gives no piece.
    Sequence ids are unique, not dense: pieces of full length have negative ones.
    """
    return place(pieces_of(docs, capacity, tokenizer, ranks, doc_id, text), capacity)
