"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct n-word shingles. Shingles are tokens in two global classes: rare ones, and frequent ones by counts over
all documents. Tokens are ordered rare before frequent. A document's prefix runs until its credits exceed the tokens it may lack in a
partner: a rare token counts one; of frequent tokens, dealt by hash into subclasses, each but the first of its subclass counts one. Two
similar documents then share a rare token or two frequent tokens of one subclass within their prefixes, so rare tokens are indexed singly
and frequent ones in pairs. Subclasses are as many as half the smaller size of a band of document sizes, hence pairs stay few; similar
documents lie in the same or neighbouring bands, and a document indexes its pairs for both.

Equal sets are one node, candidates are verified on whole sets. Links only decide components, so no bucket of the index is expanded into
its pairs: its members are first compared with a hub, the bucket's member of the least key (a hash of its set), and then with a member of the bucket's
largest component. Only members that are still apart are compared with all others, once for all buckets of a hub, and only against what
counts and bitmaps leave possible. A document that indexes pairs indexes all its rare tokens; who meets by a pair and nowhere by a rare
token shares frequent tokens only, so there the bound counts these alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WordHashes, discard, doc_groups, mix64, shingle_sets, unused, written
from quillon.llm.components import components, id_filter, may_hold, spread_join

#: A shingle is frequent from so many counted occurrences on; the list of frequent ones is bounded (8 bytes each), which costs speed only.
FREQUENT, MOST_FREQUENT = 3, 1 << 20
CHUNK = 2_000_000
#: Rows of a block, of which two meet in a task.
BLOCK = 1024
#: Bits a token of the two bitmaps, of all tokens and of the frequent ones, and the most bits of one.
ALL_BITS, FREQUENT_BITS, MOST_BITS = 1.2, 4.8, 1 << 14
#: Kinds of index keys: a rare token, a pair of frequent ones. The lowest bit of a key says which.
SINGLE, PAIR = 0, 1


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def key_of(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "little", signed=True)


def bitmap_of(tokens: np.ndarray, bits: float = ALL_BITS) -> bytes:
    """A bit for each token by its lowest bits: a power of two of them, at least ``bits`` a token, 64 to ``MOST_BITS``."""
    width = min(MOST_BITS, max(64, 1 << max(0, int(bits * len(tokens)) - 1).bit_length()))
    out = np.zeros(width, np.uint8)
    out[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def least_missing(x: bytes, y: bytes) -> tuple[int, int]:
    """At least so many tokens of x are not in y, and the other way round: bits of one that the other lacks, at the narrower width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    a, b = np.bitwise_or.reduce(a.reshape(-1, width), 0), np.bitwise_or.reduce(b.reshape(-1, width), 0)
    return int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())


def least_overlap(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common tokens that makes sets of these sizes similar."""
    return -(-percent * (na + nb) // (100 + percent))


def bands(most: int = 1 << 40) -> list[int]:
    """Lower ends of size bands: a partner of at most 4/3 the size is in the same band or the next."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 4 // 3 + 1)
    return out


BANDS = np.array(bands(), np.int64)


def in_sorted(tokens: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(tokens), bool)
    return some[np.minimum(np.searchsorted(some, tokens), len(some) - 1)] == tokens


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = 75) -> np.ndarray:
    """The index keys of a set: its prefix's rare tokens, and pairs of its frequent ones of one subclass; the lowest bit is the kind."""
    n = len(tokens)
    if not n:
        return tokens
    need = n - -(-percent * n // 100) + 1
    common = in_sorted(tokens, frequent)
    rare = tokens[~common]
    one = np.uint64(1)
    singles = mix64(rare[:need]) & ~one
    if len(rare) >= need:
        return singles
    out, need, rest = [], need - len(rare), tokens[common]
    band = int(np.searchsorted(BANDS, n, "right")) - 1
    for b in {band, max(0, band - 1)}:
        classes = int(BANDS[b]) // 2
        if not classes:
            out.append(mix64(rest + np.uint64(b + 1)))
            continue
        group = (mix64(rest ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(classes)).astype(np.int64)
        order = np.lexsort((rest, group))
        group, own = group[order], rest[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1  # the shortest prefix with enough credits
        group, own, first = group[:end], own[:end], first[:end]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(own)))
        for gap in range(1, int(sizes.max()) if len(sizes) else 0):
            i = np.flatnonzero(group[gap:] == group[:-gap])
            out.append(mix64(mix64(own[i] + np.uint64(b + 1)) + own[i + gap]))
    return np.unique(np.concatenate([singles, *(x | one for x in out)]))


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """Per document (doc_id, n, mark); and, without a mark, (token, count) of shingles met at least twice among some millions of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size, seen = WordHashes(), [], 0, set()
        names = ["doc_id", "n", "mark", "k"]

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            twice = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[twice].view(np.int64)), pa.array(counts[twice], pa.int64()), pa.nulls(int(twice.sum()), pa.binary()), pa.nulls(int(twice.sum()), pa.int64())], names=names)

        for batch, texts in doc_groups(batches):
            sizes, marks = [], []
            for s in shingle_sets(texts, words, n):
                marks.append(fingerprint(s))
                sizes.append(len(s))
                if marks[-1] not in seen:  # equal sets count once
                    seen.add(marks[-1])
                    held.append(s)
                    size += len(s)
                if size > CHUNK:
                    yield counted()
                    held, size = [], 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array([key_of(m) for m in marks], pa.int64())], names=names)
        yield counted()

    return docs.mapInArrow(work, "doc_id long, n long, mark binary, k long")


def _index(docs: DataFrame, n: int, frequent: np.ndarray, percent: int) -> DataFrame:
    """Of every distinct set, once a task: rows (sig, k), and without a sig one row (k, n, f, doc_id, whole, common) with its sizes and bitmaps."""
    names = ["sig", "k", "n", "f", "doc_id", "whole", "common"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for batch, texts in doc_groups(batches):
            sigs, keys, nodes = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(texts, words, n), strict=True):
                k = key_of(fingerprint(s))
                if len(s) and k not in seen:
                    seen.add(k)
                    sigs.append(signatures(s, frequent, percent))
                    keys.append(np.full(len(sigs[-1]), k, np.int64))
                    own = s[in_sorted(s, frequent)]
                    nodes.append((k, len(s), len(own), i, bitmap_of(s), bitmap_of(own, FREQUENT_BITS)))
            if len(seen) > 1_000_000:
                seen.clear()
            if sigs:
                m = sum(map(len, sigs))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys)), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(nodes), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))], names=names)

    return docs.mapInArrow(work, "sig long, k long, n long, f long, doc_id long, whole binary, common binary")


def _sets(docs: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(k, tokens) of the nodes ``ends`` (k, doc_id of one of its documents). Only documents whose id a bounded map may hold are read again."""
    bitmap = id_filter(ends, "doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * len(bitmap))).alias("place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            x = batch.column(0).to_numpy().astype(np.uint64)
            chosen = batch.filter(pa.array((bitmap[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1))
            for _, texts in doc_groups([chosen]):
                sets = shingle_sets(texts, words, n)
                yield pa.RecordBatch.from_arrays([pa.array([key_of(fingerprint(s)) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k", "tokens"])

    return docs.select(place, "text").mapInArrow(work, "k long, tokens array<long>").join(ends, "k", "left_semi").dropDuplicates(["k"])


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of rows (a, b, kind) that sizes and bitmaps do not rule out."""
    left, right = (nodes.select(F.col("k").alias(k), *(F.col(c).alias(c + k) for c in ("n", "f", "whole", "common"))) for k in "ab")
    met = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, na, nb, fa, fb = (batch.column(c).to_numpy() for c in ("kind", "na", "nb", "fa", "fb"))
            overlap = least_overlap(na, nb, percent)
            lacks = np.array([least_missing(x, y) for x, y in zip(batch.column("wholea").to_pylist(), batch.column("wholeb").to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            fits = (na - lacks[:, 0] >= overlap) & (nb - lacks[:, 1] >= overlap)
            both = np.flatnonzero(fits & (kind == PAIR) & (np.minimum(fa, fb) >= overlap))
            fits &= kind == SINGLE
            x, y = batch.column("commona"), batch.column("commonb")
            for i in both.tolist():
                la, lb = least_missing(x[i].as_py(), y[i].as_py())
                fits[i] = fa[i] - la >= overlap[i] and fb[i] - lb >= overlap[i]
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    return met.select("a", "b", "kind", *(c + k for c in ("n", "f", "whole", "common") for k in "ab")).mapInArrow(work, "a long, b long").distinct()


def block_pairs(left: np.ndarray, right: np.ndarray, k: np.ndarray, root: np.ndarray, late: np.ndarray, n: np.ndarray, tokens: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of a left and a right row in different components that sizes and bitmaps, of so many ``tokens`` of each, leave possible.

    Two rows that are both ``late`` meet in either order; only one of the two is given.
    """
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    fits = (root[a] != root[b]) & (~late[b] | (k[a] < k[b])) & (np.minimum(tokens[a], tokens[b]) >= least_overlap(n[a], n[b], percent))
    a, b = a[fits], b[fits]
    width = np.array([len(x) for x in bits])
    keep = np.zeros(len(a), bool)
    narrow = np.minimum(width[a], width[b])
    for w in np.unique(narrow):
        at = np.flatnonzero(narrow == w)
        used, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        table = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[r], np.uint8).reshape(-1, w), 0) for r in used])
        for part in np.array_split(np.arange(len(at)), len(at) * int(w) // 4_000_000 + 1):
            x, y = table[place[part]], table[place[len(at) + part]]
            i, j = a[at[part]], b[at[part]]
            overlap = least_overlap(n[i], n[j], percent)
            keep[at[part]] = (tokens[i] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64) >= overlap) & (tokens[j] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64) >= overlap)
    a, b = k[a[keep]], k[b[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def _apart(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The possible pairs (a, b) of nodes in different components that share a hub; ``rows`` has hub, kind, k and root, each node once a hub.

    Members outside the largest component of a hub are compared with all members, in blocks of about ``BLOCK`` of either: neither a hub's
    members nor their pairs ever stand in one place, and only pairs that bitmaps leave possible are given.
    """
    keys = ["hub", "kind"]
    by_root = rows.groupBy(*keys, "root").agg(F.count("*").alias("c"))
    sizes = by_root.groupBy(*keys).agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("most"))
    sizes = sizes.select(*keys, F.col("most.root").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("most.c")) / BLOCK).cast("int").alias("lates"))
    tokens = F.when(F.col("kind") == PAIR, F.col("f")).otherwise(F.col("n")).alias("tokens")
    bits = F.when(F.col("kind") == PAIR, F.col("common")).otherwise(F.col("whole")).alias("bits")
    own = rows.join(sizes.where(F.col("lates") > 0), keys).withColumn("late", F.col("root") != F.col("main"))
    own = own.join(nodes.select("k", "n", "f", "whole", "common"), "k").select(*keys, "k", "root", "late", "n", tokens, bits, "blocks", "lates")
    place = lambda of: F.pmod(F.xxhash64("k", F.lit(5)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = own.where("late").select(*keys, place("lates").alias("lo"), every("blocks").alias("hi"), F.lit(True).alias("asks"), "k", "root", "late", "n", "tokens", "bits")
    right = own.select(*keys, every("lates").alias("lo"), place("blocks").alias("hi"), F.lit(False).alias("asks"), "k", "root", "late", "n", "tokens", "bits")
    cell = [*keys, "lo", "hi"]

    def compared(table: pa.Table) -> pa.RecordBatch:
        cells = [table.column(i).to_numpy() for i in range(4)]
        asks, k, root, late, n, tokens = (table.column(i).to_numpy() for i in range(4, 10))
        bits = table.column(10).to_pylist()
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cells], axis=0), [True]])
        edges, found = np.flatnonzero(new), []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            at = np.arange(e - s)
            asked = asks[s:e].astype(bool)
            found.append(block_pairs(at[asked], at[~asked], k[s:e], root[s:e], late[s:e].astype(bool), n[s:e], tokens[s:e], bits[s:e], percent))
        both = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:  # sorted by cell; the last cell of a batch may go on in the next
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            other = np.any([(c := table.column(i).to_numpy()) != c[-1] for i in range(4)], axis=0)
            begun = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if begun:
                yield compared(table.slice(0, begun))
            held = table.slice(begun)
        if held is not None and held.num_rows:
            yield compared(held)

    parts = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell)
    return parts.mapInArrow(work, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left, right = sets.select(F.col("k").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("k").alias("b"), F.col("tokens").alias("y"))
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (total - both)).select("a", "b")


class _Links:
    """Verified links so far, the components they make, and the pairs that need no second look."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, percent: int):
        self.docs, self.nodes, self.n, self.percent = docs, nodes, n, percent
        self.tried: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.found: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.held: list[DataFrame] = []

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        self.held.append(written(df, label))
        return self.held[-1]

    def rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their k: its smallest node."""
        if self.roots is None:
            return rows.withColumn("root", F.col("k"))
        return rows.join(self.roots, "k", "left").withColumn("root", F.coalesce("root", "k"))

    def test(self, likely: DataFrame) -> None:
        likely = self._kept(likely if self.tried is None else likely.join(self.tried, ["a", "b"], "left_anti"), "likely")
        self.tried = likely if self.tried is None else self.tried.unionByName(likely)
        ends = likely.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        ends = self._kept((ends if self.sets is None else ends.join(self.sets.select("k"), "k", "left_anti")).join(self.nodes.select("k", "doc_id"), "k"), "ends")
        if ends.head(1):
            new = self._kept(_sets(self.docs, ends, self.n), "sets")
            self.sets = new if self.sets is None else self.sets.unionByName(new)
        if self.sets is None:
            return
        found = self._kept(_verified(likely, self.sets, self.percent), "links")
        if found.head(1):
            self.found = found if self.found is None else self.found.unionByName(found)
            self.roots = written(components(self.found).withColumnRenamed("node", "k"), "roots")


def _component_roots(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame | None:
    """(k, root) of all nodes that links reach; none without a link."""
    index = written(_index(docs, n, frequent, percent), "index")
    met = index.where(F.col("sig").isNotNull()).select("sig", "k")
    shared = met.groupBy("sig").agg(F.min("k").alias("hub"), F.max("k").alias("high"), F.count("*").alias("size")).where(F.col("hub") != F.col("high")).select("sig", "size", "hub")
    buckets = written(met.join(shared, "sig").withColumn("kind", (F.col("sig").bitwiseAND(F.lit(1))).cast("int")), "buckets")
    nodes = index.where(F.col("sig").isNull()).groupBy("k").agg(*(F.first(c).alias(c) for c in ("n", "f", "whole", "common")), F.min("doc_id").alias("doc_id"))
    nodes = written(nodes.join(buckets.select("k").distinct(), "k", "left_semi"), "nodes")
    discard(index)
    links = _Links(docs, nodes, n, percent)
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "kind")
    # each member of a bucket with its hub, which is the same in most buckets of a group of copies
    links.test(_plausible(buckets.where(F.col("k") != F.col("hub")).select(*ordered("k", "hub")).distinct(), nodes, percent))
    # members outside a bucket's largest component with a member of that one
    own = links.rooted(buckets.where(F.col("size") > 2))
    by_root = own.groupBy("sig", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("k", "sig").alias("h"), "k")).alias("one"))
    apart = by_root.groupBy("sig").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root", F.col("one.k").alias("k"))).alias("main")).where(F.col("roots") > 1)
    other = own.join(apart.select("sig", "main"), "sig").where(F.col("root") != F.col("main.root"))
    links.test(_plausible(other.select(*ordered("k", "main.k")).distinct(), nodes, percent))
    # what is still apart
    own = links.rooted(buckets.where(F.col("size") > 2))
    apart = own.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("sig")
    rows = written(own.join(apart, "sig", "left_semi").select("hub", "kind", "k", "root").distinct(), "apart")
    links.test(_apart(rows, nodes, percent))
    discard(rows, buckets, nodes, *links.held)
    return links.roots


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets. Fewer than ``n`` words are one shingle; a null,
    empty or blank text has none and links with nothing, not even with its like. Documents of equal sets link. Repeated rows stay, each with
    its component; a null doc_id takes part in linking by its text but is never the smallest, and alone its component is null. Other columns
    are not read. An empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    first = written(_summaries(rows, n), "summaries")
    each = first.where(F.col("mark").isNotNull())
    heavy = first.where(F.col("mark").isNull()).groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("count")).where(F.col("count") >= FREQUENT)
    tokens = heavy.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token").to_numpy()
    frequent = np.sort(np.ascontiguousarray(tokens).astype(np.int64).view(np.uint64))
    roots = _component_roots(rows, frequent, n, percent)
    nodes = each.where(F.col("n") > 0).groupBy("mark", "n", "k").agg(F.min("doc_id").alias("least_id"))
    if roots is None:
        by_mark = nodes.select("mark", "n", F.col("least_id").alias("component_id"))
    else:
        linked = nodes.join(roots, "k", "left")
        smallest = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least_id").alias("smallest"))
        reached = spread_join(linked.where(F.col("root").isNotNull()), smallest, "root", "k")
        by_mark = reached.select("mark", "n", F.col("smallest").alias("component_id")).unionByName(linked.where(F.col("root").isNull()).select("mark", "n", F.col("least_id").alias("component_id")))
    many = each.where(F.col("n") > 0).join(by_mark, ["mark", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = each.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return many.unionByName(none)


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns stay. Repeated rows of a kept id all stay, and so do rows without an id.

    Only documents that a bounded bitmap of dropped ids may hold are shuffled; all others pass straight through.
    """
    found = ngram_components(docs, n, percent, doc_id, text)
    gone, may = unused("gone", docs), unused("may", docs)
    dropped = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    marked = docs.withColumn(may, may_hold(id_filter(dropped, gone), F.col(f"`{doc_id}`").cast("long")))
    sure = marked.where(~F.col(may)).drop(may)
    rest = marked.where(F.col(may)).drop(may)
    return sure.unionByName(rest.join(dropped, F.col(f"`{doc_id}`").cast("long") == F.col(gone), "left_anti"))
