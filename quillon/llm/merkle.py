"""A Merkle manifest of a table: a tree of digests for each group of rows, one tree over the groups' roots, and a proof for every row.

Upwards, a task combines the digests it holds by events: a digest joins its parent's partial entry, and when the entry has as many children
as the level's size gives it, the parent's digest is the next event. What stays partial is a task's frontier, a few entries a level; it is
dealt anew by the ancestor ``BAND`` levels up, again and again, until all roots are there. A task holds one such ancestor's entries at most.
Downwards, every finished parent is a link back to its children; bands of links pass their paths on, from the roots to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import discard, written

ARITY = 3
#: Levels of a band: a task handles one ancestor's 3**6 descendants of a band at a time.
BAND = 6
NODES = "grp string, n long, level int, idx long, slots array<int>, kids array<binary>, done boolean"
STEPS = "array<struct<slot:int,siblings:array<string>>>"


def field(c: Column) -> Column:
    """A value in a leaf: ``-`` for null, else its size in bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(columns: Sequence[Column]) -> Column:
    """The hexadecimal SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def joined(kids: Iterable[bytes]) -> bytes:
    """A parent's digest: that of its children's digests as hexadecimal text."""
    return hashlib.sha256("".join(k.hex() for k in kids).encode()).digest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def children(n: int, level: int, idx: int) -> int:
    """How many children the size of the tree gives to a parent: ``ARITY``, fewer at the right edge; 0 above the root."""
    below = n
    for _ in range(level - 1):
        below = -(-below // ARITY)
    return 0 if below == 1 else min(ARITY, below - ARITY * idx)


class Combiner:
    """Partial parents by (group, level, index). ``add`` takes a child's digest and yields the parents that it finishes, ancestors included."""

    def __init__(self) -> None:
        self.partial: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}

    def add(self, grp: str, n: int, level: int, idx: int, digest: bytes) -> Iterator[tuple]:
        """``level`` and ``idx`` are the child's."""
        while need := children(n, level + 1, idx // ARITY):
            level, idx, slot = level + 1, idx // ARITY, idx % ARITY
            _, kids = self.partial.setdefault((grp, level, idx), (n, {}))
            kids[slot] = digest
            if len(kids) < need:
                return
            del self.partial[grp, level, idx]
            own = [kids[i] for i in range(need)]
            yield grp, n, level, idx, list(range(need)), own, True
            digest = joined(own)

    def rest(self) -> Iterator[tuple]:
        for (grp, level, idx), (n, kids) in self.partial.items():
            slots = sorted(kids)
            yield grp, n, level, idx, slots, [kids[i] for i in slots], False
        self.partial = {}


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])


def _batched(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _nodes(held)
            held = []
    if held:
        yield _nodes(held)


def placed(rows: DataFrame, grp: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx, their place in their group from 0 by ``order`` (nulls first), and n, the group's size; ties in any order. Written, and sorted in each file.

    A range sort, one count for each group and partition, and running sums of these: no task sees a whole group.
    """
    part, at = "m_part", "m_at"
    by = [F.col(grp), *(F.col(c).asc_nulls_first() for c in order)]
    tie = F.monotonically_increasing_id()  # rows that tie in all of order may be very many
    ranged = rows.withColumn("m_tie", tie).repartitionByRange(*by, "m_tie").sortWithinPartitions(*by, "m_tie").drop("m_tie")
    ranged = written(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-sorted")
    counts = ranged.groupBy(grp, part).agg(F.count("*").alias("own"), F.min(at).alias("first"))
    before = F.sum("own").over(W.partitionBy(grp).orderBy(part)) - F.col("own")
    offsets = counts.select(grp, part, (before - F.col("first")).alias("shift"), F.sum("own").over(W.partitionBy(grp)).alias("n"))
    numbered = ranged.join(offsets, [grp, part]).withColumn("idx", F.col(at) + F.col("shift")).drop(part, at, "shift")
    out = written(numbered.sortWithinPartitions(grp, "idx"), "merkle-placed")
    discard(ranged)
    return out


def combined(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Links (grp, n, level, idx, kids) of all finished parents of leaves (grp, n, idx, digest), and the number of bands."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            own = Combiner()
            for batch in batches:
                for grp, n, idx, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    yield from own.add(grp, n, 0, idx, digest)
            yield from own.rest()

        return _batched(rows())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            own, key = Combiner(), None
            for batch in batches:
                for at, grp, n, level, idx, slots, kids in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    if (grp, at) != key:
                        yield from own.rest()
                        key = grp, at
                    for slot, digest in zip(slots, kids, strict=True):
                        yield from own.add(grp, n, level - 1, ARITY * idx + slot, digest)
            yield from own.rest()

        return _batched(rows())

    largest = leaves.agg(F.max("n")).first()[0] or 1
    bands = max(1, -(-depth(largest) // BAND))
    every = [written(leaves.select("grp", "n", "idx", "digest").mapInArrow(first, NODES), "merkle-nodes")]
    frontier = every[0].where(~F.col("done"))
    for band in range(1, bands + 1):
        top = band * BAND
        ripe = frontier.where(F.col("level") <= top)
        at = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), F.lit(top) - F.col("level"))).cast("long")
        dealt = ripe.select(at.alias("at"), "grp", "n", "level", "idx", "slots", "kids").repartition("grp", "at").sortWithinPartitions("grp", "at", "level", "idx")
        every.append(written(dealt.mapInArrow(again, NODES), "merkle-nodes"))
        frontier = frontier.where(F.col("level") > top).unionByName(every[-1].where(~F.col("done")))
    links = every[0]
    for more in every[1:]:
        links = links.unionByName(more)
    return links.where("done").select("grp", "n", "level", "idx", "kids"), bands


def up(level: Column, idx: Column, top: int) -> Column:
    """The index of the ancestor at level ``top``."""
    return F.floor(idx / F.pow(F.lit(float(ARITY)), F.lit(top) - level)).cast("long")


def depth_of(n: Column, most: int) -> Column:
    """Levels above the leaves of a tree of ``n``, which has ``most`` at most."""
    out = F.lit(0)
    for i in range(most):
        out = out + F.when(n > ARITY**i, 1).otherwise(0)
    return out


def traced(leaves: DataFrame, links: DataFrame, bands: int, seeds: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(idx, ``carried``, top, proof) of the leaves: for each level, leaf first, the place in the run and the run's others; then the seed's steps.

    ``seeds`` (grp, n, top, proof) hold each group's root as text and the steps above it.
    """
    kinds = dict(leaves.dtypes)
    names = [f"k{i}" for i in range(len(carried))]
    blank = [F.lit(None).cast(kinds[c]).alias(k) for k, c in zip(names, carried, strict=True)]
    no_kids, no_path = F.lit(None).cast("array<binary>").alias("kids"), (F.lit(None).cast("string").alias("top"), F.lit(None).cast(STEPS).alias("proof"))
    steps = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))

    def down(batches: Iterator[pa.RecordBatch], bottom: int | None) -> Iterator[pa.RecordBatch]:
        """Rows come by (grp, block, kind): the block's own path, its links from the highest level down, then its leaves. ``bottom``: the level whose paths are wanted, or None for the leaves."""
        key, top, paths = None, "", {}
        for batch in batches:
            grps, blocks, kind_of, levels, idxs, kid_lists, tops, proofs = (batch.column(i).to_pylist() for i in range(8))
            out: list[tuple] = []
            took: list[int] = []
            for i, (grp, block, kind) in enumerate(zip(grps, blocks, kind_of, strict=True)):
                if (grp, block) != key:
                    key, paths = (grp, block), {}
                if kind == 0:
                    top, paths[levels[i], idxs[i]] = tops[i], proofs[i]
                elif kind == 1:
                    above = paths.pop((levels[i], idxs[i]))
                    own = [k.hex() for k in kid_lists[i]]
                    for slot in range(len(own)):
                        path = [{"slot": slot, "siblings": own[:slot] + own[slot + 1 :]}, *above]
                        level, idx = levels[i] - 1, ARITY * idxs[i] + slot
                        if level == bottom:
                            out.append((grp, idx, top, path))
                        else:
                            paths[level, idx] = path
                else:
                    took.append(i)
                    out.append((grp, idxs[i], top, paths[0, idxs[i]]))
            if out:
                grp, idx, tops_, proof = zip(*out, strict=True)
                rows = batch.take(pa.array(took, pa.int64()))
                more = [] if bottom is not None else [rows.column(8 + j) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(idx, pa.int64()), *more, pa.array(tops_, pa.string()), pa.array(proof, steps)], names=["grp", "idx", *(names if more else ()), "top", "proof"])

    seeds = seeds.withColumn("depth", depth_of(F.col("n"), bands * BAND)).withColumn("band", F.greatest(F.lit(1), F.ceil(F.col("depth") / BAND).cast("int")))
    paths = None
    for band in range(bands, 0, -1):
        top, bottom = band * BAND, (band - 1) * BAND
        rows = seeds.where(F.col("band") == band).select("grp", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), F.col("depth").alias("level"), F.lit(0).cast("long").alias("idx"), no_kids, "top", "proof", *blank)
        if paths is not None:
            rows = rows.unionByName(paths.select("grp", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.lit(top).alias("level"), "idx", no_kids, "top", "proof", *blank))
        own = links.where((F.col("level") > bottom) & (F.col("level") <= top))
        rows = rows.unionByName(own.select("grp", up(F.col("level"), F.col("idx"), top).alias("block"), F.lit(1).alias("kind"), "level", "idx", "kids", *no_path, *blank))
        if band == 1:
            rows = rows.unionByName(leaves.select("grp", up(F.lit(0), F.col("idx"), top).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", no_kids, *no_path, *(F.col(c).alias(k) for k, c in zip(names, carried, strict=True))))
        dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", F.desc("level"), "idx")
        if band > 1:
            paths = written(dealt.mapInArrow(lambda b, bottom=bottom: down(b, bottom), f"grp string, idx long, top string, proof {STEPS}"), "merkle-paths")
    out = dealt.mapInArrow(lambda b: down(b, None), ", ".join(["grp string, idx long", *(f"{k} {kinds[c]}" for k, c in zip(names, carried, strict=True)), f"top string, proof {STEPS}"]))
    return out.select("idx", *(F.col(k).alias(c) for k, c in zip(names, carried, strict=True)), "top", "proof")


def roots_of(leaves: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, n, digest) of each group: the digest of its highest parent, or its only leaf."""
    hexes = F.concat_ws("", F.transform("kids", lambda k: F.lower(F.hex(k))))
    high = links.groupBy("grp").agg(F.max_by(F.struct("n", F.unhex(F.sha2(hexes.cast("binary"), 256)).alias("digest")), "level").alias("top")).select("grp", "top.*")
    return high.unionByName(leaves.where(F.col("n") == 1).select("grp", "n", "digest"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    run = lambda at, s: F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), s["slot"]), ""), at, F.array_join(F.slice(s["siblings"], s["slot"] + 1, F.greatest(F.lit(0), F.size(s["siblings"]) - s["slot"])), ""))
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(run(at, s).cast("binary"), 256))


def merkle_manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with leaf, subroot, root and proof: a row for each of ``docs``.

    A row's leaf digests ``columns``. Leaves of a group ascend by ``order``, nulls first, and equal ones by digest; groups ascend by their
    names' bytes, null first. ``proof`` has a step for each level from the leaf to the root: slot, the place in the run, and siblings, the
    run's others from left to right. Null values have a spelling of their own, so null texts differ from empty ones; texts of any length
    count whole. Rows that repeat each other have a leaf each. An empty table gives an empty one. Kept columns of the new names are left out.
    """
    kept = [c for c in keep if c.lower() not in ("leaf", "subroot", "root", "proof")]
    spelled = [f"own_{i}" for i in range(len(kept))]
    name = F.col(f"`{group}`").cast("string")
    leaf = leaf_of([F.col(f"`{c}`") for c in columns])
    grp = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name))
    narrow = written(docs.select(grp.alias("grp"), F.col(f"`{order}`").alias("by"), F.unhex(leaf).alias("digest"), *(F.col(f"`{c}`").alias(s) for c, s in zip(kept, spelled, strict=True))), "merkle-leaves")
    leaves = placed(narrow, "grp", ["by", "digest"])
    discard(narrow)
    links, bands = combined(leaves)
    roots = written(roots_of(leaves, links).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("n").alias("size"), "digest"), "merkle-roots")
    tops = placed(roots, "grp", ["name"])
    top_links, top_bands = combined(tops)
    found = roots_of(tops, top_links).first()
    seed = tops.select("grp", "n").distinct().withColumn("top", F.lit("")).withColumn("proof", F.array().cast(STEPS))
    above = traced(tops, top_links, top_bands, seed, ["name", "size", "digest"])
    seeds = written(above.select(F.col("name").alias("grp"), F.col("size").alias("n"), F.lower(F.hex("digest")).alias("top"), "proof"), "merkle-seeds")
    discard(roots, tops)
    out = traced(leaves, links, bands, seeds, ["digest", *spelled])
    root = F.lit(found["digest"].hex() if found else None).cast("string")
    return out.select(*(F.col(s).alias(c) for c, s in zip(kept, spelled, strict=True)), F.lower(F.hex("digest")).alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "proof")
