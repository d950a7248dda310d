"""Product quantisation: codebooks, codes, table-lookup scores, pruned search, packing and rotation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vec import doubles, times_matrix
from quillon.operators.blocks import TASK_BLOCKS, block_top_k, folded, met, packed, pairs_met, steps
from quillon.operators.ranking import top_k
from quillon.operators.training import sampled
from quillon.sources.shared import kept


#: Documents of a block of an inverted list.
LIST_ROWS = 8192


def sampled_codebook(vectors: DataFrame, parts: int, codes: int, seed: int = 42) -> np.ndarray:
    """[parts, codes, width]: the sub-vectors of ``codes`` documents, sampled from the whole table by a hash of docid and seed.

    The size must be a multiple of ``parts``.
    """
    v = np.array([r["v"] for r in sampled(vectors, "docid", codes, seed).select(doubles("doc_vec").alias("v")).collect()])
    if v.shape[1] % parts:
        raise ValueError(f"size {v.shape[1]} is no multiple of {parts}")
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2).copy()


def nearest_codes(x: np.ndarray, book: np.ndarray, assign: str) -> np.ndarray:
    """[rows, parts]: per part the code of the smallest distance ("l2") or the largest inner product ("ip"), the first of equals."""
    if assign not in ("l2", "ip"):
        raise ValueError("assign is l2 or ip")
    parts = x.reshape(len(x), len(book), -1)
    out = np.empty(parts.shape[:2], np.int64)
    step = max(1, 4_000_000 // max(1, book[0].size))  # rows whose differences from all codes are held at a time
    for m, centroids in enumerate(book):
        for at in range(0, len(x), step):
            a, b = parts[at : at + step, m, None], centroids[None]
            out[at : at + step, m] = folded(a - b, a - b).argmin(1) if assign == "l2" else folded(a, b).argmax(1)
    return out


def encoded(vectors: DataFrame, book: np.ndarray, assign: str = "l2", rotation: np.ndarray | None = None) -> DataFrame:
    """(docid, docno, codes); vectors are rotated first where there is a rotation. The codebook is a bounded table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), np.float64)
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest_codes(x if rotation is None else x @ rotation, book, assign).tolist(), pa.list_(pa.int32()))], names=["docid", "docno", "codes"])

    return vectors.select("docid", "docno", doubles("doc_vec").alias("v")).mapInArrow(work, "docid long, docno string, codes array<int>")


def book_literal(book: np.ndarray) -> Column:
    return F.from_json(F.lit(str(book.tolist())), "array<array<array<double>>>")


def decoded(codes: DataFrame, book: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """(docid, docno, doc_vec): the codes' centroids in a row, rotated back where there is a rotation."""
    b = book_literal(book)
    v = F.flatten(F.transform("codes", lambda c, m: F.element_at(F.element_at(b, m + 1), c + 1)))
    return codes.select("docid", "docno", (v if rotation is None else times_matrix(v, rotation.T.tolist())).alias("doc_vec"))


def trained(vectors: DataFrame, parts: int, codes: int, rounds: int = 10, rotation: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds from a sample of the documents. Means are aggregated per part and code; parts * codes * width numbers reach the driver."""
    book = sampled_codebook(vectors, parts, codes) if start is None else start.copy()
    if rotation is not None and start is None:
        book = (book.transpose(1, 0, 2).reshape(book.shape[1], -1) @ rotation).reshape(book.shape[1], parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in code_sums(vectors, book, rotation).collect():  # parts * codes * width rows at most
            at = np.unravel_index(r["at"], book.shape)
            book[at] = r["x"] / r["n"]
    return book


def code_sums(vectors: DataFrame, book: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """(at, x, n): the sum of each codebook cell's sub-vector components and how many there are, added up within tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(book.shape), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if len(x):
                x = x if rotation is None else x @ rotation
                codes, parts = nearest_codes(x, book, "l2"), x.reshape(len(x), len(book), -1)
                for m in range(len(book)):
                    np.add.at(sums[m], codes[:, m], parts[:, m])
                    counts[m] += np.bincount(codes[:, m], minlength=book.shape[1])
        n = np.repeat(counts.ravel(), book.shape[2])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at]), pa.array(n[at])], names=["at", "x", "n"])

    return vectors.select(doubles("doc_vec").alias("v")).mapInArrow(work, "at long, x double, n long").groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def learned_rotation(vectors: DataFrame, parts: int, codes: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and the codebook of the rotated vectors: rounds of coding and of the orthogonal Procrustes problem, whose d * d moments are aggregated over all rows."""
    size = len(vectors.select("doc_vec").first()[0])
    rotation, book = np.eye(size), None
    for _ in range(rounds):
        book = trained(vectors, parts, codes, 1, rotation, book)
        near = decoded(encoded(vectors, book, "l2", rotation), book).select("docid", F.col("doc_vec").alias("y")).join(vectors.select("docid", doubles("doc_vec").alias("x")), "docid")

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size))
            for b in batches:
                if b.num_rows:
                    total += np.array(b.column(0).to_pylist()).T @ np.array(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "x"])

        cells = near.select("x", "y").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        moment = np.zeros(size * size)
        for r in cells:
            moment[r["at"]] = r["x"]
        u, _, vt = np.linalg.svd(moment.reshape(size, size))
        rotation = u @ vt
    return rotation, trained(vectors, parts, codes, 1, rotation, book)


def lookup_tables(queries: DataFrame, book: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """Queries with lut, [part][code]: inner products of the query's sub-vectors with all centroids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.array(batch.column(1).to_pylist(), np.float64)
            if len(q):
                parts = (q if rotation is None else q @ rotation).reshape(len(q), len(book), -1)
                lut = np.stack([folded(parts[:, m, None], book[m][None]) for m in range(len(book))], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lut.tolist(), pa.list_(pa.list_(pa.float64())))], names=["qid", "lut"])

    return queries.select("qid", doubles("query_vec").alias("v")).mapInArrow(work, f"qid {queries.schema['qid'].dataType.simpleString()}, lut array<array<double>>")


def looked_up(codes: np.ndarray, luts: np.ndarray) -> np.ndarray:
    """[queries, docs] scores: table entries of each part, added from the left."""
    out = np.zeros((len(luts), len(codes)))
    for m in range(codes.shape[1]):
        out += luts[:, m][:, codes[:, m]]
    return out


def code_search(queries: DataFrame, codes: DataFrame, book: np.ndarray, k: int = 1000, rotation: np.ndarray | None = None, prune: bool = False, inflation: float = 1.0, query_rows: int = 256, doc_rows: int = 8192, n_docs: int | None = None) -> DataFrame:
    """(qid, docid, docno, score, rank from 1) of the k best documents by table lookup.

    Queries' tables and codes are packed into blocks; a block of codes stays in its task while blocks of tables stream past. With ``prune`` each block of
    codes is searched through its inverted lists, best centroids first, until no unseen document can reach the kth score; ``inflation``
    below 1 prunes more and may lose documents, 1 gives the same answer as without.
    """
    qtype = queries.schema["qid"].dataType.simpleString()
    tables = kept(lookup_tables(queries, book, rotation).select("qid", F.flatten("lut").alias("lut")), "tables")
    if n_docs is None:
        codes = kept(codes.select("docid", "docno", "codes"), "codes")
        n_docs = codes.count()
    qb, db = max(1, -(-tables.count() // query_rows)), max(1, -(-n_docs // doc_rows))
    copies = -(-qb // TASK_BLOCKS)
    resident = packed(codes, "docid", "codes", db).select(F.col("block").alias("at"), steps(copies).alias("copy"), "blob")
    streamed = packed(tables, "qid", "lut", qb).select(steps(db).alias("at"), F.pmod("block", F.lit(copies)).cast("long").alias("copy"), "block", "blob")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (docids, c), (qids, tables) in pairs_met(batches):
            luts, c, ids = tables.reshape(len(qids), len(book), -1), c.astype(np.int64), np.array(docids, np.int64)
            if prune:
                hits = [pruned_best(c, lut, k, inflation) for lut in luts]
                q, d = np.repeat(np.arange(len(luts)), [len(h) for h in hits]), np.concatenate(hits)
                s = np.concatenate([looked_up(c[h], lut[None])[0] for h, lut in zip(hits, luts, strict=True)])
            else:
                scores = looked_up(c, luts)
                last = np.partition(scores, max(0, len(c) - k), 1)[:, max(0, len(c) - k)]
                q, d = np.nonzero(scores >= last[:, None])
                s = scores[q, d]
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q], pa.int64() if qtype == "bigint" else pa.string()), pa.array(ids[d]), pa.array(s, pa.float64())], names=["qid", "docid", "score"])

    found = met(resident, streamed, db * copies).mapInArrow(work, f"qid {qtype}, docid long, score double")
    return top_k(found, k, first=1).join(codes.select("docid", "docno"), "docid")


def pruned_best(codes: np.ndarray, lut: np.ndarray, k: int, inflation: float = 1.0, step: int = 8) -> np.ndarray:
    """Rows that may be among the k best: centroids are visited best first in the part whose next one is best; the sum of all parts' next entries bounds what is unseen."""
    order = np.argsort(-lut, 1, kind="stable")
    best = np.take_along_axis(lut, order, 1)
    at, seen, kth = np.zeros(len(lut), int), np.zeros(len(codes), bool), -np.inf
    n = lut.shape[1]
    while not seen.all():
        left = np.flatnonzero(at < n)
        if len(left) < len(lut) or inflation * best[np.arange(len(lut)), at].sum() + 1e-9 < kth:
            break
        m = left[np.argmax(best[left, at[left]])]
        seen |= np.isin(codes[:, m], order[m, at[m] : at[m] + step])
        at[m] += step
        if seen.sum() >= k:
            rows = np.flatnonzero(seen)
            s = looked_up(codes[rows], lut[None])[0]
            kth = np.partition(s, len(s) - k)[len(s) - k]
    return np.flatnonzero(seen)


def flat_search(queries: DataFrame, codes: DataFrame, book: np.ndarray, k: int = 1000) -> DataFrame:
    """The same ranking over reconstructed vectors."""
    found = block_top_k(queries.select("qid", "query_vec"), decoded(codes, book), k)
    return found.join(codes.select("docid", "docno"), "docid").withColumn("rank", F.col("rank") + 1)


def inverted_codes(codes: DataFrame, rows: int = LIST_ROWS) -> DataFrame:
    """(part, code, block, docids): the documents of each centroid in docid order, a row for each block of ``rows`` docids, so that no list grows with the table."""
    block = F.floor(F.col("docid") / rows).alias("block")
    return codes.select("docid", block, F.posexplode("codes").alias("part", "code")).groupBy("part", "code", "block").agg(F.array_sort(F.collect_list("docid")).alias("docids"))


def packed_codes(codes: DataFrame, bits: int) -> DataFrame:
    """(docid, packed): codes of ``bits`` bits each, lowest bit first, in whole bytes, as hex."""
    n = F.size("codes")
    flat = F.flatten(F.transform("codes", lambda c: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.floor(c / F.pow(F.lit(2), i)).cast("long") % 2)))
    size = F.ceil(n * bits / 8).cast("int")
    byte = lambda i: F.aggregate(F.transform(F.slice(flat, i * 8 + 1, 8), lambda b, j: b * F.pow(F.lit(2), j).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return codes.select("docid", F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "").alias("packed"))
