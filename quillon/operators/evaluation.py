"""Retrieval measures per query, experiments over several runs, and a paired test."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.operators.diversity import ils


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.select("qid", "docno", "rank").join(qrels.select("qid", "docno", "label"), ["qid", "docno"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def measures(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rr, recall, precision, ap, ndcg), all at ``k``, for every query with a relevant document; 0 where none is found. Gains are 2 ** label - 1."""
    top = judged(run.where(F.col("rank") < k), qrels)
    rel = (F.col("label") > 0).cast("int")
    hits = F.sum(rel).over(W.partitionBy("qid").orderBy("rank"))
    gain = (F.pow(F.lit(2.0), F.greatest("label", F.lit(0))) - 1) / F.log2(F.col("rank") + 2.0)
    found = top.withColumn("hits", hits).groupBy("qid").agg(
        F.max(F.when(rel == 1, 1 / (F.col("rank") + 1.0))).alias("rr"),
        F.sum(rel).alias("n"),
        F.sum(F.when(rel == 1, F.col("hits") / (F.col("rank") + 1.0))).alias("ap"),
        F.sum(gain).alias("dcg"),
    )
    ideal = qrels.where(F.col("label") > 0).withColumn("at", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("label"), "docno")) - 1)
    best = ideal.groupBy("qid").agg(F.count("*").alias("r"), F.sum(F.when(F.col("at") < k, (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col("at") + 2.0))).alias("idcg"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = best.join(found, "qid", "left")
    return out.select("qid", z(F.col("rr")).alias("rr"), z(F.col("n") / F.col("r")).alias("recall"), z(F.col("n") / F.lit(float(k))).alias("precision"), z(F.col("ap") / F.col("r")).alias("ap"), z(F.col("dcg") / F.col("idcg")).alias("ndcg"))


@dataclass(frozen=True)
class Measure:
    """A named value of each query: ``of`` takes a run (qid, docno, rank, ...) and qrels and gives (qid, value). ``measure @ k`` is the same of the first k hits."""

    name: str
    of: Callable[[DataFrame, DataFrame], DataFrame]

    def __matmul__(self, k: int) -> Measure:
        own = self.of
        return Measure(f"{self.name}@{k}", lambda run, qrels: own(run.where(F.col("rank") < k), qrels))


def ils_measure(vectors: DataFrame, name: str = "ils") -> Measure:
    """Intra-list similarity by stored vectors (docno, doc_vec): the mean cosine of the pairs of a query's hits; 0 for a single hit. It needs no qrels."""
    known = vectors.select("docno", "doc_vec")
    return Measure(name, lambda run, qrels: ils(run.select("qid", "docno", "rank").join(known, "docno")).select("qid", F.col("ils").alias("value")))


def experiment(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 10, more: Sequence[Measure] = ()) -> DataFrame:
    """(run, qid, measures...) of several runs; ``more`` measures follow under their names, 0 for queries without a hit."""
    out = None
    for name, run in runs.items():
        part = measures(run, qrels, k)
        for m in more:
            part = part.join(m.of(run, qrels).select("qid", F.col("value").alias(m.name)), "qid", "left").fillna(0.0, [m.name])
        part = part.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def fingerprint(what: str, *tables: DataFrame) -> str:
    """A name for a pipeline over tables: its description, and paths, sizes and times of all files that the tables read. Nothing is read but the listing.

    A table that reads no file, such as one of the driver's rows, counts by its rows' hashes.
    """
    h = hashlib.sha256(what.encode())
    for t in tables:
        spark, files = t.sparkSession, sorted(t.inputFiles())
        h.update(json.dumps(t.dtypes).encode())
        for f in files:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
            h.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
        if not files:
            x = F.xxhash64(*t.columns)
            h.update(repr(tuple(t.agg(F.count("*"), F.bit_xor(x), F.sum(x.cast("decimal(38,0)"))).first())).encode())
    return h.hexdigest()[:32]


def saved_run(root: str, what: str, tables: Sequence[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored below ``root`` under the fingerprint of ``what`` and ``tables``; where that is stored already, it is read and nothing is made.

    ``what`` names the pipeline with all its parameters; a change of it or of any file of the tables makes the run anew.
    """
    spark = tables[0].sparkSession
    path = f"{root}/{fingerprint(what, *tables)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def means(results: DataFrame) -> DataFrame:
    return results.groupBy("run").agg(*(F.avg(c).alias(c) for c in results.columns if c not in ("run", "qid")))


def paired_t(results: DataFrame, baseline: str, measure: str = "ndcg") -> DataFrame:
    """(run, n, difference, t): mean difference to the baseline over queries and its t statistic; null where the differences do not vary."""
    base = results.where(F.col("run") == baseline).select("qid", F.col(measure).alias("b"))
    d = results.where(F.col("run") != baseline).join(base, "qid").select("run", (F.col(measure) - F.col("b")).alias("d"))
    return d.groupBy("run").agg(F.count("*").alias("n"), F.avg("d").alias("difference"), F.stddev_samp("d").alias("s")).select("run", "n", "difference", (F.col("difference") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).alias("t"))
