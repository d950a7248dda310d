"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts in a batch that goes to Python.
TEXT_ROWS = 500
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session's setting rules; a temporary folder only where it is unset and all tasks run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        place = tempfile.mkdtemp(prefix="spark-quillon-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def remove(spark: SparkSession, place: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


#: Folders of written tables that are still there, by the DataFrame that reads them.
_PLACES: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut, and every executor sees the files.

    The folder goes when ``discard`` is called, or when the driver ends.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    atexit.register(remove, spark, place)
    out = spark.read.schema(df.schema).parquet(place)
    _PLACES[id(out)] = (out, place)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of ``written`` tables from which nothing will be read again; others are left alone."""
    for table in tables:
        if id(table) in _PLACES:
            own, place = _PLACES.pop(id(table))
            remove(own.sparkSession, place)


def short_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Sets how many rows a batch to Python has: of whole texts, Spark's 10,000 are tens of MB, held several times over. A smaller number that the session has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that no table has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def hash_sample(df: DataFrame, rows: int, total: int, *columns: str) -> DataFrame:
    """The ``rows`` rows of the smallest hashes of the columns. A threshold on the hash, set from the row count, leaves few rows to sort."""
    h = F.xxhash64(*columns)
    share = min(1.0, (2 * rows + 100) / max(1, total))
    near = df if share == 1 else df.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))
    return near.orderBy(F.pmod(h, F.lit(1 << 40)), *columns).limit(rows)


def doc_groups(batches: Iterable[pa.RecordBatch], text: str = "text", most_chars: int = 250_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches that hold about ``most_chars`` characters each (one text may be longer), with their texts; null is empty."""
    for whole in batches:
        for first in range(0, whole.num_rows, 64):  # so that no whole batch of texts is held as strings
            batch = whole.slice(first, 64)
            texts = ["" if x is None else x for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            start = size = 0
            for i, x in enumerate(texts):
                if i > start and size + len(x) > most_chars:
                    yield batch.slice(start, i - start), texts[start:i]
                    start, size = i, 0
                size += len(x)
            if len(texts) > start:
                yield batch.slice(start), texts[start:]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space, and the odd base of the word hash.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15


class WordHashes:
    """64-bit hashes of words: a polynomial in the word's bytes modulo 2**64, scrambled. All words of many texts are hashed at once."""

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(size, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64))

    def __call__(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words, between ASCII white space, of all texts in a row, and how many words each text has."""
        sizes = np.array([len(b) + 1 for b in blobs], np.int64)
        data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8) if blobs else np.zeros(0, np.uint8)
        if len(data) >= len(self.power):
            self._grow(2 * len(data))
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))  # a word begins, and the space behind it
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)])])
        words = mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        return words, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))


def shingle_sets(texts: list[str], hashes: WordHashes, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles: A-Z lower-cased, words parted by ASCII white space. Fewer words are one shingle, none give none."""
    words, counts = hashes([x.encode("utf-8", "surrogatepass").lower() for x in texts])  # of bytes: ASCII only
    width = max(0, len(words) - n + 1)
    runs = np.full(width, n, np.uint64)
    for i in range(n):
        runs = mix64(runs + words[i : i + width])
    out, at = [], 0
    for m in counts.tolist():
        if m >= n:
            own = np.sort(runs[at : at + m - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            short = np.full(min(m, 1), m, np.uint64)
            for i in range(m):
                short = mix64(short + words[at + i : at + i + 1])
            out.append(short)
        at += m
    return out


def with_text_columns(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], fields: str, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` (all by default) and new ones computed from whole texts, in one pass without a shuffle.

    ``make`` runs once per task and gives a function from texts (null as empty) to a list of arrays, one for each of ``fields``. Kept
    columns whose names clash with new ones are replaced.
    """
    new = [f.split()[0].lower() for f in fields.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), fields])
    names = [*kept, *(f.split()[0] for f in fields.split(", "))]
    body = unused("text_in", docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch, texts in doc_groups(batches, body):
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *arrays], names=names)

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias(body)).mapInArrow(work, schema)
