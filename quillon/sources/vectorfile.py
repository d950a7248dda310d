"""Vector files as a Spark data source: matrices of raw 32-bit floats, row by row in docid order, beside compact lists of docnos.

A file holds the consecutive docids of one writing task; a manifest, written last, says which. Reading deals the files out by byte ranges, and
bounds on docid decide which bytes are read at all. Docnos with a common beginning and numbers that rise evenly are kept as such runs.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "quillon-vector-file"
SCHEMA = "docid long, docno string, doc_vec array<float>"
#: Bytes of a range that a task reads, about, and rows of a batch.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 4096


def place_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def compact(names: Sequence[str]) -> dict:
    """Names as a common prefix and runs of [first number, step, count, digits], in order; as they are where one has another form."""
    if not names:
        return {"names": []}
    low, high = min(names), max(names)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    prefix = re.sub(r"[0-9]*\Z", "", low[:n])  # digits belong to the numbers
    rests = [x[len(prefix) :] for x in names]
    if not all(re.fullmatch(r"[0-9]{1,18}", x) for x in rests):
        return {"names": list(names)}
    runs: list[list[int]] = []
    for x in rests:
        number, digits = int(x), len(x) if x[0] == "0" and len(x) > 1 else 0  # fixed digits where a number begins with 0
        if runs:
            first, step, count, width = runs[-1]
            fits = width == digits or (width == len(x) and digits == 0)
            if fits and (count == 1 or number == first + step * count):
                runs[-1] = [first, number - first if count == 1 else step, count + 1, width]
                continue
        runs.append([number, 0, 1, digits])
    out = {"prefix": prefix, "runs": runs}
    return out if list(expanded(out)) == list(names) else {"names": list(names)}


def expanded(held: dict, start: int = 0, stop: int | None = None) -> Iterator[str]:
    """The names at the places from ``start`` to before ``stop``."""
    if "names" in held:
        yield from held["names"][start:stop]
        return
    at = 0
    for first, step, count, digits in held["runs"]:
        for i in range(max(0, start - at), count if stop is None else max(0, min(count, stop - at))):
            yield held["prefix"] + str(first + step * i).zfill(digits)
        at += count


@dataclass
class Written(WriterCommitMessage):
    file: str
    first: int
    count: int
    size: int


@dataclass
class Range(InputPartition):
    file: str
    first: int
    start: int
    stop: int
    size: int

    def __init__(self, file: str, first: int, start: int, stop: int, size: int) -> None:
        self.file, self.first, self.start, self.stop, self.size = file, first, start, stop, size


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        high = self.options.get("stop")
        return Reader(self.options["path"], int(self.options.get("start", 0)), None if high is None else int(high))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str, low: int = 0, high: int | None = None) -> None:
        self.path, self.low, self.high = path, low, high

    def partitions(self) -> list[Range]:
        fs, root = place_of(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as s:
            manifest = json.loads(s.read())
        if manifest["format"] != FORMAT:
            raise ValueError(f"{self.path} holds {manifest['format']}")
        rows = max(1, RANGE_BYTES // max(1, 4 * manifest["size"]))
        out = []
        for file, first, count in manifest["files"]:
            low, high = max(0, self.low - first), count if self.high is None else min(count, self.high - first)
            out += [Range(file, first, a, min(a + rows, high), manifest["size"]) for a in range(low, high, rows)]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.stop:
            return
        fs, root = place_of(self.path)
        with fs.open_input_stream(f"{root}/{part.file}.docnos") as s:
            held = json.loads(s.read())
        names = expanded(held, part.start, part.stop)
        with fs.open_input_file(f"{root}/{part.file}.f4") as f:
            for a in range(part.start, part.stop, BATCH_ROWS):
                n = min(BATCH_ROWS, part.stop - a)
                flat = np.frombuffer(f.read_at(4 * part.size * n, 4 * part.size * a), "<f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.size), pa.array(flat))
                docnos = [next(names) for _ in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(part.first + a + np.arange(n)), pa.array(docnos, pa.string()), vectors], names=["docid", "docno", "doc_vec"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of this task's rows, which must be consecutive docids with vectors of one size."""
        fs, root = place_of(self.path)
        fs.create_dir(root, recursive=True)
        file, first, count, size, names, out = uuid.uuid4().hex, 0, 0, 0, [], None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                ids = batch.column("docid").to_numpy()
                vectors = batch.column("doc_vec")
                sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
                first, size = (int(ids[0]), int(sizes[0])) if out is None else (first, size)
                if len(sizes) != 1 or sizes[0] != size or (ids != first + count + np.arange(len(ids))).any():
                    raise ValueError("rows of a file need consecutive docids, in order, and vectors of one size")
                out = fs.open_output_stream(f"{root}/{file}.f4") if out is None else out
                out.write(np.asarray(vectors.flatten()).astype("<f4").tobytes())
                names += batch.column("docno").to_pylist()
                count += len(ids)
        finally:
            if out is not None:
                out.close()
        if count:
            with fs.open_output_stream(f"{root}/{file}.docnos") as s:
                s.write(json.dumps(compact(names)).encode())
        return Written(file, first, count, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = place_of(self.path)
        done = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        if len({m.size for m in done}) > 1 or any(a.first + a.count != b.first for a, b in zip(done, done[1:], strict=False)):
            raise ValueError("files of vectors of different sizes, or docids with gaps between them")
        old = []
        if fs.get_file_info(f"{root}/manifest.json").type == pyarrow.fs.FileType.File:
            if not self.overwrite:
                raise FileExistsError(self.path)
            with fs.open_input_stream(f"{root}/manifest.json") as s:
                old = json.loads(s.read())["files"]
        manifest = {"format": FORMAT, "size": done[0].size if done else 0, "count": sum(m.count for m in done), "files": [[m.file, m.first, m.count] for m in done]}
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.new") as s:
            s.write(json.dumps(manifest).encode())
        fs.move(f"{root}/manifest.new", f"{root}/manifest.json")
        for file, *_ in old:
            for end in ("f4", "docnos"):
                fs.delete_file(f"{root}/{file}.{end}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = place_of(self.path)
        for m in messages:
            for end in ("f4", "docnos"):
                if m and fs.get_file_info(f"{root}/{m.file}.{end}").type == pyarrow.fs.FileType.File:
                    fs.delete_file(f"{root}/{m.file}.{end}")


def write_vector_file(vectors: DataFrame, path: str, mode: str = "create") -> None:
    """Write (docid, docno, doc_vec) with dense docids as vector files. ``create`` fails where there are some, ``overwrite`` replaces them once the new ones are there."""
    vectors.sparkSession.dataSource.register(VectorFiles)
    rows = vectors.select(F.col("docid").cast("long").alias("docid"), F.col("docno").cast("string").alias("docno"), F.col("doc_vec").cast("array<float>").alias("doc_vec"))
    rows.repartitionByRange("docid").sortWithinPartitions("docid").write.format(FORMAT).mode({"create": "append", "overwrite": "overwrite"}[mode]).save(path)


def read_vector_file(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """(docid, docno, doc_vec) of docids from ``start`` to before ``stop``, of which no other byte range is read.

    The bounds are options of the source, not filters pushed into it: Spark keeps what was pushed into a Python source with the frame, and
    would apply it again when the same frame is next read without a filter.
    """
    spark.dataSource.register(VectorFiles)
    bounds = {k: str(v) for k, v in (("start", start), ("stop", stop)) if v is not None}
    return spark.read.format(FORMAT).options(**bounds).load(path)
