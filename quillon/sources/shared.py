"""Tables kept between the steps of an iterated job, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        place = tempfile.mkdtemp(prefix="spark-quillon-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that no table has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


#: Folders of kept tables that are still there, by the DataFrame that reads them.
_PLACES: dict[int, tuple[DataFrame, str]] = {}


def kept(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written and read again, which cuts its lineage and survives lost executors. The folder goes by ``dropped``, or when the driver ends.

    ``by``, the last column, gives each of its values a folder of its own.
    """
    place = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(place)
    atexit.register(removed, df.sparkSession, place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    _PLACES[id(out)] = (out, place)
    return out


def backed(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which reads the ``kept`` table: dropping ``df`` drops the table's folder."""
    _PLACES[id(df)] = (df, _PLACES.pop(id(table))[1])
    return df


def dropped(*tables: DataFrame | None) -> None:
    """Removes the folders of ``kept`` tables from which nothing will be read again; other tables are left alone."""
    for table in tables:
        if id(table) in _PLACES:
            own, place = _PLACES.pop(id(table))
            removed(own.sparkSession, place)


def removed(spark: SparkSession, place: str) -> None:
    """Deletes a folder; nothing is left to delete once the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
