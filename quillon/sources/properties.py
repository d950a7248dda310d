"""Versioned properties of a store: small JSON states, each committed by its writer's own success file, so a broken write leaves the one before."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

#: Versions that stay.
HELD = 2


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str, name: str = "meta") -> list[int]:
    """The numbers of the committed versions, ascending."""
    place, fs = _files(spark, f"{path}/{name}")
    if not fs.exists(place):
        return []
    found = [m for x in fs.listStatus(place) if (m := re.fullmatch(r"v(\d+)", x.getPath().getName()))]
    return sorted(int(m[1]) for m in found if fs.exists(_files(spark, f"{path}/{name}/{m[0]}/_SUCCESS")[0]))


def write_properties(spark: SparkSession, path: str, values: dict, name: str = "meta") -> int:
    """Commits a new version and drops those long replaced; its number."""
    old = versions(spark, path, name)
    new = (old[-1] if old else 0) + 1
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/v{new}")
    for v in old[: 1 - HELD] if len(old) >= HELD else []:
        place, fs = _files(spark, f"{path}/{name}/v{v}")
        fs.delete(place, True)
    return new


def read_properties(spark: SparkSession, path: str, name: str = "meta", version: int | None = None) -> dict | None:
    """The values of the last committed version, or of the given one; None where there is none."""
    found = versions(spark, path, name)
    if not found or (version is not None and version not in found):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/{name}/v{found[-1] if version is None else version}").collect()))
