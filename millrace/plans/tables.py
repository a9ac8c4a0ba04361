"""Tables that change by files: an upsert, a delete or a cascade rewrites the files that hold touched keys and no others.

A table is a folder of Parquet files and a pointer that names the ones that count, so a reader sees one state whatever is
written beside it. A change finds its files by the key column alone (``_metadata.file_path`` of the rows whose keys are
touched), writes their rows anew next to them, and moves the pointer last; a failure before that changes nothing. Files
that nobody names any more stay until ``vacuum``. One writer at a time: a pointer that has moved meanwhile is an error.
What reaches the driver is names of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import snapshot as D
from .freshness import _fs, point, stored


@dataclass(frozen=True)
class Change:
    """Names of the files that a change has rewritten, those that it has written, and those that it has left alone."""

    rewritten: list[str]
    written: list[str]
    kept: list[str]


def short(file: str) -> str:
    """A file's folder and name: unique within a table."""
    return "/".join(file.rsplit("/", 2)[1:])


def written(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    folder = f"{path}/f_{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    fs, p = _fs(spark, folder)
    return sorted(short(str(x.getPath())) for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet"))


def create(spark: SparkSession, rows: DataFrame, path: str, key: str = "path") -> list[str]:
    """A new table, sorted by key over its files, so that keys that change together share few of them."""
    if stored(spark, path) is not None:
        raise ValueError(f"there is a table at {path}")
    files = written(spark, path, rows.repartitionByRange(key).sortWithinPartitions(key))
    point(spark, path, {"version": 0, "schema": rows.schema.json(), "files": files})
    return files


def state(spark: SparkSession, path: str) -> dict:
    s = stored(spark, path)
    if s is None:
        raise ValueError(f"there is no table at {path}")
    return s


def scan(spark: SparkSession, path: str, s: dict, files: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(s["schema"]))
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files])


def read(spark: SparkSession, path: str) -> DataFrame:
    s = state(spark, path)
    return scan(spark, path, s, s["files"])


def holding(spark: SparkSession, path: str, s: dict, keys: DataFrame, key: str) -> list[str]:
    """The files with any of some keys: only the key column is read, only names come back."""
    if not s["files"]:
        return []
    rows = scan(spark, path, s, s["files"]).select(key, F.col("_metadata.file_path").alias("__file"))
    return sorted(short(r[0]) for r in rows.join(keys.select(key).distinct(), key, "left_semi").select("__file").distinct().collect())


def changed(spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], key: str = "path") -> Change:
    """``change`` gets the rows of the files that hold ``keys`` and gives what takes their place; it may add rows."""
    s = state(spark, path)
    old = holding(spark, path, s, keys, key)
    names = scan(spark, path, s, []).columns
    new = written(spark, path, change(scan(spark, path, s, old)).select(*names))
    kept = [f for f in s["files"] if f not in set(old)]
    if state(spark, path)["version"] != s["version"]:
        raise RuntimeError(f"{path} has been changed by another writer")
    point(spark, path, {**s, "version": s["version"] + 1, "files": kept + new})
    return Change(old, new, kept)


def upsert(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None, key: str = "path") -> Change:
    """``rows`` in place of those with the same key, and none of the keys of ``gone``. Rows with a null key replace nothing."""
    keys = rows.select(key) if gone is None else rows.select(key).unionAll(gone.select(key))
    return changed(spark, path, keys, lambda old: D.upsert(old, rows, gone, key), key)


def cascade(spark: SparkSession, path: str, target: str, today: str) -> Change:
    """Deletes a document and what hangs on it, as ``snapshot.cascade_plan`` says."""
    plan = D.cascade_plan(read(spark, path), target)
    return changed(spark, path, plan, lambda old: D.apply_cascade(old, plan, today))


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes files that the table no longer names; how many there were."""
    used, n = set(state(spark, path)["files"]), 0
    fs, top = _fs(spark, path)
    for folder in fs.listStatus(top):
        if folder.isDirectory() and folder.getPath().getName().startswith("f_"):
            inside = [x.getPath() for x in fs.listStatus(folder.getPath())]
            data = [p for p in inside if p.getName().endswith(".parquet")]
            gone = [p for p in data if short(str(p)) not in used]
            for p in [folder.getPath()] if len(gone) == len(data) else gone:
                fs.delete(p, True)
            n += len(gone)
    return n
