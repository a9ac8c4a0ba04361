"""Freshness as a stream: successive scans of a corpus in, added, changed and removed paths out.

A scan is a listing (path, hash) with a number, written to a folder whose files a stream follows; its last row, written
when all others are there, ends it. Scans are numbered one by one; one that failed is written again under its number. The
state has one row for each path, its hash and the number of the scan that saw it last, spread by path over the state
store's partitions. A path that the next scan hasn't seen when that scan ends is removed: its timer runs on the clock of
scans, not on the time of day. What comes out doesn't depend on how scans fall into micro-batches, and a stream that is
started again from its checkpoint repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.freshness import _fs
from ..sources.ship import ship

LISTING = "scan long, path string, hash string"
EVENTS = "path string, change string, scan long"

# The clock: rows of scan s are at 2s seconds, its end is at 2s + 1, and the watermark is half a second behind. So rows of
# a scan are never late in a later batch of the same scan, and a timer at 2s + 2 fires when scan s + 1 has ended.


def clock(scan, end) -> F.Column:
    return F.timestamp_seconds(2 * scan + F.when(end, 1).otherwise(0))


def due(scan: int) -> int:
    return (2 * scan + 2) * 1000


def publish(rows: DataFrame, folder: str, scan: int) -> None:
    """Writes scan number ``scan`` of ``rows`` (path, hash); rows without a path are left out. A scan that has ended stays as it is."""
    spark = rows.sparkSession
    done = f"{folder}/scan-{scan:09d}-end"
    fs, p = _fs(spark, done)
    if fs.exists(p):
        raise ValueError(f"scan {scan} has ended")
    number = F.lit(scan).cast("long").alias("scan")
    rows.filter("path IS NOT NULL").select(number, "path", "hash").write.parquet(f"{folder}/scan-{scan:09d}-{uuid.uuid4().hex}")
    spark.range(1).select(number, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("hash")).write.parquet(done)


def seen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A path's events: from the scans that saw it in this batch, or from the end of one that didn't."""
    (path,) = key
    if path is None:  # ends of scans only move the clock
        return
    if state.hasTimedOut:
        _, last = state.get
        state.remove()
        yield pd.DataFrame({"path": [path], "change": ["removed"], "scan": [last + 1]})
        return
    rows = sorted({(int(s), None if pd.isna(h) else h) for p in parts for s, h in zip(p["scan"], p["hash"])}, key=lambda r: (r[0], r[1] or ""))
    old, last = state.get if state.exists else (None, None)
    out = []
    for scan, new in rows:
        if last is not None and scan < last:
            continue
        if last is not None and scan > last + 1:  # absent from scans that have ended meanwhile
            out.append(("removed", last + 1))
            last = None
        if last is None:
            out.append(("added", scan))
        elif new != old:
            out.append(("changed", scan))
        old, last = new, scan
    state.update((old, last))
    state.setTimeoutTimestamp(due(last))
    if out:
        yield pd.DataFrame({"path": path, "change": [c for c, _ in out], "scan": [s for _, s in out]})


def events(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The stream of events of all scans in ``folder``; ``files`` bounds the files of one micro-batch."""
    ship(spark)
    reader = spark.readStream.schema(LISTING).option("recursiveFileLookup", True)
    s = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    timed = s.withColumn("at", clock(F.col("scan"), F.col("path").isNull())).withWatermark("at", "500 milliseconds")
    return timed.groupBy("path").applyInPandasWithState(seen, EVENTS, "hash string, scan long", "append", GroupStateTimeout.EventTimeTimeout)


def follow(spark: SparkSession, folder: str, target: str, state: str, files: int | None = None) -> DataFrame:
    """Appends the events of all scans that are new since the last call to the table at ``target``, which is returned; ``state`` is the stream's checkpoint folder."""
    events(spark, folder, files).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(EVENTS).parquet(target)
