"""Incremental corpora: a stream of Markdown files keeps a table of parsed documents up to date.

The file source finds new files; each micro-batch parses what arrived and appends it with its batch number; readers
take the newest row of a path. Deletions are not events of a file stream: scans (``streaming.scans``) find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.markdown_tree import PARSED, parse

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """The stream of files under ``root``: path from the content directories on, kind, content."""
    s = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    path = F.regexp_extract("path", r"/((?:sources|wiki)/[^/].*)$", 1)
    return s.select(path.alias("path"), X.kind_of(path).alias("kind"), "content").filter(F.col("kind").isin("source", "wiki"))


def refresh(spark: SparkSession, root: str, target: str, state: str) -> None:
    """Processes all files that have arrived since the last call; ``state`` is the stream's checkpoint folder."""

    def write(batch: DataFrame, number: int) -> None:
        # Repeating a batch after a failure writes the same partition again.
        parse(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    arrivals(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of each path."""
    t = spark.read.schema(T.StructType([*PARSED.fields, T.StructField("batch", T.LongType())])).parquet(target)
    return t.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("batch"), "hash"))).filter("k = 1").drop("k", "batch")


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type; rows later than the watermark are left out of open state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
