"""What the operators share: reading tables, Arrow batches, checkpoints, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.cut import checkpoint
from ..sources.ship import ship

__all__ = ["BATCH_ROWS", "LOWER_ASCII", "checkpoint", "crc_of_id", "map_texts", "scan_parts", "ship", "small_batches", "table"]

#: Rows of an Arrow batch at most. Texts may be long, so a batch is short.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for the memory of a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def crc_of_id(col: str | Column) -> Column:
    """crc32 of an id written as text: the folds of training and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))


LOWER_ASCII = {i: i + 32 for i in range(65, 91)}


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], out: T.StructType, keep: Iterable[str] | None = None) -> DataFrame:
    """Adds the columns ``out`` to the columns ``keep`` of ``df`` by a function of its whole texts.

    ``make()`` runs once in each task and gives a function from a list of texts (null stays None)
    to one list of values for each field of ``out``. No shuffle; a batch of rows at a time is in memory.
    Columns are told apart by place, so ``df`` may have any names. Of a column of ``df`` with the name of
    a new one the new one stays.
    """
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    new = set(out.names)
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    src = df.select(F.col(text).cast("string").alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + list(out.fields))
    types, names = [to_arrow_type(f.dataType) for f in out.fields], [f.name for f in schema.fields]

    def run(batches):
        fn = make()
        for b in batches:
            made = fn(b.column(0).to_pylist())
            cols = [b.column(i + 1) for i in range(len(keep))] + [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def scan_parts(df: DataFrame) -> int:
    """Tasks of the scan: the measure of the input from which bucket counts are derived."""
    return max(1, df.rdd.getNumPartitions())
