"""The changelog: one line for each operation, parsed, checked and rendered as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OPERATIONS

# The form of a line, and what stands in an empty log.
LINE = r"^(?:- )?(\d{4}-\d{2}-\d{2}) \[([^\]]*)\] \[([^\]]*)\]: (.*)$"
EMPTY = "No operations yet."


def format_line(date: Column, operation: Column, actor: Column, reason: Column) -> Column:
    return F.format_string("- %s [%s] [%s]: %s", date, operation, actor, reason)


def parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """date, operation, actor, reason, fault of each line that is an entry; blank lines, headings and the empty mark are skipped."""
    t = F.trim(F.col(col))
    rows = lines.filter((F.col(col) != "") & ~F.col(col).startswith("#") & (F.col(col) != EMPTY))
    parts = [F.regexp_extract(t, LINE, i) for i in range(1, 5)]
    split = rows.select(F.col(col).alias("line"), t.rlike(LINE).alias("shaped"), *[p.alias(n) for p, n in zip(parts, ("date", "operation", "actor", "reason"), strict=True)])
    return split.select("line", "date", "operation", "actor", "reason", F.when(~F.col("shaped"), "not a changelog line").otherwise(fault()).alias("fault"))


def fault() -> Column:
    """What is wrong with columns date, operation, actor, reason; null if nothing."""
    return (
        F.when(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNull(), "date must be YYYY-MM-DD")
        .when(~F.col("operation").isin(*OPERATIONS), "operation is not supported")
        .when((F.trim("actor") == "") | F.col("actor").rlike(r"[\]\r\n]"), "actor is missing or holds ] or a line break")
        .when(F.trim("reason") == "", "reason is required")
        .when(F.col("reason").rlike(r"[\r\n]"), "reason must be one line")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def render(entries: list[tuple[str, str, str, str]]) -> str:
    """A changelog's whole text from (date, operation, actor, reason)."""
    return "# Changelog\n\n" + ("".join(f"- {d} [{o}] [{a}]: {r}\n" for d, o, a, r in entries) or f"{EMPTY}\n")
