"""Line dedup by overlapping three-line windows (operator 1). DataFrame functions only.

Each run of ``WINDOW`` consecutive lines is a window, known by 128 bits of hash. A window that occurs more
than once anywhere keeps its first occurrence, by (id, text's hash, line); the lines that any later occurrence
covers are removed. Covered positions of overlapping windows merge, so each line goes once.

Semantics. Lines are what newlines separate, trailing carriage returns aside; no other change. Texts of fewer
lines than a window have none and stay. Null texts stay null, empty ones empty; a text all of whose lines go
becomes empty, its row stays. Rows that agree in id and text are one occurrence and are treated alike; rows
without id are ordered before the others. Other columns, whatever their names, pass through unchanged.

Scale. Window hashes are counted by partial aggregation before the shuffle, so a window that a third of all
rows hold is one row from each task. Only windows that repeat are joined back, by a join that splits skewed
keys, and then only the places of removed lines go to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

WINDOW = 3


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def windows_of(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """__id, __t (text's hash), i (first line, from 0), h1, h2 (the window's hash)."""
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__t"), F.transform(lines_of(text_col), lambda x: F.rtrim(x, F.lit("\r"))).alias("ls"))
    at = F.sequence(F.lit(0), F.size("ls") - window)
    hashed = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get("ls", i + k) for k in range(window)]).alias("h1"), F.xxhash64(F.lit(1), *[F.get("ls", i + k) for k in range(window)]).alias("h2")))
    return keyed.filter(F.size("ls") >= window).select("__id", "__t", F.posexplode(hashed).alias("i", "h")).select("__id", "__t", "i", "h.h1", "h.h2")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """__id, __t, starts: first lines of the windows that occurred before."""
    w = windows_of(docs, id_col, text_col, window)
    place = F.struct("__id", "__t", "i")
    # Written out, so that the join below reads both sides straight from an exchange and can split a skewed key.
    repeated = checkpoint(w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("h1", "h2", "first"))
    later = w.join(repeated, ["h1", "h2"]).filter(F.struct("__id", "__t", "i") != F.col("first"))
    return later.groupBy("__id", "__t").agg(F.sort_array(F.collect_set("i")).alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = False) -> DataFrame:
    """The table with the repeated lines taken out of ``text_col``; with ``counts`` also n_lines and n_removed."""
    starts = removed_lines(docs, id_col, text_col, window)
    names = docs.columns
    src = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    joined = src.join(starts, F.col(ident).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__t")), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    # Texts that lose nothing are neither split nor copied; their lines are counted by their newlines.
    kept = joined.withColumn("ls", F.when(F.col("starts").isNotNull(), lines_of(text))).withColumn("gone", F.when(F.col("starts").isNotNull(), covered))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    # array_except hashes the covered places: the time is linear in the lines, however many are covered.
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone")
    clean = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("ls", i)), "\n"))
    out = [clean.alias(c) if c == text_col else F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    if counts:
        out += [F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return kept.select(*out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, counts=True)


OP1_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, rtrim(ls[i], chr(13)) || chr(10) || rtrim(ls[i + 1], chr(13)) || chr(10) || rtrim(ls[i + 2], chr(13)) AS h
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM r WHERE k > 1) GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN g.gone IS NULL THEN l.text ELSE array_to_string([x FOR x, i IN ls IF NOT list_contains(gone, i)], chr(10)) END AS text,
       (CASE WHEN l.text IS NULL THEN 0 ELSE len(ls) END)::BIGINT AS n_lines, coalesce(len(g.gone), 0)::BIGINT AS n_removed
FROM l LEFT JOIN g USING (doc_id)
"""
