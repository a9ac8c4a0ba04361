"""Materialised views of a corpus: index trees, tag registry, checksum manifest, index manifest and freshness.

A view is a DataFrame of ordered lines; files are rendered from it on the driver, as they are small texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.corpus import Corpus

# Versions that the index manifest records.
SCHEMA_VERSION, INDEXER_VERSION, SECTIONS_VERSION = 3, 1, 1


def display_title(title: Column, first_h1: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(first_h1), F.lit("")), X.title_words(X.basename(path)))


def tree_lines(files: DataFrame, root: str) -> DataFrame:
    """line and key of a directory tree of ``files`` (path, title, and perhaps sources: array of (title, path)).

    Each directory is one line, found by a distinct of path prefixes; the key orders a directory before a file of the
    same name. Sorting by the key gives the tree; no tree is built.
    """
    parts = F.split(F.regexp_replace("path", f"^{root}", ""), "/")
    f = files.filter(F.col("path").startswith(root)).withColumn("parts", parts).withColumn("depth", F.size("parts") - 1)
    # A key is the names with a mark of their kind: names compare first, and 0 (directory) before 1 (file).
    mark = lambda names: F.array_join(F.transform(names, lambda x: F.concat(x, F.lit("\x01" + "0"))), "\x02")
    dirs = F.slice("parts", 1, F.col("depth"))
    leaf = F.concat(F.element_at("parts", -1), F.lit("\x01" + "1"))
    key = F.when(F.col("depth") > 0, F.concat(mark(dirs), F.lit("\x02"), leaf)).otherwise(leaf)
    own = f.select(key.alias("key"), F.lit(0).alias("sub"), F.concat(F.expr("repeat('  ', depth)"), F.lit("- ["), "title", F.lit("]("), "path", F.lit(")")).alias("line"))
    up = f.filter("depth > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: F.slice("parts", 1, n))).alias("d")).distinct()
    folders = up.select(mark(F.col("d")).alias("key"), F.lit(0).alias("sub"), F.concat(F.expr("repeat('  ', size(d) - 1)"), F.lit("- "), F.element_at("d", -1), F.lit("/")).alias("line"))
    out = own.unionByName(folders)
    if "sources" in files.columns:
        cited = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("["), s["title"], F.lit("]("), s["path"], F.lit(")"))), ", ")
        out = out.unionByName(f.filter(F.size("sources") > 0).select(key.alias("key"), F.lit(1).alias("sub"), F.concat(F.expr("repeat('  ', depth)"), F.lit("  - Sources: "), cited).alias("line")))
    return out


def wiki_files(corpus: Corpus) -> DataFrame:
    """path, title, sources (title, path) of the wiki pages."""
    titles = corpus.documents.select(F.col("path").alias("source_path"), F.col("title").alias("source_title"))
    cited = corpus.wiki.select("path", F.explode("sources").alias("source_path")).join(titles, "source_path", "left")
    per = cited.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("source_path").alias("path"), F.coalesce("source_title", X.title_words(X.basename(F.col("source_path")))).alias("title")))).alias("sources"))
    return corpus.wiki.select("path", "title").join(per, "path", "left").withColumn("sources", F.coalesce("sources", F.expr("cast(array() as array<struct<path:string,title:string>>)")))


def index_tree(corpus: Corpus) -> DataFrame:
    return tree_lines(wiki_files(corpus), "wiki/")


def sources_tree(corpus: Corpus) -> DataFrame:
    return tree_lines(corpus.documents.filter(F.col("kind") == "source").select("path", "title"), "sources/")


def tag_registry(corpus: Corpus) -> DataFrame:
    return corpus.tags.groupBy("tag").agg(F.count("*").alias("pages"))


def checksum_lines(pages: DataFrame, content: str = "content") -> DataFrame:
    """path and line of the checksum manifest; line ends are normalised before hashing."""
    clean = F.regexp_replace(F.col(content).cast("string"), "\r\n", "\n")
    return pages.select("path", F.concat("path", F.lit(" sha256:"), F.sha2(clean, 256)).alias("line"))


def in_order(rows: DataFrame, *texts: str, key: str = "path", least: int = 1 << 20):
    """For each of the columns ``texts`` their values in the order of ``key``, joined in chunks of ``least`` characters or more.

    Partitions are ranges of the key, sorted on the executors; the driver holds one partition's chunks at a time.
    """

    def run(batches):
        held, size = [[] for _ in texts], 0
        for b in batches:
            for k in range(len(texts)):
                held[k] += b.column(k).to_pylist()
            size += sum(map(len, held[0][-b.num_rows :]))
            if size >= least:
                yield pa.RecordBatch.from_arrays([pa.array(["".join(h)], pa.string()) for h in held], names=list(texts))
                held, size = [[] for _ in texts], 0
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(h)], pa.string()) for h in held], names=list(texts))

    sorted_ = rows.repartitionByRange(key).sortWithinPartitions(key)
    return sorted_.select(*texts).mapInArrow(run, ", ".join(f"{t} string" for t in texts)).toLocalIterator()


def manifest(corpus: Corpus) -> DataFrame:
    """One row: the hash of the index manifest, the hash of the path list, and the number of files.

    A manifest is one text over all paths in order, and its hash a fold from the first byte to the last: the lines are
    made and sorted on the executors and stream through the driver in chunks.
    """
    head = f"schema_version={SCHEMA_VERSION}\nindexer_version={INDEXER_VERSION}\nmarkdown_sections_version={SECTIONS_VERSION}\n"
    line = F.concat(F.lit("path="), "path", F.lit(" hash="), "hash", F.lit(" size="), F.col("size_bytes").cast("string"), F.lit("\n"))
    rows = corpus.documents.select("path", line.alias("line"), F.concat("path", F.lit("\n")).alias("paths"))
    whole, paths, files = hashlib.sha256(head.encode()), hashlib.sha256(), 0
    for r in in_order(rows, "line", "paths"):
        whole.update(r["line"].encode())
        paths.update(r["paths"].encode())
        files += r["paths"].count("\n")
    return rows.sparkSession.createDataFrame([(whole.hexdigest(), paths.hexdigest(), files)], "manifest_hash string, paths_hash string, files long")


def status(stored: dict | None, current: dict) -> tuple[str, str]:
    """fresh, stale, missing or incompatible, and why. Both are maps of the index's recorded values."""
    if not stored:
        return "missing", "there is no index"
    for key in ("schema_version", "indexer_version", "markdown_sections_version"):
        if str(stored.get(key)) != str(current.get(key)):
            return ("incompatible" if key == "schema_version" else "stale"), f"{key} is {stored.get(key)}, not {current.get(key)}"
    for key in ("paths_hash", "manifest_hash"):
        if stored.get(key) != current.get(key):
            return "stale", f"{key} differs"
    return "fresh", ""


def versions() -> dict:
    return {"schema_version": SCHEMA_VERSION, "indexer_version": INDEXER_VERSION, "markdown_sections_version": SECTIONS_VERSION}


def changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two tables of path and hash: what an incremental refresh reads."""
    both = stored.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def line_diff(left: DataFrame, right: DataFrame, limit: int = 5, key: tuple[str, ...] = ()) -> DataFrame:
    """key, n, left, right: the first lines in which two texts (one row for each key, column text) differ."""
    lines = lambda df, name: df.select(*key, F.posexplode(F.split("text", "\n", -1)).alias("n", name))
    both = lines(left, "left").join(lines(right, "right"), [*key, "n"], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    return both.select(*key, (F.col("n") + 1).alias("n"), "left", "right").orderBy(*key, "n").limit(limit)


def render(lines: DataFrame, title: str, note: str, empty: str) -> str:
    rows = [r["line"] for r in lines.orderBy("key", "sub").select("line").toLocalIterator()]
    return f"# {title}\n\n{note}\n\n" + ("\n".join(rows) if rows else empty) + "\n"
