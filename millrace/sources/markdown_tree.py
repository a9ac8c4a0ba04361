"""A corpus from a tree of Markdown files: sources/**/*.md and wiki/**/*.md under a root that Spark can read.

Files are read as bytes (``binaryFile``), parsed once in Arrow batches on the executors, and turned into the five
tables. Files that can't be parsed don't stop the read: they are rows of ``errors``.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..functions import text as X
from ..functions.sections import with_sections
from ..operators.corpus import Corpus, resolve_links

#: Files that a task holds parsed at once.
FILES = 64
_S = T.StringType()
_SECTION = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("heading", _S), T.StructField("anchor", _S), T.StructField("level", T.IntegerType()), T.StructField("body", _S)])
_REF = T.StructType([T.StructField("path", _S), T.StructField("anchor", _S)])
_STRINGS = T.ArrayType(_S)
PARSED = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("path", _S), ("kind", _S), ("error", _S), ("faults", _STRINGS), ("id", _S), ("title", _S), ("summary", _S), ("tags", _STRINGS), ("sources", _STRINGS), ("links", _STRINGS), ("modified_date", _S),
        ("hash", _S), ("sum_hash", _S), ("size_bytes", T.LongType()), ("body", _S), ("first_h1", _S), ("has_sources", T.BooleanType()), ("body_links", _STRINGS), ("body_sources", _STRINGS), ("anchors", _STRINGS),
        ("sections", T.ArrayType(_SECTION)), ("link_refs", T.ArrayType(_REF)), ("source_refs", T.ArrayType(_REF)), ("citations", T.ArrayType(_REF)),
    )]
)


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (from the root on), length, content of all regular files under the three content directories."""
    full = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/{r}" for r in existing(spark, root)])
    base = root.rstrip("/").split("/")[-1]
    path = F.regexp_extract(F.expr("url_decode(replace(path, '+', '%2B'))"), f"/{re.escape(base)}/((?:sources|wiki|assets)/.*)$", 1)
    return full.select(path.alias("path"), "length", *(["content"] if content else []))


def existing(spark: SparkSession, root: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for r in ("sources", "wiki", "assets"):
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{r}")
        if p.getFileSystem(conf).exists(p) and p.getFileSystem(conf).listFiles(p, True).hasNext():
            found.append(r)
    if not found:
        raise FileNotFoundError(f"no sources, wiki or assets under {root}")
    return found


def linked(spark: SparkSession, root: str) -> DataFrame:
    """path of the Markdown files that are symbolic links or lie behind one; other stores than plain folders have no links."""
    f = files(spark, root, content=False).filter(F.lower("path").endswith(".md")).select("path")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return f.limit(0)
    base = top.toUri().getPath()

    def run(batches):
        real: dict[str, bool] = {}  # folders that are no links

        def link(path: str) -> bool:
            folder = path.rpartition("/")[0]
            if folder and folder not in real:
                real[folder] = not link(folder)
            return bool(folder) and not real[folder] or os.path.islink(f"{base}/{path}")

        for b in batches:
            yield b.filter(pa.array([link(p) for p in b.column(0).to_pylist()], pa.bool_()))

    return f.mapInArrow(run, "path string")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, length, content of the Markdown files; one that isn't a regular file is an error."""
    if (bad := linked(spark, root).first()) is not None:
        raise M.MarkdownError(f"{bad['path']} is not a regular file")
    f = files(spark, root).filter(F.lower("path").endswith(".md") & ~F.col("path").startswith("assets/"))
    return f.withColumn("kind", X.kind_of(F.col("path")))


def asset_files(spark: SparkSession, root: str) -> DataFrame:
    """path and title (the file's name); contents aren't read."""
    f = files(spark, root, content=False).filter(F.col("path").startswith("assets/"))
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("title"), "length")


def parse_file(path: str, kind: str, content: bytes) -> dict:
    row: dict = {"path": path, "kind": kind, "hash": hashlib.sha256(content).hexdigest(), "sum_hash": hashlib.sha256(content.replace(b"\r\n", b"\n")).hexdigest(), "size_bytes": len(content)}
    text = content.decode("utf-8", "replace")
    try:
        front, body = M.split_front(text) if kind == "wiki" else (None, text)
        a, parts = M.analyze(path, body) if kind == "wiki" else M.Analysis(), M.sections(body)
        row |= {"body": body, "sections": [vars(s) for s in parts]}
        if kind == "wiki":
            row["faults"] = M.front_faults(front) + ([] if front is None or front.modified_date.strip() else [M.DATELESS])
            if front is not None:
                unique = lambda v: sorted({x.strip() for x in v} - {""})
                row |= {"id": front.id.strip(), "title": front.title.strip(), "summary": front.summary.strip(), "tags": unique(front.tags), "sources": unique(front.sources), "links": unique(front.links), "modified_date": front.modified_date.strip()}
            refs = lambda v: [{"path": p, "anchor": x} for p, x in v]
            row |= {"first_h1": a.first_h1, "has_sources": a.has_sources, "body_links": a.links, "body_sources": a.sources, "anchors": a.anchors, "link_refs": refs(a.link_refs), "source_refs": refs(a.source_refs), "citations": refs(a.citations)}
        else:
            row |= {"id": "source_" + hashlib.sha256(path.encode()).hexdigest()[:32], "title": M.source_title(path, text), "summary": "", "tags": [], "sources": [], "links": [], "modified_date": "", "faults": [], "anchors": sorted({s.anchor for s in parts if s.anchor})}
    except (M.MarkdownError, ValueError) as e:
        row["error"] = str(e)
    return row


def sections_of(texts: DataFrame, body: str) -> DataFrame:
    """``texts`` with the sections of a text column: made in the JVM where lines settle them, by the parser for the rest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from .ship import ship

    ship(texts.sparkSession)
    out = T.StructType([*texts.schema.fields, T.StructField("sections", T.ArrayType(_SECTION))])
    schema, place = to_arrow_schema(out), texts.columns.index(body)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.filter(b.column("settled")).columns, schema, strict=False)], schema=schema)
            rest = b.filter(pc.invert(b.column("settled")))
            made = pa.array([[vars(s) for s in M.sections(t or "")] for t in rest.column(place).to_pylist()], schema.field("sections").type)
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(rest.columns[:-2], schema, strict=False)], made], schema=schema)

    return with_sections(texts, body).select(*texts.columns, "sections", "settled").mapInArrow(run, out)


def settled_sources(markdown: DataFrame) -> DataFrame:
    """Files with ``settled``, the columns of ``PARSED`` where that holds, and their contents where it doesn't: pages, and sources that need the parser."""
    source = F.col("kind") == "source"
    told = with_sections(markdown.select("path", "kind", "content", F.when(source, F.make_valid_utf8(F.col("content").cast("string"))).alias("body")), "body")
    # Bytes that aren't UTF-8, and files without a name before the dot, are the parser's.
    settled = source & F.col("settled") & ~F.col("body").contains("\ufffd") & ~F.element_at(F.split("path", "/"), -1).startswith(".")
    headed = F.filter("sections", lambda s: s["heading"].isNotNull())
    top = F.filter(headed, lambda s: s["level"] == 1)
    title = F.coalesce(F.get(top, F.lit(0))["heading"], F.get(headed, F.lit(0))["heading"], X.title_words(X.basename(F.col("path"))))
    given = {
        "path": F.col("path"), "kind": F.col("kind"), "id": X.source_id(F.col("path")), "title": title, "summary": F.lit(""), "modified_date": F.lit(""), "hash": F.sha2("content", 256),
        "sum_hash": F.sha2(F.encode(F.replace("body", F.lit("\r\n"), F.lit("\n")), "UTF-8"), 256), "size_bytes": F.octet_length("content").cast("long"), "body": F.col("body"), "sections": F.col("sections"),
        "anchors": F.array_sort(F.array_distinct(F.transform(headed, lambda s: s["anchor"]))), **{c: F.array() for c in ("faults", "tags", "sources", "links")},
    }
    whole = told.withColumn("settled", F.coalesce(settled, F.lit(False)))
    kept = [F.when(F.col("settled"), given[f.name]).cast(f.dataType).alias(f.name) if f.name in given and f.name not in ("path", "kind") else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PARSED.fields]
    return whole.select(*kept, "settled", F.when(~F.col("settled"), F.col("content")).alias("content"))


def parse(markdown: DataFrame) -> DataFrame:
    """One row for each file; everything that is derived from a file's text is derived here, once.

    Sources whose sections lines alone settle are made in the JVM and pass through; pages, with their frontmatter and
    links, and other sources are parsed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from .ship import ship

    ship(markdown.sparkSession)
    schema = to_arrow_schema(PARSED)

    def run(batches):
        for whole in batches:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(whole.filter(whole.column("settled")).columns, schema, strict=False)], schema=schema)
            left = whole.filter(pc.invert(whole.column("settled"))).select(["path", "kind", "content"])
            # A few files at a time are decoded and parsed.
            for at in range(0, left.num_rows, FILES):
                b = left.slice(at, FILES)
                rows = [parse_file(p, k, c) for p, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return settled_sources(markdown.select("path", "kind", "content")).mapInArrow(run, PARSED)


@dataclass(frozen=True)
class Parsed:
    corpus: Corpus
    parsed: DataFrame

    @property
    def errors(self) -> DataFrame:
        return self.parsed.filter(F.col("error").isNotNull()).select("path", "error")

    def release(self) -> None:
        self.parsed.unpersist()


def corpus_of(parsed: DataFrame) -> Corpus:
    good = parsed.filter(F.col("error").isNull() & (F.size("faults") == 0))
    documents = good.select("id", "path", "kind", X.tier_of(F.col("path")).alias("tier"), "title", "summary", "tags", "sources", "links", "modified_date", "hash", "size_bytes")
    s = good.select(F.col("id").alias("document_id"), "path", F.explode("sections").alias("s"))
    sections = s.select(X.section_id(F.col("document_id"), F.col("s.ordinal")).alias("section_id"), "document_id", "path", "s.ordinal", "s.heading", "s.anchor", "s.level", "s.body")
    wiki = good.filter(F.col("kind") == "wiki")
    l = wiki.select(F.col("id").alias("from_document_id"), F.col("path").alias("from_path"), F.lit("").alias("from_anchor"), F.explode("link_refs").alias("r")).filter("r.path != from_path")  # noqa: E741
    links = resolve_links(l.select("from_document_id", "from_path", "from_anchor", F.col("r.path").alias("to_path"), F.col("r.anchor").alias("to_anchor")).withColumn("kind", X.target_kind(F.col("to_path"))).distinct(), documents)
    front = wiki.select(F.col("id").alias("document_id"), F.col("path").alias("wiki_path"), F.explode("sources").alias("source_path"), F.lit("").alias("source_anchor"), F.lit("frontmatter_source").alias("citation_kind"))
    inline = wiki.select(F.col("id").alias("document_id"), F.col("path").alias("wiki_path"), F.explode("citations").alias("r")).select("document_id", "wiki_path", F.col("r.path").alias("source_path"), F.col("r.anchor").alias("source_anchor"), F.lit("inline_source").alias("citation_kind"))
    tags = wiki.select(F.col("id").alias("document_id"), "path", F.explode("tags").alias("tag")).distinct()
    return Corpus(documents, sections, links, front.unionByName(inline).distinct(), tags)


def read_tree(spark: SparkSession, root: str) -> Parsed:
    """The tree as it is now. The parsed files are kept until ``release``, since every table reads them."""
    # What an earlier read of the same folder has kept is out of date when files have changed.
    spark.catalog.refreshByPath(root)
    parsed = parse(markdown_files(spark, root)).persist()
    return Parsed(corpus_of(parsed), parsed)


def read_corpus(spark: SparkSession, root: str) -> Corpus:
    return read_tree(spark, root).corpus
