"""Imports of foreign files as Markdown sources: text, Markdown and HTML; selection by name, target paths."""

from __future__ import annotations

import fnmatch
import html
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ship import ship

EXTENSIONS = (".md", ".markdown", ".mdx", ".txt", ".html", ".htm", ".docx")
#: Files that a task holds at once, and bytes of a document that are parsed at once.
FILES, CHUNK = 64, 1 << 20


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def target_path(name: Column, key: Column) -> Column:
    """Where an import goes: a readable name and the first ten digits of its key's hash."""
    return F.concat(F.lit("sources/"), slug(name), F.lit("-"), F.substring(F.sha2(key, 256), 1, 10), F.lit(".md"))


def relative_target(rel: Column, mtime: Column | None = None, prefix: str = "sources") -> Column:
    """Where a file goes: its folders and name in readable form, its time where versions are kept apart, and the hash of its path from the imported folder on.

    The path counts from that folder, so another mount of it gives the same targets.
    """
    parts = F.split(rel, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), slug)
    name = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    file = F.concat(slug(name), *([F.lit("-"), mtime.cast("long").cast("string")] if mtime is not None else []), F.lit("-"), F.substring(F.sha2(rel, 256), 1, 10), F.lit(".md"))
    return F.concat_ws("/", F.lit(prefix.rstrip("/")), folders, file)


def title_of(rel: Column) -> Column:
    """A title from a file's name: its words, each with a capital."""
    name = F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"(.)\.[^.]*$", "$1")
    words = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ")
    return F.when(title == "", "Untitled").otherwise(title)


def selected(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, col: str = "path") -> DataFrame:
    """Files with a known extension, not hidden, that match an include pattern (if any) and no exclude pattern."""
    any_of = lambda patterns: F.col(col).rlike("|".join(re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"^(?:\1)$", fnmatch.translate(p)) for p in patterns))
    out = files.filter(F.lower(col).rlike("(" + "|".join(map(re.escape, EXTENSIONS)) + ")$") & ~F.col(col).rlike(r"(^|/)\."))
    if include:
        out = out.filter(any_of(include))
    return out.filter(~any_of(exclude)) if exclude else out


def markdown_of(page: str | None) -> tuple[str, str]:
    """(title, Markdown) of an HTML page: headings, paragraphs, lists, links, emphasis and code."""
    page = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", "", page or "")
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    title = " ".join(html.unescape(m.group(1)).split()) if m else ""
    body = re.sub(r"(?is)<head\b.*?</head\s*>", "", page)
    body = re.sub(r"(?is)<pre[^>]*>(.*?)</pre>", lambda m: "\n\n```\n" + re.sub(r"<[^>]+>", "", m.group(1)).replace("\n", "\x00") + "\n```\n\n", body)
    body = re.sub(r"[ \t\r\n\f]+", " ", body)
    body = re.sub(r"(?i)<h([1-6])[^>]*>(.*?)</h\1\s*>", lambda m: f"\n\n{'#' * int(m.group(1))} {m.group(2).strip()}\n\n", body)
    body = re.sub(r"(?i)<a\b[^>]*href\s*=\s*[\"']?([^\"'\s>]+)[\"']?[^>]*>(.*?)</a\s*>", r"[\2](\1)", body)
    body = re.sub(r"(?i)</?(?:b|strong)\b[^>]*>", "**", body)
    body = re.sub(r"(?i)</?(?:i|em)\b[^>]*>", "*", body)
    body = re.sub(r"(?i)</?code\b[^>]*>", "`", body)
    body = re.sub(r"(?i)<br\s*/?>", "\n", body)
    body = re.sub(r"(?i)<li\b[^>]*>", "\n- ", body)
    body = re.sub(r"(?i)</?(?:p|div|article|section|header|footer|nav|main|aside|ul|ol|table|tr|blockquote|form|body|html|hr|dl|dd|dt)\b[^>]*>", "\n\n", body)
    body = html.unescape(re.sub(r"<[^>]+>", "", body)).replace("\x00", "\n")
    lines = [x.strip() for x in body.split("\n")]
    return title, re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n"


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class Paragraphs:
    """Takes a document's XML element by element and keeps each paragraph's line of Markdown, in the order of their beginnings."""

    def __init__(self):
        self.lines: list[str] = []
        self.path: list[str] = []
        #: For each open paragraph: its place, texts, style, and whether it is a list's.
        self.open: list[dict] = []
        self.text: list[str] | None = None

    def doctype(self, *_):
        raise ElementTree.ParseError("documents have no type declarations")

    def start(self, tag: str, attrs: dict) -> None:
        if tag == f"{WORD}p":
            self.open.append({"place": len(self.lines), "texts": [], "style": "", "listed": False, "depth": len(self.path)})
            self.lines.append("")
        elif self.open:
            p = self.open[-1]
            if tag == f"{WORD}t":
                self.text = []
            elif tag in (f"{WORD}tab", f"{WORD}br"):
                self.put(" ")
            elif self.path[-1] == f"{WORD}pPr" and len(self.path) == p["depth"] + 2:
                if tag == f"{WORD}pStyle":
                    p["style"] = attrs.get(f"{WORD}val", "")
                p["listed"] |= tag == f"{WORD}numPr"
        self.path.append(tag)

    def put(self, text: str) -> None:
        for p in self.open:  # a text box's text is also its paragraph's
            p["texts"].append(text)

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, tag: str) -> None:
        self.path.pop()
        if tag == f"{WORD}t" and self.text is not None:
            self.put("".join(self.text))
            self.text = None
        elif tag == f"{WORD}p":
            p = self.open.pop()
            text, name = " ".join("".join(p["texts"]).split()), p["style"]
            level = re.fullmatch(r"(?i)heading ?([1-6])", name)
            mark = "# " if name.lower() == "title" else "#" * int(level[1]) + " " if level else "- " if p["listed"] else ""
            self.lines[p["place"]] = mark + text if text else ""

    def close(self) -> list[str]:
        return [x for x in self.lines if x]


def markdown_of_docx(content: bytes | None) -> str | None:
    """Headings, list items and paragraphs of a word-processor file of any size; null if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z, z.open("word/document.xml") as f:
            parser = ElementTree.XMLParser(target=Paragraphs())
            while part := f.read(CHUNK):
                parser.feed(part)
            out = parser.close()
    except (zipfile.BadZipFile, zlib.error, KeyError, OSError, EOFError, RuntimeError, ElementTree.ParseError):
        return None
    return re.sub(r"(?m)^(- .*)\n\n(?=- )", r"\1\n", "\n\n".join(out)) + "\n"


def docx_to_markdown(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds markdown, null where a file can't be read; the content is dropped."""
    ship(files.sparkSession)
    keep = [c for c in files.columns if c != content_col]
    schema = T.StructType([files.schema[c] for c in keep] + [T.StructField("markdown", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, FILES):
                b = whole.slice(at, FILES)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(map(markdown_of_docx, b.column(len(keep)).to_pylist()), pa.string())], names=names)

    return files.select(*keep, content_col).mapInArrow(run, schema)


def html_to_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title and markdown; the html is dropped."""
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c != html_col]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for whole, at in ((w, at) for w in batches for at in range(0, w.num_rows, FILES)):
            b = whole.slice(at, FILES)
            made = [markdown_of(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.string())], names=names)

    return pages.select(*keep, html_col).mapInArrow(run, schema)


def header(name: Column, path: Column, mtime: Column) -> Column:
    return F.concat(F.lit("---\noriginal_filename: "), name, F.lit("\noriginal_path: "), path, F.lit("\noriginal_mtime: "), mtime, F.lit("\n---\n\n"))


def import_files(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, versioned: bool = False, prefix: str = "sources") -> DataFrame:
    """target, source_path, markdown of all importable files of a folder; what can't be read has null markdown."""
    every = selected(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "content"), include, exclude)
    word = F.lower("path").endswith(".docx")
    f = every.filter(~word).select("path", "modificationTime", F.col("content").cast("string").alias("text"))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    rel = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), f"^[a-z0-9+.-]+:(//[^/]*)?{re.escape(base)}/", "")
    name = F.element_at(F.split(rel, "/"), -1)
    as_html = html_to_markdown(f.filter(F.lower("path").rlike(r"\.html?$")), "text").select("path", "modificationTime", "markdown")
    plain = f.filter(~F.lower("path").rlike(r"\.html?$")).select("path", "modificationTime", F.when(F.lower("path").endswith(".txt"), F.concat(F.lit("# "), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("markdown"))
    made = as_html.unionByName(plain).unionByName(docx_to_markdown(every.filter(word)))
    return made.select(relative_target(rel, F.col("modificationTime") if versioned else None, prefix).alias("target"), F.col("path").alias("source_path"), F.concat(header(name, rel, F.date_format("modificationTime", "yyyy-MM-dd")), "markdown").alias("markdown"))
