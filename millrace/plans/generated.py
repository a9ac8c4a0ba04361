"""The generated files of a corpus tree: written, compared with what is there, and the whole tree verified.

A generated file is ordered lines of a DataFrame under a fixed head. Lines are made and sorted on the executors and
stream through the driver in chunks, into the file or against it: a file of any length is never held whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import integrity as V
from ..operators.corpus import Corpus
from ..operators.index import Index
from ..schema import MAX_TAGS
from ..sources import markdown_tree as S
from ..sources.cut import checkpoint
from . import changelog as L
from . import views as G
from .freshness import ensure_fresh

# The marker of a corpus tree and the heads of its generated files.
MARKER, VERSION = "VERSION", "millrace-corpus-1"
SUMS = "SUMS"
HEADS = {
    "INDEX.md": ("# Index\n\nGenerated. Wiki pages and their sources.\n\n", "No wiki pages yet.\n"),
    "SOURCES.md": ("# Sources\n\nGenerated. Reference material, which never changes.\n\n", "No sources yet.\n"),
    "ASSETS.md": ("# Assets\n\nGenerated. Attachments, which never change.\n\n", "No assets yet.\n"),
    SUMS: ("sums-v1 sha256\n", ""),
    "tags.md": (f"# Tags\n\nGenerated from the wiki pages; not to be edited.\n\nPages have 1-{MAX_TAGS} tags. Use those that there are where they fit.\n", "\nNo tags yet.\n"),
}
TAGS_HEAD = "\n## Tags\n\n"


@dataclass(frozen=True)
class View:
    """head, rows (key, sub, line), what stands for no rows."""

    name: str
    rows: DataFrame

    def chunks(self) -> Iterator[str]:
        head, empty = HEADS[self.name]
        yield head
        some = False
        keyed = self.rows.select(F.struct("key", "sub").alias("key"), F.concat("line", F.lit("\n")).alias("line"))
        for r in G.in_order(keyed, "line", key="key"):
            if not some and self.name == "tags.md":
                yield TAGS_HEAD
            some = True
            yield r["line"]
        if not some:
            yield empty

    def text(self) -> str:
        return "".join(self.chunks())


def views(corpus: Corpus, sums: DataFrame, assets: DataFrame) -> list[View]:
    """sums: path and sum_hash of the wiki pages; assets: path and title."""
    tags = G.tag_registry(corpus).select(F.col("tag").alias("key"), F.lit(0).alias("sub"), F.concat(F.lit("- "), "tag", F.lit(" ("), F.col("pages").cast("string"), F.lit(")")).alias("line"))
    lines = sums.select(F.col("path").alias("key"), F.lit(0).alias("sub"), F.concat("path", F.lit(" sha256:"), "sum_hash").alias("line"))
    return [View("INDEX.md", G.index_tree(corpus)), View("SOURCES.md", G.sources_tree(corpus)), View("ASSETS.md", G.tree_lines(assets.select("path", "title"), "assets/")), View(SUMS, lines), View("tags.md", tags)]


def of_tree(spark: SparkSession, root: str, tree: S.Parsed | None = None) -> list[View]:
    tree = tree or S.read_tree(spark, root)
    return views(tree.corpus, tree.parsed.filter(F.col("kind") == "wiki").select("path", "sum_hash"), S.asset_files(spark, root))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, chunks) -> None:
    """Writes a file beside its place and moves it there."""
    folder, _, name = path.rpartition("/")
    fs, part = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    _, to = _fs(spark, path)
    if fs.getUri().getScheme() == "file":
        # Without checksum files beside it, so that other programs can write it too. Hadoop may have wrapped its file system.
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
        fs.initialize(part.toUri().resolve("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(_fs(spark, f"{folder}/.{name}.crc")[1], False)
    out = fs.create(part, True)
    for c in chunks:
        out.write(bytearray(c.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"{path} couldn't be written")


def write(spark: SparkSession, root: str, tree: S.Parsed | None = None) -> list[str]:
    """Writes all generated files; their names."""
    own = tree or S.read_tree(spark, root)
    made = of_tree(spark, root, own)
    for v in made:
        put(spark, f"{root}/{v.name}", v.chunks())
    if tree is None:
        own.release()
    return [v.name for v in made]


def lines_of(chunks) -> Iterator[str]:
    rest = ""
    for c in chunks:
        *whole, rest = (rest + c).split("\n")
        yield from whole
    if rest:
        yield rest


def file_lines(spark: SparkSession, path: str) -> Iterator[str] | None:
    """The lines of one file in order; None if it isn't there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    return iter(reader.readLine, None)


def differences(want: Iterator[str], got: Iterator[str], most: int = 5) -> list[str]:
    """The first lines in which two texts differ."""
    out: list[str] = []
    for n, (w, g) in enumerate(zip_longest(want, got), 1):
        if w != g:
            out.append(f"line {n}: {w!r} is not there" if g is None else f"line {n}: {g!r} is too much" if w is None else f"line {n}: {g!r} instead of {w!r}")
            if len(out) == most:
                break
    return out


def stale(spark: SparkSession, root: str, tree: S.Parsed | None = None) -> list[tuple[str, str, str]]:
    """(rule, path, detail) of each generated file that is missing or differs from what would be written."""
    out = []
    for v in of_tree(spark, root, tree):
        got = file_lines(spark, f"{root}/{v.name}")
        if got is None:
            out.append(("generated", v.name, "is missing"))
        elif found := differences(lines_of(v.chunks()), got):
            out.append(("generated", v.name, "; ".join(found)))
    return out


def marker(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    got = file_lines(spark, f"{root}/{MARKER}")
    text = None if got is None else "\n".join(got).strip()
    return [] if text == VERSION else [("marker", MARKER, "is missing" if text is None else f"unsupported version {text!r}")]


def path_policy(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """Content directories are there and real; nothing in them is a symbolic link or another thing than a file or directory; assets hold no Markdown.

    Links can be seen where the driver sees the tree as a folder; other stores have none.
    """
    out = []
    local = root.removeprefix("file://")
    for r in ("sources", "wiki", "assets"):
        fs, p = _fs(spark, f"{root}/{r}")
        if not fs.exists(p):
            out.append(("path", r, "required directory is missing"))
        elif os.path.islink(f"{local}/{r}"):
            out.append(("path", r, "must be a real directory, not a link"))
        elif not fs.getFileStatus(p).isDirectory():
            out.append(("path", r, "must be a directory"))
    for at, dirs, names in os.walk(local) if os.path.isdir(local) else ():
        rel = os.path.relpath(at, local)
        if rel == ".":
            dirs[:] = sorted(d for d in dirs if d in ("sources", "wiki", "assets"))
            continue
        for x in sorted([*dirs, *names]):
            full = f"{at}/{x}"
            if os.path.islink(full):
                out.append(("path", f"{rel}/{x}", "is a symbolic link"))
            elif x in names and not os.path.isfile(full):
                out.append(("path", f"{rel}/{x}", "is not a regular file"))
    return out


def misplaced(spark: SparkSession, root: str) -> DataFrame:
    """Markdown under assets, and paths that no content may have."""
    f = S.files(spark, root, content=False)
    bad = F.col("path").startswith("assets/") & F.lower("path").endswith(".md")
    return f.filter(bad).select(F.lit("path").alias("rule"), "path", F.lit("Markdown files are not allowed under assets/").alias("detail"))


RULES = "rule string, path string, detail string"


def check(spark: SparkSession, root: str) -> DataFrame:
    """rule, path, detail of everything that is wrong with a tree: marker, paths, pages, records, facts, generated files, changelog."""
    first = marker(spark, root) + path_policy(spark, root)
    if any(rule == "path" and ("required" in why or "must be" in why) for rule, _, why in first):
        return spark.createDataFrame(first, RULES)
    tree = S.read_tree(spark, root)
    log = file_lines(spark, f"{root}/CHANGELOG.md")
    rows = first + stale(spark, root, tree) + ([("changelog", "CHANGELOG.md", "is missing")] if log is None else [])
    out = spark.createDataFrame(rows, RULES).unionByName(misplaced(spark, root)).unionByName(V.pages(tree.parsed)).unionByName(V.check(tree.corpus))
    if log is not None:
        bad = L.read(spark, f"{root}/CHANGELOG.md").filter("fault IS NOT NULL")
        out = out.unionByName(bad.select(F.lit("changelog").alias("rule"), F.lit("CHANGELOG.md").alias("path"), F.concat("fault", F.lit(": "), "line").alias("detail")))
    return out.distinct()


def rewritten(spark: SparkSession, root: str, lacking: Column, give: Callable[[M.Front], None]) -> list[str]:
    """Changes the frontmatter of the pages that lack something; their paths.

    Pages are found on the executors and come one by one; each is written beside its place and moved there. Pages whose
    frontmatter can't be read, or that have none, stay as they are.
    """
    pages = S.parse(S.markdown_files(spark, root).filter(F.col("kind") == "wiki")).filter(F.col("error").isNull() & F.col("title").isNotNull())
    done = []
    for r in checkpoint(pages.filter(lacking).select("path")).toLocalIterator():
        path = f"{root}/{r['path']}"
        front, body = M.split_front("\n".join(file_lines(spark, path)) + "\n")
        give(front)
        put(spark, path, [M.join_front(front, body)])
        done.append(r["path"])
    return sorted(done)


def repair_ids(spark: SparkSession, root: str) -> list[str]:
    """Gives pages without an id a new one; their paths."""
    return rewritten(spark, root, F.col("id") == "", lambda front: setattr(front, "id", f"doc_{uuid.uuid4().hex}"))


def repair_dates(spark: SparkSession, root: str, today: str) -> list[str]:
    """Gives pages without a modified date ``today``; their paths. Dates that are there stay, wrong ones too."""
    if not M.valid_date(today):
        raise ValueError(f"{today!r} must be YYYY-MM-DD")
    return rewritten(spark, root, F.col("modified_date") == "", lambda front: setattr(front, "modified_date", today))


def indexed(spark: SparkSession, root: str, path: str, today: str | None = None) -> Index:
    """The index at ``path`` of a tree that is sound: as it is if it is fresh, else built anew.

    Pages from before pages had dates get ``today`` (by default, the current day) first, and generated files follow; a
    tree with any other fault of paths or frontmatter isn't touched. Whatever is wrong after that is an error.
    """
    dateless = (F.col("rule") == "frontmatter") & (F.col("detail") == M.DATELESS)
    found = checkpoint(check(spark, root))
    if not found.filter(dateless).isEmpty():
        if (first := found.filter(F.col("rule").isin("marker", "path", "frontmatter", "markdown") & ~dateless).first()) is not None:
            raise ValueError(f"{first['path']}: {first['detail']}")
        repair_dates(spark, root, today or date.today().isoformat())
        write(spark, root)
        found = check(spark, root)
    if (first := found.first()) is not None:
        raise ValueError(f"{first['path']}: {first['detail']}")
    return ensure_fresh(spark, S.read_corpus(spark, root), path)


def verify(spark: SparkSession, root: str, fix: bool = False) -> DataFrame:
    """The violations that are left after missing ids are repaired; generated files are written again then, or with ``fix``."""
    if not marker(spark, root) and not path_policy(spark, root) and (repair_ids(spark, root) or fix):
        write(spark, root)
    return check(spark, root)
