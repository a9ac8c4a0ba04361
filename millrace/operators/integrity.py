"""Integrity checks: every violation of every rule, as rows (rule, path, detail). Empty means sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import BODY_LINES, KINDS, MAX_TAGS, TIERS
from .corpus import Corpus


def fault(df: DataFrame, rule: str, bad: Column | None = None, path: str = "path", detail: Column | str = "") -> DataFrame:
    rows = df if bad is None else df.filter(bad)
    return rows.select(F.lit(rule).alias("rule"), F.col(path).alias("path"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def duplicates(df: DataFrame, key: str, path: str, rule: str) -> DataFrame:
    d = df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("c"), F.min(path).alias("first")).filter("c > 1")
    return fault(d, rule, path="first", detail=F.col("value"))


def foreign_keys(corpus: Corpus) -> DataFrame:
    """Facts whose document or page isn't there, and links whose target's id doesn't fit."""
    ids, paths = corpus.documents.select("id"), corpus.documents.select("path", F.col("id").alias("want"))

    def absent(df: DataFrame, col: str, path: str, rule: str) -> DataFrame:
        return fault(df.join(ids, df[col] == ids["id"], "left_anti"), rule, path=path, detail=F.col(col))

    wrong = corpus.links.join(paths.withColumnRenamed("path", "to_path"), "to_path", "left").filter(F.col("to_document_id") != F.coalesce("want", F.lit("")))
    return reduce(DataFrame.unionByName, [absent(corpus.sections, "document_id", "path", "section_document"), absent(corpus.links, "from_document_id", "from_path", "link_document"), absent(corpus.citations, "document_id", "wiki_path", "citation_document"), absent(corpus.tags, "document_id", "path", "tag_document"), fault(wrong, "link_target_id", path="from_path", detail=F.col("to_path"))])


def records(corpus: Corpus) -> DataFrame:
    """Rules on the records themselves."""
    d, s = corpus.documents, corpus.sections
    wiki = F.col("kind") == "wiki"
    outside = lambda col, pattern: F.exists(col, lambda x: ~x.rlike(pattern))
    rules = [
        fault(d, "kind", ~F.col("kind").isin(*KINDS) | ~F.col("kind").eqNullSafe(X.kind_of(F.col("path")))),
        fault(d, "tier", ~F.col("tier").isin(*TIERS) | (F.col("tier") != X.tier_of(F.col("path")))),
        fault(d, "title", F.trim("title") == ""),
        fault(d, "summary", wiki & (F.trim("summary") == "")),
        fault(d, "modified_date", wiki & F.try_to_timestamp("modified_date", F.lit("yyyy-MM-dd")).isNull()),
        fault(d, "size", F.col("size_bytes") < 0),
        fault(d, "source_metadata", ~wiki & ((F.size("tags") > 0) | (F.size("sources") > 0) | (F.size("links") > 0))),
        fault(d, "tags", wiki & ((F.size("tags") == 0) | (F.size("tags") > MAX_TAGS) | outside("tags", "^[a-z0-9][a-z0-9-]{0,62}$"))),
        fault(d, "sorted_lists", reduce(Column.__or__, [F.col(c) != X.sorted_unique(F.col(c)) for c in ("tags", "sources", "links")])),
        fault(d, "path", F.col("path").rlike(r"^/|\\|(^|/)\.\.?(/|$)|//") | ~F.col("path").endswith(".md")),
        fault(s, "ordinal", F.col("ordinal") < 1),
        fault(s, "level", F.col("level") < 1),
        duplicates(d, "id", "path", "unique_id"),
        duplicates(d, "path", "path", "unique_path"),
        duplicates(s, "section_id", "path", "unique_section"),
    ]
    return reduce(DataFrame.unionByName, rules)


def pages(parsed: DataFrame) -> DataFrame:
    """Rules on parsed Markdown pages: frontmatter, length, title, sources, links, and references that lead nowhere."""
    wiki = parsed.filter((F.col("kind") == "wiki") & F.col("error").isNull())
    lines = F.when(F.rtrim(F.regexp_replace("body", "\n+$", "")) == "", 0).otherwise(F.size(F.split(F.regexp_replace("body", "\n+$", ""), "\n")))
    prefixed = lambda col, p: F.filter(col, lambda x: x.startswith(p))
    cited = F.transform("citations", lambda r: r["path"])
    refs = wiki.select("path", F.explode(F.concat("link_refs", "source_refs", "citations")).alias("r")).select("path", F.col("r.path").alias("to"), F.col("r.anchor").alias("anchor")).distinct()
    # References meet their target once: a file's row has all its anchors.
    targets = parsed.select(F.col("path").alias("to"), F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"))
    met = refs.filter(F.lower("to").endswith(".md")).join(targets, "to", "left")
    target = F.concat("to", F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(""))
    rules = [
        fault(parsed.filter(F.col("error").isNotNull()), "parse", detail=F.col("error")),
        fault(parsed.select("path", F.explode("faults").alias("f")), "frontmatter", detail=F.col("f")),
        fault(wiki, "body_lines", lines > BODY_LINES, detail=lines.cast("string")),
        fault(wiki, "title_heading", F.col("first_h1") != F.col("title"), detail=F.col("first_h1")),
        fault(wiki, "links", X.sorted_unique(prefixed("body_links", "wiki/")) != X.sorted_unique(F.col("links"))),
        fault(wiki, "sources_section", ~F.col("has_sources") | F.exists("body_sources", lambda x: ~x.startswith("sources/"))),
        fault(wiki, "sources", X.sorted_unique(F.concat("body_sources", cited)) != X.sorted_unique(F.col("sources"))),
        fault(met, "missing_target", F.col("anchors").isNull(), detail=target),
        fault(met, "missing_anchor", (F.col("anchor") != "") & ~F.array_contains("anchors", F.col("anchor")), detail=target),
        duplicates(wiki, "id", "path", "unique_id"),
    ]
    return reduce(DataFrame.unionByName, rules)


def check(corpus: Corpus) -> DataFrame:
    return records(corpus).unionByName(foreign_keys(corpus))
