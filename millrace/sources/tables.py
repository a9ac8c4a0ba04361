"""A corpus from a plain table of texts (doc_id, text, lang, source).

Such texts have no markup, so structure is derived from them by fixed rules: every fourth row is a source, the
others are wiki pages; a text's lines are its sections; tags, citations and links follow from hashes and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.corpus import Corpus, resolve_links


def paths_of(table: DataFrame) -> DataFrame:
    """doc_id, text, and kind, path, entity (a name shared by texts with the same first line), first line."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    d = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", first.alias("l1"), F.md5(first).alias("h"))
    part = F.when(F.col("doc_id") % 20 < 8, "").when(F.col("doc_id") % 20 < 10, "design/").when((F.col("doc_id") % 20).isin(12, 13), "reference/").otherwise("")
    root = F.when(F.col("doc_id") % 4 == 0, "sources/").otherwise("wiki/")
    entity = F.concat(F.lit("t"), F.substring("h", 1, 5))
    number = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    return d.select("doc_id", "text", "lang", "source", "l1", "h", entity.alias("entity"), F.when(F.col("doc_id") % 4 == 0, "source").otherwise("wiki").alias("kind"), F.concat(root, part, entity, F.lit("-"), "source", F.lit("-"), "lang", F.lit("-"), number, F.lit(".md")).alias("path"))


def corpus_of(table: DataFrame) -> Corpus:
    d = paths_of(table)
    ids = d.select("doc_id", "path")
    count = d.filter("doc_id % 4 = 0").agg(F.count("*").alias("ns"))
    wiki = d.filter(F.col("kind") == "wiki").crossJoin(F.broadcast(count))  # one row
    cited = 4 * (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("ns"))
    wanted = wiki.select("doc_id", F.explode(F.array_compact(F.array(cited, F.when(F.col("doc_id") % 12 == 3, F.col("doc_id") - F.col("doc_id") % 4)))).alias("source_no"), F.lit(None).cast("long").alias("link_no"))
    linked = wiki.filter(((F.col("doc_id") + 1) % 4 != 0) & (F.col("doc_id") % 5 != 0)).select("doc_id", F.lit(None).cast("long").alias("source_no"), (F.col("doc_id") + 1).alias("link_no"))
    edges = wanted.unionAll(linked).withColumn("other", F.coalesce("source_no", "link_no")).join(ids.select(F.col("doc_id").alias("other"), F.col("path").alias("to_path")), "other")
    refs = edges.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("source_no").isNotNull(), F.col("to_path")))).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("link_no").isNotNull(), F.col("to_path")))).alias("links"))
    none = F.array().cast("array<string>")
    is_wiki = F.col("kind") == "wiki"
    full = d.join(refs, "doc_id", "left")
    title = F.concat_ws(" ", F.array_compact(F.concat(F.array("entity"), F.slice(X.present(F.split("l1", " ")), 1, 4))))
    documents = full.select(
        F.when(is_wiki, F.concat(F.lit("doc_"), F.md5("path"))).otherwise(X.source_id(F.col("path"))).alias("id"),
        "path",
        "kind",
        X.tier_of(F.col("path")).alias("tier"),
        title.alias("title"),
        F.when(is_wiki, F.col("l1")).otherwise("").alias("summary"),
        F.when(is_wiki, F.array_sort(F.array_distinct(F.array("entity", "source")))).otherwise(none).alias("tags"),
        F.coalesce("sources", none).alias("sources"),
        F.coalesce("links", none).alias("links"),
        F.when(is_wiki, F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")), "yyyy-MM-dd")).otherwise("").alias("modified_date"),
        F.sha2("text", 256).alias("hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        "doc_id",
        "text",
        F.col("lang"),
    )
    lines = documents.select(F.col("id").alias("document_id"), "path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "body"))
    ordinal = F.col("pos") + 1
    heading = F.when(F.col("pos") % 3 == 0, F.nullif(F.array_join(F.slice(X.present(F.split("body", " ")), 1, 3), " "), F.lit("")))
    sections = lines.withColumn("heading", heading).select(
        X.section_id(F.col("document_id"), ordinal).alias("section_id"), "document_id", "path", ordinal.alias("ordinal"), "heading", F.when(F.col("heading").isNotNull(), X.anchor(F.col("heading"))).alias("anchor"), F.when(F.col("heading").isNotNull(), F.when(F.col("pos") == 0, 1).otherwise(2)).alias("level"), "body"
    )
    # Everything but the texts is small beside them and read by every query several times.
    narrow = documents.drop("text", "doc_id", "lang").persist()
    tags = narrow.filter(is_wiki).select(F.col("id").alias("document_id"), "path", F.explode("tags").alias("tag"))
    links = resolve_links(narrow.filter(is_wiki).select(F.col("id").alias("from_document_id"), F.col("path").alias("from_path"), F.lit("").alias("from_anchor"), F.explode("links").alias("to_path"), F.lit("").alias("to_anchor")).withColumn("kind", X.target_kind(F.col("to_path"))), narrow)
    plain = narrow.filter(is_wiki).select(F.col("id").alias("document_id"), F.col("path").alias("wiki_path"), F.explode("sources").alias("source_path"), F.lit("").alias("source_anchor"), F.lit("frontmatter_source").alias("citation_kind"))
    # Even pages cite the fourth section of the source that their hash names.
    fourth = sections.filter((F.col("ordinal") == 4) & F.col("anchor").isNotNull()).select(F.col("path").alias("source_path"), F.col("anchor").alias("source_anchor"))
    even = wiki.filter("doc_id % 2 = 0").select("doc_id", "path", cited.alias("no")).join(ids.select(F.col("doc_id").alias("no"), F.col("path").alias("source_path")), "no").join(fourth, "source_path")
    inline = even.select(F.concat(F.lit("doc_"), F.md5("path")).alias("document_id"), F.col("path").alias("wiki_path"), "source_path", "source_anchor", F.lit("inline_source").alias("citation_kind"))
    return Corpus(narrow, sections, links, plain.unionByName(inline), tags)
