"""The corpus: five tables from which every search and health query is computed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.cut import checkpoint


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    sections: DataFrame
    links: DataFrame
    citations: DataFrame
    tags: DataFrame

    @property
    def wiki(self) -> DataFrame:
        return self.documents.filter(F.col("kind") == "wiki")

    @staticmethod
    def from_tables(spark: SparkSession, sf_dir: str) -> Corpus:
        from ..sources.tables import corpus_of

        return corpus_of(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))

    @staticmethod
    def from_markdown(spark: SparkSession, root: str) -> Corpus:
        from ..sources.markdown_tree import read_corpus

        return read_corpus(spark, root)


#: Bytes for each core up to which a table in few files is dealt out.
SMALL = 64 << 20


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table in fewer files than there are cores, and so small, dealt out to all cores once and written; any other as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return checkpoint(table.repartition(cores, key)) if len(table.inputFiles()) < cores and size < SMALL * cores else table


def facts_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, citations and tags of wiki documents whose arrays hold them: three explodes of one pruned scan."""
    wiki = documents.filter(F.col("kind") == "wiki")
    links = wiki.select(F.col("id").alias("from_document_id"), F.col("path").alias("from_path"), F.explode("links").alias("to_path")).filter("from_path != to_path")
    links = links.select("from_document_id", "from_path", F.lit("").alias("from_anchor"), "to_path", F.lit("").alias("to_anchor"), X.target_kind(F.col("to_path")).alias("kind"))
    citations = wiki.select(F.col("id").alias("document_id"), F.col("path").alias("wiki_path"), F.explode("sources").alias("source_path"), F.lit("").alias("source_anchor"), F.lit("frontmatter_source").alias("citation_kind"))
    tags = wiki.select(F.col("id").alias("document_id"), "path", F.explode("tags").alias("tag"))
    return resolve_links(links, documents).distinct(), citations.distinct(), tags.distinct()


def resolve_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds the target's id, empty where there is no such document."""
    ids = documents.select(F.col("path").alias("to_path"), F.col("id").alias("to_document_id"))
    return links.join(ids, "to_path", "left").select("from_document_id", "from_path", "from_anchor", "to_path", "to_anchor", F.coalesce("to_document_id", F.lit("")).alias("to_document_id"), "kind")
