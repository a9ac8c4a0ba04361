"""Term statistics of wiki pages, and top terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import Corpus


def term_counts(corpus: Corpus) -> DataFrame:
    """path, term, tf of wiki pages: over path, title, summary, tags, headings and bodies, without stop words.

    A page's texts meet before they are split, so that a task counts the terms of some pages: a row for each page and
    term is neither kept for all pages of an input split nor shuffled.
    """
    d = corpus.wiki.select("path", F.concat_ws(" ", "path", "title", "summary", F.array_join("tags", " ")).alias("text"))
    s = corpus.sections.filter(F.col("document_id").startswith("doc_")).select("path", F.concat_ws(" ", "heading", "body").alias("text"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = d.unionByName(s).repartition(parts, "path")
    terms = texts.select("path", F.explode(X.words(F.col("text"))).alias("term")).filter(~X.is_candidate_stop(F.col("term")))
    return terms.groupBy("path", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    # Every count is positive. Reading it keeps the column, so that a plan with the counts themselves reuses their exchange.
    return counts.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))


def weighted_terms(counts: DataFrame, total: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Adds df and w, of all pages or of some (path) alone; ``total`` is one row with n, the number of wiki pages."""
    some = counts if pages is None else counts.join(pages, "path", "left_semi")
    return some.join(document_frequency(counts), "term").crossJoin(F.broadcast(total)).withColumn("w", X.term_weight(F.col("tf"), F.col("df"), F.col("n")))


def top_terms(weights: DataFrame, limit: int) -> DataFrame:
    """The heaviest terms of each page. Weights are rounded, so that the order doesn't hang on the last bits."""
    order = Window.partitionBy("path").orderBy(F.desc(X.round_to(F.col("w"), 9)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def pair_terms(weights: DataFrame, limit: int, always: int) -> DataFrame:
    """Of each page's top terms those that may bring pages together: in more than one page, and in few or at most a third."""
    return top_terms(weights, limit).filter((F.col("df") > 1) & ((F.col("df") <= always) | (F.col("df") * 3 <= F.col("n"))))


def wiki_count(corpus: Corpus) -> DataFrame:
    return corpus.wiki.agg(F.count("*").alias("n"))
