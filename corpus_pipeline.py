"""The corpus pipeline: documents in, tokenised clean documents out. Each stage calls one operator and acts on what it finds.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, in their
order, whatever other columns there are and however they are named. Rows count one by one: repeated rows and ids, and
rows without an id, are documents like others. An empty table gives no rows. Texts are treated whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from millrace.llm.common import checkpoint, table


class Renamed:
    """The rows of a table under names of our own, so that no name clashes; ``back`` gives the table's names again."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.id, self.text = (f"c{self.names.index(c)}" for c in ("doc_id", "text"))

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.names)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity classifier rejects (score 0.5 or more) go.

    Null and empty texts have the score of a text without features. Equal texts have one score, so ties and repeated
    rows go or stay together.
    """
    own = Renamed(docs)
    model = toxicity.train(own.rows.select(F.col(own.id).alias("doc_id"), F.col(own.text).alias("text")), table(spark, sf_dir, "labels"))
    return own.back(toxicity.score(own.rows, model, own.text, name="score").filter(F.col("score") < 0.5))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that occurred before go; every row stays, with its new number of characters.

    Null texts stay null, and so is their number of characters; a text all of whose lines go is empty. Rows that agree in
    id and text are one occurrence.
    """
    own = Renamed(docs)
    out = own.back(line_dedup.line_dedup(own.rows, own.id, own.text))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: the one with the smallest id, null ids last, rows of one id by their hash.

    Rows count one by one, whatever their ids: a row without an id or with another row's id is a document like others.
    Of equal rows the first stays. Rows without shingles (null, empty and blank texts) are groups of their own, so all
    of them stay.
    """
    own = Renamed(docs)
    rows = own.rows
    least = F.coalesce(own.id, F.lit(0).cast(rows.schema[own.id].dataType))
    content = F.xxhash64(*rows.columns, *[F.col(c).isNull() for c in rows.columns])
    keyed = rows.withColumn("key", F.struct(F.col(own.id).isNull().alias("late"), least.alias("id"), content.alias("hash")))
    groups = jaccard_join.jaccard_components(keyed, id_col="key", text_col=own.text)
    stays = groups.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(F.max("n_shingles").alias("n"))
    # Equal rows have one key: of those with shingles the first stays, a limit that runs before the rows meet. Rows
    # without shingles are told apart, so that however many equal ones there are, they don't meet at all.
    told = keyed.join(stays, "key").withColumn("lone", F.when(F.col("n") == 0, F.monotonically_increasing_id()))
    turn = F.row_number().over(Window.partitionBy("key", "lone").orderBy("n"))
    return own.back(told.withColumn("turn", turn).filter(F.col("turn") == 1))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with any window of a benchmark item go. Null and empty texts have no words and stay."""
    own = Renamed(docs)
    found = decontamination.find_occurrences(own.rows, table(spark, sf_dir, "benchmark"), own.text)
    return own.back(found.filter(F.size("spans") == 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` with n_tokens, ids_sha256 and decoded_sha256 of their texts; columns of these names are replaced.

    Null texts count as empty and stay null.
    """
    return bpe.token_digest(docs, bpe.content_of(bpe.default_path()), keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Toxicity is learned and near copies are components: SQL can't express them. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage leaves is written once, so that the next one's passes don't run it again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpoint(docs) if k else docs, sf_dir)
    return docs
