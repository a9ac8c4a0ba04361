"""Ranked lexical search by a threshold-seeded join (operator 13).

Every item (a query) gets its best documents by a whole-number score of the terms that they share:

1. The documents are tokenised once. What is kept of each is its vector: its number of terms, and the numbers and
   counts of those of its terms that any item has. The vectors are written, so that the later passes read no text.
2. Of each term are counted the documents that hold it, and stored its greatest and its kth greatest impact (what one
   occurrence in an item adds to a score). k documents reach the kth impact of a term, so the best of an item's terms
   by that measure is a lower bound of the item's kth score: its threshold, known before any document is scored.
3. An item's terms are ordered by the most that they can add. The longest tail that sums to less than the threshold is
   pruned: a document with none but these terms can't be among the first k.
4. The vectors join the items through the terms that are left. A document's sum over them, and the tail's bound, must
   reach the threshold, else the pair goes. What remains gets the tail's terms too and so its exact score. A task's own
   kth scores raise its thresholds as it goes; it sends on k rows of each item at most, and a window ranks them.

Nothing is dropped that could rank: all comparisons with a threshold are strict, so ties at the kth place are decided by
the id. No posting is shuffled, so a term of all documents is no hot key; a task holds one batch of vectors, one block
of items and k rows of each of them. Items are taken in blocks of about ``BLOCK_TERMS`` terms: a block is what reaches
the driver and is broadcast, and each block reads the documents once more.

Semantics. Terms are the maximal runs of ASCII letters, ASCII digits and characters from U+0080 on, A-Z lower-cased.
Null and empty texts have no terms: such documents never rank, such items have no rows. Each row of ``docs`` and of
``items`` counts by itself, so repeated rows have equal scores and ranks of their own. Equal scores rank by ascending id,
null ids last. Ids of documents are read as long. Texts are read whole, however long. Other columns are ignored,
whatever their names. An empty table on either side gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ship, small_batches, table

TOP = 10
#: Terms of a block of items, with repeats.
BLOCK_TERMS = 200_000
#: Rows that a task's joins make at once.
STEP = 2_000_000
#: Fixed values of the score.
WEIGHT, SHARE, TF, LENGTH, PERCENT, SLOPE = 1000, 1_000_000_000, 1000, 8, 100, 75

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


VECTOR = "id long, n long, terms array<int>, counts array<int>"
IMPACTS = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("impact", T.LongType())])
FOUND = "item long, id long, score long"


def vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """id, n, terms, counts of every document that has any term. ``vocabulary``: a broadcast dictionary of term to number."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)

    def run(batches):
        get = vocabulary.value.get
        size = max(1, len(vocabulary.value))
        for b in batches:
            n, codes, rows = [], [], []
            for row, t in enumerate(b.column(0).to_pylist()):
                words = terms_of(t)
                n.append(len(words))
                own = np.array([x for x in map(get, words) if x is not None], np.int64)
                codes.append(own)
                rows.append(np.full(own.size, row, np.int64))
            key, counts = np.unique(np.concatenate(rows) * size + np.concatenate(codes), return_counts=True) if n else (np.empty(0, np.int64),) * 2
            ends = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % size, counts)]
            out = pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "counts"])
            yield out.filter(pa.array(np.array(n) > 0))

    return docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("k")).mapInArrow(run, VECTOR)


def items_of(items: DataFrame, text_col: str) -> DataFrame:
    """item (a number for each row), terms (distinct), counts: of the items that have any."""

    def run(batches):
        for b in batches:
            out = []
            for item, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                if words := terms_of(t):
                    names, counts = np.unique(np.array(words, object), return_counts=True)
                    out.append((item, list(names), counts.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())))], names=["item", "terms", "counts"])

    return items.select(F.col(text_col).cast("string").alias("t"), "item").mapInArrow(run, "item long, terms array<binary>, counts array<int>")


class Entries:
    """A batch of vectors as columns: for each entry its document's place in the batch, term, and impact's share of 10^9."""

    def __init__(self, batch: pa.RecordBatch, documents: int, terms: int):
        n, lists = np.asarray(batch.column(1)), batch.column(2)
        self.size = len(batch)
        self.doc = np.repeat(np.arange(self.size), np.diff(np.asarray(lists.offsets)))
        self.term = np.asarray(lists.flatten()).astype(np.int64)
        tf = np.asarray(batch.column(3).flatten()).astype(np.int64)
        norm = PERCENT - SLOPE + (SLOPE * n * documents) // max(1, terms)
        self.share = (SHARE * tf) // (TF * tf + LENGTH * norm[self.doc])
        self.start = np.searchsorted(self.doc, np.arange(self.size + 1))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges given by start and size: for each of their places the range's number, and the place."""
    of = np.repeat(np.arange(sizes.size), sizes)
    return of, np.arange(of.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def best_of(groups: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k of each group, by the keys in ``order``; the last key counts first."""
    at = np.lexsort((*order, groups))
    sorted_ = groups[at]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: at.size])
    turn = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))
    return at[turn < k]


def top_impacts(index: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """term, impact (without its weight): the k greatest of each term, and which they are doesn't matter."""

    def run(batches):
        term, share = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            e = Entries(b, documents, terms)
            term, share = np.append(term, e.term), np.append(share, e.share)
            keep = best_of(term, [-share], k)
            term, share = term[keep], share[keep]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(share, pa.int64())], names=["term", "impact"])

    turn = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    return index.mapInArrow(run, IMPACTS).withColumn("turn", turn).filter(F.col("turn") <= k)


class Items:
    """A block of items as columns, with their thresholds; what the join's tasks get.

    item[i] is the number of item i. By term, in ``lead``: the items that the term still leads to, and its weight there
    (its own weight, times its occurrences in the item). By item, in ``tail``: the terms that are pruned, and their weights.
    """

    def __init__(self, rows: list, vocabulary: dict[bytes, int], weight: np.ndarray, kth: np.ndarray, most: np.ndarray):
        self.item = np.array([r["item"] for r in rows], np.int64)
        size = np.array([len(r["terms"]) for r in rows], np.int64)
        of = np.repeat(np.arange(size.size), size)
        term = np.array([vocabulary[bytes(t)] for r in rows for t in r["terms"]], np.int64)
        value = np.array([c for r in rows for c in r["counts"]], np.int64) * weight[term]
        order = np.lexsort((term, -value * most[term], of))
        term, value = term[order], value[order]
        start = np.cumsum(size) - size
        self.threshold = np.maximum.reduceat(value * kth[term], start)
        bound = value * most[term]
        after = np.cumsum(bound[::-1])[::-1]  # from here to the end of all items
        rest = after - np.append(after, 0)[start + size][of]  # to the end of the item
        pruned = (rest < self.threshold[of]) | (rest == 0)
        self.rest = np.zeros(size.size, np.int64)
        np.maximum.at(self.rest, of[pruned], rest[pruned])
        self.tail_size = np.bincount(of[pruned], minlength=size.size)
        self.tail_start = np.cumsum(self.tail_size) - self.tail_size
        self.tail_term, self.tail_value = term[pruned], value[pruned]
        term, value, of = term[~pruned], value[~pruned], of[~pruned]
        by_term = np.argsort(term, kind="stable")
        self.lead_size = np.bincount(term, minlength=len(vocabulary))
        self.lead_start = np.cumsum(self.lead_size) - self.lead_size
        self.lead_item, self.lead_value = of[by_term], value[by_term]


class Search:
    """A task's search: the best rows of each item so far, and the thresholds that they raise."""

    def __init__(self, items: Items, documents: int, terms: int, k: int):
        self.q, self.documents, self.terms, self.k = items, documents, terms, k
        self.threshold = items.threshold.copy()
        self.item = self.id = self.score = np.empty(0, np.int64)
        self.null = np.empty(0, bool)
        self.candidates = self.rescored = 0

    def add(self, batch: pa.RecordBatch) -> None:
        e = Entries(batch, self.documents, self.terms)
        null = np.asarray(batch.column(0).is_null())
        ids = np.asarray(batch.column(0).fill_null(0))
        made = np.append(0, np.cumsum(self.q.lead_size[e.term]))[e.start]
        at = 0
        while at < e.size:  # as many documents as make STEP rows, one at least
            to = max(at + 1, int(np.searchsorted(made, made[at] + STEP, "right")) - 1)
            doc, item, score = self.scored(e, at, to)
            self.keep(item, ids[doc], null[doc], score)
            at = to

    def scored(self, e: Entries, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and exact scores of the pairs that may rank."""
        q, count = self.q, self.q.item.size
        part = slice(e.start[at], e.start[to])
        doc, term, share = e.doc[part], e.term[part], e.share[part]
        entry, place = ranges(q.lead_start[term], q.lead_size[term])
        pair, value = doc[entry] * count + q.lead_item[place], q.lead_value[place] * share[entry]
        order = np.argsort(pair, kind="stable")
        pair, value = pair[order], value[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: pair.size])
        if not first.size:
            return (np.empty(0, np.int64),) * 3
        pair, score = pair[first], np.add.reduceat(value, first)
        self.candidates += pair.size
        may = score + q.rest[pair % count] >= self.threshold[pair % count]
        pair, score = pair[may], score[may]
        self.rescored += pair.size
        # The tails: each of their terms is looked up in the document's vector.
        width = q.lead_size.size
        keys = doc * width + term
        sizes, done = q.tail_size[pair % count], 0
        ends = np.append(0, np.cumsum(sizes))
        while done < pair.size:
            to = max(done + 1, int(np.searchsorted(ends, ends[done] + STEP, "right")) - 1)
            of, place = ranges(q.tail_start[pair[done:to] % count], sizes[done:to])
            want = (pair[done:to] // count)[of] * width + q.tail_term[place]
            found = np.minimum(np.searchsorted(keys, want), keys.size - 1)
            np.add.at(score, of + done, np.where(keys[found] == want, q.tail_value[place] * share[found], 0))
            done = to
        return pair // count, pair % count, score

    def keep(self, item: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        may = (score > 0) & (score >= self.threshold[item])
        self.item, self.id, self.null, self.score = (np.append(a, b[may]) for a, b in ((self.item, item), (self.id, ids), (self.null, null), (self.score, score)))
        best = best_of(self.item, [self.id, self.null, -self.score], self.k)
        self.item, self.id, self.null, self.score = self.item[best], self.id[best], self.null[best], self.score[best]
        full = np.flatnonzero(np.bincount(self.item, minlength=self.threshold.size) >= self.k)
        if full.size:
            least = np.full(self.threshold.size, np.iinfo(np.int64).max)
            np.minimum.at(least, self.item, self.score)
            self.threshold[full] = np.maximum(self.threshold[full], least[full])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q.item[self.item], pa.int64()), pa.array(self.id, pa.int64(), mask=self.null), pa.array(self.score, pa.int64())], names=["item", "id", "score"])


def search_block(docs: DataFrame, block: list, id_col: str, text_col: str, k: int) -> DataFrame:
    """item, id, score: k rows of each item of the block and task at most, the item's first k among them."""
    sc = docs.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in block for t in r["terms"]}))}
    index = checkpoint(vectors(docs, id_col, text_col, sc.broadcast(vocabulary)))
    documents, terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(vocabulary)
    weight, kth, most = (np.zeros(size, np.int64) for _ in range(3))
    holding = F.floor(WEIGHT * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", holding.alias("w")).collect():
        weight[r["term"]] = r["w"]
    for r in top_impacts(index, documents, terms, k).groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("least"), F.count("*").alias("n")).collect():
        most[r["term"]], kth[r["term"]] = r["most"], r["least"] if r["n"] == k else 0
    items = sc.broadcast(Items(block, vocabulary, weight, kth, most))

    def run(batches):
        search = Search(items.value, documents, terms, k)
        for b in batches:
            search.add(b)
        yield search.rows()

    return index.mapInArrow(run, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_col, rank, id_col, score: the k best documents of each item with scores above 0."""
    spark = docs.sparkSession
    ship(spark)
    numbered = checkpoint(items.select(F.col(item_col).alias("name"), F.col(item_text).alias("t")).withColumn("item", F.monotonically_increasing_id()))
    queries = checkpoint(items_of(numbered, "t"))
    blocks = 1 + (queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        if rows := queries.filter(block == b).collect():
            part = search_block(docs, rows, id_col, text_col, k)
            # With several blocks each one's rows are written, so that its vectors and broadcasts can go.
            found = part if blocks == 1 else found.unionAll(checkpoint(part))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
it AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
tf AS (SELECT k, doc_id, len(ws)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
sc AS (SELECT q, item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
       FROM tf JOIN w USING (term) JOIN it USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM sc WHERE score > 0) WHERE rank <= 10
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
