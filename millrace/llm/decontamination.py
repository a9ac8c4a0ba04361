"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 5).

Patterns are the windows of ``WINDOW`` consecutive words of benchmark items; an item of fewer words is one
shorter pattern. For each pattern length a shift table, addressed by the hash of a block of two words, says how far
the search may move when that block ends at a position; blocks of one address share the smallest shift. Where it
is 0, a second table asks whether any pattern ends with that block and begins with that first word; if so, the
suffix-hash bucket names the patterns, and direct comparison of their text confirms them. Most of a document's
words are never looked at.

Bounds. The test strings are a stated query set. They are searched in blocks of at most ``BLOCK_BYTES`` of UTF-8 (or
one item), whose tables are a few flat arrays, of about 50 bytes a word, so half a GB in the worst case (words of one
letter) and a third of that in prose; they are built once, on the driver, and broadcast. With more than one block, each is a pass of its own over what the one before wrote to the
checkpoint folder, so a worker holds the tables of one block whatever the benchmark's size.

Semantics. A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A document word inside any
occurrence is hit, once. Null and empty texts have no words and no hits. Repeated rows get equal rows. Items of
one id are listed once; items of equal text are each listed. Very long texts are searched whole. Extra columns
are kept, whatever their names, but for those named like a result. An empty benchmark hits nothing; an empty
documents table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII, checkpoint, map_texts, table

WINDOW = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Benchmark text that is searched for at once.
BLOCK_BYTES = 16 << 20
#: Words whose hashes a task remembers. The memory is cleared when full: it bounds memory, never results.
MEMO_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER_ASCII) if not text.isascii() else text.lower()) if text else []


class Hashes(dict):
    """32 bits of each word's hash."""

    def __missing__(self, w: str) -> int:
        self[w] = h = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


#: Odd factors by which two words' hashes become one address.
NEAR, FAR = 0x9E3779B1, 0x85EBCA77


def mixed(x: int | np.ndarray):
    """The upper bits of a 64-bit product, so that all bits of both words count."""
    return x ^ (x >> 29)


class WuManber:
    """The windows of one length of a block's items, as flat arrays. ``find`` yields (first word, item numbers).

    ``text`` has the items' words, each with a space after it; ``begin`` the place of each word there. Equal windows
    are one pattern, known by the word it begins with. Patterns are sorted by their bucket: the hash of the last block.
    """

    def __init__(self, length: int, words: list[list[str]], numbers: list[int]):
        self.m, self.block = length, min(2, length)
        m, b = self.m, self.block
        memo = Hashes()
        raw = [[w.encode("utf-8", "surrogatepass") for w in ws] for ws in words]
        self.text = b"".join(w + b" " for ws in raw for w in ws)
        sizes = np.fromiter((len(w) + 1 for ws in raw for w in ws), dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)
        h = np.fromiter((memo[w] for ws in words for w in ws), dtype=np.uint64)
        memo.clear()
        item = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        at = np.arange(h.size) - np.concatenate([[0], np.cumsum([len(ws) for ws in words])])[item]
        # The block that ends at each word; words that begin an item end none of two words.
        key = self.key(h, np.concatenate([h[:1], h[:-1]])) if b == 2 else self.key(h, h)
        ends = at >= b - 1
        bits = max(10, int(4 * h.size).bit_length())
        self.mask = (1 << min(bits, 27)) - 1
        # A block ends some window at once where m words end there, else the first window of its item some words later.
        shift = np.full(self.mask + 1, m - b + 1, dtype=np.uint8)
        later = np.maximum(0, m - 1 - at)
        np.minimum.at(shift, (key[ends] & np.uint64(self.mask)).astype(np.int64), later[ends].astype(np.uint8))
        self.shift = shift.tobytes()
        last = np.flatnonzero(at >= m - 1)
        first = last - (m - 1)
        # Equal windows are found by their text's hash, taken word by word.
        whole = np.zeros(last.size, dtype=np.uint64)
        for k in range(m):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[first + k] + np.uint64(1)
        order = np.lexsort((numbers_of := np.asarray(numbers)[item[last]], whole, key[last]))
        last, first, whole = last[order], first[order], whole[order]
        new = np.ones(last.size, dtype=bool)
        new[1:] = (key[last[1:]] != key[last[:-1]]) | (whole[1:] != whole[:-1])
        # Windows of one hash but other words are patterns of their own.
        for i in np.flatnonzero(~new):
            new[i] = self.letters(first[i]) != self.letters(first[i - 1])
        of = numbers_of[order]
        self.bucket, self.first = key[last[new]], first[new].astype(np.int32)
        self.starts = np.append(np.flatnonzero(new), last.size).astype(np.int32)
        self.items = of.astype(np.int32)
        both = mixed(self.bucket * np.uint64(FAR) + h[self.first])
        wide = max(10, int(8 * both.size).bit_length())
        self.wide = (1 << min(wide, 28)) - 1
        some = np.zeros(self.wide + 1, dtype=np.uint8)
        some[(both & np.uint64(self.wide)).astype(np.int64)] = 1
        self.some = some.tobytes()

    @staticmethod
    def key(last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return mixed(last * np.uint64(NEAR) + before)

    def letters(self, first: int) -> bytes:
        return self.text[self.begin[first] : self.begin[first + self.m]]

    def size(self) -> int:
        """Bytes held."""
        return len(self.text) + len(self.shift) + len(self.some) + sum(x.nbytes for x in (self.begin, self.bucket, self.first, self.starts, self.items))

    def named(self, key: int, words: bytes) -> list[int]:
        """The items of the pattern that is ``words``, from its suffix block's bucket."""
        i = int(np.searchsorted(self.bucket, np.uint64(key)))
        out: list[int] = []
        while i < self.bucket.size and int(self.bucket[i]) == key:
            if self.letters(self.first[i]) == words:
                out += self.items[self.starts[i] : self.starts[i + 1]].tolist()
            i += 1
        return out

    def find(self, words: list[str], h: Hashes):
        m, b, n, shift, mask, some, wide = self.m, self.block, len(words), self.shift, self.mask, self.some, self.wide
        end, low = m, 0xFFFFFFFFFFFFFFFF
        while end <= n:
            x = h[words[end - 1]] * NEAR + h[words[end - b]] & low
            x ^= x >> 29
            step = shift[x & mask]
            if step:
                end += step
                continue
            first = end - m
            y = x * FAR + h[words[first]] & low
            if some[(y ^ y >> 29) & wide] and (items := self.named(x, "".join(w + " " for w in words[first:end]).encode("utf-8", "surrogatepass"))):
                yield first, items
            end += 1


class Searcher:
    """The tables of one block of items. They are built once and sent to the tasks as they are."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids: list[str] = []
        by: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item_id, text in items:
            if w := words_of(text):
                words, numbers = by[min(window, len(w))]
                words.append(w)
                numbers.append(len(self.ids))
                self.ids.append(str(item_id))
        self.tables = [WuManber(m, *by[m]) for m in sorted(by)]

    def size(self) -> int:
        return sum(t.size() for t in self.tables)

    def search(self, text: str | None, h: Hashes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words, merged ranges of hit words, item numbers."""
        words, ranges, items = words_of(text), [], set()
        for t in self.tables:
            for first, found in t.find(words, h):
                ranges.append((first, first + t.m))
                items.update(found)
            if len(h) > MEMO_WORDS:
                h.clear()
        ranges.sort()
        merged: list[tuple[int, int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, items


SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def search_block(docs: DataFrame, items: list[tuple], text_col: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Searcher(items))

    def make():
        s, h = shared.value, Hashes()

        def fn(texts: list) -> list:
            got = [s.search(t, h) for t in texts]
            return [[g[0] for g in got], [g[1] for g in got], [list(dict.fromkeys(s.ids[i] for i in sorted(g[2]))) for g in got]]

        return fn

    return map_texts(docs, text_col, make, FOUND, keep)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Lists of (id, text), each of at most ``limit`` bytes of text or one item; one list is held at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        n = len((row["t"] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    yield block


def find_occurrences(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` (all columns but those named like a result) with n_words, spans (merged ranges of hit words) and items of each document.

    With more than one block, each adds its own to what its predecessor wrote; rows never meet in a shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FOUND.names]
    out = None
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        if out is None:
            src = docs.select(F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
            out = search_block(src, block, "__text", src.columns)
        else:
            before = checkpoint(out).withColumnsRenamed({"spans": "__spans", "items": "__items"}).drop("n_words")
            more = search_block(before, block, "__text", before.columns)
            out = more.withColumn("spans", F.concat("__spans", "spans")).withColumn("items", F.array_union("__items", "items")).drop("__spans", "__items")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items")


def hits(spans):
    """Number of words in the union of ranges; ranges of several blocks may overlap."""
    ordered = F.array_sort(spans)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], acc["end"]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end"))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = find_occurrences(docs, benchmark, text_col, keep=[id_col], **more)
    return found.select(
        id_col,
        "n_words",
        hits(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS words
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS words
      FROM (SELECT doc_id, ws, size, unnest(range(1, greatest(1, len(ws) - size + 2))) AS i FROM w, (SELECT DISTINCT size FROM p))),
m AS (SELECT DISTINCT d.doc_id, d.i, d.size, p.item_id FROM d JOIN p USING (size, words)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""
