"""Spelling variants without pairs, by wildcard groups (operator 12).

Words whose spelling differs by one inserted, deleted or replaced code point are near. Each word is to get its most
frequent near word, their number, and the end of the chain that leads from word to form. Near words are never listed:

1. Words are counted in each task and then by Spark. What remains, the vocabulary, is sorted: a word's number keeps its
   place in code-point order, so everything that follows carries numbers only, however long the words are.
2. A word of length l makes l wildcard rows, one for each position, keyed by the position, what stands before and what
   stands after; as many deletion rows at most, keyed by the word without that letter; and one row of its own, keyed by
   itself. Keys are 128 bits of a hash.
3. One window over each key's rows gives its size and its first two rows: its own word first, then the most frequent,
   ties by code-point order. A wildcard group with others gives each of its words size - 1 near words, and its first
   word, or the second for the first one itself. Where a key has its own word, its deletion rows have that word near,
   and the word has all of them near, the first one best. A group has a row for each letter of the alphabet, or for
   each letter and position, so no group grows with the vocabulary.
4. What the groups give is added up by word. A form is five times as frequent as its word, so chains are short: their
   length is bounded by the logarithm of the greatest count, and pointers double in each round.

Semantics. Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z are lower-cased. Where 199 divides the crc32
of ``<id>:<run>``, the run loses the letter at crc32 modulo its length. Null texts have no runs; a null id is written
as nothing. Repeated rows count each time. Words shorter than ``LEAST_LETTERS`` or rarer than ``LEAST_COUNT`` aren't in
the vocabulary. Texts and runs are read whole, however long: the key of a long word's part comes from sums that grow
letter by letter, so a word of l letters costs l steps. Other columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship, small_batches, table

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: How many times as frequent as a word its form must be.
TIMES = 5
#: One in so many runs of a document loses a letter.
DAMAGED = 199
#: Words and letters that a task counts before it sends them on.
MOST_WORDS, MOST_LETTERS = 300_000, 8_000_000
#: Strings up to this length are hashed as they are, longer ones by sums modulo two primes.
WHOLE = 64
PRIMES, BASES = ((1 << 61) - 1, (1 << 61) - 31), (0x1B873593CC9E2D51, 0x1656A4D4EB382D4F)
ROWS = 1 << 16

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def damaged(doc_id: str, runs) -> list[tuple[str, int]]:
    """Of (run, n) the word that it counts for; runs are lower-cased."""
    base, out = zlib.crc32(f"{doc_id}:".encode()), []
    for run, n in runs:
        h = zlib.crc32(run.encode(), base)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out.append((run, n))
    return out


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int) -> DataFrame:
    """word, n: of each task's words, some of them more than once. They are to be added up."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)

    def sent(counts: Counter):
        names = list(counts)
        for i in range(0, len(names), ROWS):
            part = names[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        letters = 0
        for b in batches:
            for text, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter(RUN.findall(lowered(text)))
                for word, n in damaged(doc_id, [x for x in runs.items() if len(x[0]) >= least_letters]):
                    if len(word) >= least_letters:
                        if word not in counts:
                            letters += len(word)
                        counts[word] += n
                if len(counts) >= MOST_WORDS or letters >= MOST_LETTERS:
                    yield from sent(counts)
                    counts, letters = Counter(), 0
        yield from sent(counts)

    return docs.select(F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k")).mapInArrow(run, "word string, n long")


OWN, DELETED, WILD = 0, 1, 2


def sums(word: str) -> list[tuple[list[int], list[int], list[int]]]:
    """For each prime: sums of all beginnings, sums of all ends, powers."""
    out = []
    for p, base in zip(PRIMES, BASES, strict=True):
        head, tail, power = [0], [0], [1]
        for ch in word:
            head.append((head[-1] * base + ord(ch)) % p)
            power.append(power[-1] * base % p)
        for k, ch in enumerate(reversed(word)):
            tail.append((tail[-1] + ord(ch) * power[k]) % p)
        out.append((head, tail[::-1], power))
    return out


def keys_of(word: str):
    """(kind, 16 bytes) of a word's rows: its own, one for each different deletion, one for each position."""
    size, digest = len(word), xxhash.xxh3_128_digest
    if size <= WHOLE:
        yield OWN, digest(word.encode())
        for i in range(size):
            yield WILD, digest(f"{word[:i]}\0{word[i + 1 :]}".encode())
    else:
        s = sums(word)
        yield OWN, digest(struct.pack("<BQQQ", OWN, size, *[head[size] for head, _, _ in s]))
        for i in range(size):
            yield WILD, digest(struct.pack("<BQQ4Q", WILD, size, i, *[x for head, tail, _ in s for x in (head[i], tail[i + 1])]))
    for i in range(size):
        if i and word[i] == word[i - 1]:
            continue  # the same string as without the letter before
        if size - 1 <= WHOLE:
            yield DELETED, digest((word[:i] + word[i + 1 :]).encode())
        else:
            yield DELETED, digest(struct.pack("<BQQQ", OWN, size - 1, *[(head[i] * power[size - 1 - i] + tail[i + 1]) % p for (head, tail, power), p in zip(s, PRIMES, strict=True)]))


def key_rows(vocabulary: DataFrame) -> DataFrame:
    """hi, lo, kind, id, n for every key of every word of id, word, n."""

    def sent(kinds: bytearray, keys: bytearray, ids: list, ns: list):
        key = np.frombuffer(bytes(keys), "<i8").reshape(-1, 2)
        columns = [pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(np.frombuffer(bytes(kinds), np.int8)), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "kind", "id", "n"])

    def run(batches):
        kinds, keys, ids, ns = bytearray(), bytearray(), [], []
        for b in batches:
            for word, id_, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for kind, key in keys_of(word):
                    kinds.append(kind)
                    keys += key
                    ids.append(id_)
                    ns.append(n)
                    if len(ids) == ROWS:
                        yield sent(kinds, keys, ids, ns)
                        kinds, keys, ids, ns = bytearray(), bytearray(), [], []
        if ids:
            yield sent(kinds, keys, ids, ns)

    return vocabulary.select("word", "id", "n").mapInArrow(run, "hi long, lo long, kind byte, id long, n long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, best (n and minus the id of the most frequent near word) of words with near words."""
    group = Window.partitionBy("hi", "lo").orderBy("kind", F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("kind", "id", "n")
    rows = key_rows(vocabulary).select("kind", "id", F.count("*").over(group).alias("size"), F.first(row).over(group).alias("first"), F.nth_value(row, 2).over(group).alias("second"))
    has_own = F.col("first.kind") == OWN
    near = F.when(F.col("kind") != DELETED, F.col("size") - 1).otherwise(has_own.cast("long"))
    best = F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    found = rows.select("id", near.alias("near"), best.alias("b")).filter(F.col("near") > 0)
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct(F.col("b.n").alias("n"), (-F.col("b.id")).alias("minus"))).alias("best"))


def roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """id, root: the ends of the chains of ``id, form``. A chain's counts grow ``times``-fold at each step up to ``most``."""
    steps = int(math.log(max(most, 1), times)) + 1
    at = forms.select("id", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        to = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = checkpoint(at.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    counts = word_counts(docs, id_col, text_col, least_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    vocabulary = checkpoint(counts.orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    near = near_words(vocabulary)
    known = vocabulary.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best_id"))
    fits = F.col("best_n") >= times * F.col("n")
    known = checkpoint(known.select("id", "word", "n", "n_near", F.when(fits, F.col("best_id")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or 1
    ends = roots(known.filter("form IS NOT NULL").select("id", "form"), most, times)
    name = lambda c: vocabulary.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    changed = known.filter("form IS NOT NULL").join(ends, "id").join(name("form"), "form").join(name("root"), "root")
    alike = known.filter("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return alike.unionAll(changed.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
