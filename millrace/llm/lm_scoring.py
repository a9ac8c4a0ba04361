"""Language-model scoring with a weighted backoff automaton (operator 8).

The model is a smoothed bigram model whose n-grams are states of an automaton. The root has an arc for every
training word, weighted by its discounted share of the training tokens; what the discounts leave is the arc of
the unknown word. A word that begins kept bigrams is a state of its own: arcs with discounted conditional
log-probabilities, and one failure arc to the root whose weight makes all continuations sum to 1. A text is
scored in one traversal from left to right that carries the state and adds up arc and failure weights.

Which bigrams are kept. All that occur ``LEAST_PAIR`` times in the training texts, at every size.

Scale. Words from a share of ``WORD_SHARE`` of all tokens on, at most 1 / share, are broadcast, with their counts and
failure weights; the traversal of a task reads their root and failure arcs. All other arcs stay distributed. Each task
sends its bigrams once, with their training counts and the texts that they stand in, as packed columns, to the
partitions that hold the states. There the counts meet; what is kept and which words are rare is written; counts of
rare words that end a kept bigram are asked for and answered; and each partition gives back one sum for each text of
each task. Neither way has a hot key: the bigrams of a frequent word are spread over partitions by its count, and the
texts of a bigram that is frequent in a task are spread by task, where the bigram's count is sent after them.

Sums of distributed weights are whole numbers of 2 ** -``POINT``, so they don't depend on the order of adding. Words are
told apart by 60 bits of a hash, texts by 128; equal texts have one score.

Semantics. A-Z are lower-cased; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end. Null and empty texts
have the end alone. Training rows are those whose crc32(id as text) mod 10 isn't 0; rows with a null id are
scored but not learned from, and their ``held_out`` is null. Without training rows all counts are 0, every token
is unknown with probability 1. Rows are scored one by one, so repeated ids and texts give equal rows. Texts are scored
whole, however long. Other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, crc_of_id, scan_parts, ship, small_batches, table

FOLDS, HELD_OUT = 10, 0
#: A bigram is kept from this count on, at every size.
LEAST_PAIR = 2
#: Share of the training tokens from which on a word is broadcast.
WORD_SHARE = 1e-6
#: Share of a task's tokens, and number, from which on the texts of a bigram of two such words are spread by task.
PAIR_SHARE, LEAST_HOT = 1e-5, 64
#: Keys of words: the number among the broadcast ones, or this plus 60 bits of a hash.
RARE = 1 << 60
#: Bits of a task's number of a word and of a text; what a task holds before it sends it.
WORD_BITS, ROW_BITS = 24, 15
MOST_TOKENS, MOST_WORDS = 3_000_000, 1_500_000
#: Sums are counted in steps of 2 ** -POINT.
POINT = 36
ADD = 0.1
END = b""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8: bytes are lower-cased and split at ASCII letters and white space alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 4


END_HASH = hash_of(END)


# Packed columns, and how they are dealt to partitions.


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the bytes of one place next to each other, compressed."""
    head = struct.pack("<B", len(columns)) + b"".join(c.dtype.str[1:].encode() + struct.pack("<I", c.size) for c in columns)
    body = head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(c.size, c.itemsize).T.tobytes() for c in columns)
    return struct.pack("<Q", len(body)) + pa.compress(body, "zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack_from("<Q", blob)[0], "zstd", asbytes=True)
    n, at, kinds, out = raw[0], 1, [], []
    for _ in range(n):
        kinds.append((np.dtype(raw[at : at + 2].decode()), struct.unpack_from("<I", raw, at + 2)[0]))
        at += 6
    for kind, size in kinds:
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences: sorted numbers pack well so. ``np.cumsum`` turns them back."""
    return np.diff(x, prepend=x.dtype.type(0))


#: A message: what it is, the partition it goes to, where it comes from (a task's flush or a partition), its columns.
MESSAGE = "kind string, place long, piece long, src long, blob binary"


class Outbox:
    """Messages on their way out of a task. ``places``: for each partition a number that Spark's hash sends to it."""

    def __init__(self, places: list[int]):
        self.places, self.rows = places, []

    def put(self, kind: str, piece: int, src: int, *columns: np.ndarray) -> None:
        self.rows.append((kind, self.places[piece], piece, src, pack(*columns)))

    def batches(self):
        for i in range(0, len(self.rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows[i : i + 64], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "place", "piece", "src", "blob"])
        self.rows = []


class Parts:
    """The partitions that messages are dealt to."""

    def __init__(self, df: DataFrame):
        self.n = 2 * scan_parts(df) | 1
        # A number that Spark's hash sends to each partition, so that none gets two shares.
        ids = df.sparkSession.range(self.n * 30).select("id", F.pmod(F.hash("id"), F.lit(self.n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        place = {r["p"]: r["id"] for r in ids}
        self.places = [place.get(i, i) for i in range(self.n)]

    def run(self, messages: DataFrame, fn) -> DataFrame:
        """``fn`` takes the rows (kind, piece, src, blob) of a partition and an Outbox."""
        places = self.places

        def task(batches):
            box = Outbox(places)
            rows = ((r["kind"], r["piece"], r["src"], r["blob"]) for b in batches for r in b.to_pylist())
            for _ in fn(rows, box):
                yield from box.batches()
            yield from box.batches()

        return messages.repartition(self.n, "place").mapInArrow(task, MESSAGE)


def by_piece(rows) -> dict[int, dict[str, list]]:
    """Messages by the partition they were meant for (two may share one of Spark's) and kind."""
    out: dict[int, dict[str, list]] = {}
    for kind, piece, src, blob in rows:
        out.setdefault(piece, {}).setdefault(kind, []).append((src, blob))
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of keys."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def of_word(w: np.ndarray, n: int) -> np.ndarray:
    """The first partition of each word's bigrams."""
    return (mixed(w, np.zeros_like(w)) % np.uint64(n)).astype(np.int64)


def of_pair(a: np.ndarray, b: np.ndarray, spread: np.ndarray, n: int) -> np.ndarray:
    """The partition of each bigram: a frequent word has as many partitions as its count asks for."""
    k = np.where(a < RARE, spread[np.where(a < RARE, a, 0)], 1).astype(np.uint64)
    return (of_word(a, n) + (mixed(b, a) % k).astype(np.int64)) % n


# Words.


def word_messages(train: DataFrame, text_col: str, parts: Parts) -> DataFrame:
    """The words' hashes and counts over all training texts, added up in each task; END counts once for each text."""
    small_batches(train.sparkSession)
    ship(train.sparkSession)
    places = parts.places

    def run(batches):
        have, box = Counter(), Outbox(places)

        def out():
            h = np.fromiter(map(hash_of, have), dtype=np.int64, count=len(have))
            c = np.fromiter(have.values(), dtype=np.uint32, count=len(have))
            order = np.argsort(h)
            h, c = h[order], c[order]
            part = of_word(h, len(places))
            order = np.argsort(part.astype(np.uint32), kind="stable")
            ends = np.searchsorted(part[order], np.arange(len(places) + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                x = order[ends[i] : ends[i + 1]]
                box.put("word", i, 0, steps(h[x]), c[x])
            have.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                have.update(words_of(t))
                have[END] += 1
            if len(have) > 400_000:
                out()
                yield from box.batches()
        if have:
            out()
        yield from box.batches()

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, MESSAGE)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if keys.size else np.zeros(0, np.int64)


def add_words(rows, box: Outbox):
    """For each partition the words that occur twice at least, and the numbers of tokens, words, and words that occur once and twice."""
    for piece, of in by_piece(rows).items():
        got = [unpack(blob) for _, blob in of["word"]]
        h, c = summed(np.concatenate([np.cumsum(x[0]) for x in got]), np.concatenate([x[1] for x in got]))
        box.put("size", piece, 0, np.array([c.sum(), c.size, (c == 1).sum(), (c == 2).sum()], dtype=np.int64))
        often = (c > 1) | (h == END_HASH)
        box.put("often", piece, 0, steps(h[often]), c[often])
        yield


# Bigrams.


class Local(dict):
    """A task's numbers of words, in order of occurrence, END's first; ``keys``: their keys."""

    def __init__(self, number: dict[int, int]):
        super().__init__({END: 0})
        self.all, self.keys = number, [0]

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.keys)
        h = hash_of(word)
        self.keys.append(self.all.get(h, RARE + h))
        return i


def stream(texts: list, local: Local) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers of the words of all texts, an END before, between and after them; numbers of tokens (with END)."""
    ids, ends = [0], []
    for t in texts:
        ids += map(local.__getitem__, words_of(t))
        ids.append(0)
        ends.append(len(ids) - 1)
    return np.asarray(ids, dtype=np.int64), np.diff(np.asarray([0, *ends], dtype=np.int64))


def text_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    d = b"".join(xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts)
    x = np.frombuffer(d, dtype="<i8").reshape(-1, 2)
    return x[:, 0].copy(), x[:, 1].copy()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), starts[1], ..."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def pair_messages(src: DataFrame, parts: Parts, shared) -> DataFrame:
    """All bigrams of each flush of a task: keys, training counts, and the texts that they stand in ("pair"; "hot": the texts of frequent ones; "text": the texts' hashes)."""
    small_batches(src.sparkSession)
    ship(src.sparkSession)
    places = parts.places

    def run(batches):
        frequent, spread = shared.value
        number = {h: i for i, h in enumerate(frequent)}
        box, flushes, n = Outbox(places), 0, len(places)
        local, have, hashes, tokens, texts_held = Local(number), [], [], 0, 0

        def out():
            nonlocal local, have, hashes, tokens, texts_held, flushes
            me = (TaskContext.get().partitionId() << 24) + flushes
            keys = np.array(local.keys)
            order = np.argsort(keys)
            rank = np.empty(order.size, dtype=np.uint64)
            rank[order] = np.arange(order.size, dtype=np.uint64)
            keys = keys[order]
            v = np.concatenate([rank[x[:-1]] << np.uint64(WORD_BITS + ROW_BITS + 1) | rank[x[1:]] << np.uint64(ROW_BITS + 1) | low for x, low in have])
            have = []
            v.sort()
            pair = v >> np.uint64(ROW_BITS + 1)
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            pair = pair[first]
            times = np.diff(np.append(first, v.size))
            count = np.add.reduceat((v & np.uint64(1)).astype(np.uint32), first)
            row = (v >> np.uint64(1)).astype(np.uint16) & np.uint16((1 << ROW_BITS) - 1)
            a, b = keys[(pair >> np.uint64(WORD_BITS)).astype(np.int64)], keys[(pair & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)]
            hot = (a < RARE) & (b < RARE) & (times >= max(LEAST_HOT, PAIR_SHARE * v.size))
            part = of_pair(a, b, spread, n)

            def send(kind: str, where: np.ndarray, some: np.ndarray, counted: bool) -> None:
                order = some[np.argsort(where[some].astype(np.uint32), kind="stable")]
                ends = np.searchsorted(where[order], np.arange(n + 1))
                for i in np.flatnonzero(np.diff(ends)).tolist():
                    x = order[ends[i] : ends[i + 1]]
                    size = np.where(hot[x], 0, times[x]) if counted else times[x]
                    r = row[ranges(first[x], size)]
                    d = steps(r)
                    begin = (np.cumsum(size) - size)[size > 0]
                    d[begin] = r[begin]
                    box.put(kind, i, me, steps(a[x]), b[x], *([count[x]] if counted else []), size.astype(np.uint32), d)

            send("pair", part, np.arange(a.size), True)
            send("hot", (part + me) % n, np.flatnonzero(hot), False)
            box.put("text", me % n, me, *(np.concatenate(h) for h in zip(*hashes, strict=True)))
            local, hashes, tokens, texts_held, flushes = Local(number), [], 0, 0, flushes + 1

        for b in batches:
            for at in range(0, b.num_rows, 1 << ROW_BITS):
                texts, train = (c.to_pylist() for c in b.slice(at, 1 << ROW_BITS).columns)
                if have and texts_held + len(texts) > 1 << ROW_BITS:
                    out()
                    yield from box.batches()
                x, lengths = stream(texts, local)
                low = (np.arange(len(texts), dtype=np.uint64) + np.uint64(texts_held)) << np.uint64(1) | np.array(train, dtype=np.uint64)
                have.append((x, np.repeat(low, lengths)))
                hashes.append(text_hashes(texts))
                tokens, texts_held = tokens + x.size, texts_held + len(texts)
                if tokens > MOST_TOKENS or len(local) > MOST_WORDS:
                    out()
                    yield from box.batches()
        if have:
            out()
            yield from box.batches()

    return src.select("text", "train").mapInArrow(run, MESSAGE)


class Model:
    """What all tasks know: the frequent words' counts by number, their spread, and the sizes."""

    def __init__(self, counts: np.ndarray, n: int, v: int, n1: int, n2: int):
        self.counts, self.n, self.v = counts, n, v
        self.discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        self.total = n + ADD * (v + 1)
        self.unknown = math.log10(self.discount * v / n) if n else 0.0

    def share(self, c: np.ndarray) -> np.ndarray:
        return (c - self.discount) / self.n


def add_pairs(model):
    """Counts meet. For each partition: the kept bigrams, rare words and their texts ("kept"), the rare words' counts ("count"), questions for the
    counts of rare words that end kept bigrams ("ask"), parts of the failure weights of frequent words ("state"), and the counts of bigrams that
    were frequent in a task, to where their texts are ("visit"). Texts' hashes and those of frequent bigrams pass through."""

    def run(rows, box: Outbox):
        m, n = model.value, len(box.places)
        many: dict[int, list] = {}
        for kind, piece, src, blob in rows:
            if kind == "pair":
                many.setdefault(piece, []).append((src, blob))
            else:
                box.rows.append((kind, box.places[piece], piece, src, blob))
                yield
        for piece, got in many.items():
            src = [s for s, _ in got]
            got = [unpack(blob) for _, blob in got]
            a, b, c, size, d = (np.concatenate([np.cumsum(x[0]) if k == 0 else x[k] for x in got]) for k in range(5))
            of = np.repeat(np.arange(len(src)), [x[0].size for x in got])
            got.clear()
            h = mixed(a, b)
            order = np.argsort(h)
            new = np.append(True, h[order[1:]] != h[order[:-1]])
            first = np.flatnonzero(new)
            total = np.add.reduceat(c[order].astype(np.int64), first)
            group = np.empty(order.size, dtype=np.int64)
            group[order] = np.cumsum(new) - 1
            place = order[first]
            kept = np.flatnonzero(total >= LEAST_PAIR)
            kept = kept[np.lexsort((b[place[kept]], a[place[kept]]))]
            number = np.zeros(first.size, dtype=np.int64)
            number[kept] = np.arange(1, kept.size + 1)
            pair_of = number[group]
            ka, kb, kc = a[place[kept]], b[place[kept]], total[kept]
            rare = np.flatnonzero(a >= RARE)
            words, word_of = np.unique(a[rare], return_inverse=True)
            counts = np.bincount(word_of, c[rare], words.size).astype(np.int64)
            seen = np.flatnonzero(counts)
            number = np.zeros(words.size, dtype=np.int64)
            number[seen] = np.arange(1, seen.size + 1)
            word = np.zeros(a.size, dtype=np.int64)
            word[rare] = number[word_of]
            words, counts = words[seen], counts[seen]
            begin = np.cumsum(size.astype(np.int64)) - size
            # Their texts, by where they come from.
            use = np.flatnonzero((pair_of > 0) | (word > 0))
            use = use[size[use] > 0]
            sent = np.bincount(of[use], minlength=len(src))
            box.put("kept", piece, 0, steps(ka), kb, kc.astype(np.uint32), steps(words), counts.astype(np.uint32), np.array(src, dtype=np.int64), sent.astype(np.uint32), steps(pair_of[use]).astype(np.int32), steps(word[use]).astype(np.int32), size[use], d[ranges(begin[use], size[use].astype(np.int64))])
            yield
            often = counts >= LEAST_PAIR
            box.put("count", piece, 0, steps(words[often]), counts[often].astype(np.uint32))
            ask = np.unique(kb[kb >= RARE])
            where = of_word(ask, n)
            for i in np.unique(where).tolist():
                w = ask[where == i]
                x = np.flatnonzero((kb >= RARE) & (ka < RARE))
                x = x[of_word(kb[x], n) == i] if x.size else x
                box.put("ask", i, piece, steps(w), ka[x].astype(np.uint32), np.searchsorted(w, kb[x]).astype(np.uint32))
            yield
            x = ka < RARE
            if x.any():
                states, at = np.unique(ka[x], return_inverse=True)
                with_count = kb[x] < RARE
                box.put("state", piece, 0, states, np.bincount(at, kc[x] - m.discount), np.bincount(at, np.where(with_count, m.share(m.counts[np.where(with_count, kb[x], 0)]), 0.0)))
            visit = np.flatnonzero((size == 0) & (pair_of > 0))
            for s in np.unique(of[visit]).tolist():
                y = visit[of[visit] == s]
                box.put("visit", (piece + src[s]) % n, src[s], a[y].astype(np.uint32), b[y].astype(np.uint32), kc[pair_of[y] - 1].astype(np.uint32))
            yield

    return run


def answer(model):
    """The counts of rare words to the partitions that ask ("told"), and parts of frequent words' failure weights ("state")."""

    def run(rows, box: Outbox):
        m = model.value
        for piece, of in by_piece(rows).items():
            words, counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for _, blob in of.get("count", ()):
                w, counts = unpack(blob)
                words = np.cumsum(w)
            for who, blob in of.get("ask", ()):
                w, a, at = unpack(blob)
                c = counts[np.searchsorted(words, np.cumsum(w))].astype(np.int64)
                box.put("told", who, piece, c)
                if a.size:
                    states, k = np.unique(a.astype(np.int64), return_inverse=True)
                    box.put("state", piece, 0, states, np.zeros(states.size), np.bincount(k, m.share(c[at])))
                yield

    return run


def log10(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log10(x)


def failure(kept: np.ndarray, shares: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights of failure arcs from the kept bigrams' discounted counts, the shares of the words they end with, and the state's count."""
    return log10((1 - kept / count) / np.maximum(1e-12, 1 - shares))


def give_back(model, fail):
    """The sums of all distributed weights for each text of each flush ("sum"). Texts' hashes pass through."""

    def run(rows, box: Outbox):
        m, f, n = model.value, fail.value, len(box.places)
        held: dict[int, dict[str, list]] = {}
        for kind, piece, src, blob in rows:
            if kind == "text":
                box.rows.append((kind, box.places[piece], piece, src, blob))
                yield
            else:
                held.setdefault(piece, {}).setdefault(kind, []).append((src, blob))

        def put(src: int, row: np.ndarray, part: np.ndarray, seen: np.ndarray, base: np.ndarray) -> None:
            size = int(row.max()) + 1
            sums = [np.bincount(row, x, size) for x in (part, seen, base)]
            some = np.flatnonzero(np.bincount(row, minlength=size))
            whole = [np.rint(x[some] * (1 << POINT)).astype(np.int64) for x in (sums[0], sums[2])]
            box.put("sum", src % n, src, steps(some.astype(np.uint16)), whole[0], sums[1][some].astype(np.uint32), whole[1])

        for of in held.values():
            told = {who: unpack(blob)[0] for who, blob in of.get("told", ())}
            for _, blob in of.get("kept", ()):
                ka, kb, kc, words, counts, src, sent, pair, word, size, d = unpack(blob)
                ka, words, pair, word = np.cumsum(ka), np.cumsum(words), np.cumsum(pair.astype(np.int64)), np.cumsum(word.astype(np.int64))
                cb = np.where(kb < RARE, m.counts[np.where(kb < RARE, kb, 0)], 0)
                ask = np.unique(kb[kb >= RARE])
                where, c = of_word(ask, n), np.zeros(ask.size, dtype=np.int64)
                for i in np.unique(where).tolist():
                    c[where == i] = told[i]
                cb[kb >= RARE] = c[np.searchsorted(ask, kb[kb >= RARE])]
                at = np.minimum(np.searchsorted(words, ka), max(0, words.size - 1))
                ca = np.where(ka < RARE, m.counts[np.where(ka < RARE, ka, 0)], counts[at] if words.size else 0)
                # All bigrams of a rare word are here.
                x = ka >= RARE
                up, down = (np.bincount(at[x], w[x], words.size) for w in (kc - m.discount, m.share(cb)))
                state = np.bincount(at[x], minlength=words.size) > 0
                own = np.where(state, failure(up, down, np.maximum(1, counts)), 0.0)
                fa = np.where(x, own[at] if words.size else 0.0, f[np.where(x, 0, ka)])
                arc = np.append(0.0, log10((kc - m.discount) / np.maximum(1, ca)) - fa - log10(m.share(cb)))
                root = np.append(0.0, log10(m.share(counts)) + own - m.unknown)
                base = np.append(0.0, log10((counts + ADD) / m.total) - math.log10(ADD / m.total))
                size = size.astype(np.int64)
                ends, row = np.cumsum(sent), 0
                begin = np.cumsum(size) - size
                for s, i, j in zip(src.tolist(), (ends - sent).tolist(), ends.tolist(), strict=True):
                    if i == j:
                        continue
                    lo, hi = int(begin[i]), int(begin[j - 1] + size[j - 1])
                    # Rows come as differences inside each bigram.
                    t = np.cumsum(d[lo:hi].astype(np.int64))
                    first = begin[i:j] - lo
                    row = t - np.repeat(t[first] - d[lo:hi][first].astype(np.int64), size[i:j])
                    p, w = np.repeat(pair[i:j], size[i:j]), np.repeat(word[i:j], size[i:j])
                    put(s, row, arc[p] + root[w], w > 0, base[w])
                    if len(box.rows) > 64:
                        yield
            visits: dict[int, list] = {}
            for s, blob in of.get("visit", ()):
                visits.setdefault(s, []).append(unpack(blob))
            for s, blob in of.get("hot", ()):
                if s not in visits:
                    continue
                a, b, size, d = unpack(blob)
                a, size = np.cumsum(a), size.astype(np.int64)
                va, vb, vc = (np.concatenate(c).astype(np.int64) for c in zip(*visits[s], strict=True))
                key = mixed(va, vb)
                order = np.argsort(key)
                want = mixed(a, b)
                at = order[np.minimum(np.searchsorted(key[order], want), key.size - 1)]
                hit = key[at] == want
                c, ca, cb = vc[at], m.counts[a], m.counts[b]
                arc = np.where(hit, log10(np.maximum(1e-12, c - m.discount) / np.maximum(1, ca)) - f[a] - log10(np.maximum(1e-12, m.share(cb))), 0.0)
                t = np.cumsum(d.astype(np.int64))
                first = np.cumsum(size) - size
                row = t - np.repeat(t[first] - d[first].astype(np.int64), size)
                put(s, row, np.repeat(arc, size), np.zeros(row.size), np.zeros(row.size))
            yield

    return run


SUMS = "h1 long, h2 long, part long, seen long, base long"


def text_sums(parts: Parts, messages: DataFrame) -> DataFrame:
    """One row for each text of each flush: its hash and the sums that all partitions gave back."""

    def task(batches):
        held: dict[int, dict[str, list]] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["src"], {}).setdefault(r["kind"], []).append(r["blob"])
        for of in held.values():
            h1, h2 = unpack(of["text"][0])
            sums = np.zeros((3, h1.size), dtype=np.int64)
            for blob in of.get("sum", ()):
                row, *x = unpack(blob)
                sums[:, np.cumsum(row.astype(np.int64))] += np.stack([y.astype(np.int64) for y in x])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, *sums)], names=["h1", "h2", "part", "seen", "base"])

    return messages.repartition(parts.n, "place").mapInArrow(task, SUMS)


# The automaton.


class Automaton:
    """The part of the automaton that is broadcast.

    The state after a word is the word's own, or the root for a word without kept bigrams; so the states that one
    traversal runs through are the text's words, each a step later, and the weights along them can be read off
    arrays: ``root`` by word, ``fail`` by state, ``weight`` by arc (``arc``: state and next word as one number, sorted).
    Words are known by any names, of which ``end`` is the end's.
    """

    def __init__(self, words: dict, pairs: list[tuple], n: int, discount: float, fail: dict | None = None, end=END):
        self.names = [end, *sorted(w for w in words if w != end)]
        self.number = {w: i for i, w in enumerate(self.names)}
        counts = np.array([words.get(w, 0) for w in self.names], dtype=np.float64)
        share = (counts - discount) / n if n else counts
        # The last place is that of words that aren't here.
        with np.errstate(divide="ignore", invalid="ignore"):
            self.root = np.append(np.where(counts > 0, np.log10(np.maximum(share, 1e-300)), 0.0), 0.0)
        self.known_end = bool(counts[0])
        after: dict[int, list[tuple[int, int]]] = {}
        for a, b, c in pairs:
            after.setdefault(self.number[a], []).append((self.number[b], c))
        size = len(self.names) + 1
        self.fail = np.full(size, np.nan)
        arcs: dict[int, float] = {}
        for a, row in after.items():
            total = max(counts[a], sum(c for _, c in row))
            kept = {b: (c - discount) / total for b, c in row}
            arcs.update({a * size + b: math.log10(p) for b, p in kept.items()})
            self.fail[a] = math.log10((1 - sum(kept.values())) / max(1e-12, 1 - sum(share[b] for b in kept)))
        for w, x in (fail or {}).items():
            self.fail[self.number[w]] = x
        self.arc = np.array(sorted(arcs), dtype=np.int64)
        self.weight = np.array([arcs[k] for k in self.arc.tolist()])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, END's last; -1: a word whose root arc is elsewhere."""
        n = len(words)
        x = np.zeros(n + 1, dtype=np.int64)
        x[:n] = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=n)
        if not self.known_end:
            x[n] = -1
        return x

    def score(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The weights that this part has along a text's numbers, and which tokens took a root arc that is elsewhere."""
        return float(self.weights(np.concatenate([[0], x[:-1]]), x)[0].sum()), x < 0

    def weights(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights that this part has at each place, and where the arc of the bigram may be elsewhere."""
        out, failed = self.root[x], self.fail[state]
        inside = ~np.isnan(failed) & (state >= 0)
        take = np.flatnonzero(inside)
        open_ = inside | (state < 0)
        if take.size and self.arc.size:
            key = state[take] * (len(self.names) + 1) + x[take]
            at = np.minimum(np.searchsorted(self.arc, key), self.arc.size - 1)
            hit = (self.arc[at] == key) & (x[take] >= 0)
            out[take] = np.where(hit, self.weight[at], failed[take] + out[take])
            open_[take[hit]] = False
        else:
            out[take] += failed[take]
        return out, open_


OWN = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("own", T.DoubleType()), T.StructField("known", T.LongType()), T.StructField("own_base", T.DoubleType())]


def traverse(src: DataFrame, shared) -> DataFrame:
    """The id and hash of each text, and its sums along the broadcast part of the automaton. A rare word counts as unknown here."""
    small_batches(src.sparkSession)
    ship(src.sparkSession)
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *OWN])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        automaton, counts, total, unknown = shared.value
        none = math.log10(ADD / total)
        base = np.append(np.log10((np.array([counts.get(w, 0) for w in automaton.names], dtype=np.float64) + ADD) / total), none)
        local = Local(automaton.number)
        for r in batches:
            texts = r.column(1).to_pylist()
            if not texts:
                continue
            if len(local) > MOST_WORDS:
                local = Local(automaton.number)
            x, lengths = stream(texts, local)
            number = np.array(local.keys)
            number[number >= RARE] = -1
            if not automaton.known_end:
                number[0] = -1
            w = number[x]
            rows = np.repeat(np.arange(len(texts)), lengths)
            weight, rare = automaton.weights(w[:-1], w[1:])[0], w[1:] < 0
            sums = [np.bincount(rows, v, len(texts)) for v in (weight + rare * unknown, ~rare, base[w[1:]])]
            columns = [r.column(0), *map(pa.array, text_hashes(texts)), pa.array(lengths), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return src.select("id", "text").mapInArrow(run, schema)


def learn_words(train: DataFrame, parts: Parts) -> tuple[list[int], Model]:
    """The hashes of the frequent words, END's first, by number, and what is known of all words."""
    found = checkpoint(parts.run(word_messages(train, "text", parts), add_words))
    size = np.zeros(4, dtype=np.int64)
    for r in found.filter("kind = 'size'").select("blob").toLocalIterator():
        size += unpack(r["blob"])[0]
    least = max(2.0, WORD_SHARE * float(size[0]))

    def frequent(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                h, c = unpack(blob)
                h, use = np.cumsum(h), c >= least
                use |= h == END_HASH
                yield pa.RecordBatch.from_arrays([pa.array(h[use]), pa.array(c[use].astype(np.int64))], names=["h", "c"])

    counts = {r["h"]: r["c"] for r in found.filter("kind = 'often'").select("blob").mapInArrow(frequent, "h long, c long").toLocalIterator()}
    names = [END_HASH, *sorted(h for h in counts if h != END_HASH)]
    return names, Model(np.array([counts.get(h, 0) for h in names], dtype=np.int64), *map(int, size))


def failures(messages: DataFrame, model: Model) -> np.ndarray:
    """The failure weights of the frequent words by number: at most 1 / WORD_SHARE of them, added up from all partitions."""

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                a, kept, shares = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(kept), pa.array(shares)], names=["a", "kept", "shares"])

    out = np.zeros(model.counts.size)
    rows = messages.filter("kind = 'state'").select("blob").mapInArrow(run, "a long, kept double, shares double").groupBy("a").agg(F.sum("kept").alias("kept"), F.sum("shares").alias("shares")).toArrow()
    if rows.num_rows:
        a = rows["a"].to_numpy()
        out[a] = failure(rows["kept"].to_numpy(), rows["shares"].to_numpy(), model.counts[a])
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    learned = F.col("id").isNotNull() & (crc_of_id("id") % FOLDS != HELD_OUT)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("train", F.coalesce(learned, F.lit(False)))
    context, parts = src.sparkSession.sparkContext, Parts(src)
    names, model = learn_words(src.filter("train"), parts)
    spread = 1 + (4 * parts.n * model.counts // max(1, model.n))
    known = context.broadcast(model)
    # Written: what is kept is read by the questions, the failure weights and the sums.
    pairs = checkpoint(parts.run(pair_messages(src, parts, context.broadcast((names, np.minimum(spread, parts.n)))), add_pairs(known)))
    told = checkpoint(parts.run(pairs.filter("kind IN ('count', 'ask')"), answer(known)))
    fail = failures(pairs.unionByName(told), model)
    back = parts.run(pairs.filter("kind IN ('kept', 'hot', 'visit', 'text')").unionByName(told.filter("kind = 'told'")), give_back(known, context.broadcast(fail)))
    # Written, so that the join reads both its sides from exchanges of their own and can split the rows of a text that many have.
    sums = checkpoint(text_sums(parts, back).groupBy("h1", "h2").agg(*[F.max(c).alias(c) for c in ("part", "seen", "base")]))
    automaton = Automaton(dict(zip(names, model.counts.tolist(), strict=True)), [], model.n, model.discount, {h: x for h, x in zip(names, fail.tolist(), strict=True) if x}, end=END_HASH)
    own = traverse(src, context.broadcast((automaton, dict(zip(names, model.counts.tolist(), strict=True)), model.total, model.unknown)))
    return own.join(sums, ["h1", "h2"]).select(
        F.col("id").alias(id_col),
        (crc_of_id("id") % FOLDS == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("seen")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("own_base") + F.col("base") / float(1 << POINT)).alias("base_score"),
        (F.col("own") + F.col("part") / float(1 << POINT)).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
