"""N-gram Jaccard join with adaptive multi-match prefixes (operator 3).

Sets are the distinct 5-word shingles of the texts; two are linked when 100 |A & B| >= 80 |A | B|.

The join. All shingles have one global order, from rare to frequent. Of a set of n shingles, the l-prefix is the
first n - ceil(0.8 n) + l in that order: linked sets share at least l shingles of their l-prefixes. Each document
picks its own l: it lengthens its prefix as long as that lowers the estimated cost, that is its own shingles to be
sent, the postings to be read and the candidates to be verified, of which there are at most postings / l. A pair is
verified only if it shares min(l, l') prefix shingles, and if the places of the shared ones leave room for the overlap
it needs.

How frequent a shingle is. One pass over all texts counts all shingles - each task adds up its own first, so a
shingle that a third of all texts hold is one number from each task - and keeps the logarithms of the counts in a
table of 2 ** ``SLOT_BITS`` bytes, the largest in each slot. The order reads that table, so it is the same for all
documents, and any such order gives right results; collisions only make a shingle look more frequent. A shingle of
an empty slot occurs once and links nothing: a document with a whole prefix of such shingles has no partner and
sends nothing on. In most texts that is so.

Groups. Equal texts are one node. Near-copy groups aren't expanded into pairs: in rounds, each prefix shingle picks
one pivot among its documents, every document is verified against the pivot it shares most with, and components
grow. Only pairs from different components are still open. How many they are is estimated, from the pairs of one node in
``SAMPLE``, before any is written. When they are few, or a round links few documents, all of them are verified, in as
many slices as their number asks for, so no link between components is missed whatever the estimate: the join finds
every link, and pairs under the similarity are never linked.

Semantics. A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. Texts of fewer than five words are one shingle,
the whole sequence; null, empty and blank texts have none and link with nothing. ``component_id`` is the smallest
id reachable, the row's own id included. Repeated rows are copies of each other. Rows with a null id link like
others; their component_id is the smallest id there, or null. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_texts, scan_parts, ship, small_batches, table
from .components import components

SHINGLE, PERCENT = 5, 80
#: Bytes of the table of counts. It is broadcast; its size is the same for any input.
SLOT_BITS = 25
#: Costs of sending a shingle and of verifying a candidate, in postings.
SEND, VERIFY = 8.0, 4.0
#: Rounds of pivots go on while more than so many pairs a node are open and a round links this share of the nodes.
OPEN, WORTH = 32, 0.03
#: Open pairs a node, about, that are written at once; one in so many nodes is asked for their number.
SLICE, SAMPLE = 64, 16
MEMO_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(words: list[bytes], memo: Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    w = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    k = min(n, size)
    h, factor = np.zeros(n - k + 1, dtype=np.uint64), _MIX
    for i in range(k):
        h = h * factor + w[i : n - k + 1 + i]
    return np.unique(mixed(h + np.uint64(k)))


# Counting.


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte plane by byte plane, and how often each occurs."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    n = np.ascontiguousarray(counts, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(d[:, :6].T).tobytes() + np.ascontiguousarray(n.T).tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(10, -1)
    d = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    d[:, :6] = planes[:6].T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[6:].T).view("<u4").ravel()


def count_table(docs: DataFrame, text_col: str, bits: int = SLOT_BITS) -> bytes:
    """The table, compressed: for each slot, 0 if its shingles occur once each, else 1 + log2(count / 2) of the most frequent."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    # As many buckets as the input has need of, so that a bucket's size doesn't grow with the input.
    bucket_bits = min(bits, max(6, (8 * scan_parts(docs) - 1).bit_length()))

    def hashes(batches):
        memo, parts, size = Words(), [], 0

        def out():
            # 40 bits: a chance clash makes a shingle look more frequent.
            h, n = np.unique(np.concatenate(parts) >> np.uint64(24), return_counts=True)
            cut = np.searchsorted(h, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(40 - bucket_bits))
            ends = np.append(cut[1:], h.size)
            full = np.flatnonzero(ends > cut)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(h[cut[i] : ends[i]], n[cut[i] : ends[i]]) for i in full], pa.binary())], names=["bucket", "keys"])

        for b in batches:
            for t in b.column(0).to_pylist():
                h = shingles(words_of(t), memo)
                parts.append(h)
                size += h.size
            if size > 3_000_000:
                yield out()
                parts, size = [], 0
        if size:
            yield out()

    def levels(t: pa.Table) -> pa.Table:
        keys, n = (np.concatenate(x) for x in zip(*map(unpack, t.column("keys").to_pylist()), strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[first], np.add.reduceat(n, first)
        keys, n = keys[n > 1], n[n > 1]
        slot = (keys >> np.uint64(40 - bits)) & np.uint64((1 << bits - bucket_bits) - 1)
        segment = np.zeros(1 << bits - bucket_bits, dtype=np.uint8)
        np.maximum.at(segment, slot.astype(np.int64), np.minimum(40, np.log2(n).astype(np.int64)).astype(np.uint8))
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "segment": pa.array([zstandard.compress(segment.tobytes(), 1)], pa.binary())})

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(hashes, "bucket int, keys binary").groupBy("bucket").applyInArrow(levels, "bucket int, segment binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    width = 1 << bits - bucket_bits
    for r in rows.toLocalIterator():  # all segments together are the table, whatever the input's size
        out[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(zstandard.decompress(bytes(r["segment"])), dtype=np.uint8)
    return zstandard.compress(out, 3)


# Prefixes.


def need(n: int) -> int:
    """ceil(0.8 n): the least overlap of a set of n with any set that it is linked to."""
    return -(-PERCENT * n // 100)


def prefix(h: np.ndarray, levels: np.ndarray, bits: int) -> tuple[int, np.ndarray, int] | None:
    """l, the shingles of the l-prefix that may be shared, and the place of the first of them; None: no partner."""
    n = h.size
    level = levels[(h >> np.uint64(64 - bits)).astype(np.int64)]
    base, alone = n - need(n) + 1, int((level == 0).sum())
    if not n or alone >= base:
        return None
    shared = level > 0
    rest, lev = h[shared], level[shared]
    order = np.lexsort((rest, lev))
    rest, lev = rest[order], lev[order]
    # Postings of the others in the l-prefix for l = 1, 2, ...
    others = np.cumsum(np.exp2(lev.astype(np.float64)) - 1)
    k = np.arange(1, need(n) + 1)
    sent = np.minimum(rest.size, base + k - 1 - alone)
    cost = SEND * sent + others[sent - 1] * (1 + VERIFY / k)
    # The shortest whose cost is within a twentieth of the least.
    best = int(k[np.argmax(cost <= cost.min() / 0.95)])
    return best, rest[: base + best - 1 - alone], alone


ROWS = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("l", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())]
)


def prefixes(table_: bytes, bits: int):
    memo, levels = Words(), np.frombuffer(zstandard.decompress(table_), dtype=np.uint8)

    def fn(texts: list) -> list:
        rows = []
        for t in texts:
            words = words_of(t)
            h = shingles(words, memo)
            found = prefix(h, levels, bits) if h.size else None
            if found is None:
                rows.append((h.size, None, None, None, None, None, None))
                continue
            body = b" ".join(words)
            c = xxhash.xxh3_128_digest(body)
            rows.append((h.size, int.from_bytes(c[:8], "big", signed=True), int.from_bytes(c[8:], "big", signed=True), found[0], found[2], found[1].view(np.int64), zstandard.compress(body, 3)))
        return [list(x) for x in zip(*rows, strict=True)] or [[] for _ in ROWS.fields]

    return fn


# Candidates and links.


def enough(na, nb, room):
    """Whether an overlap of at most ``room`` can link sets of these sizes: 180 o >= 80 (na + nb)."""
    return room * (100 + PERCENT) >= (na + nb) * PERCENT


def alike(na, nb):
    return (na * 100 >= nb * PERCENT) & (nb * 100 >= na * PERCENT)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. Each pair's texts are shingled again; the pairs come sorted by a."""
    ship(pairs.sparkSession)
    words = nodes.select("node", "words")
    half = pairs.select("a", "b").join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    full = half.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").select("a", "b", "wa", "wb")

    def run(batches):
        memo, last, have = Words(), None, None
        for t in batches:
            keep = []
            for a, wa, wb in zip(t.column(0).to_pylist(), t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                if a != last:
                    last, have = a, shingles(zstandard.decompress(wa).split(b" "), memo)
                other = shingles(zstandard.decompress(wb).split(b" "), memo)
                both = np.intersect1d(have, other, assume_unique=True).size
                keep.append(100 * both >= PERCENT * (have.size + other.size - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def room_of(a: str, b: str) -> Column:
    """Shingles that two sets may share: all but those that occur once."""
    return F.least(F.col(f"n{a}") - F.col(f"first{a}"), F.col(f"n{b}") - F.col(f"first{b}"))


def pivots(postings: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) at most for each node b: its token's pivots a of other components, the one with most shared tokens.

    A document with few shingles of its own is a token's pivot: what is near to others in a group is nearer to it.
    """
    p = postings.join(labels, "node")
    own = F.col("first") * 256 / F.col("n")
    key = F.struct((own if turn == 0 else F.floor(own / 8)).alias("k"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "first", "label")
    pivot = checkpoint(p.groupBy("token").agg(F.min(key).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("token", F.col("p.node").alias("a"), F.col("p.n").alias("n_a"), F.col("p.first").alias("first_a"), F.col("p.label").alias("label_a")))
    met = p.withColumnsRenamed({"n": "n_b", "first": "first_b"}).join(pivot, "token").filter((F.col("label") != F.col("label_a")) & alike(F.col("n_b"), F.col("n_a")) & enough(F.col("n_b"), F.col("n_a"), room_of("_a", "_b")))
    shared = met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    return shared.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def live_postings(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of shingles that documents of several components have, with the shingle's largest component."""
    p = postings.join(labels, "node")
    per = p.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("m.label").alias("main"))
    # Written, so that the join reads both its sides from exchanges of their own and can split a shingle that many have.
    return checkpoint(p.join(checkpoint(per), "token"))


def open_rows(live: DataFrame, slice_: int = 0, slices: int = 1, sample: int = 1) -> DataFrame:
    """a, b, l for each prefix shingle that two documents of different components share and that leaves room for the overlap.

    Of several slices, the pairs that fall to one by their smaller end; sample: those of one in so many nodes.
    """
    # Every open pair has an end outside the token's largest component.
    ends = live.filter(F.col("label") != F.col("main"))
    a = (ends if sample == 1 else ends.filter(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0)).select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "l", "first", "pos", "label")])
    b = live.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "l", "first", "pos", "label")], (F.col("label") != F.col("main")).alias("out"))
    least = F.least("l_a", "l_b")
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    # Shared shingles before this one are neither set's own; of those after it, and itself, there are ``room`` at most.
    whole = F.least(F.col("pos_a") - F.col("first_a"), F.col("pos_b") - F.col("first_b")) + room
    met = a.join(b, "token").filter((F.col("label_a") != F.col("label_b")) & (~F.col("out") | (F.col("node_a") < F.col("node_b"))) & alike(F.col("n_a"), F.col("n_b")) & enough(F.col("n_a"), F.col("n_b"), whole) & enough(F.col("n_a"), F.col("n_b"), room + least - 1))
    if slices > 1:
        met = met.filter(F.pmod(F.xxhash64(F.least("node_a", "node_b")), F.lit(slices)) == slice_)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), least.alias("l"))


def rest_pairs(*of) -> DataFrame:
    """All pairs of different components that share min(l, l') prefix shingles."""
    return open_rows(*of).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("l").alias("l")).filter("c >= l").select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = SLOT_BITS, report: dict | None = None) -> DataFrame:
    """id_col, n_shingles, component_id of each row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    levels = src.sparkSession.sparkContext.broadcast(count_table(src, "text", bits))
    rows = checkpoint(map_texts(src, "text", lambda: prefixes(levels.value, bits), ROWS, ["id"]).withColumn("row", F.monotonically_increasing_id()))
    levels.unpersist()
    some = rows.filter(F.col("tokens").isNotNull())
    classes = checkpoint(some.groupBy("c1", "c2").agg(F.min("row").alias("node"), F.min("id").alias("least")))
    nodes = checkpoint(some.drop("id", "c1", "c2").join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"))
    postings = nodes.select("node", "n", "l", "first", F.posexplode("tokens").alias("i", "token")).select("token", "node", "n", "l", "first", (F.col("first") + F.col("i")).alias("pos"))
    labels = nodes.select("node", F.col("node").alias("label"))
    size = nodes.count()
    turn = 0
    while True:
        found = checkpoint(verified(pivots(postings, labels, turn), nodes))
        linked, turn = found.count(), turn + 1
        if linked:
            labels = components(labels, found)
        live = live_postings(postings, labels)
        left = SAMPLE * open_rows(live, sample=SAMPLE).count()
        if report is not None:
            report.setdefault("rounds", []).append((size, linked, left))
        if left <= OPEN * size or linked <= WORTH * size:
            break
    slices = -(-left // (SLICE * size)) if left else 1
    for k in range(slices):
        live = live_postings(postings, labels) if k else live
        labels = components(labels, verified(rest_pairs(live, k, slices), nodes))
    least = labels.join(classes, "node").groupBy("label").agg(F.min("least").alias("component_id"))
    # Written, so that the join below reads both its sides from exchanges.
    of_class = checkpoint(classes.select("c1", "c2", "node").join(labels, "node").join(least, "label").select("c1", "c2", "component_id"))
    # A class of copies may hold a third of the rows: its key is read from the rows' own exchange, which a skew join can split.
    return rows.select("id", "n", "c1", "c2").join(of_class, ["c1", "c2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
