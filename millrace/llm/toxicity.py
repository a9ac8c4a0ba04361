"""Toxicity by a counterfactual-regularised classifier (operator 4).

A logistic classifier over the presence of words and word beginnings; weights are not negative, so innocent
words don't make up for abuse. While it is trained, identity terms in
labelled sentences are swapped for other terms of the same kind, and half the squared change of the score (in
logits) is added to the loss, so that naming a group moves the score as little as the data allow; sentences
without such a term get one put in, once for each side of the swap.

Bounds. Labels of at most ``SAMPLE`` rows of each class, those with the smallest hashes of their ids, are
learned from; ``FEATURES`` features, chosen by the likelihood-ratio statistic of presence against the label,
have weights. What reaches the driver is bounded by these and by 2 ** ``BITS``: first how many sampled texts of each
class have each feature, then which of the chosen ones each sampled text has, however long the texts are. Labels,
language, source and id are never inputs. Every whole text is scored.

Semantics. Null and empty texts have no features; their score is the intercept's. Labels of repeated ids
count once, toxic if any says so; of the texts of a repeated id the smallest is learned from. Without labels of both
classes every score is the smoothed share of toxic labels. Rows with a null id have a null ``held_out`` and aren't
learned from. Repeated rows and ties get equal scores; very long texts are scored whole. Extra columns are kept
by ``score``, whatever their names, but for one named like the score; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, crc_of_id, map_texts, ship, small_batches, table

SAMPLE = 3_000
FEATURES = 4_000
#: Features are known by this many bits of a hash of their text.
BITS = 20
#: Weights of the loss: squared weights, and squared score changes of counterfactual pairs.
RIDGE, COUNTERFACTUAL = 2e-4, 1.0
FOLDS, HELD_OUT = 5, 0
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 300_000

#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY = {
    "gender": ["women", "men", "woman", "man", "girls", "boys", "transgender", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews"],
    "origin": ["african", "asian", "european", "american", "mexican", "chinese", "german", "french", "spanish", "immigrants", "refugees"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer"],
    "colour": ["black", "white", "brown"],
    "age and health": ["old", "young", "elderly", "deaf", "blind", "disabled", "autistic"],
}
KIND = {t: k for k, terms in IDENTITY.items() for t in terms}


def word_features(w: str) -> list[int]:
    """A word and its beginnings of three to seven letters, hashed."""
    raw = [f"={w}"] + [f"^{w[:n]}" for n in range(3, min(7, len(w)) + 1)]
    return [zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in raw]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swapped(words: set[str], seed: int) -> tuple[set[str], set[str]]:
    """A pair of word sets that differ by their identity terms alone."""
    terms = sorted(w for w in words if w in KIND)
    rest = words - set(terms)
    if not terms:
        kinds = list(IDENTITY)
        terms = [IDENTITY[k := kinds[seed % len(kinds)]][seed // len(kinds) % len(IDENTITY[k])]]
    others = [IDENTITY[KIND[t]][(IDENTITY[KIND[t]].index(t) + 1 + seed % (len(IDENTITY[KIND[t]]) - 1)) % len(IDENTITY[KIND[t]])] for t in terms]
    return rest | set(terms), rest | set(others)


def features_of(words: set[str]) -> list[int]:
    out: set[int] = set()
    for w in words:
        out.update(word_features(w))
    return sorted(out)


SAMPLE_FIELDS = T.StructType([T.StructField(c, T.BinaryType()) for c in ("plain", "a", "b")])


def packed(features: list[int]) -> bytes:
    return np.asarray(features, dtype="<i4").tobytes()


def sampled(texts: list, chosen: set[int] | None = None) -> list:
    """Hashed features of each text, and those by which the two sides of its counterfactual pair differ; of all or of the chosen ones."""
    plain, left, right = [], [], []
    of = lambda words: [f for f in features_of(words) if chosen is None or f in chosen]
    for t in texts:
        words = words_of(t)
        x, y = swapped(words, zlib.crc32((t or "").encode("utf-8", "replace")))
        fx, fy = set(of(x)), set(of(y))
        plain.append(packed(of(words)))
        left.append(packed(sorted(fx - fy)))
        right.append(packed(sorted(fy - fx)))
    return [plain, left, right]


class Rows:
    """Feature numbers of many rows, one after the other, and how many each row has."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes

    @staticmethod
    def of(column) -> Rows:
        """From an Arrow column of packed features, without copying them."""
        a = column.combine_chunks()
        a = a.chunk(0) if hasattr(a, "chunk") and a.num_chunks else a
        if not len(a):
            return Rows(np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64))
        ends = np.frombuffer(a.buffers()[1], dtype="<i4", count=len(a) + 1, offset=a.offset * 4)
        return Rows(np.frombuffer(a.buffers()[2], dtype="<i4", count=int(ends[-1] - ends[0]) // 4, offset=int(ends[0])), np.diff(ends) // 4)

    def counts(self, of_rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat[np.repeat(of_rows, self.sizes)], minlength=size)

    def cells(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and chosen-feature numbers of the non-zero cells."""
        place = np.full(1 << BITS, -1, dtype=np.int16 if chosen.size < 1 << 15 else np.int32)
        place[chosen] = np.arange(chosen.size)
        col = place[self.flat]
        have = col >= 0
        return np.repeat(np.arange(self.sizes.size, dtype=np.int32), self.sizes)[have], col[have].astype(np.int32)


def choose(counts: tuple[np.ndarray, np.ndarray], n0: float, n1: float) -> np.ndarray:
    """The features with weights, from how many sampled texts of each class have each, and the identity terms'."""
    p0, p1 = (counts[0] + 0.5) / (n0 + 1), (counts[1] + 0.5) / (n1 + 1)
    p = (counts[0] + counts[1] + 1) / (n0 + n1 + 2)
    ratio = sum(c * np.log(q / p) + (n - c) * np.log((1 - q) / (1 - p)) for c, q, n in ((counts[0], p0, n0), (counts[1], p1, n1)))
    ratio[(counts[0] + counts[1] < 3) | (p1 <= p0)] = -np.inf
    chosen = np.argsort(-ratio, kind="stable")[: min(FEATURES, int(np.isfinite(ratio).sum()))]
    return np.union1d(chosen, np.unique([f for t in KIND for f in word_features(t)]))


class Model:
    """weights by hashed feature, and the intercept."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    @staticmethod
    def fit(plain: Rows, left: Rows, right: Rows, labels: np.ndarray, shares: tuple[float, float], rounds: int = 250, chosen: np.ndarray | None = None) -> Model:
        """shares: labelled rows of class 0 and 1, from which the sample was drawn; chosen: the features, where the rows have no others."""
        y = labels.astype(np.float64)
        n0, n1 = float((y == 0).sum()), float((y == 1).sum())
        prior = float(np.log((shares[1] + 1) / (shares[0] + 1)))
        if not n0 or not n1:
            return Model({}, prior)
        if chosen is None:
            chosen = choose((plain.counts(y == 0, 1 << BITS), plain.counts(y == 1, 1 << BITS)), n0, n1)
        (at, col), (la, lc), (ra, rc) = plain.cells(chosen), left.cells(chosen), right.cells(chosen)
        n, k = y.size, chosen.size
        # Each class weighs as much as it has labelled rows, so the scores are probabilities of the whole table.
        weight = np.where(y == 1, shares[1] / n1, shares[0] / n0) / (shares[0] + shares[1])
        w, b = np.zeros(k), prior
        m, v, step = np.zeros(k + 1), np.zeros(k + 1), 0.05
        for t in range(1, rounds + 1):
            z = np.bincount(at, w[col], minlength=n) + b
            g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            change = np.bincount(la, w[lc], minlength=n) - np.bincount(ra, w[rc], minlength=n)
            c = COUNTERFACTUAL * weight * change
            grad = np.append(np.bincount(col, g[at], minlength=k) + np.bincount(lc, c[la], minlength=k) - np.bincount(rc, c[ra], minlength=k) + RIDGE * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(0.0, w - move[:-1]), b - move[-1]
        return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, float(b))

    def scorer(self):
        weights, intercept = self.weights, self.intercept
        memo: dict[str, tuple] = {}

        def fn(texts: list) -> list:
            out = []
            for t in texts:
                found: set[int] = set()
                for w in words_of(t):
                    have = memo.get(w)
                    if have is None:
                        have = memo[w] = tuple(f for f in word_features(w) if f in weights)
                    if have:
                        found.update(have)
                z = intercept + sum(weights[f] for f in sorted(found))
                out.append(float(1 / (1 + np.exp(-min(40.0, max(-40.0, z))))))
                if len(memo) > MEMO_WORDS:
                    memo.clear()
            return [out]

        return fn


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def labelled_sample(labels: DataFrame, id_col: str, label: str, mod: int, held: int, sample: int) -> tuple[DataFrame, tuple[float, float]]:
    """A broadcast of at most ``sample`` training ids of each class (__id, y), and how many labelled rows each class has."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (crc_of_id(id_col) % mod != held)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("y"))
    counts = {int(r["y"]): float(r["n"]) for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = lambda k: one.filter(F.col("y") == k).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = [(r["__id"], int(r["y"])) for k in (0, 1) for r in part(k).collect()]
    schema = T.StructType([T.StructField("__id", labels.schema[id_col].dataType), T.StructField("y", T.IntegerType())])
    return F.broadcast(labels.sparkSession.createDataFrame(rows, schema)), (counts.get(0, 0.0), counts.get(1, 0.0))


def sample_rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, y, __text: one row of each sampled id, written, as they are read more than once."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(ids, "__id")
    return checkpoint(rows.groupBy("__id", "y").agg(F.min("__text").alias("__text")))


def feature_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each feature how many of the rows of class 0 and 1 have it. Tasks add up first; what arrives has 2 ** BITS rows at most."""
    small_batches(rows.sparkSession)
    ship(rows.sparkSession)

    def run(batches):
        have = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have[y, features_of(words_of(t))] += 1
        some = np.flatnonzero(have.sum(0))
        if some.size:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x[some]) for x in have)], names=["f", "n0", "n1"])

    got = rows.select("__text", "y").mapInArrow(run, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for k in (0, 1):
        counts[k][got["f"].to_numpy()] = got[f"n{k}"].to_numpy()
    return counts


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", mod: int = FOLDS, held: int = HELD_OUT, sample: int = SAMPLE) -> Model:
    ids, shares = labelled_sample(labels, id_col, label, mod, held, sample)
    rows = sample_rows(docs, ids, id_col, text_col)
    n = {r["y"]: float(r["count"]) for r in rows.groupBy("y").count().collect()}
    chosen = choose(feature_counts(rows), n.get(0, 0.0), n.get(1, 0.0))
    got = map_texts(rows, "__text", lambda: (lambda few: lambda texts: sampled(texts, few))(set(chosen.tolist())), SAMPLE_FIELDS, ["__id", "y"]).toArrow().sort_by("__id")
    return Model.fit(Rows.of(got["plain"]), Rows.of(got["a"]), Rows.of(got["b"]), got["y"].to_numpy(), shares, chosen=chosen)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the score to the columns ``keep`` (all). The model, at most FEATURES weights, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text_col, lambda: shared.value.scorer(), T.StructType([T.StructField(name, T.DoubleType())]), keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id_col, held_out, score, predicted of each row."""
    model = train(docs, labels, id_col, text_col, **more)
    return score(docs, model, text_col, [id_col]).select(id_col, (crc_of_id(id_col) % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
