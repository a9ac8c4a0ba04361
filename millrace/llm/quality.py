"""Quality by attention-based multiple-instance learning (operator 9).

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded by its words and
its character trigrams, hashed to ``BUCKETS`` counts each, and by the classes of its characters, word lengths and
repetition; a learned layer maps that to a hidden vector h; gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the weighted sum is classified. All
weights are learned together from document labels by Adam.

Bounds. At most ``SAMPLE`` labelled rows of each class, those with the smallest hashes of their ids, are
learned from, and of each of them ``MOST_PASSAGES`` passages at most, at equal distances. Labels, language, source and
id are never inputs. Every whole text is scored by all its passages.

Semantics. Null and empty texts are one passage without words. Labels of repeated ids count once, good if any
says so; of the texts of a repeated id the smallest is learned from. Without labels of both classes every score is
the smoothed share of good labels. Rows with a null id have a null ``held_out`` and aren't learned from. Repeated rows
and ties get equal scores. Extra columns are kept by ``score``, whatever their names, but for one named like the
score; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, map_texts, table
from .toxicity import labelled_sample, sample_rows

PASSAGE = 64
SAMPLE, MOST_PASSAGES = 3_000, 64
FOLDS, HELD_OUT = 4, 2
HIDDEN, ATTENTION = 16, 8
#: Weight of the squared weights, and documents of a training step.
RIDGE, BATCH = 3e-4, 512

CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bar": b"|", "bang": b"!?", "stop": b".,;:", "quote": b"'\"`()[]-", "symbol": b"#$%&*@^~<>{}\\/_=+", "line": b"\n\r", "blank": b" \t\x0b\x0c"}
CLASS_OF = np.full(256, len(CLASSES), dtype=np.uint8)
for _k, _chars in enumerate(CLASSES.values()):
    CLASS_OF[list(_chars)] = _k
KINDS = len(CLASSES) + 1
LINE, BLANK = list(CLASSES).index("line"), list(CLASSES).index("blank")
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
#: Hashed words and hashed trigrams of a passage, each to so many counts.
BUCKETS = 128
FORM = KINDS + 6
WIDTH = FORM + 2 * BUCKETS + 1


def encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text: FORM numbers of its form, then logarithms of hashed counts, then 1 where there is no word."""
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raws), dtype=np.int64, count=len(raws))
    begins = np.cumsum(lengths) - lengths
    kind = CLASS_OF[data]
    inside = (kind != LINE) & (kind != BLANK)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    doc = np.searchsorted(begins, starts, side="right") - 1
    words = np.bincount(doc, minlength=len(texts)) if starts.size else np.zeros(len(texts), dtype=np.int64)
    sizes = np.maximum(1, -(-words // PASSAGE))
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    rank = np.arange(starts.size) - (np.cumsum(words) - words)[doc]
    passage = first[doc] + rank // PASSAGE
    # A passage's bytes run from its first word to the next passage's.
    edges = begins.copy() if not starts.size else None
    owner = np.zeros(total, dtype=np.int64)
    owner[first] = begins
    lead = starts[rank % PASSAGE == 0] if starts.size else starts
    lead_of = passage[rank % PASSAGE == 0] if starts.size else passage
    later = np.setdiff1d(lead_of, first, assume_unique=False)
    if later.size:
        owner[later] = lead[np.searchsorted(lead_of, later)]
    del edges
    span = np.diff(np.append(owner, data.size))
    of_byte = np.repeat(np.arange(total), span)
    hist = np.bincount(of_byte * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS).astype(np.float64)
    hist[np.cumsum(sizes) - 1, LINE] -= 1  # the newline put between texts
    n = np.bincount(passage, minlength=total).astype(np.float64)
    width = stops - starts
    if starts.size:
        at = np.arange(data.size) - np.repeat(starts, np.diff(np.append(starts, data.size))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], data.size) - np.repeat(starts, np.diff(np.append(starts, data.size)))])
        mixed = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * POWERS[at & 63], np.uint64(0))
        code = np.add.reduceat(mixed, starts)
        key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
        distinct = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=total)
        same = np.concatenate([[False], (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])])
        twice = np.concatenate([[False, False], (code[2:] == code[:-2]) & (passage[2:] == passage[:-2])])[: code.size]
        repeats, seconds = np.bincount(passage, same, minlength=total), np.bincount(passage, twice, minlength=total)
        mean = np.bincount(passage, width, minlength=total) / np.maximum(1, n)
        short = np.bincount(passage, width <= 3, minlength=total)
    else:
        distinct = repeats = seconds = mean = short = np.zeros(total)
    size = np.maximum(1, hist.sum(1, keepdims=True))
    some = np.maximum(1, n)
    form = np.column_stack([hist / size, np.log1p(n), distinct / some, repeats / some, seconds / some, np.minimum(mean, 40), short / some])
    hashed = np.zeros((total, 2 * BUCKETS), dtype=np.float64)
    if starts.size:
        bucket = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)
        hashed[:, :BUCKETS] = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS)
        # Trigrams inside words, ASCII letters in lower case.
        low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint32)
        three = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:]) if data.size > 2 else starts[:0]
        mix = (low[three] * np.uint32(0x9E3779B1) ^ low[three + 1] * np.uint32(0x85EBCA6B) ^ low[three + 2] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        hashed[:, BUCKETS:] = np.bincount(of_byte[three] * BUCKETS + (mix >> np.uint32(25)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    return np.concatenate([form, np.log1p(hashed), (n == 0)[:, None].astype(float)], axis=1), sizes


def segment_sum(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, x[:, j], minlength=n) for j in range(x.shape[1])], 1) if x.ndim == 2 else np.bincount(at, x, minlength=n)


class Model:
    def __init__(self, mean, scale, weights: dict, prior: float, attend: bool = True):
        self.mean, self.scale, self.w, self.prior, self.attend = mean, scale, weights, prior, attend

    @staticmethod
    def forward(w: dict, x: np.ndarray, sizes: np.ndarray, attend: bool = True) -> dict:
        at = np.repeat(np.arange(sizes.size), sizes)
        h = np.tanh(x @ w["W"] + w["c"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"] if attend else np.zeros(len(h))
        e = np.exp(e - np.maximum.reduceat(e, np.cumsum(sizes) - sizes)[at])
        a = e / np.bincount(at, e, minlength=sizes.size)[at]
        z = segment_sum(a[:, None] * h, at, sizes.size)
        return {"at": at, "h": h, "t": t, "s": s, "a": a, "z": z, "o": z @ w["o"] + w["b"]}

    @staticmethod
    def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, shares: tuple[float, float], rounds: int = 400, ridge: float = RIDGE, attend: bool = True) -> Model:
        """attend: False weighs all passages alike, for comparison."""
        n0, n1, y_all = float((y == 0).sum()), float((y == 1).sum()), y.size
        prior = float(np.log((shares[1] + 1) / (shares[0] + 1)))
        if not n0 or not n1:
            return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, prior)
        mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        # Together the hashed counts weigh as much as the numbers of the form.
        scale[FORM:-1] *= np.sqrt(2 * BUCKETS / FORM)
        x = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
        rng = np.random.default_rng(7)
        w = {k: rng.normal(0, 0.3, s) for k, s in (("W", (WIDTH, HIDDEN)), ("V", (HIDDEN, ATTENTION)), ("U", (HIDDEN, ATTENTION)), ("a", ATTENTION), ("o", HIDDEN))} | {"c": np.zeros(HIDDEN), "b": np.array(prior)}
        weight = np.where(y == 1, shares[1] / n1, shares[0] / n0) / (shares[0] + shares[1])
        m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
        whole, begins, order = (x, sizes, y, weight), np.cumsum(sizes) - sizes, np.zeros(0, dtype=np.int64)
        for r in range(1, rounds + 1):
            # Documents come in batches, all of them before any comes again.
            if order.size < min(BATCH, y_all):
                order = np.append(order, rng.permutation(y_all))
            some, order = order[:BATCH], order[BATCH:]
            sizes, y, weight = whole[1][some], whole[2][some], whole[3][some] * (y_all / some.size)
            x = whole[0][np.arange(sizes.sum()) + np.repeat(begins[some] - (np.cumsum(sizes) - sizes), sizes)]
            f = Model.forward(w, x, sizes, attend)
            at, h, t, s, a = (f[k] for k in ("at", "h", "t", "s", "a"))
            g = weight * (1 / (1 + np.exp(-np.clip(f["o"], -40, 40))) - y)
            gz = g[:, None] * w["o"]
            gh = a[:, None] * gz[at]
            da = (gz[at] * h).sum(1)
            de = a * (da - np.bincount(at, a * da, minlength=sizes.size)[at]) * attend
            gt, gs = de[:, None] * w["a"] * s * (1 - t**2), de[:, None] * w["a"] * t * s * (1 - s)
            gh = gh + gt @ w["V"].T + gs @ w["U"].T
            gx = gh * (1 - h**2)
            grad = {"o": f["z"].T @ g, "b": g.sum(), "a": (t * s).T @ de, "V": h.T @ gt, "U": h.T @ gs, "W": x.T @ gx, "c": gx.sum(0)}
            for k in w:
                d = grad[k] + ridge * w[k] * (k not in "bc")
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                w[k] = w[k] - 0.03 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)
        return Model(mean.astype(np.float32), scale.astype(np.float32), w, prior, attend)

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        o = self.forward(self.w, np.clip((x - self.mean) / self.scale, -8, 8), sizes, self.attend)["o"] if self.w else np.full(sizes.size, self.prior)
        return 1 / (1 + np.exp(-np.clip(o, -40, 40)))


#: Bytes of text that are encoded at once.
CHUNK = 1 << 20


def scorer(model: Model):
    def fn(texts: list) -> list:
        out: list[float] = []
        part: list = []
        size = 0
        for t in [*texts, None]:
            if part and (size > CHUNK or len(out) + len(part) == len(texts)):
                out += model.scores(*encode(part)).tolist()
                part, size = [], 0
            part.append(t)
            size += len(t or "")
        return [out]

    return fn


BAG = T.StructType([T.StructField("form", T.BinaryType()), T.StructField("hashed", T.BinaryType()), T.StructField("n", T.IntegerType())])


def bags(texts: list) -> list:
    """The sampled passages of each text: numbers of the form, and the logarithms of counts in steps of 1/32, as bytes."""
    out = []
    for t in texts:
        x, _ = encode([t])
        x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), MOST_PASSAGES)).astype(np.int64))]
        out.append((x[:, :FORM].astype("<f4").tobytes(), np.minimum(255, np.rint(x[:, FORM:] * 32)).astype(np.uint8).tobytes(), len(x)))
    return [list(c) for c in zip(*out, strict=True)] or [[], [], []]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", mod: int = FOLDS, held: int = HELD_OUT, sample: int = SAMPLE) -> Model:
    ids, shares = labelled_sample(labels, id_col, label, mod, held, sample)
    rows = sample_rows(docs, ids, id_col, text_col)
    got = map_texts(rows, "__text", lambda: bags, BAG, ["__id", "y"]).toPandas().sort_values("__id", kind="stable")
    sizes = got["n"].to_numpy().astype(np.int64)
    form = np.frombuffer(b"".join(got["form"]), dtype="<f4").reshape(-1, FORM)
    hashed = np.frombuffer(b"".join(got["hashed"]), dtype=np.uint8).reshape(-1, WIDTH - FORM).astype(np.float32) / 32
    return Model.fit(np.concatenate([form, hashed], axis=1), sizes, got["y"].to_numpy().astype(np.float64), shares)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text_col, lambda: scorer(shared.value), T.StructType([T.StructField(name, T.DoubleType())]), keep)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id_col, held_out, score, predicted of each row."""
    model = train(docs, labels, id_col, text_col, **more)
    return score(docs, model, text_col, [id_col]).select(id_col, (crc_of_id(id_col) % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
