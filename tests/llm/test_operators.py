"""Operators against brute force, round trips and held-out labels, and their defined results for odd inputs."""

import hashlib
import html
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, html_extraction, jaccard_join, line_dedup, lm_scoring, media, quality, token_counts, toxicity
from millrace.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
#: Nulls, empties, blanks, repeats, ties, a very long text.
ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "x y z w v u " * 4000), (7, "a\nb\nc\nd\nb\nc\nd"), (7, "a\nb\nc")]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def table(name, d=SMALL):
    return duckdb.execute(f"SELECT * FROM '{d}/{name}.parquet'").fetchall()


def texts(d=SMALL):
    return duckdb.execute(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = c.execute(oracle_sql()[name]).fetchdf()
    got = queries()[name](spark, SMALL).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


# 1


def brute_dedup(rows):
    """rows: (id, text), distinct. First occurrences by (id, line)."""
    first, gone = {}, defaultdict(set)
    for i, t in sorted(rows):
        ls = (t or "").split("\n")
        for k in range(len(ls) - 2):
            w = tuple(x.rstrip("\r") for x in ls[k : k + 3])
            if first.setdefault(w, (i, k)) != (i, k):
                gone[i].update(range(k, k + 3))
    return {i: t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcd") + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = dict(rows_of(line_dedup.line_dedup(docs(spark, rows))))
    assert got == brute_dedup(rows)


def test_line_dedup_odd(spark):
    got = rows_of(line_dedup.line_dedup(docs(spark, ODD), counts=True))
    assert len(got) == len(ODD)
    assert (1, None, 0, 0) in got and (2, "", 1, 0) in got and got.count((5, "one", 1, 0)) == 2
    assert {t for i, t, *_ in got if i == 7} in ({"a\nb\nc\nd", ""}, {"d", "a\nb\nc"})  # whichever text's hash is smaller comes first
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a", 5, "x")], "doc_id long, text string, starts int, ls string")
    assert line_dedup.line_dedup(clash).columns == ["doc_id", "text", "starts", "ls"]


# 2


@given(st.lists(st.binary(min_size=0, max_size=700), min_size=1, max_size=9), st.sampled_from([1, 3]))
@settings(max_examples=60, deadline=None)
def test_lacing(frames, lacing):
    body = media.block(1, 5, frames, lacing)
    track, at, _ = media.read_vint(body, 0)
    kind = body[at + 2] >> 1 & 3
    assert track == 1 and [body[a:b] for a, b in media.laced(body, at + 3, len(body), kind)] == frames


@given(st.binary(max_size=9000), st.sampled_from([1, 2, 3]))
@settings(max_examples=40, deadline=None)
def test_mux_round_trip(raw, lacing):
    payload = raw + b"\xff" * ((-len(raw)) % media.UNIT if raw else media.UNIT)
    c = media.Container(media.mux(payload, lacing=lacing))
    assert media.demux(c) == payload and [x[2] for x in c.cues] == c.clusters and c.tracks == {1: "A_PCM/INT/LIT"}
    assert [p[1] for p in c.packets] == [media.TICK * i for i in range(len(payload) // media.UNIT)]


def test_unknown_size_cluster():
    inner = media.uint(media.TIMESTAMP, 7) + media.element(media.SIMPLE_BLOCK, media.block(1, 2, [b"abc"]))
    seg = b"".join(media.CLUSTER.to_bytes(4, "big") + b"\xff" + inner for _ in range(2))
    data = media.element(media.EBML, media.element(media.DOC_TYPE, b"matroska")) + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + seg
    assert [(p[1], data[p[3] : p[4]]) for p in media.Container(data).packets] == [(9, b"abc")] * 2
    with pytest.raises(ValueError):
        media.Container(media.mux(b"x" * 576)[:-40])


def test_media(spark):
    got = {r.doc_id: r for r in media.media_digest(docs(spark, ODD)).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        if i != 7:
            assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    packets = media.packet_table(media.store(docs(spark, [(1, "ab" * 1000), (2, None)])))
    assert packets.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 4), (2, 1)]


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_times_of_laced_frames(lacing):
    """Files of many frames: every packet has its own time."""
    for n in (20, 300):
        payload = bytes(range(256)) * (n * 9) * 1
        payload = (payload * 2)[: n * media.UNIT]
        c = media.Container(media.mux(payload, lacing=lacing))
        assert media.demux(c) == payload and [p[1] for p in c.packets] == [72 * i for i in range(n)]
        assert len(c.clusters) == len(c.cues) == -(-n // (media.LACE * media.BLOCKS))


def matroska(*body, scale=None, tracks=b""):
    info = media.element(media.INFO, media.uint(media.TIMESTAMP_SCALE, scale)) if scale else b""
    return media.element(media.EBML, media.element(media.DOC_TYPE, b"matroska")) + media.element(media.SEGMENT, info + tracks + b"".join(body))


def test_scale_groups_and_durations():
    e, u = media.element, media.uint
    group = lambda t, frames, *more: e(media.BLOCK_GROUP, e(media.BLOCK, media.block(2, t, frames, 3)) + b"".join(more))
    cluster = e(media.CLUSTER, u(media.TIMESTAMP, 100) + group(1, [b"a"]) + group(2, [b"b"], u(media.REFERENCE_BLOCK, 1)) + group(3, [b"c", b"d"], u(media.BLOCK_DURATION, 8)) + e(media.SIMPLE_BLOCK, media.block(3, 9, [b"e", b"f"], 1)))
    c = media.Container(matroska(cluster, scale=250_000))
    assert [(p[0], p[5], p[2]) for p in c.packets] == [(2, 25_250_000, True), (2, 25_500_000, False), (2, 25_750_000, True), (2, 26_750_000, True), (3, 27_250_000, True), (3, None, True)]
    assert [p[1] for p in c.packets] == [25, 25, 25, 26, 27, None]
    tracks = e(media.TRACKS, e(media.TRACK_ENTRY, u(media.TRACK_NUMBER, 3) + u(media.DEFAULT_DURATION, 500_000)))
    assert media.Container(matroska(cluster, scale=250_000, tracks=tracks)).packets[-1][5] == 27_750_000


def test_damaged_files(spark):
    whole = media.mux(bytes(576 * 20))
    rows = [(1, whole), (2, whole[:2000]), (3, b"junk"), (4, None), (5, b""), (None, whole)]
    got = defaultdict(list)
    for r in media.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got[r.doc_id].append(r)
    assert len(got[1]) == len(got[None]) == 20 and all(r.error is None for r in got[1]) and 4 not in got and 5 not in got
    assert got[2][-1].error and got[2][-1].start is None and len(got[3]) == 1 and got[3][0].error
    for k in range(0, len(whole), 37):
        assert (media.Container(whole[:k], whole=False).error is None) == (k == 0 or k == len(whole)) or k < 60
    assert media.packet_table(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_media_odd(spark):
    clash = docs(spark, [(1, "a", "x", 2), (1, "a", "y", 3)], "doc_id long, text string, media string, n_bytes int")
    got = rows_of(media.media_digest(clash))
    assert len(got) == 2 and got[0] == got[1] and media.media_digest(docs(spark, [])).count() == 0
    long = media.media_digest(docs(spark, [(1, "ab" * 1_000_000)])).first()
    assert (long.payload_bytes, long.n_packets) == (2_000_448, 3473)


# 3


def brute_components(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[root(b)] = root(a)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    return sorted(((i, len(sets[k]), min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=6, size=14, words=60):
    """Groups of copies with random edits, passages shared by many, chains."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            base = w if rng.random() < 0.4 else base
            n += 1
    for _ in range(20):
        rows.append((n, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))])))
        n += 1
    return rows + [(n + k, rows[3][1]) for k in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = near_copies(seed)
    got = sorted(rows_of(jaccard_join.jaccard_components(docs(spark, rows), bits=16 if seed == 1 else 8)), key=str)
    assert got == brute_components(rows)


def test_jaccard_odd(spark):
    rows = [*ODD, (9, "A b C d e F"), (10, "A b"), (11, "a  B")]
    got = sorted(rows_of(jaccard_join.jaccard_components(docs(spark, rows), bits=12)), key=str)
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(docs(spark, []), bits=12).count() == 0


def test_packed_numbers():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    n = np.random.default_rng(2).integers(1, 1 << 30, x.size)
    keys, counts = jaccard_join.unpack(jaccard_join.pack(x, n))
    assert (keys == x).all() and (counts == n).all()


# 4 and 9


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    got = toxicity.score(spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id"), model, keep=["doc_id", "toxic"]).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.97
    assert ((held.score >= 0.5) & (held.toxic == 0)).sum() <= 3
    # Naming a group moves no score by much: every identity term's weight is small beside those of abuse.
    identity = [sum(model.weights.get(f, 0.0) for f in toxicity.word_features(t)) for t in toxicity.KIND]
    assert max(identity) < 0.25 * max(model.weights.values())
    assert model.scorer()(["women men gay muslim immigrants", None, ""])[0][0] < 0.5


def test_counterfactual_penalty():
    """Toxic examples that name one group more often: without the penalty its word counts, with it much less."""
    rng = random.Random(5)
    rows, y = [], []
    for i in range(400):
        toxic = i % 2
        words = {rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(4)} | ({"vile"} if toxic and rng.random() < 0.7 else set())
        words |= {"women"} if rng.random() < (0.8 if toxic else 0.2) else {"men"}
        rows.append(" ".join(sorted(words)))
        y.append(toxic)
    packed = [toxicity.Rows(np.frombuffer(b"".join(c), dtype="<i4"), np.asarray([len(x) // 4 for x in c])) for c in toxicity.sampled(rows)]
    strength = toxicity.COUNTERFACTUAL
    weight = {}
    for s in (0.0, strength):
        toxicity.COUNTERFACTUAL = s
        m = toxicity.Model.fit(*packed, np.asarray(y), (200.0, 200.0))
        weight[s] = sum(m.weights.get(f, 0.0) for f in toxicity.word_features("women")) - sum(m.weights.get(f, 0.0) for f in toxicity.word_features("men"))
    toxicity.COUNTERFACTUAL = strength
    assert weight[strength] < 0.5 * weight[0.0]


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.98


@pytest.mark.parametrize("op,label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_odd(spark, op, label):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = op(d, none).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and any(r.held_out is None for r in got)
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    got = op(d, some).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert op(docs(spark, []), some).count() == 0


def test_attention_beats_mean_pooling():
    """One passage of many decides, by what it says: all passages look alike but for their words."""
    rng = random.Random(9)
    good, bad = [f"word{i:03}" for i in range(60)], [f"spam{i:03}" for i in range(8)]
    texts, y = [], []
    for i in range(900):
        passages = [[rng.choice(good) for _ in range(quality.PASSAGE)] for _ in range(rng.randint(8, 24))]
        if i % 2:
            p = rng.choice(passages)
            for k in rng.sample(range(quality.PASSAGE), 12):
                p[k] = rng.choice(bad)
        texts.append(" ".join(w for p in passages for w in p))
        y.append(1 - i % 2)
    packed = quality.bags(texts)
    y, sizes = np.asarray(y, dtype=float), np.asarray(packed[2])
    form = np.frombuffer(b"".join(packed[0]), dtype="<f4").reshape(-1, quality.FORM)
    x = np.concatenate([form, np.frombuffer(b"".join(packed[1]), dtype=np.uint8).reshape(-1, quality.WIDTH - quality.FORM) / 32], axis=1)
    cut, right = int(sizes[:600].sum()), {}
    for attend in (True, False):
        m = quality.Model.fit(x[:cut].astype(np.float32), sizes[:600], y[:600], (300.0, 300.0), attend=attend)
        right[attend] = ((m.scores(x[cut:], sizes[600:]) >= 0.5) == (y[600:] == 1)).mean()
    assert right[True] > 0.95 and right[True] > right[False] + 0.02, right


def test_samples_are_bounded(spark):
    """Repeated ids and very long texts don't make what reaches the driver larger."""
    long = " ".join(f"w{i}" for i in range(100_000))
    assert quality.bags([long])[2] == [quality.MOST_PASSAGES]
    rows = [(i % 4, f"{long} {i}" if i < 4 else f"t {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    ids, _ = toxicity.labelled_sample(labels, "doc_id", "toxic", 1, 1, 10)
    sample = toxicity.sample_rows(docs(spark, rows), ids, "doc_id", "text")
    assert sample.count() == 4
    n0, n1 = toxicity.feature_counts(sample)
    assert n0.max() <= 2 and n1.max() <= 2
    few = set(np.flatnonzero(n0)[:50].tolist())
    assert all(len(x) <= 4 * len(few) for c in toxicity.sampled([long], few) for x in c)


def test_passages_match_a_plain_count():
    t = ["Ab! cd | EF9\n" * 40, "", None, "x", "y z " * 64]
    x, sizes = quality.encode(t)
    assert sizes.tolist() == [-(-max(1, len((s or "").split())) // quality.PASSAGE) for s in t] and len(x) == sizes.sum()
    names = list(quality.CLASSES)
    assert abs(x[sizes[0], :].sum() - x[sizes[0], -1]) < 1e-9  # an empty text has only its mark
    first = " ".join(["y z"] * 32)
    assert abs(x[-2, names.index("lower")] - 64 / len(first + " ")) < 1e-9 and abs(np.expm1(x[-2, quality.KINDS]) - 64) < 1e-6


# 5


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), []
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        m, any_ = min(10, len(w)), False
        windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
        for k in range(len(words) - m + 1):
            if m and tuple(words[k : k + m]) in windows:
                hit.update(range(k, k + m))
                any_ = True
        if any_:
            found.append(str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, block):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "Cé", "d9", "É"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 9, 10, 11, 25])] + [(90, None), (91, ""), (4, "d9, d9; a a")]
    rows = [*ODD, *[(100 + k, rng.choice([" ", "-", "\n"]).join([word() for _ in range(rng.randint(0, 30))] + items[rng.randrange(7)][1].split() * rng.randint(0, 1))) for k in range(40)]]
    got = decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    if block == 40:
        items = items[:-1] + [(4, "d9, d9; a a")]
    want = sorted(((i, *brute_hits(t, items)) for i, t in rows), key=str)
    # Two items of one id count once where they come in different blocks.
    assert [r[:3] + r[5:] for r in sorted(rows_of(got), key=str)] == [r[:3] + r[5:] for r in want]
    assert decontamination.decontaminate(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


# 6

PAGE = """<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">m{0}</a></li><li><a>n</a></li></ul></nav><!-- x -->
<header>Site</header><div class="ad banner">Buy</div><article><header><h1>Title {0} &amp;&nbsp;more</h1></header>{1}<aside>side</aside><form>f<input></form></article><section id="comments"><p>no</p></section><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows, want = [], {}
    for k in range(12):
        paragraphs = "".join(f"<p>par <b>{k}-{j}</b>\n text<br>next &lt;x&gt;" + ("</p>" if j % 2 else "") for j in range(k % 5))
        rows.append((k, f"https://h{k % 2}.example/p{k}", PAGE.format(k, paragraphs)))
        want[k] = " ".join([f"Title {k} & more"] + [f"par {k}-{j} text next <x>" for j in range(k % 5)])
    rows += [(20, None, None), (21, "junk", ""), (22, "https://h0.example/x", "<article><p>cut off in a ta<b"), (23, "https://z.example", "just words &amp; more")]
    want |= {20: "", 21: "", 22: "cut off in a ta", 23: "just words & more"}
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_tables(spark):
    got = {r.page_id: r.text for r in html_extraction.op6_html_extraction(spark, SMALL).collect()}
    for i, _, page in table("pages"):
        a = page.find("<article>") + 9
        b = page.find("</article>")
        body = re.sub(r"</?b>", "", page[a : len(page) if b < 0 else b])
        assert got[i] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split()), i


@pytest.mark.parametrize("page,want", [
    ('<div class="main-menu">m</div><div id="main-content"><div class="article-header"><h1>T</h1></div><p>x</p></div><div>z</div>', "T x"),
    ('<main><h2>no</h2><article><p>a</p><div class="share">s</div></article></main>', "a"),
    ('<div role="main">a<div class="cookie-notice">c</div> b</div>', "a b"),
    ('<p title="a > b">x</p><p>y &#8212; &eacute;&nbsp;z', "x y \u2014 \u00e9 z"),
])
def test_regions(page, want):
    assert html_extraction.Reader().text(page, None, 0) == want


def obfuscated_pages(hosts=3, each=8, seed=3):
    """Pages without telling elements or classes: (rows, main texts). A fixed box stands inside the text, varying links and teasers outside."""
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(100)) for _ in range(n))
    rows, want = [], {}
    for h in range(hosts):
        for k in range(each):
            i = h * 100 + k
            title, parts = sentence(4), [sentence(rng.randint(8, 40)) for _ in range(rng.randint(1, 5))]
            links = "".join(f'<li><a href="/{j}">{sentence(2)}</a></li>' for j in range(rng.randint(3, 6)))
            legal = f'<p class="legal-news">{sentence(9)}</p>' if k % 3 == 0 else ""
            box = "<div class=q8><p>Get our letter</p><p>Every week, free</p></div>"
            body = "".join(f"<p>{x}</p>" + (box if j == 0 else "") for j, x in enumerate(parts)) + legal
            rows.append((i, f"http://h{h}.example/{k}", f"<html><body><div class=z1><ul>{links}</ul></div><div class='k7 related-science'><h1>{title}</h1><div class=w2>{body}</div></div><div class=z9><p>{sentence(5)}</p></div><div class=b4>All rights reserved</div></body></html>"))
            want[i] = " ".join([title, *parts, *([re.search('legal-news">([^<]*)', legal)[1]] if legal else [])])
    return rows, want


PAGES = "page_id long, url string, html string"


def test_html_by_wrappers_alone(spark):
    rows, want = obfuscated_pages()
    alone = {i: html_extraction.Reader().text(page) for i, _, page in rows}
    assert all("Get our letter" in t for t in alone.values()) and sum(alone[i] == want[i] for i in want) == 0
    for parts, broadcast in ((1, 1 << 20), (50, 1 << 20), (3, 0)):
        got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, PAGES).repartition(parts), broadcast=broadcast).collect()}
        assert got == want


def test_html_class_names_are_no_evidence_against_the_text():
    read = html_extraction.Reader().text
    assert read('<article class="post related-science"><p>a</p><p class="legal-news">b</p><p class="legal">c</p></article>') == "a b"
    assert read(f'<div class="legal"><p>{"long text " * 9}</p></div><div class="ad">x</div>') == " ".join(["long text"] * 9)


def test_html_copies_keep_their_text(spark):
    """Copies on pages that differ around them are one content: what they alone have is no template."""
    page = lambda k, text: f"<body><nav><a>{k}</a></nav><div><h1>T {text}</h1><pre>same listing</pre><p>{text * 6}</p></div><p>{k}</p></body>"
    rows = [(k, "http://c.example/", page(k, "one copied text ")) for k in range(9)] + [(20 + k, "http://c.example/", f"<body><nav><a>x</a></nav><div><h1>U{k}</h1><p>{f'other{k} words ' * 9}</p></div><p>{k}</p></body>") for k in range(2)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("same listing" in got[k] for k in range(9)) and got[20].startswith("U0 other0")


def test_html_keeps_headings_that_articles_share(spark):
    """Subheadings and captions beside an article's own text are its text on every page; a fixed box with its heading isn't."""
    page = lambda k: f"<body><div><h3>Menu</h3><a href=/>home</a></div><article><h1>Title {k}</h1><p>{f'text{k} of this page ' * 12}</p><h2>Background</h2><p>{f'more{k} words here ' * 9}</p><div class=x1><h4>Join us</h4><p>Every week</p></div><h2>References</h2><p>ref {k}</p></article></body>"
    for tag in ("article", "div"):
        rows = [(k, "http://h.example/", page(k).replace("article>", f"{tag}>")) for k in range(5)]
        got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, PAGES)).collect()}
        for k in range(5):
            assert got[k] == f"Title {k} " + f"text{k} of this page " * 12 + "Background " + f"more{k} words here " * 9 + f"References ref {k}"


def test_html_comments_stay_out_however_long():
    read = html_extraction.Reader().text
    assert read("<article><p>a</p><div class='comments'><p>reader says hi there</p></div><p>b</p></article>") == "a b"
    assert read(f"<main><p>short</p><section id='comment-list'>{'<p>a long discussion of it</p>' * 30}</section></main>") == "short"
    assert read(f"<body class='comments'><p>{'the text itself ' * 9}</p></body>") == " ".join(["the text itself"] * 9)


def test_html_odd(spark):
    rows = [(None, None, None), (1, "http://a.example", ""), (1, "http://a.example", ""), (2, "http://a.example", "<p>" * 3000), (3, "http://b.example", "<article>" + "<p>long text</p><hr>" * 20_000 + "</article>")]
    got = html_extraction.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", host string, text int")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 199_999), ("None", 0)]
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(6)
    for n in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        monkeypatch.setattr(html_extraction, "CELLS", 1 << 28 if n % 2 else 4)
        pairs = html_extraction.aligned(x, y)
        assert len(pairs) == best[0][0] and all(x[i] == y[j] for i, j in pairs) and all(p < q and r < t for (p, r), (q, t) in zip(pairs, pairs[1:], strict=False))


def test_folding_has_no_limits():
    unit = [f"<t{i}" for i in range(60)]
    assert html_extraction.fold(unit * 3)[0] == [["+", unit]]
    nested: list = ["<hr"]
    for k in range(6):
        nested = (nested * 2) + [f"<s{k}"]
    nodes, leaf = html_extraction.fold(nested)
    depth = lambda x: 0 if isinstance(x, str) else 1 + max(map(depth, x[1]))
    assert max(map(depth, nodes)) == 6 and [html_extraction.leaves(nodes)[i] for i in leaf] == nested


def test_wrapper_is_union_free():
    letters = html_extraction.Letters()
    a, leaf = html_extraction.fold("<p # </p <p # </p <hr <p # </p <p # </p <hr".split(), letters)
    assert a == [["+", [["+", ["<p", "#", "</p"]], "<hr"]]] and leaf == [0, 1, 2, 0, 1, 2, 3] * 2
    b, _ = html_extraction.fold("<p # </p <div # </div".split(), letters)
    assert html_extraction.merge(["<p", "#7", "</p"], ["<p", "#8", "</p", "<hr"]) == ["<p", "#", "</p", ["?", ["<hr"]]]
    assert html_extraction.merge(b, ["<p", "#", "</p"]) == ["<p", "#", "</p", ["?", ["<div", "#", "</div"]]]


# 7


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Bpe(bpe.content_of(bpe.default_path()))


@given(st.text(st.sampled_from("ab the'sre12 \n\té!?|漢　<>"), max_size=80), st.sampled_from([1, 3, 7, 30]))
@settings(max_examples=300, deadline=None)
def test_bpe_joins(tokenizer, text, leaf):
    assert tokenizer.ids(text, leaf) == tokenizer.hf.encode(text, add_special_tokens=False).ids


def test_bpe_long_texts_of_any_script(tokenizer):
    """The tree, not the library, encodes them."""
    rng = random.Random(4)
    words = ["漢字", "かな", " العربية", " слово", "😀", " the", "\n\n", " it's", "。", " 12", "한국어"]
    text = "".join(rng.choice(words) for _ in range(60_000))
    assert len(text) > 100_000
    with ThreadPoolExecutor(3) as pool:
        ends, tokens = tokenizer.tree(text, 5000, pool)
    ids = [t for p in tokens for t in p]
    assert ends[-1] == len(text) and ids == tokenizer.hf.encode(text, add_special_tokens=False).ids == tokenizer.ids(text, 777)


def test_bpe_ids_are_not_ranks(tokenizer):
    """A file with permuted ids gives the library's ids; one whose merges can't be exact is refused."""
    spec = json.loads(bpe.content_of(bpe.default_path()))
    vocab = list(spec["model"]["vocab"])
    ids = list(range(len(vocab)))
    random.Random(1).shuffle(ids)
    spec["model"]["vocab"] = dict(zip(vocab, ids, strict=True))
    other = bpe.Bpe(json.dumps(spec))
    text = "the quick brown fox, it's 12 naïve cafés 漢字\n\n and <|endoftext|> more of the same words"
    assert other.ids(text) == other.ids(text, 5) == other.hf.encode(text, add_special_tokens=False).ids != tokenizer.ids(text)
    assert other.decode(other.ids(text)) == text
    spec["model"]["merges"].append(["the", "r"] if isinstance(spec["model"]["merges"][0], list) else "the r")
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(spec))


def test_bpe_odd(spark):
    clash = docs(spark, [(1, "a b", 7, "k0"), (1, "a b", 7, "k0"), (2, None, 0, "t")], "doc_id long, text string, n_tokens int, t string")
    out = bpe.token_digest(clash, bpe.content_of(bpe.default_path()), keep=clash.columns)
    assert sorted(out.columns) == sorted({*clash.columns, "n_tokens", "ids_sha256", "decoded_sha256"})
    assert sorted(r.n_tokens for r in out.collect()) == [0, 2, 2]
    assert bpe.token_digest(docs(spark, []), bpe.content_of(bpe.default_path())).count() == 0


@given(st.text(st.sampled_from("aethion"), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_bpe_long_piece(tokenizer, text):
    was, bpe.LEAF_BYTES = bpe.LEAF_BYTES, 4
    try:
        assert tokenizer.piece(text.encode()) == tokenizer.hf.encode(text, add_special_tokens=False).ids
    finally:
        bpe.LEAF_BYTES = was


def test_bpe(spark, tokenizer):
    rows = [*ODD, (8, "<|endoftext|> a <|endoftext|>"), (9, "x" * 40_000), (10, ("long text, it's 12 " * 3000) + "ä漢")]
    got = sorted(rows_of(bpe.token_digest(docs(spark, rows), bpe.content_of(bpe.default_path()))), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = tokenizer.hf.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.hf.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError):
        bpe.Bpe('{"pre_tokenizer": null, "model": {"type": "Unigram"}, "added_tokens": []}')


# 8


def test_lm_scoring(spark):
    rows = [(i, t) for i, t in texts()] + [r for r in ODD if r[0] is None] + [(10**6, None), (10**6 + 1, "")]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs(spark, rows)).collect()}
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), ""] for i, t in rows}
    train = [i for i in words if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for i in train for p in zip([""] + words[i][:-1], words[i], strict=True))
    n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    kept = {p: x for p, x in pairs.items() if x >= max(2, lm_scoring.PAIR_SHARE * n) and all(w == "" or c[w] >= max(2, lm_scoring.PAIR_SHARE * n) for w in p)}
    share = {w: (x - d) / n for w, x in c.items()}
    after = defaultdict(dict)
    for (a, b), x in kept.items():
        after[a][b] = (x - d) / max(c[a], 1)
    for i, w in words.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score, state = 0.0, ""
        for x in w:
            p = share.get(x, d * v / n)
            if state in after:
                row = after[state]
                p = row[x] if x in row else p * (1 - sum(row.values())) / (1 - sum(share[y] for y in row))
            score += math.log10(p)
            state = x
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * (1 + abs(base)) and abs(r.score - score) < 1e-6 * (1 + abs(score)), i
        assert r.held_out == (None if i is None else zlib.crc32(str(i).encode()) % 10 == 0)


def test_lm_automaton_sums_to_one():
    words = {b"": 3, b"a": 6, b"b": 4, b"c": 2}
    m = lm_scoring.Automaton(words, [(b"a", b"b", 3), (b"a", b"", 2), (b"", b"a", 2)], 15, 0.5)
    unknown = 0.5 * 4 / 15
    for before in ([], [b"a"], [b"b"], [b"x"]):
        ahead = m.score(m.numbers(before)[:-1])[0] if before else 0.0
        after = {w: 10 ** (m.score(np.append(m.numbers(before)[:-1], m.number.get(w, -1)))[0] - ahead) for w in [*words, b"x"]}
        after[b"x"] *= unknown
        assert abs(sum(after.values()) - 1) < 1e-9


def test_lm_keeps_every_repeated_bigram(spark, monkeypatch):
    """Shares that broadcast little or nothing don't change a score."""
    rows = [(i, t) for i, t in texts()] + [(10**6, None), (10**6 + 1, "")]
    scores = lambda: {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.lm_scores(docs(spark, rows)).collect()}
    want = scores()
    for word, pair in ((1e-3, 1e-2), (1.0, 1.0)):
        monkeypatch.setattr(lm_scoring, "WORD_SHARE", word)
        monkeypatch.setattr(lm_scoring, "PAIR_SHARE", pair)
        assert scores() == want


def test_lm_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_scoring.lm_scores(docs(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm_scoring.lm_scores(docs(spark, [])).count() == 0


# 10


@given(st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=4), max_size=12), st.text(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=300, deadline=None)
def test_longest_match(pieces, word):
    have, at, n = set(pieces), 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in have), None)
        if end is None:
            n = -1
            break
        at, n = end, n + 1
    assert token_counts.LongestMatch(pieces).count(word) == n


def test_token_counts(spark):
    got = sorted(rows_of(token_counts.token_counts(docs(spark, ODD), ["▁", "▁o", "ne", "n", "e", "▁a", "▁b"])), key=str)
    want = {(4, 1, 2, 0), (5, 1, 2, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)}
    assert want <= set(got) and len(got) == len(ODD)
    assert (None, 6, 7, 3) in got
    assert token_counts.token_counts(docs(spark, []), ["a"]).count() == 0


def test_html_copies_arent_a_template(spark):
    """Copies count once, and a text that one page alone has is main text."""
    page = lambda *xs: "<body>" + "".join(f"<h1>{x}</h1><p>and {x}</p>" for x in xs) + "<hr></body>"
    url = lambda h, i: f"http://{h}.org/{i}"
    foot = lambda x: f"<body><p>{x}</p><hr><i>Site</i></body>"
    rows = [(i, url("copies", i), page("one")) for i in range(4)]
    rows += [(10 + i, url("own", i), foot(f"text {i}")) for i in range(4)] + [(20, url("own", 9), "<body><h2>Alone</h2><p>text 9</p><hr><i>Site</i></body>")]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(4)} == {"one and one"}
    assert [got[10 + i] for i in range(4)] == [f"text {i}" for i in range(4)] and got[20] == "Alone text 9"


def test_decontamination_lists_an_item_once(spark):
    """Repeated item ids give the same in one block and in several."""
    d = docs(spark, [(1, "a b c d e f g h i j k"), (2, "x")])
    items = spark.createDataFrame([("q", "a b c d e f g h i j"), ("q", "b c d e f g h i j k"), ("r", "a b c d e f g h i j")], "item_id string, text string")
    got = [sorted(rows_of(decontamination.decontaminate(d, items, block_bytes=n))) for n in (10**6, 1)]
    assert got[0] == got[1] and [r[3] for r in got[0]] == [2, 0]


def test_decontamination_tables_are_small():
    """Flat arrays: about 50 bytes a word beside its letters, also where windows repeat."""
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for i in range(300)] * 2
    s = decontamination.Searcher(items)
    words = sum(len(t.split()) for _, t in items)
    assert s.size() < 60 * words + sum(len(t) + 1 for _, t in items)
    n, spans, found = s.search(" x ".join([items[7][1], items[9][1][:200]]), decontamination.Hashes())
    assert spans[0] == (0, 300) and {i % 300 for i in found} == {7, 9} and len(found) == 4 and n > 300


def test_decontamination_odd(spark):
    d = docs(spark, [(1, "A b c", "x", 5, "t"), (1, "A b c", "x", 5, "t"), (None, "z a B C " * 50_000, None, 6, None), (3, None, "", 1, "")], "doc_id long, text string, spans string, n_words int, __k0 string")
    items = spark.createDataFrame([(1, "a b c"), (2, None), (None, "z a")], "item_id long, text string")
    out = decontamination.find_occurrences(d, items)
    assert out.columns == ["doc_id", "text", "__k0", "n_words", "spans", "items"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].spans == [[0, 3]] and got[None].n_words == 200_000 and got[None].spans == [[0, 200_000]] and got[3].spans == []
    assert decontamination.find_occurrences(docs(spark, []), items).count() == 0


def test_lm_frequent_bigrams_are_spread(spark, monkeypatch):
    """Where the texts of frequent bigrams are spread by task, and tasks send often, scores stay the same."""
    rows = [(i, t) for i, t in texts()] + [(10**6, None), (10**6, "a b c"), (None, "a b c"), (5, "the " * 70_000)]
    d = docs(spark, rows).repartition(3).persist()
    scores = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in lm_scoring.lm_scores(d).collect())
    want = scores()
    assert len(want) == len(rows) and want[-1][1:] == next(w for w in want if w[0] == "1000000" and w[1] == 4)[1:]
    for least, tokens in ((2, 3_000_000), (2, 5_000), (10**9, 20_000)):
        monkeypatch.setattr(lm_scoring, "LEAST_HOT", least)
        monkeypatch.setattr(lm_scoring, "MOST_TOKENS", tokens)
        assert scores() == want
    d.unpersist()


def test_packed_columns():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 1 << 60, 1000), rng.integers(0, 9, 10).astype(np.uint16), np.zeros(0, np.uint32), rng.random(7)]
    back = lm_scoring.unpack(lm_scoring.pack(*columns))
    assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(columns, back, strict=True))


def brute_scores(rows):
    """score of each row by counting everything in plain dictionaries: every bigram that occurs twice is kept, no shares."""
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), ""] for _, t in rows]
    train = [w for (i, _), w in zip(rows, words, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip([""] + w[:-1], w, strict=True))
    n, v, n1, n2 = sum(c.values()), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    after = defaultdict(dict)
    for (a, b), x in pairs.items():
        if x >= 2:
            after[a][b] = (x - d) / c[a]
    share = {x: (k - d) / n for x, k in c.items()}
    fail = {a: math.log10((1 - sum(row.values())) / (1 - sum(share[b] for b in row))) for a, row in after.items()}
    root = {x: math.log10(p) for x, p in share.items()}
    out = []
    for w in words:
        score, state = 0.0, ""
        for x in w:
            row = after.get(state, {})
            score += math.log10(row[x]) if x in row else fail.get(state, 0.0) + root.get(x, math.log10(d * v / n))
            state = x
        out.append(score)
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_lm_equals_plain_counting(spark, size):
    rows = sorted(texts(f"/root/testdata/{size}"))
    got = {r.doc_id: r.score for r in lm_scoring.op8_lm_scoring(spark, f"/root/testdata/{size}").select("doc_id", "score").collect()}
    want = brute_scores(rows)
    assert len(got) == len(rows) and max(abs(got[i] - s) / (1 + abs(s)) for (i, _), s in zip(rows, want, strict=True)) < 1e-9
