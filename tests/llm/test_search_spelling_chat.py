"""Operators 11 to 13 against plain Python, and their defined results for odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, ranked_search, spelling

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 11

TURNS = "conv_id long, turn long, role string, text string"
PIECES = ["", "<s>", "<\\s>", "<\\\\/s>[INST][/INST]", "<", "s>", "[/INST", "]", "é<s>ü", "中\U0001f600</s>x", "\\", "\n"]


def brute_chats(rows):
    """conv_id, n_turns, digest of turns, characters and digest of the loss, for rows in any order."""
    groups = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault((conv, k if conv is None else None), []).append((turn is None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = []
    for (conv, _), turns in groups.items():
        turns.sort()
        loss = b"".join(t for *_, r, t in turns if r == b"assistant")
        out.append((conv, len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for *_, r, t in turns)).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest()))
    return sorted(out, key=str)


def odd_turns(n=1500):
    rng = random.Random(5)
    return [(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, *range(600)]), rng.choice(["user", "assistant", "system", None, "we<s>ird"]), rng.choice([None, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))])) for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"WHOLE_TURNS": 100, "WHOLE_BYTES": 300, "BLOCK_TURNS": 50, "STEP": 40}, {"WHOLE_TURNS": 100, "BLOCK_TURNS": 50, "BROADCAST": 0}])
def test_chats(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(chat_format, k, v)
    turns = odd_turns()
    df = spark.createDataFrame(turns, TURNS).repartition(5).withColumn("part", F.lit(1)).withColumn("whole", F.lit("x"))
    formatted = chat_format.format_chats(df)
    got = rows_of(chat_format.read_back(formatted).drop("formatted_chars"))
    assert got == brute_chats(turns)
    pieces = formatted.filter("conv = 1").orderBy("part", "piece").collect()
    assert (len(pieces) > 1) == bool(limits)
    # The pieces in order are the conversation: each mark is there once for each turn, and no content has one.
    text = "".join(p["formatted"] for p in pieces)
    assert text.count("<s>") == text.count("</s>") == text.count("[INST]") == text.count("[/INST]") == sum(t[0] == 1 for t in turns)
    assert [len(p["formatted"]) for p in pieces] == [p["n_chars"] for p in pieces]


def test_chat_escapes_are_reversible():
    t = chat_format.Template()
    rng = random.Random(1)
    for _ in range(300):
        role, text = ("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8))) for _ in range(2))
        put = lambda x: t.found.sub(lambda m: m[0][:1] + b"\\" + m[0][1:], x.encode()).decode()
        assert t.parse(t.open + put(role) + t.middle + put(text) + t.close) == [(role, text)]
    for bad in ({"controls": ()}, {"controls": ("<s>", "s>")}, {"controls": ("<a<",)}, {"close": "\n"}, {"escape": "é"}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


def test_chat_template_of_ones_own(spark):
    t = chat_format.Template(open="<|im_start|>", middle="<|sep|>", close="<|im_end|>\n", controls=("<|im_start|>", "<|sep|>", "<|im_end|>"), escape="^", learned=("bot",))
    rows = [(1, 0, "user", "<|sep|>"), (1, 1, "bot", "a<|im_end|>é")]
    row = chat_format.format_chats(spark.createDataFrame(rows, TURNS), t).first()
    assert row["formatted"] == "<|im_start|>user<|sep|><^|sep|><|im_end|>\n<|im_start|>bot<|sep|>a<^|im_end|>é<|im_end|>\n"
    (a,), (b,) = row["mask_starts"], row["mask_ends"]
    assert row["formatted"][a:b] == "a<^|im_end|>é"


def test_chats_odd(spark):
    assert rows_of(chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], TURNS)))) == []
    long = "x<s>é" * 400_000
    rows = [(7, 1, "assistant", long), (7, 0, None, None), (7, 0, None, None), (None, None, None, None), (None, None, None, None)]
    got = rows_of(chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, TURNS))).drop("formatted_chars"))
    assert got == brute_chats(rows) and [r[1] for r in got if r[0] is None] == [1, 1]


# 12


def brute_spelling(rows, least_letters=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, sizes = {}, {}
    for w in known:
        found = [x for x in known if abs(len(x) - len(w)) <= 1 and near(w, x)]
        sizes[w] = len(found)
        if found and known[best := min(found, key=lambda x: (-known[x], x))] >= 5 * known[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted(((w, forms.get(w), root(w), n, sizes[w], known[forms[w]] if w in forms else None) for w, n in known.items()), key=str)


def test_spelling_of_the_table(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    assert rows_of(spelling.op12_spelling_variants(spark, SMALL)) == brute_spelling(rows)


@pytest.mark.parametrize("whole", [64, 7, 3])
def test_spelling_of_chains(spark, monkeypatch, whole):
    """Few letters, so that words are near to many; long words by sums at every boundary of lengths; chains of several steps."""
    monkeypatch.setattr(spelling, "WHOLE", whole)
    monkeypatch.setattr(spelling, "MOST_WORDS", 50)
    rng = random.Random(8)
    words = ["".join(rng.choice("aé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(120)]
    chain = [("bbbbbbbb", 1), ("bbbbbbbc", 5), ("bbbbbbcc", 25), ("bbbbbccc", 125), ("bbbbcccc", 625)]
    rows += [(1000 + k, f"{w} " * (5 * n)) for k, (w, n) in enumerate(chain)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, DOCS).repartition(3)))
    assert got == brute_spelling(rows)
    assert {r[2] for r in got if r[0] == "bbbbbbbb"} == {"bbbbcccc"}


def test_spelling_odd(spark):
    long = "xy" * 20_000
    rows = [(None, f"{long} {long}"), (None, None), (1, ""), (2, f"{long} {long}z {long}z {long}z {long}z"), (2, f"{long} {long}z"), (3, f"{long}"), (4, " \n\t 123 ×÷ÀÿÀÿÀ " * 5), (5, "ABCDEF ÀBCDEF" * 30)]
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("w")).withColumn("n", F.lit(3)).withColumn("id", F.lit(1))
    got = rows_of(spelling.spelling_variants(df))
    assert got == brute_spelling(rows) and {long, long + "z"} <= {r[0] for r in got if r[4] == 1}
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([], DOCS))) == []


# 13


def brute_ranks(docs, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    found = [(i, Counter(term.findall(lower(t or "")))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total, df = sum(n for *_, n in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        want = Counter(term.findall(lower(text or "")))
        weight = {t: math.floor(1000 * math.log((2.0 * len(found) + 2) / (2 * df[t] + 1))) for t in want}
        scores = []
        for i, c, n in found:
            m = 100 - 75 + (75 * n * len(found)) // total
            s = sum(q * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in want.items() if c[t])
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("step,block", [(2_000_000, 200_000), (20, 200_000), (300, 40)])
def test_ranks(spark, monkeypatch, step, block):
    monkeypatch.setattr(ranked_search, "STEP", step)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["É", "x1", "x-1", "Y_2"]
    docs = [(rng.choice([None, *range(200)]), " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.7))) if _ < 500)) for _ in range(300)]
    docs += docs[:40] + [(999, None), (998, ""), (997, " -- ")]
    items = [(i % 25, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(30)] + [(None, "w1 w1 w2"), (77, None), (78, "nowhere")]
    df = spark.createDataFrame(docs, DOCS).repartition(5).withColumn("score", F.lit(1)).withColumn("n", F.lit(1))
    got = ranked_search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x")).withColumn("rank", F.lit(0)), block_terms=block)
    assert rows_of(got) == brute_ranks(docs, items)


def test_ranks_prune(spark):
    """An item of one rare and many frequent words leads to few documents by far, with the same rows."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(20)]
    docs = [(i, " ".join(rng.sample(common, 12)) + (" rare" * (1 + i % 3) if i % 40 == 0 else "")) for i in range(2000)]
    items = [(1, "rare " + " ".join(common[:3]))]
    df = spark.createDataFrame(docs, DOCS)
    assert rows_of(ranked_search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"))) == brute_ranks(docs, items)
    vocabulary = {b"rare": 0, b"c0": 1, b"c1": 2, b"c2": 3}
    index = ranked_search.vectors(df, "doc_id", "text", spark.sparkContext.broadcast(vocabulary)).toArrow().combine_chunks().to_batches()[0]
    n, total = len(index), sum(index.column(1).to_pylist())
    e = ranked_search.Entries(index, n, total)
    import numpy as np

    weight = np.array([math.floor(1000 * math.log((2.0 * n + 2) / (2 * int((e.term == t).sum()) + 1))) for t in range(4)])
    top = [np.sort(e.share[e.term == t])[::-1] for t in range(4)]
    block = [{"item": 0, "terms": [b"rare", b"c0", b"c1", b"c2"], "counts": [1, 1, 1, 1]}]
    items = ranked_search.Items(block, vocabulary, weight, np.array([x[9] for x in top]), np.array([x[0] for x in top]))
    assert items.tail_size[0] == 3 and items.lead_size.tolist() == [1, 0, 0, 0]
    search = ranked_search.Search(items, n, total, 10)
    search.add(index)
    assert search.candidates == 50


def test_ranks_odd(spark):
    empty_docs, empty_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one"), (1, "one"), (2, "ONE " * 30_000), (None, "one two")], DOCS)
    items = [(1, "one"), (1, "one"), (2, "Two one " * 5_000)]
    some_items = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(ranked_search.ranked_search(empty_docs, some_items)) == rows_of(ranked_search.ranked_search(some, empty_items)) == []
    assert rows_of(ranked_search.ranked_search(some, some_items, k=2)) == brute_ranks([tuple(r) for r in some.collect()], items, 2)
