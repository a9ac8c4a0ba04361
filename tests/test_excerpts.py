"""Excerpts equal those of SQLite's full-text search."""

import random
import sqlite3

from millrace.functions.plain import fold_tokens
from millrace.operators import excerpts as X
from millrace.operators import index as I
from millrace.operators import search as S

from .test_search import PAGES, make

SCHEMA = "section_id int, field int, text string"


def theirs(rows, phrases):
    db = sqlite3.connect(":memory:")
    n = len(rows[0])
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(f'c{i}' for i in range(n))})")
    db.executemany(f"INSERT INTO f(rowid, {', '.join(f'c{i}' for i in range(n))}) VALUES (?{', ?' * n})", [(k, *r) for k, r in enumerate(rows)])
    match = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
    return dict(db.execute("SELECT rowid, snippet(f, -1, '<<', '>>', '...', 16) FROM f WHERE f MATCH ?", (match,)).fetchall())


def ours(spark, rows, phrases):
    fields = spark.createDataFrame([(k, i, t) for k, r in enumerate(rows) for i, t in enumerate(r)], SCHEMA)
    return {r["section_id"]: r["snippet"] for r in X.excerpts(fields, phrases).collect()}


def test_equals_sqlite_on_random_texts(spark):
    rng = random.Random(9)
    words = ["ant", "bee", "cat", "Dog", "café", "café", "elk_fox", "gnu", "ÉLAN", "x"]
    gap = lambda: rng.choice([" ", " ", " ", ". ", ": ", ".\n", ".", ", ", "\n\n", " - ", " . "])

    def text(most):
        n = rng.randint(0, most)
        return rng.choice(["", "", "(", "\n"]) + "".join(rng.choice(words) + gap() for _ in range(n))

    rows = [(text(4), text(30), text(120)) for _ in range(150)]
    for phrases in (["gnu"], ["gnu", "x"], ["ant bee"], ["ant bee", "bee cat", "cat"], ["cafe", "elan gnu"], ["elk fox", "fox"], ["ant ant", "ant"]):
        phrases = [fold_tokens(p) for p in phrases]
        want, got = theirs(rows, phrases), ours(spark, rows, phrases)
        assert want and {k: got[k] for k in want} == want, phrases


def test_long_phrases_and_texts(spark):
    long = " ".join(f"w{i % 50}" for i in range(40_000))
    phrase = [f"w{i}" for i in range(10, 32)]
    rows = [(long, "w3"), ("w1 w2", " ".join(phrase) + ". w1 w2"), (" ".join(phrase * 2), "")]
    for phrases in ([phrase], [phrase, ["w12"]], [["w3"], ["w49", "w0"]]):
        want, got = theirs(rows, phrases), ours(spark, rows, phrases)
        assert {k: got[k] for k in want} == want


def test_odd_rows(spark):
    rows = [(None, ""), ("", None), ("--", ".."), ("no match here", "nor here"), ("ant", "ant")]
    assert ours(spark, rows, [["ant"]]) == {3: "no match here", 4: "<<ant>>"}
    assert ours(spark, rows[3:], [[]]) == {0: "no match here", 1: "ant"}
    assert ours(spark, rows, [["ant"]]) and spark.createDataFrame([], SCHEMA).count() == 0
    assert X.excerpts(spark.createDataFrame([], SCHEMA), [["ant"]]).count() == 0


def test_search_shows_them(spark):
    out = S.search(I.build(make(spark, PAGES)), "tenant quotas", S.Options(limit=10))["results"]
    assert out and all("<<" in r["snippet"] for r in out)
    assert any(r["snippet"] == "Quotas for each <<tenant>> of orca" or "<<tenant>> <<quotas>>" in r["snippet"] for r in out)
