"""Search on a small corpus of our own, and its ranking against SQLite's full-text search."""

import random
import sqlite3

import pytest

from millrace import schema as C
from millrace.functions.plain import fold_tokens
from millrace.operators import excerpts as E
from millrace.operators import index as I
from millrace.operators import search as S
from millrace.operators.corpus import Corpus, facts_from_documents

DOC = "id string, path string, kind string, tier string, title string, summary string, tags array<string>, sources array<string>, links array<string>, modified_date string, hash string, size_bytes long"
SEC = "section_id string, document_id string, path string, ordinal int, heading string, anchor string, level int, body string"


def make(spark, pages):
    """pages: (path, title, summary, tags, sources, links, [(heading, body)...])."""
    docs, secs = [], []
    for n, (path, title, summary, tags, sources, links, parts) in enumerate(pages):
        kind = "wiki" if path.startswith("wiki/") else "source"
        tier = next((t for t in ("design", "reference") if f"/{t}/" in path), "canonical")
        i = f"doc_{n:032x}" if kind == "wiki" else f"source_{n:032x}"
        docs.append((i, path, kind, tier, title, summary, sorted(tags), sorted(sources), sorted(links), "2026-05-06" if kind == "wiki" else "", f"h{n}", 10))
        secs += [(f"{i}#section-{k:04d}", i, path, k, h, h and h.lower().replace(" ", "-"), h and 1, b) for k, (h, b) in enumerate(parts, 1)]
    d, s = spark.createDataFrame(docs, DOC), spark.createDataFrame(secs, SEC)
    return Corpus(d, s, *facts_from_documents(d))


PAGES = [
    ("wiki/orca-shrink.md", "Orca Shrink", "How to shrink orca safely", ["orca", "shrink"], ["sources/orca.md"], ["wiki/kiln-limits.md"], [("Orca Shrink", "Shrink orca one zone at a time."), ("Checks", "orca shrink checks before the drain")]),
    ("wiki/orca-quotas.md", "Orca Quotas", "Quotas for each tenant of orca", ["orca", "quotas"], ["sources/orca.md"], [], [("Orca Quotas", "tenant quotas of orca override the defaults")]),
    ("wiki/kiln-limits.md", "Kiln Limits", "Tenant limits of kiln", ["kiln", "limits"], ["sources/mixed.md"], [], [("Kiln Limits", "kiln applies tenant limits per tenant")]),
    ("wiki/kiln-growth.md", "Kiln Growth", "Growing kiln", ["kiln"], ["sources/mixed.md"], [], [("Kiln Growth", "growth of kiln and its rings"), ("Sources", "kiln growth growth growth"), (None, "kiln growth notes"), ("More", "kiln growth more"), ("Last", "kiln growth last")]),
    ("sources/orca.md", "Orca raw", "", [], [], [], [("Orca raw", "raw notes: orca shrink, tenant quotas")]),
    ("sources/mixed.md", "Mixed raw", "", [], [], [], [("Mixed raw", "difference of tenant quotas between orca and kiln limits")]),
]


@pytest.fixture(scope="module")
def index(spark):
    i = I.build(make(spark, PAGES))
    return I.Index(*[t.cache() for t in (i.postings, i.sections, i.stats)])


def test_parse():
    assert S.parse('what is "per tenant" AND sources/x_y.md?').atoms == ["per tenant", "sources x_y md"]
    assert S.parse('"the').atoms == ["the"]
    with pytest.raises(ValueError):
        S.parse("what is the")


def test_top_and_reading(index):
    out = S.search(index, "orca shrink", S.Options(limit=10))
    assert out["mode"] == "and" and out["results"][0]["path"] == "wiki/orca-shrink.md" and out["results"][0]["score"] < out["results"][0]["lexical_score"]
    assert out["read_order"] == ["wiki/orca-shrink.md"] and out["recommended_sections"][0]["target"] == "wiki/orca-shrink.md#orca-shrink"
    assert "<<" in out["results"][0]["snippet"]


def test_fallback_and_coverage(index):
    assert S.search(index, "orca nonexistent")["mode"] == "or_fallback"
    out = S.search(index, "difference tenant quotas orca kiln")
    assert out["mode"] == "or_fallback" and out["read_order"][0] == "wiki/orca-quotas.md" and out["coverage"] == {"entities": {"orca": True, "kiln": True}, "missing": []}
    none = S.search(index, "absentterm")
    assert none["results"] == [] and none["stop_rule"] == S.STOP_NONE


def test_cap_phrase_and_headings(index):
    out = S.search(index, "kiln growth", S.Options(limit=20))
    assert sum(r["path"] == "wiki/kiln-growth.md" for r in out["results"]) == C.SECTIONS_PER_DOCUMENT
    assert out["results"][0]["heading"] != "Sources"
    assert S.search(index, '"tenant limits"')["results"] and not S.search(index, '"limits tenant"')["results"]


@pytest.mark.parametrize("options,test", [
    ({"kind": "source"}, lambda r: r["kind"] == "source"), ({"path": "WIKI/kiln"}, lambda r: r["path"].startswith("wiki/kiln")),
    ({"tags": ["orca", "quotas"]}, lambda r: r["path"] == "wiki/orca-quotas.md"), ({"sources": ["sources/mixed.md"]}, lambda r: "sources/mixed.md" in r["sources"]), ({"tiers": ["canonical"]}, lambda r: r["tier"] == "canonical"),
])
def test_filters(index, options, test):
    rows = S.search(index, "tenant orca kiln", S.Options(limit=100, **options))["results"]
    assert rows and all(map(test, rows)) and len(rows) <= C.SEARCH_MOST


@pytest.mark.parametrize("bad", [{"kind": "x"}, {"path": "../x"}, {"path": "/x"}, {"tags": ["No"]}, {"sources": ["wiki/a.md"]}, {"tiers": ["x"]}])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        S.Options(**bad).checked()


def test_against_sqlite(spark):
    """The same scores as a full-text engine with weighted columns, on random texts with phrases and accents."""
    rng = random.Random(4)
    word = lambda: rng.choice(["ant", "bee", "cat", "dog", "café", "elk_fox", "gnu"])
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    pages = [(f"wiki/{word()}-{k}.md", text(3) or "ant", text(6), [rng.choice(["ant", "bee"])], [f"sources/{rng.choice('xy')}.md"], [], [(text(3) or None, text(25)) for _ in range(rng.randint(1, 3))]) for k in range(25)]
    c = make(spark, pages)
    i = I.build(c)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, path, summary, tags, sources, links, heading, body)")
    for r in I.section_fields(c).collect():
        db.execute("INSERT INTO f VALUES (?,?,?,?,?,?,?,?,?)", (r["section_id"], r["title"], r["path"], r["summary"], r["tags"], r["sources"], r["links"], r["heading"], r["body"]))
    for q in ("ant", "cat bee", '"ant bee"', "cafe dog dog", "elk_fox gnu"):
        parsed = S.parse(q)
        for mode in ("and", "or"):
            match = f" {mode.upper()} ".join(f'"{a}"' for a in parsed.atoms)
            want = dict(db.execute("SELECT id, bm25(f, 0, 5.0, 3.0, 4.0, 2.0, 2.0, 1.5, 3.0, 1.0) FROM f WHERE f MATCH ?", (match,)).fetchall())
            got = {r["section_id"]: r["lexical_score"] for r in S.bm25(i, parsed, mode).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), q


def test_index_on_disk(index, spark, tmp_path):
    index.write(str(tmp_path / "i"))
    again = I.Index.read(spark, str(tmp_path / "i"))
    assert S.search(again, "orca shrink") == S.search(index, "orca shrink")
    plan = S.bm25(again, S.parse("orca"))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term" in plan or "In(term" in plan


def test_snippet(spark):
    t = " ".join(f"w{i}" for i in range(60))
    s = E.excerpts(spark.createDataFrame([("s", 0, t)], "section_id string, field int, text string"), [fold_tokens("w30")]).first()["snippet"]
    assert s.startswith("...") and s.endswith("...") and "<<w30>>" in s and len(s.split()) == 16


def test_tokens_equal_sqlites_on_every_code_point(spark):
    """All code points that Unicode 3.2 assigns, as SQLite's tables are older than ours, but for two that have become marks since."""
    import unicodedata

    from pyspark.sql import functions as F

    from millrace.functions import text as X

    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    points = [i for i in range(1, 0x110000) if unicodedata.ucd_3_2_0.category(chr(i)) not in ("Cn", "Cs", "Co") and i not in (0x1885, 0x1886)]
    points += [0xE000, 0xF8FF, 0xF0000, 0x10FFFD]  # private ones
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", ((i, f"a{chr(i)}b") for i in points))
    want: dict = {i: [] for i in points}
    for doc, term in db.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    assert [hex(i) for i in points if fold_tokens(f"a{chr(i)}b") != want[i]] == []
    df = spark.createDataFrame([(i, f"a{chr(i)}b") for i in points], "i int, x string").select("i", X.tokens(F.col("x")).alias("t"))
    assert [hex(r["i"]) for r in df.collect() if r["t"] != want[r["i"]]] == []


def test_one_search_makes_tokens_once(spark):
    """Searches for the same terms share what an unwritten index has made for them; terms are added up before any shuffle."""
    c = make(spark, [(f"wiki/p{k}.md", "Alpha", "alpha", ["t"], [], [], [("H", "alpha beta"), ("I", "beta")]) for k in range(3)])
    i, q = I.build(c), S.parse("alpha beta")
    both = [sorted(map(str, S.ranked(i, q, S.Options().checked(), mode, 6).drop("body").collect())) for mode in ("and", "or")]
    assert len(i.made) == 1 and len(both[0]) == 6 and len(both[1]) == 6
    written = I.Index(i.postings, i.sections, i.stats)
    assert both == [sorted(map(str, S.ranked(written, q, S.Options().checked(), mode, 6).drop("body").collect())) for mode in ("and", "or")]
    got = sorted(map(tuple, i.totals().select("term", "n", "sections").collect()))
    assert got == sorted(map(tuple, written.totals().select("term", "n", "sections").collect())) and ("alpha", 15, 6) in got
    plan = i.totals()._jdf.queryExecution().executedPlan().toString()
    assert "section_id" not in plan.split("MapInArrow")[0]
