"""Health candidates on small corpora of our own."""

import pytest

from millrace.operators import health as H
from millrace.operators import integrity as V
from pyspark.sql import functions as F

from .test_search import make


def rows(df):
    return [(r["type"], r["score"], list(r["pages"]), list(r["sources"]), [(x["code"], x["value"]) for x in r["reasons"]]) for r in df.collect()]


PROSE = "the turbine governor trips when bearing vibration exceeds the alarm threshold during synchronisation"


def test_duplicates_and_score(spark):
    c = make(spark, [
        ("wiki/turbine-notes.md", "Turbine trips", PROSE, ["trips", "vibration"], ["sources/a.md"], [], [("Turbine trips", PROSE)]),
        ("wiki/turbine-guide.md", "Turbine trips", PROSE, ["trips", "vibration"], ["sources/a.md"], [], [("Turbine trips", PROSE)]),
        ("wiki/other.md", "Other", "nothing in common", ["misc"], ["sources/b.md"], [], [("Other", "unrelated matter entirely")]),
        ("sources/a.md", "A", "", [], [], [], [("A", "raw")]), ("sources/b.md", "B", "", [], [], [], [("B", "raw")]),
    ])
    got = rows(H.health(c, kind="duplicates"))
    assert len(got) == 1 and got[0][0] == "possible_duplicate" and got[0][2] == ["wiki/turbine-guide.md", "wiki/turbine-notes.md"] and got[0][3] == ["sources/a.md"]
    assert [x[0] for x in got[0][4]] == ["shared_tag", "shared_tag", "shared_source", "lexical_overlap", "not_linked"]
    # tags 2 (0.02 + 0.16 / 4), source 0.05 + 0.2 / 4, lexical 0.30, same entity 0.06, not linked 0.12
    assert got[0][1] == 0.7
    assert rows(H.health(c, kind="links"))[0][0] == "possible_duplicate"


def test_older_page(spark):
    pages = [("wiki/pump-a.md", "Pump seals", PROSE, ["pump"], ["sources/a.md"], [], [("Pump seals", PROSE)]), ("wiki/pump-b.md", "Pump seals again", PROSE, ["pump"], ["sources/a.md"], [], [("Pump", PROSE)]), ("sources/a.md", "A", "", [], [], [], [("A", "raw")])]
    c = make(spark, pages)
    old = c.documents.withColumn("modified_date", F.when(F.col("path") == "wiki/pump-a.md", "2026-01-01").otherwise(F.col("modified_date")))
    got = rows(H.pairs(type(c)(old, c.sections, c.links, c.citations, c.tags)))
    assert ("older_relevant_page", "wiki/pump-a.md") in got[0][4] and "older_relevant_page" not in str(rows(H.pairs(c)))


def test_graph_sources_and_gaps(spark):
    three = [("T", "x"), ("One", "a"), ("Two", "b"), ("Three", "c")]
    c = make(spark, [
        ("wiki/hub.md", "Hub", "s", ["t"], ["sources/used.md"], ["wiki/leaf.md"], [("Hub", "\n".join("line" for _ in range(20)))]),
        ("wiki/leaf.md", "Leaf", "s", ["t"], ["sources/used.md"], [], [("Leaf", "x")]), ("wiki/alone.md", "Alone", "s", ["t"], ["sources/used.md"], [], [(None, "a\nb\nc\nd"), ("B", "a\nb\nc\nd"), ("C", "a\nb\nc\nd")]),
        ("sources/used.md", "Used", "", [], [], [], three), ("sources/unused.md", "Unused", "", [], [], [], three),
    ])
    assert [(r[0], r[2]) for r in rows(H.health(c, kind="orphans"))] == [("orphan_page", ["wiki/alone.md"]), ("underlinked_page", ["wiki/hub.md"]), ("underlinked_page", ["wiki/leaf.md"])]
    assert [(r[2], r[4][0][1]) for r in rows(H.health(c, kind="stubs"))] == [(["wiki/leaf.md"], "1 body lines"), (["wiki/alone.md"], "12 body lines")]
    got = rows(H.health(c, kind="sources"))
    assert [(r[0], r[3]) for r in got] == [("uncited_source", ["sources/unused.md"])]
    deep = c.sections.withColumn("level", F.when(F.col("ordinal") > 1, 2).otherwise(F.col("level")))
    cites = c.citations.unionByName(c.citations.limit(1).withColumn("source_anchor", F.lit("one")))
    gaps = rows(H.coverage_gaps(type(c)(c.documents, deep, c.links, cites, c.tags)))
    assert [(g[3], [x[1] for x in g[4]], g[1]) for g in gaps] == [(["sources/used.md"], ["Two", "Three"], 0.483)]


def test_tags_and_prefix(spark):
    pages = [(f"wiki/{'a' if k < 2 else 'b'}/p{k}.md", f"P{k}", "s", t, ["sources/s.md"], [], [("P", "x")]) for k, t in enumerate((["broad", "one"], ["broad", "mid"], ["broad", "mid"], ["broad"], ["other2", "mid2"]))]
    c = make(spark, pages)
    assert [(r[4][0][0], r[4][0][1]) for r in rows(H.health(c, kind="tags", limit=2))][0] == ("tag_too_broad", "broad (4/5 pages)")
    assert rows(H.health(c, kind="tags"))[0][4][0] == ("tag_too_broad", "broad (4/5 pages)")
    assert all(any(p.startswith("wiki/a/") for p in r[2]) for r in rows(H.health(c, path="wiki/a/", limit=50)))
    assert H.tag_anomalies(make(spark, pages[:2])).count() == 0
    with pytest.raises(ValueError):
        H.health(c, kind="nonsense")


@pytest.mark.parametrize("limit,want", [(10, [3, 3, 2, 1, 1]), (20, [6, 6, 4, 2, 2]), (3, [1, 1, 1, 0, 0]), (1, [1, 0, 0, 0, 0])])
def test_quotas(limit, want):
    assert H.quotas(limit) == want


def test_diversified_matches_a_plain_loop(spark):
    kinds = [t for f in H.FAMILIES for t in f]
    data = [(kinds[k % 8 if k % 3 else 0], "low", round(0.9 - (k * 7 % 30) / 40, 3), [f"p{k}"], [], [], [], "") for k in range(30)]
    df = spark.createDataFrame(data, "type string, confidence string, score double, pages array<string>, sources array<string>, reasons array<struct<code:string,value:string>>, queries array<string>, instruction string")
    key = lambda r: (-r[2], r[0], r[3][0])
    for limit in (1, 2, 3, 5, 10, 25):
        ordered, taken = sorted(data, key=key), []
        for f, q in zip(H.FAMILIES, H.quotas(limit), strict=True):
            taken += [r for r in ordered if r[0] in f][: max(1, q)]
        taken += [r for r in ordered if r not in taken][: max(0, limit - len(taken))]
        assert [r["pages"][0] for r in H.diversified(df, limit).collect()] == [r[3][0] for r in sorted(taken, key=key)[:limit]]


def test_integrity(spark):
    c = make(spark, [("wiki/a.md", "A", "s", ["t"], ["sources/s.md"], ["wiki/gone.md"], [("A", "x")]), ("sources/s.md", "S", "", [], [], [], [("S", "x")])])
    assert V.check(c).count() == 0
    bad = c.documents.withColumn("tier", F.lit("odd")).withColumn("title", F.lit(" ")).unionByName(c.documents.filter("kind = 'wiki'"))
    got = {r["rule"] for r in V.check(type(c)(bad, c.sections, c.links.withColumn("to_document_id", F.lit("x")), c.citations, c.tags)).collect()}
    assert {"tier", "title", "unique_id", "unique_path", "link_target_id"} <= got


def test_sources_and_tags_make_no_terms(spark, monkeypatch):
    """Kinds that don't use the terms of pages don't count them."""
    c = make(spark, [("wiki/a.md", "A", "s", ["t"], ["sources/s.md"], [], [("A", "x")]), ("sources/s.md", "S", "", [], [], [], [("S", "x")]), ("sources/u.md", "U", "", [], [], [], [("U", "x")])])

    def never(*_):
        raise AssertionError("terms are counted")

    monkeypatch.setattr(H.W, "term_counts", never)
    assert [r[3] for r in rows(H.health(c, kind="sources"))] == [["sources/u.md"]]
    assert rows(H.health(c, kind="tags")) == []


def test_terms_are_counted_by_page(spark):
    """Terms of a page are counted where its texts have met: its path isn't shuffled with each term."""
    c = make(spark, [("wiki/a.md", "Alpha", "beta", ["t"], [], [], [("One", "gamma gamma"), ("Two", "gamma")])])
    t = H.W.term_counts(c)
    assert {(r["term"], r["tf"]) for r in t.collect()} >= {("gamma", 3), ("alpha", 1)}
    plan = t._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    assert "hashpartitioning(path" in plan and not any("hashpartitioning(path" in x and "term" in x for x in plan.split("\n"))


def test_pairs_leave_at_their_first_key(spark, monkeypatch):
    """Small blocks, tiles and parts give each pair once, as the plain joins do; pairs aren't shuffled."""
    from millrace.operators import pair_blocks as B

    for name, n in (("BLOCK", 3), ("TILE", 2), ("PART", 2), ("PARTS", 3)):
        monkeypatch.setattr(B, name, n)
    pages = [(f"p{k}", f"k{j}") for k in range(9) for j in (0, 1 + k % 2, 3 + k % 3, 9 + k)] + [("q0", "k4"), ("q1", "k4")]
    keys = spark.createDataFrame(pages, "path string, key string")
    own = {}
    for p, k in pages:
        own.setdefault(p, set()).add(k)
    want = sorted((a, b) for a in own for b in own if a < b and own[a] & own[b])
    met = B.meetings(keys)
    assert sorted(map(tuple, met.collect())) == want
    assert not any(x in met._jdf.queryExecution().executedPlan().toString() for x in ("hashpartitioning(a", "HashAggregate"))
    weights = spark.createDataFrame([(p, f"t{(int(p[1]) * m) % 7}", 1.0 + m / 4) for p in own for m in (1, 2, 3) if p != "q1"], "path string, term string, w double").dropDuplicates(["path", "term"])
    none = spark.createDataFrame([], "path string, value string")
    seen = lambda df: sorted((r["a"], r["b"], round(r["j"], 6), tuple(r["shared_terms"])) for r in df.collect())
    got = seen(B.lexical_pairs(keys, weights, none, none, every=True))
    assert got and got == seen(H.lexical_overlap(spark.createDataFrame(want, "a string, b string"), weights))
    assert seen(B.lexical_pairs(keys, weights, none, none)) == [x for x in got if x[2] >= 0.10]


def page(name, tags, sources, body, links=()):
    return (f"wiki/{name}.md", name, "s", tags, sources, list(links), [(name, body)])


def corpus_of_pairs(spark, twins, others):
    """Twins that share a tag and a source of their own; others that share a frequent tag and, by fives, a source."""
    pages = [page(f"n{k}-{x}", ["common", f"own{k}"], [f"sources/own{k}.md"], f"{PROSE} word{k} more{k}") for k in range(twins) for x in "ab"]
    pages += [page(f"m{k % 7}-{k}", ["common", f"few{k % 5}"], [f"sources/of{k % 4}.md"], f"{PROSE if k % 3 else 'other'} term{k} thing{k % 6}", [f"wiki/m{(k + 4) % 7}-{k + 4}.md"]) for k in range(others)]
    return make(spark, pages + [(f"sources/{n}.md", n, "", [], [], [], [(n, "raw")]) for n in [*(f"own{k}" for k in range(twins)), *(f"of{k}" for k in range(4))]])


def test_best_pairs_compare_few_pages(spark, monkeypatch):
    """where twins fill the places, the pages of a frequent tag aren't copied into its blocks."""
    monkeypatch.setattr(H.C, "OLDER_PAIRS", 3)
    c, seen, blocks = corpus_of_pairs(spark, 4, 30), [], H.lexical_pairs
    monkeypatch.setattr(H, "lexical_pairs", lambda keys, *a, **b: seen.extend(r["key"] for r in keys.collect()) or blocks(keys, *a, **b))
    got = rows(H.health(c, kind="links", limit=2))
    assert [r[0] for r in got] == ["possible_duplicate"] * 2
    assert "town0" in seen and "tcommon" not in seen and not any(k.startswith("w") for k in seen)


@pytest.mark.parametrize("twins,others,older,limit", [(4, 30, 3, 2), (1, 30, 8, 5), (0, 30, 20, 25), (3, 6, 100, 25)])
def test_best_pairs_are_the_best(spark, monkeypatch, twins, others, older, limit):
    """The same as the best of all pairs: where rare signals do, where others have to be compared, and where all have to."""
    monkeypatch.setattr(H.C, "OLDER_PAIRS", older)
    c = corpus_of_pairs(spark, twins, others)
    every = H.scored_pairs(c, H.W.weighted_terms(H.W.term_counts(c), H.W.wiki_count(c)))
    seen = lambda df, n: [(r["a"], r["b"], r["type"], r["score"], list(r["shared_terms"])) for r in df.orderBy(*H.pair_order(df)).limit(n).collect()]
    for kind, path in (("links", ""), ("duplicates", ""), ("all", "wiki/m3")):
        w = H.wanted_pairs(kind, path)
        best = H.best_pairs(c, limit=limit, wanted=w, links=kind != "duplicates")
        assert seen(best, older) == seen(every, older)
        assert seen(best.filter(w), limit) == seen(every.filter(w), limit)
