"""Markdown parsing, the tree reader, snapshots, changelog, imports, streaming."""

import pytest

from millrace.functions import markdown as M
from millrace.operators import integrity as V
from millrace.plans import changelog as L
from millrace.plans import snapshot as D
from millrace.plans import views as G
from millrace.sources import importer, markdown_tree
from millrace.streaming import incremental
from pyspark.sql import functions as F


def parts(body):
    return [(s.ordinal, s.heading, s.anchor, s.level, s.body) for s in M.sections(body)]


def test_sections():
    assert parts("intro\n\n# A\n\nx\n\n## B b\ny\n## B b\n") == [(1, None, None, None, "intro"), (2, "A", "a", 1, "x"), (3, "B b", "b-b", 2, "y"), (4, "B b", "b-b-1", 2, "")]
    assert parts("```\n# no\n```\n\nTitle\n=====\n\nt\n\nSub\n---\n") == [(1, None, None, None, "```\n# no\n```"), (2, "Title", "title", 1, "t"), (3, "Sub", "sub", 2, "")]
    assert parts("only text") == [(1, None, None, None, "only text")]
    assert parts("# A `c` [l](x) *e*\r\nb")[0][1:3] == ("A c l e", "a-c-l-e")


@pytest.mark.parametrize("text,want", [("Hello, World!", "hello-world"), ("a  -- b", "a-b"), ("_x_ Ünï 9", "_x_-ünï-9"), ("!!!", "section"), ("-a-", "a")])
def test_anchor(text, want, spark):
    from millrace.functions import text as X

    assert M.anchor_for(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(X.anchor(F.col("t"))).first()[0] == want


def test_analysis():
    body = """# T

See [b](./b.md#x) and [ref] and ![i](../assets/i.png) and [self](#t) `[source: ./../sources/no.md]`.
Cited [source: ../sources/a.md#p] but not [source: http://x] and not [source: ../sources/z.md](x).

[ref]: ../sources/r.md

- tight [source: ../sources/tight.md] [c](../wiki/c.md)

### in
## Sources

- [a](../sources/a.md)
### still
[d](../sources/d.md)
# Next
[e](e.md)
"""
    a = M.analyze("wiki/p.md", body)
    assert a.first_h1 == "T" and a.links == ["sources/r.md", "wiki/b.md", "wiki/c.md", "wiki/e.md", "wiki/x"] and a.sources == ["sources/a.md", "sources/d.md"]
    assert a.citations == [("sources/a.md", "p")] and ("wiki/p.md", "t") in a.link_refs
    for bad in ("[x](../../x.md)", "[x](/etc/x.md)", "[x](../other/x.md)"):
        with pytest.raises(M.MarkdownError):
            M.analyze("wiki/p.md", bad)


def test_frontmatter():
    f = M.Front("T", "S", ["a"], "corpus", "doc_" + "0" * 32, M.SCHEMA, "wiki", "2026-01-02", ["sources/a.md"], [])
    text = M.join_front(f, "# T\n")
    assert M.split_front(text) == (f, "# T\n") and M.front_faults(f) == []
    assert M.split_front("# no") == (None, "# no")
    with pytest.raises(M.MarkdownError):
        M.split_front("---\na: 1\n")
    assert len(M.front_faults(M.Front(title="", id="x", schema="y", kind="z", modified_date="2026-13-01"))) == 5
    assert M.front_faults(None)


def test_edits():
    b = M.with_sources("# T\n\nx\n\n## Sources\n\n- old\n\n## After\n\ny\n", "wiki/d/p.md", ["sources/my-src.md"])
    assert b == "# T\n\nx\n\n## After\n\ny\n\n## Sources\n\n- [My Src](../../sources/my-src.md)\n"
    assert M.append_to_section("# T\n\n## A\n\nx\n\n## B\n\ny\n", "a", "new") == "# T\n\n## A\n\nx\n\nnew\n\n## B\n\ny\n"
    assert M.unwrap_links("see [B](./b.md#q).", "wiki/a.md", "wiki/b.md") == "see B."
    assert M.strip_citations("x [source: ../sources/s.md#a]  y ", "wiki/a.md", "sources/s.md") == "x y"
    assert M.strip_asset("a ![i](../assets/i.png) b", "wiki/a.md", "assets/i.png") == "a b"


@pytest.fixture
def store(tmp_path):
    s = D.Store.create(tmp_path / "corpus")
    put = lambda p, c, **k: s.write(p, c, reason="r", actor="me", today="2026-05-06", **k)
    put("sources/a.md", "# A\n\n## One\n\nx\n")
    put("sources/b.md", "# B\n")
    assert put("wiki/doomed.md", "# Doomed\n\ntext\n", title="Doomed", summary="s", tags=["t"], sources=["sources/a.md"]) == "create"
    put("wiki/kept.md", "# Kept\n\nSee [Doomed](./doomed.md). Cited [source: ../sources/a.md#one].\n", title="Kept", summary="s", tags=["t"], sources=["sources/a.md", "sources/b.md"])
    return s


def test_tree(spark, store):
    t = markdown_tree.read_tree(spark, str(store.current))
    c = t.corpus
    assert t.errors.count() == 0 and V.pages(t.parsed).collect() == [] and V.check(c).count() == 0
    assert {r["path"]: r["kind"] for r in c.documents.collect()} == {"sources/a.md": "source", "sources/b.md": "source", "wiki/doomed.md": "wiki", "wiki/kept.md": "wiki"}
    assert sorted((r["wiki_path"], r["source_path"], r["source_anchor"]) for r in c.citations.collect())[1:] == [("wiki/kept.md", "sources/a.md", ""), ("wiki/kept.md", "sources/a.md", "one"), ("wiki/kept.md", "sources/b.md", "")]
    assert [(r["from_path"], r["to_path"]) for r in c.links.filter("kind = 'wiki'").collect()] == [("wiki/kept.md", "wiki/doomed.md")]
    lines = [r["line"] for r in G.index_tree(c).orderBy("key", "sub").collect()]
    assert lines == ["- [Doomed](wiki/doomed.md)", "  - Sources: [A](sources/a.md)", "- [Kept](wiki/kept.md)", "  - Sources: [A](sources/a.md), [B](sources/b.md)"]
    assert G.status(None, {}) == ("missing", "there is no index")
    now = {**G.versions(), **G.manifest(c).first().asDict()}
    assert G.status(now, now)[0] == "fresh" and G.status({**now, "manifest_hash": "x"}, now)[0] == "stale" and G.status({**now, "schema_version": 1}, now)[0] == "incompatible"


def test_bad_tree(spark, store):
    (store.current / "wiki" / "bad.md").write_text("---\ntitle: x\ncorpus: {schema: document-v1, kind: wiki}\n---\n# y\n\n[gone](./gone.md) [a](../sources/a.md#nope)\n")
    (store.current / "wiki" / "broken.md").write_text("---\nno end\n")
    found = {(r["rule"], r["path"]) for r in V.pages(markdown_tree.read_tree(spark, str(store.current)).parsed).collect()}
    assert {("parse", "wiki/broken.md"), ("frontmatter", "wiki/bad.md"), ("missing_target", "wiki/bad.md"), ("missing_anchor", "wiki/bad.md"), ("title_heading", "wiki/bad.md"), ("sources_section", "wiki/bad.md")} <= found


def test_cascade(store):
    assert store.delete("sources/a.md", reason="gone", actor="me", today="2026-06-01") == ["sources/a.md", "wiki/doomed.md"]
    f, body = M.split_front((store.current / "wiki/kept.md").read_text())
    assert f.sources == ["sources/b.md"] and f.links == [] and f.modified_date == "2026-06-01" and "See Doomed. Cited" in body and "source:" not in body
    log = (store.current / "CHANGELOG.md").read_text()
    assert "- 2026-06-01 [delete] [me]: gone" in log and "[me]: cascade from sources/a.md: gone" in log


@pytest.mark.parametrize("path,kw", [("sources/a.md", {}), ("wiki/n.md", {"title": "N", "summary": "s", "tags": ["t"]}), ("wiki/n.md", {"summary": "s", "tags": ["t"], "sources": ["sources/a.md"]}), ("wiki/n.md", {"title": "N", "summary": "s", "tags": list("abcdef"), "sources": ["sources/a.md"]}), ("wiki/n.md", {"title": "Other", "summary": "s", "tags": ["t"], "sources": ["sources/a.md"]}), ("wiki/../n.md", {}), ("x/n.md", {}), ("assets/n.md", {}), ("wiki/n.md", {"append": "A"}), ("wiki/n.md", {"title": "N", "summary": "s", "tags": ["t"], "sources": ["sources/none.md"]})])
def test_refused_writes(store, path, kw):
    before = store.current
    with pytest.raises(ValueError):
        store.write(path, "# N\n", reason="r", actor="me", **kw)
    assert store.current == before and not (store.root / "LOCK").exists() and len(list((store.root / "versions").iterdir())) == 5


def test_append(store):
    store.write("wiki/kept.md", "added", append="News", reason="r", actor="me")
    text = (store.current / "wiki/kept.md").read_text()
    assert "## News\n\nadded\n\n## Sources" in text and "[append]" in (store.current / "CHANGELOG.md").read_text()


def test_changelog(spark):
    lines = ["# Changelog", "", "- 2026-01-02 [create] [me]: x [y]: z", "2026-01-02 [update] [me]: q", "- 2026-13-02 [create] [me]: x", "- 2026-01-02 [dance] [me]: x", "rubbish", "No operations yet."]
    got = L.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["reason"], r["fault"]) for r in got] == [("x [y]: z", None), ("q", None), ("x", "date must be YYYY-MM-DD"), ("x", "operation is not supported"), ("", "not a changelog line")]


def test_import(spark, tmp_path):
    (tmp_path / "In Dir").mkdir()
    (tmp_path / "In Dir" / "A page.html").write_text("<title>T</title><h1>Hi &amp; ho</h1><p>a <b>b</b> <a href='x.md'>l</a></p><ul><li>i<li>j</ul>")
    (tmp_path / "note.txt").write_text("plain")
    (tmp_path / "skip.bin").write_text("x")
    (tmp_path / ".hidden.md").write_text("x")
    got = {r["source_path"].split("/")[-1].replace("%20", " "): r for r in importer.import_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"A page.html", "note.txt"}
    assert "# Hi & ho\n\na **b** [l](x.md)\n\n- i\n- j" in got["A page.html"]["markdown"] and "# note\n\nplain" in got["note.txt"]["markdown"]
    assert got["note.txt"]["target"].startswith("sources/note-")
    assert importer.import_files(spark, str(tmp_path), exclude=["*.txt"]).count() == 1


def test_stream(spark, store, tmp_path):
    target = str(tmp_path / "table")
    incremental.refresh(spark, str(store.current), target, str(tmp_path / "state"))
    first = {r["path"]: r["hash"] for r in incremental.current(spark, target).collect()}
    assert len(first) == 4
    store.write("sources/c.md", "# C\n", reason="r", actor="me")
    incremental.refresh(spark, str(store.current), target, str(tmp_path / "state"))
    assert set(r["path"] for r in incremental.current(spark, target).collect()) == set(first) | {"sources/c.md"}
