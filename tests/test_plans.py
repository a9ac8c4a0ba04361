"""Published indexes, reports, rendered views."""

import hashlib
import json
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import markdown as M
from millrace.operators import corpus as K
from millrace.operators import health as H
from millrace.operators import report as R
from millrace.operators import search as S
from millrace.plans import changelog as L
from millrace.plans import freshness as P
from millrace.plans import generated as N
from millrace.plans import snapshot as D
from millrace.plans import views as G
from millrace.sources import importer
from millrace.sources.markdown_tree import read_corpus as S_read

from .test_search import PAGES, make


def test_freshness(spark, tmp_path):
    path, c = str(tmp_path / "index"), make(spark, PAGES)
    assert P.check(spark, c, path)[0] == "missing"
    i = P.ensure_fresh(spark, c, path)
    assert P.check(spark, c, path) == ("fresh", "") and S.search(i, "orca shrink")["results"]
    first = P.stored(spark, path)["version"]
    assert P.ensure_fresh(spark, c, path) is not None and P.stored(spark, path)["version"] == first
    fewer = make(spark, PAGES[1:])
    assert P.check(spark, fewer, path)[0] == "stale"
    assert not any(r["path"] == "wiki/orca-shrink.md" for r in S.search(P.ensure_fresh(spark, fewer, path), "orca shrink")["results"])
    assert P.stored(spark, path)["version"] != first
    (tmp_path / "index" / P.POINTER).write_text(json.dumps({**P.stored(spark, path), "schema_version": 1}))
    (tmp_path / "index" / f".{P.POINTER}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        P.ensure_fresh(spark, c, path)


def test_reports(spark):
    h = H.health(make(spark, PAGES), limit=20)
    rows = [json.loads(r["json"]) for r in R.as_json(h).orderBy("place").collect()]
    assert rows and all(isinstance(r["pages"], list) and isinstance(r["sources"], list) and r["review_instruction"] for r in rows)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert any("value" not in x for r in rows for x in r["reasons"]) or all(x.get("value") for r in rows for x in r["reasons"])
    line = R.as_lines(h).orderBy("place").first()["line"]
    assert line.startswith(f"1. {rows[0]['type']} (")


def test_rendered(spark):
    c = make(spark, PAGES)
    text = G.render(G.sources_tree(c), "Sources", "Generated.", "None yet.")
    assert text == "# Sources\n\nGenerated.\n\n- [Mixed raw](sources/mixed.md)\n- [Orca raw](sources/orca.md)\n"
    assert G.render(G.sources_tree(c).limit(0), "S", "G", "None yet.").endswith("None yet.\n")
    entries = [("2026-01-02", "create", "me", "x")]
    again = L.parse(spark.createDataFrame([(x,) for x in L.render(entries).splitlines()], "value string")).collect()
    assert [(r["date"], r["operation"], r["actor"], r["reason"]) for r in again] == entries and L.EMPTY in L.render([])


def small_tree(tmp_path):
    s = D.Store.create(tmp_path / "corpus")
    put = lambda p, c, **k: s.write(p, c, reason="r", actor=D.actor_name(" a]b\n"), today="2026-05-06", **k)
    put("sources/design/a.md", "# A\n\n## One\n\nx\n")
    put("sources/b.md", "no heading\n")
    put("assets/pics/p.png", b"\x89PNG")
    put("wiki/one.md", "# One\n\ntext\n", title="One", summary="s", tags=["t", "u"], sources=["sources/design/a.md", "sources/b.md"])
    put("wiki/deep/two.md", "# Two\n\nSee [One](../one.md).\n", title="Two", summary="s", tags=["t"], sources=["sources/b.md"])
    return s


def test_generated_files(spark, tmp_path):
    """A writer's own files equal those that Spark makes; a sound tree has no violation; what is broken is found and mended."""
    s = small_tree(tmp_path)
    root = str(s.current)
    texts = {v.name: v.text() for v in N.of_tree(spark, root)}
    assert texts == {n: (s.current / n).read_text() for n in N.HEADS}
    assert "- deep/\n  - [Two](wiki/deep/two.md)\n    - Sources: [B](sources/b.md)\n" in texts["INDEX.md"] and "- t (2)\n- u (1)\n" in texts["tags.md"] and "- pics/\n  - [p.png](assets/pics/p.png)\n" in texts["ASSETS.md"]
    assert N.verify(spark, root).collect() == []
    D.put(s.current / "tags.md", texts["tags.md"].replace("(2)", "(3)") + "more\n")
    D.put(s.current / "INDEX.md", texts["INDEX.md"].replace("- [One](wiki/one.md)\n", ""))
    (s.current / "SOURCES.md").unlink()
    D.put(s.current / "assets" / "x.md", "# X\n")
    D.put(s.current / N.MARKER, "other\n")
    log = (s.current / "CHANGELOG.md").read_text()
    D.put(s.current / "CHANGELOG.md", log + "- 2026-05-06 [dance] [me]: x\n")
    found = {(r["rule"], r["path"]): r["detail"] for r in N.check(spark, root).collect()}
    assert {("generated", "tags.md"), ("generated", "INDEX.md"), ("generated", "SOURCES.md"), ("path", "assets/x.md"), ("marker", "VERSION"), ("changelog", "CHANGELOG.md")} <= set(found)
    assert "'- t (3)' instead of '- t (2)'" in found["generated", "tags.md"] and "'more' is too much" in found["generated", "tags.md"] and found["generated", "SOURCES.md"] == "is missing"
    (s.current / "wiki" / "link.md").symlink_to(s.current / "wiki" / "one.md")
    assert ("path", "wiki/link.md", "is a symbolic link") in N.path_policy(spark, root)
    (s.current / "wiki" / "link.md").unlink()
    (s.current / "assets" / "x.md").unlink()
    D.put(s.current / N.MARKER, N.VERSION)
    D.put(s.current / "CHANGELOG.md", log)
    assert {r["rule"] for r in N.verify(spark, root).collect()} == {"generated"}
    assert N.verify(spark, root, fix=True).collect() == []


def test_repair_of_ids(spark, tmp_path):
    s = small_tree(tmp_path)
    page = s.current / "wiki" / "one.md"
    front, body = M.split_front(page.read_text())
    front.id = ""
    D.put(page, M.join_front(front, body))
    assert any(r["rule"] == "frontmatter" for r in N.check(spark, str(s.current)).collect())
    assert N.verify(spark, str(s.current)).collect() == []
    again, text = M.split_front(page.read_text())
    assert M.DOC_ID.match(again.id) and (text, again.title) == (body, "One") and N.repair_ids(spark, str(s.current)) == []


def test_an_index_of_a_tree_without_dates(spark, tmp_path):
    s = small_tree(tmp_path)
    root, index = str(s.current), str(tmp_path / "index")
    N.write(spark, root)
    page, other = s.current / "wiki" / "one.md", s.current / "wiki" / "deep" / "two.md"
    dated = other.read_text()
    front, body = M.split_front(page.read_text())
    front.modified_date = ""
    D.put(page, M.join_front(front, body))
    assert any(r["detail"] == M.DATELESS for r in N.check(spark, root).collect())
    with pytest.raises(ValueError, match="YYYY"):
        N.repair_dates(spark, root, "2026-13-01")
    i = N.indexed(spark, root, index, "2026-07-01")
    again, text = M.split_front(page.read_text())
    assert (again.modified_date, text, again.id, other.read_text()) == ("2026-07-01", body, front.id, dated)
    assert N.check(spark, root).collect() == [] and N.repair_dates(spark, root, "2026-07-02") == []
    assert S.search(i, "text")["results"] and P.check(spark, S_read(spark, root), index) == ("fresh", "")
    front.modified_date, front.title = "", ""
    D.put(page, M.join_front(front, body))
    with pytest.raises(ValueError, match="one.md"):
        N.indexed(spark, root, index, "2026-07-03")
    assert M.split_front(page.read_text())[0].modified_date == ""


def test_links_are_refused_when_read(spark, tmp_path):
    s = small_tree(tmp_path)
    (tmp_path / "out").mkdir()
    D.put(tmp_path / "out" / "x.md", "# X\n")
    (s.current / "sources" / "behind").symlink_to(tmp_path / "out")
    with pytest.raises(M.MarkdownError, match="sources/behind/x.md is not a regular file"):
        S_read(spark, str(s.current))
    (s.current / "sources" / "behind").unlink()
    (s.current / "wiki" / "link.md").symlink_to(s.current / "wiki" / "one.md")
    with pytest.raises(M.MarkdownError, match="wiki/link.md"):
        S_read(spark, str(s.current))
    (s.current / "wiki" / "link.md").unlink()
    (s.current / "assets" / "link.png").symlink_to(s.current / "assets" / "pics" / "p.png")
    (tmp_path / "whole").symlink_to(s.current)  # the root itself may be one
    assert S_read(spark, str(tmp_path / "whole")).documents.count() == 4


def test_missing_directory(spark, tmp_path):
    s = small_tree(tmp_path)
    shutil.rmtree(s.current / "assets")
    assert ("path", "assets") in {(r["rule"], r["path"]) for r in N.check(spark, str(s.current)).collect()}


def test_lock_and_versions(tmp_path):
    s = small_tree(tmp_path)
    lock = D.Lock(s.root / "LOCK", "test")
    with pytest.raises(D.ChangeError, match="test"):
        s.delete("wiki/one.md", reason="r", actor="me")
    owner = lock.owner()
    D.put(s.root / "LOCK" / "OWNER", json.dumps({**owner, "token": "other"}))
    with pytest.raises(D.ChangeError):
        lock.release()
    D.put(s.root / "LOCK" / "OWNER", json.dumps({**owner, "pid": 2**22 + 1}))  # a writer that crashed
    before = s.current
    old = (before / "wiki" / "one.md").read_bytes()
    s.write("wiki/one.md", "# One\n\nnew\n", reason="r", actor="me")
    assert not (s.root / "LOCK").exists() and (before / "wiki" / "one.md").read_bytes() == old != (s.current / "wiki" / "one.md").read_bytes()
    assert os.stat(before / "sources" / "b.md").st_ino == os.stat(s.current / "sources" / "b.md").st_ino
    assert len(s.vacuum(keep=2)) == 5 and s.current.exists() and len(list((s.root / "versions").iterdir())) == 2
    (s.current / "wiki" / "out").symlink_to(tmp_path)
    with pytest.raises(D.ChangeError):
        s.write("wiki/out/x.md", "# X\n", title="X", summary="s", tags=["t"], sources=["sources/b.md"], reason="r", actor="me")


def test_json_of_a_search(spark, tmp_path):
    c = make(spark, PAGES)
    i = P.ensure_fresh(spark, c, str(tmp_path / "i"))
    found = S.search(i, "orca shrink")
    body = json.loads(R.search_json(found))
    assert list(body) == ["query", "query_mode", "recommended_sections", "agent_instructions", "coverage", "results", "recommended_read_order", "stop_rule"]
    assert body["results"] and all(isinstance(r["tags"], list) and isinstance(r["links"], list) and r["id"] and "" not in (r.get("anchor"), r.get("summary")) for r in body["results"])
    assert body["coverage"]["missing"] == [] and R.search_lines(found)[-1] == body["stop_rule"]
    assert R.search_json(S.search(i, "absentterm")).count("[]") >= 3
    lines = P.report(spark, make(spark, PAGES[1:]), str(tmp_path / "i"))
    assert lines[0] == "status: stale" and lines[-1].startswith("reason: ") and "exists: true" in lines
    assert P.report(spark, c, str(tmp_path / "none"))[:3] == ["status: missing", f"index: {tmp_path / 'none'}", "exists: false"]


def test_import_targets(spark, tmp_path):
    (tmp_path / "in" / "Some Dir").mkdir(parents=True)
    (tmp_path / "in" / "Some Dir" / "My note.v2.txt").write_text("x")
    r = importer.import_files(spark, str(tmp_path / "in")).first()
    digest = hashlib.sha256(b"Some Dir/My note.v2.txt").hexdigest()[:10]
    assert r["target"] == f"sources/some-dir/my-note-v2-{digest}.md" and "original_path: Some Dir/My note.v2.txt" in r["markdown"]
    stamp = int(os.stat(tmp_path / "in" / "Some Dir" / "My note.v2.txt").st_mtime)
    assert importer.import_files(spark, str(tmp_path / "in"), versioned=True).first()["target"] == f"sources/some-dir/my-note-v2-{stamp}-{digest}.md"
    assert [x[0] for x in spark.createDataFrame([("a/my_new-file.md",), ("__.txt",)], "p string").select(importer.title_of(F.col("p"))).collect()] == ["My New File", "Untitled"]


def test_import_of_word_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, pr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    body = para("Big", '<w:pStyle w:val="Title"/>') + para("Part", '<w:pStyle w:val="Heading2"/>') + para("a &amp; b") + para("") + para("x", "<w:numPr/>") + para("y", "<w:numPr/>")
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "A file.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "in" / "bad.docx").write_bytes(b"junk")
    got = {r["target"].split("/")[-1].rsplit("-", 1)[0]: r["markdown"] for r in importer.import_files(spark, str(tmp_path / "in")).collect()}
    big = "".join(para(f"line {i} " + "word " * 200) for i in range(70_000))  # more than 64 MiB of XML
    box = f"<w:p><w:r><w:t>out</w:t><w:txbxContent>{para('in', '<w:pStyle w:val=\"Title\"/>')}</w:txbxContent><w:t>er</w:t></w:r></w:p>"
    made = {}
    for name, x in (("big", big), ("box", box), ("typed", para("a"))):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", ("<!DOCTYPE x [<!ENTITY e 'e'>]>" if name == "typed" else "") + f"<w:document {w}><w:body>{x}</w:body></w:document>")
        made[name] = importer.markdown_of_docx((tmp_path / name).read_bytes())
    assert len(big) > 64 << 20 and made["big"].count("\n\n") == 69_999 and made["box"] == "outiner\n\n# in\n" and made["typed"] is None
    assert importer.markdown_of_docx((tmp_path / "big").read_bytes()[:-5000]) is None and importer.markdown_of_docx(None) is None
    assert got["a-file"].endswith("---\n\n# Big\n\n## Part\n\na & b\n\n- x\n- y\n") and got["bad"] is None


def test_small_tables_are_spread(spark, tmp_path, monkeypatch):
    spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    dealt = K.spread(t, "doc_id")
    assert dealt.rdd.getNumPartitions() == cores and sorted(r[0] for r in dealt.collect()) == list(range(100))
    monkeypatch.setattr(K, "SMALL", 0)
    assert K.spread(t, "doc_id").rdd.getNumPartitions() < cores


def test_texts_in_order(spark):
    rows = spark.createDataFrame([(f"p{i:04}", f"line {i}\n", "x") for i in range(999, -1, -1)], "path string, line string, other string").repartition(5)
    chunks = [(r["line"], r["other"]) for r in G.in_order(rows, "line", "other", least=100)]
    assert "".join(c for c, _ in chunks) == "".join(f"line {i}\n" for i in range(1000)) and sum(len(o) for _, o in chunks) == 1000
    assert list(G.in_order(rows.limit(0), "line")) == []
