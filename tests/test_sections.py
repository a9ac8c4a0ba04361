"""Sections made in the JVM against the parser, and reading of trees that mix both."""

import random

from pyspark.sql import functions as F

from millrace.functions import markdown as M
from millrace.functions.sections import MOST_HEADINGS, with_sections
from millrace.sources import markdown_tree as T

ANY = ["# A", "## A", "## B c", "### Dé ##", "#", "# ", "#x", "####### y", "   # in", "    # code", "\t# t", "```", "````", "```py", "``` a`b", "~~~", "~~~~ x", "   ```", "    ```", "text", "more text  ", "", "", "- item", "- # item", "* * *", "> q", "===", "---", "# with *b*", "# a_b", "[x]: y", "# #", "# x \\#", "1. # n", "text\xa0", " x "]
SETTLED = [x for x in ANY if x not in ("> q", "===", "---", "text\xa0", "#", "# ", "# #", "# x \\#", "# with *b*", "# a_b")]


def texts(n=900):
    rng = random.Random(4)
    out = [(i, rng.choice(["\n", "\r\n", "\n", "\r"]).join(rng.choice(ANY if i % 3 == 0 else SETTLED) for _ in range(rng.randint(0, 14)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "\n".join(f"# h{i % 7}" for i in range(MOST_HEADINGS + 1))), (n + 3, "x\n" * 30_000 + "# last")]


def wanted(t):
    return [(s.ordinal, s.heading, s.anchor, s.level, s.body) for s in M.sections(t or "")]


def test_settled_texts_have_the_parsers_sections(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "k int, body string").repartition(3)
    told = {r["k"]: r for r in with_sections(df, "body").collect()}
    settled = [k for k, r in told.items() if r["settled"]]
    assert all(k % 3 == 0 or k >= 900 or told[k]["settled"] for k in told) and len(settled) < len(rows)
    assert [k for k in settled if [tuple(s) for s in told[k]["sections"]] != wanted(rows[k][1])] == []
    every = {r["k"]: [tuple(s) for s in r["sections"]] for r in T.sections_of(df, "body").collect()}
    assert every == {k: wanted(t) for k, t in rows}


def test_files_are_as_the_parser_has_them(spark):
    rows = [(f"sources/d/file-{k}_x.md", "source", (t or "").encode()) for k, t in texts(200)]
    rows += [("sources/.md", "source", b"# x"), ("sources/bad.md", "source", b"# a\xff\nb"), ("wiki/p.md", "wiki", b"# P\n"), ("sources/BIG name.md", "source", "ßa\r\n# É".encode())]
    df = spark.createDataFrame(rows, "path string, kind string, content binary")
    got = {r["path"]: r.asDict(recursive=True) for r in T.parse(df).collect()}
    for path, kind, content in rows:
        want = T.parse_file(path, kind, content)
        assert {k: v for k, v in got[path].items() if v is not None} == {k: v for k, v in want.items() if v is not None}, path


def test_only_what_lines_settle_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("sources/a.md", "source", b"# A\n\ntext"), ("sources/b.md", "source", b"B\n==="), ("wiki/p.md", "wiki", b"# P")], "path string, kind string, content binary")
    left = {r["path"]: r["content"] is not None for r in T.settled_sources(df).select("path", "content").collect()}
    assert left == {"sources/a.md": False, "sources/b.md": True, "wiki/p.md": True}
