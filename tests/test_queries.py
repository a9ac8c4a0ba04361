"""Every registered query with SQL gives the SQL's rows."""

import hashlib

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_fk_violations_have_sections(spark):
    assert any(r["rule"] == "section_document" for r in QUERIES["fk_violations"](spark, SMALL).select("rule").collect())


def test_line_diff_of_late_documents(spark, tmp_path):
    """Documents from the fortieth on are compared too; null ids come last."""
    texts = [(i, "a\nb") for i in range(60)] + [(60, "x\nthe\nthe x"), (61, "then"), (None, "other")]
    spark.createDataFrame(texts[::-1], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = "\n".join(t for _, t in texts).split("\n")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = [(n, md5(x), md5(x.replace("the", "teh"))) for n, x in enumerate(whole, 1) if "the" in x]
    assert len(want) == 4 and [tuple(r) for r in QUERIES["line_diff"](spark, str(tmp_path)).collect()] == want
