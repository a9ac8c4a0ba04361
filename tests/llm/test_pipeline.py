"""Each stage of the pipeline against a brute-force version on its own input."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, toxicity

from .test_operators import SMALL, brute_components, brute_dedup, brute_hits, table


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append((name, before, after))
    (_, a0, b0), (_, a1, b1), (_, a2, b2), (_, a3, b3), (_, a4, b4) = seen
    model = toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = dict(zip(a0, model.scorer()([r["text"] for r in a0.values()])[0], strict=True))
    assert set(b0) == {i for i in a0 if scores[i] < 0.5} and len(b0) < len(a0)
    assert {i: r["text"] for i, r in b1.items()} == brute_dedup([(i, r["text"]) for i, r in a1.items()])
    assert all(r["n_chars"] == len(r["text"]) for r in b1.values())
    rows = [(i, r["text"]) for i, r in a2.items()]
    assert set(b2) == {i for i, _, c in brute_components(rows) if c == i}
    items = table("benchmark")
    assert set(b3) == {i for i, r in a3.items() if not brute_hits(r["text"], items)[-1]}
    hf = bpe.Bpe(bpe.content_of(bpe.default_path())).hf
    assert set(b4) == set(a4) and all(r["n_tokens"] == len(hf.encode(r["text"], add_special_tokens=False).ids) for r in b4.values())


def test_one_row_of_each_group_stays(spark):
    """Null ids and repeated ids count by row."""
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    near = words(1) + " end"
    rows = [(None, words(0)), (None, words(0)), (None, words(2)), (1, words(1)), (1, near), (1, words(1)), (1, words(3)), (2, near), (2, words(4)), (3, words(5)), (3, words(5)), (4, ""), (4, ""), (None, "")]
    out = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SMALL)
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    first = next(t for i, t in got if i == "1" and t in (words(1), near))
    assert got == sorted([("None", words(0)), ("None", words(2)), ("1", first), ("1", words(3)), ("2", words(4)), ("3", words(5)), ("4", ""), ("4", ""), ("None", "")])


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __score int, spans string, n_words int, key int, turn string, c0 int, starts string"


def odd_rows():
    more = ("en", "web", 1, 5, "s", 6, 7, "t", 8, "u")
    long = " ".join(f"long{i}" for i in range(30_000))
    lines = "\n".join(f"a line of its own {i}" for i in range(6))
    rows = [(None, None, *more), (None, "words of a row without an id, enough for some shingles", *more), (1, "", *more), (1, "", *more), (2, long, *more), (3, lines, *more), (4, lines, *more), (4, lines, *more), (5, "one", None, None, None, None, None, None, None, None, None, None)]
    return rows, long, lines


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_names(spark, k):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, no rows: defined by each stage's docstring."""
    name, stage = corpus_pipeline.STAGES[k]
    rows, long, lines = odd_rows()
    df = spark.createDataFrame(rows, ODD_COLUMNS).repartition(3)
    out = stage(spark, df, SMALL)
    got = out.collect()
    if k < 4:
        assert out.columns == df.columns
        assert all(tuple(r)[5:] in {tuple(x)[5:] for x in rows} for r in got)
    texts = sorted((str(r.doc_id), r.text or "") for r in got)
    everything = sorted((str(r[0]), r[1] or "") for r in rows)
    if name in ("toxicity", "benchmark decontamination"):
        assert texts == everything and [r.text for r in got].count(None) == 1
    elif name == "line dedup":
        assert [t for i, t in texts if i in "34"] == [lines, "", ""] and len(got) == len(rows)
        assert {r.n_chars for r in got if r.doc_id == 2} == {len(long)} and all(r.n_chars is None for r in got if r.text is None)
    elif name == "n-gram Jaccard join":
        assert texts == sorted([e for e in everything if e[0] != "4"])
    else:
        assert len(got) == len(rows) and all(r.n_tokens == 0 for r in got if not r.text) and len(set(out.columns)) == len(out.columns)
    assert stage(spark, spark.createDataFrame([], ODD_COLUMNS), SMALL).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = labels.filter("toxic = 0 and quality = 1").select("doc_id")
    kept = out.join(clean, "doc_id").count()
    assert kept > 0.7 * clean.count() and zlib.crc32(b"") == 0
    assert out.select(F.max("n_tokens")).first()[0] > 0
