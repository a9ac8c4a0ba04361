"""Tables that change by files: the same rows as on the whole table, and untouched files byte for byte."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.plans import snapshot as D
from millrace.plans import tables as B

ROW = "path string, kind string, title string, sources array<string>, links array<string>, modified_date string"


def docs(spark, n=200):
    rows = [(f"wiki/p{k:04d}.md", "wiki", f"t{k}", [f"sources/s{k // 10:02d}.md"] + ([f"sources/s{k % 7:02d}.md"] if k % 3 == 0 and k % 7 != k // 10 else []), [f"wiki/p{k + 1:04d}.md"], "2026-01-01") for k in range(n)]
    rows += [(f"sources/s{k:02d}.md", "source", f"s{k}", [], [], "") for k in range(n // 10)]
    return spark.createDataFrame(rows, ROW).repartition(4)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    B.create(spark, docs(spark), path)
    yield path
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def sums(path):
    return {B.short(str(p)): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_an_upsert_rewrites_the_files_of_its_keys(spark, table):
    before, whole = sums(table), docs(spark)
    assert len(before) == 8
    new = whole.filter("path in ('wiki/p0003.md', 'wiki/p0004.md')").withColumn("title", F.lit("x")).unionByName(whole.limit(1).withColumn("path", F.lit("wiki/new.md")))
    gone = spark.createDataFrame([("wiki/p0005.md",), ("wiki/nowhere.md",)], "path string")
    change = B.upsert(spark, table, new, gone)
    assert rows(B.read(spark, table)) == rows(D.upsert(whole, new, gone))
    assert 1 <= len(change.rewritten) <= 2 and len(change.kept) >= 6
    after = sums(table)
    assert all(after[f] == before[f] for f in before)  # nothing is written in place
    assert B.vacuum(spark, table) == len(change.rewritten)
    assert set(sums(table)) == {*change.kept, *change.written} and rows(B.read(spark, table)) == rows(D.upsert(whole, new, gone))


def test_inserts_alone_rewrite_nothing(spark, table):
    new = docs(spark).limit(3).withColumn("path", F.concat(F.lit("z/"), "path"))
    assert B.upsert(spark, table, new).rewritten == [] and B.read(spark, table).count() == 223


@pytest.mark.parametrize("target", ["sources/s13.md", "wiki/p0042.md", "wiki/nowhere.md"])
def test_a_cascade_equals_the_one_on_the_whole_table(spark, table, target):
    whole = docs(spark)
    change = B.cascade(spark, table, target, "2026-06-01")
    assert rows(B.read(spark, table)) == rows(D.apply_cascade(whole, D.cascade_plan(whole, target), "2026-06-01"))
    assert len(change.kept) >= 5


def test_a_failure_leaves_the_table(spark, table, monkeypatch):
    before = rows(B.read(spark, table))
    broken = docs(spark).limit(2).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        B.upsert(spark, table, broken)
    assert rows(B.read(spark, table)) == before
    real = B.written

    def meanwhile(*of):
        monkeypatch.setattr(B, "written", real)
        B.upsert(spark, table, docs(spark).limit(1).withColumn("title", F.lit("other")))
        return real(*of)

    monkeypatch.setattr(B, "written", meanwhile)
    with pytest.raises(RuntimeError):
        B.upsert(spark, table, docs(spark).limit(1).withColumn("title", F.lit("mine")))
    assert {r["title"] for r in B.read(spark, table).collect()} >= {"other"}


def test_empty_tables_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "e")
    B.create(spark, docs(spark).limit(0), path)
    assert B.read(spark, path).count() == 0
    one = docs(spark).limit(1).withColumn("path", F.lit(None).cast("string"))
    B.upsert(spark, path, one)
    B.upsert(spark, path, one)
    assert B.read(spark, path).count() == 2  # a null key replaces nothing
    with pytest.raises(ValueError):
        B.create(spark, one, path)
    with pytest.raises(ValueError):
        B.read(spark, str(tmp_path / "nowhere"))
