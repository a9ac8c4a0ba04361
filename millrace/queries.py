"""The registered queries: name to function (spark, sf_dir) and name to DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as O
from . import schema as C
from .functions import text as X
from .functions.markdown import unique_anchor
from .functions.plain import fold_tokens
from .operators import blocks as P
from .operators import corpus as K
from .operators import excerpts as R
from .operators import health as H
from .operators import index as I
from .operators import integrity as V
from .operators import search as S
from .operators import terms as W
from .operators.corpus import Corpus
from .operators.pair_blocks import meetings
from .plans import changelog as L
from .plans import digests as J
from .plans import generated as N
from .plans import segments as E
from .plans import snapshot as D
from .plans import tables as B
from .plans import views as G
from .sources import importer as M
from .sources.cut import checkpoint, new_folder
from .sources.ship import ship
from .sources import markdown_tree as T
from .sources.tables import paths_of
from .streaming import scans as Q

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, d: str) -> Corpus:
    return Corpus.from_tables(spark, d)


def joined(col: str | Column) -> Column:
    return F.array_join(col, "|")


BASE = O.with_(O.CORPUS)


# Corpus.


@query(BASE + "SELECT id, path, kind, tier, title, summary, array_to_string(tags, '|') AS tags, array_to_string(sources, '|') AS sources, array_to_string(links, '|') AS links, modified_date, hash, size_bytes FROM docs")
def doc_projection(spark, d):
    return corpus(spark, d).documents.select("id", "path", "kind", "tier", "title", "summary", *[joined(c).alias(c) for c in ("tags", "sources", "links")], "modified_date", "hash", "size_bytes")


@query(BASE + "SELECT section_id, document_id, ordinal, coalesce(heading, '') AS heading, coalesce(anchor, '') AS anchor, coalesce(level, 0) AS level, strlen(body) AS body_bytes FROM secs")
def section_explode(spark, d):
    return corpus(spark, d).sections.select("section_id", "document_id", "ordinal", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.coalesce("level", F.lit(0)).alias("level"), F.octet_length("body").cast("long").alias("body_bytes"))


@query(BASE + "SELECT path, max(section_id) AS last_section, count(*) AS n FROM secs GROUP BY path")
def section_ids(spark, d):
    return corpus(spark, d).sections.groupBy("path").agg(F.max("section_id").alias("last_section"), F.count("*").alias("n"))


@query(BASE + "SELECT path, 'source_' || substr(sha256(path), 1, 32) AS id FROM docs WHERE kind = 'source'")
def source_ids(spark, d):
    return corpus(spark, d).documents.filter("kind = 'source'").select("path", X.source_id(F.col("path")).alias("id"))


@query(BASE + "SELECT tier, count(*) AS n FROM docs GROUP BY 1")
def tier_counts(spark, d):
    return corpus(spark, d).documents.groupBy("tier").agg(F.count("*").alias("n"))


@query(BASE + "SELECT kind, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM docs GROUP BY 1")
def kind_counts(spark, d):
    return corpus(spark, d).documents.groupBy(X.kind_of(F.col("path")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(BASE + f"SELECT path, array_to_string({O._words(O._base('path'))}, '|') AS terms, {O._words(O._base('path'))}[1] AS first_term FROM docs")
def path_tokens(spark, d):
    return corpus(spark, d).documents.select("path", joined(X.path_terms(F.col("path"))).alias("terms"), X.first_path_term(F.col("path")).alias("first_term"))


@query(BASE + f"SELECT heading, {O._anchor('heading')} AS anchor FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS heading FROM raw)")
def anchors(spark, d):
    t = raw(spark, d).select(F.explode(F.split("text", "\n", -1)).alias("heading")).distinct()
    return t.select("heading", X.anchor(F.col("heading")).alias("anchor"))


@query(BASE + "SELECT section_id, anchor || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END AS anchor FROM (SELECT section_id, anchor, row_number() OVER (PARTITION BY document_id, anchor ORDER BY ordinal) AS k FROM secs WHERE anchor IS NOT NULL)")
def duplicate_anchors(spark, d):
    """The parser's own numbering: anchors of one document count from its first heading on."""
    s = corpus(spark, d).sections.filter("heading IS NOT NULL")
    per = s.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "section_id", "heading"))).alias("s"))  # a document's own headings
    ship(spark)

    def run(batches):
        for b in batches:
            rows = []
            for sections in b.column(0).to_pylist():
                counts: dict[str, int] = {}
                rows += [(x["section_id"], unique_anchor(x["heading"], counts)) for x in sections]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["section_id", "anchor"])

    return per.select("s").mapInArrow(run, "section_id string, anchor string")


@query(BASE + "SELECT path, to_json(tags)::VARCHAR AS tags_json, array_to_string(tags, ' ') AS tags_text, len(from_json(to_json(tags), '[\"VARCHAR\"]'))::BIGINT AS n FROM docs")
def json_arrays(spark, d):
    t = corpus(spark, d).documents.select("path", F.to_json("tags").alias("tags_json"), F.array_join("tags", " ").alias("tags_text"))
    return t.withColumn("n", F.size(F.from_json("tags_json", "array<string>")).cast("long"))


@query(BASE + "SELECT path, array_to_string(list_sort(list_distinct(list_filter(list_transform([' ' || tags[2], tags[1], '', tags[2], tags[1] || ' '], lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM docs WHERE kind = 'wiki'")
def sorted_unique_tags(spark, d):
    t = corpus(spark, d).wiki
    tag = lambda i: F.col("tags")[i]
    messy = F.array(F.concat(F.lit(" "), tag(1)), tag(0), F.lit(""), tag(1), F.concat(tag(0), F.lit(" ")))
    return t.select("path", joined(X.sorted_unique(F.filter(messy, lambda x: x.isNotNull()))).alias("tags"))


@query(BASE + "SELECT path, title || CASE WHEN len(sources) > 0 THEN ' <- ' || array_to_string(sources, ', ') ELSE '' END AS label FROM docs WHERE kind = 'wiki'")
def display_labels(spark, d):
    t = corpus(spark, d).wiki
    return t.select("path", F.concat(G.display_title(F.col("title"), F.lit(""), F.col("path")), F.when(F.size("sources") > 0, F.concat(F.lit(" <- "), F.array_join("sources", ", "))).otherwise("")).alias("label"))


# Facts.


@query(BASE + "SELECT tag, count(*) AS pages FROM tags GROUP BY 1")
def tag_registry(spark, d):
    return G.tag_registry(corpus(spark, d))


@query(BASE + "SELECT tag, count(DISTINCT path) AS df FROM tags GROUP BY 1")
def tag_df(spark, d):
    return H.tag_frequency(corpus(spark, d))


@query(BASE + "SELECT source_path, count(DISTINCT wiki_path) AS df FROM cits GROUP BY 1")
def source_df(spark, d):
    return corpus(spark, d).citations.groupBy("source_path").agg(F.countDistinct("wiki_path").alias("df"))


@query(O.with_(O.CORPUS, O.GRAPH) + "SELECT path, in_degree, out_degree FROM deg")
def link_degrees(spark, d):
    return H.degrees(corpus(spark, d)).select("path", "in_degree", "out_degree")


@query(BASE + "SELECT from_path, to_path, kind, to_document_id FROM links")
def link_resolution(spark, d):
    return corpus(spark, d).links.select("from_path", "to_path", "kind", "to_document_id")


@query(BASE + "SELECT 'link_document' AS rule, from_path AS path, from_document_id AS detail FROM links WHERE from_document_id NOT IN (SELECT id FROM docs WHERE doc_id % 7 <> 0) UNION ALL SELECT 'citation_document', wiki_path, document_id FROM cits WHERE document_id NOT IN (SELECT id FROM docs WHERE doc_id % 7 <> 0) UNION ALL SELECT 'tag_document', path, document_id FROM tags WHERE document_id NOT IN (SELECT id FROM docs WHERE doc_id % 7 <> 0) UNION ALL SELECT 'link_target_id', from_path, to_path FROM links WHERE to_path IN (SELECT path FROM docs WHERE doc_id % 7 = 0) UNION ALL SELECT 'section_document', path, document_id FROM secs WHERE document_id NOT IN (SELECT id FROM docs WHERE doc_id % 7 <> 0)")
def fk_violations(spark, d):
    """Every seventh document taken out, the facts that then hang in the air."""
    c = corpus(spark, d)
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    broken = Corpus(c.documents.filter(number % 7 != 0), c.sections, c.links, c.citations, c.tags)
    return V.foreign_keys(broken)


@query(BASE + "SELECT DISTINCT document_id, path, tag FROM (SELECT * FROM tags UNION ALL SELECT * FROM tags)")
def fact_dedup(spark, d):
    t = corpus(spark, d).tags
    return t.unionAll(t).dropDuplicates(["document_id", "tag"])


@query(BASE + "SELECT DISTINCT wiki_path, source_path FROM cits")
def distinct_citations(spark, d):
    return corpus(spark, d).citations.select("wiki_path", "source_path").distinct()


@query(BASE + "SELECT 'link' AS fact, path AS page, unnest(links) AS value FROM docs WHERE kind = 'wiki' UNION ALL SELECT 'citation', path, unnest(sources) FROM docs WHERE kind = 'wiki' UNION ALL SELECT 'tag', path, unnest(tags) FROM docs WHERE kind = 'wiki'")
def facts_from_json(spark, d):
    docs = corpus(spark, d).documents
    for c in ("tags", "sources", "links"):
        docs = docs.withColumn(c, F.from_json(F.to_json(c), "array<string>"))
    links, citations, tags = K.facts_from_documents(docs)
    return links.select(F.lit("link").alias("fact"), F.col("from_path").alias("page"), F.col("to_path").alias("value")).unionAll(citations.select(F.lit("citation"), "wiki_path", "source_path")).unionAll(tags.select(F.lit("tag"), "path", "tag"))


@query(BASE + "SELECT path FROM docs WHERE kind = 'wiki' AND list_contains(tags, 'src3') AND list_has_any(sources, (SELECT list(path) FROM docs WHERE kind = 'source' AND contains(path, 'src4')))")
def tag_and_source_division(spark, d):
    """Pages with a tag that cite any source of a group: two semi-joins on facts."""
    c = corpus(spark, d)
    group = c.documents.filter("kind = 'source' AND path LIKE '%src4%'").select(F.col("path").alias("source_path"))
    cite = c.citations.filter("citation_kind = 'frontmatter_source'").join(group, "source_path", "left_semi").select(F.col("wiki_path").alias("path"))
    return c.wiki.join(c.tags.filter("tag = 'src3'").select("path"), "path", "left_semi").join(cite, "path", "left_semi").select("path")


# Texts.

RAW = "WITH raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) "


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(RAW + rf"SELECT doc_id, md5(trim(regexp_replace(lower(trim(text)), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) AS digest FROM raw")
def normalize_text(spark, d):
    return raw(spark, d).select("doc_id", F.md5(X.normalized(F.col("text"))).alias("digest"))


@query(RAW + f"SELECT doc_id, len({O._tokens('text')})::BIGINT AS n, md5(array_to_string({O._tokens('text')}, ' ')) AS digest FROM raw")
def tokenize_fts(spark, d):
    t = raw(spark, d).withColumn("t", X.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


#: Letters of the texts, and letters of other scripts, with marks and of several cases, that stand for them.
SCRIPT_FROM = "aeiounrstlTIE"
SCRIPT_TO = "άЁїǖҝñßἁŢŁΣİΈ"


@query(RAW + f", r2 AS (SELECT doc_id, regexp_replace(translate(text, '{SCRIPT_FROM}', '{SCRIPT_TO}'), 'd', 'e' || chr(769), 'g') AS text FROM raw) SELECT doc_id, len({O._tokens('text')})::BIGINT AS n, md5(array_to_string({O._tokens('text')}, ' ')) AS digest FROM r2")
def tokenize_scripts(spark, d):
    """Tokens of the texts in other scripts: accented Greek and Cyrillic stay, Latin letters lose single marks, combining marks go."""
    other = F.regexp_replace(F.translate("text", SCRIPT_FROM, SCRIPT_TO), "d", "e\u0301")
    t = raw(spark, d).withColumn("t", X.tokens(other))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


TERMED = O.with_(O.CORPUS, O.TERMS)


def counts(spark, d) -> tuple[Corpus, DataFrame]:
    c = corpus(spark, d)
    return c, W.term_counts(c)


def unwritten(spark, d) -> DataFrame:
    """Weights for one reader."""
    c, t = counts(spark, d)
    return W.weighted_terms(t, W.wiki_count(c))


def weights(spark, d) -> tuple[Corpus, DataFrame]:
    c, t = counts(spark, d)
    return c, checkpoint(W.weighted_terms(t, W.wiki_count(c)))


@query(TERMED + "SELECT path, term, tf FROM tf")
def term_tf(spark, d):
    return counts(spark, d)[1]


@query(TERMED + "SELECT term, df FROM df")
def term_df(spark, d):
    return W.document_frequency(counts(spark, d)[1])


@query(TERMED + "SELECT path, sum(tf)::BIGINT AS length, count(*) AS terms FROM tf GROUP BY 1")
def doc_length(spark, d):
    return counts(spark, d)[1].groupBy("path").agg(F.sum("tf").alias("length"), F.count("*").alias("terms"))


@query(O.with_(O.CORPUS, O.STUBS) + "SELECT path, lines FROM lc")
def body_lines(spark, d):
    return H.line_counts(corpus(spark, d)).select("path", "lines")


@query(RAW + f", w AS (SELECT unnest({O._words('text')}) AS term FROM raw) SELECT term, count(*) AS n FROM w WHERE strlen(term) >= 3 AND term NOT IN ({O.STOP}) GROUP BY 1")
def stopword_filter(spark, d):
    return raw(spark, d).select(F.explode(X.words(F.col("text"))).alias("term")).filter(~X.is_candidate_stop(F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))


@query(TERMED + f"SELECT path, term, {O._round('w', 6)} AS w FROM wt")
def term_weight(spark, d):
    return unwritten(spark, d).select("path", "term", X.round_to(F.col("w"), 6).alias("w"))


@query(TERMED + "SELECT path, term, rank FROM top WHERE rank <= 12")
def top_terms(spark, d):
    return W.top_terms(unwritten(spark, d), 12).select("path", "term", F.col("rank").cast("long").alias("rank"))


@query(TERMED + "SELECT path, term FROM top WHERE rank <= 12 AND df > 1 AND (df <= 8 OR df * 3 <= n)")
def allowed_pair_terms(spark, d):
    return W.pair_terms(unwritten(spark, d), C.PAIR_TERMS, C.RARE_TERM).select("path", "term")


# Search. The words are ones that the texts have.

ONE, TWO, THREE, PHRASE = "thble", "thble thing", "ertion thing oning", '"to thanedble" thing'
INDEXED = O.with_(O.CORPUS, O.INDEX)


def searched(text: str, mode: str, tail: str) -> str:
    return f"{O.with_(O.CORPUS, O.INDEX, O.bm25([fold_tokens(a) for a in S.parse(text).atoms], mode))} {tail}"


def index(spark, d) -> I.Index:
    return I.build(corpus(spark, d))


def ranked(spark, d, text: str, mode: str = "and", **options) -> DataFrame:
    return S.ranked(index(spark, d), S.parse(text), S.Options(**options).checked(), mode, 6)


SHOWN = ("section_id", "path", "kind", "tier", "heading", "ordinal", "lexical_score", "score")
ALL = f"SELECT {O.SHOWN} FROM hits"


@query(INDEXED + "SELECT term, sum(n)::BIGINT AS n, count(DISTINCT section_id) AS sections FROM (SELECT section_id, unnest(list_concat(k0, k1, k2, k3, k4, k5, k6, k7)) AS term, 1 AS n FROM idx) GROUP BY 1")
def postings(spark, d):
    return index(spark, d).totals()


@query(INDEXED + f"SELECT n, {O._round('avgdl', 6)} AS avgdl FROM stat")
def index_statistics(spark, d):
    return index(spark, d).stats.select("n", X.round_to(F.col("avgdl"), 6).alias("avgdl"))


def _search_query(name: str, text: str, mode: str, sql_tail: str, **options):
    def run(spark, d):
        return ranked(spark, d, text, mode, **options).select(*SHOWN)

    run.__name__ = name
    return query(searched(text, mode, sql_tail))(run)


_search_query("bm25_term", ONE, "and", ALL)
_search_query("bm25_and", TWO, "and", ALL)
_search_query("bm25_or", TWO, "or", ALL)
_search_query("bm25_phrase", PHRASE, "and", ALL)
_search_query("score_adjusted", THREE, "or", ALL)
_search_query("filter_kind", TWO, "or", ALL + " WHERE kind = 'source'", kind="source")
_search_query("filter_prefix", TWO, "or", ALL + " WHERE starts_with(lower(path), 'wiki/design')", path="Wiki/design")
_search_query("filter_tags", TWO, "or", ALL + " WHERE list_contains(tags, 'src6')", tags=["src6"])
_search_query("filter_tier", TWO, "or", ALL + " WHERE tier IN ('design', 'reference')", tiers=["design", "reference"])


@query(searched(TWO, "or", ALL + " WHERE list_contains(sources, (SELECT min(source_path) FROM cits))"))
def filter_sources(spark, d):
    first = corpus(spark, d).citations.agg(F.min("source_path")).first()[0]  # the option's value
    return ranked(spark, d, TWO, "or", sources=[first]).select(*SHOWN)


_BOTH = "(SELECT sources FROM hits WHERE len(sources) > 1 ORDER BY path, section_id LIMIT 1)"


@query(searched(TWO, "or", ALL + f" WHERE list_has_all(sources, {_BOTH})"))
def filter_several_sources(spark, d):
    """Pages that cite all sources of the first result with several."""
    i, q = index(spark, d), S.parse(TWO)
    both = S.ranked(i, q, S.Options().checked(), "or", 6).filter(F.size("sources") > 1).select("path", "section_id", "sources").orderBy("path", "section_id").first()
    return S.ranked(i, q, S.Options(sources=list(both["sources"]) if both else ["sources/none.md"]).checked(), "or", 6).select(*SHOWN)


_PAIR = "(SELECT tags FROM hits WHERE len(tags) > 1 ORDER BY path, section_id LIMIT 1)"


@query(searched(TWO, "or", ALL + f" WHERE list_has_all(tags, {_PAIR})"))
def filter_several_tags(spark, d):
    """Pages with all tags of the first result with several."""
    i, q = index(spark, d), S.parse(TWO)
    both = S.ranked(i, q, S.Options().checked(), "or", 6).filter(F.size("tags") > 1).select("path", "section_id", "tags").orderBy("path", "section_id").first()
    return S.ranked(i, q, S.Options(tags=list(both["tags"]) if both else ["none"]).checked(), "or", 6).select(*SHOWN)


@query(searched(TWO, "or", f"SELECT {O.SHOWN}, row_number() OVER (ORDER BY {O.ORDER}) AS place FROM hits ORDER BY {O.ORDER} LIMIT 40"))
def search_topk(spark, d):
    t = S.top(index(spark, d), S.parse(TWO), S.Options().checked(), "or", 6)
    return t.withColumn("place", F.row_number().over(Window.orderBy(*S.ORDER))).select(*SHOWN, "place")  # 40 rows


# Search on a written index, by blocks.

PLACED = f"SELECT {O.SHOWN}, row_number() OVER (ORDER BY {O.ORDER}) AS place FROM hits ORDER BY {O.ORDER} LIMIT 40"


def placed(spark, path: str, text: str, mode: str) -> DataFrame:
    rows = P.top(E.opened(spark, path), S.parse(text), S.Options().checked(), mode, 6)[0]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*S.ORDER))).select(*SHOWN, "place")  # 40 rows


def _blocks_query(name: str, text: str, mode: str):
    def run(spark, d):
        path = new_folder(spark, "index")
        E.refresh(spark, corpus(spark, d), path)
        return placed(spark, path, text, mode)

    run.__name__ = name
    return query(searched(text, mode, PLACED))(run)


_blocks_query("blocks_or", TWO, "or")
_blocks_query("blocks_and", TWO, "and")
_blocks_query("blocks_three", THREE, "or")
_blocks_query("blocks_phrase", PHRASE, "and")


def older(c: Corpus) -> Corpus:
    """An earlier state of a corpus: without each seventh document, each fifth with other texts, each ninth tagged anew, and with documents that have gone since."""
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    changed = number % 5 == 0
    documents = c.documents.filter(number % 7 != 0).withColumn("hash", F.when(changed, F.lit("old")).otherwise(F.col("hash"))).withColumn("tags", F.when(number % 9 == 0, F.array(F.lit("thing"))).otherwise(F.col("tags")))
    sections = c.sections.filter(number % 7 != 0).withColumn("body", F.when(changed, F.concat(F.lit("thble "), "body")).otherwise(F.col("body")))
    away = c.documents.filter(number % 11 == 0).withColumns({"id": F.concat(F.lit("x"), "id"), "path": F.concat("path", F.lit(".old"))})
    lost = c.sections.filter(number % 11 == 0).withColumns({"section_id": F.concat(F.lit("x"), "section_id"), "document_id": F.concat(F.lit("x"), "document_id"), "path": F.concat("path", F.lit(".old"))})
    return replace(c, documents=documents.unionByName(away), sections=sections.unionByName(lost))


def refreshed(spark, d) -> str:
    """An index of an earlier state, brought up to the corpus."""
    path, c = new_folder(spark, "index"), corpus(spark, d)
    E.refresh(spark, older(c), path)
    E.refresh(spark, c, path)
    return path


@query(searched(THREE, "or", PLACED))
def refreshed_search(spark, d):
    return placed(spark, refreshed(spark, d), THREE, "or")


@query(searched(PHRASE, "or", PLACED))
def compacted_search(spark, d):
    path = refreshed(spark, d)
    E.compact(spark, path)
    return placed(spark, path, PHRASE, "or")


@query(INDEXED + ", ts AS (SELECT section_id, unnest(list_concat(k0, k1, k2, k3, k4, k5, k6, k7)) AS term FROM idx) SELECT term, sum(has)::BIGINT AS sections, sum(n)::BIGINT AS n FROM (SELECT term, section_id, 1 AS has, count(*) AS n FROM ts GROUP BY ALL) GROUP BY 1")
def compacted_postings(spark, d):
    """What is in all blocks after a refresh and a compaction: sections and occurrences of each term."""
    path = refreshed(spark, d)
    E.compact(spark, path)
    b = E.opened(spark, path).blocks.filter(F.col("term") != P.ALL)
    return b.groupBy("term").agg(F.sum("n").alias("sections"), F.sum(F.expr("aggregate(at, 0L, (s, x) -> s + size(x.positions))")).alias("n"))


TOP = f"tp AS (SELECT *, row_number() OVER (ORDER BY {O.ORDER}) AS place FROM hits ORDER BY {O.ORDER} LIMIT 40)"


@query(searched(TWO, "or", f", {TOP} SELECT section_id, path, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) AS k FROM tp) WHERE k <= 3 ORDER BY place LIMIT 20"))
def cap_per_doc(spark, d):
    rows = rows_of(spark, d, TWO, "or")
    place = {r["section_id"]: i for i, r in enumerate(rows, 1)}
    out = [(r["section_id"], r["path"], place[r["section_id"]]) for r in S.select(rows, [], 20)]
    return spark.createDataFrame(out, "section_id string, path string, place long")


def rows_of(spark, d, text: str, mode: str) -> list:
    return rows_in(corpus(spark, d), text, mode)


def rows_in(c: Corpus, text: str, mode: str) -> list:
    return S.top(I.build(c), S.parse(text), S.Options().checked(), mode, 6).collect()


# The first words of files are hashes of first lines; the most frequent one is a query that names an entity.
ENTITY = "e AS (SELECT entity FROM d0 GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 1)"


def entity_of(c: Corpus) -> str:
    t = c.documents.groupBy(X.first_path_term(F.col("path")).alias("e")).agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "e").first()["e"]


def _entity_sql(tail: str) -> str:
    f = " + ".join(f"{w} * len(list_filter(k{i}, lambda t: t = entity))" for i, w in enumerate(C.FIELD_WEIGHTS.values()))
    g = " + ".join(f"{w} * {O.occurrences(['thing'], f'k{i}')}" for i, w in enumerate(C.FIELD_WEIGHTS.values()))
    body = O.bm25([["zzentity"], ["thing"]], "or")
    start = body.index("f AS (SELECT *, ")
    end = body.index(" FROM idx)")
    body = body[:start] + f"f AS (SELECT *, {f} AS f0, {g} AS f1 FROM idx, e)" + body[end + len(" FROM idx)") :]
    return f"{O.with_(O.CORPUS, O.INDEX, ENTITY, body, TOP)} {tail}"


_FIRST = rf"{O._words(O._base('path'))}[1]"
_NAMED = f"({_FIRST} = entity OR {O._words('title')}[1] = entity)"
_PRIMARY = f"(strlen({_FIRST}) >= 3 AND {_FIRST} NOT IN ({O.RECOMMENDATION_STOP}) AND (list_contains(tags, {_FIRST}) OR kind = 'source') AND {_FIRST} <> entity)"


@query(_entity_sql(f", sh AS (SELECT *, score + (CASE WHEN {_NAMED} THEN -0.25 WHEN {_PRIMARY} THEN 15.0 ELSE 0.0 END) AS moved FROM tp), nm AS (SELECT bool_or({_NAMED}) AS any_named FROM tp) SELECT section_id, path, {O._round('CASE WHEN any_named THEN moved ELSE score END', 6)} AS score, row_number() OVER (ORDER BY CASE WHEN any_named THEN moved ELSE place END, lexical_score, path, section_id) AS place FROM sh, nm"))
def entity_rerank(spark, d):
    c = corpus(spark, d)
    text = f"{entity_of(c)} thing"
    rows = S.rerank(rows_in(c, text, "or"), S.parse(text).terms)
    out = [(r["section_id"], r["path"], float(r["score"]), i + 1) for i, r in enumerate(rows)]
    t = spark.createDataFrame(out, "section_id string, path string, score double, place long")
    return t.withColumn("score", X.round_to(F.col("score"), 6))


@query(_entity_sql(f"SELECT max(entity) AS entity, bool_or({_NAMED}) AS named, count(*) FILTER ({_NAMED}) AS rows_named FROM tp"))
def entity_detection(spark, d):
    c = corpus(spark, d)
    e = entity_of(c)
    rows = rows_in(c, f"{e} thing", "or")
    return spark.createDataFrame([(e, e in S.entities(rows, [e, "thing"]), sum(S.is_of(r, e) for r in rows))], "entity string, named boolean, rows_named long")


@query(f"{O.with_(O.CORPUS, O.INDEX, O.bm25([['thble'], ['zzznothere']], 'and').replace('hits AS', 'hits_and AS'))} SELECT 'or_fallback' AS mode, 40::BIGINT AS rows WHERE (SELECT count(*) FROM hits_and) = 0")
def or_fallback(spark, d):
    q, o = S.parse("thble zzznothere"), S.Options().checked()
    i = index(spark, d)
    rows = S.top(i, q, o, "and", 6).collect()
    mode = "or_fallback" if S.falls_back(q, o, rows) else "and"
    n = S.top(i, q, o, "or", 6).count() if mode == "or_fallback" else len(rows)
    return spark.createDataFrame([(mode, n)], "mode string, rows long")


_BODY = "trim(regexp_replace(lower(trim(body)), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


def _section_quality(term: str, heading: int) -> str:
    return f"CASE WHEN list_contains({O._words('heading')}, '{term}') THEN {heading} WHEN list_contains({O._words(O._base('path'))}, '{term}') OR list_contains({O._words('title')}, '{term}') THEN 4 WHEN contains({_BODY}, '{term}') THEN 1 ELSE 0 END"


@query(searched(TWO, "or", f", {TOP}, q AS (SELECT tp.*, ({_section_quality('thble', 12).replace('heading', 'tp.heading').replace('path', 'tp.path')}) + ({_section_quality('thing', 32).replace('heading', 'tp.heading').replace('path', 'tp.path')}) AS quality FROM tp JOIN (SELECT section_id, body FROM secs) b ON b.section_id = tp.section_id) SELECT path, section_id, quality::BIGINT AS quality FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY quality DESC, score, lexical_score, section_id) AS k FROM q) WHERE k = 1"))
def best_section_per_path(spark, d):
    topics = ["thble", "thing"]
    best: dict = {}
    for r in rows_of(spark, d, TWO, "or"):
        key = (-S.section_quality(r, topics), S.rank(r))
        if r["path"] not in best or key < best[r["path"]][0]:
            best[r["path"]] = key, r["section_id"]
    return spark.createDataFrame([(p, i, -key[0]) for p, (key, i) in best.items()], "path string, section_id string, quality long")


@query(_entity_sql(f"SELECT max(entity) AS term, coalesce(bool_or({_NAMED} AND place <= 3), FALSE) AS covered, NOT coalesce(bool_or({_NAMED} AND place <= 3), FALSE) AS missing FROM tp HAVING bool_or({_NAMED})"))
def coverage(spark, d):
    """Which entities of a query its first three results cover."""
    c = corpus(spark, d)
    text = f"{entity_of(c)} thing"
    rows = rows_in(c, text, "or")
    covered, missing = S.coverage(rows, [{"section_id": r["section_id"]} for r in rows[:3]], S.parse(text).terms)
    return spark.createDataFrame([(t, c, t in missing) for t, c in covered.items()], "term string, covered boolean, missing boolean")


@query()
def snippet(spark, d):
    out = S.search(index(spark, d), TWO, S.Options(limit=20), 6)["results"]
    return spark.createDataFrame([(r["section_id"], r["snippet"], r["target"]) for r in out], "section_id string, snippet string, target string")


@query(searched(PHRASE, "or", "," + O.excerpts([fold_tokens(a) for a in S.parse(PHRASE).atoms]) + " SELECT section_id, snippet FROM excerpt"))
def excerpts(spark, d):
    """The excerpts of all sections that match, not only of those that a search would show."""
    query = S.parse(PHRASE)
    return R.excerpts(R.fields_of(S.ranked(index(spark, d), query, S.Options().checked(), "or", 6)), [fold_tokens(a) for a in query.atoms])


@query()
def search_pipeline(spark, d):
    out = S.search(index(spark, d), THREE, S.Options(limit=20), 6)
    return spark.createDataFrame([(i + 1, out["mode"], r["section_id"], r["target"], float(r["score"])) for i, r in enumerate(out["results"])], "place int, mode string, section_id string, target string, score double")


# Health.


def flat(df: DataFrame, queries: bool = False) -> DataFrame:
    """Candidates with their arrays as texts."""
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat(r["code"], F.lit("="), r["value"])), "|")
    return df.select("type", "confidence", "score", joined("pages").alias("pages"), joined("sources").alias("sources"), reasons.alias("reasons"), *([joined("queries").alias("queries")] if queries else []))


@query(O.with_(O.CORPUS, O.GRAPH, O.ORPHANS) + "SELECT * FROM orphans")
def orphans(spark, d):
    return flat(H.orphans(corpus(spark, d)))


@query(O.with_(O.CORPUS, O.GRAPH, O.ORPHANS) + f"SELECT o.type, o.pages, array_to_string({O._query_terms(O.with_queries('title', 'tags', 'path'), 7)}, ' ') AS queries, CASE o.type " + " ".join(f"WHEN '{k}' THEN '{C.REVIEW[k].replace(chr(39), chr(39) * 2)}'" for k in ("orphan_page", "underlinked_page")) + " END AS instruction FROM orphans o JOIN docs ON path = o.pages")
def orphan_queries(spark, d):
    return H.orphans(corpus(spark, d)).select("type", joined("pages").alias("pages"), joined("queries").alias("queries"), "instruction")


@query(O.with_(O.CORPUS, O.STUBS) + "SELECT * FROM stubs")
def stubs(spark, d):
    return flat(H.stubs(corpus(spark, d)))


LANG_TAGS = "tags2 AS (SELECT * FROM tags UNION ALL SELECT id, path, lang FROM docs WHERE kind = 'wiki')"


@query(O.with_(O.CORPUS, "nw AS (SELECT count(*) AS n FROM docs WHERE kind = 'wiki')", LANG_TAGS, O.tag_ctes("tags2")) + "SELECT * FROM tag_rows")
def tag_anomalies(spark, d):
    """With the language as one more tag, so that there is a broad one."""
    c = corpus(spark, d)
    lang = c.wiki.select(F.col("id").alias("document_id"), "path", F.regexp_extract("path", r"-([a-z]+)-\d+\.md$", 1).alias("tag"))
    return flat(H.tag_anomalies(Corpus(c.documents, c.sections, c.links, c.citations, c.tags.unionByName(lang))))


@query(O.with_(O.CORPUS, O.UNCITED) + "SELECT * FROM uncited")
def uncited_sources(spark, d):
    return flat(H.uncited_sources(corpus(spark, d)))


@query(O.with_(O.CORPUS, O.GAPS) + "SELECT * FROM gaps")
def coverage_gaps(spark, d):
    return flat(H.coverage_gaps(corpus(spark, d)))


PAIRED = O.with_(O.CORPUS, O.TERMS, O.GRAPH, O.PAIRS)


@query(PAIRED + "SELECT a, b FROM blocked")
def pair_blocking(spark, d):
    c, w = weights(spark, d)
    return H.blocked_pairs(c, w)


@query(PAIRED + f"SELECT a, b, array_to_string(stags, '|') AS tags, array_to_string(ssources, '|') AS sources, {O._round('ts', 6)} AS tag_score, {O._round('ss', 6)} AS source_score, rare::BIGINT AS rare FROM shared")
def pair_shared_tags(spark, d):
    c = corpus(spark, d)
    signal = c.tags.select("path", F.concat(F.lit("t"), "tag").alias("key")).unionAll(c.citations.select("wiki_path", F.concat(F.lit("s"), "source_path"))).distinct()
    t = H.signals_of(meetings(signal, H.signal_lists(c)))
    return t.select("a", "b", joined("tags").alias("tags"), joined("sources").alias("sources"), X.round_to(F.col("tag_score"), 6).alias("tag_score"), X.round_to(F.col("source_score"), 6).alias("source_score"), F.col("rare").cast("long").alias("rare"))


@query(PAIRED + f"SELECT a, b, {O._round('j', 6)} AS j, array_to_string(sterms, ',') AS terms FROM lex")
def weighted_jaccard(spark, d):
    c, w = weights(spark, d)
    t = H.blocked_overlap(c, w)
    return t.select("a", "b", X.round_to(F.col("j"), 6).alias("j"), F.array_join("shared_terms", ",").alias("terms"))


@query(PAIRED + "SELECT a, b, type, score FROM scored")
def pair_scores(spark, d):
    c, w = weights(spark, d)
    return H.scored_pairs(c, w).select("a", "b", "type", "score")


FULL_PAIRS = (O.CORPUS, O.TERMS, O.GRAPH, O.PAIRS, O.INDEX, O.OLDER, O.PAIR_ROWS)


@query(O.with_(*FULL_PAIRS) + "SELECT a, b, older FROM older")
def older_relevant(spark, d):
    c = corpus(spark, d)
    return H.older_relevant(c, H.best_pairs(c))


EVERY = (*FULL_PAIRS, O.ORPHANS, O.STUBS, O.tag_ctes("tags"), O.UNCITED, O.GAPS)


@query(O.with_(*EVERY) + ", " + O.diversified(10))
def health_all(spark, d):
    return flat(H.health(corpus(spark, d), limit=10))


@query(O.with_(*FULL_PAIRS) + "SELECT * FROM pairs WHERE type = 'missing_link' OR contains('|' || reasons, '|not_linked=') ORDER BY score DESC, type, replace(pages, '|', chr(0)) || CASE WHEN sources <> '' THEN chr(0) || replace(sources, '|', chr(0)) ELSE '' END LIMIT 25")
def health_kind_filter(spark, d):
    return flat(H.health(corpus(spark, d), kind="links", limit=25))


@query(O.with_(O.CORPUS, O.UNCITED, O.GAPS) + "SELECT * FROM (SELECT * FROM uncited UNION ALL SELECT * FROM gaps) WHERE starts_with(sources, 'sources/design/') ORDER BY score DESC, type, sources LIMIT 50")
def health_prefix(spark, d):
    return flat(H.health(corpus(spark, d), kind="sources", path="sources/design/", limit=50))


# Integrity and views.


@query(BASE + "SELECT path, 'path=' || path || ' hash=' || hash || ' size=' || size_bytes AS line, count(*) OVER () AS files FROM docs")
def manifest_lines(spark, d):
    c = corpus(spark, d).documents
    total = c.agg(F.count("*").alias("files"))
    return c.select("path", F.concat(F.lit("path="), "path", F.lit(" hash="), "hash", F.lit(" size="), F.col("size_bytes").cast("string")).alias("line")).crossJoin(F.broadcast(total))


@query(BASE + "SELECT sha256('schema_version=3' || chr(10) || 'indexer_version=1' || chr(10) || 'markdown_sections_version=1' || chr(10) || string_agg('path=' || path || ' hash=' || hash || ' size=' || size_bytes || chr(10), '' ORDER BY path)) AS manifest_hash, sha256(string_agg(path || chr(10), '' ORDER BY path)) AS paths_hash, count(*) AS files FROM docs")
def manifest_hash(spark, d):
    return G.manifest(corpus(spark, d))


@query(RAW + r"SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM raw")
def sha_manifest(spark, d):
    t = raw(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    return t.join(G.checksum_lines(t), "path").select("doc_id", F.substring_index("line", "sha256:", -1).alias("hash"))


@query("SELECT 'unique_id' AS rule, min(doc_id) AS path, md5(coalesce(text, '')) AS detail FROM documents GROUP BY 3 HAVING count(*) > 1")
def dup_ids(spark, d):
    return V.duplicates(raw(spark, d).select(F.md5("text").alias("id"), "doc_id"), "id", "doc_id", "unique_id")


@query(BASE + """, c AS (SELECT p.path, string_agg('[' || x.title || '](' || x.path || ')', ', ' ORDER BY x.path) AS cited FROM (SELECT path, unnest(sources) AS s FROM docs WHERE kind = 'wiki') p JOIN docs x ON x.path = p.s GROUP BY 1),
t AS (SELECT path, title, string_split(regexp_replace(path, '^wiki/', ''), '/') AS p, cited FROM docs LEFT JOIN c USING (path) WHERE kind = 'wiki')
SELECT repeat('  ', len(p) - 1) || '- [' || title || '](' || path || ')' AS line FROM t UNION ALL SELECT repeat('  ', len(p) - 1) || '  - Sources: ' || cited FROM t WHERE cited IS NOT NULL
UNION ALL SELECT DISTINCT '- ' || p[1] || '/' FROM t WHERE len(p) > 1""")
def index_tree(spark, d):
    return G.index_tree(corpus(spark, d)).select("line")


@query(BASE + """, t AS (SELECT path, title, string_split(regexp_replace(path, '^sources/', ''), '/') AS p FROM docs WHERE kind = 'source') SELECT repeat('  ', len(p) - 1) || '- [' || title || '](' || path || ')' AS line FROM t UNION ALL SELECT DISTINCT '- ' || p[1] || '/' FROM t WHERE len(p) > 1""")
def sources_tree(spark, d):
    return G.sources_tree(corpus(spark, d)).select("line")


_EVENT = "'- ' || strftime(ts, '%Y-%m-%d') || ' [' || event_type || '] [user-' || user_id || ']: event ' || event_id"


def event_lines(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", L.format_line(F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("value"))


@query(f"SELECT event_id, {_EVENT} AS value FROM events")
def changelog_format(spark, d):
    return event_lines(spark, d)


_DAY = "strftime(ts, '%Y-%m-%d')"
_KINDS = ["'- ' || day || ' [' || event_type || '] [user-' || user_id || ']: event ' || event_id", "'- ' || day || ' [create] [user-' || user_id || ']: event ' || event_id", "day || ' [update] [me]: event ' || event_id", "'- 2026-13-01 [delete] [me]: event ' || event_id", "'- ' || day || ' [append] [ ]: event ' || event_id", "'rubbish ' || event_id"]
_LINES = f"ev AS (SELECT *, {_DAY} AS day, event_id % 6 AS k FROM events), ln AS (SELECT *, CASE k " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_KINDS)) + " END AS line FROM ev)"


@query(f"""WITH {_LINES} SELECT line, CASE WHEN k = 5 THEN '' WHEN k = 3 THEN '2026-13-01' ELSE day END AS date, CASE k WHEN 0 THEN event_type WHEN 1 THEN 'create' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' WHEN 4 THEN 'append' ELSE '' END AS operation,
CASE WHEN k <= 1 THEN 'user-' || user_id WHEN k <= 3 THEN 'me' WHEN k = 4 THEN ' ' ELSE '' END AS actor, CASE WHEN k < 5 THEN 'event ' || event_id ELSE '' END AS reason,
CASE k WHEN 0 THEN 'operation is not supported' WHEN 3 THEN 'date must be YYYY-MM-DD' WHEN 4 THEN 'actor is missing or holds ] or a line break' WHEN 5 THEN 'not a changelog line' END AS fault FROM ln""")
def changelog_parse(spark, d):
    """Lines of all kinds: valid entries with and without a dash, and one of each fault that a line can have."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    day, event = F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("event "), text("event_id"))
    user, me = F.concat(F.lit("user-"), text("user_id")), F.lit("me")
    kinds = [L.format_line(day, F.col("event_type"), user, event), L.format_line(day, F.lit("create"), user, event), F.substring(L.format_line(day, F.lit("update"), me, event), 3, 10_000), L.format_line(F.lit("2026-13-01"), F.lit("delete"), me, event), L.format_line(day, F.lit("append"), F.lit(" "), event), F.concat(F.lit("rubbish "), text("event_id"))]
    return L.parse(e.select(F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int")).alias("value")))


@query(BASE + "SELECT path, list_sort(list_distinct(list_concat(tags, ['x']))) = list_sort(list_distinct(list_concat(['x'], list_reverse(tags)))) AS same, list_sort(tags) = list_sort(links) AS other FROM docs")
def set_equality(spark, d):
    t = corpus(spark, d).documents
    x = F.array(F.lit("x"))
    return t.select("path", (X.sorted_unique(F.concat("tags", x)) == X.sorted_unique(F.concat(x, F.reverse("tags")))).alias("same"), (X.sorted_unique(F.col("tags")) == X.sorted_unique(F.col("links"))).alias("other"))


@query(RAW + """, l AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) AS t FROM raw), r AS (SELECT string_agg(replace(text, 'the', 'teh'), chr(10) ORDER BY doc_id) AS t FROM raw),
a AS (SELECT unnest(string_split(t, chr(10))) AS s, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM l), b AS (SELECT unnest(string_split(t, chr(10))) AS s, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM r)
SELECT a.n::BIGINT AS n, md5(a.s) AS "left", md5(b.s) AS "right" FROM a FULL JOIN b USING (n) WHERE a.s IS DISTINCT FROM b.s ORDER BY 1 LIMIT 5""")
def line_diff(spark, d):
    """A diff is of two texts: here those of all documents in the order of their ids, and the same with a letter swap.

    Documents are compared one by one, since the swap leaves their numbers of lines.
    """
    t = raw(spark, d).select(F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), "text")
    diff = G.line_diff(t, t.select("key", F.replace("text", F.lit("the"), F.lit("teh")).alias("text")), key=("key",))
    # The lines before a document, for the few in the result.
    lines = t.select(F.col("key").alias("other"), F.size(F.split("text", "\n", -1)).alias("lines"))
    before = lines.join(F.broadcast(diff.select("key").distinct()), F.col("other") < F.col("key")).groupBy("key").agg(F.sum("lines").alias("before"))
    n = F.col("n") + F.coalesce("before", F.lit(0))
    return diff.join(F.broadcast(before), "key", "left").select(n.cast("long").alias("n"), F.md5("left").alias("left"), F.md5("right").alias("right")).orderBy("n")


_GONE = "gone AS (SELECT min(source_path) AS g FROM cits)"


@query(O.with_(O.CORPUS, _GONE) + "SELECT path, CASE WHEN len(list_filter(sources, lambda s: s <> g)) = 0 THEN 'deleted' ELSE 'cleaned' END AS action, array_to_string(list_filter(sources, lambda s: s <> g), '|') AS sources FROM docs, gone WHERE kind = 'wiki' AND list_contains(sources, g) UNION ALL SELECT g, 'deleted', '' FROM gone")
def cascade_delete(spark, d):
    c = corpus(spark, d)
    first = c.citations.agg(F.min("source_path")).first()[0]  # the argument of the operation
    return D.cascade_plan(c.documents, first).select("path", "action", joined("sources").alias("sources"))


@query(BASE + "SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'updated: ' || title ELSE title END AS title FROM docs WHERE doc_id % 10 <> 7 UNION ALL SELECT 'wiki/new-' || doc_id || '.md', 'new' FROM docs WHERE doc_id % 10 = 7")
def upsert_snapshot(spark, d):
    """A snapshot after updates, inserts and deletes: what is replaced or removed is left out by an anti-join, what is new is added."""
    docs = corpus(spark, d).documents
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    updates = docs.filter(number % 10 == 3).select("path", F.concat(F.lit("updated: "), "title").alias("title"))
    inserts = docs.filter(number % 10 == 7).select(F.concat(F.lit("wiki/new-"), number.cast("string"), F.lit(".md")).alias("path"), F.lit("new").alias("title"))
    return D.upsert(docs.select("path", "title"), updates.unionByName(inserts), docs.filter(number % 10 == 7).select("path"))


@query(ORACLES["upsert_snapshot"])
def table_upsert(spark, d):
    """The same on a table of files, of which only those with touched keys are rewritten."""
    docs, path = corpus(spark, d).documents, new_folder(spark, "table")
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    B.create(spark, docs.select("path", "title"), path)
    gone = docs.filter(number % 10 == 7)
    B.upsert(spark, path, docs.filter(number % 10 == 3).select("path", F.concat(F.lit("updated: "), "title").alias("title")), gone)
    B.upsert(spark, path, gone.select(F.concat(F.lit("wiki/new-"), number.cast("string"), F.lit(".md")).alias("path"), F.lit("new").alias("title")))
    return B.read(spark, path)


@query(BASE + ", one AS (SELECT min(source_path) AS f FROM cits) SELECT path, array_to_string(list_filter(sources, lambda x: x <> f), '|') AS sources, CASE WHEN list_contains(sources, f) THEN '2026-06-01' ELSE modified_date END AS modified_date FROM docs, one WHERE path <> f AND NOT (len(sources) = 1 AND sources[1] = f)")
def table_cascade(spark, d):
    """A table of files after the deletion of the first cited source and of what hangs on it."""
    c, path = corpus(spark, d), new_folder(spark, "table")
    first = c.citations.agg(F.min("source_path")).first()[0]  # the argument of the operation
    B.create(spark, c.documents, path)
    B.cascade(spark, path, first, "2026-06-01")
    return B.read(spark, path).select("path", joined("sources").alias("sources"), "modified_date")


@query(BASE + "SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'changed' END AS change FROM docs WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def freshness_changes(spark, d):
    docs = corpus(spark, d).documents.select("path", "hash")
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    now = docs.filter(number % 11 != 0).withColumn("hash", F.when(number % 13 == 0, F.lit("other")).otherwise(F.col("hash")))
    return G.changed(docs, now)


_NODES = "SELECT path, md5(path) AS key, md5(path || chr(10) || hash) AS own FROM docs"


@query(BASE + f"SELECT level::INT AS level, substr(key, 1, level) AS node, count(*) AS n, bit_xor(('0x' || substr(own, 1, 15))::BIGINT) AS x, bit_xor(('0x' || substr(own, 16, 15))::BIGINT) AS y FROM ({_NODES}), range(5) AS r(level) GROUP BY 1, 2")
def digest_tree(spark, d):
    return J.tree(corpus(spark, d).documents)


@query(ORACLES["freshness_changes"])
def digest_changes(spark, d):
    """The changes of ``freshness_changes`` from two written snapshots, of which only differing ranges are read."""
    docs = corpus(spark, d).documents.select("path", "hash")
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    now = docs.filter(number % 11 != 0).withColumn("hash", F.when(number % 13 == 0, F.lit("other")).otherwise(F.col("hash")))
    paths = [new_folder(spark, "digests") for _ in range(2)]
    for rows, path in zip((docs, now), paths):
        J.write(rows, path)
    return J.changes(*[J.Snapshot.read(spark, path) for path in paths])


_SCANS = """sc AS (SELECT 1 AS scan, path, hash FROM docs UNION ALL SELECT 2, path, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE hash END FROM docs WHERE doc_id % 11 <> 0 UNION ALL SELECT 3, path, hash FROM docs WHERE doc_id % 7 <> 0),
ev AS (SELECT coalesce(b.path, a.path) AS path, coalesce(b.scan, a.scan + 1) AS scan, a.hash AS old, b.hash AS new FROM sc a FULL JOIN sc b ON a.path = b.path AND b.scan = a.scan + 1)"""


@query(O.with_(O.CORPUS, _SCANS) + " SELECT path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change, scan::BIGINT AS scan FROM ev WHERE scan <= 3 AND old IS DISTINCT FROM new")
def stream_changes(spark, d):
    """What a stream of three scans says: documents that go and come back, and hashes that change and change back."""
    docs = corpus(spark, d).documents.select("path", "hash")
    number = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long")
    two = docs.filter(number % 11 != 0).withColumn("hash", F.when(number % 13 == 0, F.lit("other")).otherwise(F.col("hash")))
    folder, target, state = (new_folder(spark, n) for n in ("scans", "events", "state"))
    for k, rows in enumerate((docs, two, docs.filter(number % 7 != 0)), 1):
        Q.publish(rows, folder, k)
    return Q.follow(spark, folder, target, state)


_N = "doc_id % 40"
_SAME = "(SELECT id FROM docs WHERE doc_id % 40 = 15)"
_BROKEN = " UNION ALL ".join(
    [f"SELECT '{rule}' AS rule, path, '' AS detail FROM docs WHERE {_N} = {k}" for k, rule in ((0, "kind"), (1, "tier"), (2, "title"), (3, "summary"), (5, "modified_date"), (6, "size"), (7, "tags"), (8, "source_metadata"), (9, "tags"), (10, "sorted_lists"))]
    + [f"SELECT '{rule}', path, '' FROM secs JOIN docs USING (path) WHERE secs.ordinal = 1 AND {_N} = {k}" for k, rule in ((13, "ordinal"), (14, "level"))]
    + [f"SELECT 'unique_id', min(path), 'doc_same' FROM docs WHERE {_N} = 15 HAVING count(*) > 1"]
    + [f"SELECT '{rule}', {path}, {of} FROM {table} WHERE {of} IN {_SAME}" for rule, path, of, table in (("section_document", "path", "document_id", "secs"), ("link_document", "from_path", "from_document_id", "links"), ("citation_document", "wiki_path", "document_id", "cits"), ("tag_document", "path", "document_id", "tags"))]
    + [f"SELECT 'link_target_id', from_path, to_path FROM links WHERE to_document_id IN {_SAME}"]
)


@query(BASE + _BROKEN)
def integrity_violations(spark, d):
    """The derived corpus, sound as it is, with one kind of damage to every fortieth page or source for each rule."""
    c = corpus(spark, d)
    n = F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long") % 40
    array = lambda *v: F.array(*map(F.lit, v))
    bad = {"kind": {0: F.lit("asset")}, "tier": {1: F.lit("none")}, "title": {2: F.lit(" ")}, "summary": {3: F.lit("")}, "modified_date": {5: F.lit("2026-13-01")}, "size_bytes": {6: F.lit(-1)}, "tags": {7: F.array().cast("array<string>"), 8: array("x"), 9: array("Bad tag"), 10: array("b", "a")}, "id": {15: F.lit("doc_same")}}

    def damaged(df: DataFrame, damage: dict) -> DataFrame:
        for col, by in damage.items():
            value = F.col(col)
            for k, v in by.items():
                value = F.when(n == k, v).otherwise(value)
            df = df.withColumn(col, value)
        return df

    first = F.col("ordinal") == 1
    sections = c.sections.withColumn("level", F.when(first & (n == 14), 0).otherwise(F.col("level"))).withColumn("ordinal", F.when(first & (n == 13), 0).otherwise(F.col("ordinal")))
    return V.check(Corpus(damaged(c.documents, bad), sections, c.links, c.citations, c.tags))


@query(BASE + """, tg AS (SELECT 'tags.md' AS view, '- ' || tag || ' (' || count(*) || ')' AS line FROM tags GROUP BY tag), sm AS (SELECT 'SUMS', path || ' sha256:' || sha256(replace(text, chr(13) || chr(10), chr(10))) FROM docs WHERE kind = 'wiki'),
sr AS (SELECT path, title, string_split(regexp_replace(path, '^sources/', ''), '/') AS p FROM docs WHERE kind = 'source')
SELECT * FROM tg UNION ALL SELECT * FROM sm UNION ALL SELECT 'SOURCES.md', repeat('  ', len(p) - 1) || '- [' || title || '](' || path || ')' FROM sr UNION ALL SELECT DISTINCT 'SOURCES.md', '- ' || p[1] || '/' FROM sr WHERE len(p) > 1
UNION ALL SELECT 'ASSETS.md', '- [' || source || '.png](assets/' || source || '.png)' FROM (SELECT DISTINCT source FROM raw)""")
def generated_views(spark, d):
    """The lines of the generated files that have one text each; assets: a picture for each origin of texts. ``index_tree`` has the index's."""
    c = corpus(spark, d)
    texts = paths_of(spark.read.parquet(f"{d}/documents.parquet")).filter("kind = 'wiki'")
    sums = texts.select("path", F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256).alias("sum_hash"))
    assets = spark.read.parquet(f"{d}/documents.parquet").select(F.concat("source", F.lit(".png")).alias("title")).distinct().select(F.concat(F.lit("assets/"), "title").alias("path"), "title")
    made = [v.rows.select(F.lit(v.name).alias("view"), "line") for v in N.views(c, sums, assets) if v.name != "INDEX.md"]
    return reduce(DataFrame.unionByName, made)


# Imports.


@query()
def html_import(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return M.html_to_markdown(p, "html").select("page_id", "title", F.length("markdown").alias("n"))


@query(r"SELECT page_id, 'sources/' || CASE WHEN s = '' THEN 'untitled' ELSE s END || '-' || substr(sha256(url), 1, 10) || '.md' AS path FROM (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)")
def import_paths(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", M.target_path(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), F.col("url")).alias("path"))


# Pages with planted faults: by their numbers, each rule that reads parsed Markdown finds its own.
_FAULTY = """f AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN 'sources/n' ELSE 'wiki/n' END || doc_id || '.md' AS path, len(string_split(text, chr(10))) AS n FROM raw),
w AS (SELECT *, EXISTS (SELECT 1 FROM f t WHERE t.k = f.k + 1) AND (k + 1) % 4 <> 0 AS next FROM f WHERE k % 4 <> 0)"""


@query(RAW + f""", {_FAULTY}
SELECT 'title_heading' AS rule, path, 'Other' || k AS detail FROM w WHERE k % 13 = 5
UNION ALL SELECT 'links', path, '' FROM w WHERE k % 11 = 2 AND (next OR k % 17 = 3)
UNION ALL SELECT 'missing_target', path, 'wiki/gone' || k || '.md' FROM w WHERE k % 17 = 3
UNION ALL SELECT 'missing_anchor', path, 'wiki/n' || (k + 1) || '.md#nowhere' FROM w WHERE k % 19 = 4 AND next
UNION ALL SELECT 'missing_anchor', path, 'sources/n' || (k - k % 4) || '.md#one-1' FROM w WHERE k % 31 = 8
UNION ALL SELECT 'body_lines', path, (14 + n + CASE WHEN k % 29 = 7 THEN -4 ELSE 0 END + CASE WHEN next THEN 2 ELSE 0 END + CASE WHEN k % 17 = 3 THEN 2 ELSE 0 END + CASE WHEN k % 19 = 4 AND next THEN 2 ELSE 0 END + CASE WHEN k % 31 = 8 THEN 2 ELSE 0 END + CASE WHEN k % 23 = 6 THEN 400 ELSE 0 END)::VARCHAR
  FROM w WHERE 14 + n + CASE WHEN k % 29 = 7 THEN -4 ELSE 0 END + CASE WHEN next THEN 2 ELSE 0 END + CASE WHEN k % 17 = 3 THEN 2 ELSE 0 END + CASE WHEN k % 19 = 4 AND next THEN 2 ELSE 0 END + CASE WHEN k % 31 = 8 THEN 2 ELSE 0 END + CASE WHEN k % 23 = 6 THEN 400 ELSE 0 END > 400
UNION ALL SELECT 'sources_section', path, '' FROM w WHERE k % 29 = 7
UNION ALL SELECT 'sources', path, '' FROM w WHERE k % 29 = 7 AND k % 31 <> 8
UNION ALL SELECT 'frontmatter', path, 'summary is required' FROM w WHERE k % 37 = 9
UNION ALL SELECT 'frontmatter', path, 'more than 5 tags' FROM w WHERE k % 41 = 10""")
def page_faults(spark, d):
    """Every rule on parsed pages, over pages made of the texts: what is found is what was planted."""
    t = raw(spark, d).withColumnRenamed("doc_id", "k")
    after = t.select((F.col("k") - 1).alias("k"), F.lit(True).alias("there"))
    t = t.join(after, "k", "left").withColumn("next", F.coalesce("there", F.lit(False)) & ((F.col("k") + 1) % 4 != 0))
    n, up = F.col("k").cast("string"), (F.col("k") + 1).cast("string")
    source = F.concat(F.lit("n"), (F.col("k") - F.col("k") % 4).cast("string"), F.lit(".md"))
    every = lambda m, r: F.col("k") % m == r
    part = lambda test, *of: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in of])).otherwise("")
    prose = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("x"), F.regexp_replace(x, "[^A-Za-z ]", ""))), "\n")
    links = F.array_compact(F.array(F.when(F.col("next"), F.concat(F.lit("wiki/n"), up, F.lit(".md"))), F.when(every(17, 3), F.concat(F.lit("wiki/gone"), n, F.lit(".md")))))
    quoted = F.to_json(F.when(every(11, 2), F.array().cast("array<string>")).otherwise(links))
    front = F.concat(
        F.lit("---\ntitle: N"), n, F.when(every(37, 9), "\nsummary: ''").otherwise("\nsummary: s"), F.when(every(41, 10), "\ntags: [a, b, c, d, e, f]").otherwise("\ntags: [a]"), F.lit("\ncorpus:\n  id: doc_"), F.md5(n),
        F.lit("\n  schema: document-v1\n  kind: wiki\n  modified_date: '2026-01-01'\n  sources: ['sources/"), source, F.lit("']\n  links: "), quoted, F.lit("\n---\n\n"),
    )
    body = F.concat(
        F.lit("# "), F.when(every(13, 5), "Other").otherwise("N"), n, F.lit("\n\n## One\n\n## Two\n\n"), prose, F.lit("\n\n"), part(F.col("next"), "[next](n", up, ".md)\n\n"), part(every(17, 3), "see [gone](./gone", n, ".md)\n\n"),
        part(every(19, 4) & F.col("next"), "and [part](../wiki/n", up, ".md#nowhere)\n\n"), part(every(31, 8), "cited [source: ../sources/", source, "#one-1]\n\n"), part(~every(29, 7), "## Sources\n\n- [s](../sources/", source, ")\n\n"),
        F.lit("## End\n\n"), F.when(every(23, 6), F.repeat(F.lit("y\n"), 400)).otherwise(""), F.lit("last\n"),
    )
    wiki = F.col("k") % 4 != 0
    files = t.select(F.concat(F.when(wiki, "wiki/n").otherwise("sources/n"), n, F.lit(".md")).alias("path"), F.when(wiki, "wiki").otherwise("source").alias("kind"), F.encode(F.when(wiki, F.concat(front, body)).otherwise(F.concat(F.lit("# S\n\n## One\n\n"), prose)), "UTF-8").alias("content"))
    return V.pages(checkpoint(T.parse(files)))


_PLAIN = "trim(regexp_replace(line, '[^\\p{L}\\p{N} .,]+', ' ', 'g'))"
_PARTS = f"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM raw),
c AS (SELECT doc_id, i, CASE WHEN {_PLAIN} = '' THEN 'x' || i ELSE {_PLAIN} END AS line FROM l),
e AS (SELECT doc_id, i, i // 5 AS part, CASE i % 5 WHEN 2 THEN '```' || chr(10) || '# ' || line || chr(10) || '```' ELSE line END AS element FROM c),
s AS (SELECT doc_id, part + 1 AS ordinal, max(line) FILTER (i % 5 = 0) AS heading, 2 AS level, coalesce(string_agg(element, chr(10) || chr(10) ORDER BY i) FILTER (i % 5 > 0), '') AS body FROM e JOIN c USING (doc_id, i) GROUP BY doc_id, part
  UNION ALL SELECT doc_id, max(i) // 5 + 2, 'Tail', 1, '' FROM l WHERE doc_id % 10 = 3 GROUP BY doc_id),
a AS (SELECT *, {O._anchor("heading")} AS mark FROM s)"""


@query(RAW + f", {_PARTS} SELECT doc_id, ordinal::INT AS ordinal, heading, mark || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END AS anchor, level, md5(body) AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mark ORDER BY ordinal) AS k FROM a)")
def markdown_parse(spark, d):
    """The sections of texts written as Markdown: each fifth line a heading, one in fenced code, all others paragraphs; each tenth text ends with an underlined heading."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N} .,]+", " ")).alias("line"), i.alias("i")))
    named = F.transform(lines, lambda x: F.struct(F.when(x["line"] == "", F.concat(F.lit("x"), x["i"].cast("string"))).otherwise(x["line"]).alias("line"), x["i"].alias("i")))
    element = F.transform(named, lambda x: F.when(x["i"] % 5 == 0, F.concat(F.lit("## "), x["line"])).when(x["i"] % 5 == 2, F.concat(F.lit("```\n# "), x["line"], F.lit("\n```"))).otherwise(x["line"]))
    tail = F.when(F.col("doc_id") % 10 == 3, "\n\nTail\n====").otherwise("")
    found = T.sections_of(raw(spark, d).select("doc_id", F.concat(F.array_join(element, "\n\n"), tail).alias("body")), "body")
    return found.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.ordinal", "s.heading", "s.anchor", "s.level", F.md5("s.body").alias("body"))
