"""Record schemas, enumerations and fixed numbers of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT = _struct(id=_S, path=_S, kind=_S, tier=_S, title=_S, summary=_S, tags=_A, sources=_A, links=_A, modified_date=_S, hash=_S, size_bytes=T.LongType())
SECTION = _struct(section_id=_S, document_id=_S, path=_S, ordinal=T.IntegerType(), heading=_S, anchor=_S, level=T.IntegerType(), body=_S)
LINK = _struct(from_document_id=_S, from_path=_S, from_anchor=_S, to_path=_S, to_anchor=_S, to_document_id=_S, kind=_S)
CITATION = _struct(document_id=_S, wiki_path=_S, source_path=_S, source_anchor=_S, citation_kind=_S)
TAG = _struct(document_id=_S, path=_S, tag=_S)
CHANGE = _struct(date=_S, operation=_S, actor=_S, reason=_S)

# Kinds, tiers, operations, candidate types, reasons and what to do about a candidate.
KINDS = ("source", "wiki")
TIERS = ("canonical", "design", "reference")
OPERATIONS = ("source", "create", "append", "update", "asset", "delete", "migrate", "move")
CANDIDATE_KINDS = ("all", "duplicates", "links", "sources", "orphans", "stubs", "tags")
REVIEW = {
    "possible_duplicate": "Read both pages and cited sources before deciding whether to merge, cross-link, or leave separate.",
    "missing_link": "Read both pages before deciding whether a cross-link is warranted.",
    "orphan_page": "Search for related pages before deciding whether to link, merge, or leave standalone.",
    "underlinked_page": "Search for related pages before deciding whether additional inbound or outbound links are warranted.",
    "uncited_source": "Search for concepts in this source and decide whether to create or update wiki coverage, or leave it uncited.",
    "source_coverage_gap": "Review uncited source sections and decide whether to add wiki coverage, inline citations, or leave them uncovered.",
    "stub_page": "Review whether this page should be expanded with more content or merged into a parent page.",
    "tag_anomaly": "Review whether this tag adds search value. Singleton tags may need removal or broader application; broad tags may need splitting or removal.",
}

# Field weights of the ranking, its two constants, and the additions to a score.
FIELD_WEIGHTS = {"title": 5.0, "path": 3.0, "summary": 4.0, "tags": 2.0, "sources": 2.0, "links": 1.5, "heading": 3.0, "body": 1.0}
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
WIKI_BONUS = 0.15
HEADING_PENALTY = {"sources": 4.0, "related pages": 4.0, "status": 3.5, "table of contents": 3.5, "contents": 3.5, "navigation": 3.5}
TIER_PENALTY = {"design": 0.45, "reference": 0.60}
ENTITY_MATCH, ENTITY_MISMATCH = -0.25, 15.0

# Limits of search and of health candidates.
SEARCH_LIMIT, SEARCH_MOST = 5, 20
FETCH_TIMES, FETCH_LEAST, FETCH_MOST = 5, 40, 100
SECTIONS_PER_DOCUMENT, READ_ORDER = 3, 3
CANDIDATE_LIMIT, CANDIDATE_MOST = 10, 50
PAIR_TERMS, RARE_TERM, RARE_SIGNAL = 12, 8, 3
LEXICAL_REASON, LEXICAL_PAIR, LEXICAL_DUPLICATE, PAIR_LEAST = 0.08, 0.10, 0.22, 0.18
OLDER_PAIRS, OLDER_DAYS = 100, 30
STUB_LINES, STUB_SHORT = 15, 5
TAG_PAGES, TAG_BROAD = 3, 0.40
GAP_REASONS = 5
BODY_LINES, MAX_TAGS = 400, 5

# Stop words of search, of recommendations (besides those), of candidates (besides both).
SEARCH_STOPWORDS = frozenset(
    """a about an and are as at be between by can compare comparison difference differences do does explain find for
    from how i in information is it of on or read relationship should that the this to understand versus vs was what
    when where which who why with""".split()
)
RECOMMENDATION_STOPWORDS = frozenset(
    """about answer better compare comparison difference differences explain find information read relationship search
    understand versus vs""".split()
)
CANDIDATE_STOPWORDS = frozenset(
    """anchor anchors available body combined compact doc docs file files generated generic index markdown may must
    page pages section sections source sources wiki""".split()
)
ALL_STOPWORDS = SEARCH_STOPWORDS | RECOMMENDATION_STOPWORDS | CANDIDATE_STOPWORDS
