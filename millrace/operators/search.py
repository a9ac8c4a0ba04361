"""Ranked search: weighted BM25 over eight fields, exact filters, penalties, entity-aware reranking, recommendations.

Matching, scoring, filtering and top-k are one DataFrame plan over the postings of the query's terms. What follows
works on the rows that a search fetches, at most ``FETCH_MOST``, on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import schema as C
from ..functions import text as X
from ..functions.plain import first_path_word, first_word, fold_tokens, normalize, path_words
from ..sources.cut import checkpoint
from .excerpts import excerpts, fields_of
from .index import Index

TAG = re.compile(r"^[a-z0-9][a-z0-9-]{0,62}$")


@dataclass
class Query:
    """atoms: normalised words and phrases to match; terms: their distinct words in order."""

    atoms: list[str]
    terms: list[str]


def parse(query: str) -> Query:
    """Quoted parts are phrases and stay whatever they are; other parts lose stop words, and what normalises to several words is a phrase."""
    atoms: list[str] = []
    for m in re.finditer(r'"([^"]*)(?:"|\Z)|([^\s"]+)', query):
        quoted, text = m.group(1) is not None, normalize(m.group(1) if m.group(1) is not None else m.group(2))
        if text and (quoted or " " in text or text not in C.SEARCH_STOPWORDS):
            atoms.append(text)
    if not atoms:
        raise ValueError("the query has no searchable words")
    return Query(atoms, list(dict.fromkeys(w for a in atoms for w in a.split())))


@dataclass
class Options:
    limit: int = C.SEARCH_LIMIT
    kind: str = "all"
    path: str = ""
    tags: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    tiers: list[str] = field(default_factory=list)

    def checked(self) -> Options:
        limit = C.SEARCH_LIMIT if self.limit <= 0 else min(self.limit, C.SEARCH_MOST)
        if self.kind not in ("all", *C.KINDS):
            raise ValueError(f"kind {self.kind!r} is not all, source or wiki")
        path = self.path.strip().replace("\\", "/").removeprefix("./")
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"path prefix {self.path!r} leaves the corpus")
        tags, sources, tiers = (list(dict.fromkeys(x.strip() for x in v if x.strip())) for v in (self.tags, self.sources, self.tiers))
        if bad := [t for t in tags if not TAG.match(t)]:
            raise ValueError(f"tag {bad[0]!r} is not a lower-case slug")
        if bad := [s for s in sources if not s.startswith("sources/") or ".." in s.split("/")]:
            raise ValueError(f"{bad[0]!r} is not a source path")
        if bad := [t for t in tiers if t not in C.TIERS]:
            raise ValueError(f"tier {bad[0]!r} is not known")
        return Options(limit, self.kind, path, tags, sources, tiers)


def fetch_size(limit: int) -> int:
    return max(C.FETCH_LEAST, min(C.FETCH_MOST, C.FETCH_TIMES * limit))


# One plan: matching and scoring.


def shifted(by: int):
    return lambda x: x - by


def frequency(phrase: list[str]) -> Column:
    """How often a phrase occurs in the fields ``at0``, ``at1``, ... (maps of token to positions), by their weights."""
    none = F.array().cast("array<int>")

    def occurrences(i: int) -> Column:
        # A phrase is consecutive tokens of one field: shift each token's positions to the phrase's start.
        starts = [F.transform(F.coalesce(F.col(f"at{i}")[t], none), shifted(k)) for k, t in enumerate(phrase)]
        return F.when(F.col(f"at{i}").isNull(), 0).otherwise(F.size(reduce(F.array_intersect, starts)))

    return reduce(Column.__add__, [w * occurrences(i) for i, w in enumerate(C.FIELD_WEIGHTS.values())])


def inverse_frequency(n: Column, has: Column) -> Column:
    raw = F.log((n - has + 0.5) / (has + 0.5))
    return F.when(raw <= 0, C.BM25_LEAST_IDF).otherwise(raw)


def saturated(f: Column, length: Column, mean: Column) -> Column:
    return f * (C.BM25_K1 + 1) / (f + C.BM25_K1 * ((1 - C.BM25_B) + C.BM25_B * length / mean))


def bm25(index: Index, query: Query, mode: str = "and") -> DataFrame:
    """section_id and lexical_score (lower is better) of the sections that match all atoms, or any of them.

    Statistics are the whole corpus's: filters come later and don't change them.
    """
    phrases = [fold_tokens(a) for a in query.atoms]
    hits, stats = index.matches(sorted({t for p in phrases for t in p}))
    per = hits.select("section_id", "length", *[frequency(p).alias(f"f{i}") for i, p in enumerate(phrases)])
    seen = per.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(phrases))])
    both = per.filter(reduce(Column.__and__ if mode == "and" else Column.__or__, [F.col(f"f{i}") > 0 for i in range(len(phrases))]))
    full = both.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(stats))  # one row each

    part = lambda i: inverse_frequency(F.col("n"), F.col(f"n{i}")) * saturated(F.col(f"f{i}"), F.col("length"), F.col("avgdl"))
    return full.select("section_id", (-reduce(Column.__add__, [part(i) for i in range(len(phrases))])).alias("lexical_score"))


def final_score(lexical: Column, kind: Column, heading: Column, tier: Column) -> Column:
    nav = reduce(lambda w, h: w.when(F.lower(heading) == h, C.HEADING_PENALTY[h]), C.HEADING_PENALTY, F).otherwise(0.0)
    off = reduce(lambda w, t: w.when(tier == t, C.TIER_PENALTY[t]), C.TIER_PENALTY, F).otherwise(0.0)
    return lexical - F.when(kind == "wiki", F.abs(lexical) * C.WIKI_BONUS).otherwise(0.0) + nav + F.abs(lexical) * off


def filtered(sections: DataFrame, o: Options) -> DataFrame:
    """Filters that aren't asked for aren't in the plan. Tags and sources must all be there, one of the tiers suffices."""
    if o.kind != "all":
        sections = sections.filter(F.col("kind") == o.kind)
    if o.path:
        sections = sections.filter(F.lower("path").startswith(o.path.lower()))
    for t in o.tags:
        sections = sections.filter(F.array_contains("tags", t))
    for s in o.sources:
        sections = sections.filter(F.array_contains("sources", s))
    if o.tiers:
        sections = sections.filter(F.col("tier").isin(o.tiers))
    return sections


ORDER = ("score", "lexical_score", "not_wiki", "path", "ordinal", "section_id")


def ranked(index: Index, query: Query, options: Options, mode: str = "and", digits: int | None = None) -> DataFrame:
    """All matching sections with their scores. ``digits`` rounds the scores before anything is ordered by them."""
    # A section's length has had its part in the score; here it would be made again from all tokens.
    return adjusted(bm25(index, query, mode).join(filtered(index.sections.drop("length"), options), "section_id"), digits)


def adjusted(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Rows with lexical_score and what a section shows get the final score, and what they are ordered by."""
    rows = rows.withColumn("score", final_score(F.col("lexical_score"), F.col("kind"), F.col("heading"), F.col("tier")))
    if digits is not None:
        rows = rows.withColumns({c: X.round_to(F.col(c), digits) for c in ("score", "lexical_score")})
    return rows.withColumn("not_wiki", (F.col("kind") != "wiki").cast("int"))


def top(index: Index, query: Query, options: Options, mode: str = "and", digits: int | None = None) -> DataFrame:
    return ranked(index, query, options, mode, digits).orderBy(*ORDER).limit(fetch_size(options.limit))


# On the fetched rows.


def recommends(term: str) -> bool:
    return len(term.encode()) >= 3 and term not in C.SEARCH_STOPWORDS and term not in C.RECOMMENDATION_STOPWORDS


def is_of(row: Row, term: str) -> bool:
    return term in (first_path_word(row["path"]), first_word(row["title"]))


def entities(rows: list[Row], terms: list[str]) -> list[str]:
    """Query terms that begin some result's file name or title."""
    return [t for t in dict.fromkeys(terms) if recommends(t) and any(is_of(r, t) for r in rows)]


def quality(row: Row, term: str) -> int:
    if term in path_words(row["path"]) or term in normalize(row["title"]).split():
        return 4
    if term in row["tags"]:
        return 3
    return 2 if term in normalize(row["heading"]).split() else 0


def rank(row: Row) -> tuple:
    return row["score"], row["lexical_score"], row["path"], row["section_id"]


def rerank(rows: list[Row], terms: list[str]) -> list[Row]:
    """Results about a named entity rise, those about another fall; without entities the order stays."""
    named = entities(rows, terms)
    if not named:
        return rows

    def shift(r: Row) -> float:
        if any(is_of(r, t) for t in named):
            return C.ENTITY_MATCH
        own = first_path_word(r["path"])
        primary = own if own and recommends(own) and (own in r["tags"] or r["kind"] == "source") else ""
        return C.ENTITY_MISMATCH if primary and primary not in named else 0.0

    return sorted((Row(**{**r.asDict(), "score": r["score"] + shift(r)}) for r in rows), key=rank)


def best_path(rows: list[Row], kind: str, term: str, entity: str = "") -> str | None:
    """The path of the best row for a term, among the entity's rows first."""
    for pool in ([r for r in rows if is_of(r, entity)] if entity else [], rows):
        found = [(-quality(r, term), rank(r), r["path"]) for r in pool if r["kind"] == kind and quality(r, term)]
        if found:
            return min(found)[2]
    return None


def read_order(rows: list[Row], kind: str, terms: list[str]) -> list[str]:
    base = list(dict.fromkeys(r["path"] for r in rows if r["kind"] == kind))
    if kind != "wiki" or not base:
        return base[: C.READ_ORDER]
    named = entities(rows, terms)
    picks: list[str | None] = []
    if len(named) > 1:
        picks = [best_path(rows, kind, t) for t in named]
    out = list(dict.fromkeys(p for p in picks if p))[: C.READ_ORDER]
    if out:
        return out
    context = named[0] if len(named) == 1 else ""
    picks = [best_path(rows, kind, t, context) for t in terms if recommends(t) and t not in named]
    return list(dict.fromkeys(p for p in picks if p))[: C.READ_ORDER] or base[: C.READ_ORDER]


def section_quality(row: Row, topics: list[str]) -> int:
    total = 0
    for t in topics:
        if t in normalize(row["heading"]).split():
            total += 12 + (20 if t == topics[-1] else 0)
        elif t in path_words(row["path"]) or t in normalize(row["title"]).split():
            total += 4
        elif t in normalize(row["snippet"] if "snippet" in row else row["body"]):
            total += 1
    return total


def target(row: Row) -> str:
    return f"{row['path']}#{row['anchor']}" if row["anchor"] else row["path"]


def recommended_sections(rows: list[Row], paths: list[str], kind: str, terms: list[str]) -> list[dict]:
    named = entities(rows, terms)
    topics = [t for t in terms if recommends(t) and t not in named]
    out = []
    for p in paths:
        own = [r for r in rows if r["kind"] == kind and r["path"] == p]
        if not own:
            continue
        best = min(own, key=lambda r: (-section_quality(r, topics), rank(r)))
        label = best["heading"] or best["title"]
        about = next((t for t in named if is_of(best, t)), None)
        reason = f"Covers {about[:1].upper()}{about[1:]}: {label}" if about else f"Best matching {kind} section: {label}"
        out.append({"section_id": best["section_id"], "target": target(best), "path": p, "anchor": best["anchor"], "kind": kind, "title": best["title"], "heading": best["heading"], "reason": reason})
    return out


def select(rows: list[Row], first: list[str], limit: int) -> list[Row]:
    """Recommended sections first, then in order; at most ``SECTIONS_PER_DOCUMENT`` of a document."""
    by_id = {r["section_id"]: r for r in rows}
    out, of_document = [], {}
    for i in dict.fromkeys([s for s in first if s in by_id] + [r["section_id"] for r in rows]):
        r = by_id[i]
        if len(out) == limit:
            break
        if of_document.get(r["document_id"], 0) < C.SECTIONS_PER_DOCUMENT:
            of_document[r["document_id"]] = of_document.get(r["document_id"], 0) + 1
            out.append(r)
    return out


def coverage(rows: list[Row], sections: list[dict], terms: list[str]) -> tuple[dict[str, bool], list[str]]:
    ids = {s["section_id"] for s in sections}
    covered = {t: any(is_of(r, t) for r in rows if r["section_id"] in ids) for t in entities(rows, terms)}
    return covered, [t for t, c in covered.items() if not c]


def falls_back(query: Query, options: Options, rows: list[Row]) -> bool:
    """Whether a search for all atoms is to be followed by one for any of them."""
    if len(query.atoms) < 2:
        return False
    if not rows or options.kind == "all" and not any(r["kind"] == "wiki" for r in rows):
        return True
    if options.kind not in ("all", "wiki"):
        return False
    named = entities(rows, query.terms)
    return any(best_path(rows, "wiki", t) is None for t in query.terms if recommends(t) and t not in named)


#: What a search tells its reader.
STOP_NONE = "No indexed content matched. Ask for clearer terms or use INDEX.md/tags.md only if fallback navigation is required; do not scan the repo."
STOP_SOURCE = "Read these source sections/files directly. Do not scan the repo unless they are insufficient."
STOP_WIKI = "Read recommended_sections from the top wiki pages first. Do not scan the repo unless those are insufficient."


def search(index: Index, text: str, options: Options | None = None, digits: int | None = None) -> dict:
    """The whole pipeline; results are in ``results``."""
    query, o = parse(text), (options or Options()).checked()
    mode, found = "and", checkpoint(top(index, query, o, "and", digits))
    rows = found.orderBy(*ORDER).collect()
    if falls_back(query, o, rows):
        mode, found = "or_fallback", checkpoint(top(index, query, o, "or", digits))
        rows = found.orderBy(*ORDER).collect()
    shown = {r["section_id"]: r["snippet"] for r in excerpts(fields_of(found), [fold_tokens(a) for a in query.atoms]).collect()}
    rows = [Row(**r.asDict(), snippet=shown.get(r["section_id"], "")) for r in rows]
    rows = rerank(rows, query.terms)
    kind = "source" if o.kind == "source" or not any(r["kind"] == "wiki" for r in rows) else "wiki"
    paths = read_order(rows, kind, query.terms)
    sections = recommended_sections(rows, paths, kind, query.terms)
    covered, missing = coverage(rows, sections, query.terms)
    return {
        "query": text, "mode": mode, "read_order": paths, "recommended_sections": sections,
        "stop_rule": STOP_NONE if not rows else STOP_SOURCE if kind == "source" else STOP_WIKI,
        "coverage": {"entities": covered, "missing": missing},
        "results": [{k: r[k] for k in ("document_id", "section_id", "path", "kind", "tier", "title", "heading", "anchor", "summary", "snippet", "tags", "sources", "links", "score", "lexical_score")} | {"target": target(r)} for r in select(rows, [s["section_id"] for s in sections], o.limit)],
    }
