"""Health candidates, search results and the state of an index as JSON and as lines to read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .health import sort_key


def as_json(candidates: DataFrame) -> DataFrame:
    """place and one JSON object for each candidate; a reason without a value has none, lists are never null."""
    reasons = F.transform("reasons", lambda r: F.struct(r["code"].alias("code"), F.nullif(r["value"], F.lit("")).alias("value")))
    body = F.struct("type", "confidence", "score", "pages", "sources", reasons.alias("reasons"), F.col("queries").alias("suggested_queries"), F.col("instruction").alias("review_instruction"))
    # Candidates are fifty at most: one task numbers them.
    return candidates.select(F.row_number().over(Window.orderBy(*sort_key())).alias("place"), F.to_json(body).alias("json"))


def as_lines(candidates: DataFrame) -> DataFrame:
    """place and a line for each candidate."""
    where = F.array_join(F.concat("pages", "sources"), ", ")
    why = F.array_join(F.transform("reasons", lambda r: F.when(r["value"] == "", r["code"]).otherwise(F.concat(r["code"], F.lit(": "), r["value"]))), "; ")
    place = F.row_number().over(Window.orderBy(*sort_key()))
    return candidates.select(place.alias("place"), F.format_string("%d. %s (%s, %.3f) %s - %s", place, "type", "confidence", "score", where, why).alias("line"))


# What a search tells a program that reads it.
INSTRUCTIONS = {"read_first": "recommended_sections", "do_not": ["scan_repo"], "fallback": "ask_for_clearer_terms_or_use_index_tags_only"}


def search_json(found: dict) -> str:
    """A search's result as one JSON object: lists are never null, an empty anchor, heading or summary is left out."""
    some = lambda row, *names: {n: row[n] for n in names if row[n] or n not in ("anchor", "heading", "summary")}
    sections = [some(s, "section_id", "target", "path", "anchor", "kind", "title", "heading", "reason") for s in found["recommended_sections"]]
    rows = [{"id": r["document_id"], **some(r, "section_id", "path", "anchor", "kind", "tier", "title", "heading", "summary"), "tags": list(r["tags"] or []), "score": r["score"], "snippet": r["snippet"], "sources": list(r["sources"] or []), "links": list(r["links"] or [])} for r in found["results"]]
    body = {"query": found["query"], "query_mode": found["mode"], "recommended_sections": sections, "agent_instructions": INSTRUCTIONS, "coverage": {**found["coverage"]["entities"], "missing": found["coverage"]["missing"]}, "results": rows, "recommended_read_order": found["read_order"], "stop_rule": found["stop_rule"]}
    return json.dumps(body, ensure_ascii=False, indent=2)


def search_lines(found: dict) -> list[str]:
    """A search's result to read: what to read first, then the results."""
    out = [f"query: {found['query']} ({found['mode']})", *[f"read {i}. {s['target']} - {s['reason']}" for i, s in enumerate(found["recommended_sections"], 1)]]
    out += [f"{i}. {r['target']} ({r['kind']}, {r['score']:.3f}) {r['title']}" + (f" - {r['snippet']}" if r["snippet"] else "") for i, r in enumerate(found["results"], 1)]
    return [*out, found["stop_rule"]]


def status_lines(path: str, stored: dict | None, current: dict, state: str, why: str) -> list[str]:
    """The state of an index: what it records, what its corpus asks for, and why it isn't fresh."""
    has = stored or {}
    out = [f"status: {state}", f"index: {path}", f"exists: {str(bool(stored)).lower()}", f"schema_version: {has.get('schema_version', 0)}", f"expected_schema_version: {current['schema_version']}"]
    out += [f"{label}: {x['manifest_hash']}" for label, x in (("manifest_hash", has), ("expected_manifest_hash", current)) if x.get("manifest_hash")]
    return out + ([f"reason: {why}"] if why else [])
