"""Markdown as far as a knowledge base needs it: frontmatter, headings, sections, links, citations, and small edits.

Blocks: ATX and setext headings, fenced and indented code, paragraphs, lists and quotes. Inline: code spans, links
(also with reference definitions), images, autolinks. All functions are plain Python over one document's text; the
readers run them in Arrow batches on the executors.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

import regex

ROOTS = ("sources/", "wiki/", "assets/")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*$")
INLINE = re.compile(r"(?P<escape>\\.)|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|(?P<auto><[a-zA-Z][a-zA-Z0-9+.-]*:[^\s<>]*>)|(?P<link>!?\[(?P<label>(?:\\.|[^\[\]\\]|!?\[[^\]]*\](?:\([^)]*\))?)*)\](?:\((?P<dest>\s*(?:<[^>\n]*>|(?:[^\s()]|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*)\)|\[(?P<ref>[^\]]*)\])?)", re.S)
# Fixed value: the form of an inline citation.
CITATION = re.compile(r"\[source:\s*([^\]\r\n]+?)\]", re.I)
LOCAL = ("#", "./", "../", "sources/", "wiki/")


class MarkdownError(ValueError):
    pass


# Anchors, links, labels.


def anchor_for(heading: str) -> str:
    kept = regex.sub(r"[^\p{L}\p{N}_\s-]+", "", heading.strip()).lower()
    return re.sub(r"[\s-]+", "-", kept).strip("-") or "section"


def normalize_anchor(anchor: str) -> str:
    return unquote(anchor.strip().removeprefix("#")).strip()


def is_content(path: str) -> bool:
    return any(path.startswith(r) and len(path) > len(r) for r in ROOTS)


def resolve(from_path: str, destination: str) -> tuple[str, str] | None:
    """(path, anchor) of a local destination, None for external and empty ones. Leaving the roots is an error."""
    d = destination.strip()
    low = d.lower()
    if not d or "://" in low or low.startswith(("mailto:", "tel:", "urn:")):
        return None
    path, mark, fragment = d.partition("#")
    path, fragment = path.partition("?")[0].strip(), normalize_anchor(fragment)
    if not path:
        return (posixpath.normpath(from_path), fragment) if mark and fragment else None
    path = posixpath.normpath(path.replace("\\", "/"))
    if path.startswith("/"):
        raise MarkdownError(f"link {destination!r} is absolute")
    if not is_content(path):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(from_path), path))
    if path == "..":
        raise MarkdownError(f"link {destination!r} leaves the corpus")
    if not is_content(path) or ".." in path.split("/"):
        raise MarkdownError(f"link {destination!r} is outside {', '.join(ROOTS)}")
    return path, fragment


def relative(from_path: str, to_path: str) -> str:
    r = posixpath.relpath(to_path, posixpath.dirname(from_path) or ".")
    return r if r.startswith(".") else f"./{r}"


def title_words(text: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.split(r"[-_\s]+", text) if w)


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


# Blocks.


@dataclass
class Block:
    """kind: heading or paragraph (or text of a tight list item, which isn't a paragraph)."""

    kind: str
    text: str
    level: int = 0
    first: int = 0
    last: int = 0


def blocks(body: str) -> tuple[list[Block], dict[str, str]]:
    """The blocks with the numbers of their lines, and the link definitions."""
    out: list[Block] = []
    definitions: dict[str, str] = {}
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    para: list[str] = []
    start, fence, in_item, tight = 0, "", False, False

    def end(at: int) -> None:
        nonlocal para
        text = "\n".join(para).strip()
        if text:
            out.append(Block("item" if tight else "paragraph", text, 0, start, at))
        para = []

    for n, raw in enumerate(lines):
        line = re.sub(r"^(?: {0,3}> ?)+", "", raw)
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                fence = ""
            continue
        f = FENCE.match(line)
        if f and not (f.group(1)[0] == "`" and "`" in f.group(2)):
            end(n - 1)
            fence = f.group(1)
            continue
        if not line.strip():
            end(n - 1)
            tight = False
            continue
        item = ITEM.match(line)
        if not para and not in_item and re.match(r"^(?: {4}|\t)", line):
            continue
        h = ATX.match(line)
        if h:
            end(n - 1)
            in_item = tight = False
            out.append(Block("heading", (h.group(2) or "").strip(), len(h.group(1)), n, n))
            continue
        s = SETEXT.match(line)
        if s and para and not tight:
            text = "\n".join(para).strip()
            para = []
            out.append(Block("heading", text, 1 if s.group(1)[0] == "=" else 2, start, n))
            continue
        if re.match(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", line):
            end(n - 1)
            continue
        d = DEFINITION.match(line)
        if d and not para:
            definitions.setdefault(" ".join(d.group(1).lower().split()), d.group(2))
            continue
        if item:
            end(n - 1)
            in_item = tight = True
            start, line = n, line[item.end() :]
        elif not re.match(r"^\s", line) and not para:
            in_item = tight = False
        if not para:
            start = n
        para.append(line.strip())
    end(len(lines) - 1)
    return out, definitions


def inline(text: str, definitions: dict[str, str]) -> tuple[str, str, list[str]]:
    """(plain text, text for citations with links and code cut out by newlines, destinations of links)."""
    plain, cited, links = [], [], []
    at = 0
    for m in INLINE.finditer(text):
        plain.append(text[at : m.start()])
        cited.append(text[at : m.start()])
        at = m.end()
        if m.group("escape"):
            plain.append(m.group("escape")[1:])
            cited.append(m.group("escape")[1:])
        elif m.group("ticks"):
            plain.append(" ".join(m.group("code").split("\n")).strip())
            cited.append("\n")
        elif m.group("auto"):
            plain.append(m.group("auto")[1:-1])
            cited.append(m.group("auto"))
        else:
            label, dest = m.group("label"), m.group("dest")
            if dest is not None:
                dest = re.sub(r"\s+(?:\"[^\"]*\"|'[^']*')\s*$", "", dest.strip()).strip("<>")
            else:
                key = " ".join((m.group("ref") or label).lower().split())
                dest = definitions.get(key)
            if dest is None:
                plain.append(m.group("link"))
                cited.append(m.group("link"))
                continue
            inner = inline(label, definitions)
            plain.append(inner[0])
            if m.group("link").startswith("!"):
                cited.append(inner[1])
            else:
                cited.append("\n")
                links.append(dest)
    plain.append(text[at:])
    cited.append(text[at:])
    bare = re.sub(r"(\*{1,3}|_{1,3}(?=\w)|(?<=\w)_{1,3}(?!\w)|~~)", "", "".join(plain))
    return bare, "".join(cited), links


# Sections and analysis.


@dataclass
class Section:
    ordinal: int
    heading: str | None
    anchor: str | None
    level: int | None
    body: str


@dataclass
class Analysis:
    first_h1: str = ""
    headings: list[tuple[int, str, str]] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    link_refs: list[tuple[str, str]] = field(default_factory=list)
    source_refs: list[tuple[str, str]] = field(default_factory=list)
    citations: list[tuple[str, str]] = field(default_factory=list)
    has_sources: bool = False

    @property
    def anchors(self) -> list[str]:
        return sorted({h[2] for h in self.headings})


def unique_anchor(heading: str, counts: dict[str, int]) -> str:
    base = anchor_for(heading)
    n = counts.get(base, 0)
    counts[base] = n + 1
    return f"{base}-{n}" if n else base


def sections(body: str) -> list[Section]:
    """Text before the first heading, if any, and one section for each heading; the whole body where there is none."""
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    found, definitions = blocks(body)
    counts: dict[str, int] = {}
    heads = []
    for b in found:
        if b.kind == "heading":
            text = inline(b.text, definitions)[0].strip()
            mark = unique_anchor(text, counts)
            if text:
                heads.append((b, text, mark))
    out: list[Section] = []
    before = "\n".join(lines[: heads[0][0].first] if heads else lines).strip("\n").strip()
    if before or not heads:
        out.append(Section(1, None, None, None, before))
    for k, (b, text, mark) in enumerate(heads):
        until = heads[k + 1][0].first if k + 1 < len(heads) else len(lines)
        out.append(Section(len(out) + 1, text, mark, b.level, "\n".join(lines[b.last + 1 : until]).strip()))
    return out


def analyze(path: str, body: str) -> Analysis:
    a, counts, in_sources = Analysis(), {}, False
    found, definitions = blocks(body)
    for b in found:
        plain, cited, links = inline(b.text, definitions)
        if b.kind == "heading":
            text = plain.strip()
            mark = unique_anchor(text, counts)
            a.headings.append((b.level, text, mark))
            if b.level == 1 and not a.first_h1:
                a.first_h1 = text
            if b.level <= 2:
                in_sources = b.level == 2 and text.lower() == "sources"
                a.has_sources |= in_sources
        for d in links:
            ref = resolve(path, d)
            if ref is None:
                continue
            if in_sources:
                a.source_refs.append(ref)
                a.sources.append(ref[0])
            else:
                a.link_refs.append(ref)
                if not (ref[1] and ref[0] == posixpath.normpath(path)):
                    a.links.append(ref[0])
        if b.kind == "paragraph" and not in_sources:
            for m in CITATION.finditer(cited):
                d = m.group(1).strip()
                if cited[m.end() : m.end() + 1] == "(" or not d.startswith(LOCAL):
                    continue
                ref = resolve(path, d)
                if ref is None:
                    raise MarkdownError(f"citation {d!r} is not local")
                a.citations.append(ref)
    for name in ("links", "sources", "link_refs", "source_refs", "citations"):
        setattr(a, name, sorted(set(getattr(a, name))))
    return a


# Frontmatter.

TAG = re.compile(r"^[a-z0-9][a-z0-9-]{0,62}$")
DOC_ID = re.compile(r"^doc_[0-9a-f]{32}$")
DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
SCHEMA = "document-v1"


@dataclass
class Front:
    """space: the name of the mapping that holds id, schema, kind, modified_date, sources and links."""

    title: str = ""
    summary: str = ""
    tags: list[str] = field(default_factory=list)
    space: str = "corpus"
    id: str = ""
    schema: str = SCHEMA
    kind: str = "wiki"
    modified_date: str = ""
    sources: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)


def split_front(content: str) -> tuple[Front | None, str]:
    """Frontmatter and body. The mapping with a ``schema`` may have any name."""
    import yaml

    text = content.removeprefix("﻿")
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return None, content
    stop = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if stop is None:
        raise MarkdownError("frontmatter has no end")
    try:
        raw = yaml.load("\n".join(lines[1:stop]), Loader=yaml.BaseLoader) or {}  # noqa: S506  strings only
    except yaml.YAMLError as e:
        raise MarkdownError(f"frontmatter is malformed: {e}") from e
    rest = lines[stop + 1 :]
    body = "\n".join(rest[1:] if rest and rest[0].strip("\r") == "" else rest)
    space = next((k for k, v in raw.items() if isinstance(v, dict) and "schema" in v), "")
    own = raw.get(space) or {}
    listed = lambda v: [str(x) for x in v or []]
    return Front(raw.get("title", ""), raw.get("summary", ""), listed(raw.get("tags")), space, own.get("id", ""), own.get("schema", ""), own.get("kind", ""), own.get("modified_date", ""), listed(own.get("sources")), listed(own.get("links"))), body


def front_faults(f: Front | None, missing_id: bool = False) -> list[str]:
    """Everything that is wrong with a frontmatter."""
    if f is None:
        return ["frontmatter is missing"]
    tags = sorted({t.strip() for t in f.tags} - {""})
    faults = [
        (not f.title.strip(), "title is required"),
        (not f.id.strip() and not missing_id, "id is required"),
        (bool(f.id.strip()) and not DOC_ID.match(f.id.strip()), "id must be doc_ and 32 hexadecimal digits"),
        (f.schema != SCHEMA, f"schema must be {SCHEMA}"),
        (bool(f.modified_date.strip()) and not valid_date(f.modified_date.strip()), "modified_date must be YYYY-MM-DD"),
        (f.kind not in ("source", "wiki"), "kind must be source or wiki"),
    ]
    if f.kind == "wiki":
        faults += [(not f.summary.strip(), "summary is required"), (bool(re.search("[\r\n]", f.summary.strip())), "summary must be one line"), (not tags, "tags are required"), (len(tags) > 5, "more than 5 tags"), (any(not TAG.match(t) for t in tags), "a tag is not a lower-case slug")]
    return [what for bad, what in faults if bad]


#: The fault of a page from before pages had dates.
DATELESS = "modified_date is required"


def valid_date(text: str) -> bool:
    from datetime import date

    try:
        return bool(DATE.match(text)) and bool(date.fromisoformat(text))
    except ValueError:
        return False


def join_front(f: Front, body: str) -> str:
    import yaml

    doc = {"title": f.title, "summary": f.summary, "tags": f.tags, f.space: {"id": f.id, "schema": f.schema, "kind": f.kind, "modified_date": f.modified_date, "sources": f.sources, "links": f.links}}
    return f"---\n{yaml.safe_dump(doc, sort_keys=False, allow_unicode=True, width=10**6)}---\n\n{body}"


# Edits.


def without_sources(body: str) -> str:
    """The body without its ``## Sources`` section."""
    lines = body.split("\n")
    found, definitions = blocks(body)
    out, skip, at = [], False, 0
    for b in [x for x in found if x.kind == "heading" and x.level <= 2]:
        if not skip:
            out += lines[at : b.first]
        skip = b.level == 2 and inline(b.text, definitions)[0].strip().lower() == "sources"
        at = b.first
    if not skip:
        out += lines[at:]
    return "\n".join(out).rstrip() + "\n"


def with_sources(body: str, path: str, sources: list[str]) -> str:
    """The body with a fresh ``## Sources`` section."""
    rows = [f"- [{title_words(stem(s))}]({relative(path, s)})" for s in sorted(set(sources))]
    return f"{without_sources(body).rstrip()}\n\n## Sources\n\n" + "\n".join(rows) + "\n"


def append_to_section(body: str, heading: str, text: str) -> str:
    """Text at the end of a section; a new second-level section where there is none."""
    lines = body.rstrip("\n").split("\n")
    found, definitions = blocks(body)
    heads = [b for b in found if b.kind == "heading"]
    for k, b in enumerate(heads):
        if inline(b.text, definitions)[0].strip().lower() == heading.strip().lower():
            stop = next((h.first for h in heads[k + 1 :] if h.level <= b.level), len(lines))
            return "\n".join([*"\n".join(lines[:stop]).rstrip().split("\n"), "", text.strip(), "", *lines[stop:]]).rstrip() + "\n"
    return f"{body.rstrip()}\n\n## {heading.strip()}\n\n{text.strip()}\n"


def collapse_spaces(body: str) -> str:
    return "\n".join(re.sub(r"  +", " ", x).rstrip(" ") for x in body.split("\n"))


def _forms(from_path: str, to_path: str) -> str:
    return "(?:" + "|".join(re.escape(x) for x in (relative(from_path, to_path), to_path)) + ")"


def strip_citations(body: str, from_path: str, source: str) -> str:
    return collapse_spaces(re.sub(rf"\[source:\s*{_forms(from_path, source)}(?:#[^\]]*?)?\]", "", body, flags=re.I))


def unwrap_links(body: str, from_path: str, page: str) -> str:
    return re.sub(rf"\[([^\]]*)\]\({_forms(from_path, page)}(?:#[^)]*)?\)", r"\1", body)


def strip_asset(body: str, from_path: str, asset: str) -> str:
    return collapse_spaces(re.sub(rf"!?\[[^\]]*\]\({_forms(from_path, asset)}(?:#[^)]*)?\.?\)", "", body))


def source_title(path: str, text: str) -> str:
    """A source's first heading of level 1, else its first heading, else its file's name in words."""
    parts = sections(text)
    top = next((s for s in parts if s.level == 1), next((s for s in parts if s.heading), None))
    return top.heading if top else title_words(stem(path))
