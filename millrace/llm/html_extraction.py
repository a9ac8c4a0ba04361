"""Main text of web pages by union-free regular-expression inference (operator 6).

Pages of one host are token streams of tags and texts. A stream's adjacent repeats are folded into repeated
groups, of any length and depth; the folded streams of a host are then aligned one by one with the wrapper so far.
Texts that differ become text slots, tags that one side lacks become optional groups, and a run that the other side
holds as a group joins it. The result is one expression of tags, fixed texts, slots, ``(...)?`` and ``(...)+`` for
each host, without alternatives.

What is main text. The wrapper decides for all pages of its host, by what its slots have held: a text that is the
same on all pages that have it, on half of the host's pages and on ``ENOUGH`` of different content at least, is
template, wherever it stands, unless another text of its block isn't, or it is a heading or caption in the region and
its box has varying text too. Of the other texts, those of the densest region are main: the smallest box
that holds ``DENSE`` of the host's varying text, links not counted; an article or main element is
taken for it if it holds ``SOME`` of that text. Inside it go navigation, headers, footers, asides, forms and the like,
boxes whose class, id or role names nothing but such things, unless they hold most of the varying text, and what is
marked as readers' comments, however long it is.
A page is read by aligning its stream with its host's wrapper. Hosts with fewer pages of different content have no
evidence: there each page is decided by its own texts in the same way, and nothing is template.

Text. Character references are decoded; white space inside a block becomes one space; blocks are trimmed and
joined in page order by one space. Comments, scripts, styles, forms and what a truncated page cuts off in the
middle of a tag give nothing.

Semantics. Null and empty html give an empty text and 0 characters. Pages without a host (null or odd urls) form
one host. Repeated pages, and pages with the same longest text, count once as evidence; each has its row. Results
depend on the pages of the host alone, not on how these are dealt to tasks. Very long pages are read whole.
Extra columns are ignored, whatever their names; an empty table gives no rows.

Scale. Only distinct folded streams of a host are gathered, with counts, and merged in a tree of groups of about
``FAN``, so a host with a third of all pages is spread over many tasks. Wrappers with their decisions are broadcast
where they are at most ``BROADCAST`` bytes, so pages aren't shuffled; else they meet the pages in a join on the host
that splits skewed keys.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ship, small_batches, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^<>]*\Z|[^<]+|<", re.S)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements without main text.
OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", *RAW}
#: Words of classes, ids and roles for things without main text, and words that say nothing either way.
OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "legal", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "reply", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Those of them that name what readers say: such a box stays out however long it is.
TALK_WORDS = {"comment", "comments", "disqus", "reply", "respond"}
PLAIN_WORDS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "posts", "primary", "right", "section", "secondary", "site", "text", "top", "wrap", "wrapper"}
MAIN, MAIN_MARKS = {"article", "main"}, {"article", "main", "article-body", "articlebody", "article-content", "post-content", "post-body", "entry-content", "main-content", "maincontent"}
#: Elements whose fixed text belongs to the varying text that stands beside it in the same box.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "caption", "figcaption", "dt", "th"}
#: Elements that can be the region of the main text.
BOXES = {"html", "body", "div", "section", "main", "article", "center", "table", "tbody", "tr", "td"}
#: Shares of the varying text that make a box the region, and an article or main element.
DENSE, SOME = 0.7, 0.1
#: Pages of different content from which on texts can be template.
ENOUGH = 3
#: Streams that are merged in one group, about, and distinct streams that a task holds before it sends them.
FAN, HELD = 16, 20_000
#: Bytes of all wrappers up to which they are broadcast.
BROADCAST = 32 << 20
#: Cells of an alignment's table that are held at once, a bit each.
CELLS = 1 << 28


def out_mark(marks: str) -> str:
    """``.out`` where a class, id or role names nothing but things without main text, ``.talk`` where that is what readers say."""
    found = ""
    for name in marks.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not OUT_WORDS.isdisjoint(words) and all(w in OUT_WORDS or w in PLAIN_WORDS for w in words):
            if not TALK_WORDS.isdisjoint(words):
                return ".talk"
            found = ".out"
    return found


def tokens_of(page: str | None) -> list[tuple[str, str]]:
    """(symbol, text): symbols are <name, <name.mark (a mark that matters), </name, # (a text) and / (a block's edge)."""
    out: list[tuple[str, str]] = []
    skip = None
    for m in TOKEN.finditer(page or ""):
        s = m.group(0)
        name = m.group(2) or m.group(5)
        if skip:
            if name and (m.group(1) or m.group(4)) and name.lower() == skip:
                skip = None
            continue
        if name is None:
            if s[0] != "<" or s == "<":
                if s.strip():
                    out.append(("#", s))
                elif out and out[-1][0] == "#":
                    out[-1] = ("#", out[-1][1] + s)
                else:
                    out.append(("~", s))
            continue
        name = name.lower()
        if m.group(1) or m.group(4):
            out.append((f"</{name}", ""))
            continue
        if name in RAW and not s.endswith("/>"):
            skip = name
            continue
        marks = " ".join("".join(g) for g in MARKS.findall(m.group(3) or m.group(6) or "")).lower()
        mark = "" if not marks else ".main" if not MAIN_MARKS.isdisjoint(marks.split()) else out_mark(marks)
        out.append((f"<{name}{mark}", ""))
    return out


# Folding and alignment. A node is a symbol or a pair of "+" or "?" and a list of nodes.


class Letters(dict):
    """A letter for each symbol of a page, so that repeats can be found in a string."""

    def __missing__(self, symbol: str) -> str:
        n = 0x100 + len(self)
        self[symbol] = c = chr(n if n < 0xD800 else n + 0x800)
        return c


#: Short repeats are found by regular expressions, one for each width, longer ones by comparing the string with itself.
SHORT = 24
REPEAT = [re.compile(r"(.{%d})\1+" % k, re.S) for k in range(1, SHORT + 1)]


def repeats(code: str, k: int) -> list[tuple[int, int]]:
    """(start, end) of the adjacent repeats of k letters."""
    if k <= SHORT:
        return [m.span() for m in REPEAT[k - 1].finditer(code)]
    x, at, out = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0, []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-k] == x[k:]).view(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if (a := max(a, at)) + k <= b:
            out.append((a, at := a + (b - a + k) // k * k))
    return out


def closed(symbols: list[str]) -> bool:
    """Whether all end tags end something that begins here: then a repeat of these stays at its place in the tree."""
    open_: list[str] = []
    for s in symbols:
        if s.startswith("</"):
            if s[2:] not in open_:
                return False
            del open_[open_.index(s[2:]) :]
        elif s[0] == "<":
            open_.append(s[1:].split(".")[0])
    return True


def fold_once(nodes: list, spans: list[tuple[int, int]], k: int) -> tuple[list, list[int]]:
    """Nodes with the repeats of k of them at ``spans`` as groups, and for each old leaf the number of its new one."""
    sizes = [1 if isinstance(x, str) else len(leaves(x[1])) for x in nodes]
    out: list = []
    moved: list[int] = []
    at = n = 0

    def plain(a: int, b: int) -> None:
        nonlocal n
        width = sum(sizes[a:b])
        out.extend(nodes[a:b])
        moved.extend(range(n, n + width))
        n += width

    for a, b in spans:
        plain(at, a)
        width = sum(sizes[a : a + k])
        # A group that repeats is the group itself.
        out.append(nodes[a] if k == 1 and not isinstance(nodes[a], str) else ["+", nodes[a : a + k]])
        moved.extend(n + i % width for i in range(sum(sizes[a:b])))
        n, at = n + width, b
    plain(at, len(nodes))
    return out, moved


def fold(symbols: list[str], letters: Letters | None = None) -> tuple[list, list[int]]:
    """Nodes, and for each symbol the number of its leaf. The narrowest repeats go first, so repeats of repeats are folded too, until there are none."""
    letters = Letters() if letters is None else letters
    nodes: list = list(symbols)
    leaf = list(range(len(symbols)))
    k = 1
    code = "".join(map(letters.__getitem__, nodes))
    while 2 * k <= len(nodes):
        spans = [(a, b) for a, b in repeats(code, k) if closed(leaves(nodes[a : a + k]))]
        if not spans:
            k += 1
            continue
        nodes, moved = fold_once(nodes, spans, k)
        leaf = [moved[x] for x in leaf]
        code, k = "".join(letters[x if isinstance(x, str) else json.dumps(x)] for x in nodes), 1
    return nodes, leaf


def leaves(nodes: list) -> list[str]:
    out: list[str] = []
    for x in nodes:
        if isinstance(x, str):
            out.append(x)
        else:
            out += leaves(x[1])
    return out


def kind(x) -> str:
    if isinstance(x, str):
        return "#" if x[0] == "#" else x
    return x[0] + next(iter(leaves(x[1])), "")


def table_rows(x: list[str], y: list[str]) -> list[int]:
    """A row of bits for each symbol of x: bit j is 0 where y[: j + 1] has a longer common subsequence than y[:j]."""
    at: dict[str, int] = {}
    for j, s in enumerate(y):
        at[s] = at.get(s, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, out = full, []
    for s in x:
        u = v & at.get(s, 0)
        v = (v + u | v - u) & full
        out.append(v)
    return out


def lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each beginning of y."""
    v = table_rows(x, y)[-1] if x else (1 << len(y)) - 1
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def subsequence(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. The table is halved where it would be too large."""
    if not x or not y:
        return []
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]))
        return subsequence(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in subsequence(x[half:], y[cut:])]
    # From the ends, so that the first symbols are met first on the way back.
    rows = table_rows(x[::-1], y[::-1])
    out, i, j, n, m = [], 0, 0, len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[n - 1 - i] >> (m - 1 - j) & 1:
            j += 1
        else:
            i += 1
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, the common ends first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inside = subsequence(a[head : len(a) - tail], b[head : len(b) - tail])
    return [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in inside] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def held(x: str) -> tuple[str, int, int, list[int]]:
    """What a text leaf "#hash;letters;pages;contents" has held: the hash (none: a slot), letters, pages, the least hashes of their contents."""
    text, *more = x.split(";")
    return text, int(more[0]) if more else 0, int(more[1]) if more else 0, [int(p) for p in more[2].split(",")] if more else []


def named_leaf(text: str, letters: int, pages: int, contents: list[int]) -> str:
    return f"{text};{letters};{pages};{','.join(map(str, contents))}" if pages else text


def common(x: str, y: str) -> str:
    """The text leaf of both: fixed if they are the same text, else a slot."""
    if x[0] != "#":
        return x
    (tx, lx, nx, cx), (ty, ly, ny, cy) = held(x), held(y)
    return named_leaf(tx if tx == ty else "#", lx + ly, nx + ny, least(cx, cy))


def within(x: str, y: str) -> str:
    """The text leaf of two places of one page, or of pages that are counted already."""
    (tx, lx, nx, cx), (ty, ly, ny, cy) = held(x), held(y)
    return named_leaf(tx if tx == ty else "#", lx + ly, max(nx, ny), least(cx, cy)) if x[0] == "#" else x


def gathered(nodes: list, groups: list) -> list:
    """Runs of nodes that the other side holds as a repeated group become that group."""
    for g in groups:
        want = [kind(x) for x in g[1]]
        if not all(isinstance(x, str) for x in g[1]):
            continue
        out, i, k = [], 0, len(want)
        while i < len(nodes):
            j, seen = i, []
            while j + k <= len(nodes) and all(isinstance(x, str) for x in nodes[j : j + k]) and [kind(x) for x in nodes[j : j + k]] == want:
                j, seen = j + k, [within(x, y) for x, y in zip(seen, nodes[j : j + k], strict=True)] if j > i else nodes[j : j + k]
            if j > i:
                out.append(["+", seen])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def merge(a: list, b: list) -> list:
    """The union-free expression of both."""
    ga, gb = [x for x in a if not isinstance(x, str) and x[0] == "+"], [x for x in b if not isinstance(x, str) and x[0] == "+"]
    a, b = gathered(a, gb), gathered(b, ga)
    # An optional group of one side is met by its own first symbol on the other side.
    out: list = []
    i = j = 0

    def lack(run: list) -> None:
        for x in run:
            if not isinstance(x, str) and x[0] == "?":
                out.append(x)
            elif out and isinstance(out[-1], list) and out[-1][0] == "?" and len(out[-1]) == 3:
                out[-1][1].append(x)
            else:
                out.append(["?", [x], 0])

    def bare(nodes: list) -> tuple[list, list[bool]]:
        flat, optional = [], []
        for x in nodes:
            inner = x[1] if not isinstance(x, str) and x[0] == "?" else [x]
            flat += inner
            optional += [inner is not x and not isinstance(x, str) and x[0] == "?"] * len(inner)
        return flat, optional

    (fa, oa), (fb, ob) = bare(a), bare(b)
    for p, q in [*aligned([kind(x) for x in fa], [kind(x) for x in fb]), (len(fa), len(fb))]:
        lack(fa[i:p])
        if out and isinstance(out[-1], list):
            del out[-1][2:]
        lack(fb[j:q])
        if out and isinstance(out[-1], list):
            del out[-1][2:]
        if p < len(fa):
            x, y = fa[p], fb[q]
            both = common(x, y) if isinstance(x, str) else [x[0], merge(x[1], y[1])]
            out.append(["?", [both]] if oa[p] or ob[q] else both)
        i, j = p + 1, q + 1
    return out


# Marking.


def flat(nodes: list, repeated: bool = False) -> list[tuple[str, bool]]:
    """Leaves, and whether they stand in a repeated group."""
    out: list[tuple[str, bool]] = []
    for x in nodes:
        out += [(x, repeated)] if isinstance(x, str) else flat(x[1], repeated or x[0] == "+")
    return out


def boxes(symbols: list[tuple[str, bool]]) -> tuple[list[tuple[str, str, bool, int]], list[tuple[int, ...]]]:
    """The elements (name, mark, whether in a repeated group, leaf), and for each text leaf the elements around it."""
    opened: list[tuple[str, str, bool, int]] = []
    stack: list[int] = []
    paths: list[tuple[int, ...]] = []
    for i, (s, repeated) in enumerate(symbols):
        paths.append(tuple(stack) if s[0] in "#~" else ())
        if s[0] in "#~":
            continue
        if s.startswith("</"):
            at = next((k for k in range(len(stack) - 1, -1, -1) if opened[stack[k]][0] == s[2:]), None)
            if at is not None:
                del stack[at:]
            continue
        name, _, mark = s[1:].partition(".")
        if name not in VOID:
            opened.append((name, mark, repeated, i))
            stack.append(len(opened) - 1)
    return opened, paths


def barred(opened: list, path: tuple[int, ...]) -> bool:
    """Whether an element without main text stands around, or what readers say; the header of an article is its own."""
    if any(opened[k][1] == "talk" and opened[k][0] not in {"html", "body", *MAIN} for k in path):
        return True
    return any(opened[k][0] in OUT and not (opened[k][0] == "header" and any(opened[j][0] in MAIN or opened[j][1] == "main" for j in path[:i])) for i, k in enumerate(path))


def decide(symbols: list[tuple[str, bool]], letters: list[int], template: list[bool], sure: bool) -> tuple[list[bool], set[int]]:
    """For each leaf whether it is main text, and the leaves that open the region (none: all of the page).

    letters: what text leaves have held; sure: the letters are a host's, not one page's.
    """
    opened, paths = boxes(symbols)
    text = [s[0] == "#" and not t for (s, _), t in zip(symbols, template, strict=True)]
    # Boxes that a mark rules out count again where they hold most of the text.
    weight = [n if ok and not barred(opened, p) and not any(opened[k][0] == "a" for k in p) else 0 for n, ok, p in zip(letters, text, paths, strict=True)]
    inside = [0] * len(opened)
    for w, p in zip(weight, paths, strict=True):
        for k in p:
            inside[k] += w
    ruled = {k for k, (_, mark, _, _) in enumerate(opened) if mark == "out" and 2 * inside[k] <= sum(weight)}
    gone = [barred(opened, p) or not ruled.isdisjoint(p) for p in paths]
    inside, total = [0] * len(opened), 0
    for w, p, g in zip(weight, paths, gone, strict=True):
        if not g:
            total += w
            for k in p:
                inside[k] += w
    region: set[int] = set()
    # An article, else a main element, else what is marked so.
    for ok in (lambda k: opened[k][0] == "article", lambda k: opened[k][0] == "main", lambda k: opened[k][1] == "main"):
        found = [k for k in range(len(opened)) if ok(k) and k not in ruled]
        if found and (not sure or sum(sorted(inside[k] for k in found)[-1:]) >= SOME * total):
            region = {k for k in found if not sure or 10 * inside[k] >= max(inside[j] for j in found)}
            break
    title: set[int] = set()
    if not region and total:
        box: tuple[int, ...] = ()
        while True:
            # All boxes of this depth that hold enough: one at most, as DENSE is over one half.
            next_ = next((p[: len(box) + 1] for p, w in zip(paths, weight, strict=True) if w and len(p) > len(box) and p[: len(box)] == box and inside[p[len(box)]] >= DENSE * total and opened[p[len(box)]][0] in BOXES and not opened[p[len(box)]][2]), None)
            if next_ is None:
                break
            box = next_
        if box:
            region = {box[-1]}
            # The heading may stand before its text's box.
            first = next(i for i, p in enumerate(paths) if box[-1] in p)
            title = {i for i in range(first) if any(opened[k][0] == "h1" for k in paths[i])}
    keep = [s[0] in "#~" and not t and not g and (not region or i in title or not region.isdisjoint(p)) for i, ((s, _), t, g, p) in enumerate(zip(symbols, template, gone, paths, strict=True))]
    return keep, {opened[k][3] for k in region}


def read(tokens: list[tuple[str, str]], keep: list[bool]) -> str:
    out: list[str] = []
    for (s, text), k in zip(tokens, keep, strict=True):
        if s[0] in "#~":
            if k:
                out.append(text)
        elif s.lstrip("</").split(".")[0] not in INLINE:
            out.append("\n")
    return " ".join(html.unescape("".join(out)).split())


STREAMS = "host string, stream string, texts array<long>, letters array<long>, n long, pages array<long>"


def content_hash(tokens: list[tuple[str, str]]) -> int:
    """Known by its longest text: pages that agree in it are copies."""
    longest = max((t for s, t in tokens if s == "#"), key=lambda t: (len(t), t), default="")
    return int.from_bytes(hashlib.blake2b(longest.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def least(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[:ENOUGH]


def same(a: list, b: list) -> list:
    return [x if x == y else None for x, y in zip(a, b, strict=True)]


def sums(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


class Streams(dict):
    """(host, stream) to what its texts have held: texts (hash of each leaf that has the same texts on all its pages, else null), letters, pages, contents."""

    def add(self, host: str, stream: str, texts: list, letters: list[int], n: int, pages: list[int]) -> None:
        old = self.get((host, stream))
        self[host, stream] = (texts, letters, n, pages) if old is None else (same(old[0], texts), sums(old[1], letters), old[2] + n, least(old[3], pages))

    def batch(self) -> pa.RecordBatch:
        rows = list(self.values())
        many = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in self], pa.string()), pa.array([k[1] for k in self], pa.string()), pa.array([r[0] for r in rows], many), pa.array([r[1] for r in rows], many), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], many)], names=["host", "stream", "texts", "letters", "n", "pages"])


def distinct_streams(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """The distinct folded streams of each task."""
    small_batches(pages.sparkSession)
    ship(pages.sparkSession)

    def run(batches):
        have = Streams()
        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = tokens_of(page)
                nodes, leaf = fold([s for s, _ in tokens])
                size = leaf[-1] + 1 if leaf else 0
                texts, letters = [0] * size, [0] * size
                for (s, t), n in zip(tokens, leaf, strict=True):
                    if s == "#":
                        # In a repeated group the whole run of texts is what may be fixed.
                        texts[n] = zlib.crc32(b"\n" + t.strip().encode("utf-8", "replace"), texts[n]) | 1 << 32
                        letters[n] += len(t.strip())
                have.add(h, json.dumps(nodes, ensure_ascii=False), texts, letters, 1, [content_hash(tokens)])
            if len(have) > HELD:
                yield have.batch()
                have.clear()
        if have:
            yield have.batch()

    return pages.select(F.col(host), F.col(html_col).cast("string")).mapInArrow(run, STREAMS)


def named(nodes: list, texts: list, letters: list[int], n: int, pages: list[int], at: list[int]) -> list:
    """Nodes whose text leaves carry what they have held."""
    out: list = []
    for x in nodes:
        if isinstance(x, str):
            k = at[0]
            out.append(named_leaf(f"#{texts[k]}" if texts[k] else "#", letters[k], n, pages) if x == "#" else x)
            at[0] += 1
        else:
            out.append([x[0], named(x[1], texts, letters, n, pages, at)])
    return out


def union_of(parts: list[str]) -> list:
    """The wrapper of all, the shortest first."""
    nodes: list = []
    for k, part in enumerate(sorted(parts, key=lambda x: (len(x), x))):
        nodes = merge(nodes, json.loads(part)) if k else json.loads(part)
    return nodes


def wrappers(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """host, wrapper (JSON), n (pages), pages (least hashes of different contents)."""
    out = "host string, piece long, wrapper string, n long, pages array<long>"

    def row(t: pa.Table, parts: list[str], n: int, contents: list[int]) -> pa.Table:
        return pa.table({"host": pa.array([t.column("host")[0].as_py()], pa.string()), "piece": pa.array([t.column("piece")[0].as_py()], pa.int64()), "wrapper": pa.array([json.dumps(union_of(parts), ensure_ascii=False)], pa.string()), "n": pa.array([n], pa.int64()), "pages": pa.array([contents], pa.list_(pa.int64()))})

    def partial(t: pa.Table) -> pa.Table:
        have = Streams()
        for r in t.to_pylist():
            have.add("", r["stream"], r["texts"], r["letters"], r["n"], r["pages"])
        parts = [json.dumps(named(json.loads(s), *held_, [0]), ensure_ascii=False) for (_, s), held_ in have.items()]
        return row(t, parts, sum(x[2] for x in have.values()), least([], [p for x in have.values() for p in x[3]]))

    def whole(t: pa.Table) -> pa.Table:
        return row(t, t.column("wrapper").to_pylist(), sum(t.column("n").to_pylist()), least([], [p for x in t.column("pages").to_pylist() for p in x]))

    streams = checkpoint(distinct_streams(pages, host, html_col).withColumn("hash", F.xxhash64("stream")))
    # Pieces come from the streams alone, so the same streams are merged in the same order however pages are dealt.
    most = streams.groupBy("host", "hash").agg(F.lit(1).alias("k")).groupBy("host").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 1
    pieces = 1
    while pieces * FAN < most:
        pieces *= FAN
    made = streams.withColumn("piece", F.pmod("hash", F.lit(pieces))).groupBy("host", "piece").applyInArrow(partial, out)
    while pieces > 1:
        pieces //= FAN
        made = made.withColumn("piece", F.pmod("piece", F.lit(pieces))).groupBy("host", "piece").applyInArrow(whole, out)
    return made


def decided(wrapper: str, n: int, contents: list[int]) -> tuple[list[str], list[bool], set[int]]:
    """The wrapper's leaves, whether they are main text, and those that open the region."""
    symbols = flat(json.loads(wrapper))
    letters, template = [], []
    for s, _ in symbols:
        text, size, pages, of = held(s) if s[0] == "#" else ("", 0, 0, [])
        letters.append(size)
        template.append(len(text) > 1 and len(of) >= ENOUGH and 2 * pages >= n)
    # A block is template as a whole or not at all: what stands beside a slot in it is a part of its sentence.
    block: list[int] = []
    for i, (s, _) in enumerate([*symbols, ("<p", False)]):
        if s[0] in "#~":
            block.append(i)
        elif s.lstrip("</").split(".")[0] not in {*INLINE, "br"}:
            if not all(template[j] for j in block if symbols[j][0][0] == "#"):
                for j in block:
                    template[j] = False
            block = []
    main, region = decide(symbols, letters, template, True)
    # A heading that many articles share is theirs where it stands beside their own text: only a box that is fixed as a
    # whole, or a list of links, is template with its heading.
    opened, paths = boxes(symbols)
    own = {k for (s, _), t, p in zip(symbols, template, paths, strict=True) if s[0] == "#" and not t and not any(opened[j][0] == "a" for j in p) for k in p}
    inside = {k for k, (_, _, _, leaf) in enumerate(opened) if leaf in region}
    again = list(template)
    for i, p in enumerate(paths):
        box = [k for k in p if opened[k][0] not in INLINE | HEADINGS]
        if template[i] and box and box[-1] in own and not (inside and inside.isdisjoint(p)) and any(opened[k][0] in HEADINGS for k in p) and not any(opened[k][0] == "a" for k in p):
            again[i] = False
    if again != template:
        main, region = decide(symbols, letters, again, True)
    return [kind(s) for s, _ in symbols], main, region


FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


class Reader:
    """Pages by the wrappers of their hosts; what an alignment gives is remembered for each wrapper and stream."""

    def __init__(self):
        self.memo: dict = {}

    def keep(self, wrapper: tuple[list[str], list[bool], set[int]], key: str, nodes: list) -> list[bool]:
        at = key, json.dumps(nodes, ensure_ascii=False)
        got = self.memo.get(at)
        if got is None:
            if len(self.memo) > 5_000:
                self.memo.clear()
            own = flat(nodes)
            kinds, main, region = wrapper
            met = {j: i for i, j in aligned(kinds, [s for s, _ in own])}
            # A text that met none of the wrapper's (it joined a group there) is main if it stands in the region.
            opened, paths = boxes(own)
            inside = {k for k, (_, _, _, leaf) in enumerate(opened) if met.get(leaf) in region}
            ruled = {k for k, (_, mark, _, _) in enumerate(opened) if mark == "out"}
            free = lambda p: not barred(opened, p) and ruled.isdisjoint(p) and (not region or not inside.isdisjoint(p))
            got = [s[0] in "#~" and (main[met[j]] if j in met else free(paths[j])) for j, (s, _) in enumerate(own)]
            self.memo[at] = got
        return got

    def text(self, page: str | None, wrapper: tuple[list[str], list[bool], set[int]] | None = None, key: str = "") -> str:
        """By the wrapper's leaves and decisions, or, without one, by the page's own texts."""
        tokens = tokens_of(page)
        if wrapper:
            nodes, leaf = fold([s for s, _ in tokens])
            keep = self.keep(wrapper, key, nodes)
            return read(tokens, [keep[n] for n in leaf])
        return read(tokens, decide([(s, False) for s, _ in tokens], [len(t.strip()) for _, t in tokens], [False] * len(tokens), False)[0])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """id_col, url_col, text, n_chars of each page."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#\s@]*@)?([^/?#\s]*)", 1))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    known = checkpoint(wrappers(src, "host", "html").filter(F.size("pages") >= ENOUGH).select("host", "wrapper", "n", "pages"))
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    small_batches(spark)
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), *FIELDS.fields])

    def rows(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    if size <= broadcast:
        shared = spark.sparkContext.broadcast({r["host"]: decided(r["wrapper"], r["n"], r["pages"]) for r in known.toLocalIterator()})

        def run(batches):
            reader, of = Reader(), shared.value
            for b in batches:
                yield rows(b, [reader.text(p, of.get(h), h) for p, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])

        found = src.select("id", "url", "html", "host").mapInArrow(run, schema)
    else:

        def run(batches):
            reader, of = Reader(), {}
            for b in batches:
                texts = []
                for p, h, w, n, c in zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True):
                    if w is not None and h not in of:
                        of.clear()
                        of[h] = decided(w, n, c)
                    texts.append(reader.text(p, of[h] if w is not None else None, h))
                yield rows(b, texts)

        found = src.join(known, "host", "left").select("id", "url", "html", "host", "wrapper", "n", "pages").mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
