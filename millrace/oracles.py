"""DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

from . import schema as C
from .functions.text import FOLDED, FOLDS_TO
from .operators.excerpts import WORD


def _words(x: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(translate(lower({x}), '{FOLDED}', '{FOLDS_TO}'), '[^\p{{L}}\p{{N}}\p{{Co}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in sorted(names))


def _round(x: str, digits: int) -> str:
    m = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {m} + 0.5) / {m})"


def _clamp(x: str) -> str:
    return f"(floor(least(1.0, greatest(0.0, {x})) * 1000 + 0.5) / 1000)"


_BASE = r"regexp_replace(regexp_extract({0}, '[^/]*$'), '\.[^.]*$', '')"


def _base(x: str) -> str:
    return _BASE.format(x)


def _anchor(x: str) -> str:
    slug = rf"regexp_replace(trim({x}), '[^\p{{L}}\p{{N}}_\s-]+', '', 'g')"
    slug = rf"regexp_replace(regexp_replace(lower({slug}), '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN {slug} = '' THEN 'section' ELSE {slug} END"


STOP = _quoted(C.ALL_STOPWORDS)
RECOMMENDATION_STOP = _quoted(C.SEARCH_STOPWORDS | C.RECOMMENDATION_STOPWORDS)

# The corpus of sources/tables.py.
CORPUS = rf"""
raw AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, split_part(coalesce(text, ''), chr(10), 1) AS l1, md5(split_part(coalesce(text, ''), chr(10), 1)) AS h FROM documents),
d0 AS (SELECT *, 't' || substr(h, 1, 5) AS entity, CASE WHEN doc_id % 4 = 0 THEN 'source' ELSE 'wiki' END AS kind,
  (CASE WHEN doc_id % 4 = 0 THEN 'sources/' ELSE 'wiki/' END) || (CASE WHEN doc_id % 20 IN (8, 9) THEN 'design/' WHEN doc_id % 20 IN (12, 13) THEN 'reference/' ELSE '' END)
  || 't' || substr(h, 1, 5) || '-' || source || '-' || lang || '-' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path FROM raw),
ns AS (SELECT count(*) AS ns FROM d0 WHERE doc_id % 4 = 0),
cite AS (SELECT d0.doc_id, 4 * (('0x' || substr(h, 1, 8))::BIGINT % ns) AS no FROM d0, ns WHERE kind = 'wiki'),
want AS (SELECT doc_id, no FROM cite UNION SELECT doc_id, doc_id - doc_id % 4 FROM d0 WHERE kind = 'wiki' AND doc_id % 12 = 3),
src AS (SELECT w.doc_id, list(t.path ORDER BY t.path) AS sources FROM want w JOIN d0 t ON t.doc_id = w.no GROUP BY 1),
lnk AS (SELECT a.doc_id, list(b.path) AS links FROM d0 a JOIN d0 b ON b.doc_id = a.doc_id + 1 WHERE a.kind = 'wiki' AND b.kind = 'wiki' AND a.doc_id % 5 <> 0 GROUP BY 1),
docs AS (SELECT CASE WHEN kind = 'wiki' THEN 'doc_' || md5(path) ELSE 'source_' || substr(sha256(path), 1, 32) END AS id, path, kind,
  CASE WHEN regexp_matches(path, '^(sources|wiki)/design/') THEN 'design' WHEN regexp_matches(path, '^(sources|wiki)/reference/') THEN 'reference' ELSE 'canonical' END AS tier,
  array_to_string(list_concat([entity], list_filter(string_split(l1, ' '), lambda x: x <> '')[1:4]), ' ') AS title,
  CASE WHEN kind = 'wiki' THEN l1 ELSE '' END AS summary,
  CASE WHEN kind = 'wiki' THEN list_sort(list_distinct([entity, source])) ELSE []::VARCHAR[] END AS tags,
  coalesce(sources, []::VARCHAR[]) AS sources, coalesce(links, []::VARCHAR[]) AS links,
  CASE WHEN kind = 'wiki' THEN strftime(DATE '2026-01-01' + (doc_id % 120)::INT, '%Y-%m-%d') ELSE '' END AS modified_date,
  sha256(text) AS hash, strlen(text) AS size_bytes, doc_id, text, lang
  FROM d0 LEFT JOIN src USING (doc_id) LEFT JOIN lnk USING (doc_id)),
sec0 AS (SELECT id AS document_id, path, kind AS dkind, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS ordinal, unnest(string_split(text, chr(10))) AS body FROM docs),
sec1 AS (SELECT *, CASE WHEN ordinal % 3 = 1 THEN nullif(array_to_string(list_filter(string_split(body, ' '), lambda x: x <> '')[1:3], ' '), '') END AS heading FROM sec0),
secs AS (SELECT document_id || '#section-' || printf('%04d', ordinal) AS section_id, document_id, path, dkind, ordinal, heading,
  CASE WHEN heading IS NOT NULL THEN {_anchor("heading")} END AS anchor,
  CASE WHEN heading IS NOT NULL THEN CASE WHEN ordinal = 1 THEN 1 ELSE 2 END END AS level, body FROM sec1),
tags AS (SELECT id AS document_id, path, unnest(tags) AS tag FROM docs),
links AS (SELECT f.id AS from_document_id, f.path AS from_path, f.to_path, CASE WHEN starts_with(to_path, 'wiki/') THEN 'wiki' WHEN starts_with(to_path, 'sources/') THEN 'source' ELSE 'external' END AS kind, coalesce(t.id, '') AS to_document_id
  FROM (SELECT id, path, unnest(links) AS to_path FROM docs) f LEFT JOIN docs t ON t.path = f.to_path),
cits AS (SELECT id AS document_id, path AS wiki_path, unnest(sources) AS source_path, '' AS source_anchor, 'frontmatter_source' AS citation_kind FROM docs WHERE kind = 'wiki'
  UNION ALL SELECT p.id, p.path, s.path, x.anchor, 'inline_source' FROM cite c JOIN docs p USING (doc_id) JOIN docs s ON s.doc_id = c.no JOIN secs x ON x.path = s.path AND x.ordinal = 4 AND x.anchor IS NOT NULL WHERE c.doc_id % 2 = 0)
"""

# Terms of wiki pages.
TERMS = rf"""
words AS (SELECT path, unnest({_words("concat_ws(' ', path, title, summary, array_to_string(tags, ' '))")}) AS term FROM docs WHERE kind = 'wiki'
  UNION ALL SELECT path, unnest({_words("concat_ws(' ', heading, body)")}) FROM secs WHERE dkind = 'wiki'),
tf AS (SELECT path, term, count(*) AS tf FROM words WHERE strlen(term) >= 3 AND term NOT IN ({STOP}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
nw AS (SELECT count(*) AS n FROM docs WHERE kind = 'wiki'),
wt AS (SELECT path, term, tf, df, n, (1 + ln(tf)) * (ln((n + 1)::DOUBLE / (greatest(df, 1) + 1)) + 1) AS w FROM tf JOIN df USING (term), nw),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_round("w", 9)} DESC, term) AS rank FROM wt))
"""

# The search index: every section with its eight fields as token lists.
FIELDS = ("title", "path", "summary", "tags", "sources", "links", "heading", "body")
INDEX = f"""
fld AS (SELECT s.section_id, s.document_id, s.path, d.kind, d.tier, d.title, coalesce(s.heading, '') AS heading, coalesce(s.anchor, '') AS anchor, s.ordinal, d.tags, d.sources,
  {_tokens("d.title")} AS k0, {_tokens("s.path")} AS k1, {_tokens("d.summary")} AS k2, {_tokens("array_to_string(d.tags, ' ')")} AS k3, {_tokens("array_to_string(d.sources, ' ')")} AS k4,
  {_tokens("array_to_string(d.links, ' ')")} AS k5, {_tokens("coalesce(s.heading, '')")} AS k6, {_tokens("s.body")} AS k7 FROM secs s JOIN docs d ON d.id = s.document_id),
idx AS (SELECT *, {" + ".join(f"len(k{i})" for i in range(8))} AS length FROM fld),
stat AS (SELECT count(*) AS n, avg(length) AS avgdl FROM idx)
"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts)


def occurrences(tokens: list[str], field: str) -> str:
    if len(tokens) == 1:
        return f"len(list_filter({field}, lambda t: t = '{tokens[0]}'))"
    test = " AND ".join(f"{field}[i + {k}] = '{t}'" for k, t in enumerate(tokens))
    return f"len(list_filter(range(1, len({field}) - {len(tokens)} + 2), lambda i: {test}))"


def bm25(phrases: list[list[str]], mode: str = "and", digits: int = 6) -> str:
    """CTEs f, hits(…, lexical_score, score)."""
    weights = list(C.FIELD_WEIGHTS.values())
    f = ", ".join("(" + " + ".join(f"{weights[i]} * {occurrences(p, f'k{i}')}" for i in range(8)) + f") AS f{j}" for j, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (f{j} > 0) AS n{j}" for j in range(len(phrases)))
    idf = lambda j: f"CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{j} + 0.5) / (n{j} + 0.5)) END"
    part = " + ".join(f"({idf(j)}) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * length / avgdl))" for j in range(len(phrases)))
    match = (" AND " if mode == "and" else " OR ").join(f"f{j} > 0" for j in range(len(phrases)))
    nav = " ".join(f"WHEN lower(heading) = '{h}' THEN {v}" for h, v in C.HEADING_PENALTY.items())
    off = " ".join(f"WHEN tier = '{t}' THEN {v}" for t, v in C.TIER_PENALTY.items())
    score = f"lex - (CASE WHEN kind = 'wiki' THEN abs(lex) * 0.15 ELSE 0.0 END) + (CASE {nav} ELSE 0.0 END) + abs(lex) * (CASE {off} ELSE 0.0 END)"
    return f"""f AS (SELECT *, {f} FROM idx), seen AS (SELECT {n} FROM f),
lexed AS (SELECT f.*, -({part}) AS lex FROM f, seen, stat WHERE {match}),
hits AS (SELECT *, {_round("lex", digits)} AS lexical_score, {_round("(" + score + ")", digits)} AS score, (kind <> 'wiki')::INT AS not_wiki FROM lexed)"""


def excerpts(phrases: list[list[str]]) -> str:
    """CTE excerpt(section_id, snippet) of the sections in ``hits``: windows of 16 tokens, by scores over positions."""
    number = range(len(phrases))
    at = ", ".join("(" + " AND ".join(f"coalesce(lead(token, {j}) OVER w, '') = '{t}'" for j, t in enumerate(p)) + f")::INT AS a{i}" for i, p in enumerate(phrases))
    ends = [f"CASE WHEN a{i} = 1 THEN pos + {len(p)} END" for i, p in enumerate(phrases)]
    score = " + ".join(f"sum(a{i}) OVER f + 999 * max(a{i}) OVER f" for i in number)
    return rf"""
xf AS (SELECT section_id, unnest(range(8)) AS field, unnest([d.title, s.path, d.summary, array_to_string(d.tags, ' '), array_to_string(d.sources, ' '), array_to_string(d.links, ' '), coalesce(s.heading, ''), s.body]) AS text
  FROM (SELECT section_id FROM hits) JOIN secs s USING (section_id) JOIN docs d ON d.id = s.document_id),
xw AS (SELECT section_id, field, regexp_extract_all(text, '{WORD}') AS words, string_split_regex(text, '{WORD}') AS gaps FROM xf),
xt AS (SELECT section_id, field, len(words) AS n, gaps[-1] AS tail, unnest(range(len(words))) AS pos, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap FROM xw),
xa AS (SELECT *, {at} FROM (SELECT *, translate(lower(word), '{FOLDED}', '{FOLDS_TO}') AS token FROM xt) WINDOW w AS (PARTITION BY section_id, field ORDER BY pos)),
xe AS (SELECT *, greatest({", ".join(ends)}) AS far, coalesce({", ".join(ends[::-1])}) AS final FROM xa),
xs AS (SELECT *, {score} AS score, last_value(final IGNORE NULLS) OVER f AS until, coalesce(max(far) OVER b, 0) AS past, max(far) OVER u AS reach, pos = 0 OR regexp_matches(gap, '[.:][ 	

]+$') AS opens
  FROM xe WINDOW f AS (PARTITION BY section_id, field ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING), b AS (PARTITION BY section_id, field ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY section_id, field ORDER BY pos)),
xr AS (SELECT *, CASE WHEN reach > pos THEN max(CASE WHEN far IS NOT NULL AND past <= pos THEN pos END) OVER u END AS run, max(CASE WHEN opens THEN pos END) OVER u AS sentence FROM xs WINDOW u AS (PARTITION BY section_id, field ORDER BY pos)),
xc AS (SELECT section_id, field, pos, 1 AS first, score, greatest(0, least(pos - trunc((16 - until + pos) / 2)::INT, n - 16)) AS start FROM xr WHERE far IS NOT NULL
  UNION ALL SELECT a.section_id, a.field, a.pos, 0, s.score + CASE WHEN s.pos = 0 THEN 120 ELSE 100 END, s.pos FROM xr a JOIN xr s ON s.section_id = a.section_id AND s.field = a.field AND s.pos = a.sentence WHERE a.far IS NOT NULL AND a.n > 16 AND s.pos < a.pos),
xb AS (SELECT section_id, field, start FROM xc QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY score DESC, field, pos, first DESC) = 1),
xn AS (SELECT *, lead(run) OVER (PARTITION BY section_id, field ORDER BY pos) AS next FROM xr),
excerpt AS (SELECT section_id, CASE WHEN any_value(start) > 0 THEN '...' ELSE '' END || string_agg(CASE WHEN start > 0 AND pos = start THEN '' ELSE gap END || CASE WHEN run >= start AND run = pos THEN '<<' ELSE '' END || word
  || CASE WHEN run >= start AND (pos = start + 15 OR next IS DISTINCT FROM run) THEN '>>' ELSE '' END, '' ORDER BY pos) || CASE WHEN any_value(start) + 16 >= any_value(n) THEN any_value(tail) ELSE '...' END AS snippet
  FROM xn JOIN xb USING (section_id, field) WHERE pos BETWEEN start AND start + 15 GROUP BY section_id)"""


ORDER = "score, lexical_score, not_wiki, path, ordinal, section_id"
SHOWN = "section_id, path, kind, tier, heading, ordinal, lexical_score, score"


# Health.


def _query_terms(x: str, limit: int) -> str:
    """Ordered distinct words of a list, without stop words."""
    flat = f"flatten(list_transform({x}, lambda v: {_words('v')}))"
    kept = f"list_filter({flat}, lambda t: strlen(t) >= 3 AND t NOT IN ({STOP}))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)[1:{limit}]"


CAND = "type, confidence, score, pages, sources, reasons, queries"


def _cand(kind: str, score: str, pages: str, sources: str, reasons: str, source: str) -> str:
    s = _clamp(score)
    return f"SELECT '{kind}' AS type, CASE WHEN {s} >= 0.75 THEN 'high' WHEN {s} >= 0.45 THEN 'medium' ELSE 'low' END AS confidence, {s} AS score, {pages} AS pages, {sources} AS sources, {reasons} AS reasons FROM {source}"


GRAPH = """
edges AS (SELECT DISTINCT from_path AS a, to_path AS b FROM links WHERE kind = 'wiki' AND from_path <> to_path AND from_path IN (SELECT path FROM docs WHERE kind = 'wiki') AND to_path IN (SELECT path FROM docs WHERE kind = 'wiki')),
deg AS (SELECT path, title, tags, (SELECT count(*) FROM edges WHERE a = path) AS out_degree, (SELECT count(*) FROM edges WHERE b = path) AS in_degree FROM docs WHERE kind = 'wiki')
"""
ORPHANS = f"""orphans AS ({_cand("orphan_page", "0.52", "path", "''", "'orphan_page='", "deg WHERE in_degree = 0 AND out_degree = 0")}
UNION ALL {_cand("underlinked_page", "0.34", "path", "''", "'underlinked_page=inbound=' || in_degree || ',outbound=' || out_degree", "deg WHERE (in_degree = 0) <> (out_degree = 0)")})"""
STUBS = f"""lc AS (SELECT d.path, coalesce(sum(CASE WHEN regexp_replace(body, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE 1 END), 0)::BIGINT AS lines FROM docs d LEFT JOIN secs s ON s.document_id = d.id WHERE d.kind = 'wiki' GROUP BY 1),
stubs AS ({_cand("stub_page", "CASE WHEN lines <= 5 THEN 0.42 ELSE 0.32 END", "path", "''", "'stub_page=' || lines || ' body lines'", "lc WHERE lines < 15")})"""


def tag_ctes(table: str = "tags") -> str:
    return f"""tdf AS (SELECT tag, count(DISTINCT path) AS df FROM {table} GROUP BY 1),
tfirst AS (SELECT tag, string_agg(path, '|' ORDER BY path) AS pages FROM (SELECT DISTINCT tag, path, dense_rank() OVER (PARTITION BY tag ORDER BY path) AS k FROM {table}) WHERE k <= 3 GROUP BY 1),
tagged AS (SELECT * FROM tdf JOIN tfirst USING (tag), nw WHERE n >= 3),
tag_rows AS ({_cand("tag_anomaly", "0.28", "pages", "''", "'tag_too_specific=' || tag || ' (' || df || '/' || n || ' pages)'", "tagged WHERE df = 1")}
UNION ALL {_cand("tag_anomaly", "0.38", "pages", "''", "'tag_too_broad=' || tag || ' (' || df || '/' || n || ' pages)'", "tagged WHERE df > 1 AND df > floor(n * 0.40)")})"""


UNCITED = f"""uncited AS ({_cand("uncited_source", "0.48", "''", "path", "'uncited_source='", "docs WHERE kind = 'source' AND path NOT IN (SELECT source_path FROM cits)")})"""
GAPS = f"""gap0 AS (SELECT s.path, s.ordinal, s.heading, NOT EXISTS (SELECT 1 FROM cits c WHERE c.source_path = s.path AND c.source_anchor = s.anchor) AS open FROM secs s WHERE s.dkind = 'source' AND level IN (2, 3) AND coalesce(anchor, '') <> '' AND s.path IN (SELECT source_path FROM cits)),
gap1 AS (SELECT path, count(*) AS total, count(*) FILTER (open) AS uncited, list(heading ORDER BY ordinal, heading) FILTER (open) AS heads FROM gap0 GROUP BY 1),
gaps AS ({_cand("source_coverage_gap", "0.35 + 0.20 * uncited / total", "''", "path", "array_to_string(list_transform(heads[1:5], lambda x: 'uncited_section=' || x), '|') || CASE WHEN uncited > 5 THEN '|uncited_section=...and ' || (uncited - 5) || ' more' ELSE '' END", "gap1 WHERE uncited > 0")})"""

PAIRS = f"""
keys AS (SELECT DISTINCT path, 't' || tag AS key FROM tags UNION SELECT DISTINCT wiki_path, 's' || source_path FROM cits UNION SELECT path, 'w' || term FROM top WHERE rank <= 12 AND df > 1 AND (df <= 8 OR df * 3 <= n)),
blocked AS (SELECT DISTINCT a.path AS a, b.path AS b FROM keys a JOIN keys b ON a.key = b.key AND a.path < b.path),
sig AS (SELECT path, 'tag' AS what, tag AS value, df FROM tags JOIN (SELECT tag, count(DISTINCT path) AS df FROM tags GROUP BY 1) USING (tag)
  UNION ALL SELECT DISTINCT wiki_path, 'source', source_path, df FROM cits JOIN (SELECT source_path, count(DISTINCT wiki_path) AS df FROM cits GROUP BY 1) USING (source_path)),
sig2 AS (SELECT *, 1 - (df - 1)::DOUBLE / greatest(1, n - 1) AS r FROM sig, nw),
shared AS (SELECT a.path AS a, b.path AS b, coalesce(list(a.value ORDER BY a.value) FILTER (a.what = 'tag'), []) AS stags, coalesce(list(a.value ORDER BY a.value) FILTER (a.what = 'source'), []) AS ssources,
  least(0.42, coalesce(sum(0.02 + 0.16 * a.r * a.r) FILTER (a.what = 'tag'), 0.0)) AS ts, least(0.42, coalesce(sum(0.05 + 0.20 * a.r * a.r) FILTER (a.what = 'source'), 0.0)) AS ss, count(*) FILTER (a.df <= 3) AS rare
  FROM sig2 a JOIN sig2 b ON a.what = b.what AND a.value = b.value AND a.path < b.path GROUP BY 1, 2),
wsum AS (SELECT path, sum(w) AS s FROM wt GROUP BY 1),
met AS (SELECT p.a, p.b, x.term, least(x.w, y.w) AS m FROM blocked p JOIN wt x ON x.path = p.a JOIN wt y ON y.path = p.b AND y.term = x.term),
lex AS (SELECT a, b, {_round("sum(m) / (any_value(sa.s) + any_value(sb.s) - sum(m))", 9)} AS j, list(term ORDER BY {_round("m", 9)} DESC, term)[1:5] AS sterms FROM met JOIN wsum sa ON sa.path = a JOIN wsum sb ON sb.path = b GROUP BY a, b),
linkd AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM edges),
pair0 AS (SELECT p.a, p.b, coalesce(stags, []) AS stags, coalesce(ssources, []) AS ssources, coalesce(ts, 0.0) AS ts, coalesce(ss, 0.0) AS ss, coalesce(rare, 0) AS rare, coalesce(j, 0.0) AS j, coalesce(sterms, []) AS sterms, l.a IS NOT NULL AS linked,
  {_words(_base("p.a"))}[1] = {_words(_base("p.b"))}[1] AS same FROM blocked p LEFT JOIN shared USING (a, b) LEFT JOIN lex USING (a, b) LEFT JOIN linkd l USING (a, b)),
pair1 AS (SELECT *, ts + ss + least(0.30, 1.5 * j) AS base FROM pair0),
pair2 AS (SELECT *, base + (CASE WHEN same THEN 0.06 WHEN len(ssources) = 0 THEN -0.25 ELSE 0.0 END) AS moved, same AND rare >= 2 AND j >= 0.22 AS dup FROM pair1
  WHERE (len(ssources) > 0 OR len(stags) >= 2 OR j >= 0.10 OR (len(stags) > 0 AND j >= 0.08)) AND {_round("base", 9)} >= 0.18),
pair3 AS (SELECT *, CASE WHEN linked THEN moved * 0.75 ELSE moved + 0.12 END AS raw, CASE WHEN dup THEN 'possible_duplicate' ELSE 'missing_link' END AS type FROM pair2 WHERE dup OR NOT linked),
scored AS (SELECT *, {_clamp(_round("(CASE WHEN type = 'missing_link' THEN 0.40 + 0.35 * (1 - exp(-greatest(0.0, raw))) ELSE raw END)", 9))} AS score FROM pair3)
"""
OLDER = f"""
best AS (SELECT a, b FROM scored ORDER BY score DESC, type, concat_ws(chr(0), a, b, array_to_string(ssources, chr(0))) LIMIT 100),
two AS (SELECT p.a, p.b, x.modified_date < y.modified_date AS first, x.title AS ta, y.title AS tb, x.tags AS ga, y.tags AS gb, abs(date_diff('day', x.modified_date::DATE, y.modified_date::DATE)) AS apart FROM best p JOIN docs x ON x.path = p.a JOIN docs y ON y.path = p.b),
apart0 AS (SELECT a, b, CASE WHEN first THEN a ELSE b END AS older, CASE WHEN first THEN tb ELSE ta END AS title, CASE WHEN first THEN gb ELSE ga END AS tags, CASE WHEN first THEN b ELSE a END AS newer FROM two WHERE apart >= 30),
apart AS (SELECT a, b, older, {_query_terms("list_concat([title], tags, [" + _base("newer") + "])", 5)} AS q FROM apart0),
atom AS (SELECT a, b, older, unnest(q) AS atom FROM apart),
older AS (SELECT DISTINCT a, b, older FROM atom JOIN idx ON idx.path = atom.older
  WHERE {" OR ".join(f"contains(' ' || array_to_string(k{i}, ' ') || ' ', ' ' || array_to_string({_tokens('atom')}, ' ') || ' ')" for i in range(8))})
"""
PAIR_ROWS = f"""pairs AS (SELECT type, CASE WHEN s >= 0.75 AND type <> 'missing_link' THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS confidence, s AS score, a || '|' || b AS pages, array_to_string(ssources, '|') AS sources,
  array_to_string(list_concat(list_transform(stags, lambda x: 'shared_tag=' || x), list_transform(ssources, lambda x: 'shared_source=' || x), CASE WHEN j >= 0.08 AND len(sterms) > 0 THEN ['lexical_overlap=' || array_to_string(sterms, ',')] ELSE [] END,
    CASE WHEN NOT linked THEN ['not_linked='] ELSE [] END, CASE WHEN older IS NOT NULL THEN ['older_relevant_page=' || older] ELSE [] END), '|') AS reasons
  FROM (SELECT *, CASE WHEN older IS NULL THEN score ELSE {_clamp("score + 0.10")} END AS s FROM scored LEFT JOIN older USING (a, b)))"""


def with_queries(title: str, tags: str, path: str) -> str:
    return f"list_concat([{title}], {tags}, [{_base(path)}])"


def diversified(limit: int) -> str:
    from .operators.health import FAMILIES, quotas

    q = quotas(limit)
    family = "CASE " + " ".join(f"WHEN type IN ({_quoted(t)}) THEN {i}" for i, t in enumerate(FAMILIES)) + " END"
    quota = "CASE family " + " ".join(f"WHEN {i} THEN {max(1, x)}" for i, x in enumerate(q)) + " END"
    key = "score DESC, type, replace(pages, '|', chr(0)) || CASE WHEN pages <> '' AND sources <> '' THEN chr(0) ELSE '' END || replace(sources, '|', chr(0))"
    return f"""cand AS (SELECT * FROM pairs UNION ALL SELECT * FROM orphans UNION ALL SELECT * FROM stubs UNION ALL SELECT * FROM tag_rows UNION ALL SELECT * FROM uncited UNION ALL SELECT * FROM gaps),
fam AS (SELECT *, {family} AS family FROM cand), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {key}) AS k FROM fam),
rk2 AS (SELECT *, (k > {quota})::INT AS rest FROM rk), pl AS (SELECT *, row_number() OVER (ORDER BY rest, {key}) AS place FROM rk2)
SELECT type, confidence, score, pages, sources, reasons FROM pl WHERE rest = 0 OR place <= {limit} ORDER BY {key} LIMIT {limit}"""
