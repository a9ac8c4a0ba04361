"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALL_STOPWORDS, RECOMMENDATION_STOPWORDS, SEARCH_STOPWORDS

NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def _folds() -> tuple[str, str]:
    """Letters and what the index has for them, then the marks that it drops: those that compose with ASCII letters.

    A letter that decomposes into an ASCII letter and one mark is that letter; any other is its case folding, where that
    is one letter. Letters with several marks, and other scripts' letters with marks, stay as they are.
    """
    pairs, marks = {}, set()
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if unicodedata.category(ch) not in ("Lu", "Ll", "Lt"):
            continue
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and int(parts[0], 16) < 0x80:
            pairs[ch] = chr(int(parts[0], 16)).lower()
            if unicodedata.category(chr(int(parts[1], 16))) == "Mn":
                marks.add(chr(int(parts[1], 16)))
        else:
            lower = ch.lower() if len(ch.lower()) == 1 else ch
            marked = len(unicodedata.decomposition(lower).split()) == 2 and not unicodedata.decomposition(lower).startswith("<")
            same = lower.casefold() if not marked or ch == "\u1e9b" else lower
            if len(same) == 1 and same != ch:
                pairs[ch] = same
            elif lower != ch:
                pairs[ch] = lower
    for ch, to in list(pairs.items()):  # what a letter becomes may be a letter to fold itself
        pairs[ch] = pairs.get(to, to)
    gone = "".join(sorted(marks))
    return "".join(pairs) + gone, "".join(pairs.values())


#: ``FOLDED`` is longer than ``FOLDS_TO``: translation drops what has no counterpart, the marks.
FOLDED, FOLDS_TO = _folds()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), FOLDED, FOLDS_TO)


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x != "")


def tokens(text: Column) -> Column:
    """Index tokens: folded runs of letters, numbers and private characters; an underscore separates."""
    return present(F.split(fold(F.coalesce(text, F.lit(""))), NOT_TOKEN))


def normalized(text: Column) -> Column:
    """Query normalisation: lower case, runs of anything but letters, numbers and underscores become one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), NOT_WORD, " "))


def words(text: Column) -> Column:
    return present(F.split(normalized(text), " "))


def sorted_unique(values: Column) -> Column:
    """Trimmed, without empties, distinct, in byte order."""
    return F.array_sort(F.array_distinct(present(F.transform(values, lambda x: F.trim(x)))))


def basename(path: Column) -> Column:
    """The last path segment without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def path_terms(path: Column) -> Column:
    return words(basename(path))


def first_term(text: Column) -> Column:
    return F.coalesce(F.get(words(text), F.lit(0)), F.lit(""))


def first_path_term(path: Column) -> Column:
    return first_term(basename(path))


def anchor(heading: Column) -> Column:
    """A heading's anchor: lower-case letters and numbers, underscores, single dashes; else ``section``."""
    slug = F.regexp_replace(F.trim(heading), r"[^\p{L}\p{N}_\s-]+", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(slug), r"[\s-]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def is_stop(term: Column, which: frozenset = ALL_STOPWORDS) -> Column:
    return (F.octet_length(term) < 3) | term.isin(sorted(which))


def is_candidate_stop(term: Column) -> Column:
    return is_stop(term, ALL_STOPWORDS)


def is_recommendation_stop(term: Column) -> Column:
    return is_stop(term, SEARCH_STOPWORDS | RECOMMENDATION_STOPWORDS)


def query_terms(values: Column, limit: int) -> Column:
    """Ordered distinct terms of several texts, without stop words, ``limit`` at most."""
    flat = F.flatten(F.transform(values, words))
    return F.slice(F.array_distinct(F.filter(flat, lambda t: ~is_candidate_stop(t))), 1, limit)


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero, as a pure floating-point expression."""
    m = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m


def clamp_score(x: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 1000 + 0.5) / 1000


def title_words(name: Column) -> Column:
    """Dashes and underscores become spaces, each word's first letter upper case, the rest as it is."""
    w = present(F.split(F.regexp_replace(name, r"[-_\s]+", " "), " "))
    return F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), " ")


def body_lines(body: Column) -> Column:
    """Lines of a trimmed body; a blank one has none."""
    t = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")))


def kind_of(path: Column) -> Column:
    return F.when(path.startswith("sources/") & (F.length(path) > 8), "source").when(path.startswith("wiki/") & (F.length(path) > 5), "wiki").when(path.startswith("assets/") & (F.length(path) > 7), "asset")


def tier_of(path: Column) -> Column:
    return F.when(path.rlike("^(sources|wiki)/design/"), "design").when(path.rlike("^(sources|wiki)/reference/"), "reference").otherwise("canonical")


def target_kind(path: Column) -> Column:
    return F.when(path.startswith("wiki/"), "wiki").when(path.startswith("sources/"), "source").otherwise("external")


def source_id(path: Column) -> Column:
    return F.concat(F.lit("source_"), F.substring(F.sha2(path, 256), 1, 32))


def section_id(document_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s#section-%04d", document_id, ordinal)


def term_weight(tf: Column, df: Column, total: Column) -> Column:
    """(1 + ln tf) (ln((N + 1) / (df + 1)) + 1), df at least 1."""
    d = F.greatest(df, F.lit(1))
    return F.when(tf <= 0, 0.0).otherwise((1 + F.log(tf.cast("double"))) * (F.log((total + 1).cast("double") / (d + 1)) + 1))
