"""Health candidates: pairs of pages to merge or link, orphans, stubs, uncited sources, coverage gaps, odd tags.

Every family is one DataFrame plan. Scores are fixed formulas; a candidate has type, confidence, score, pages,
sources, reasons (code, value), suggested queries and an instruction.
"""

from __future__ import annotations

from functools import partial, reduce
from math import inf, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as C
from ..functions import text as X
from ..sources.cut import checkpoint
from . import terms as W
from .corpus import Corpus
from .pair_blocks import lexical_pairs, meetings

COLUMNS = ("type", "confidence", "score", "pages", "sources", "reasons", "queries", "instruction")



def strings(*cols) -> Column:
    return F.array(*cols).cast("array<string>")


def reason(code: str, value: Column | str = "") -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(value) if isinstance(value, str) else value).alias("value"))


def confidence(score: Column, kind: Column | None = None) -> Column:
    high = score >= 0.75 if kind is None else (score >= 0.75) & (kind != "missing_link")
    return F.when(high, "high").when(score >= 0.45, "medium").otherwise("low")


def candidate(df: DataFrame, kind: str, score: Column, pages: Column, sources: Column, reasons: Column, queries: Column) -> DataFrame:
    s = X.clamp_score(score)
    return df.select(F.lit(kind).alias("type"), confidence(s).alias("confidence"), s.alias("score"), pages.alias("pages"), sources.alias("sources"), reasons.alias("reasons"), queries.alias("queries"), F.lit(C.REVIEW[kind]).alias("instruction"))


def document_queries(title: Column, tags: Column, path: Column, heavy: Column) -> Column:
    """One query from a page's title, tags and file name; its heaviest terms fill up what room the counts leave."""
    own = F.concat(X.words(title), tags, X.path_terms(path))
    full = F.concat(own, F.slice(heavy, 1, F.greatest(F.lit(0), 7 - F.size(own))))
    found = X.query_terms(full, 7)
    return F.when(F.size(found) > 0, strings(F.array_join(found, " "))).when(F.size(X.path_terms(path)) > 0, strings(F.array_join(X.path_terms(path), " "))).otherwise(strings())


# The link graph.


def wiki_edges(corpus: Corpus) -> DataFrame:
    """Distinct links from page to page, both ends existing, none to itself."""
    pages = corpus.wiki.select("path")
    e = corpus.links.filter(F.col("kind") == "wiki").select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).filter("a != b").distinct()
    return e.join(pages.withColumnRenamed("path", "a"), "a", "left_semi").join(pages.withColumnRenamed("path", "b"), "b", "left_semi")


def degrees(corpus: Corpus) -> DataFrame:
    e = wiki_edges(corpus)
    ends = e.select(F.col("a").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("b", F.lit(0), F.lit(1)))
    d = ends.groupBy("path").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return corpus.wiki.join(d, "path", "left").select("path", "title", "tags", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def heavy_terms(weights: DataFrame, limit: int = 7) -> DataFrame:
    top = W.top_terms(weights, limit)
    return top.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("heavy"))


def with_heavy(df: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return df.withColumn("heavy", strings())
    return df.join(heavy_terms(weights), "path", "left").withColumn("heavy", F.coalesce("heavy", strings()))


def orphans(corpus: Corpus, weights: DataFrame | None = None) -> DataFrame:
    d = with_heavy(degrees(corpus), weights)
    alone, half = (F.col("in_degree") == 0) & (F.col("out_degree") == 0), (F.col("in_degree") == 0) != (F.col("out_degree") == 0)
    q = document_queries(F.col("title"), F.col("tags"), F.col("path"), F.col("heavy"))
    pages = strings("path")
    return candidate(d.filter(alone), "orphan_page", F.lit(0.52), pages, strings(), F.array(reason("orphan_page")), q).unionByName(candidate(d.filter(half), "underlinked_page", F.lit(0.34), pages, strings(), F.array(reason("underlinked_page", F.concat(F.lit("inbound="), F.col("in_degree").cast("string"), F.lit(",outbound="), F.col("out_degree").cast("string")))), q))


# Lines, tags, sources.


def line_counts(corpus: Corpus) -> DataFrame:
    lines = corpus.sections.groupBy("path").agg(F.sum(X.body_lines(F.col("body"))).cast("long").alias("lines"))
    return corpus.wiki.join(lines, "path", "left").select("path", "title", "tags", F.coalesce("lines", F.lit(0)).alias("lines"))


def stubs(corpus: Corpus, weights: DataFrame | None = None) -> DataFrame:
    d = with_heavy(line_counts(corpus).filter(F.col("lines") < C.STUB_LINES), weights)
    score = F.when(F.col("lines") <= C.STUB_SHORT, 0.42).otherwise(0.32)
    return candidate(d, "stub_page", score, strings("path"), strings(), F.array(reason("stub_page", F.concat(F.col("lines").cast("string"), F.lit(" body lines")))), document_queries(F.col("title"), F.col("tags"), F.col("path"), F.col("heavy")))


def tag_frequency(corpus: Corpus) -> DataFrame:
    return corpus.tags.groupBy("tag").agg(F.countDistinct("path").alias("df"))


def tag_anomalies(corpus: Corpus) -> DataFrame:
    """Tags of one page, and tags of more than two fifths of the pages, where there are three pages at least."""
    total = F.broadcast(W.wiki_count(corpus))  # one row
    # The three first pages: a partial minimum of paths, not a list of all of them.
    first = corpus.tags.withColumn("k", F.row_number().over(Window.partitionBy("tag").orderBy("path"))).filter("k <= 3").groupBy("tag").agg(F.array_sort(F.collect_list("path")).alias("pages"))
    t = tag_frequency(corpus).crossJoin(total).filter(F.col("n") >= C.TAG_PAGES)
    rare, broad = F.col("df") == 1, F.col("df") > F.floor(F.col("n") * C.TAG_BROAD)
    d = t.filter(rare | broad).join(first, "tag")
    value = F.concat("tag", F.lit(" ("), F.col("df").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" pages)"))
    q = strings("tag")
    return candidate(d.filter(rare), "tag_anomaly", F.lit(0.28), F.col("pages"), strings(), F.array(reason("tag_too_specific", value)), q).unionByName(candidate(d.filter(broad & ~rare), "tag_anomaly", F.lit(0.38), F.col("pages"), strings(), F.array(reason("tag_too_broad", value)), q))


def uncited_sources(corpus: Corpus) -> DataFrame:
    cited = corpus.citations.select(F.col("source_path").alias("path")).distinct()
    d = corpus.documents.filter(F.col("kind") == "source").join(cited, "path", "left_anti")
    return candidate(d, "uncited_source", F.lit(0.48), strings(), strings("path"), F.array(reason("uncited_source")), document_queries(F.col("title"), strings(), F.col("path"), strings()))


def coverage(corpus: Corpus) -> DataFrame:
    """Of each cited source: its sections of level 2 and 3, how many no page cites by anchor, and the first of those."""
    cited = corpus.citations.select(F.col("source_path").alias("path")).distinct()
    anchors = corpus.citations.filter(F.col("source_anchor") != "").select(F.col("source_path").alias("path"), F.col("source_anchor").alias("anchor"), F.lit(True).alias("cited")).distinct()
    s = corpus.sections.filter(F.col("level").isin(2, 3) & (F.coalesce("anchor", F.lit("")) != "")).join(corpus.documents.filter(F.col("kind") == "source").select("path", "title"), "path").join(cited, "path", "left_semi")
    open_ = s.join(anchors, ["path", "anchor"], "left").withColumn("open", F.col("cited").isNull())
    counts = open_.groupBy("path", "title").agg(F.count("*").alias("total"), F.sum(F.col("open").cast("long")).alias("uncited")).filter("uncited > 0")
    # Only the first few are gathered: the window's limit runs before its shuffle.
    place = F.row_number().over(Window.partitionBy("path").orderBy("ordinal", "heading"))
    first = open_.filter("open").select("path", "ordinal", "heading", place.alias("k")).filter(F.col("k") <= C.GAP_REASONS).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "heading"))).alias("list"))
    return counts.join(first, "path")


def coverage_gaps(corpus: Corpus) -> DataFrame:
    d = coverage(corpus)
    first = F.transform(F.slice("list", 1, C.GAP_REASONS), lambda x: F.struct(F.lit("uncited_section").alias("code"), F.coalesce(x["heading"], F.lit("")).alias("value")))
    more = F.when(F.col("uncited") > C.GAP_REASONS, F.array(reason("uncited_section", F.concat(F.lit("...and "), (F.col("uncited") - C.GAP_REASONS).cast("string"), F.lit(" more"))))).otherwise(F.slice(first, 1, 0))
    return candidate(d, "source_coverage_gap", 0.35 + 0.20 * F.col("uncited") / F.col("total"), strings(), strings("path"), F.concat(first, more), document_queries(F.col("title"), strings(), F.col("path"), strings()))


# Pairs of pages.


def pair_keys(corpus: Corpus, weights: DataFrame) -> DataFrame:
    """path, key: the tags, sources and top terms by which pages may meet."""
    tag = corpus.tags.select("path", F.concat(F.lit("t"), "tag").alias("key"))
    source = corpus.citations.select(F.col("wiki_path").alias("path"), F.concat(F.lit("s"), "source_path").alias("key"))
    term = W.pair_terms(weights, C.PAIR_TERMS, C.RARE_TERM).select("path", F.concat(F.lit("w"), "term").alias("key"))
    return tag.unionAll(source).unionAll(term).distinct()


def blocked_pairs(corpus: Corpus, weights: DataFrame) -> DataFrame:
    """a < b: pages that share a tag, a source, or one of their top terms: an equi-join on the shared key."""
    return meetings(pair_keys(corpus, weights))


def tags_and_sources(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """path, value."""
    return corpus.tags.select("path", F.col("tag").alias("value")), corpus.citations.select(F.col("wiki_path").alias("path"), F.col("source_path").alias("value"))


def blocked_overlap(corpus: Corpus, weights: DataFrame) -> DataFrame:
    """``lexical_overlap`` of the blocked pairs, without a row for each pair and term."""
    return lexical_pairs(pair_keys(corpus, weights), weights, *tags_and_sources(corpus), every=True)


def signal_lists(corpus: Corpus) -> DataFrame:
    """path, tag, source: each page's tags and sources with the number of pages that have them and whether few do."""
    n = F.broadcast(W.wiki_count(corpus))  # one row
    tags = corpus.tags.select("path", "tag").distinct().join(tag_frequency(corpus), "tag").select("path", F.lit("tag").alias("what"), F.col("tag").alias("value"), "df")
    cites = corpus.citations.select(F.col("wiki_path").alias("path"), F.col("source_path").alias("value")).distinct()
    sources = cites.join(cites.groupBy("value").agg(F.count("*").alias("df")), "value").select("path", F.lit("source").alias("what"), "value", "df")
    rarity = 1 - (F.col("df") - 1) / F.greatest(F.lit(1), F.col("n") - 1)
    rows = tags.unionByName(sources).crossJoin(n).select("path", "what", F.struct("value", (rarity * rarity).alias("r"), (F.col("df") <= C.RARE_SIGNAL).cast("int").alias("rare")).alias("x"))
    # A page has few tags and sources.
    of = lambda what: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.col("x"))))
    return rows.groupBy("path").agg(of("tag").alias("tag"), of("source").alias("source"))


def among(names: str, v: Column) -> Column:
    return F.array_contains(names, v["value"])


def shared_signals(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with their shared tags and sources, rarity scores and number of rare signals.

    Lists of two pages are compared, once for each pair asked for: a tag of many pages makes no rows of its own.
    """
    lists = signal_lists(corpus)
    of = lambda end: lists.select(F.col("path").alias(end), F.col("tag").alias(f"tag_{end}"), F.col("source").alias(f"source_{end}"))
    return signals_of(pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left"))


def signals_of(both: DataFrame) -> DataFrame:
    """Of pairs with the lists of ``signal_lists`` of their pages (tag_a, source_a, tag_b, source_b) what ``shared_signals`` gives."""
    empty = F.expr("cast(array() as array<struct<value:string,r:double,rare:int>>)")
    for what in ("tag", "source"):
        names = F.transform(F.coalesce(f"{what}_b", empty), lambda v: v["value"])
        both = both.withColumn(f"names_{what}", names).withColumn(what, F.filter(F.coalesce(f"{what}_a", empty), partial(among, f"names_{what}")))
    values = lambda what: F.transform(what, lambda v: v["value"])
    score = lambda what, least, more: F.least(F.lit(0.42), F.aggregate(what, F.lit(0.0), lambda s, v: s + (least + more * v["r"])))
    rare = F.aggregate(F.concat("tag", "source"), F.lit(0), lambda s, v: s + v["rare"])
    return both.select("a", "b", values("tag").alias("tags"), values("source").alias("sources"), score("tag", 0.02, 0.16).alias("tag_score"), score("source", 0.05, 0.20).alias("source_score"), rare.alias("rare"))


def lexical_overlap(pairs: DataFrame, weights: DataFrame, digits: int = 9) -> DataFrame:
    """j: weighted Jaccard of two pages' terms (the sum of maxima is both sums less the sum of minima), and the top five shared terms."""
    w = weights.select("path", "term", "w")
    total = w.groupBy("path").agg(F.sum("w").alias("s"))
    met = pairs.select("a", "b").join(w.select(F.col("path").alias("a"), "term", F.col("w").alias("wa")), "a").join(w.select(F.col("path").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    least = F.least("wa", "wb")
    # Of a pair's shared terms the five best are kept.
    shared = met.groupBy("a", "b").agg(F.sum(least).alias("m"), F.slice(F.array_sort(F.collect_list(F.struct((-X.round_to(least, digits)).alias("c"), "term"))), 1, 5).alias("best"))
    full = shared.join(total.select(F.col("path").alias("a"), F.col("s").alias("sa")), "a").join(total.select(F.col("path").alias("b"), F.col("s").alias("sb")), "b")
    return full.select("a", "b", X.round_to(F.col("m") / (F.col("sa") + F.col("sb") - F.col("m")), digits).alias("j"), F.transform("best", lambda x: x["term"]).alias("shared_terms"))


def scored_pairs(corpus: Corpus, weights: DataFrame) -> DataFrame:
    """Pairs that pass the gate, with type, score and evidence; score is calibrated, before any enrichment."""
    return scored(corpus, pair_keys(corpus, weights), weights)


def scored(corpus: Corpus, keys: DataFrame, weights: DataFrame, least: tuple[DataFrame, float] | None = None) -> DataFrame:
    """What ``scored_pairs`` gives, of pages that share one of ``keys`` (path, key); least: ``signal_lists``, and the least sum of scores."""
    tags, sources = tags_and_sources(corpus)
    if least is not None:
        of = lambda what, low, more: least[0].select("path", F.explode(what).alias("s")).select("path", "s.value", (low + more * F.col("s.r")).alias("v"))
        tags, sources = of("tag", 0.02, 0.16), of("source", 0.05, 0.20)
    # Written, as the signals are looked up for the pairs that pass alone. Pairs without any lexical overlap are among
    # them, with j = 0, where another signal lets them pass.
    lexical = checkpoint(lexical_pairs(keys, weights, tags, sources, least=0.0 if least is None else least[1]))
    signals = shared_signals(corpus, lexical)
    edge = wiki_edges(corpus).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("linked")).distinct()
    p = lexical.join(signals, ["a", "b"], "left").join(edge, ["a", "b"], "left")
    none = strings()
    p = p.select("a", "b", F.coalesce("tags", none).alias("tags"), F.coalesce("sources", none).alias("sources"), F.coalesce("tag_score", F.lit(0.0)).alias("ts"), F.coalesce("source_score", F.lit(0.0)).alias("ss"), F.coalesce("rare", F.lit(0)).alias("rare"), F.coalesce("j", F.lit(0.0)).alias("j"), F.coalesce("shared_terms", none).alias("shared_terms"), F.coalesce("linked", F.lit(False)).alias("linked"))
    base = F.col("ts") + F.col("ss") + F.least(F.lit(0.30), 1.5 * F.col("j"))
    strong = (F.size("sources") > 0) | (F.size("tags") >= 2) | (F.col("j") >= C.LEXICAL_PAIR) | ((F.size("tags") > 0) & (F.col("j") >= C.LEXICAL_REASON))
    same = (X.first_path_term(F.col("a")) != "") & (X.first_path_term(F.col("a")) == X.first_path_term(F.col("b")))
    p = p.withColumn("base", base).filter(strong & (X.round_to(F.col("base"), 9) >= C.PAIR_LEAST)).withColumn("same", same)
    moved = F.col("base") + F.when(F.col("same"), 0.06).when(F.size("sources") == 0, -0.25).otherwise(0.0)
    raw = F.when(F.col("linked"), moved * 0.75).otherwise(moved + 0.12)
    duplicate = F.col("same") & (F.col("rare") >= 2) & (F.col("j") >= C.LEXICAL_DUPLICATE)
    p = p.withColumn("type", F.when(duplicate, "possible_duplicate").otherwise("missing_link")).filter(duplicate | ~F.col("linked"))
    score = X.clamp_score(X.round_to(F.when(F.col("type") == "missing_link", link_score(raw)).otherwise(raw), 9))
    return p.withColumn("score", score).drop("base", "ts", "ss")


def link_score(raw: Column) -> Column:
    return 0.40 + 0.35 * (1 - F.exp(-F.greatest(F.lit(0.0), raw)))


def pair_order(df: DataFrame) -> list[Column]:
    return [F.desc("score"), F.asc("type"), F.concat_ws("\0", "a", "b", F.array_join("sources", "\0"))]


def signal_keys(lists: DataFrame, rare: bool) -> DataFrame:
    """path, x: each page's tags and sources (key as in ``pair_keys``, v: what one adds to a pair's score), the most frequent first."""
    of = lambda what, least, more: F.transform(F.filter(what, lambda s: s["rare"] == int(rare)), lambda s: F.struct(s["r"].alias("r"), F.concat(F.lit(what[0]), s["value"]).alias("key"), (least + more * s["r"]).alias("v")))
    return lists.select("path", F.array_sort(F.concat(of("tag", 0.02, 0.16), of("source", 0.05, 0.20))).alias("x"))


def rare_keys(lists: DataFrame) -> DataFrame:
    """path, key: the tags and sources of several pages, but of ``RARE_SIGNAL`` at most."""
    keys = signal_keys(lists, True).select("path", F.explode("x.key").alias("key"))
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key").select("path", "key")


def reaching_keys(lists: DataFrame, need: float) -> DataFrame:
    """path, key: other tags and sources, one of which pages share if what they share adds up to ``need`` (above 0).

    A page's most frequent ones that don't come to ``need`` together are left out: pages that share enough share one that
    is less frequent, and the least frequent of those is left out of neither.
    """
    x = signal_keys(lists, False)
    sums = F.transform("x", lambda s, i: F.aggregate(F.slice(F.col("x"), 1, i + 1), F.lit(0.0), lambda t, u: t + u["v"]))
    return x.select("path", F.explode(F.arrays_zip(F.col("x.key").alias("key"), sums.alias("sum"))).alias("s")).filter(F.col("s.sum") >= need).select("path", "s.key")


def link_raw(score: float) -> float:
    """The least raw score, a little less for rounding, of a missing link that scores so much; none scores 0.75."""
    link = (score - 0.0006 - 0.40) / 0.35
    return 0.0 if link <= 0 else inf if link >= 1 else -log(1 - link) - 1e-6


#: What a missing link has at most: from one name and no link, from terms, from tags and sources.
LINK_MORE, LEXICAL_MOST, SIGNALS_MOST = 0.06 + 0.12, 0.30, 0.42 + 0.42


def best_pairs(corpus: Corpus, weights: DataFrame | None = None, limit: int = 0, wanted: Column | None = None, links: bool = True) -> DataFrame:
    """Of ``scored_pairs`` the best ``OLDER_PAIRS``, and the best ``limit`` of those that are wanted (links: missing links may be).

    Pages that share a rare signal come first: few have it, and all duplicates are among them. Of the others those pairs
    alone are compared that share enough signals to reach the scores found, and those alone are written that reach them.
    """
    lists = checkpoint(signal_lists(corpus))
    total = lambda pages=None: checkpoint(W.weighted_terms(W.term_counts(corpus), W.wiki_count(corpus), pages)) if weights is None else weights
    rare = checkpoint(rare_keys(lists))
    quotas = [(C.OLDER_PAIRS, F.lit(True)), *([(limit, wanted)] if limit else [])]
    best = lambda rows: [rows.filter(w).orderBy(*pair_order(rows)).limit(n) for n, w in quotas]
    found = checkpoint(reduce(DataFrame.unionAll, best(checkpoint(scored(corpus, rare, total(rare.select("path").distinct()))))).dropDuplicates(["a", "b"]))
    # The least score that a missing link needs to come among the best: one row for each quota.
    last = [(n, *found.filter(w).orderBy(F.desc("score")).limit(n).agg(F.count("*"), F.min("score")).first()) for n, w in quotas[: 1 + links]]
    raw = link_raw(min(s if k == n else 0.0 for n, k, s in last))
    need = raw - LINK_MORE - LEXICAL_MOST
    if need > 0:
        keys = checkpoint(reaching_keys(lists, need)) if need <= SIGNALS_MOST else None
        if keys is None or keys.isEmpty():
            return found
        weights = total(keys.select("path").distinct())
    else:
        weights = total()
        keys = pair_keys(corpus, weights)
    rest = checkpoint(scored(corpus, keys, weights, (lists, raw - LINK_MORE)))
    return reduce(DataFrame.unionAll, [found, *best(rest)]).dropDuplicates(["a", "b"])


def older_relevant(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """a, b, older: of the best pairs those whose pages are 30 days apart, the older one with a word of the newer one's query.

    The best ``OLDER_PAIRS`` pairs are chosen once, before any filter.
    """
    best = pairs.orderBy(*pair_order(pairs)).limit(C.OLDER_PAIRS).select("a", "b")
    d = corpus.wiki.select("path", "title", "tags", F.to_date("modified_date", "yyyy-MM-dd").alias("day"))
    two = best.join(d.select(F.col("path").alias("a"), F.col("title").alias("title_a"), F.col("tags").alias("tags_a"), F.col("day").alias("day_a")), "a").join(d.select(F.col("path").alias("b"), F.col("title").alias("title_b"), F.col("tags").alias("tags_b"), F.col("day").alias("day_b")), "b")
    first = F.col("day_a") < F.col("day_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    apart = two.filter(F.abs(F.datediff("day_a", "day_b")) >= C.OLDER_DAYS).select("a", "b", pick("a", "b").alias("older"), X.query_terms(F.concat(X.words(pick("title_b", "title_a")), pick("tags_b", "tags_a"), X.path_terms(pick("b", "a"))), 5).alias("q"))
    # Query words are matched as the index splits them: a word with an underscore is a phrase of its parts.
    atoms = apart.select("a", "b", "older", F.explode("q").alias("atom")).filter(~F.col("atom").isin(sorted(C.SEARCH_STOPWORDS)))
    text = fielded(corpus)
    hit = atoms.join(text, atoms["older"] == text["path"]).filter(F.exists("fields", lambda f: f.contains(F.concat(F.lit(" "), F.array_join(X.tokens(F.col("atom")), " "), F.lit(" ")))))
    return hit.select("a", "b", "older").distinct()


def fielded(corpus: Corpus) -> DataFrame:
    """path, fields: a section's fields as space-bounded token strings."""
    d = corpus.wiki.select(F.col("id").alias("document_id"), "title", "summary", F.array_join("tags", " ").alias("ts"), F.array_join("sources", " ").alias("ss"), F.array_join("links", " ").alias("ls"))
    s = corpus.sections.join(d, "document_id")
    return s.select("path", F.array(*[F.concat(F.lit(" "), F.array_join(X.tokens(F.col(c)), " "), F.lit(" ")) for c in ("title", "path", "summary", "ts", "ss", "ls", "heading", "body")]).alias("fields"))


def pairs(corpus: Corpus, weights: DataFrame | None = None, limit: int = 0, wanted: Column | None = None, links: bool = True) -> DataFrame:
    """Pair candidates with their enrichment: all, or those among which the first ``limit`` wanted ones are."""
    if limit:
        p = best_pairs(corpus, weights, limit, wanted, links)
    else:
        p = scored_pairs(corpus, W.weighted_terms(W.term_counts(corpus), W.wiki_count(corpus)) if weights is None else weights)
    p = checkpoint(p)  # read twice: for the best hundred, and in full
    p = p.join(older_relevant(corpus, p), ["a", "b"], "left")
    score = F.when(F.col("older").isNotNull(), X.clamp_score(F.col("score") + 0.10)).otherwise(F.col("score"))
    as_reasons = lambda col, code: F.transform(col, lambda x: F.struct(F.lit(code).alias("code"), x.alias("value")))
    empty = F.slice(F.array(reason("")), 1, 0)
    reasons = F.concat(
        as_reasons("tags", "shared_tag"), as_reasons("sources", "shared_source"),
        F.when((F.col("j") >= C.LEXICAL_REASON) & (F.size("shared_terms") > 0), F.array(reason("lexical_overlap", F.array_join("shared_terms", ",")))).otherwise(empty),
        F.when(~F.col("linked"), F.array(reason("not_linked"))).otherwise(empty),
        F.when(F.col("older").isNotNull(), F.array(reason("older_relevant_page", F.col("older")))).otherwise(empty),
    )
    one = X.query_terms(F.concat("tags", "shared_terms", X.path_terms(F.col("a")), X.path_terms(F.col("b"))), 7)
    two = F.when(F.size("sources") > 0, X.query_terms(F.concat(X.path_terms(F.col("sources")[0]), "tags", "shared_terms"), 7)).otherwise(strings())
    queries = F.array_distinct(X.present(strings(F.array_join(one, " "), F.array_join(two, " "))))
    return p.withColumn("score", score).select("type", confidence(F.col("score"), F.col("type")).alias("confidence"), "score", strings("a", "b").alias("pages"), "sources", reasons.alias("reasons"), queries.alias("queries"), reduce(lambda w, k: w.when(F.col("type") == k, C.REVIEW[k]), C.REVIEW, F).alias("instruction"))


# All families.


def sort_key() -> list[Column]:
    return [F.desc("score"), F.asc("type"), F.array_join(F.concat("pages", "sources"), "\0")]


FAMILIES = (("possible_duplicate", "missing_link"), ("uncited_source", "source_coverage_gap"), ("orphan_page", "underlinked_page"), ("stub_page",), ("tag_anomaly",))
SHARES = (3, 3, 2, 1, 1)


def quotas(limit: int) -> list[int]:
    """Places of each family among ``limit``: a share each, one at least; too many are taken back from the last family on."""
    q = [max(1, s * limit // 10) for s in SHARES]
    while sum(q) > limit and any(q):
        for i in reversed(range(len(q))):
            if sum(q) > limit and q[i]:
                q[i] -= 1
    return q


def diversified(rows: DataFrame, limit: int) -> DataFrame:
    """A mixed queue: each family's first rows up to its quota (one even if that is 0), the best others, sorted, cut.

    Only the first ``limit`` rows of each family can matter; they are taken by a window whose limit is pushed below its shuffle.
    """
    q = quotas(limit)
    family = reduce(lambda w, i: w.when(F.col("type").isin(*FAMILIES[i]), i), range(len(FAMILIES)), F)
    quota = reduce(lambda w, i: w.when(F.col("family") == i, max(1, q[i])), range(len(q)), F)
    ranked = rows.withColumn("family", family).withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy(*sort_key()))).filter(F.col("k") <= limit)
    # At most five times the limit's rows are left: one task orders them.
    rest = (F.col("k") > quota).cast("int")
    chosen = ranked.withColumn("rest", rest).withColumn("place", F.row_number().over(Window.orderBy("rest", *sort_key()))).filter((F.col("rest") == 0) | (F.col("place") <= limit))
    return chosen.orderBy(*sort_key()).limit(limit).select(*COLUMNS)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    if kind == "all":
        return rows
    types = {"duplicates": ["possible_duplicate"], "sources": list(FAMILIES[1]), "orphans": list(FAMILIES[2]), "stubs": ["stub_page"], "tags": ["tag_anomaly"]}
    if kind == "links":
        return rows.filter((F.col("type") == "missing_link") | F.exists("reasons", lambda r: r["code"] == "not_linked"))
    return rows.filter(F.col("type").isin(types[kind]))


def wanted_pairs(kind: str, path: str) -> Column:
    """What ``of_kind`` and the prefix leave, of scored pairs."""
    of = {"duplicates": F.col("type") == "possible_duplicate", "links": (F.col("type") == "missing_link") | ~F.col("linked")}.get(kind, F.lit(True))
    return of & F.exists(F.concat(F.array("a", "b"), "sources"), lambda x: x.startswith(path))


def health(corpus: Corpus, kind: str = "all", path: str = "", limit: int = C.CANDIDATE_LIMIT) -> DataFrame:
    """Candidates of a kind whose pages or sources begin with ``path``, best first."""
    if kind not in C.CANDIDATE_KINDS:
        raise ValueError(f"kind {kind!r} is not one of {', '.join(C.CANDIDATE_KINDS)}")
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"path prefix {path!r} leaves the corpus")
    limit = C.CANDIDATE_LIMIT if limit <= 0 else min(limit, C.CANDIDATE_MOST)
    makers = {"pairs": lambda: pairs(corpus, weights, limit, wanted_pairs(kind, path), kind != "duplicates"), "orphans": lambda: orphans(corpus, weights), "stubs": lambda: stubs(corpus, weights), "tags": lambda: tag_anomalies(corpus), "uncited": lambda: uncited_sources(corpus), "gaps": lambda: coverage_gaps(corpus)}
    needed = {"all": list(makers), "duplicates": ["pairs"], "links": ["pairs"], "sources": ["uncited", "gaps"], "orphans": ["orphans"], "stubs": ["stubs"], "tags": ["tags"]}[kind]
    # Sources and tags have no use for the terms of pages, pairs alone seldom for those of all.
    weights = checkpoint(W.weighted_terms(W.term_counts(corpus), W.wiki_count(corpus))) if {"orphans", "stubs"} & set(needed) else None
    rows = of_kind(reduce(DataFrame.unionByName, [makers[m]() for m in needed]), kind)
    if path:
        rows = rows.filter(F.exists(F.concat("pages", "sources"), lambda x: x.startswith(path)))
    return diversified(rows, limit) if kind == "all" else rows.orderBy(*sort_key()).limit(limit).select(*COLUMNS)
