"""Excerpts of found sections, made in the plan: a window of tokens around the best matches of a query's phrases.

A section's fields become rows of tokens with their positions, and window functions over the positions do the rest. Any
``size`` consecutive tokens of a field score 1000 for each phrase that starts among them and 1 for each further start.
Windows that are tried are those that have a match in their middle and those that begin with a match's sentence, which
get 100 more, or 120 where the sentence begins the field. Sections are dealt out once, by their key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SIZE = 16
#: The fields of the index in their order, as texts.
FIELDS = {
    "title": F.col, "path": F.col, "summary": F.col, "tags": lambda c: F.array_join(c, " "), "sources": lambda c: F.array_join(c, " "),
    "links": lambda c: F.array_join(c, " "), "heading": F.col, "body": F.col,
}
#: A token as it is written: marks that the index drops belong to it.
WORD = rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{X.FOLDED[len(X.FOLDS_TO) :]}]*"
#: What stands before the first token of a sentence.
SENTENCE = r"[.:][ \t\n\r]+\z"


def fields_of(sections: DataFrame, key: str = "section_id") -> DataFrame:
    """key, field (its number), text of the fields of sections; null texts are empty."""
    texts = F.array(*[F.coalesce(f(c), F.lit("")) for c, f in FIELDS.items()])
    return sections.select(key, texts.alias("texts")).repartition(key).select(key, F.posexplode("texts").alias("field", "text"))


def matched(tokens: DataFrame, phrases: list[list[str]], ordered) -> DataFrame:
    """Adds a0, a1, ...: 1 where a phrase begins; far, last: the greatest end and the last phrase's end of what begins here."""
    ahead = lambda j: F.lead("token", j).over(ordered) if j else F.col("token")
    begins = lambda p: F.coalesce(reduce(Column.__and__, [ahead(j) == t for j, t in enumerate(p)]), F.lit(False)).cast("int")
    t = tokens.select("*", *[begins(p).alias(f"a{i}") for i, p in enumerate(phrases)])
    ends = [F.when(F.col(f"a{i}") == 1, F.col("pos") + len(p)) for i, p in enumerate(phrases)]
    return t.withColumns({"far": F.greatest(*ends, F.lit(None).cast("int")) if len(ends) > 1 else ends[0], "last": F.coalesce(*ends[::-1])})


def excerpts(fields: DataFrame, phrases: list[list[str]], key: str = "section_id", size: int = SIZE) -> DataFrame:
    """key, snippet: << >> around matches, which merge where they overlap, and ... where the field is cut.

    ``fields`` has key, field, text. Equal scores: the first field and match. Keys without any match get the beginning of
    field 0; keys without any token in the field that is shown get no row. Null texts and empty phrases match nothing.
    """
    phrases = [p for p in phrases if p] or [["\0"]]
    split = fields.select(key, "field", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), F.split("text", WORD, -1).alias("gaps"))
    each = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("gaps", i).alias("gap")))
    rows = split.select(key, "field", F.size("words").alias("n"), F.element_at("gaps", -1).alias("tail"), F.posexplode(each).alias("pos", "w"))
    by = Window.partitionBy(key, "field").orderBy("pos")
    before, upto, window = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, size - 1)
    t = matched(rows.select(key, "field", "n", "tail", "pos", "w.word", "w.gap", X.fold(F.col("w.word")).alias("token")), phrases, by)
    marks = [F.col(f"a{i}") for i in range(len(phrases))]
    new = F.col("far").isNotNull() & (F.coalesce(F.max("far").over(before), F.lit(0)) <= F.col("pos"))
    score = reduce(Column.__add__, [F.sum(a).over(window) + 999 * F.max(a).over(window) for a in marks])
    t = t.select(
        key, "field", "n", "tail", "pos", "word", "gap", "far", score.alias("score"), F.last("last", True).over(window).alias("until"),
        F.last(F.when(new, F.col("pos")), True).over(upto).alias("run"), (F.max("far").over(upto) > F.col("pos")).alias("inside"), ((F.col("pos") == 0) | F.col("gap").rlike(SENTENCE)).alias("opens"),
    )
    t = t.withColumn("run", F.when(F.col("inside"), F.col("run"))).select("*", F.lead("run").over(by).alias("next"), *[F.last(F.when(F.col("opens"), F.col(c)), True).over(upto).alias(a) for c, a in (("pos", "sentence"), ("score", "sentence_score"))])
    # Integers are cut towards zero.
    middle = F.greatest(F.lit(0), F.least(F.col("pos") - ((size - F.col("until") + F.col("pos")) / 2).cast("int"), F.col("n") - size))
    found = lambda s, first, begin: F.struct(s.cast("long").alias("score"), (-F.col("field")).alias("field"), (-F.col("pos")).alias("pos"), F.lit(first).alias("first"), begin.cast("int").alias("begin"))
    own = F.when(F.col("far").isNotNull(), found(F.col("score"), 1, middle))
    sentence = F.when(F.col("far").isNotNull() & (F.col("n") > size) & (F.col("sentence") < F.col("pos")), found(F.col("sentence_score") + F.when(F.col("sentence") == 0, 120).otherwise(100), 0, F.col("sentence")))
    t = t.withColumn("best", F.max(F.array_max(F.array(own, sentence))).over(Window.partitionBy(key)))
    t = t.withColumns({"begin": F.coalesce("best.begin", F.lit(0)), "shown": F.coalesce(-F.col("best.field"), F.lit(0))}).filter("field = shown").filter(F.col("pos").between(F.col("begin"), F.col("begin") + size - 1))
    marked = F.coalesce(F.col("run") >= F.col("begin"), F.lit(False))
    ends = (F.col("pos") == F.col("begin") + size - 1) | ~F.col("next").eqNullSafe(F.col("run"))
    piece = F.concat(F.when((F.col("begin") > 0) & (F.col("pos") == F.col("begin")), "").otherwise(F.col("gap")), F.when(marked & (F.col("run") == F.col("pos")), "<<").otherwise(""), F.col("word"), F.when(marked & ends, ">>").otherwise(""))
    whole = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"), F.max("begin").alias("begin"), F.max("n").alias("n"), F.max("tail").alias("tail"))
    rest = F.when(F.col("begin") + size >= F.col("n"), F.col("tail")).otherwise("...")
    return whole.select(key, F.concat(F.when(F.col("begin") > 0, "...").otherwise(""), F.array_join("p.piece", ""), rest).alias("snippet"))
