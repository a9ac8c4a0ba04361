"""Markdown sections in the JVM, for the texts whose structure is settled by their lines alone.

Most texts are plain: their headings stand on lines of their own that begin with number signs, outside fenced code. For
these a fold over the few lines that may open or close something finds the headings, and sections are slices of
the array of lines. A text is left to the parser where more has to be known: quotes, underlined headings, headings with
markup or without text, very many headings, and white space other than blanks, tabs and line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Headings up to which anchors are told apart within an array.
MOST_HEADINGS = 300

ODD_SPACE = r"[\x0B\x0C\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
UNSETTLED = rf"(?md)^ {{0,3}}>|^ {{0,3}}(=+|-+)[ \t]*$|{ODD_SPACE}"
MAY_MATTER = r"^ {0,3}(#{1,6}([ \t]|$)|`{3,}|~{3,})"
ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
OPENS = r"^ {0,3}(`{3,}|~{3,})(.*)$"
CLOSES = r"^ {0,3}(`{3,}|~{3,})[ \t]*$"
MARKUP = r"[\\`<\[*_~]"

SECTION = "struct<ordinal:int,heading:string,anchor:string,level:int,body:string>"


def unix(body: Column) -> Column:
    """A text with one kind of line ends."""
    return F.replace(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n"))


def _step(s: Column, x: Column) -> Column:
    """One line: it closes or opens a fence, or is a heading outside of any."""
    run, opened, info = F.regexp_extract(x["line"], CLOSES, 1), F.regexp_extract(x["line"], OPENS, 1), F.regexp_extract(x["line"], OPENS, 2)
    closes = (run != "") & (F.substring(run, 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(run) >= F.length(s["fence"]))
    opens = (opened != "") & ~(opened.startswith("`") & info.contains("`"))
    state = lambda fence, heads: F.struct(fence.alias("fence"), heads.alias("heads"))
    inside = state(F.when(closes, "").otherwise(s["fence"]), s["heads"])
    heading = state(F.lit(""), F.concat(s["heads"], F.array(x)))
    return F.when(s["fence"] != "", inside).when(opens, state(opened, s["heads"])).when(x["line"].rlike(ATX), heading).otherwise(s)


def with_sections(texts: DataFrame, body: str) -> DataFrame:
    """``texts`` with ``settled`` and, where that holds, ``sections``: text before the first heading, if any, and one for each heading."""
    text = texts.withColumn("__text", unix(F.col(body)))
    lines = text.withColumns({"__lines": F.split("__text", "\n", -1), "__plain": ~F.col("__text").rlike(UNSETTLED)}).drop("__text")
    numbered = F.transform("__lines", lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    none = F.expr("cast(array() as array<struct<i:int,line:string>>)")
    few = F.filter(numbered, lambda x: x["line"].rlike(MAY_MATTER))
    heads = F.aggregate(few, F.struct(F.lit("").alias("fence"), none.alias("heads")), _step, lambda s: s["heads"])
    found = lines.withColumn("__found", F.when(F.col("__plain"), heads))
    said = F.transform("__found", lambda h: F.struct(h["i"].alias("i"), stripped(F.regexp_extract(h["line"], ATX, 2)).alias("heading"), F.length(F.regexp_extract(h["line"], ATX, 1)).alias("level")))
    settled = F.col("__plain") & (F.size("__heads") <= MOST_HEADINGS) & ~F.exists("__heads", lambda h: (h["heading"] == "") | h["heading"].rlike(MARKUP))
    told = found.withColumn("__heads", said).withColumn("settled", F.coalesce(settled, F.lit(False)))
    told = told.withColumn("__marks", F.when(F.col("settled"), F.transform("__heads", lambda h: X.anchor(h["heading"]))))
    count = F.size("__heads")
    joined = lambda start, n: stripped(F.array_join(F.slice("__lines", start, n), "\n"))
    at = lambda k: F.coalesce(F.get(F.col("__heads"), k)["i"], F.size("__lines"))
    told = told.withColumn("__before", F.when(F.col("settled"), joined(F.lit(1), at(F.lit(0)))))
    leads = (F.col("__before") != "") | (count == 0)

    def section(h: Column, k: Column) -> Column:
        mark = F.get(F.col("__marks"), k)
        same = F.size(F.filter(F.slice("__marks", F.lit(1), k), lambda m: m == mark))
        return F.struct((k + 1 + leads.cast("int")).alias("ordinal"), h["heading"].alias("heading"), F.when(same > 0, F.concat(mark, F.lit("-"), same.cast("string"))).otherwise(mark).alias("anchor"), h["level"].alias("level"), joined(h["i"] + 2, at(k + 1) - h["i"] - 1).alias("body"))

    first = F.array(F.struct(F.lit(1).alias("ordinal"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("int").alias("level"), F.col("__before").alias("body")))
    empty = F.expr(f"cast(array() as array<{SECTION}>)")
    made = F.concat(F.when(leads, first).otherwise(empty), F.transform("__heads", section)).cast(f"array<{SECTION}>")
    return told.withColumn("sections", F.when(F.col("settled"), made)).drop("__lines", "__plain", "__found", "__heads", "__marks", "__before")
