"""HTML to text by relational steps: split at tags, running counters of style and script, ordered rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Patterns that results depend on. Fixed values.
COMMENT = r"(?s)<!--(?:>|->|.*?-->)"
OPEN_COMMENT = r"(?s)<!--.*"
WHITE = r"[^-]color:#ffff*[^0-9a-f]"
TINY = r"font-size:[0-5]px"
BREAKS = ["p", "br", "td", "div", "li"]
STYLED = ["p", "span", "div"]
MARKS = ["<body", "<img", "<style", "<center", "<a href"]


def is_html(text, ctype=None):
    """Whether a part is HTML: by its type, or by one of a few tags in it."""
    low = F.lower(text)
    found = F.contains(low, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        found = found | F.contains(low, F.lit(mark))
    return found if ctype is None else F.lower(ctype).isin("text/html", "text/xml") | found


def cut_head(text):
    """The text from its body tag on, if it has one behind the start."""
    at = F.instr(F.lower(text), "<body")
    return F.when(at > 1, F.substr(text, at)).otherwise(text)


def html_to_text(rows: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rows (id, text): visible text, with marks for comments and hidden styles. A null stays null; ids must be unique.

    All rows of a text meet in one window partition, whose size is that of the text.
    """
    source = rows.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    plain = F.regexp_replace(F.regexp_replace(F.col("html"), COMMENT, " HTMLcomment "), OPEN_COMMENT, "")
    chunks = source.where("html is not null").select("id", F.posexplode(F.split(plain, "<", -1)).alias("pos", "chunk"))
    tagged = F.contains(F.col("chunk"), F.lit(">"))
    tag = F.when(tagged, F.substring_index("chunk", ">", 1))
    name = F.lower(F.regexp_extract(F.col("tag"), r"^\s*(\S+)", 1))
    rest = F.when(F.col("tag").isNotNull(), F.expr("substring(chunk, length(tag) + 2)")).otherwise(F.col("chunk"))
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = lambda t: F.sum(F.when(F.col("name") == t, 1).when(F.col("name") == f"/{t}", -1).otherwise(0)).over(upto)
    parsed = chunks.withColumn("tag", tag).withColumn("name", name).withColumn("rest", rest)
    counted = parsed.withColumn("style", depth("style")).withColumn("script", depth("script"))
    low = F.concat(F.lower("tag"), F.lit(";"))  # the end of the tag ends a colour
    styled = F.col("name").isin(STYLED)
    marks = F.concat(
        F.when(styled & low.rlike(WHITE), "\nHTMLhiddenWHITE:").otherwise(""),
        F.when(styled & low.rlike(TINY), "\nHTMLhiddenFONTSIZE:").otherwise(""),
        F.when(F.col("name").isin(BREAKS), "\n").otherwise(""),
    )
    visible = (F.col("style") <= 0) & (F.col("script") <= 0)
    piece = F.when(F.col("tag").isNull(), F.col("rest")).when(visible, F.concat(marks, "rest")).otherwise("")
    texts = counted.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x.piece), "").alias("text"))
    return source.select("id").join(texts, "id", "left")
