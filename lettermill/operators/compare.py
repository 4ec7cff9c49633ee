"""Two models' scores against each other: classes of change, counters, running shares, large changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of one block of the running totals.
BLOCK = 1 << 16


#: A sentence whose lines are left out of comparisons. Fixed value.
IGNORED = "sajnalom de rossz hirem van szamodra ! egy par honappal ezelott"


def comparable(rows: DataFrame, tokens: str, order: str, ignored: str = IGNORED) -> DataFrame:
    """The lines that a comparison counts: without those that hold the ignored sentence, and of equal lines the first by order.

    Lines are told apart by two 64-bit hashes of their text. Null tokens count as an empty line; orders must be unique.
    """
    text = F.coalesce(F.array_join(tokens, " "), F.lit(""))
    kept = rows.where(~F.contains(text, F.lit(ignored)))
    first = kept.groupBy(F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")).agg(F.min(order).alias("_first")).select("_first")
    return kept.join(first, kept[order] == first["_first"], "left_semi")


def compared(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Adds diff = old - new and change: '+' ham to spam, '-' spam to ham, '?' and '!' at the outer borders, else blank."""
    o, n = F.col(old), F.col(new)
    change = (
        F.when((o <= 20) & (n >= 80), "+").when((n <= 20) & (o >= 80), "-").when((o < 2) & (n >= 2), "?")
        .when((n < 2) & (o >= 2), "!").when((o >= 98) & (n < 98), "?").when((n >= 98) & (o < 98), "!").otherwise(" ")
    )
    return rows.withColumns({"diff": o - n, "change": change})


def counters(rows: DataFrame) -> DataFrame:
    """One row (total, changed, to_spam, to_ham) of compared rows."""
    hits = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.agg(F.count("*").alias("total"), F.coalesce(hits(F.col("diff") != 0), F.lit(0)).alias("changed"), F.coalesce(hits(F.col("change") == "+"), F.lit(0)).alias("to_spam"), F.coalesce(hits(F.col("change") == "-"), F.lit(0)).alias("to_ham"))


def running(rows: DataFrame, order: str) -> DataFrame:
    """Adds total, changed, crossed and their percentages as of each row, by a unique order.

    Blocks of the order are summed first, and only these sums are totalled in one place; within a block a
    window runs on its own. So no task holds more than a block or the list of blocks.
    """
    flags = rows.withColumns({"_c": F.when(F.col("diff") != 0, 1).otherwise(0), "_x": F.when(F.col("change").isin("+", "-"), 1).otherwise(0), "_b": F.floor(F.col(order) / BLOCK)})
    sums = flags.groupBy("_b").agg(F.count("*").alias("n"), F.sum("_c").alias("c"), F.sum("_x").alias("x"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}0") for k in "ncx"])
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = flags.join(offsets, "_b").withColumns({"total": F.count("*").over(within) + F.col("_n0"), "changed": F.sum("_c").over(within) + F.col("_c0"), "crossed": F.sum("_x").over(within) + F.col("_x0")})
    share = lambda c: F.floor(F.lit(100) * F.col(c) / F.col("total")).cast("int")
    return out.withColumns({"changed_pct": share("changed"), "crossed_pct": share("crossed")}).drop("_b", "_c", "_x", "_n0", "_c0", "_x0")


def large_changes(rows: DataFrame, tokens: str, least: int = 20, width: int = 120) -> DataFrame:
    """Rows whose scores differ by more than `least`, with the first `width` characters of their tokens as text."""
    return rows.where(F.abs("diff") > least).withColumn("text", F.substring(F.array_join(tokens, " "), 1, width))
