"""Scores to verdicts and points, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each verdict. Fixed values; dunno and toosmall have none.
POINTS = {"ham": -3, "maybeham": -2, "20ham": -1, "spam": 6, "maybespam": 4, "80spam": 2}
LEAST_KNOWN = 10


def percent(spam: Column, ham: Column) -> Column:
    """Share of the spam output in percent; 50 if it is no number between 0 and 100."""
    value = F.try_divide(spam * 100, spam + ham)
    return F.when(value.between(0, 100), value).otherwise(50.0)


def online_bucket(score: Column, known: Column) -> Column:
    """Verdict of the mail filter for a raw score and the number of known tokens."""
    s = score + 0.1
    return (
        F.when(known < LEAST_KNOWN, "toosmall").when(s < 2, "ham").when(s < 10, "maybeham").when(s < 20, "20ham")
        .when(s > 98, "spam").when(s > 90, "maybespam").when(s > 80, "80spam").otherwise("dunno")
    )


def online_verdict(score: Column, known: Column) -> Column:
    bucket = online_bucket(score, known)
    return F.when(bucket == "toosmall", bucket).otherwise(F.concat(bucket, F.lit(" "), (score + 0.1).cast("int").cast("string"), F.lit("%")))


def batch_verdict(score: Column, known: Column) -> Column:
    """Verdict of the offline sorter, whose borders and names differ."""
    s = score + 0.1
    n = s.cast("int").cast("string")
    return (
        F.when(known < LEAST_KNOWN, "toosmall").when(s <= 10, F.concat(F.lit("ham-"), n)).when(s < 20, "ham-maybe")
        .when(s >= 90, F.concat(F.lit("spam-"), n)).when(s > 80, "spam-maybe").otherwise("dunno")
    )


def with_points(rows: DataFrame, bucket_col: str) -> DataFrame:
    """Adds points: those of the bucket, null where no rule matches."""
    rules = rows.sparkSession.createDataFrame(sorted(POINTS.items()), "rule string, points int")
    return rows.join(F.broadcast(rules), F.lower(rows[bucket_col]) == rules.rule, "left").drop("rule")


def log_line(score: Column, tokens: Column) -> Column:
    """A line of the score log: the score in three places, then the tokens."""
    return F.concat(F.lpad(score.cast("int").cast("string"), 3, " "), F.lit("%:"), F.array_join(tokens, " "))


def parse_log_line(line: Column) -> Column:
    """The struct (score, tokens) of such a line; null if it has no score."""
    parts = F.split(line, ":", 2)
    score = F.trim(F.replace(parts[0], F.lit("%"), F.lit(""))).try_cast("int")
    return F.when(score.isNotNull() & (F.size(parts) == 2), F.struct(score.alias("score"), F.split(parts[1], " ").alias("tokens")))
