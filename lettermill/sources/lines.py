"""Text lines: plain, labelled, with directives; the score log; confusables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import log_line, parse_log_line
from .mbox import write_raw


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line) of UTF-8 text; bytes that cannot be decoded are dropped."""
    return spark.read.text(path).select(F.regexp_replace("value", "�", "").alias("line"))


def read_labelled(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Rows (tokens, label) of lines of tokens."""
    return read_lines(spark, path).select(F.split(F.trim("line"), " ").alias("tokens"), F.lit(label).alias("label"))


def pass_directives(line, tokens):
    """The trimmed line if it starts with a colon, else its tokens joined by blanks."""
    return F.when(F.startswith(line, F.lit(":")), F.trim(line)).otherwise(F.array_join(tokens, " "))


def write_tokens(rows: DataFrame, tokens: str, path: str) -> None:
    """One line of tokens for each row."""
    rows.select(F.array_join(tokens, " ").alias("value")).write.mode("append").text(path)


def append_score_log(rows: DataFrame, score: str, tokens: str, path: str, compression: str = "gzip") -> None:
    """Lines of the score log, added to a folder; compression is zstd, or one that text files offer."""
    lines = rows.select(log_line(F.col(score), F.col(tokens)).alias("value"))
    if compression != "zstd":
        lines.write.mode("append").option("compression", compression).text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            text = "".join(f"{t}\n" for t in batch.column(0).to_pylist() if t is not None)
            # frames may follow each other in one file
            yield pa.RecordBatch.from_pydict({"box": pa.array([""]), "raw": pa.array([zstandard.ZstdCompressor().compress(text.encode())], pa.binary())})

    write_raw(lines.mapInArrow(run, "box string, raw binary"), path, ".zst")


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (value) of the lines of zstd files under a path. Of a file, a few megabytes of text are held at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zst").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for data in batch.column(0).to_pylist():
                with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
                    rest = b""
                    while chunk := stream.read(4 << 20):
                        *lines, rest = (rest + chunk).split(b"\n")
                        yield pa.RecordBatch.from_pydict({"value": pa.array([x.decode("utf-8", "ignore") for x in lines], pa.string())})
                    if rest:
                        yield pa.RecordBatch.from_pydict({"value": pa.array([rest.decode("utf-8", "ignore")], pa.string())})

    return files.mapInArrow(run, "value string")


def read_score_log(spark: SparkSession, path: str, compression: str | None = None) -> DataFrame:
    """Rows (score, tokens) of the lines of a score log that have a score; compression goes by the files' ending, but zstd must be named."""
    lines = read_zstd_lines(spark, path) if compression == "zstd" else spark.read.text(path)
    return lines.select(parse_log_line(F.col("value")).alias("l")).where("l is not null").select("l.*")


#: Entries of a table of confusables; Unicode has about 150,000 characters.
CONFUSABLES = 200_000


def read_confusables(spark: SparkSession, path: str) -> dict[str, str]:
    """A map of characters to what they are folded to, from lines 'char TAB replacement', for lettermill.functions.text.fold."""
    rows = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).where("size(p) = 2 and length(p[0]) = 1")
    found = {r[0]: r[1] for r in rows.select(F.col("p")[0], F.col("p")[1]).limit(CONFUSABLES + 1).collect()}
    if len(found) > CONFUSABLES:
        raise ValueError(f"more than {CONFUSABLES} confusables in {path}")
    return found


def route(rows: DataFrame, verdict: str, path: str) -> None:
    """Rows in one folder for each verdict."""
    rows.write.mode("append").partitionBy(verdict).parquet(path)
