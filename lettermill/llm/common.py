"""What the operators of this subpackage share: tables, lineage cuts, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, fresh_path

__all__ = ["cut", "fresh_path", "hinted", "is_plain", "map_arrow", "small", "table"]

#: Tables whose rows take long to work on, so that a single small file should not be one task.
WORKED = {"documents", "mail_corpus", "score_log", "mime_parts"}
#: Bytes of the rows that a Python function is given at a time.
SLICE_BYTES = 1 << 20
#: Largest table, in bytes as counted row by row, that is ever broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder, with only the named columns, over all cores if it comes in fewer partitions."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in WORKED and df.rdd.getNumPartitions() < cores else df


def is_plain(ctype: str = "ctype"):
    """Whether a content type is text/plain, whatever its case or parameters."""
    return F.lower(F.trim(F.substring_index(F.col(ctype), ";", 1))) == "text/plain"


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply f to slices of about a megabyte of each Arrow batch; it returns the columns of schema as arrays."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(f(batch.slice(at, rows)))

    return df.mapInArrow(over, schema)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table of rows of at most row_bytes stays below the limit for broadcasts (counts no further than that)."""
    return df.limit(limit // row_bytes + 1).count() <= limit // row_bytes


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """The table, marked for broadcast if its counted size allows that; else joins shuffle it."""
    return F.broadcast(df) if small(df, row_bytes) else df
