"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of one's own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_lettermill_dir"):
        spark._lettermill_dir = "file://" + tempfile.mkdtemp(prefix="lettermill-")
    return spark._lettermill_dir


def fresh_path(spark: SparkSession) -> str:
    """A new place in the shared folder, as a full URI, that clear() will delete."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lettermill-{uuid.uuid4().hex}")
    path = full_uri(spark, place)
    spark.__dict__.setdefault("_lettermill_tables", []).append(path)
    return path


def full_uri(spark: SparkSession, place) -> str:
    """A Hadoop path with its scheme, in the form that pyarrow reads too."""
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def cut(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back, so that later steps neither repeat what made it nor depend on executors that may be lost."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if they come in fewer partitions; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clear(spark: SparkSession) -> None:
    """Delete the tables that this session's cuts have written; results that still depend on them can no longer be read."""
    for path in spark.__dict__.pop("_lettermill_tables", []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
