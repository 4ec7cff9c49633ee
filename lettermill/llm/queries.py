"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import is_plain, table
from .p1_language import mislabelled, segments
from .p2_splits import matched_spans, overlap_counts, overlaps
from .p3_personal import personal, redacted
from .p4_quotes import newly_written, not_written
from .p5_encoding import garbled_documents, garbled_parts, sent_model
from .p6_markup import cleaned, with_markup
from .p7_near import near_groups, near_pairs
from .p8_packing import fill, pack
from .p9_leaks import leaks
from .p10_spans import shared_share, shared_spans, sharing_documents


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "ctype").where(is_plain())
    return mislabelled(docs, table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "ctype").where(is_plain())
    return segments(docs, table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mail_corpus", "id", "tokens", "split", "source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_corpus(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_counts(_corpus(spark, sf_dir))


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_spans(_corpus(spark, sf_dir))


def _personal_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "ctype").where(is_plain()).select(F.col("doc_id").alias("row_id"), "text")
    log = table(spark, sf_dir, "score_log", "line_no", "tokens").withColumnRenamed("line_no", "row_id")
    return docs, log, table(spark, sf_dir, "name_list", "name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(*_personal_inputs(spark, sf_dir), table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(*_personal_inputs(spark, sf_dir), table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "ctype").where(is_plain())
    return not_written(docs, table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))


def p4_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "ctype").where(is_plain())
    return newly_written(docs, table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))


def _garbled(spark: SparkSession, sf_dir: str, texts_too: bool) -> DataFrame:
    samples = sent_model(table(spark, sf_dir, "lang_samples", "lang", "sample_no", "text"))
    docs = garbled_documents(table(spark, sf_dir, "documents", "doc_id", "text"), samples, texts_too=texts_too)
    return docs.unionByName(garbled_parts(table(spark, sf_dir, "mime_parts", "msg_no", "part_no", "ctype", "charset", "payload"), samples, texts_too=texts_too))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir, False).select("tbl", "row_id", "part_no").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir, True).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_markup(table(spark, sf_dir, "documents", "doc_id", "text"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_corpus(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_corpus(spark, sf_dir))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text", "n_tok"), table(spark, sf_dir, "pack_spec", "spec_id", "capacity"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p8_pack(spark, sf_dir), table(spark, sf_dir, "pack_spec", "spec_id", "capacity"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "heldout_items", "item_id", "text"), width=12, edits=1, sampled=4, recall=0.9)
    return found.where("whole").select("doc_id", "item_id")  # the exact check of the query


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "heldout_items", "item_id", "text"), width=16, edits=1, sampled=6, recall=0.95).select("doc_id", "item_id", "whole")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_found, p8_pack, p9_found, p10_found)
    more = (p1_segments, p2_counts, p2_spans, p3_redacted, p4_written, p5_restored, p6_clean, p7_groups, p8_fill, p9_near, p10_spans, p10_share)
    return {f.__name__: f for f in (*found, *more)}


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
