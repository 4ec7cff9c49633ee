"""Corpus building: best candidate, exact and near de-duplication, vocabulary, encoding, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..storage import cut

LENGTH = 100
SHINGLE = 7
#: Shingles of open rows that one task of the greedy de-duplication settles at a time.
SETTLE = 500_000
#: Entries of a vocabulary that every task may hold (a few megabytes).
VOCABULARY = 100_000


def best_candidate(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Of each key the row with the largest size, the first of these by order; keys whose sizes are all zero or null have none."""
    # partial aggregation keeps hot keys small, where a window would sort the whole group
    return rows.where(F.col(size) > 0).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("*"), F.struct(F.col(size), -F.col(order))).alias("_r")).select("_r.*")


def first_of_each(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row of each distinct text, the first by order; null texts are one text. Orders must be unique.

    Texts are told apart by two 64-bit hashes; only hashes and orders are grouped, and texts are neither sorted nor shuffled for that.
    """
    marked = cut(rows.withColumns({"_h1": F.xxhash64(F.col(text)), "_h2": F.xxhash64(F.lit(1), F.col(text).isNull(), F.col(text))}))
    first = marked.groupBy("_h1", "_h2").agg(F.min(order).alias("_first")).select("_first")
    return marked.join(first, marked[order] == first["_first"], "left_semi").drop("_h1", "_h2")


def shingles(rows: DataFrame, key: str, tokens: str, n: int = SHINGLE) -> DataFrame:
    """Rows (key, pos, h1, h2): every run of n tokens, as two 64-bit hashes."""
    size = F.size(tokens)
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
    # hashed behind the generator, where the text of a run is at hand once, and dropped before anything is shuffled
    return rows.select(key, F.posexplode(grams).alias("pos", "_gram")).select(key, "pos", F.xxhash64("_gram").alias("h1"), F.xxhash64(F.lit(1), "_gram").alias("h2"))


def _shared(grams: DataFrame, key: str) -> DataFrame:
    """Rows (h1, h2, first) of the shingles that more than one row has, with the first of these; the others decide nothing."""
    owners = grams.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.max(key).alias("_last"))
    return owners.where(F.col("first") < F.col("_last")).drop("_last")


def _limit(size):
    return (size - 10) * 4 / 5.0


def near_dedup(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows (key, seen, kept): runs of 7 tokens that some earlier row has too, and whether they are few enough.

    Every earlier row counts, kept or not; rows are ordered by key. The first owner of a shingle comes from an
    aggregate and a join, so that a shingle of very many rows is combined before it is shuffled.
    """
    rows = cut(rows.select(key, tokens))
    grams = cut(shingles(rows, key, tokens).drop("pos"))  # read twice
    seen = grams.join(_shared(grams, key), ["h1", "h2"]).where(F.col("first") < F.col(key)).groupBy(key).agg(F.count("*").alias("seen"))
    return rows.select(key, F.size(tokens).alias("size")).join(seen, key, "left").select(key, F.coalesce("seen", F.lit(0)).alias("seen"), (F.coalesce("seen", F.lit(0)) <= _limit(F.col("size"))).alias("kept"))


def near_dedup_greedy(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows (key, seen, kept) where only kept rows count as earlier ones, as if rows came one by one.

    In each round an open row is settled if it is kept even when all open rows before it are, or dropped even when
    none is; from the second round on the first open rows are also settled one by one, in the order of the key, by
    one task. At least the first open row is settled each time, so that chains of any length come to an end.
    """
    rows = cut(rows.select(key, tokens))
    every = cut(shingles(rows, key, tokens).drop("pos"))
    numbered = cut(_shared(every, key).select("h1", "h2", F.monotonically_increasing_id().alias("shingle")))
    grams = cut(every.join(numbered, ["h1", "h2"]).groupBy(key, "shingle").agg(F.count("*").alias("n")))
    sizes = cut(rows.select(key, F.size(tokens).alias("size")))
    kept, rest = None, sizes
    while True:
        mine = grams.join(rest.select(key), key, "left_semi")
        maybe = mine.groupBy("shingle").agg(F.min(key).alias("maybe"), F.count("*").alias("owners"))
        marked = mine.join(maybe, "shingle")
        if kept is None:
            marked = marked.withColumn("first", F.lit(None).cast(rows.schema[key].dataType))
        else:
            marked = cut(marked.join(_first_owner(grams, kept, key), "shingle", "left"))
        owned, risky = F.coalesce(F.col("first") < F.col(key), F.lit(False)), F.col("maybe") < F.col(key)
        bounds = marked.groupBy(key).agg(F.sum(F.when(owned, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(owned | risky, F.col("n")).otherwise(0)).alias("high"))
        bounds = rest.join(bounds, key, "left").select(key, "size", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(0)).alias("high"))
        sure = F.when(F.col("high") <= _limit(F.col("size")), True).when(F.coalesce(F.col("low") > _limit(F.col("size")), F.lit(True)), False)
        if kept is None:
            told = cut(bounds.select(key, "size", sure.alias("ok")))
        else:
            bounds = cut(bounds)
            left = marked.where(~owned & (F.col("owners") > 1))
            told = cut(bounds.join(_one_by_one(bounds, left, key), key, "left").select(key, "size", F.coalesce("ok", sure).alias("ok")))
        more = told.where("ok").select(key)
        kept = cut(more if kept is None else kept.unionByName(more))
        rest = told.where("ok is null").select(key, "size")
        if rest.isEmpty():
            break
    seen = grams.join(_first_owner(grams, kept, key), "shingle").groupBy(key).agg(F.sum(F.when(F.col("first") < F.col(key), F.col("n")).otherwise(0)).alias("seen"))
    return sizes.join(seen, key, "left").select(key, F.coalesce("seen", F.lit(0)).alias("seen"), (F.coalesce("seen", F.lit(0)) <= _limit(F.col("size"))).alias("kept"))


def _first_owner(grams: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows (shingle, first): the first of the kept rows that have it."""
    return grams.join(kept, key, "left_semi").groupBy("shingle").agg(F.min(key).alias("first"))


def _one_by_one(bounds: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """Rows (key, ok) of the first open rows, by bounds (key, size, low) and their shingles (key, shingle, n) that no kept row before them has.

    As many rows are taken as have about SETTLE such shingles; one task walks through them and holds no more than these.
    """
    total = left.count()
    if total > SETTLE:
        last = bounds.orderBy(key).limit(max(1, bounds.count() * SETTLE // total)).agg(F.max(key)).first()[0]
        bounds, left = bounds.where(F.col(key) <= last), left.where(F.col(key) <= last)
    lists = left.groupBy(key).agg(F.collect_list("shingle").alias("shingles"), F.collect_list("n").alias("ns"))
    ordered = bounds.join(lists, key, "left").select(key, (_limit(F.col("size")) - F.col("low")).alias("room"), "shingles", "ns").repartition(1).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned: set[int] = set()
        for batch in batches:
            ok = []
            for room, grams, ns in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                grams = grams or []
                ok.append(room is not None and sum(n for g, n in zip(grams, ns or [], strict=True) if g in owned) <= room)
                if ok[-1]:
                    owned.update(grams)
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "ok": pa.array(ok, pa.bool_())})

    return ordered.mapInArrow(run, StructType([bounds.schema[key], StructField("ok", BooleanType())]))


def vocabulary(rows: DataFrame, tokens: str, least: int = 1) -> DataFrame:
    """Rows (token, n) of the tokens that occur at least so often."""
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def known_tokens(rows: DataFrame, key: str, tokens: str, vocab: DataFrame, minlen: int = 1) -> DataFrame:
    """Rows (key, tokens, ids): the tokens that the vocabulary (token, id) has, in order and with repeats. Every key stays.

    Tokens shorter than minlen are left out. A vocabulary of up to VOCABULARY entries is a model that every task holds, and its
    tokens are looked up in whole Arrow columns; a larger one is joined.
    """
    vocab = vocab.where(F.col("token").isNotNull() & (F.length("token") >= minlen)).select("token", F.col("id").cast("int").alias("id"))
    if vocab.limit(VOCABULARY + 1).count() > VOCABULARY:
        return _joined_tokens(rows, key, tokens, vocab)
    table = vocab.toArrow().combine_chunks()
    sent = rows.sparkSession.sparkContext.broadcast((table.column("token").combine_chunks(), table.column("id").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=words)
            known = pc.is_valid(at)
            upto = np.concatenate(([0], np.cumsum(known.to_numpy(zero_copy_only=False))))
            offsets = pa.array(upto[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat.filter(known).cast(pa.string())), pa.ListArray.from_arrays(offsets, numbers.take(at.filter(known)).cast(pa.int32()))], names=[key, "tokens", "ids"])

    schema = StructType([rows.schema[key], StructField("tokens", ArrayType(StringType())), StructField("ids", ArrayType(IntegerType()))])
    return rows.select(key, tokens).mapInArrow(run, schema)


def _joined_tokens(rows: DataFrame, key: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """The same with a vocabulary of any size."""
    rows = cut(rows.select(key, tokens))
    words = rows.select(F.col(key).alias("_key"), F.posexplode(tokens).alias("_pos", "_token"))
    known = words.join(vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id")), "_token")
    lists = known.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_pos", "_token", "_id"))).alias("_l"))
    joined = rows.select(F.col(key).alias("_key")).join(lists, "_key", "left")
    empty = F.array()
    return joined.select(F.col("_key").alias(key), F.coalesce(F.col("_l._token"), empty.cast("array<string>")).alias("tokens"), F.coalesce(F.col("_l._id"), empty.cast("array<int>")).alias("ids"))


def padded(ids, length: int = LENGTH):
    """Ids cut or filled with zeros to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def coverage(rows: DataFrame, tokens: str, vocab: DataFrame) -> DataFrame:
    """One row (total, known): all tokens, and those in the vocabulary."""
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(vocab.select("token", F.lit(1).alias("hit")), "token", "left").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("known"))


def one_hot(label, classes: int = 2):
    return F.when(label.isNotNull(), F.array(*[F.when(label == k, 1.0).otherwise(0.0) for k in range(classes)]))


def labelled_union(spam: DataFrame, ham: DataFrame, spam_held: DataFrame, ham_held: DataFrame) -> DataFrame:
    """Four sources as one table with label (0 spam, 1 ham) and split."""
    parts = ((spam, 0, "train"), (ham, 1, "train"), (spam_held, 0, "validation"), (ham_held, 1, "validation"))
    out = None
    for rows, label, split in parts:
        rows = rows.withColumns({"label": F.lit(label), "split": F.lit(split)})
        out = rows if out is None else out.unionByName(rows)
    return out


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds position, from 1: the place of each row in an order that depends on key and seed only. Keys must be unique.

    Rows are ranked within the 4,096 blocks of their hash, and a block's offset is the number of rows before it.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 3))
    sums = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return hashed.join(F.broadcast(offsets), "_b").withColumn("position", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_o")).drop("_h", "_b", "_o")


def file_boundaries(lines: DataFrame, file: str, no: str, line: str) -> DataFrame:
    """Adds msg_no, counted from 1 in each file: a line that starts with 'From ' begins a message unless it stands among headers.

    Headers reach from such a line to the next blank one. A file is one window partition; split large files with
    lettermill.sources.mbox instead.
    """
    upto = Window.partitionBy(file).orderBy(no)
    event = F.when(F.startswith(F.col(line), F.lit("From ")), "F").when(F.trim(F.regexp_replace(line, r"\s", "")) == "", "B")
    before = F.last("_ev", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("_ev", event).withColumn("_at", F.when((F.col("_ev") == "F") & (F.coalesce(before, F.lit("B")) == "B"), 1).otherwise(0))
    lead = F.first("_at").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return marked.withColumn("msg_no", F.sum("_at").over(upto.rowsBetween(Window.unboundedPreceding, 0)) + (1 - lead)).drop("_ev", "_at")
