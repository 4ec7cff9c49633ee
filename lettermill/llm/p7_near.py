"""Near-duplicate records, by tensored banding of minhashes.

Two collections of m small hashes, each of r minhashes, are combined: table (i, j) is keyed by hash i of the
first and hash j of the second, so that m * m tables cost 2 * m * r minhashes. Records that meet in a table are
candidates; their exact similarity decides.

The tables are never written out: a record is sent once for each hash of the first collection, with all its hashes of
the second, and the task that holds a bucket combines the two. Only the members of large buckets are sent by the
combined key, and buckets that are large even then are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, map_arrow
from .tokensets import bitmaps, classes, distinct, distinct_sorted, may_be_alike, records, token_hashes, trigrams

#: Hashes of each collection, and minhashes of each hash. A pair of similarity s meets with probability
#: (1 - (1 - s**ROWS)**SIDE)**2: 0.965 at 0.5, 0.995 at 0.6, 0.9998 at 0.7.
SIDE, ROWS = 14, 2
#: Members of a bucket that one task combines; those of larger ones are sent by the combined key.
BUCKET = 4000
#: Members of one block of a bucket that is large even so; blocks are compared two by two, each pair of blocks in a task of its own.
BLOCK = 2000
#: Members, and pairs, that a task works on at a time.
MEMBERS, PAIRS = 20_000, 1 << 20


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, n, np.int64).astype(np.uint64)


def signatures(grams: np.ndarray, starts: np.ndarray, side: int, rows: int, collections: int = 2, seed: int = 7) -> np.ndarray:
    """Small hashes (collections x side x records); every record must have a gram."""
    n = len(starts) - 1
    mult, add = _constants(collections * side * rows, seed)
    out = np.zeros((collections, side, n), np.uint64)
    k = 0
    for c in range(collections):
        for i in range(side):
            for _ in range(rows):
                h = grams * mult[k] + add[k]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                least = np.minimum.reduceat(h, starts[:-1])
                out[c, i] = (out[c, i] ^ least) * np.uint64(0x9E3779B97F4A7C15)
                out[c, i] ^= out[c, i] >> np.uint64(29)
                k += 1
    return out


def _sketches(reps: DataFrame, side: int, rows: int) -> DataFrame:
    """Rows (rep, first, rest) of records (rep, tokens): the small hashes of the first collection, and, packed, what candidates are told by (see _unpacked)."""

    def run(batch: pa.RecordBatch) -> dict:
        hashes, starts = token_hashes(batch.column(1))
        grams, at = distinct_sorted(*trigrams(hashes, starts))
        sig = signatures(grams, at, side, rows)
        n = len(batch)
        first = np.ascontiguousarray((sig[0] >> np.uint64(32)).T.astype(np.uint32)).view(np.int32).ravel()
        # 16 bits of the second hashes do, as the first ones are compared whole
        parts = (np.diff(at).astype(np.uint32)[:, None], np.ascontiguousarray((sig[1] >> np.uint64(48)).T.astype(np.uint16)), bitmaps(grams, at))
        rest = np.concatenate([x.view(np.uint8).reshape(n, -1) for x in parts], 1)
        return {"rep": batch.column(0), "first": pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * side).astype(np.int32)), pa.array(first)), "rest": pa.array([r.tobytes() for r in rest], pa.binary())}

    return map_arrow(reps.select("rep", "tokens"), run, "rep long, first array<int>, rest binary")


def _unpacked(column: pa.ChunkedArray | pa.Array, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each record the number of its trigrams, the small hashes of the second collection, and the bitmap."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    cut_at = lambda a, b, kind: np.ascontiguousarray(data[:, a:b]).view(kind)
    return cut_at(0, 4, np.uint32).astype(np.int64).ravel(), cut_at(4, 4 + 2 * side, np.uint16), cut_at(4 + 2 * side, data.shape[1], np.uint64)


def _triangles(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within runs, some runs at a time."""
    for n in distinct(size):
        at = first[size == n]
        i, j = np.triu_indices(n, 1)
        turn = max(1, PAIRS // len(i))
        for k in range(0, len(at), turn):
            yield (at[k : k + turn, None] + i).ravel(), (at[k : k + turn, None] + j).ravel()


def _meeting(key: np.ndarray, rep: np.ndarray, rest: pa.Array, side: int, threshold: float, combined: bool) -> pa.RecordBatch:
    """Distinct candidates (a, b) among members of whole buckets, in order of their keys, that meet in a table and are not ruled out.

    A key is that of a bucket of the first collection, or, if combined, that of a table.
    """
    total, second, bits = _unpacked(rest, side)
    if combined:
        sub, member = key, np.arange(len(key))
    else:
        table = table_keys(key.view(np.uint64)[:, None], second.astype(np.uint64), np.arange(side, dtype=np.uint64)[None, :]).view(np.int64)
        order = np.argsort(table.ravel())
        sub, member = table.ravel()[order], order // side
    first = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1]))) if len(sub) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(sub)))
    found, held = [np.zeros(0, np.int64)], 0
    for i, j in _triangles(first[size > 1], size[size > 1]):
        x, y = member[i], member[j]
        near = may_be_alike(total[x], total[y], bits[x], bits[y], threshold)
        x, y = x[near], y[near]
        found.append(np.minimum(x, y) * np.int64(len(key)) + np.maximum(x, y))
        held += len(x)
        if held > 8 * PAIRS:  # a pair that meets in several tables is kept once
            found, held = [distinct(np.concatenate(found))], 0
    pair = distinct(np.concatenate(found))
    x, y = rep[pair // max(1, len(key))], rep[pair % max(1, len(key))]
    both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0) if len(pair) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def _meet(rows: DataFrame, side: int, threshold: float, combined: bool) -> DataFrame:
    """Candidates (a, b) of the buckets of rows (key, rep, rest), none of which is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < MEMBERS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if last:
                yield _meeting(key[:last], table.column(1).to_numpy()[:last], table.column(2).slice(0, last), side, threshold, combined)
                held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield _meeting(table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2), side, threshold, combined)

    return rows.select("key", "rep", "rest").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _by_size(rows: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the buckets of at most so many members, and those of the larger ones; sizes are counted before anything is sent."""
    large = hinted(cut(rows.groupBy("key").count().where(F.col("count") > bucket).select("key")), 16)
    return rows.join(large, "key", "left_anti"), rows.join(large, "key", "left_semi")


def _crowded(rows: DataFrame, sketches: DataFrame, side: int, threshold: float) -> DataFrame:
    """Candidates (a, b) of the large tables' buckets (key, rep): pairs that meet in no earlier table and are not ruled out.

    A pair that meets in many large buckets comes out of the first alone, and nothing is left out: an earlier table
    with a small bucket has given the pair already.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = rows.select("key", "rep").join(sizes, "key").select("key", "rep", mine.alias("mine"), other.alias("other"))
    placed = spread.select("key", "rep", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    full = placed.join(sketches, "rep")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, block = table.column("rep").to_numpy(), table.column("mine").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        total, second, bits = _unpacked(table.column("rest"), side)
        firsts = table.column("first").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(len(rep), side)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in left.tolist():
            others = right[rep[right] > rep[k]] if x == y else right
            others = others[may_be_alike(total[others], total[k], bits[others], bits[k], threshold)]
            a.append(np.full(len(others), k))
            b.append(others)
        a, b = np.concatenate(a), np.concatenate(b)
        # both share this bucket's hashes; the first table in which they meet has the first equal hash of either collection
        i, j = (firsts[a] == firsts[b]).argmax(1), (second[a] == second[b]).argmax(1)
        bucket = first_keys(i, firsts[a, i])
        keep = table_keys(bucket.view(np.uint64), second[a, j].astype(np.uint64), j.astype(np.uint64)).view(np.int64) == np.int64(table.column("key")[0].as_py())
        a, b = rep[a[keep]], rep[b[keep]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return full.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def first_keys(number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Keys of the buckets of the first collection, from a hash's number and value."""
    return (number.astype(np.int64) << 32) | value.astype(np.int64)


def table_keys(first: np.ndarray, second: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Keys of tables from a bucket of the first collection, and a hash of the second with its number."""
    h = (first * np.uint64(0x9FB21C651E98DF25)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (table * np.uint64(0xA24BAED4963EE407))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def similar_classes(reps: DataFrame, threshold: float, side: int = SIDE, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """Rows (a, b, similarity), a < b, of records (rep, tokens) whose sets of token trigrams have at least the given similarity."""
    sketches = cut(_sketches(reps, side, rows))
    hashed = sketches.select("rep", "rest", F.posexplode("first").alias("i", "u"))
    sent = hashed.select(((F.col("i").cast("long") * F.lit(1 << 32)) + F.col("u").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), "rep", "rest")
    small, large = _by_size(sent, bucket)

    def combine(batch: pa.RecordBatch) -> dict:
        key, (_, second, _) = batch.column(0).to_numpy(), _unpacked(batch.column(2), side)
        keys = table_keys(key.view(np.uint64)[:, None], second.astype(np.uint64), np.arange(side, dtype=np.uint64)[None, :]).view(np.int64)
        again = pa.array(np.repeat(np.arange(len(key)), side))
        return {"key": pa.array(keys.ravel()), "rep": batch.column(1).take(again), "rest": batch.column(2).take(again)}

    sparse, dense = _by_size(map_arrow(large.select("key", "rep", "rest"), combine, "key long, rep long, rest binary"), bucket)
    met = _meet(small, side, threshold, False).unionByName(_meet(sparse, side, threshold, True)).unionByName(_crowded(dense, sketches, side, threshold))
    both = cut(met.distinct())
    # only the records of some candidate are read again
    needed = both.select(F.col("a").alias("rep")).unionByName(both.select(F.col("b").alias("rep"))).distinct()

    def grams(batch: pa.RecordBatch) -> dict:
        values, at = distinct_sorted(*trigrams(*token_hashes(batch.column(1))))
        return {"rep": batch.column(0), "grams": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))}

    sets = cut(map_arrow(reps.join(needed, "rep", "left_semi").select("rep", "tokens"), grams, "rep long, grams array<long>"))
    joined = both.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return joined.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def _train(corpus: DataFrame, least: int) -> DataFrame:
    return records(corpus.where("split = 'train'"), least)


def near_pairs(corpus: DataFrame, threshold: float = 0.5, least: int = 20) -> DataFrame:
    """Rows (id_a, id_b), id_a < id_b: records of the training split with at least that similarity.

    Records of fewer than `least` tokens, null lists and null ids give no row; rows with one id count as one
    record; records without tokens in common are never alike; exact copies are paired by their class.
    """
    members, reps = classes(_train(corpus, least))
    reps = cut(reps)
    return expand(members, similar_classes(reps, threshold))


def expand(members: DataFrame, alike: DataFrame) -> DataFrame:
    """Pairs of ids from members (id, rep) and pairs of classes (a, b)."""
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    linked = alike.select("a", "b").unionByName(members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    return linked.join(left, "a").join(right, "b").where("x <> y and (a <> b or x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b): each node of edges (a, b) but the least of its component, and that least node.

    Nodes are hung on the least neighbour in turn, the larger neighbours of each and then the smaller ones, until all hang on nodes that hang on none.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        hung = edges.select("a").intersect(edges.select("b"))
        if hung.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            return edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def near_groups(corpus: DataFrame, threshold: float = 0.5, least: int = 20) -> DataFrame:
    """Rows (id, group_id, class_id, copies, links): each record's group, its class of copies, its size, and the number of other classes that are alike.

    Groups are the connected components of the alike classes, named by their least id: two records of a group are
    linked by a chain of alike records, and may be less alike themselves.
    """
    members, reps = classes(_train(corpus, least))
    reps = cut(reps)
    alike = cut(similar_classes(reps, threshold))
    groups = components(alike.select("a", "b")).select(F.col("a").alias("rep"), F.col("b").alias("group_id"))
    links = alike.select(F.col("a").alias("rep")).unionByName(alike.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return members.join(copies, "rep").join(links, "rep", "left").join(groups, "rep", "left").select("id", F.coalesce("group_id", "rep").alias("group_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
