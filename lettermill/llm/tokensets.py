"""Records as token lists: classes of exact copies, and trigrams as hashed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def records(corpus: DataFrame, least: int, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Rows (id, tokens, k1, k2) of the records with at least `least` tokens, three at any rate; null tokens in a list are dropped first.

    k1 and k2 are the two halves of a 128-bit hash of the tokens, so that copies are found without comparing or sorting texts.
    """
    tokens = F.filter(F.col(tokens_col), lambda t: t.isNotNull())
    kept = corpus.where(F.col(id_col).isNotNull()).withColumn("_t", tokens).where(F.size("_t") >= max(least, 3))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col("_t").alias("tokens"), F.xxhash64("_t").alias("k1"), F.xxhash64(F.lit(1), "_t").alias("k2"), *[c for c in ("split", "source") if c in corpus.columns])


def classes(rows: DataFrame, *also: str, **of_class: Column) -> tuple[DataFrame, DataFrame]:
    """Exact copies of records: members (id, rep and the named columns), and one record (rep, tokens, and the aggregates of_class over its members) of each class.

    Only hashes and ids are grouped; the tokens of the chosen rows are fetched at the end. Repeated rows are one member.
    """
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.groupBy("k1", "k2", "id", *also).agg(F.min("row").alias("row"))
    firsts = each.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    named = cut(each.join(firsts, ["k1", "k2"]).select("id", "rep", "row", *also))
    chosen = named.groupBy("rep").agg(F.min(F.when(F.col("id") == F.col("rep"), F.col("row"))).alias("row"), *(c.alias(k) for k, c in of_class.items()))
    return named.select("id", "rep", *also).distinct(), rows.join(chosen, "row").select("rep", "tokens", *of_class)


def token_hashes(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of a list column, and where each list starts (with the end as last entry)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(t or "") for t in coded.dictionary.to_pylist()], np.uint64)
    return hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64), starts


def trigrams(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams of each list, and where each list's start (lists of fewer than three tokens have none)."""
    a, b, c = (np.uint64(m) for m in MULTIPLIERS)
    if len(hashes) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    h = hashes[:-2] * a + np.bitwise_xor(hashes[1:-1] * b, hashes[1:-1] >> np.uint64(31)) + np.bitwise_xor(hashes[2:] * c, hashes[2:] >> np.uint64(29))
    h ^= h >> np.uint64(32)
    ends = np.repeat(starts[1:], np.diff(starts))[: len(h)]
    valid = np.arange(len(h)) + 3 <= ends
    sizes = np.maximum(np.diff(starts) - 2, 0)
    return h[valid], np.concatenate(([0], np.cumsum(sizes)))


def distinct_sorted(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list's distinct values in order, and where each list starts."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1]))) if len(v) else np.zeros(0, bool)
    return v[keep], np.concatenate(([0], np.cumsum(np.bincount(o[keep], minlength=len(starts) - 1))))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (which is many times faster than hashing for 64-bit integers)."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


#: Bits of the bitmaps of trigram sets.
BITMAP = 512


def bitmaps(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A bitmap (lists x words) of each list: each value sets one bit, so where two sets differ in few values, few bits differ."""
    n = len(starts) - 1
    bits = np.zeros(n * BITMAP, bool)
    bits[np.repeat(np.arange(n), np.diff(starts)) * BITMAP + (grams >> np.uint64(40)).astype(np.int64) % BITMAP] = True
    return np.packbits(bits).view(np.uint64).reshape(n, BITMAP // 64)


def may_be_alike(size: np.ndarray, other_size: np.ndarray, bits: np.ndarray, other_bits: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets, by their sizes and bitmaps, can reach the similarity: such sets differ in (1 - t) / (1 + t) of their members' number at most, and their bitmaps in no more bits."""
    differ = np.bitwise_count(bits ^ other_bits).sum(1, dtype=np.int64)
    return differ <= (size + other_size) * ((1 - threshold) / (1 + threshold)) + 1e-9


def shared_counts(ids: np.ndarray, starts: np.ndarray, left: np.ndarray, others: np.ndarray, other_starts: np.ndarray, right: np.ndarray, at_a_time: int = 1 << 21) -> np.ndarray:
    """How many values the list left[k] of one side and the list right[k] of the other have in common; the values of a list are different numbers from 0 to 2**31."""
    out = np.zeros(len(left), np.int64)
    x, y = np.diff(starts)[left], np.diff(other_starts)[right]
    turns = np.cumsum(x + y) // at_a_time
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(turns)) + 1) if len(left) else []:
        keys = []
        for values, at, size in ((ids, starts[left[part]], x[part]), (others, other_starts[right[part]], y[part])):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            keys.append((np.repeat(np.arange(len(part)), size) << 31) | values[np.repeat(at, size) + step])
        key = np.sort(np.concatenate(keys))
        out[part] = np.bincount(key[1:][key[1:] == key[:-1]] >> 31, minlength=len(part))
    return out
