"""Passages of held-out items inside a large corpus.

Windows of words are embedded by the CGK random walk, which turns edit distance into Hamming distance, and
looked up by sampled symbols of the embedding in tables of the items' windows; an exact edit distance decides.
Windows that hold no whole piece of any item window cannot be that near to one and are not embedded.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokensets import distinct

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Characters of item texts in one block; each block is a query set of its own against the corpus.
BLOCK_CHARS = 1_000_000
PAIRS = 50_000  # candidates compared at a time
STEPS = 3  # the walk takes at most this many steps a word


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


#: Tables that sample one random walk; the next ones walk anew, as a walk that misses its way misses it for all of its tables.
TABLES_A_WALK = 4


def embed(windows: np.ndarray, tables: int, sampled: int, seed: int) -> np.ndarray:
    """Keys (tables x windows) from as many walks as the tables need."""
    return np.concatenate([_walk(windows, min(TABLES_A_WALK, tables - t), sampled, seed + 1000 * t) for t in range(0, tables, TABLES_A_WALK)])


def _walk(windows: np.ndarray, tables: int, sampled: int, seed: int) -> np.ndarray:
    """Keys (tables x windows): a hash of the symbols that the random walk of each window emits at the sampled steps.

    At each step the walk emits the symbol it stands on and goes on by one if the step's random bit for that
    symbol is set; all windows share the bits, so equal windows have equal embeddings and a window some edits
    away falls into step with them again.
    """
    n, width = windows.shape
    rng = np.random.default_rng(seed)
    length = STEPS * width
    bits = rng.integers(0, 2, (length, 1024), np.uint8)
    take = np.zeros((tables, length), bool)
    for t in range(tables):
        # the earlier steps are walked by every window; later ones may lie behind its end
        take[t, rng.permutation(2 * width)[:sampled]] = True
    odd = rng.integers(0, 1 << 62, (tables, length), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    padded = np.zeros((width + 1, n), np.uint32)
    padded[:width] = windows.T
    flat, lane = padded.ravel(), np.arange(n)
    at = np.zeros(n, np.int64)
    keys = np.zeros((tables, n), np.uint64)
    for j in range(int(np.flatnonzero(take.any(0)).max(initial=0)) + 1):
        symbol = flat[at * n + lane]
        for t in np.flatnonzero(take[:, j]):
            keys[t] += (symbol.astype(np.uint64) + np.uint64(1)) * odd[t, j]
        at = np.minimum(at + bits[j][symbol & np.uint32(1023)], width)
    for t in range(tables):
        keys[t] ^= keys[t] >> np.uint64(29)
        keys[t] *= np.uint64(0x9E3779B97F4A7C15)
    return keys


def hold(regions: np.ndarray, windows: np.ndarray, edits: int) -> np.ndarray:
    """Whether each row of regions has a stretch, of any length, at most `edits` edits from its row of windows."""
    if not len(regions):
        return np.zeros(0, bool)
    regions, windows = np.ascontiguousarray(regions.T), np.ascontiguousarray(windows.T)
    row = np.zeros((len(regions) + 1, regions.shape[1]), np.int16)  # a stretch starts anywhere
    for word in windows:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (regions != word))
        for j in range(1, len(row)):
            np.minimum(new[j], new[j - 1] + 1, out=new[j])
        row = new
    return row.min(0) <= edits  # and ends anywhere


def within(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether the edit distance of two short sequences is at most `edits`."""
    if edits == 0 or np.array_equal(a, b):
        return np.array_equal(a, b)
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.concatenate(([i], new))
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        if row.min() > edits:
            return False
    return int(row[-1]) <= edits


def tables_for(recall: float, edits: int, sampled: int, width: int) -> int:
    """Tables needed so that a window `edits` edits away shares a key with the given probability (one edit moves the walk for about seven steps, as measured)."""
    if edits == 0:
        return 1
    same = (1 - min(0.9, 7 * edits / (2 * width))) ** sampled
    return math.ceil(math.log(1 - recall) / math.log(1 - same))


def piece(width: int, edits: int) -> int:
    """Words of a run that a window keeps whole when it is at most `edits` edits from another: of edits + 1 equal pieces one at
    least has no edit, and edits may push so many of its words out of a window of the same width."""
    return max(1, width // (edits + 1) - edits)


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Slots of 2**20 for the runs of so many ids."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.int64) & ((1 << 20) - 1)


Finder = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]
_FINDERS: dict[str, Finder] = {}


def _kept(key: str, make: Callable[[], Finder]) -> Finder:
    """The finder of that key: made once in each Python worker, which keeps the last few for its next tasks."""
    if key not in _FINDERS:
        while len(_FINDERS) >= 2:
            del _FINDERS[next(iter(_FINDERS))]
        _FINDERS[key] = make()
    return _FINDERS[key]


def finder(items: list[tuple[int, str]], width: int, edits: int, sampled: int, recall: float, seed: int = 9) -> Finder:
    """A function from texts to triples (number of the text, item id, whether a window is held without any edit)."""
    vocabulary: dict[str, int] = {}
    sequences = [(i, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.uint32)) for i, text in items]
    views = [(k, np.lib.stride_tricks.sliding_window_view(s, width)) for k, (_, s) in enumerate(sequences) if len(s) >= width]
    tables = tables_for(recall, edits, sampled, width)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if not views:
        return lambda texts: none
    item_windows = np.concatenate([v for _, v in views])
    item_number, item_ids = np.concatenate([np.full(len(v), k, np.int64) for k, v in views]), np.array([i for i, _ in sequences], np.int64)
    item_keys = embed(item_windows, tables, sampled, seed)
    sorts = [np.argsort(k, kind="stable") for k in item_keys]
    sorted_keys = [k[o] for k, o in zip(item_keys, sorts, strict=True)]
    # most keys are in no table: a bitmap over their low bits tells so at once
    slots = np.uint64((1 << 18) - 1)
    taken = np.zeros((tables, 1 << 18), bool)
    for t in range(tables):
        taken[t, (item_keys[t] & slots).astype(np.int64)] = True

    size = piece(width, edits)
    pieces = np.zeros(1 << 20, bool)
    for _, sequence in sequences:
        pieces[_grams(sequence, size)] = True

    def find(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        get = vocabulary.get
        # a passage that lacks words may end with the text: each text gets so many words that no item has
        tail = [""] * edits
        found = [WORD.findall(t.casefold()) + tail for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((get(w, 0) for ws in found for w in ws), np.uint32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        n = len(ids) - width + 1
        if n <= 0:
            return none
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.arange(n)
        # a word that no item has costs one edit at least
        keep = (unknown[width:] - unknown[:-width] <= edits) & (np.repeat(ends, sizes)[:n] >= at + width)
        held = np.concatenate(([0], np.cumsum(pieces[_grams(ids, size)])))
        keep &= held[at + width - size + 1] > held[at]
        at = at[keep]
        if not len(at):
            return none
        windows = np.lib.stride_tricks.sliding_window_view(ids, width)[at]
        keys = embed(windows, tables, sampled, seed)
        pairs = []
        for t in range(tables):
            some = np.flatnonzero(taken[t][(keys[t] & slots).astype(np.int64)])
            lo, hi = (np.searchsorted(sorted_keys[t], keys[t][some], side=s) for s in ("left", "right"))
            count = hi - lo
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            # a pair is one number, which sorts many times faster than two
            pairs.append(np.repeat(some, count) * np.int64(len(item_windows)) + sorts[t][np.repeat(lo, count) + step])
        pair = distinct(np.concatenate(pairs))
        window, item_window = pair // len(item_windows), pair % len(item_windows)
        same = (windows[window] == item_windows[item_window]).all(1)
        whole = same.copy()
        if edits:
            doc = np.searchsorted(ends, at[window], side="right")
            pair = doc * np.int64(len(sequences)) + item_number[item_window]
            left = np.flatnonzero(~np.isin(pair, distinct(pair[same])))
            reach = np.arange(-edits, width + edits)
            for part in np.array_split(left, len(left) // PAIRS + 1):
                place = at[window[part]][:, None] + reach
                inside = (place >= (ends - sizes)[doc[part]][:, None]) & (place < ends[doc[part]][:, None])
                regions = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], 0)
                same[part] = hold(regions, item_windows[item_window[part]], edits)
        doc = np.searchsorted(ends, at[window[same]], side="right")
        # of each pair the best comes first
        found = distinct((doc * np.int64(len(sequences)) + item_number[item_window[same]]) * 2 + ~whole[same])
        pair = found >> 1
        first = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
        return pair[first] // len(sequences), item_ids[pair[first] % len(sequences)], found[first] & 1 == 0

    return find


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 12, edits: int = 0, sampled: int = 8, recall: float = 0.99
) -> DataFrame:
    """Rows (doc_id, item_id, whole): records that hold `width` words in a row of an item, up to `edits` edited words.

    whole tells whether some such words stand there without any edit; these are all found, the others with the given
    recall. Words are maximal runs of letters and digits, compared without case. Null ids, null or empty texts and
    items of fewer words give no row; repeated rows give one. Items are searched in blocks of bounded size, each
    against all records.
    """
    spark = docs.sparkSession
    src = items.where(F.col(item_col).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = src.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long"), F.col(text_col))
    out = None
    for b in range(blocks):
        block = [tuple(r) for r in (src if blocks == 1 else src.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)).collect()]
        sent = spark.sparkContext.broadcast(block)
        key = uuid.uuid4().hex

        def run(batch: pa.RecordBatch, sent=sent, key=key) -> dict:
            find = _kept(key, lambda: finder(sent.value, width, edits, sampled, recall))
            doc, item, whole = find(batch.column(1).to_pylist())
            return {"doc_id": pa.array(batch.column(0).to_numpy(zero_copy_only=False)[doc], pa.int64()), "item_id": pa.array(item, pa.int64()), "whole": pa.array(whole, pa.bool_())}

        part = map_arrow(rows, run, "doc_id long, item_id long, whole boolean")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.bool_or("whole").alias("whole"))
