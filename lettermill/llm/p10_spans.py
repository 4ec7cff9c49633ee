"""Long exact spans that stand in more than one record.

Winnowed fingerprints bring together the places that can hold such a span (every run of `span` characters
keeps one at least, chosen by its content alone). The text around each place, once for all places where it is the same,
goes into a compressed full-text index per shard; backward search takes its matching statistics against all other
records of the shard, and the maximal matches of a span or more are what is shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, map_arrow
from .fmindex import FMIndex, maximal_matches
from .rolling import Hasher, code_points, mix, winnow

#: Code points of one shard's index.
SHARD_CHARS = 1_000_000
#: Different surroundings of one fingerprint in one index at most; fingerprints with more are told apart by longer runs.
GROUP = 3_000


def _gram(span: int) -> tuple[int, int]:
    """Length of the fingerprinted grams, and of the window of which one is kept: together they fit into a span."""
    gram = max(1, span // 2)
    return gram, span - gram + 1


def fingerprints(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Rows (fp, ctx, doc, pos): kept grams, with a hash of all text within reach of a span around them."""
    gram, window = _gram(span)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        symbols, starts = code_points(texts)
        hasher = Hasher(symbols)
        h = hasher.rolling(gram)
        ends = np.repeat(starts[1:], np.diff(starts))[: len(h)]
        at = winnow(h, np.arange(gram, gram + len(h)) <= ends, window)
        doc = np.searchsorted(starts, at, side="right") - 1
        left, right = np.maximum(starts[doc], at - (span - gram)), np.minimum(starts[doc + 1], at + span)
        # the lowest bit says whether what was hashed is as long as a span
        ctx = ((hasher.at(left, right) + (right - left).astype(np.uint64)) << np.uint64(1)) | (right - left >= span).astype(np.uint64)
        return {
            "fp": pa.array(h[at].view(np.int64)),
            "ctx": pa.array(ctx.view(np.int64)),
            "doc": pa.array(ids[doc]),
            "pos": pa.array((at - starts[doc]).astype(np.int32)),
        }

    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= span)).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "fp long, ctx long, doc long, pos int")


def _surroundings(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Rows (fp, ctx, a, b, off, text): for each different text around a fingerprint its first and last record, and the text, which starts off before the fingerprint.

    A record's text is joined once, with all places that are taken from it.
    """
    reach = span - _gram(span)[0]
    records = places.groupBy("fp", "ctx").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    first = places.join(records, ["fp", "ctx"]).where("doc = a").groupBy("fp", "ctx", "a", "b").agg(F.min("pos").alias("pos"))
    mine = first.groupBy(F.col("a").alias("doc")).agg(F.collect_list(F.struct("fp", "ctx", "b", "pos")).alias("places"))
    texts = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= span)).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("whole")).join(mine, "doc")
    each = texts.select("doc", "whole", F.explode("places").alias("p")).select("p.fp", "p.ctx", F.col("doc").alias("a"), "p.b", F.least(F.col("p.pos"), F.lit(reach)).alias("off"), "p.pos", "whole")
    text = F.expr(f"substring(whole, pos - off + 1, off + {span})")
    # a record that stands in several rows gives its places in each
    return each.select("fp", "ctx", "a", "b", "off", text.alias("text"))


def shared_stretches(a: np.ndarray, b: np.ndarray, texts: list[str], own: np.ndarray, span: int, first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal matches, of a span or more, of each text in those that are own and stand in another record.

    Text k stands in the records a[k] to b[k]: in one only if these are the same. With first, only whether there is one.
    """
    indexed = np.flatnonzero(own)
    symbols, starts = code_points([texts[k] for k in indexed.tolist()])
    used, dense = np.unique(symbols, return_inverse=True)
    # each text is followed by a separator
    body = np.zeros(len(symbols) + len(indexed), np.int64)
    body[np.arange(len(symbols)) + np.repeat(np.arange(len(indexed)), np.diff(starts))] = dense + 1
    index = FMIndex(body, len(used) + 1, span if first else int(np.diff(starts).max(initial=0)) + 1)
    record = np.unique(a, return_inverse=True)[1]
    record = np.where(a < b, -1, record)  # what stands in several records is another record's for all
    owner = np.repeat(record[indexed], np.diff(starts) + 1)[index.sa]
    # for each suffix, in order, where the run of suffixes of the same record ends: an interval beyond that holds another record
    change = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    other = np.concatenate((change, [len(owner)]))[np.searchsorted(change, np.arange(len(owner)), side="right")]
    query, places = code_points(texts)
    found = np.minimum(np.searchsorted(used, query), max(0, len(used) - 1))
    query = np.where(used[found] == query, found + 1, 0) if len(used) else np.zeros(len(query), np.int64)
    accept = lambda lane, lo, hi: (owner[lo] != record[lane]) | (owner[lo] < 0) | (other[lo] < hi)
    lane, start, end, _, _ = maximal_matches(index, query, places, span, accept, first)
    return lane, start - places[lane], end - places[lane]


def _by_run(rows: DataFrame, span: int, before: int, step: int) -> DataFrame:
    """Rows keyed by longer runs: two texts that share a span around the fingerprint share one of these keys.

    A shared span starts so many code points before the fingerprint, from o to o + before - 1 in these rows; for every `step`
    of these there is a run that all such spans have in common, and its hash is a key. With a step of 1 the runs are the spans.
    """
    reach = span - _gram(span)[0]

    def run(batch: pa.RecordBatch) -> dict:
        symbols, starts = code_points(batch.column("text").to_pylist())
        old, fp, o = batch.column("key").to_numpy().view(np.uint64), batch.column("fp").to_numpy().view(np.uint64), batch.column("o").to_numpy().astype(np.int64)
        at = starts[:-1] + batch.column("off").to_numpy()
        hasher, rows, keys, firsts = Hasher(symbols), [], [], []
        for k in range(0, before, step):
            first, last = o + k, np.minimum(np.minimum(o + k + step, o + before), reach + 1) - 1
            left, right = at - first, at - last + span
            some = np.flatnonzero((first <= last) & (left >= starts[:-1]) & (right <= starts[1:]))
            rows.append(some)
            firsts.append(first[some])
            keys.append(mix(hasher.at(left[some], right[some]) ^ (fp[some] * np.uint64(0x9FB21C651E98DF25) + first[some].astype(np.uint64) + old[some] * np.uint64(0xC2B2AE3D27D4EB4F))))
        again = pa.array(np.concatenate(rows))
        return {"key": pa.array(np.concatenate(keys).view(np.int64)), "o": pa.array(np.concatenate(firsts).astype(np.int32))} | {n: batch.column(n).take(again) for n in ("fp", "ctx", "a", "b", "off", "text")}

    return map_arrow(rows.select("key", "o", "fp", "ctx", "a", "b", "off", "text"), run, "key long, o int, fp long, ctx long, a long, b long, off int, text string")


def _placed(rows: DataFrame, span: int) -> DataFrame:
    """Rows (key, part, fp, ctx, a, b, off, text, own, ask): groups by key and part, none larger than GROUP, of which own rows are indexed and ask rows are sought.

    Groups of one fingerprint that are too large are parted by longer and longer runs. What shares a whole span needs no
    comparison of all with all: two texts of different records are indexed for each part of such a group.
    """
    reach = span - _gram(span)[0]
    whole = lambda df: df.select("key", F.lit(0).alias("part"), "fp", "ctx", "a", "b", "off", "text", F.lit(True).alias("own"), F.lit(True).alias("ask"))
    rows, out = rows.withColumns({"key": F.col("fp"), "o": F.lit(0)}), None
    steps = (reach + 1, -(-(reach + 1) // 4), 4, 1, None)
    for before, step in zip(steps[:-1], steps[1:], strict=True):
        sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("b").alias("high")).where(F.col("n") > GROUP))
        if sizes.isEmpty():
            return whole(rows) if out is None else out.unionByName(whole(rows))
        small = whole(rows.join(hinted(sizes.select("key"), 16), "key", "left_anti"))
        out = small if out is None else out.unionByName(small)
        large = rows.join(hinted(sizes, 48), "key")
        if step is not None:
            rows = cut(_by_run(large, span, before, step))
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    pair = (F.col("a") == F.col("low")) | (F.col("b") == F.col("high"))
    # of the first and of the last record one text each
    firsts = large.where(pair).groupBy("key", "a", "b").agg(F.min("ctx").alias("ctx"))
    pairs = large.join(firsts, ["key", "a", "b", "ctx"], "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    columns = ["key", "part", "fp", "ctx", "a", "b", "off", "text"]
    asked = large.withColumn("part", F.pmod(F.xxhash64("ctx"), parts).cast("int")).select(*columns, F.lit(False).alias("own"), F.lit(True).alias("ask"))
    return out.unionByName(asked).unionByName(pairs.select(*columns, F.lit(True).alias("own"), F.lit(False).alias("ask")))


def _search(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, span: int, first: bool = False) -> DataFrame:
    """Rows (fp, ctx, start, end): what other records share of the text around a fingerprint, by places relative to it."""
    rows = _placed(cut(_surroundings(docs, places, id_col, text_col, span)), span)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        a, b, off, own, ask = (table.column(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "off", "own", "ask"))
        lane, start, end = shared_stretches(a, b, table.column("text").to_pylist(), own, span, first)
        keep = ask[lane]
        lane, start, end = lane[keep], start[keep], end[keep]
        again = pa.array(lane)
        return pa.RecordBatch.from_pydict({"fp": table.column("fp").combine_chunks().take(again), "ctx": table.column("ctx").combine_chunks().take(again), "start": pa.array((start - off[lane]).astype(np.int32)), "end": pa.array((end - off[lane]).astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # groups come in order; several share an index, and one is never larger than GROUP texts
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            sizes = np.add.reduceat(pc.utf8_length(batch.column("text")).to_numpy(), fresh)
            begun = 0
            for at, size in zip(fresh.tolist(), sizes.tolist(), strict=True):
                # a group at the start of a batch may go on from the one before
                goes_on = at == 0 and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (key[0], part[0])
                if chars > SHARD_CHARS and not goes_on:
                    if at > begun:
                        held.append(batch.slice(begun, at - begun))
                    yield flush(held)
                    held, chars, begun = [], 0, at
                chars += size
            held.append(batch.slice(begun))
        if held:
            yield flush(held)

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "fp long, ctx long, start int, end int")


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of overlapping stretches of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def shared_places(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Rows (fp, ctx, doc, pos): kept fingerprints that stand in more than one record, with every place of each."""
    occ = cut(fingerprints(docs, id_col, text_col, span))
    shared = occ.groupBy("fp").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("fp")
    return cut(occ.join(shared, "fp"))


def sharing_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200) -> DataFrame:
    """Rows (doc_id): records that hold a run of `span` or more code points that stands verbatim in another record.

    Null ids and null, empty or shorter texts give no row; rows with one id count as one record; extra columns
    are ignored. The text around a fingerprint goes through the index once for all records in which it is the same, and
    one such text is enough for a record that shares it with another; the other records' texts all go through it.
    """
    places = shared_places(docs, id_col, text_col, span)
    several = places.groupBy("fp", "ctx").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b and ctx & 1 = 1").select("fp", "ctx")
    within = cut(places.join(several, ["fp", "ctx"]).select("doc", "fp", "ctx"))
    one = cut(within.groupBy("doc").agg(F.min("fp").alias("fp")))
    enough = within.join(one, ["doc", "fp"]).select("fp", "ctx").distinct()
    rest = places.join(one.select("doc"), "doc", "left_anti").select("fp").distinct()
    places = cut(places.join(rest, "fp", "left_semi").unionByName(places.join(enough, ["fp", "ctx"], "left_semi")).distinct())
    found = _search(docs, places, id_col, text_col, span, True).select("fp", "ctx").distinct()
    return places.join(found, ["fp", "ctx"], "left_semi").select(F.col("doc").alias("doc_id")).distinct()


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200) -> DataFrame:
    """Rows (doc_id, start, end): the maximal stretches of each record covered by runs of `span` or more that another record holds.

    Cases as in sharing_documents. Places count code points from 0; copies of a whole record are shared from end to end.
    """
    places = shared_places(docs, id_col, text_col, span)
    found = _search(docs, places, id_col, text_col, span).distinct()
    each = places.join(found, ["fp", "ctx"]).select("doc", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        doc, start, end = _merged(*(table.column(i).to_numpy() for i in range(3)))
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})

    return each.groupBy("doc").applyInArrow(merge, "doc_id long, start int, end int")


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200) -> DataFrame:
    """Rows (doc_id, spans, shared_chars, chars, share): how much of each record with a shared span stands elsewhere too."""
    per = shared_spans(docs, id_col, text_col, span).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    sizes = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.length(text_col)).cast("long").alias("chars"))
    return per.join(sizes, "doc_id").select("doc_id", "spans", "shared_chars", "chars", (F.col("shared_chars") / F.col("chars")).alias("share"))
