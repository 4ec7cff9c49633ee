"""Texts put into containers of fixed capacity: first-fit decreasing with a tournament tree, in random groups."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs at a time; the unused space at the end of a group is at most about a container.
GROUP_ITEMS = 20_000
#: The word-and-punctuation tokenizer by which texts without a count are sized.
WORDS = r"(?U)\w+|[^\w\s]"


class Tournament:
    """The room left in each of n containers; the winner of each match is the one with more room."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first container with room for an item, which then goes in."""
        k, room = 1, self.room
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        found = k - self.leaves
        left = room[k] = room[k] - size
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
        return found if left >= 0 else -1


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (none larger than the capacity); larger items go first, equal ones in order."""
    if not sizes:
        return []
    tree = Tournament(len(sizes), capacity)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = tree.place(sizes[k])
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_tok") -> DataFrame:
    """Rows (doc_id, size) of the texts; a missing count is taken from the text."""
    counted = F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORDS), F.lit(0)))
    return docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(size_col), counted).cast("long").alias("size")).where("size > 0")


def pack(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_tok", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Rows (spec_id, container, doc_id, piece, tokens): the container of each text, or of each piece of one larger than the capacity.

    A text is split only if it is larger than the capacity: into full containers and one rest, which is packed
    like any other. Null ids, null, empty or token-less texts have no container; capacities that are null or below
    1 are left out. Containers are numbered group by group, and no two groups share a number.
    """
    items = sized(docs, id_col, text_col, size_col)
    caps = [tuple(r) for r in specs.where("spec_id is not null and capacity > 0").select("spec_id", "capacity").distinct().collect()]
    groups = max(1, math.ceil(items.count() / group_items))
    kinds = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in caps])) if caps else None
    if kinds is None:
        return items.sparkSession.createDataFrame([], "spec_id int, container long, doc_id long, piece int, tokens long")
    # the group is a hash of the id: no order of the documents, no source and no size decides it
    rows = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(groups)).cast("int")).select("doc_id", "size", "grp", kinds.alias("kind")).select("doc_id", "size", "grp", "kind.*")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        doc, size = table.column("doc_id").to_numpy(), table.column("size").to_numpy()
        cap, grp = table.column("capacity")[0].as_py(), table.column("grp")[0].as_py()
        full, rest = size // cap, size % cap
        exact = (rest == 0).astype(np.int64)
        whole = full  # containers that a text fills by itself
        docs_full = np.repeat(doc, whole)
        piece_full = np.arange(len(docs_full)) - np.repeat(np.cumsum(whole) - whole, whole)
        open_doc, open_size, open_piece = doc[exact == 0], rest[exact == 0], full[exact == 0]
        bins = np.array(first_fit_decreasing(open_size.tolist(), cap), np.int64)
        used = int(bins.max()) + 1 if len(bins) else 0
        container = np.concatenate((used + np.arange(len(docs_full)), bins))
        return pa.table(
            {
                "spec_id": pa.array(np.full(len(container), table.column("spec_id")[0].as_py()), pa.int32()),
                "container": pa.array((np.int64(grp) << np.int64(32)) + container, pa.int64()),
                "doc_id": pa.array(np.concatenate((docs_full, open_doc)), pa.int64()),
                "piece": pa.array(np.concatenate((piece_full, open_piece)), pa.int32()),
                "tokens": pa.array(np.concatenate((np.full(len(docs_full), cap), open_size)), pa.int64()),
            }
        )

    return rows.groupBy("spec_id", "grp").applyInArrow(run, "spec_id int, container long, doc_id long, piece int, tokens long")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows (spec_id, capacity, containers, tokens, fill) of what pack gives."""
    per = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return per.join(specs.select("spec_id", "capacity").distinct(), "spec_id").select("spec_id", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
