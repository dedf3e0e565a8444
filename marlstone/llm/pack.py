"""Best-fit packing with conflicts.

Documents are cut into pieces of at most ``capacity`` words. A bin holds
pieces up to the capacity, at most one document of each source and at most
one of each cluster of equal texts. Pieces come in decreasing size; the bins
of a group are kept in the order of their residual room, and the search goes
from the smallest sufficient residual upwards until it meets a bin whose
source and cluster bitmaps have neither of the piece's bits: the tightest
compatible bin. Without one, a bin is opened.

Only narrow rows travel: texts are counted where they are read. Documents are
dealt by a hash of doc_id into groups of about ``group_rows``, which are
packed apart from each other, so a hot source or a large cluster is spread
over all groups and no task sees more than a group.

Defined cases: a text that is null or has no words gives one piece of size 0
that takes a place in a bin like any other; a null source is a source of its
own; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tables import table

CAPACITY = 2048
GROUP_ROWS = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(document, start, words, bin) for every piece; bins count from 0."""
    pieces = []
    for d, n in enumerate(sizes):
        at = 0
        while n - at > capacity:
            pieces.append((capacity, d, at))
            at += capacity
        pieces.append((n - at, d, at))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    order: list[tuple[int, int]] = []  # (residual, bin), in order
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for size, d, at in pieces:
        s, c = 1 << sources[d], 1 << clusters[d]
        k = bisect_left(order, (size, -1))
        while k < len(order) and (held_sources[order[k][1]] & s or held_clusters[order[k][1]] & c):
            k += 1
        if k < len(order):
            left, b = order.pop(k)
        else:
            left, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= s
        held_clusters[b] |= c
        if left > size or size == 0:
            insort(order, (left - size, b))
        out.append((d, at, size, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row a piece: doc_id, piece, start, n_words, bin_id, bin_offset, source and cluster."""
    n_groups = max(1, -(-docs.count() // group_rows))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("cluster"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n_groups)).cast("long").alias("grp"),
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])

        def numbered(values: list) -> list[int]:
            known: dict = {}
            return [known.setdefault(v, len(known)) for v in values]

        ids, sizes = group["doc_id"].to_pylist(), group["n_words"].to_pylist()
        sources, clusters = group["source"].to_pylist(), group["cluster"].to_pylist()
        g = group["grp"][0].as_py()
        found = best_fit(sizes, numbered(sources), numbered(clusters), capacity)
        used: dict[int, int] = {}
        cols: list[list] = [[], [], [], [], [], [], [], []]
        for d, at, size, b in found:
            row = (ids[d], at // capacity, at, size, g * 2 * (1 << 31) + b, used.get(b, 0), sources[d], clusters[d])
            used[b] = used.get(b, 0) + size
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        names = ["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset", "source", "cluster"]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.groupBy("grp").applyInArrow(run, "doc_id long, piece long, start long, n_words long, bin_id long, bin_offset long, source string, cluster long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_best_fit_packing": op10}
