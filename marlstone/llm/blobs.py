"""Shuffling many small (hash, row, position) entries as packed rows.

A row is named by its document, whose order decides, and a hash of its text
(``key``), which tells rows that share a doc_id apart.

A row holds all entries of one hash range that a map task has gathered, so
Spark moves and sorts few large rows instead of one row for each word of the
corpus. Within a range, rows of kind 0 (tables, already combined on the map
side) come before rows of kind 1 (entries), which are then streamed past the
table: a task holds one table and one row of entries at a time, however often
a hash occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import width

SCHEMA = "part int, kind int, docs binary, keys binary, n binary, pos binary, h binary"
ENTRIES_A_ROW_SET = 1 << 20
TEXT_A_PART = 24 << 20

Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # hash (uint64), doc_id (int64), key (int64), position (uint32)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a query's shuffle files when the query ends; later steps read written tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def part_bits(docs: DataFrame, text_a_part: int = TEXT_A_PART) -> int:
    """Bits of the hash that name its range: about ``text_a_part`` bytes of text a range, 64 ranges at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(6, int(np.ceil(np.log2(max(1, size / text_a_part)))))


def _cuts(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where another row begins."""
    return np.concatenate(([0], np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1))


def pack(kind: int, bits: int, h: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray, short: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the entries, which come in order of row and position."""
    part = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part, h, doc, key, pos = part[order], h[order], doc[order], key[order], pos[order]
    h = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if short else h
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = _cuts(doc[a:b], key[a:b])
        n = np.diff(np.append(at, b - a)).astype(np.uint32)
        yield int(part[a]), kind, doc[a:b][at].tobytes(), key[a:b][at].tobytes(), n.tobytes(), pos[a:b].astype(np.uint32).tobytes(), h[a:b].tobytes()


def unpack(row: dict, short: bool) -> Entries:
    h = np.frombuffer(row["h"], np.uint32 if short else np.uint64)
    doc, key = (np.repeat(np.frombuffer(row[c], np.int64), np.frombuffer(row["n"], np.uint32)) for c in ("docs", "keys"))
    return h, doc, key, np.frombuffer(row["pos"], np.uint32)


def batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    names = ["part", "kind", "docs", "keys", "n", "pos", "h"]
    for i in range(0, len(rows), 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 16], strict=True), kinds, strict=True)], names=names)


def extremes(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the least and the greatest document of each."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return h, doc, doc
    return h[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)


def exchange(rows: DataFrame, short: bool, decide: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], most: bool) -> DataFrame:
    """(doc_id, key, pos) of the entries for which ``decide(found, least, greatest, doc)`` holds; pos is packed uint32."""
    dealt = rows.repartition(width(rows.sparkSession), F.col("part")).sortWithinPartitions("part", "kind")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, table = None, [], None
        for batch in source:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if row["part"] != current:
                    current, held, table = row["part"], [], None
                h, doc, key, pos = unpack(row, short)
                if row["kind"] == 0:
                    held.append((h, doc))
                    if len(held) >= 64:  # combine as they come
                        held = [_combined(held, most)]
                    continue
                if table is None:
                    table = extremes(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])) if held else extremes(np.zeros(0, h.dtype), np.zeros(0, np.int64))
                    held = []
                keys, least, greatest = table
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = decide(keys[at] == h, least[at], greatest[at], doc)
                if ok.any():
                    d, k, p = doc[ok], key[ok], pos[ok]
                    cut = _cuts(d, k)
                    out = [p[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(p)), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(d[cut], pa.int64()), pa.array(k[cut], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "key", "pos"])

    return dealt.mapInArrow(run, "doc_id long, key long, pos binary")


def _combined(held: list[tuple[np.ndarray, np.ndarray]], most: bool) -> tuple[np.ndarray, np.ndarray]:
    h, least, greatest = extremes(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
    if not most:
        return h, least
    two = greatest != least
    return np.concatenate((h, h[two])), np.concatenate((least, greatest[two]))


def table_entries(h: np.ndarray, doc: np.ndarray, most: bool) -> tuple[np.ndarray, np.ndarray]:
    """The entries that a table needs: the least document of each hash, and the greatest too if asked for, in document order."""
    h, d = _combined([(h, doc)], most)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def text_key() -> Column:
    return F.xxhash64("text").alias("key")


def by_row(found: DataFrame) -> DataFrame:
    """One row for each text of a document, with all its packed positions; equal rows are one."""
    return found.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("pos"))


def positions(packed: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in packed])).astype(np.int64) if packed else np.zeros(0, np.int64)


def known(column: str = "doc_id") -> Column:
    return F.col(column).isNotNull()
