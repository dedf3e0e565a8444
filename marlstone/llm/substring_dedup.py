"""Substring dedup: fixed-block anchors.

Every document is a reference: its text is cut into non-overlapping blocks of
7 words, which are indexed. Every rolling window of 7 words of every document
probes the index; a window of 13 words always contains one whole block of any
other document it occurs in, so no repeat of 13 words is missed. A hit means
that the block stands in some other document too. Hits are then extended:
the windows of 13 words around them are compared across documents, and each
word covered by a window that starts in a document with a smaller doc_id too
is removed. Runs of such windows are the maximal repeats.

Blocks, probes and windows travel packed (see ``blobs``). Block hashes are
short, since a false hit only costs a comparison; windows are compared by 64
bits beside the bits of their range.

Defined cases: a null text has no words; a text of fewer than 13 words loses
nothing; a null doc_id has no order, so its row neither loses words nor makes
others lose any; rows that share a doc_id do not remove words of each other,
and each loses what its own text repeats of smaller ids; equal rows fare
alike; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import blobs
from marlstone.llm.tables import table
from marlstone.llm.textops import BLANK, Words, as_bytes, slices, tune
from marlstone.session import written

WINDOW = 13
BLOCK = 7


def _packed(bits: int, short: bool, most: bool, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows for (hash, doc, key, pos, in table) arrays, gathered to about a million entries."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, doc, key, pos, ref = (np.concatenate(x) for x in zip(*held, strict=True))
        th, td = blobs.table_entries(h[ref], doc[ref], most)
        none = np.zeros(len(th), np.int64)
        rows = [*blobs.pack(0, bits, th, td, none, none, short)] + [*blobs.pack(1, bits, h, doc, key, pos, short)]
        yield from blobs.batches(rows)

    for x in found:
        if len(x[0]):
            held.append(x)
            size += len(x[0])
        if size >= blobs.ENTRIES_A_ROW_SET:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def anchors(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, key, pos): windows of BLOCK words that are a block of another document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in source:
                ids, keys, texts = *(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), as_bytes(batch.column(2))
                for lo, hi in slices(texts):
                    words = Words(texts[lo:hi], BLANK)
                    at = words.starts(BLOCK)
                    doc = words.doc[at] if len(at) else at
                    long_enough = words.counts[doc] >= WINDOW
                    at, doc = at[long_enough], doc[long_enough]
                    pos = (at - words.first[doc]).astype(np.uint32)
                    yield words.grams(BLOCK)[at], ids[lo:hi][doc], keys[lo:hi][doc], pos, pos % BLOCK == 0

        yield from _packed(bits, True, True, found())

    rows = docs.where(blobs.known()).select("doc_id", blobs.text_key(), "text").mapInArrow(run, blobs.SCHEMA)
    return blobs.exchange(rows, True, lambda found, least, greatest, doc: found & ((least != doc) | (greatest != doc)), most=True)


def repeats(docs: DataFrame, hits: DataFrame, bits: int) -> DataFrame:
    """(doc_id, key, pos): starts of windows that start in a document with a smaller doc_id too."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in source:
                ids, keys, texts = *(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), as_bytes(batch.column(2))
                packed = batch.column(3).to_pylist()
                for lo, hi in slices(texts):
                    words = Words(texts[lo:hi], BLANK)
                    wanted = np.zeros(int(words.first[-1]) + 1, dtype=np.int32)
                    for k in range(hi - lo):
                        p = blobs.positions(packed[lo + k])
                        p = p[p + BLOCK <= words.counts[k]] + words.first[k]
                        # windows that contain the block: from WINDOW - BLOCK words before it on
                        np.add.at(wanted, np.maximum(p - (WINDOW - BLOCK), words.first[k]), 1)
                        np.add.at(wanted, p + 1, -1)
                    at = words.starts(WINDOW)
                    at = at[np.cumsum(wanted)[at] > 0] if len(at) else at
                    doc = words.doc[at] if len(at) else at
                    yield words.grams(WINDOW, seed=1)[at], ids[lo:hi][doc], keys[lo:hi][doc], (at - words.first[doc]).astype(np.uint32), np.ones(len(at), dtype=bool)

        yield from _packed(bits, False, False, found())

    rows = docs.where(blobs.known()).select("doc_id", blobs.text_key(), "text").join(hits, ["doc_id", "key"]).select("doc_id", "key", "text", "pos").mapInArrow(run, blobs.SCHEMA)
    return blobs.exchange(rows, False, lambda found, least, greatest, doc: found & (least < doc), most=False)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words, joined by one space where any was removed), n_words, n_removed and kept_sha256."""
    spark = docs.sparkSession
    tune(spark)
    blobs.free_shuffles(spark)
    bits = blobs.part_bits(docs)
    hits = written(blobs.by_row(anchors(docs, bits)), "anchor-hits")
    starts = written(blobs.by_row(repeats(docs, hits, bits)), "repeat-starts")
    rows = docs.select("doc_id", blobs.text_key(), "text").join(starts, ["doc_id", "key"], "left").select("doc_id", "text", "pos")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            packed = batch.column(2).to_pylist()
            out: list[list] = [[], [], [], []]
            for t, p in zip(texts, packed, strict=True):
                words = (t or b"").split()  # bytes split at the ASCII blanks
                n, gone = len(words), 0
                if p:
                    cover = np.zeros(n + WINDOW + 1, dtype=np.int32)
                    at = blobs.positions(p)
                    at = at[at + WINDOW <= n]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
                    keep = np.cumsum(cover)[:n] == 0
                    gone = int(n - keep.sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                kept = b" ".join(words)
                for c, v in zip(out, (kept if gone else t, n, gone, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), cols[0].cast(pa.string()), *cols[1:]], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_substring_dedup": op3}

ORACLE = {
    "op3_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 12], ' ')) AS h, md5(array_to_string(w[i : i + 12], ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, m, min(doc_id) AS first_doc FROM g GROUP BY h, m),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone
         FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (h, m) WHERE first_doc < g.doc_id) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(gone, []) AS gone, w FROM d LEFT JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM k) a
         ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM k) b USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM k LEFT JOIN kept USING (doc_id)
""",
}
