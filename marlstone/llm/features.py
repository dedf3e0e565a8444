"""Sparse hashed text features, and bounded labelled samples to learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textops import BLANK, BLANK_LOWER, Words, as_bytes, mix, slices, tune

STEMS = (4, 5, 6, 7, 8)
_ALNUM_OR_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Features of one text: indices below the number of dimensions (distinct, in order) and their counts.
Sparse = tuple[np.ndarray, np.ndarray]


def fold(column: str, folds: int) -> Column:
    """crc32 of a number as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(folds))


def _per_text(keys: np.ndarray, doc: np.ndarray, n: int) -> list[Sparse]:
    """Distinct keys of each text with their counts."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(k))).astype(np.int32)
    bound = np.searchsorted(d[at], np.arange(n + 1))
    idx = k[at].astype(np.int32)
    return [(idx[a:b], count[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def stem_features(texts: list[bytes | None], bits: int, keep: np.ndarray | None = None) -> list[Sparse]:
    """Lower-cased words without ASCII punctuation, and their beginnings of 4 to 8 bytes, by hash.

    ``keep``: which features are wanted; the others are dropped early.
    """
    words = Words([t and t.translate(_ALNUM_OR_BLANK) for t in texts], BLANK_LOWER)
    doc, size = words.doc, words.end - words.start
    keys, docs = [words.hash], [doc]
    for k in STEMS:
        longer = np.flatnonzero(size > k)
        keys.append(words.span_hash(words.start[longer], words.start[longer] + k, seed=k))
        docs.append(doc[longer])
    key, docs_ = np.concatenate(keys) >> np.uint64(64 - bits), np.concatenate(docs)
    if keep is not None:
        wanted = keep[key.astype(np.int64)]
        key, docs_ = key[wanted], docs_[wanted]
    return _per_text(key, docs_, len(texts))


def shape_features(texts: list[bytes | None], bits: int) -> list[Sparse]:
    """N-gram indicators of form: words, their last three bytes, pairs of those, and the share of words that repeat the one before."""
    words = Words(texts, BLANK)
    doc, total = words.doc, len(words.start)
    if not total:
        return [(np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in texts]
    a = np.frombuffer(words.buf, dtype=np.uint8).astype(np.uint64)
    last = lambda k: np.where(words.end - k >= words.start, a[np.maximum(words.end - k, 0)], 0).astype(np.uint64)
    ends = mix((last(1) | last(2) << np.uint64(8) | last(3) << np.uint64(16)) + np.uint64(0x51ED2701))
    inside = np.zeros(total, dtype=bool)
    inside[1:] = doc[1:] == doc[:-1]
    pairs = mix(ends[1:] + ends[:-1] * np.uint64(31) + np.uint64(0x1B873593))[inside[1:]]
    again = np.flatnonzero(inside[1:] & (words.hash[1:] == words.hash[:-1])) + 1
    share = np.bincount(doc[again], minlength=len(texts)) / np.maximum(words.counts, 1)
    level = np.floor(np.minimum(share * 10, 9)).astype(np.uint64)
    again = words.first[:-1][share > 0]  # one feature for each level up to the text's
    again, same = np.repeat(doc[again], 10), np.tile(np.arange(10, dtype=np.uint64), len(again))
    ok = same <= level[again]
    again, same = again[ok], mix(same[ok] + np.uint64(0x2545F491))
    keys = np.concatenate((words.hash, ends, pairs, same)) >> np.uint64(64 - bits)
    docs = np.concatenate((doc, doc, doc[inside], again))
    return _per_text(keys, docs, len(texts))


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, featurize: Callable[[list[bytes | None], int], list[Sparse]], bits: int, spare: Column,
) -> tuple[list[Sparse], np.ndarray, np.ndarray]:
    """(features, labels, doc_ids) of at most ``rows`` labelled documents for which ``spare`` holds.

    The sample is the first by a hash of doc_id. Only ids, then features,
    travel: at most ``rows`` of each.
    """
    tune(docs.sparkSession)
    ids = (
        labels.where(spare & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            found = [x for lo, hi in slices(texts) for x in featurize(texts[lo:hi], bits)]
            cols = [pa.array([x[k].astype(np.int32).tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "y", "idx", "n"])

    joined = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # one row an id, so that repeated rows stay on the executors
    joined = joined.groupBy("doc_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = joined.mapInArrow(run, "doc_id long, y int, idx binary, n binary").toPandas().sort_values("doc_id", kind="stable")
    x = [(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for i, n in zip(got["idx"], got["n"], strict=True)]
    return x, got["y"].to_numpy(np.int64), got["doc_id"].to_numpy(np.int64)


def mapped(docs: DataFrame, score: Callable[[list[Sparse]], list[np.ndarray]], featurize, bits: int, names: list[str]) -> DataFrame:
    """doc_id and the named double columns that ``score`` gives for the features of each text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for lo, hi in slices(texts):
                for c, v in zip(cols, score(featurize(texts[lo:hi], bits)), strict=True):
                    c.append(v)
            done = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.float64()) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), *done], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def dots(found: list[Sparse], weights: np.ndarray, value: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the sum of weight times value, and the number of features."""
    size = np.array([len(i) for i, _ in found], dtype=np.int64)
    if not size.sum():
        return np.zeros(len(found)), size
    idx = np.concatenate([i for i, _ in found])
    got = weights[idx] * value(np.concatenate([c for _, c in found]))
    sums = np.concatenate(([0.0], np.cumsum(got)))
    end = np.cumsum(size)
    return sums[end] - sums[end - size], size
