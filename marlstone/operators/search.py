"""Hybrid search: an inverted index as a table, and an exact fusion of its leg with the vector leg.

The reference names a hybrid search but defines no score; this definition is
ours. With the words of a query q and a chunk d,

    keyword(q, d) = sum of idf(w) tf (K1 + 1) / (tf + K1 (1 - B + B len / avg)) over the words of both,
                    divided by the greatest value that the query's words allow,
    score(q, d)   = share * max(0, cosine(q, d)) + (1 - share) * keyword(q, d).

Exact: chunks are indexed where they are read, a segment of some thousand at a
time with the postings of each word and the vectors; segments and blocks of
queries are written, a row each, and meet in a product of partitions without a
shuffle. A task adds up postings and cosines in a matrix of a few queries by a
segment's chunks and keeps the k best of each query over all segments that it
meets; a window takes the best of those. So pairs of a query and a chunk live
only within a task, and the disk grows with the texts and the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import bounded, written

K1, B, SHARE = 1.2, 0.75, 0.5
#: Postings at which a segment ends.
POSTINGS = 2_000_000
#: Queries of a block, chunks of a segment (65,536 at most) and bytes of a task's matrix of scores.
QUERIES, CHUNKS, SCORE_BYTES = 4096, 16_384, 8 << 20
#: A word of more than this share of a segment's chunks is added as a whole row.
COMMON = 0.1
#: More than rounding can change a score by.
ROOM = 2e-6
SEGMENT = "n long, total long, ids binary, lens binary, counts binary, names array<string>, ends binary, at binary, tf binary, embedded int, m binary"
ASKED = "ids binary, whole binary, words array<string>, rows binary, idf binary, embedded int, m binary"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def _one_text(chunks: DataFrame) -> DataFrame:
    """vec_id, text, embedding and counts: chunks of a repeated vec_id share the greatest text, which counts once."""
    if chunks.groupBy("vec_id").count().where("count > 1").isEmpty():
        return chunks.select("vec_id", "text", "embedding", F.lit(True).alias("counts"))
    same = Window.partitionBy("vec_id")
    return chunks.select("vec_id", F.max(F.coalesce("text", F.lit(""))).over(same).alias("text"), "embedding", (F.row_number().over(same.orderBy("vec_id")) == 1).alias("counts"))


def index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, terms) of chunks (vec_id, text, embedding).

    segments: a written table (see ``SEGMENT``) with the chunks' ids and lengths, the postings (chunk and tf) of each
    word and the vectors, chunks with one first. terms: word, df and idf. Chunks without words count for the average
    length, with length 0.
    """
    bounded(chunks.sparkSession)
    read = _one_text(chunks).select("vec_id", words(F.col("text")).alias("words"), F.col("embedding").cast("array<double>").alias("embedding"), "counts")
    segments = written(read.mapInArrow(partial(_segments, chunks=CHUNKS, postings=POSTINGS), SEGMENT), "segments")
    n = segments.agg(F.sum("n").alias("n")).first().n or 0
    df = segments.select("counts", "names", "ends", "at").mapInArrow(_frequencies, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return segments, df.select("word", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 8, share: float = SHARE, built: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, vec_id, score (rounded to 6 places) and place of the ``k`` best chunks of every query, ties to the smaller id.

    queries: query_id, text, embedding. chunks: vec_id, text, embedding (one row an id). A null embedding has cosine 0,
    a query without known words a keyword score of 0, and a chunk of score 0 is no result. ``built``: the index of the chunks, if there is one.
    """
    bounded(queries.sparkSession)
    segments, terms = built or index(chunks)
    total = segments.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    avg = max((total.total or 0) / max(total.n or 0, 1), 1e-9)
    qw = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(terms, "word")
    # the greatest keyword score of a query: each word at idf * (K1 + 1)
    ask = qw.groupBy("query_id").agg(F.sum(F.col("idf") * (K1 + 1)).alias("whole"), F.collect_list(F.struct("word", "idf")).alias("w"))
    ask = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).join(ask, "query_id", "left").select("query_id", "embedding", F.col("w.word").alias("words"), F.col("w.idf").alias("idf"), "whole")
    asked = written(ask.mapInArrow(partial(_asked, queries=QUERIES), ASKED).select(F.monotonically_increasing_id().alias("block"), "*"), "asked")
    right = asked.toDF(*[f"q_{c}" for c in asked.columns])
    met = segments.drop("n", "total", "counts").hint("shuffle_replicate_nl").crossJoin(right)
    found = met.mapInArrow(partial(_best, k=k, share=share, avg=avg), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a column of lists, and the elements."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and those vectors, of length 1 or of zeros."""
    at, x = _lists(lists)
    have = np.unique(at)
    m = np.asarray(x, dtype=np.float64).reshape(len(have), -1) if len(have) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return have, np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _row(schema: str, *values) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    cells = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], types[t]) for v, t in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cells, names=list(names))


def _segments(batches: Iterator[pa.RecordBatch], chunks: int, postings: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task's chunks."""
    held, n, posted = [], 0, 0

    def told() -> pa.RecordBatch:
        ids, lens, counts, have, vectors, names, codes, at, tf = zip(*held, strict=True)
        ids, lens, counts, have, at, tf = (np.concatenate(c) for c in (ids, lens, counts, have, at, tf))
        own = pc.unique(pa.concat_arrays(names))
        code = np.concatenate([pc.index_in(x, value_set=own).to_numpy(zero_copy_only=False)[c] for x, c in zip(names, codes, strict=True)]).astype(np.int64)
        bare = np.ones(len(ids), bool)
        bare[have] = False
        order = np.argsort(bare, kind="stable")  # those with a vector first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = place[at]
        by = np.argsort(code * len(ids) + at, kind="stable")
        ends = np.searchsorted(code[by], np.arange(len(own) + 1))
        m = np.concatenate([v for v in vectors if len(v)]) if len(have) else np.zeros(0)
        return _row(SEGMENT, int(counts.sum()), int(lens[counts].sum()), ids[order], lens[order].astype(np.int32), counts[order], own, ends.astype(np.int64), at[by].astype(np.uint16), tf[by].astype(np.int32), len(have), m)

    for batch in batches:
        done = 0
        while done < batch.num_rows:
            part = batch.slice(done, chunks - n)
            done += part.num_rows
            at, flat = _lists(part.column("words"))
            coded = flat.dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, tf = np.unique(at * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            have, m = _units(part.column("embedding"))
            counts = part.column("counts").to_numpy(zero_copy_only=False).astype(bool)
            held.append((part.column("vec_id").to_numpy(), np.bincount(at, minlength=part.num_rows), counts, n + have, m, coded.dictionary, pairs % size, n + pairs // size, tf))
            n, posted = n + part.num_rows, posted + len(pairs)
            if n >= chunks or posted >= postings:
                yield told()
                held, n, posted = [], 0, 0
    if n:
        yield told()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many chunks of a segment each word is."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts, ends, at = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("counts", bool), ("ends", np.int64), ("at", np.uint16)))
            sums = np.concatenate(([0], np.cumsum(counts[at])))[ends]
            yield pa.RecordBatch.from_arrays([batch.column("names")[i].values, pa.array(np.diff(sums).astype(np.int64))], names=["word", "df"])


def _asked(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's queries, those with a vector first."""
    held: list[pa.RecordBatch] = []

    def told() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        bare = pc.equal(pc.fill_null(pc.list_value_length(whole.column("embedding")), 0), 0)
        whole = whole.take(pa.array(np.argsort(bare.to_numpy(), kind="stable"))).combine_chunks()
        col = {c: whole.column(c).combine_chunks() for c in whole.column_names}
        rows, flat = _lists(col["words"])
        have, m = _units(col["embedding"])
        most = np.nan_to_num(col["whole"].to_numpy(zero_copy_only=False).astype(np.float64))
        return _row(ASKED, col["query_id"].to_numpy(), most, flat, rows.astype(np.int64), np.asarray(_lists(col["idf"])[1], dtype=np.float64), len(have), m)

    for batch in batches:
        done = 0
        while done < batch.num_rows:
            held.append(batch.slice(done, queries - sum(b.num_rows for b in held)))
            done += held[-1].num_rows
            if sum(b.num_rows for b in held) >= queries:
                yield told()
                held = []
    if held:
        yield told()


def _best(batches: Iterator[pa.RecordBatch], k: int, share: float, avg: float) -> Iterator[pa.RecordBatch]:
    """The k best chunks of every query over all segments that a task meets."""
    best: dict[int, tuple] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            block = row["q_block"].as_py()
            if block not in best:
                ids = np.frombuffer(row["q_ids"].as_buffer(), np.int64).copy()
                best[block] = ids, np.zeros((len(ids), k)), np.zeros((len(ids), k), np.int64)
            _met(row, *best[block][1:], k, share, avg)
    for ids, score, vec in best.values():
        row, col = np.nonzero(score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(vec[row, col]), pa.array(score[row, col])], names=["query_id", "vec_id", "score"])


def _met(pair: dict, best: np.ndarray, vec: np.ndarray, k: int, share: float, avg: float) -> None:
    """Puts what a segment adds to the k best of a block's queries into ``best`` and ``vec``; a score of 0 is none."""
    cell = lambda c, t: np.frombuffer(pair[c].as_buffer(), t)
    ids, ends, at, tf = cell("ids", np.int64), cell("ends", np.int64), cell("at", np.uint16).astype(np.int64), cell("tf", np.int32)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * cell("lens", np.int32)[at] / avg))
    n_m, n_q = pair["embedded"].as_py(), pair["q_embedded"].as_py()
    m, q = (cell(c, np.float64).reshape(n, -1) if n else None for c, n in (("m", n_m), ("q_m", n_q)))
    whole, rows, idf = cell("q_whole", np.float64), cell("q_rows", np.int64), cell("q_idf", np.float64)
    coded = pair["q_words"].values.dictionary_encode()  # the fewer words are looked up by the more
    met = pc.index_in(pair["names"].values, value_set=coded.dictionary)
    spot = np.full(len(coded.dictionary) + 1, -1)
    spot[pc.fill_null(met, len(coded.dictionary)).to_numpy(zero_copy_only=False)] = np.arange(len(met))
    spot[-1] = -1
    word = spot[coded.indices.to_numpy(zero_copy_only=False)]
    rows, idf, word = rows[word >= 0], idf[word >= 0], word[word >= 0]
    asked = list(zip(rows.tolist(), word.tolist(), idf.tolist(), ends[word].tolist(), ends[word + 1].tolist(), strict=True))
    most = COMMON * len(ids)
    wide: dict[int, np.ndarray] = {}
    whole_row = np.empty(len(ids))
    step = max(1, SCORE_BYTES // (8 * len(ids)))
    for first in range(0, len(whole), step):
        own = slice(first, first + step)
        key = np.zeros((len(whole[own]), len(ids)))
        lo, hi = np.searchsorted(rows, [first, first + step])
        for row, w, x, a, b in asked[lo:hi]:
            own_row = key[row - first]
            if b - a <= most:
                np.add.at(own_row, at[a:b], part[a:b] * x)
                continue
            if w not in wide:
                wide[w] = np.zeros(len(ids))
                wide[w][at[a:b]] = part[a:b]
            own_row += np.multiply(wide[w], x, out=whole_row)
        key /= np.where(whole[own] > 0, whole[own], 1.0)[:, None]
        key *= 1 - share
        some, score = min(max(n_q - first, 0), len(key)), key
        if some and n_m:
            cos = np.maximum(q[first : first + some] @ m.T, 0.0)
            score = key.copy()
            score[:some, :n_m] += share * cos
        # only what may reach the k-th score is rounded and sorted
        least = np.maximum(best[own, -1] - ROOM, ROOM / 8)
        if len(ids) > 2 * k and not best[own, -1].all():
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - ROOM)
        row, col = np.divmod(np.flatnonzero(score >= least[:, None]), len(ids))
        s = key[row, col]
        if some and n_m:
            both = (row < some) & (col < n_m)
            s[both] = share * np.round(cos[row[both], col[both]], 6) + s[both]
        s = np.floor(s * 1e6 + 0.5) / 1e6  # halves go up, as in SQL: half a rounded cosine often is one
        had, place = np.nonzero(best[own] > 0)
        row, s, i = np.concatenate((had, row)), np.concatenate((best[own][had, place], s)), np.concatenate((vec[own][had, place], ids[col]))
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (rank < k) & (s > 0)
        best[own] = 0.0
        best[first + row[keep], rank[keep]], vec[first + row[keep], rank[keep]] = s[keep], i[keep]
