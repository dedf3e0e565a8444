"""Each set's shingles that other documents have too, rare ones first.

One order of all shingles, rare ones first, keeps the prefixes of a similarity
join short: a shingle that no other document has can be in no link at all, so
it takes its place in the prefix and is never sent on. Exact numbers of
documents are needed for that, at any size of the corpus, without a table that
every executor holds. So the shingles make one round trip:

1. A task gathers the sets of a slice of documents (``SLICE_ENTRIES`` shingles,
   or one larger document) and sends their hashes, packed by hash range. A
   hash of ``OFTEN`` or more documents of the slice travels once with its
   count, so no hash, however common, fills a range.
2. The task of a range counts the documents of each hash and sends back those
   hashes that two or more have, with a level: the logarithm of that number.
3. The task of a slice puts its documents together again.

Rows are packed arrays, so Spark moves few large rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.blobs import part_bits
from marlstone.llm.textops import as_bytes, mix, slices
from marlstone.session import width

SLICE_ENTRIES = 1 << 19
ALL = (1 << 16) - 1  # in place of a document's number: all documents of the slice that have the hash
OFTEN = 8
ODD_BITS = 512
TEXT_A_PART = 16 << 20

_SENT = "to int, kind int, slice long, h binary, at binary, more binary"
_ENTRIES, _DOCUMENTS, _OFTEN = range(3)
SURVEY = "doc_id long, n long, s1 long, s2 long, odd array<long>, own long, keys array<long>"

SetsOf = Callable[[list[bytes | None]], tuple[np.ndarray, np.ndarray]]


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, dtype=np.uint64).view(np.int64)


def odd_bits(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """ODD_BITS bits of each set: whether an odd number of its shingles falls into each of as many buckets.

    Every bit in which two sets differ stands for a shingle that only one of them has.
    """
    m = len(bound) - 1
    d = np.repeat(np.arange(m), np.diff(bound))
    at = d * ODD_BITS + ((h >> np.uint64(20)) & np.uint64(ODD_BITS - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=m * ODD_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).reshape(m, -1)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for i in range(0, len(rows), 32):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 32], strict=True), kinds, strict=True)], names=["to", "kind", "slice", "h", "at", "more"])


def _split(h: np.ndarray, at: np.ndarray, count: np.ndarray, bits: int, name: int) -> Iterator[tuple]:
    """Rows of entries by hash range; only the 32 bits after the range's are sent."""
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, at, count = part[order], at[order], count[order]
    short = ((h[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        many = count[a:b][at[a:b] == ALL].astype(np.uint16)
        yield int(part[a]), _ENTRIES, name, short[a:b].tobytes(), at[a:b].tobytes(), many.tobytes()


def _dealt(docs: DataFrame, sets_of: SetsOf, bits: int) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        documents, entries = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = (task << 32) | number
            number += 1
            base = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            ids, valid, n, h, doc = (np.concatenate(c) for c in zip(*[(x[0], x[1], x[2], x[3], x[4] + b) for x, b in zip(held, base, strict=True)], strict=True))
            more = np.concatenate([x[5] for x in held], axis=1)
            own = np.concatenate((valid[None].astype(np.int64), more))
            sent = valid[doc]
            h, doc = h[sent], doc[sent]
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order].astype(np.uint16)
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(h)))
            often = np.repeat(count >= OFTEN, count)
            single = ~often
            once = first[count >= OFTEN]
            sent_h = np.concatenate((h[single], h[once]))
            sent_at = np.concatenate((doc[single], np.full(len(once), ALL, np.uint16)))
            sent_n = np.concatenate((np.ones(int(single.sum()), np.int64), count[count >= OFTEN]))
            home = name % (1 << bits)
            rows = [(home, _DOCUMENTS, name, ids.tobytes(), n.astype(np.uint32).tobytes(), own.tobytes())]
            if often.any():
                rows.append((home, _OFTEN, name, (h[often] >> np.uint64(32 - bits)).tobytes(), doc[often].tobytes(), b""))
            yield from _rows(rows + [*_split(sent_h, sent_at, sent_n, bits, name)])

        for batch in source:
            texts = as_bytes(batch.column(1))
            valid = ~np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            for lo, hi in slices(texts):
                h, bound = sets_of(texts[lo:hi])
                n = np.diff(bound)
                if held and (entries + len(h) > SLICE_ENTRIES or documents + len(n) >= ALL):
                    yield from flush()
                    held, documents, entries = [], 0, 0
                sums = []
                for salt in (0x6A09E667, 0xBB67AE85):
                    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
                    sums.append(signed(s[bound[1:]] - s[bound[:-1]]))
                held.append((ids[lo:hi], valid[lo:hi], n, h, np.repeat(np.arange(len(n)), n), np.concatenate((sums, odd_bits(h, bound).T))))
                documents, entries = documents + len(n), entries + len(h)
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, _SENT)


def _counted(rows: DataFrame) -> DataFrame:
    """The entries of hashes that two or more documents have, with their level; other rows pass."""
    dealt = rows.repartition(width(rows.sparkSession), F.col("to")).sortWithinPartitions("to")

    def shared(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x[1]) for x in held])
        h, at = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        weight = np.ones(len(h), np.int64)
        weight[at == ALL] = np.concatenate([x[3] for x in held])
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_h[1:] != sorted_h[:-1])))
        count = np.add.reduceat(weight[order], first)
        level = np.zeros(len(h), np.uint8)
        level[order] = np.repeat(np.where(count > 1, np.minimum(np.ceil(np.log2(count) * 8), 255), 0).astype(np.uint8), np.diff(np.append(first, len(h))))
        ends = np.cumsum(size)
        rows = []
        for (name, *_), a, b in zip(held, ends - size, ends, strict=True):
            keep = np.flatnonzero(level[a:b]) + a
            if len(keep):
                rows.append((part, _ENTRIES, name, h[keep].tobytes(), at[keep].tobytes(), level[keep].tobytes()))
        yield from _rows(rows)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in source:
            passing = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                to, kind, name, h, at, more = row
                if to != part and held:
                    yield from shared(part, held)
                    held = []
                part = to
                if kind == _ENTRIES:
                    held.append((name, np.frombuffer(h, np.uint32), np.frombuffer(at, np.uint16), np.frombuffer(more, np.uint16)))
                else:
                    passing.append(row)
            yield from _rows(passing)
        if held:
            yield from shared(part, held)

    return dealt.mapInArrow(run, _SENT)


def _gathered(rows: DataFrame) -> DataFrame:
    dealt = rows.repartition(width(rows.sparkSession), F.col("slice")).sortWithinPartitions("slice")

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        none64, none16, none8 = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8)
        keys, ats, levels, many_key, many_at = [none64], [none16], [none8], none64, none16
        for to, kind, _, h, at, more in rows:
            if kind == _ENTRIES:
                keys.append(np.frombuffer(h, np.uint32) | (np.uint64(to) << np.uint64(32)))
                ats.append(np.frombuffer(at, np.uint16))
                levels.append(np.frombuffer(more, np.uint8))
            elif kind == _OFTEN:
                many_key, many_at = np.frombuffer(h, np.uint64), np.frombuffer(at, np.uint16)
            else:
                ids, n = np.frombuffer(h, np.int64), np.frombuffer(at, np.uint32).astype(np.int64)
                own = np.frombuffer(more, np.int64).reshape(-1, len(ids))
        key, at, level = np.concatenate(keys), np.concatenate(ats), np.concatenate(levels)
        every = at == ALL
        if every.any():
            lo, hi = np.searchsorted(many_key, key[every], side="left"), np.searchsorted(many_key, key[every], side="right")
            size = hi - lo
            place = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            key, at, level = np.concatenate((key[~every], np.repeat(key[every], size))), np.concatenate((at[~every], many_at[place])), np.concatenate((level[~every], np.repeat(level[every], size)))
        order = np.lexsort((key, level, at))
        key, at, level = key[order], at[order].astype(np.int64), level[order]
        m = np.bincount(at, minlength=len(ids))
        alone = n - m
        place = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m) + alone[at]
        prefix = n - -(-3 * n // 4)
        inside = place < prefix[at] + 2
        key, m = key[inside], np.bincount(at[inside], minlength=len(ids))
        ends = np.concatenate(([0], np.cumsum(m)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(key)))
        odd = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(own[3:].T).reshape(-1)), ODD_BITS // 64).cast(pa.list_(pa.int64()))
        arrays = [pa.array(ids, mask=own[0] == 0), pa.array(n), pa.array(own[1]), pa.array(own[2]), odd, pa.array(alone), lists]
        out = pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "s1", "s2", "odd", "own", "keys"])
        for i in range(0, out.num_rows, 4096):
            yield out.slice(i, 4096)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in source:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[2] != current and held:
                    yield from told(held)
                    held = []
                current = row[2]
                held.append(row)
        if held:
            yield from told(held)

    return dealt.mapInArrow(run, SURVEY)


def survey(docs: DataFrame, sets_of: SetsOf) -> DataFrame:
    """One row a document: doc_id, n (size of its set), s1 and s2 (sums over the set), odd (see ``odd_bits``),

    own (its shingles that no other document has, first in the order) and keys (the others within the first
    n - ceil(3n/4) + 2 of the order, in order). Documents without doc_id have no keys.
    """
    bits = part_bits(docs, TEXT_A_PART)
    return _gathered(_counted(_dealt(docs, sets_of, bits)))
