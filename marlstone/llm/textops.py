"""Words, word hashes and n-gram hashes of Arrow batches of texts.

Words are found on UTF-8 bytes, many documents at once: one ``translate``,
one separator scan, and a polynomial prefix sum that hashes all words of a
slice with a few numpy passes. Slices bound the memory of a task whatever the
size of an Arrow batch; a text longer than a slice is one slice, unless it is
read in ``runs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

_BLANK = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_BLANK_LOWER = bytes(b + 32 if 65 <= b <= 90 else _BLANK[b] for b in range(256))
_ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Byte translations: the separators of a word become a space.
BLANK, BLANK_LOWER, ALNUM_LOWER = _BLANK, _BLANK_LOWER, _ALNUM_LOWER

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, in rows and in bytes: texts are long, and neither Python workers nor Arrow's buffers are large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= SLICE_BYTES * 2:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """All words of some texts.

    ``buf``: translated bytes; ``start``/``end``: byte bounds of each word in
    it; ``first``: index of each text's first word, with the total at the end;
    ``hash``: one 64-bit hash a word.
    """

    def __init__(self, texts: list[bytes | None], table: bytes):
        raw = b" " + b" ".join(t or b"" for t in texts) + b" "
        self.buf = raw.translate(table)
        a = np.frombuffer(self.buf, dtype=np.uint8)
        edge = np.flatnonzero(np.diff((a != 32).view(np.int8)))
        self.start, self.end = edge[0::2] + 1, edge[1::2] + 1
        sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        base = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, base).astype(np.int64)
        self._a = a
        self._sums: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def span_hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the bytes from each start to its end."""
        n = len(self._a)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self._a.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self._sums[1:])
        back = _powers(_BASE_INV, n)
        return mix((self._sums[end] - self._sums[start]) * back[start] + (end - start).astype(np.uint64) + np.uint64(seed << 32))

    def grams(self, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``n`` words from each word on; only those within a text mean anything."""
        h = self.hash
        total = max(0, len(h) - n + 1)
        out = np.full(total, seed & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k in range(n):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[k : k + total]
        return mix(out)

    def starts(self, n: int) -> np.ndarray:
        """Indices of words from which ``n`` words of the same text follow, the word included."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(self.first[-1])
        return np.flatnonzero(left >= n)

    def forget(self) -> None:
        """Drop what hashing needs, before the words are kept or sent."""
        self._a, self._sums, self._hash = np.zeros(0, np.uint8), None, None

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` (exclusive), joined by one space."""
        return b" ".join([self.buf[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def runs(text: bytes, table: bytes, n: int, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text cut at blanks into runs of about ``most`` bytes; each repeats the ``n - 1`` words before it,

    so that every ``n`` words stand together in one run. A single longer word is not cut.
    """
    at, size = 0, len(text)
    while at < size:
        end = min(size, at + most)
        while end < size and table[text[end]] != 32:
            end += 1
        begin = at
        for _ in range(n - 1):  # back over one word and the blanks before it
            while begin > 0 and table[text[begin - 1]] == 32:
                begin -= 1
            while begin > 0 and table[text[begin - 1]] != 32:
                begin -= 1
        yield text[begin:end]
        at = end


def slices(texts: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if i > lo and size + k > most:
            yield lo, i
            lo, size = i, 0
        size += k
    if lo < len(texts):
        yield lo, len(texts)
