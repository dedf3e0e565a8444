"""Benchmark decontamination: broadcast sets of test n-grams, probed by every training window.

Words are runs of letters, digits and non-ASCII characters after lower-casing
A-Z. A benchmark item gives its windows of 13 words; a shorter item, unless
it has no words, is one window. Each document is read whole: the hashes of
all its windows are looked up in the set, and every hit is compared word by
word, so that no hash collision reaches the result.

The set is sent to the executors only in parts of at most ``part_bytes`` of
benchmark text. A larger benchmark takes several parts, one scan each, which
add to the same per-document columns; what a scan has found is written before
the next one, so that one part is alive at a time. Nothing is shuffled.

Defined cases: a null text, or one without words, has no words and no hits; a
null item text or one without words gives no window; items with equal windows
are all reported; items with a null id hit like any, and are reported as one
null at the end of ``items``, counted but not in the digest, as in the SQL;
repeated document rows are judged one by one; an empty
benchmark gives no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tables import table
from marlstone.llm.textops import ALNUM_LOWER, Words, as_bytes, slices, tune
from marlstone.session import written

WINDOW = 13
PART_BYTES = 4 << 20
_BITS = 20


class GramSet:
    """Windows of benchmark items: sorted hashes for the search, and where each stands for the proof.

    Built by one pass a window length; a window takes 16 bytes beside its text.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.words = Words([t for _, t in items], ALNUM_LOWER)
        first, counts = self.words.first, self.words.counts
        lengths = np.minimum(window, counts)
        self.hashes: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        self.owner: dict[int, np.ndarray] = {}
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n)
            many = counts[own] - n + 1
            owner = np.repeat(own, many)
            at = first[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            h = words_hash(self.words, n)[at]
            order = np.argsort(h, kind="stable")
            self.hashes[n], self.at[n], self.owner[n] = h[order], at[order].astype(np.int32), owner[order].astype(np.int32)
        self.words.forget()

    def owners(self, n: int, h: np.uint64, text: bytes) -> set[str | None]:
        """Items that hold the window, compared word by word."""
        lo, hi = np.searchsorted(self.hashes[n], h, side="left"), np.searchsorted(self.hashes[n], h, side="right")
        return {self.names[o] for a, o in zip(self.at[n][lo:hi].tolist(), self.owner[n][lo:hi].tolist(), strict=True) if self.words.text(a, a + n) == text}

    def filters(self) -> dict[int, np.ndarray]:
        """For each window length, a table of the hashes' low bits."""
        out = {}
        for n, hs in self.hashes.items():
            out[n] = np.zeros(1 << _BITS, dtype=bool)
            out[n][(hs & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return out


def words_hash(words: Words, n: int) -> np.ndarray:
    return words.grams(n)


def probe(words: Words, grams: GramSet, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, set[str | None]]]:
    """Which words are hit, and the items found in each text."""
    hit = np.zeros(int(words.first[-1]), dtype=bool)
    items: dict[int, set[str | None]] = defaultdict(set)
    for n, hashes in grams.hashes.items():
        at = words.grams(n)
        maybe = np.flatnonzero(filters[n][(at & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        maybe = maybe[hashes[np.minimum(np.searchsorted(hashes, at[maybe]), len(hashes) - 1)] == at[maybe]]
        docs = np.searchsorted(words.first, maybe, side="right") - 1
        inside = maybe + n <= words.first[docs + 1]
        for s, d in zip(maybe[inside].tolist(), docs[inside].tolist(), strict=True):
            if owners := grams.owners(n, at[s], words.text(s, s + n)):
                hit[s : s + n] = True
                items[d].update(owners)
    return hit, items


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[GramSet]:
    """The benchmark in parts whose texts have about ``part_bytes`` at most."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    k = max(1, -(-2 * size // part_bytes) if size > part_bytes else 1)
    for i in range(k):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i) if k > 1 else bench
        yield GramSet([(r[0], bytes(r[1]) if r[1] is not None else None) for r in part.collect()])


def _scan(df: DataFrame, grams: GramSet, last: bool) -> DataFrame:
    """Add a part's hits to the columns _hit (one byte a word) and _items."""
    sent = df.sparkSession.sparkContext.broadcast(grams)
    spare = [f for f in df.schema.fields if f.name not in ("_n", "_hit", "_items")]
    end = "_n long, _n_hit long, _items array<string>" if last else "_n long, _hit binary, _items array<string>"
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spare) + ", " + end
    first = "_hit" not in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = sent.value
        filters = grams.filters()
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index("_text")))
            old_hit = [None] * len(texts) if first else batch.column(batch.schema.get_field_index("_hit")).to_pylist()
            old_items = [None] * len(texts) if first else batch.column(batch.schema.get_field_index("_items")).to_pylist()
            n, hits, found = [], [], []
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi], ALNUM_LOWER)
                hit, items = probe(words, grams, filters)
                for k in range(hi - lo):
                    i, j = int(words.first[k]), int(words.first[k + 1])
                    one = hit[i:j]
                    if old_hit[lo + k]:
                        one = one | np.frombuffer(old_hit[lo + k], dtype=bool)
                    n.append(j - i)
                    hits.append(int(one.sum()) if last else one.tobytes())
                    found.append(sorted(items.get(k, set()) | set(old_items[lo + k] or ()), key=lambda x: (x is None, x or "")))
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in spare]
            more = [pa.array(n, pa.int64()), pa.array(hits, pa.int64() if last else pa.binary()), pa.array(found, pa.list_(pa.string()))]
            names = [f.name for f in spare] + ["_n", "_n_hit" if last else "_hit", "_items"]
            yield pa.RecordBatch.from_arrays(kept + more, names=names)

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, benchmark: DataFrame, keep: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Columns ``keep`` of every document, with n_words, n_hit, items and contaminated.

    contaminated: the hit words are a twentieth of all words, or more.
    """
    tune(docs.sparkSession)
    # one struct, so that no name of the caller's meets one of ours
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), F.col("text").alias("_text"))
    parts = _parts(benchmark, part_bytes)
    part = next(parts)
    for after in parts:
        out = written(_scan(out, part, last=False), "hits")  # one part at a time is alive in a task
        part = after
    out = _scan(out, part, last=True)
    return out.select(
        *[F.col("_keep")[c].alias(c) for c in keep],
        F.col("_n").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.col("_items").alias("items"),
        ((F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = score(docs.select(row, "text"), benchmark, ["_row"])
    return judged.where(~F.col("contaminated")).select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and text without its hit words; a text without hits stays as it is, a cut one has its words joined by spaces."""
    tune(docs.sparkSession)
    out = docs.select("doc_id", "text")
    for grams in _parts(benchmark, part_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            grams = sent.value
            filters = grams.filters()
            for batch in batches:
                texts = as_bytes(batch.column(1))
                cut = []
                for lo, hi in slices(texts):
                    words = Words(texts[lo:hi], ALNUM_LOWER)
                    hit, _ = probe(words, grams, filters)
                    for k in range(hi - lo):
                        i, j = int(words.first[k]), int(words.first[k + 1])
                        t = texts[lo + k]
                        if hit[i:j].any():
                            # bytes of the slice start one after the joining space
                            at = 1 + sum(len(x or b"") + 1 for x in texts[lo : lo + k])
                            t = b" ".join(t[a - at : b - at] for a, b, h in zip(words.start[i:j].tolist(), words.end[i:j].tolist(), hit[i:j].tolist(), strict=True) if not h)
                        cut.append(t)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

        out = written(out.mapInArrow(run, "doc_id long, text string"), "cut")
    return out


def digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"),
        "contaminated",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_decontaminate": op7}

ORACLE = {
    "op7_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN g ON dw.n = g.n AND dw.gram = g.gram),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
        FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""",
}
