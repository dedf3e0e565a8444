"""Source divergence audit: how far the sources of a language differ, and by which terms.

Terms are counted per (lang, source) in each task and summed by one shuffle;
documents and texts travel no further. With N occurrences of kept terms in a
group and V kept terms in its language, a count c gives the share
p(c) = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two shares the divergence
f(p, q) = floor((p - q)^2 / (p + q)), all in whole numbers.

Pairs of sources are summed sparsely. A term that neither source has adds the
same baseline f(p(0), q(0)), so a pair's value is V baselines, plus what each
source's own terms differ from the baseline (by the histogram of its shares,
not term by term), plus a correction for the terms that both have. The last is
added up inside the tasks, term after term, and only sums of pairs leave them.

The leading terms of every group are found by radix selection: a histogram of
16 value bits at a time finds the digit that holds each group's k-th value;
terms above it are taken, terms below it dropped, and those on it go on. Terms
that tie in the whole value are refined by their UTF-8 bytes in the same way,
in pieces that grow, so no group is ever sorted.

Tables of one row a group are broadcast up to ``SMALL_ROWS`` rows (counted
first) and joined by a shuffle beyond.

Defined cases: null text, lang and source are empty strings; every row counts
as a document, repeated ones too; a group without kept terms has the share of
count 0 for each kept term, and value 0 where its language keeps none; a
language of one source has no pairs; an empty table gives no rows. doc_id and
extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.tables import table
from marlstone.llm.textops import SLICE_BYTES, as_bytes, runs, tune
from marlstone.session import width, written

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
SMALL_ROWS = 100_000
#: Different terms that a task counts, and pairs that it adds up, before it sends them on.
TERMS_A_TASK, PAIRS_A_STEP, PAIRS_A_TASK = 200_000, 1 << 20, 1 << 21
DIGIT = 16
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in groups.items():
                terms = list(n)
                for at in range(0, len(terms), 1 << 16):
                    some = terms[at : at + (1 << 16)]
                    cols = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string())]
                    counts = [pa.array([c[t] for t in some], pa.int64()) for c in (n, of)]
                    yield pa.RecordBatch.from_arrays([*cols, *counts], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            for lang, source, text in zip(langs, sources, texts, strict=True):
                if not text:
                    continue
                n, of = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                if len(text) <= SLICE_BYTES:
                    words = text.translate(_LETTERS).split()
                    n.update(words)
                    of.update(set(words))
                else:
                    seen: set[bytes] = set()
                    for piece in runs(text, _LETTERS, 1):
                        words = piece.translate(_LETTERS).split()
                        n.update(words)
                        seen.update(words)
                    of.update(seen)
                held += len(n) - before
                if held >= TERMS_A_TASK:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = _named(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # dealt by (lang, term) once: the sums here and over all sources later need no other exchange
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _share(count: Column | str, total: str) -> Column:
    """1 + floor(SCALE (count + 2) / total), exact for any long; null for a total of 0."""
    c = (F.col(count) if isinstance(count, str) else count) + 2
    above = F.lit(SCALE).cast("decimal(10,0)") * c.cast("decimal(20,0)")
    return F.call_function("div", above, F.nullif(F.col(total), F.lit(0)).cast("decimal(20,0)")) + 1


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def cells_and_groups(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms of the groups that have them: (gid, lang, term, p, p0, q); all groups: (gid, lang, source, v, p0)."""
    term = Window.partitionBy("lang", "term").orderBy("source")  # one row a source of the language; one order, so one sort
    whole = term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = term_counts(docs).withColumns({"in_lang": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "nth": F.row_number().over(term)})
    kept = written(counts.where(F.col("in_lang") >= least_docs).select("lang", "source", "term", "n", "lang_n", "nth"), "kept-terms")
    one = F.when(F.col("nth") == 1, F.col("lang_n"))
    langs = kept.groupBy("lang").agg(F.count(one).alias("v"), F.sum(one).alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    all_groups = _named(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    sums = all_groups.select("lang", "source", "v", (F.col("total") + 2 * F.col("v")).alias("total"), (F.col("lang_total") + 2 * F.col("v")).alias("lang_total"))
    groups = written(sums.select(F.monotonically_increasing_id().alias("gid"), "*", _share(F.lit(0), "total").alias("p0")), "groups")
    cells = kept.join(_small(groups), ["lang", "source"])
    cells = cells.select("gid", "lang", "term", _share("n", "total").alias("p"), "p0", _share("lang_n", "lang_total").alias("q"))
    return written(cells, "cells"), groups


def _common(cells: DataFrame) -> DataFrame:
    """(a, b, value), a < b: what the terms of both groups add to the sums of the baseline and of each one's own terms.

    Streams over the terms; a task holds one term's groups and the sums of pairs.
    """
    dealt = cells.repartition(width(cells.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "gid")

    def div(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def summed(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        a, b, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b, v = a[order], b[order], v[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return [(a[at], b[at], np.add.reduceat(v, at))]

    def pairs(gid: np.ndarray, p: np.ndarray, p0: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Sums of pairs for whole terms, whose rows begin at ``first``."""
        end = np.repeat(np.append(first[1:], len(gid)), np.diff(np.append(first, len(gid))))
        later = end - np.arange(len(gid)) - 1  # partners of each row within its term
        upto = np.concatenate(([0], np.cumsum(later)))
        lo = 0
        while lo < len(gid):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS_A_STEP, side="right")) - 1)
            x = np.repeat(np.arange(lo, hi), later[lo:hi])
            y = x + 1 + np.arange(len(x)) - (upto[x] - upto[lo])
            if len(x):
                v = div(p[x], p[y]) - div(p[x], p0[y]) - div(p0[x], p[y]) + div(p0[x], p0[y])
                yield summed([(gid[x], gid[y], v)])[0]
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        sums: list[tuple[np.ndarray, ...]] = []

        def told() -> Iterator[pa.RecordBatch]:
            for a, b, v in summed(sums) if sums else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, v)], names=["a", "b", "value"])

        def added(rows: pa.Table, whole: bool) -> tuple[pa.Table | None, bool]:
            """Add up the terms that are complete; the rest, and whether the sums are many."""
            nonlocal sums
            rows = rows.combine_chunks()
            new = np.ones(len(rows), dtype=bool)
            for k in (0, 1):
                c = rows.column(k)
                differ = pc.not_equal(c.slice(1), c.slice(0, len(rows) - 1)).to_numpy()
                new[1:] = differ if k == 0 else new[1:] | differ
            first = np.flatnonzero(new)
            cut = len(rows) if whole else int(first[-1])
            first = first if whole else first[:-1]
            if cut:
                gid, p, p0 = (rows.column(k).to_numpy()[:cut] for k in (2, 3, 4))
                sums += pairs(gid, p, p0, first)
                if sum(len(s[0]) for s in sums) > PAIRS_A_STEP:
                    sums = summed(sums)
            return None if whole else rows.slice(cut), sum(len(s[0]) for s in sums) > PAIRS_A_TASK

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held, many = added(rows if held is None else pa.concat_tables([held, rows]), whole=False)
                if many:
                    yield from told()
                    sums = []
        if held is not None:
            added(held, whole=True)
        yield from told()

    return dealt.select("lang", "term", "gid", "p", "p0").mapInArrow(run, "a long, b long, value long")


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from every other one of its language."""
    small = _small(groups)
    own = groups.select(F.col("gid").alias("a"), "lang", F.col("p0").alias("pa"), "v")
    other = small.select(F.col("gid").alias("b"), "lang", F.col("p0").alias("pb"))
    both = own.join(other, "lang").where("a <> b")  # the pairs of the result
    base = both.select("a", "b", F.coalesce(F.col("v") * _f("pa", "pb"), F.lit(0).cast("long")).alias("value"))
    shares = cells.groupBy(F.col("gid").alias("a"), "lang", F.col("p0").alias("pa"), "p").agg(F.count("*").alias("m"))
    alone = shares.join(other, "lang").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("m") * (_f("p", "pb") - _f("pa", "pb"))).alias("value"))
    alone = written(alone, "alone")
    common = written(_common(cells).groupBy("a", "b").agg(F.sum("value").alias("value")), "common")
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = base.union(alone).union(turned(alone)).union(common).union(turned(common))
    names = lambda c, name: small.select(F.col("gid").alias(c), F.col("source").alias(name))
    total = parts.groupBy("a", "b").agg(F.sum("value").alias("value"))
    lang = small.select(F.col("gid").alias("a"), "lang")
    return total.join(names("a", "source"), "a").join(lang, "a").join(names("b", "item"), "b").select("lang", "source", "item", "value")


def _digits(open_: DataFrame, digit: Column, ascending: bool) -> DataFrame:
    """``open_`` (gid, item, value, need) with the digit, its group's threshold digit t, and taken: how many stand before t.

    t is null where all of the group's rows are wanted.
    """
    rows = open_.withColumn("digit", digit)
    order = F.asc("digit") if ascending else F.desc("digit")
    up = Window.partitionBy("gid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("gid", "need", "digit").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(up))
    over = bins.where("upto > need")
    first = F.min_by if ascending else F.max_by
    t = over.groupBy("gid").agg((F.min if ascending else F.max)("digit").alias("t"), first(F.col("upto") - F.col("n"), "digit").alias("taken"))
    return rows.join(_small(written(t, "thresholds")), "gid", "left")


def radix_top(rows: DataFrame, k: int) -> DataFrame:
    """(gid, item, value) of the ``k`` greatest values of each gid, ties by the least item in UTF-8 bytes.

    Values are whole and not negative; items differ within a gid.
    """
    open_ = written(rows.select("gid", "item", "value", F.lit(k).cast("long").alias("need")), "candidates")
    size = open_.agg(F.max("value"), F.max(F.octet_length("item"))).first()
    found: DataFrame | None = None
    bits = max(1, int(size[0] or 0).bit_length())
    shifts = [s for s in range(48, -1, -DIGIT) if s < bits]
    pieces, at, step = [], 1, 8
    while at <= (size[1] or 0):
        pieces.append((at, step))
        at, step = at + step, step * 4
    steps = [(F.shiftrightunsigned("value", s).bitwiseAND((1 << DIGIT) - 1), False) for s in shifts]
    steps += [(F.substring(F.encode("item", "UTF-8"), a, n), True) for a, n in pieces]
    for digit, ascending in steps:
        met = written(_digits(open_, digit, ascending), "digits")
        before = F.col("digit") < F.col("t") if ascending else F.col("digit") > F.col("t")
        taken = met.where(F.col("t").isNull() | before).select("gid", "item", "value")
        found = taken if found is None else found.union(taken)
        left = F.col("need") - F.col("taken")
        open_ = met.where((F.col("digit") == F.col("t")) & (left > 0)).select("gid", "item", "value", left.alias("need"))
        if open_.isEmpty():
            break
    return found if found is not None else open_.select("gid", "item", "value")


def divergence(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    cells, groups = cells_and_groups(docs, least_docs)
    candidates = cells.where("p > q").select("gid", F.col("term").alias("item"), _f("p", "q").alias("value"))
    terms = radix_top(candidates, top).join(_small(groups).select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    pairs = pair_values(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    # a group has at most ``top`` terms here, and as many pairs as its language has other sources
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return terms.union(pairs).withColumn("rank", F.row_number().over(order))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_source_divergence": op12}

ORACLE = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, ln, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (g.total + 2 * v.v) AS BIGINT) AS p,
        CAST(1 + (1000000000::HUGEINT * (ln + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
b AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u WHERE part = 'pair' OR rank <= 10
""",
}
