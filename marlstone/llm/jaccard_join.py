"""N-gram Jaccard join: size-aware, heavy and light sets.

A document's set holds its distinct 5-word shingles. Sets of at most ``x``
shingles are light: all pairs of shingles of a prefix are enumerated as keys.
Larger sets are heavy: the shingles of a shorter prefix are inverted lists,
which are scanned; light sets near the boundary also stand in the lists, so
that a light and a heavy set can meet. The boundary ``x`` is the one of least
cost: pairs to enumerate against list entries to write and to scan, summed
over all sets, for every size that occurs.

Prefixes follow one order for the whole corpus, rare shingles first, from the
number of documents of each shingle (see ``shared_shingles``). A shingle that
no other document has takes its place in the prefix, but is never sent.
Two sets with a Jaccard similarity of 3/4 share at least k shingles in
prefixes of n - ceil(3n/4) + k: no link is missed.

Links are found in rounds. First, again and again while it pays, a few sets of
each list or key group are compared with the others of the group that are not
in their component yet: a group of any size costs a few comparisons a member.
Then only sets of a group that is still in different components are compared,
by lists of single shingles whatever their size, each pair at the first
shingle that both have. Pairs whose parity bits (see ``odd_bits``) differ too much cannot be links; every
other pair is decided on the whole texts. Equal sets are one class from the
start and are represented by their least doc_id.

Defined cases: a null text, or one without words, has an empty set, links
with nothing and is its own component; a text of fewer than 5 words has one
shingle, the whole; a null doc_id is linked with nothing and has a null
component; rows that share a doc_id are one document, which links where any
of its texts does, each different text being compared once; n_shingles is the
row's own; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.blobs import free_shuffles
from marlstone.operators.graph import extended
from marlstone.llm.shared_shingles import ODD_BITS, signed, survey
from marlstone.llm.tables import table
from marlstone.llm.textops import BLANK_LOWER, Words, SLICE_BYTES, as_bytes, mix, runs, slices, tune
from marlstone.session import width, written

SHINGLE = 5
#: Star rounds go on while at least one comparison in STAR_YIELD finds a link, MOST_TURNS at most; each has PIVOTS leaders a group.
STAR_YIELD, MOST_TURNS, PIVOTS = 8, 4, 4
SCAN = 1 / 16
#: Members of a fan: pairs of one document that meet one copy of its text.
FAN, FAN_ROWS = 512, 200_000
#: Earlier keys that an entry of the last round carries, to meet a pair once: one that shares more of them may be met again.
WINDOW = 64


def sets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds of each text's) of the texts' sets, in order of hash.

    A text longer than a slice is read in runs that overlap by ``SHINGLE - 1``
    words, so that its working arrays stay as small as a slice's.
    """
    if len(texts) == 1 and texts[0] and len(texts[0]) > SLICE_BYTES:
        h = np.unique(np.concatenate([_sets([r])[0] for r in runs(texts[0], BLANK_LOWER, SHINGLE)]))
        return h, np.array([0, len(h)])
    return _sets(texts)


def _sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts, BLANK_LOWER)
    counts = words.counts
    at = words.starts(SHINGLE)
    keys, docs = [words.grams(SHINGLE)[at]], [words.doc[at] if len(at) else at]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            keys.append(words.grams(n, seed=n)[words.first[short]])
            docs.append(short)
    h, d = np.concatenate(keys), np.concatenate(docs).astype(np.int64)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


def _may_link(nx: str, ny: str, ox: str, oy: str) -> Column:
    """False only if the sets' similarity is below 3/4: a seventh of the sizes' sum bounds what just one of the two has."""
    differ = sum((F.bit_count(F.col(ox)[i].bitwiseXOR(F.col(oy)[i])) for i in range(ODD_BITS // 64)), F.lit(0))
    return 7 * differ <= F.col(nx) + F.col(ny)


def boundary(survey: DataFrame) -> int:
    """The largest light size: the one of least cost, among all sizes that occur.

    A light set costs the pairs of its prefix, a heavy one the entries of its
    prefix, each written once and scanned: a list is scanned against PIVOTS
    leaders, whatever its length, and SCAN is the cost of such a step in
    entries written. Shingles of one set alone cost nothing.
    """
    k = F.size("keys")
    rest = F.col("n") - F.ceil(F.col("n") * 3 / 4)
    scanned = F.greatest(F.least(k, rest + 1 - F.col("own")), F.lit(0)) * (1 + SCAN * PIVOTS)
    costs = survey.where("doc_id IS NOT NULL AND n > 1").groupBy("n").agg(F.sum(k * (k - 1) / 2).alias("light"), F.sum(scanned).alias("heavy"))
    # one row a size of set
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    cost = F.sum("light").over(up) + F.coalesce(F.sum("heavy").over(down), F.lit(0.0))
    none = costs.agg(F.lit(0).cast("long").alias("n"), F.coalesce(F.sum("heavy"), F.lit(0.0)).alias("cost"))
    return costs.select("n", cost.alias("cost")).union(none).orderBy("cost", "n").first()[0]


def _postings(survey: DataFrame, x: int) -> DataFrame:
    """(key, n, s1, doc_id, lead): keys of light sets and list entries of heavy ones.

    lead: the entry may find sets of this size or larger (for list entries: in the prefix for the smaller set of a pair).
    """
    near = -(-3 * (x + 1) // 4)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, n, s1, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            lists = batch.column(4)
            h = np.asarray(lists.flatten()).view(np.uint64)
            bound = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)))))
            m = np.diff(bound)
            d = np.repeat(np.arange(len(ids)), m)
            pos = np.arange(len(h)) - bound[d] + own[d]
            entry = np.flatnonzero((n[d] >= near) & (pos <= n[d] - -(-3 * n[d] // 4)))
            keys, owner = [mix(h[entry] ^ np.uint64(0xA5A5A5A5))], [d[entry]]
            lead = [pos[entry] <= n[d[entry]] - -(-6 * n[d[entry]] // 7)]
            for size in np.unique(m[(n <= x) & (m > 1)]).tolist():
                k = np.flatnonzero((n <= x) & (m == size))
                i, j = np.triu_indices(size, 1)
                step = max(1, (1 << 20) // len(i))
                for at in range(0, len(k), step):
                    some = k[at : at + step]
                    sets = np.sort(h[bound[some][:, None] + np.arange(size)], axis=1)
                    keys.append(mix(sets[:, i] * np.uint64(0xD6E8FEB86659FD93) + sets[:, j]).ravel())
                    owner.append(np.repeat(some, len(i)))
                    lead.append(np.ones(len(some) * len(i), dtype=bool))
            key, own_of, leads = np.concatenate(keys), np.concatenate(owner), np.concatenate(lead)
            for at in range(0, len(key), 1 << 18):
                o = own_of[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key[at : at + (1 << 18)])), pa.array(n[o]), pa.array(s1[o]), pa.array(ids[o]), pa.array(leads[at : at + (1 << 18)])],
                    names=["key", "n", "s1", "doc_id", "lead"],
                )

    some = survey.where((F.col("n") > 1) & (F.size("keys") > 0) & F.col("doc_id").isNotNull())
    return some.select("doc_id", "n", "s1", "own", "keys").mapInArrow(run, "key long, n long, s1 long, doc_id long, lead boolean")


def _groups(postings: DataFrame) -> DataFrame:
    """Entries of keys that two or more different sets share; equal sets count once, as their least doc_id.

    Streams over sorted entries and holds one batch, not one group.
    """
    dealt = postings.repartition(width(postings.sparkSession), F.col("key")).sortWithinPartitions("key", "n", "s1", "doc_id")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] | None = None  # the last row so far
        joined = False  # whether a row before it has its key

        def told(rows: list[np.ndarray], end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, joined
            key, n, s1 = rows[0], rows[1], rows[2]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (s1[1:] != s1[:-1])
            rows = [v[new] for v in rows]
            key = rows[0]
            same = key[1:] == key[:-1]
            member = np.zeros(len(key), dtype=bool)
            member[1:] |= same
            member[:-1] |= same
            member[0] |= joined
            out = len(key) if end else len(key) - 1  # the last row waits for the next one
            if out:
                mask = member[:out]
                yield pa.RecordBatch.from_arrays([pa.array(rows[k][:out][mask]) for k in (0, 1, 3, 4)], names=["key", "n", "doc_id", "lead"])
            joined = bool(member[-1]) if len(key) == 1 else bool(same[-1])
            waiting = [v[-1:] for v in rows]

        for batch in source:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if len(rows[0]):
                yield from told([np.concatenate((c, r)) for c, r in zip(waiting, rows, strict=True)] if waiting else rows, end=False)
        if waiting:
            yield from told(waiting, end=True)

    return dealt.mapInArrow(run, "key long, n long, doc_id long, lead boolean")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: whether their sets' similarity is 3/4 or more.

    ``docs``: one row for each text of a doc_id (see ``_texts``). Of a pair, the document that stands in more pairs is
    the middle of a fan, the other a member. Texts are looked up once, and a middle's text travels once for each
    ``FAN`` members, not once a pair: a task holds the sets of one middle and streams its members past them.
    """
    pairs = written(pairs.select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).groupBy("doc_id").agg(F.count("*").alias("pairs"))
    of = lambda c: ends.select(F.col("doc_id").alias(c), F.col("pairs").alias(f"n{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    first = F.col("na") >= F.col("nb")
    middle, member = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    fans = F.ceil(F.greatest("na", "nb") / FAN)
    asked = written(met.select(middle.alias("middle"), F.pmod(F.xxhash64(member), fans).alias("fan"), member.alias("member")), "fans")
    none = F.lit(None).cast("long").alias("member")
    rows = asked.select("middle", "fan").distinct().select(F.col("middle").alias("doc_id"), "middle", "fan", none).union(asked.select(F.col("member").alias("doc_id"), "middle", "fan", "member"))
    # up to FAN_ROWS pairs, counted, what is asked for goes to the texts; beyond it both sides are shuffled
    rows = F.broadcast(rows) if asked.count() <= FAN_ROWS else rows
    texts = docs.select("doc_id", "text").join(rows, "doc_id").select("middle", "fan", "member", "text")
    # nulls first: the middle's own texts come before its members'
    dealt = texts.repartition(width(docs.sparkSession), "middle", "fan").sortWithinPartitions("middle", "fan", "member")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in source:
            middles, fan, members = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = as_bytes(batch.column(3))
            low, high, linked = [], [], []
            for lo, hi in slices(texts):
                h, bound = sets_of(texts[lo:hi])
                for k in range(lo, hi):
                    own = h[bound[k - lo] : bound[k - lo + 1]]
                    if (middles[k], fan[k]) != current:
                        current, held = (middles[k], fan[k]), []
                    if members[k] is None:
                        held.append(own.copy())  # not a view that keeps the slice
                        continue
                    low.append(min(middles[k], members[k]))
                    high.append(max(middles[k], members[k]))
                    linked.append(any(_linked(own, other) for other in held))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return dealt.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are alike."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= 75 * (len(x) + len(y) - common)


def placed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the label of their component."""
    if labels is None:
        return members.withColumn("label", F.col("doc_id"))
    return members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def _stars(members: DataFrame, turn: int, pivots: int = PIVOTS) -> DataFrame:
    """Pairs (a, b) of the first ``pivots`` members of each key group with its others, where labels differ and sizes allow a link.

    The order is one of all documents, so that the same ones lead in many
    groups and few different pairs arise. Streams over sorted members and
    holds one batch and the leaders of one group.
    """
    rank = F.xxhash64("doc_id", F.lit(turn)).alias("rank")
    dealt = members.select("key", rank, "doc_id", "n", "label").repartition(width(members.sparkSession), F.col("key")).sortWithinPartitions("key", "rank", "doc_id")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the leaders of the group that may go on
        for batch in source:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4)]
            if not len(rows[0]):
                continue
            key, doc, n, label = rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            first = np.repeat(at, np.diff(np.append(at, len(key))))
            place = np.arange(len(key)) - first
            low, high = [], []
            for k in range(pivots):
                other = np.flatnonzero(place > k)
                lead = first[other] + k
                least, most = np.minimum(n[other], n[lead]), np.maximum(n[other], n[lead])
                ok = (label[other] != label[lead]) & (4 * least >= 3 * most)
                low.append(np.minimum(doc[other], doc[lead])[ok])
                high.append(np.maximum(doc[other], doc[lead])[ok])
            a, b = np.concatenate(low), np.concatenate(high)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64())], names=["a", "b"])
            held = [v[at[-1] : at[-1] + pivots] for v in rows]

    return dealt.mapInArrow(run, "a long, b long")


def _entries(sets: DataFrame) -> DataFrame:
    """List entries of sets of any size: key, the set's doc_id, label and n, the key's number i among its keys and its pos among all its shingles."""
    listed = sets.select("doc_id", "label", "n", "s1", "own", F.posexplode("keys").alias("i", "key"))
    pos = F.col("own") + F.col("i")
    return listed.where(pos <= F.col("n") - F.ceil(F.col("n") * 3 / 4)).select("key", "doc_id", "label", "n", "s1", "i", pos.alias("pos"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _texts(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(docs, sets, whether ids repeat) with one row for each different text, or set, of a doc_id.

    Where ids repeat, every pair of two of them would otherwise be compared
    once for each pair of their rows. Ids are counted first, which is cheap,
    so that a corpus of unique ids does not shuffle its texts for this.
    """
    known, known_sets = docs.where("doc_id IS NOT NULL").select("doc_id", "text"), sets.where("doc_id IS NOT NULL")
    if known_sets.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        return known, known_sets, False
    one = known_sets.groupBy("doc_id", "n", "s1", "s2").agg(*[F.first(c).alias(c) for c in ("odd", "own", "keys")])
    return written(known.distinct(), "texts"), written(one.select(*sets.columns), "sets"), True


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    tune(spark)
    free_shuffles(spark)
    every = written(survey(docs, sets_of), "survey")
    docs, sets, several = _texts(docs, every)
    members = written(_groups(_postings(sets, boundary(sets))), "members")

    bits = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))
    labels, tested = None, None
    for turn in range(MOST_TURNS):
        open_ = placed(members, labels)
        star = _stars(open_, turn).distinct()
        star = star.join(bits("a"), "a").join(bits("b"), "b").where(_may_link("na", "nb", "oa", "ob")).select("a", "b")
        star = star.distinct() if several else star
        found = written(_verified(docs, star if tested is None else star.join(tested.select("a", "b"), ["a", "b"], "left_anti")), "tested")
        n, linked = found.agg(F.count("*"), F.count(F.when(F.col("linked"), 1))).first()
        tested = found if tested is None else tested.union(found)
        if linked:
            labels = extended(labels, found.where("linked").select("a", "b"))
        if linked * STAR_YIELD < n or not n:
            break
    leaders = placed(members.select("doc_id").distinct(), labels).select("doc_id", "label")
    entries = written(_entries(leaders.join(sets, "doc_id")), "entries")
    open_keys = entries.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = entries.join(open_keys, "key", "left_semi").join(sets.select("doc_id", "n", "s1", "odd", "keys"), ["doc_id", "n", "s1"])
    open_ = open_.select("key", "doc_id", "label", "n", "pos", "odd", F.slice("keys", F.greatest(F.col("i") - WINDOW, F.lit(0)) + 1, F.least(F.col("i"), F.lit(WINDOW))).alias("before"))
    x, y = open_.alias("x"), open_.alias("y")
    # the first shingle that a linked pair shares: what is left from it on can still hold all that the two need to share
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    met = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc_id") < F.col("y.doc_id"))))
        & (7 * room >= 3 * (F.col("x.n") + F.col("y.n"))) & _may_link("x.n", "y.n", "x.odd", "y.odd")
        & ~F.arrays_overlap("x.before", "y.before"),  # an earlier key of both has met them already
    )
    cross = met.select(*_pair("x.doc_id", "y.doc_id")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = written(_verified(docs, cross), "tested-more")
    labels = extended(labels, more.where("linked").select("a", "b"))

    return _named(every, extended(labels, _own_classes(sets)) if several else labels)


def _own_classes(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that hold the different texts of one doc_id together: the id and the first id of each text's class."""
    some = sets.where("n > 0")
    several = some.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    classes = some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    of = some.join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).where("node <> doc_id")
    return of.select(*_pair("doc_id", "node")).distinct()


#: Equal sets of more documents than this, or than one in MOST_HOT of all, are named by a broadcast: at most MOST_HOT classes.
HOT_ROWS, MOST_HOT = 1000, 100_000


def _named(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with the label of its class of equal sets; a class of very many copies does not pass through one task."""
    names = lambda label: ["doc_id", F.col("n").alias("n_shingles"), label.alias("component_id")]
    some = sets.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "s1", "s2")
    classes = some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("size"))
    named = written(classes.join(labels, "node", "left").select("s1", "s2", "n", "size", F.coalesce("label", "node").alias("label")), "classes")
    rows = named.agg(F.sum("size")).first()[0] or 0
    hot = F.col("size") > max(HOT_ROWS, rows // MOST_HOT)
    small = F.broadcast(named.where(hot).select("s1", "s2", "n", F.col("label").alias("hot_label")))
    cold = named.where(~hot).select("s1", "s2", "n", "label")
    split = some.join(small, ["s1", "s2", "n"], "left")
    return (
        split.where("hot_label IS NOT NULL").select(*names(F.col("hot_label")))
        .union(split.where("hot_label IS NULL").join(cold, ["s1", "s2", "n"]).select(*names(F.col("label"))))
        .union(sets.where("doc_id IS NULL OR n = 0").select(*names(F.col("doc_id"))))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The first document of each component, with all its columns; rows without a doc_id stay.

    Of rows that share that doc_id one stays: the one whose text has the least hash, ties to any of the equal texts.
    """
    first = join(docs).groupBy("doc_id").agg(F.min("component_id").alias("least")).where("doc_id = least").select("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    firsts = known.groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("_row")).select("_row.*")
    return firsts.union(docs.where("doc_id IS NULL"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_jaccard_join": op2}

ORACLE = {
    "op2_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS v FROM d UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT root AS doc_id, min(v) AS c FROM r GROUP BY root) USING (doc_id)
""",
}
