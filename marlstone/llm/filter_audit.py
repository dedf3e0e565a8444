"""Filter interaction audit: what each filter removes in every order of the filters.

Each document gets a mask of the filters that it fails. Duplicates, the last
filter, come from partition refinement: documents are split by code-point
length, then by the hash of one block after the other (blocks grow by
``GROWTH``, so a text of any length has few), and after each split documents
that stand alone are dropped. The full texts of the classes that survive are
compared, and every document but those of the least id of a text is marked.

Masks are counted per part before anything else: what a filter removes at a
step depends only on the set of filters before it, so a part's rows of all
orders come from at most two to the power of the filters counts.

Rows of a class meet the class's size or least id without passing through one
task: classes of more than one row in ``MOST_HOT`` (so at most that many) are
broadcast, all others are joined by a shuffle. Full texts are compared as
grouping keys, combined where they are read.

Defined cases: a null text counts as empty, a null lang as the empty string; a
null doc_id has no order, so its row is never a duplicate and makes none;
equal rows of one doc_id are no duplicates of each other; a doc_id with
several label rows is good (toxic) if one of them says so; a null label is
neither; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.llm.quality_rules import words_of
from marlstone.llm.tables import table
from marlstone.session import written

#: Code points of the first block, and how much longer each next one is: seven blocks hold any string.
BLOCK, GROWTH, BLOCKS = 64, 16, 7
HOT_ROWS, MOST_HOT = 1000, 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The filters before the duplicates: a name and the condition of failing, from the columns text, words and n (code points).
FILTERS: list[tuple[str, Callable[[], Column]]] = [
    ("A", lambda: F.size("words") < 200),
    ("B", lambda: 100 * F.size(F.array_distinct("words")) < 50 * F.size("words")),
    ("C", lambda: 100 * (F.col("n") - F.length(F.translate("text", _UPPER, ""))) > 3 * F.col("n")),
    ("D", lambda: F.col("text").rlike(r"[#$%&*|]")),
]
DUPLICATES = "E"


def _starts() -> list[tuple[int, int]]:
    """(start, length) of the blocks, in code points from 0."""
    at, out = 0, []
    for k in range(BLOCKS):
        out.append((at, BLOCK * GROWTH**k))
        at += BLOCK * GROWTH**k
    return out


def measured(docs: DataFrame, filters: Sequence[tuple[str, Callable[[], Column]]] = FILTERS) -> DataFrame:
    """doc_id, part, text, mask of the filters, n and the hashes of the text's blocks."""
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    a = a.select("*", F.length("text").cast("long").alias("n"), words_of(F.col("text")).alias("words"))
    mask = sum((F.when(f(), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, f) in enumerate(filters)), F.lit(0))
    blocks = [F.when(F.col("n") > at, F.xxhash64(F.substring("text", at + 1, min(size, (1 << 31) - 1)))) for at, size in _starts()]
    return a.select("doc_id", "part", "text", mask.alias("mask"), "n", F.array_compact(F.array(*blocks)).alias("blocks"))


def _fold(blocks: int = BLOCKS) -> Column:
    return F.xxhash64(F.slice("blocks", 1, blocks))


def _met(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with their class on ``keys``; ``classes`` has one row a class and its number of rows ``size``."""
    hot = F.col("size") > max(HOT_ROWS, total // MOST_HOT)  # so at most MOST_HOT hot classes
    values = [c for c in classes.columns if c not in keys]
    some = F.broadcast(classes.where(hot).select(*keys, F.struct(*values).alias("hot")))
    split = rows.join(some, keys, "left")
    large = split.where("hot IS NOT NULL").select(*rows.columns, *[F.col(f"hot.{c}").alias(c) for c in values])
    return large.union(split.where("hot IS NULL").drop("hot").join(classes.where(~hot), keys).select(*rows.columns, *values))


def survivors(facts: DataFrame) -> DataFrame:
    """The rows of ``facts`` that agree with another one in length and in every block's hash, found round by round."""
    rows = facts.where("doc_id IS NOT NULL")
    total = rows.count()
    for k in range(BLOCKS + 1):
        # round 0 splits by length; round k by block k, of those texts that have it
        keyed = rows.withColumn("key", _fold(k) if k else F.lit(0).cast("long"))
        classes = written(keyed.groupBy("n", "key").agg(F.count("*").alias("size")).where("size > 1"), "classes")
        rows = written(_met(keyed, classes, ["n", "key"], total).select(*facts.columns), "survivors")
        if not rows.where(F.size("blocks") > k).limit(1).count():
            break
    return rows


def duplicates(docs: DataFrame, labels: DataFrame, facts: DataFrame, filters: Sequence[tuple[str, Callable[[], Column]]] = FILTERS) -> DataFrame:
    """The rows of ``facts`` whose text stands under a smaller doc_id too."""
    alike = survivors(facts).withColumn("fold", _fold())
    total = alike.count()
    classes = written(alike.groupBy("n", "fold").agg(F.count("*").alias("size")), "alike")
    known = measured(docs, filters).where("doc_id IS NOT NULL").withColumn("fold", _fold())
    texts = _met(known.select("doc_id", "text", "n", "fold"), classes, ["n", "fold"], total)
    first = texts.groupBy("n", "fold", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))  # compares whole texts
    agreed = written(first.groupBy("n", "fold").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.sum("size").alias("size")), "texts")
    met = _met(alike, agreed, ["n", "fold"], total)
    same = met.where("texts = 1 AND doc_id > least").select(*facts.columns)
    # texts that differ under equal hashes: not expected, decided text by text
    parted = agreed.where("texts > 1").select("n", "fold")
    if not parted.limit(1).count():
        return same
    several = labelled(known, labels).join(parted, ["n", "fold"])
    apart = several.join(first.join(parted, ["n", "fold"]).select("n", "fold", "text", "least"), ["n", "fold", "text"])
    return same.union(apart.where("doc_id > least").select(*facts.columns))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1)."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(one, "doc_id", "left").fillna(0, ["good", "toxic"])
    return known.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def masks(docs: DataFrame, labels: DataFrame, filters: Sequence[tuple[str, Callable[[], Column]]] = FILTERS) -> DataFrame:
    """Documents, good and toxic ones of each part and mask; the bit after the filters' is that of the duplicates."""
    facts = written(labelled(measured(docs, filters).drop("text"), labels), "facts")
    copies = written(duplicates(docs, labels, facts, filters), "copies")
    mark = F.col("mask").bitwiseOR(F.lit(1 << len(filters)))
    row = lambda df, mask, times: df.select("part", mask.alias("mask"), F.lit(times).alias("times"), "good", "toxic")
    # a copy leaves the cell that it was counted in for the one with the mark
    every = row(facts, F.col("mask"), 1).union(row(copies, F.col("mask"), -1)).union(row(copies, mark, 1))
    count = lambda c: F.sum(F.col("times") * c)
    return every.groupBy("part", "mask").agg(F.sum("times").alias("rows"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def steps(names: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, number of its filter, mask of those before) for all orders."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, k, before))
            before |= 1 << k
    return out


def interactions(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of all orders and steps, from the counts of ``masks``."""
    k = len(names)
    cases = counted.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("own", F.expr("shiftleft(1, filter)"))
    cases = cases.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))).where("before & own = 0")
    fails, gone = F.expr("mask & own <> 0"), F.expr("mask & before <> 0")
    when = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    sums = cases.groupBy("part", "filter", "before").agg(
        when(~fails & ~gone, "rows").alias("kept"),
        when(fails & ~gone, "rows").alias("removed"),
        when(fails & gone, "rows").alias("redundant"),
        when(F.expr("mask = own"), "rows").alias("unique_fails"),
        when(fails & ~gone, "good").alias("good_lost"),
        when(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    # orders with just these filters before this one
    orders = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.bit_count("before") + 1)
    sums = sums.withColumn("shapley", F.sum(orders * F.col("removed")).over(Window.partitionBy("part", "filter")).cast("long"))
    all_steps = counted.sparkSession.createDataFrame(steps(names), "filter_order string, step int, filter int, before int")
    return sums.join(F.broadcast(all_steps), ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[tuple[str, Callable[[], Column]]] = FILTERS, copies: str = DUPLICATES) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(masks(docs, labels, filters), [*[n for n, _ in filters], copies])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_filter_audit": op11}

ORACLE = {
    "op11_filter_audit": r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d LEFT JOIN l USING (doc_id)),
f AS (SELECT part, good, toxic,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM t),
x AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ord FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ord, array_to_string(list_transform(ord, lambda i: 'ABCDE'[i]), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
m AS (SELECT part, filter_order, step, ord[step] AS own, n, good, toxic, fails[ord[step]] AS bad,
        len(list_filter(ord[1 : step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS bads
      FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND bads = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
""",
}
