"""URL filters: host-suffix and path-prefix expressions against a table of rules.

DataFrame functions only. A rule (host, path, verdict) fits its host and all
subdomains where the url's path starts with the rule's; the longest rule that
fits wins. Every url is expanded into expressions: each suffix of its host at
a dot (no more labels than a rule's host has), followed by each prefix of its
path whose length is that of a rule's path. Expressions and rules meet by an
equi-join on the first ``PREFIX`` hex digits of their SHA-256; the full digest
then decides, and the longest of the confirmed rules gives the verdict.

Rules of at most ``BROADCAST_BYTES`` (summed first) are broadcast; larger
tables are joined by a shuffle, in which the rules stand once for each of
``SALTS`` salts and the expressions are dealt by a hash of their row, so that
one host with a third of all urls spreads over tasks. The hits of a row are
combined where it was read (the key names the input partition), so one row a
url is shuffled, whatever the number of its expressions, and repeated rows of
any number stay apart by partition.

Defined cases: a null url, or one without ``://``, has an empty host and path;
an empty path starts with no rule's path but an empty one; a rule without a
host, with a ``/`` in its host, with a path that does not start with ``/``, or
with a verdict other than allow and block, fits nothing; a null path of a rule
is empty; equal rules that contradict each other block; of two fitting rules
of equal length the one with the longer host wins; a url that no rule fits
gets ``default``; repeated rows stay as often as they are there; an empty
table gives no rows, and an empty table of rules leaves ``default``. Columns
that are not named in ``keep`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tables import table

#: Fixed values of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX = 8
BROADCAST_BYTES = 32 << 20
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepared(rules: DataFrame) -> DataFrame:
    """One row a rule that can fit something: host, path, rule (both together), verdict, digest and its prefix."""
    host, path = lowered(F.col("host")), F.coalesce("path", F.lit(""))
    usable = (F.col("host") != "") & ~F.col("host").contains("/") & ((F.col("path") == "") | F.col("path").startswith("/"))
    known = rules.select(host.alias("host"), path.alias("path"), "verdict").where(usable & F.col("verdict").isin("allow", "block"))
    one = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the greater
    full = one.withColumn("rule", F.concat("host", "path")).withColumn("digest", digest(F.col("rule")))
    return full.withColumn("prefix", F.left("digest", F.lit(PREFIX)))


def expressions(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Suffixes of the host of at most ``labels`` labels, each with every prefix of the path of one of the lengths."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    from_ = F.sequence(F.greatest(n - labels + 1, F.lit(1)), n)
    suffixes = F.transform(from_, lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length(path))
    prefixes = F.transform(fitting, lambda x: F.left(path, x))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns ``keep`` of every page with its url, host, path, rule (null where none fits) and verdict."""
    known = prepared(rules)
    size = known.agg(
        F.sum(F.octet_length("rule") * 2 + 200).alias("bytes"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.array_sort(F.collect_set(F.length("path"))).alias("lengths"),  # at most one entry a length
    ).first()
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], "url")
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    if not size.bytes:
        return rows.select(*names, "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    row = [f"k{i}" for i in range(len(keep))] + ["url", "host", "path"]
    found = rows.withColumn("at", F.spark_partition_id()).select("at", *row, F.posexplode_outer(expressions(F.col("host"), F.col("path"), size.labels, size.lengths)).alias("i", "expression"))
    found = found.withColumn("full", digest(F.col("expression"))).withColumn("prefix", F.left("full", F.lit(PREFIX))).drop("expression")
    one = F.struct("digest", F.length("rule").alias("length"), F.length("host").alias("host_length"), "rule", "verdict")
    right = known.groupBy("prefix").agg(F.collect_list(one).alias("rules"))  # more than one rule only by chance
    if size.bytes <= BROADCAST_BYTES:
        met = found.join(F.broadcast(right), "prefix", "left")
    else:
        salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("at", *row), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    hit = F.get(F.filter("rules", lambda r: r["digest"] == F.col("full")), F.lit(0))
    met = met.withColumn("hit", F.struct(*[hit[c].alias(c) for c in ("length", "host_length", "rule", "verdict")]))
    # the first expression of a row, or its only line without any, counts how often the row is there
    best = met.groupBy("at", *row).agg(F.max(F.when(F.col("hit.rule").isNotNull(), F.col("hit"))).alias("best"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("rows"))
    every = best.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return every.select(*names, "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` and the url of the pages that the rules allow."""
    return judge(pages, rules, keep).where("verdict = 'allow'").select(*[F.col(f"`{c}`") for c in keep], "url")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_url_filters": op13}

ORACLE = {
    "op13_url_filters": r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS n, page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
""",
}
