"""Quality rules: counts of bad signs, and a hashed n-gram log-likelihood ratio.

DataFrame functions only. The grams of a text are its words and the pairs of
its neighbouring words' last three characters, hashed into ``buckets``. Two
smoothed multinomials are counted: one over the raw corpus (every document),
one over the trusted target (every document labelled as good). A document's score is the sum of
log p_target - log p_raw over its grams, divided by their number, and a
document is kept when the score reaches the threshold.

Repeated windows of 8 words are found within the row by 64-bit hashes: no
shuffle, and only texts with a repeat pay for the positions.

Defined cases: a null text counts as empty; a text of under 20 words fails the
base rules; without any trusted document every ratio is 0 and the base rules
alone decide; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tables import table

WINDOW = 8
BUCKETS = 8192
THRESHOLD = -0.15
_BLANKS = r"[\x20\x09-\x0D]+"
_BLANK_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words of a text that is not null; trimmed first, so that no empty piece is left to filter."""
    return F.filter(F.split(F.btrim(text, F.lit(_BLANK_CHARS)), _BLANKS), lambda w: w != "")


def _pairs(values: Column, apart: int) -> Column:
    """Hashes of the pairs of values that are ``apart`` places from each other.

    Both sides are cut to equal length; a slice is an array copy, once a text.
    """
    n = F.greatest(F.size(values) - apart, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(apart + 1), n), lambda x, y: F.xxhash64(x, y))


def hashed(a: DataFrame) -> DataFrame:
    """``a`` with the hashes of its _words and of the words' ends."""
    return a.withColumns(
        {
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
            "_ends": F.transform("_words", lambda w: F.xxhash64(F.right(w, F.lit(3)))),
        }
    )


def base(docs: DataFrame) -> DataFrame:
    """docs with _hash, _ends and the base counts.

    Each step is a projection of its own whose output is used more than once
    further on, so that nothing is computed again inside a lambda. The hash of
    a window of 8 words comes from pairs of pairs of pairs of word hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = hashed(docs.withColumn("_words", words_of(text)))
    a = a.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK_CHARS)) != ""),
        }
    )
    a = a.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    for name, of, apart in (("_two", "_hash", 1), ("_four", "_two", 2), ("_windows", "_four", 4)):
        a = a.withColumn(name, _pairs(F.col(of), apart))
    a = a.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    a = a.withColumn(
        "_sorted",
        F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))),
    )
    size = F.size("_sorted")
    same = lambda k, j: F.element_at("_sorted", k)["h"] == F.element_at("_sorted", j)["h"]
    at = F.transform(
        F.filter(
            F.sequence(F.lit(1), size),
            lambda k: F.when(k > 1, same(k, k - 1)).otherwise(F.lit(False)) | F.when(k < size, same(k, k + 1)).otherwise(F.lit(False)),
        ),
        lambda k: F.element_at("_sorted", k)["i"],
    )
    a = a.withColumn("_at", F.when(F.col("_repeats"), F.sort_array(at)))
    n = F.size("_at")
    covered = F.aggregate(
        F.zip_with(F.slice("_at", F.lit(1), n - 1), F.slice("_at", F.lit(2), n - 1), lambda x, y: F.least(F.lit(WINDOW), y - x)),
        F.lit(WINDOW),
        lambda s, x: s + x,
    )
    a = a.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long"))
    return a.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def grams() -> Column:
    """Hashes of a text's grams, from _hash and _ends: its words, and the pairs of neighbouring words' ends."""
    return F.concat("_hash", _pairs(F.col("_ends"), 1))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, text and _good (1 or null) of docs.

    The ids meet before anything is hashed, so that the shuffle carries texts alone. They are not broadcast where they
    are few: their number grows with the corpus.
    """
    target = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("_good", F.lit(1))
    return docs.select("doc_id", "text").join(target.hint("shuffle_hash"), "doc_id", "left")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log p_target - log p_raw of each bucket.

    ``trusted``: doc_id of good documents. All of them make the target, all
    documents make the raw corpus. The driver gets one row a bucket.
    """
    marked = _marked(docs, trusted)
    read = hashed(marked.select("_good", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("_words")))
    counts = (
        read.select("_good", F.explode(grams()).alias("gram"))
        .groupBy(bucket(F.col("gram"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    )
    raw, good = [0] * buckets, [0] * buckets
    for r in counts.collect():
        raw[r.b], good[r.b] = r.raw, r.good
    if not sum(good):
        return [0.0] * buckets
    n_raw, n_good = sum(raw) + buckets, sum(good) + buckets
    return [round(math.log((g + 1) / n_good) - math.log((r + 1) / n_raw), 6) for g, r in zip(good, raw, strict=True)]


def score(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs with the base counts, base_failed, score and kept (columns of docs stay)."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in log_ratios(docs, trusted, buckets))), ",").cast("array<double>")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    a = base(docs.select(row, "text")).withColumn("_grams", grams())
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get(ratios, bucket(g, buckets)))
    a = a.withColumn("score", F.when(F.size("_grams") > 0, F.round(total / F.size("_grams"), 9)).otherwise(F.lit(0.0)))
    return a.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns as they were."""
    # the mark is not deterministic, so the filter stays above the counts: pushed down,
    # it would compute them again inside their own lambdas
    judged = score(docs, trusted_ids(labels)).select("_row", "kept", F.monotonically_increasing_id().alias("_mark"))
    return judged.where("kept AND _mark >= 0").select("_row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = score(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_quality_rules": op4}
