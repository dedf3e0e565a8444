"""Column expressions: text, numbers, buckets and vectors."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: upper bounds (inclusive) and labels of document-count buckets; the first holds 0 too
COUNT_BUCKETS = ((10, "1-10"), (100, "11-100"), (1000, "101-1000"), (10000, "1001-10000"))
COUNT_BUCKET_LAST = "10000+"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    normal = lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
    return pd.Series([normal(t) for t in s], dtype=object)


def normalized(text: str) -> str:
    """``normalize_text`` of one text, for work that is in Python already."""
    t = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    t = re.sub("[ \t]+\n", "\n", re.sub("\r\n?", "\n", t))
    return re.sub("\n{3,}", "\n\n", t)


def normalize_text(text: Column, nfc: bool = True) -> Column:
    """NFC, line ends as LF, no blanks before a line end, at most two line ends in a row.

    Only texts beyond ASCII go to Python; all others are in NFC as they are.
    """
    beyond = F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    t = F.coalesce(_nfc(F.when(beyond, text)), text) if nfc else text
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+\n", "\n")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slugify(title: Column, default: str = "page", most: int = 80) -> Column:
    s = F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.substring(F.when(s == "", F.lit(default)).otherwise(s), 1, most)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def safe_ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is not positive, else the ratio within 0 and 1."""
    return F.when(den <= 0, F.lit(0.0)).otherwise(clamp01(num / F.when(den > 0, den)))


def bucketize(n: Column, buckets=COUNT_BUCKETS, last: str = COUNT_BUCKET_LAST) -> Column:
    """Label of the first bucket whose bound holds n; a negative n is an error."""
    out = F.lit(last)
    for bound, label in reversed(buckets):
        out = F.when(n <= bound, F.lit(label)).otherwise(out)
    return F.when(n < 0, F.raise_error(F.lit("negative count")).cast("string")).otherwise(out)


def empirical_quantile(values: Column, q: float) -> Column:
    """Element at the half-even rounded rank of the sorted array; 0 for an empty one."""
    s = F.array_sort(values)
    at = 0 if q <= 0 else None
    rank = F.lit(at) if at is not None else F.bround(F.lit(min(q, 1.0)) * (F.size(s) - 1)).cast("int")
    return F.when(F.size(s) > 0, F.element_at(s, rank + 1)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a vector is zero."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n != 0, n))


def summary_card(text: Column, most: int = 200) -> Column:
    cut = F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))
    return F.when(F.length(text) > most, cut).otherwise(text)


def cost_band(n: Column) -> Column:
    return F.when(n <= 10, "small").when(n <= 50, "medium").otherwise("large")


def page_id(tenant: Column, node: Column) -> Column:
    return F.concat(F.lit("pg_"), F.substring(F.sha1(F.concat_ws("|", tenant, node)), 1, 16))
