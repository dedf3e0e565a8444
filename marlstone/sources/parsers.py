"""Parsers of files: which one applies, mails, sheets of comma-separated values, articles with a head of fields."""

from __future__ import annotations

import csv
import email
import io
from collections.abc import Iterator
from email import policy
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

NO_BODY = "[No text body found]"
_TEXT = ("body", "subject", "sender", "sent", "thread", "has_attachments")
_FILE = StructType([StructField("filename", StringType()), StructField("content_type", StringType()), StructField("size", LongType())])
MAIL = StructType([*[StructField(n, StringType()) for n in _TEXT], *[StructField(n, ArrayType(StringType())) for n in ("recipients", "copies")], StructField("attachments", ArrayType(_FILE))])


def resolve_parser(explicit: Column, mime: Column, uri: Column, by_type: dict[str, str], by_mime: dict[str, str], by_suffix: dict[str, str]) -> Column:
    """Name of the parser: by an explicit type, or else the MIME type, or else the suffix; null without one."""
    look = lambda m, k: F.try_element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), k) if m else F.lit(None).cast("string")
    suffix = F.lower(F.regexp_extract(uri, r"(\.[^./]+)$", 1))
    return F.coalesce(look(by_type, explicit), look(by_mime, mime), look(by_suffix, suffix))


def mail_fields(raw: bytes | None) -> dict:
    """Fields of one mail; ``sent`` is ISO-8601, or the header as it is where it is no date."""
    m = email.message_from_bytes(raw or b"", policy=policy.default)
    texts, files = [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        data = part.get_payload(decode=True) or b""
        if part.get_filename() or part.get_content_disposition() == "attachment":
            files.append({"filename": part.get_filename() or "", "content_type": part.get_content_type(), "size": len(data)})
        elif part.get_content_type() == "text/plain":
            try:
                texts.append(data.decode(part.get_content_charset() or "utf-8", "replace"))
            except LookupError:
                texts.append(data.decode("utf-8", "replace"))
    date = str(m.get("Date", "") or "")
    try:
        sent = parsedate_to_datetime(date).isoformat() if date else ""
    except (TypeError, ValueError):
        sent = date
    names = lambda h: [x.strip() for x in str(m.get(h, "") or "").split(",") if x.strip()]
    return {
        "body": "\n".join(texts) if texts else NO_BODY, "subject": str(m.get("Subject", "") or ""), "sender": str(m.get("From", "") or ""), "recipients": names("To"), "copies": names("Cc"),
        "sent": sent, "thread": str(m.get("In-Reply-To", "") or m.get("Message-ID", "") or ""), "has_attachments": str(bool(files)).lower(), "attachments": files,
    }


@F.pandas_udf(MAIL)
def parse_mail(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mail_fields(x) for x in raw], columns=MAIL.names)


def sheet_rows(raw: bytes | None) -> Iterator[dict[str, str | None]]:
    """Rows of a sheet as maps by the names of its first row; an empty name is ``col_i``, rows without any value go."""
    rows = [r for r in csv.reader(io.StringIO((raw or b"").decode("utf-8", "replace")))]
    if len(rows) < 2:
        return
    names = [n.strip() or f"col_{i}" for i, n in enumerate(rows[0])]
    for r in rows[1:]:
        if any(x.strip() for x in r):
            yield {n: (r[i] if i < len(r) and r[i] != "" else None) for i, n in enumerate(names)}


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def sheet_dicts(raw: pd.Series) -> pd.Series:
    return pd.Series([list(sheet_rows(x)) for x in raw])


@F.pandas_udf(StringType())
def sheet_text(raw: pd.Series) -> pd.Series:
    """Each row that has a value as one line, its values joined by `` | ``."""
    lines = lambda x: [" | ".join(r) for r in csv.reader(io.StringIO((x or b"").decode("utf-8", "replace"))) if any(v.strip() for v in r)]
    return pd.Series(["\n".join(lines(x)) for x in raw])


def article(text: Column, path: Column) -> dict[str, Column]:
    """name, tags, last_reviewed and body of a text that may begin with a head of ``key: value`` lines between ``---`` lines."""
    head = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"
    has = F.rlike(text, F.lit(head))
    fields = F.when(has, F.regexp_extract(text, head, 1)).otherwise(F.lit(""))
    value = lambda k: F.nullif(F.trim(F.regexp_extract(fields, rf"(?m)^\s*{k}\s*:[ \t]*(.*)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    listed = F.filter(F.transform(F.split(F.regexp_replace(value("tags"), r"^\[|\]$", ""), ","), lambda t: F.regexp_replace(F.trim(t), "^['\"]+|['\"]+$", "")), lambda t: t != "")
    return {
        "name": F.coalesce(value("name"), stem), "tags": F.coalesce(listed, F.array().cast("array<string>")), "last_reviewed": value("last_reviewed"),
        "body": F.when(has, F.regexp_extract(text, head, 2)).otherwise(text),
    }


def skill_files(texts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """domain, kind, slug, version and body of files ``<domain>/<kind>__<slug>__v<n>.md``; other names and kinds go, all versions stay."""
    name = r"([^/]+)/([a-z-]+)__([a-z0-9-]+)__v(\d+)\.md$"
    found = texts.where(F.rlike("uri", F.lit(name))).select(
        F.regexp_extract("uri", name, 1).alias("domain"), F.regexp_extract("uri", name, 2).alias("kind"), F.regexp_extract("uri", name, 3).alias("slug"),
        F.regexp_extract("uri", name, 4).cast("int").alias("version"), F.col("text").alias("body"), "uri",
    )
    return found.where(F.col("kind").isin(*kinds) & ~F.rlike("slug", F.lit("^-|--|-$")))


def parse_confidence(fields: Column) -> Column:
    """Share of fields with a value, two digits; 0.1 where there are none."""
    filled = F.size(F.filter(F.map_values(fields), lambda v: v.isNotNull() & (v != "")))
    return F.when(F.size(fields) > 0, F.round(filled / F.size(fields), 2)).otherwise(F.lit(0.1))


def database_row(base: Column, fields: Column) -> Column:
    """One map of both; a field takes the place of a base value of its name."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(fields), k))
    return F.map_concat(kept, fields)


_TAXONOMY = (
    "document_types map<string, struct<display_name: string, description: string, file_patterns: array<string>, fields_hints: map<string, struct<values: array<string>>>, keywords: array<string>>>, "
    "settings struct<unclassified_type: string, default_type: string>"
)


def taxonomy_types(files: DataFrame) -> DataFrame:
    """uri, ord, name, display_name, description, patterns and keywords of every type in taxonomy files (uri, text), as written.

    A file is one JSON object with document_types and settings (of YAML, its JSON form alone). Keywords are the names
    and values of a type's field hints, its own name and its keywords, in lower case, each once; the catch-all types
    that a file does not describe come last. A file without types, or that cannot be read, gives no rows.
    """
    t = files.select("uri", F.from_json("text", _TAXONOMY).alias("t")).where(F.size("t.document_types") > 0)
    no = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, no), lambda x: F.lower(x))
    each = t.select("uri", "t.settings", F.map_keys("t.document_types").alias("names"), F.posexplode("t.document_types").alias("ord", "name", "spec"))
    hints = F.flatten(F.transform(F.coalesce(F.map_entries("spec.fields_hints"), F.array().cast("array<struct<key:string,value:struct<values:array<string>>>>")), lambda e: F.concat(F.array(e["key"]), F.coalesce(e["value"]["values"], no))))
    told = each.select(
        "uri", "ord", "name", F.coalesce("spec.display_name", "name").alias("display_name"), F.coalesce("spec.description", F.lit("")).alias("description"),
        low(F.col("spec.file_patterns")).alias("patterns"), F.array_distinct(F.concat(low(F.concat(hints, F.array("name"))), low(F.col("spec.keywords")))).alias("keywords"),
    )
    default, other = F.coalesce("settings.default_type", F.lit("general_document")), F.coalesce("settings.unclassified_type", F.lit("unclassified"))
    rest = each.where("ord = 0").select("uri", "names", F.posexplode(F.array_distinct(F.array(default, other))).alias("k", "name")).where(~F.array_contains("names", F.col("name")))
    first = F.col("k") == 0
    display = F.when(first, "General Document").otherwise("Unclassified")
    described = F.when(first, "Unclassified or miscellaneous document").otherwise("Document the classifier could not assign with confidence.")
    return told.union(rest.select("uri", (F.size("names") + F.col("k")).alias("ord"), "name", display, described, no, F.array(F.lower("name"))))
