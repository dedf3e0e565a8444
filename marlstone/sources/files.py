"""Folders of files and JSON-lines observations as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# MIME types by file suffix.
MIME_TYPES = {
    ".csv": "text/csv", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".eml": "message/rfc822", ".htm": "text/html", ".html": "text/html", ".json": "application/json", ".md": "text/markdown",
    ".msg": "application/vnd.ms-outlook", ".pdf": "application/pdf", ".txt": "text/plain", ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".yaml": "application/yaml", ".yml": "application/yaml",
}

OBSERVATION = "event_id STRING, tenant STRING, kind STRING, observed_at TIMESTAMP, payload STRING"


def mime_type(path: Column) -> Column:
    """MIME type by suffix, case ignored; null where the suffix is unknown."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.try_element_at(known, suffix)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, at any depth: uri, name, mime_type, size_bytes, last_modified, etag.

    Spark lists the files; the bytes are not read, as ``content`` is pruned.
    Spark's listing leaves out empty files, so they give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.col("path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("name"), mime_type(F.col("path")).alias("mime_type"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"),
        F.concat_ws("-", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("etag"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """scan_folder's uri with the SHA-256 of the bytes and the text (UTF-8, bad bytes replaced)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("file_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_observations(rows: DataFrame, path: str) -> None:
    """Append one JSON line a row, keys sorted."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("append").text(path)


def read_observations(
    spark: SparkSession, path: str, tenant: str | None = None, kind: str | None = None, since: datetime | None = None, until: datetime | None = None, limit: int | None = None
) -> DataFrame:
    """Rows that meet every filter given (both times included), the first ``limit`` by time and id.

    Lines that are no JSON object, or lack an id, a tenant or a kind, are left out.
    """
    rows = spark.read.schema(OBSERVATION).option("mode", "DROPMALFORMED").json(path).where("event_id IS NOT NULL AND tenant IS NOT NULL AND kind IS NOT NULL")
    for name, value in (("tenant", tenant), ("kind", kind)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    rows = rows.where(F.col("observed_at") >= F.lit(since)) if since else rows
    rows = rows.where(F.col("observed_at") <= F.lit(until)) if until else rows
    return rows.orderBy("observed_at", "event_id").limit(limit) if limit is not None else rows


def count_observations(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, bad ones included."""
    return spark.read.text(path).where(F.trim("value") != "").count()
