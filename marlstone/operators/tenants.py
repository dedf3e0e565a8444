"""Tenants: a directory with unique names, keys that act for a tenant, and one policy before every read.

directory: tenant_id, slug, display_name, plan, db_schema_name, db_role_name,
created_at and opt_out. Names are unique over the directory and within a batch
of new tenants: the first of a batch by created_at and tenant_id gets the
name. A read passes the guard before anything is looked up, so a foreign key
learns nothing about which tenants there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import rules as R

DIRECTORY = ["tenant_id", "slug", "display_name", "plan", "db_schema_name", "db_role_name", "created_at", "opt_out"]


def schema_name(slug: Column) -> Column:
    return F.concat(F.lit("vw_"), slug)


def role_name(slug: Column) -> Column:
    return F.concat(schema_name(slug), F.lit("_app"))


def created(directory: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directory, outcomes) after ``wanted`` (tenant_id, slug, display_name, plan, created_at) are added.

    outcomes: tenant_id, slug and outcome (created, invalid_slug, slug_taken). A null plan is free, a null slug invalid.
    """
    known = directory.select("slug").distinct().withColumn("_known", F.lit(True))
    valid = F.coalesce(R.valid_slug(F.col("slug")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("created_at", "tenant_id"))
    judged = wanted.withColumn("_place", F.when(valid, place)).join(known, "slug", "left")
    outcome = F.when(~valid, "invalid_slug").when(F.col("_known") | (F.col("_place") > 1), "slug_taken").otherwise("created")
    judged = judged.withColumn("outcome", outcome)
    new = judged.where("outcome = 'created'").select(
        "tenant_id", "slug", "display_name", F.coalesce("plan", F.lit("free")).alias("plan"), schema_name(F.col("slug")).alias("db_schema_name"),
        role_name(F.col("slug")).alias("db_role_name"), "created_at", F.lit(False).alias("opt_out"),
    )
    return directory.select(DIRECTORY).union(new), judged.select("tenant_id", "slug", "outcome")


def opted(directory: DataFrame, choices: DataFrame) -> DataFrame:
    """The directory after ``choices`` (tenant_id, opt_out, at): the last choice of a tenant counts, unknown tenants are left out."""
    last = choices.groupBy("tenant_id").agg(F.max_by("opt_out", F.struct("at", "opt_out")).alias("_opt"))
    return directory.join(last, "tenant_id", "left").withColumn("opt_out", F.coalesce("_opt", "opt_out")).select(DIRECTORY)


def listed(directory: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """(a page of tenants by created_at, how many there are)."""
    return directory.orderBy("created_at", "tenant_id").offset(offset).limit(limit), directory.count()


def authenticated(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """calls (with token) and key_tenant: whose key the token is, null for a token that is malformed, unknown, revoked or wrong.

    keys: prefix, secret_hash (SHA-256 of the secret, as a stand-in for a slow hash), tenant_id and revoked_at. Met by
    the prefix, which names one key; the secret itself is in no column of the result.
    """
    parts = R.token_parts(F.col("token"))
    told = calls.withColumns({"_prefix": parts["prefix"], "_hash": F.sha2(parts["secret"], 256)})
    one = keys.where("revoked_at IS NULL").select(F.col("prefix").alias("_prefix"), F.col("secret_hash").alias("_hash"), F.col("tenant_id").alias("key_tenant")).dropDuplicates(["_prefix", "_hash"])
    return told.join(one, ["_prefix", "_hash"], "left").select(*[c for c in calls.columns if c != "token"], "key_tenant")


def guarded(calls: DataFrame, directory: DataFrame) -> DataFrame:
    """calls (key_tenant, tenant_id) with status: 401 without a key, 403 for another tenant's, and only then 404 or 200.

    What a foreign key is told does not depend on the directory.
    """
    there = directory.select("tenant_id").distinct().withColumn("_there", F.lit(True))
    met = calls.join(there, "tenant_id", "left")
    foreign = F.col("key_tenant") != F.coalesce("tenant_id", F.lit(""))
    status = F.when(F.col("key_tenant").isNull(), 401).when(foreign, 403).when(F.col("_there").isNull(), 404).otherwise(200)
    return met.withColumn("status", status).drop("_there")


def readable(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """The rows of a table (with tenant_id) that calls of status 200 may read, with the call's columns: the one row policy of every read."""
    return calls.where("status = 200").join(rows, "tenant_id")
