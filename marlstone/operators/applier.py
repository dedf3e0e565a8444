"""Applying learned skills: matches kept as a table until the library changes, and the text that is put before a prompt.

configs: tenant, domain (null: the default one), opt_out and six vocabularies,
maps from a tenant's own words to words of the schema. skills: domain, kind,
title, body, path and modified (when the file was last changed). A tenant and a
skill meet by domain. A kept match is named by tenant, hash of the
configuration and kind asked for, and holds as long as the library's watermark
is the one that it was made under: an equi-join on all four, so only tenants
that it does not find are matched again.

Defined cases: a tenant that opted out gets nothing and is not matched; a null
vocabulary is empty; a domain without skills gives no text; skills of equal
score go by kind and title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import envelopes
from marlstone.session import written

VOCABULARIES = ("type_vocab", "relation_type_vocab", "procedure_type_vocab", "naming_token_vocab", "query_token_vocab", "state_vocab")
# fixed values: weights of a match, the vocabulary that makes up for a kind, marks and bounds of the text
BASE, VOCAB, TYPES, KIND = 0.30, 0.35, 0.25, 0.10
KIND_VOCAB = {
    "naming-convention": "naming_token_vocab", "query-pattern": "query_token_vocab", "procedure-pattern": "state_vocab", "relationship-schema": "relation_type_vocab",
    "classifier-strategy": "relation_type_vocab", "ingestion-pattern": "type_vocab", "ontology-shape": "type_vocab",
}
HEAD, HEAD_END, END, TAIL = "--- LEARNED PATTERN: ", " ---", "--- END ---", "\n[...truncated]"
MOST_CHARS, LEAST_SCORE, DEFAULT_DOMAIN = 4000, 0.4, "AEC"
MATCH = ["tenant", "config_hash", "asked", "watermark"]


def _values(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.map_values(c), F.array().cast("array<string>")))


def config_hash(tenant: Column, opt_out: Column) -> Column:
    """Names what of a configuration bears on its matches, whatever the order of its words."""
    empty = F.create_map().cast("map<string,string>")
    parts = [F.coalesce(F.col(v), empty).alias(v) for v in VOCABULARIES]
    return envelopes.config_hash(F.to_json(F.struct(tenant.cast("string").alias("tenant_anon_id"), opt_out.alias("opt_out"), *parts)))


def watermark(skills: DataFrame) -> DataFrame:
    """One row: the newest change of the library and the number of its files, 0 and 0 for an empty one."""
    return skills.agg(F.concat_ws("/", F.coalesce(F.max("modified"), F.lit(0)).cast("string"), F.count("*").cast("string")).alias("watermark"))


def scores(configs: DataFrame, skills: DataFrame) -> DataFrame:
    """configs (tenant and vocabularies) with every skill of their domain: kind, title, path and score."""
    words = F.array_distinct(F.flatten(F.array(*[_values(v) for v in VOCABULARIES])))
    c = configs.select("*", words.alias("words"), _values("type_vocab").alias("types"), *[(F.size(_values(v)) > 0).alias(f"has_{v}") for v in VOCABULARIES])
    met = c.join(skills, "domain")

    def share(part: str) -> Column:
        found = F.filter(part, lambda w: (w != "") & F.contains(F.col("body"), w))
        return F.when(F.size(part) > 0, F.size(found) / F.size(part)).otherwise(F.lit(0.0))

    bonus = F.lit(0.0)
    for kind, vocab in KIND_VOCAB.items():
        bonus = F.when(F.col("kind") == kind, F.col(f"has_{vocab}").cast("double")).otherwise(bonus)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), BASE + VOCAB * share("words") + TYPES * share("types") + KIND * bonus))
    return met.withColumn("score", total)


def matched(configs: DataFrame, skills: DataFrame, kept: DataFrame | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, kept): a row for each tenant and skill with its score, and the table of matches to keep.

    matches also says by ``cached`` whether a row comes from ``kept``; of ``kept`` only what is still valid, or belongs
    to tenants that were not asked for, is kept on. A tenant without any skill in its domain is kept as one empty row.
    """
    domain = F.coalesce("domain", F.lit(DEFAULT_DOMAIN))
    asked = configs.where(~F.coalesce("opt_out", F.lit(False))).withColumn("domain", domain).withColumn("config_hash", config_hash(F.col("tenant"), F.lit(False)))
    now = F.broadcast(watermark(skills))  # one row
    asked = asked.withColumn("asked", F.lit(kind or "")).join(now)
    own = skills.where(F.col("kind") == kind) if kind else skills
    todo, hits = asked, None
    if kept is not None:
        hits = written(kept.join(asked.select(MATCH).distinct(), MATCH, "left_semi"), "kept-hits")
        todo = asked.join(hits.select(MATCH).distinct(), MATCH, "left_anti")
    found = scores(todo, own).select(*MATCH, "kind", "title", "path", "score")
    none = todo.join(own.select("domain").distinct(), "domain", "left_anti").select(*MATCH, *[F.lit(None).cast("string").alias(c) for c in ("kind", "title", "path")], F.lit(None).cast("double").alias("score"))
    fresh = written(found.union(none), "matches")
    told = fresh.withColumn("cached", F.lit(False))
    table = fresh
    if hits is not None:
        told = told.union(hits.select(fresh.columns).withColumn("cached", F.lit(True)))
        others = kept.join(asked.select("tenant").distinct(), "tenant", "left_anti")
        table = fresh.union(hits.select(fresh.columns)).union(others.select(fresh.columns))
    return told, table


def applied(matches: DataFrame, skills: DataFrame, most: int = MOST_CHARS, least: float = LEAST_SCORE) -> DataFrame:
    """tenant, text, n_skills and truncated: the blocks of the best skills of each tenant that fit into ``most`` characters.

    Blocks come whole as long as they fit; the first that does not is cut, or left out where too little room is left,
    and ends the text; a single block without any room is but its marks. Tenants without a text have no row.
    """
    body = matches.where(F.col("score") >= least).join(skills.select("path", "body"), "path")
    head = F.concat(F.lit(HEAD), "title", F.lit(HEAD_END))
    whole = F.concat(head, F.lit("\n"), "body", F.lit("\n" + END))
    order = Window.partitionBy("tenant").orderBy(F.desc("score"), "kind", "title", "path")
    upto = F.sum(F.length(whole) + 2).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 2
    rows = body.select("tenant", F.row_number().over(order).alias("place"), head.alias("head"), "body", whole.alias("whole"), upto.alias("upto"))
    before = F.col("upto") - F.length("whole") - F.when(F.col("place") > 1, 2).otherwise(0)
    room = F.lit(most) - before - F.when(F.col("place") > 1, 2).otherwise(0) - F.length("head") - 2 - len(END)
    cut = F.concat("head", F.lit("\n"), F.left("body", (room - len(TAIL)).cast("int")), F.lit(TAIL + "\n" + END))
    tiny = F.concat("head", F.lit(TAIL + "\n" + END))
    fits = F.col("upto") <= most
    block = F.when(fits, F.col("whole")).when(room > len(TAIL) + 1, cut).when((F.col("place") == 1) & (F.length(tiny) <= most), tiny)
    some = rows.where(fits | (before <= most)).select("tenant", "place", block.alias("block"), (~fits).alias("over"))  # the last one is the first beyond
    # at most ``most`` characters a tenant
    told = some.groupBy("tenant").agg(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("place", "block")))).alias("b"), F.bool_or("over").alias("truncated"))
    return told.where(F.size("b") > 0).select("tenant", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"), F.size("b").alias("n_skills"), "truncated")
