"""Queries on tenants, guarded reads and applied skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import applier, tenants
from marlstone.plans.queries import query, read

_SLUG = "CASE user_id % 4 WHEN 0 THEN 'tenant-' || user_id % 50 WHEN 1 THEN 'T' || user_id WHEN 2 THEN 't--' || user_id ELSE 'shop-' || user_id END"


def _directory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(tenants that are there, tenants that are wanted): users of the events, every seventh there already."""
    u, n = F.col("user_id"), F.col("user_id").cast("string")
    users = read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    slug = F.when(u % 4 == 0, F.concat(F.lit("tenant-"), (u % 50).cast("string"))).when(u % 4 == 1, F.concat(F.lit("T"), n)).when(u % 4 == 2, F.concat(F.lit("t--"), n)).otherwise(F.concat(F.lit("shop-"), n))
    named = users.select(F.concat(F.lit("id"), n).alias("tenant_id"), slug.alias("slug"), n.alias("display_name"), F.lit(None).cast("string").alias("plan"), "created_at", u.alias("n"))
    there = named.where("n % 7 = 0 AND n % 4 = 3")
    there = there.select("tenant_id", "slug", "display_name", F.lit("pro").alias("plan"), F.lit("s").alias("db_schema_name"), F.lit("r").alias("db_role_name"), "created_at", F.lit(False).alias("opt_out"))
    # those are wanted again under other ids, so that their names are taken
    return there, named.withColumn("tenant_id", F.concat("tenant_id", F.lit("x"))).drop("n")


_TENANTS = f"""u AS (SELECT user_id, min(ts) AS created_at, {_SLUG} AS slug FROM events GROUP BY user_id),
w AS (SELECT *, 'id' || user_id || 'x' AS tenant_id, row_number() OVER (PARTITION BY slug ORDER BY created_at, 'id' || user_id || 'x') AS place FROM u),
o AS (SELECT *, CASE WHEN user_id % 4 IN (1, 2) THEN 'invalid_slug' WHEN (user_id % 7 = 0 AND user_id % 4 = 3) OR place > 1 THEN 'slug_taken' ELSE 'created' END AS outcome FROM w),
t AS (SELECT 'id' || user_id AS tenant_id, slug, user_id, 'pro' AS plan, false AS new FROM u WHERE user_id % 7 = 0 AND user_id % 4 = 3 UNION ALL SELECT tenant_id, slug, user_id, 'free', true FROM o WHERE outcome = 'created')"""


@query(f"""WITH {_TENANTS} SELECT t.tenant_id AS tenant_id, t.slug AS slug, plan, CASE WHEN new THEN 'vw_' || t.slug ELSE 's' END AS db_schema_name, CASE WHEN new THEN 'vw_' || t.slug || '_app' ELSE 'r' END AS db_role_name, new AND user_id % 3 = 0 AS opt_out, 'in_directory' AS outcome FROM t
UNION ALL SELECT tenant_id, slug, NULL, NULL, NULL, NULL, outcome FROM o WHERE outcome <> 'created'""")
def tenant_directory(spark: SparkSession, d: str) -> DataFrame:
    """The directory after a batch of new tenants and their choices, and what was not created."""
    there, wanted = _directory(spark, d)
    full, outcomes = tenants.created(there, wanted)
    at = F.lit("2024-01-01").cast("timestamp")
    pick = wanted.where(F.col("display_name").cast("long") % 3 == 0).select("tenant_id")
    choices = pick.select("tenant_id", F.lit(True).alias("opt_out"), (at + F.expr("INTERVAL 1 DAY")).alias("at")).union(pick.select("tenant_id", F.lit(False), at))
    full = tenants.opted(full, choices).select("tenant_id", "slug", "plan", "db_schema_name", "db_role_name", "opt_out", F.lit("in_directory").alias("outcome"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("plan", "string"), ("db_schema_name", "string"), ("db_role_name", "string"), ("opt_out", "boolean"))]
    return full.union(outcomes.where("outcome <> 'created'").select("tenant_id", "slug", *none, "outcome"))


@query(f"""WITH {_TENANTS},
c AS (SELECT event_id, user_id AS n, 'id' || CASE event_id % 5 WHEN 1 THEN user_id + 1 ELSE user_id END || CASE WHEN event_id % 5 = 2 THEN '' ELSE 'x' END AS path, CASE WHEN event_id % 5 = 3 OR event_id % 11 = 0 OR user_id % 13 = 0 THEN NULL ELSE 'id' || user_id || 'x' END AS key FROM events),
s AS (SELECT event_id, path, CASE WHEN key IS NULL THEN 401 WHEN key <> path THEN 403 WHEN path NOT IN (SELECT tenant_id FROM t) THEN 404 ELSE 200 END AS status FROM c)
SELECT event_id, status, CASE WHEN status = 200 THEN slug END AS slug FROM s LEFT JOIN t ON t.tenant_id = path""")
def guarded_reads(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: with a good token, a malformed one, one with a wrong secret, a revoked one, or another tenant's; each asks for a tenant's record."""
    there, wanted = _directory(spark, d)
    directory, _ = tenants.created(there, wanted)
    n = F.col("user_id").cast("string")
    prefix, secret = F.lpad(n, 12, "p"), F.lpad(n, 32, "s")
    users = read(spark, d, "events").select("user_id").distinct()
    keys = users.select(prefix.alias("prefix"), F.sha2(secret, 256).alias("secret_hash"), F.concat(F.lit("id"), n, F.lit("x")).alias("tenant_id"), F.when(F.col("user_id") % 13 == 0, F.lit("2024-01-01")).cast("timestamp").alias("revoked_at"))
    e = F.col("event_id")
    token = F.when(e % 5 == 3, F.concat(F.lit("vw_"), prefix, F.lit("_short"))).when(e % 11 == 0, F.concat(F.lit("vw_"), prefix, F.lit("_"), F.lpad(n, 32, "q"))).otherwise(F.concat(F.lit("vw_"), prefix, F.lit("_"), secret))
    other = F.when(e % 5 == 1, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string")
    calls = read(spark, d, "events").select("event_id", token.alias("token"), F.concat(F.lit("id"), other, F.when(e % 5 == 2, "").otherwise("x")).alias("tenant_id"))
    judged = tenants.guarded(tenants.authenticated(calls, keys), directory)
    seen = tenants.readable(directory.select("tenant_id", "slug"), judged).select("event_id", "slug")
    return judged.select("event_id", "status").join(seen, "event_id", "left").select("event_id", "status", "slug")


#: domain, kind, title, body, path and time of the last change, before and after.
_BEFORE = [
    ("AEC", "naming-convention", "Phase names", "use phase, then rfi", "AEC/a.md", 100),
    ("AEC", "ingestion-pattern", "Drawings", "drawing sheets and rfi logs; " * 4, "AEC/b.md", 100),
    ("AEC", "query-pattern", "Open questions", "open", "AEC/c.md", 100),
    ("law", "procedure-pattern", "States", "open, closed, phase", "law/a.md", 100),
    ("law", "ontology-shape", "Shape", "nothing", "law/b.md", 100),
]
_AFTER = [(*s[:3], "phase only", *s[4:5], 200) if s[2] == "Drawings" else s for s in _BEFORE] + [("law", "naming-convention", "Names", "phase rfi drawing open", "law/c.md", 150)]
_SKILLS = "domain string, kind string, title string, body string, path string, modified long"
_MOST = 200
_LIBRARY = ", ".join(f"({i}, '{s[0]}', '{s[1]}', '{s[2]}', '{s[3]}')" for i, lib in enumerate((_BEFORE, _AFTER)) for s in lib)
_SCORE = (
    "30e-2 + 35e-2 * CASE WHEN len(w) = 0 THEN 0e0 ELSE len(list_filter(w, lambda x: contains(body, x))) / len(w) END + 25e-2 * CASE WHEN len(t) = 0 THEN 0e0 ELSE len(list_filter(t, lambda x: contains(body, x))) / len(t) END "
    "+ 1e-1 * CASE kind WHEN 'naming-convention' THEN p::INT WHEN 'procedure-pattern' THEN o::INT WHEN 'query-pattern' THEN 0 ELSE (len(t) > 0)::INT END"
)


@query(f"""WITH e AS (SELECT user_id, coalesce(bool_or(event_type = 'view') FILTER (event_id % 13 = 0), false) AS v, coalesce(bool_or(event_type = 'click') FILTER (event_id % 13 = 0), false) AS c, coalesce(bool_or(event_type = 'purchase') FILTER (event_id % 13 = 0), false) AS p, coalesce(bool_or(event_type = 'error') FILTER (event_id % 13 = 0), false) AS o FROM events GROUP BY user_id),
x AS (SELECT user_id, p, o, CASE user_id % 3 WHEN 2 THEN 'law' ELSE 'AEC' END AS domain, list_filter([CASE WHEN v THEN 'rfi' END, CASE WHEN c THEN 'drawing' END], lambda y: y IS NOT NULL) AS t, list_filter([CASE WHEN v THEN 'rfi' END, CASE WHEN c THEN 'drawing' END, CASE WHEN p THEN 'phase' END, CASE WHEN o THEN 'open' END], lambda y: y IS NOT NULL) AS w FROM e WHERE user_id % 10 > 0),
l(phase, domain, kind, title, body) AS (VALUES {_LIBRARY}), s AS (SELECT user_id, phase, kind, title, body, {_SCORE} AS score FROM x JOIN l USING (domain)),
r AS (SELECT *, '--- LEARNED PATTERN: ' || title || ' ---' || chr(10) || body || chr(10) || '--- END ---' AS whole, row_number() OVER (PARTITION BY user_id, phase ORDER BY score DESC, kind, title) AS place FROM s WHERE score >= 4e-1),
u AS (SELECT *, sum(length(whole) + 2) OVER (PARTITION BY user_id, phase ORDER BY place) - 2 AS upto FROM r),
b AS (SELECT *, upto - length(whole) - CASE WHEN place > 1 THEN 2 ELSE 0 END AS before, {_MOST} - (upto - length(whole)) - length(title) - 38 AS room FROM u),
k AS (SELECT *, CASE WHEN upto <= {_MOST} THEN whole WHEN room > 16 THEN '--- LEARNED PATTERN: ' || title || ' ---' || chr(10) || body[1 : (room - 15)::BIGINT] || chr(10) || '[...truncated]' || chr(10) || '--- END ---' WHEN place = 1 THEN '--- LEARNED PATTERN: ' || title || ' ---' || chr(10) || '[...truncated]' || chr(10) || '--- END ---' END AS block FROM b WHERE upto <= {_MOST} OR before <= {_MOST})
SELECT user_id AS tenant, i.step AS step, i.step = 1 AS cached, string_agg(block, chr(10) || chr(10) ORDER BY place) AS text, count(block) AS n_skills, bool_or(upto > {_MOST}) AS truncated
FROM k JOIN (VALUES (0, 0), (1, 0), (2, 1)) i(step, lib) ON k.phase = i.lib GROUP BY user_id, i.step HAVING count(block) > 0""")
def applied_skills(spark: SparkSession, d: str) -> DataFrame:
    """What each user's prompts are given: at first, again with the kept matches, and after the library has changed."""
    has = lambda t: F.coalesce(F.bool_or(F.when(F.col("event_id") % 13 == 0, F.col("event_type") == t)), F.lit(False))
    u = read(spark, d, "events").groupBy(F.col("user_id").alias("tenant")).agg(*[has(t).alias(t) for t in ("view", "click", "purchase", "error")])
    pair = lambda t, word: F.when(F.col(t), F.create_map(F.lit(t), F.lit(word))).otherwise(F.create_map().cast("map<string,string>"))
    none = F.lit(None).cast("map<string,string>")
    vocab = {"type_vocab": F.map_concat(pair("view", "rfi"), pair("click", "drawing")), "naming_token_vocab": pair("purchase", "phase"), "state_vocab": pair("error", "open")}
    domain = F.when(F.col("tenant") % 3 == 2, "law").when(F.col("tenant") % 3 == 1, "AEC")
    configs = u.select("tenant", domain.alias("domain"), (F.col("tenant") % 10 == 0).alias("opt_out"), *[vocab.get(v, none).alias(v) for v in applier.VOCABULARIES])
    before, after = (spark.createDataFrame(lib, _SKILLS) for lib in (_BEFORE, _AFTER))
    kept, out = None, None
    for step, skills in enumerate((before, before, after)):
        matches, kept = applier.matched(configs, skills, kept)
        seen = matches.groupBy("tenant").agg(F.bool_and("cached").alias("cached"))
        text = applier.applied(matches, skills, _MOST).join(seen, "tenant").select("tenant", F.lit(step).alias("step"), "cached", "text", F.col("n_skills").cast("long").alias("n_skills"), "truncated")
        out = text if out is None else out.union(text)
    return out
