"""Queries on signatures, checks, chains, spending and support, over events, conversations and documents.

A tenant is a user of the events table. Raw events and pull requests do not
exist in the test tables; each query says what stands in for their fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.operators import chains, envelopes, signatures
from marlstone.operators import skills as K
from marlstone.plans.queries import query, read

VOCAB = {"View": "phase", "click ": "discipline", "purchase": "type_code", "error": "no_such_member"}
STATE_VOCAB = {"view": "open", "click": "responded", "purchase": "closed", "error": "rejected"}
_BY_USER = "FROM events GROUP BY user_id"
_Q = "list_sort({0})[round_even({1}e0 * (len({0}) - 1), 0)::INT + 1]"
_NODES = "CASE WHEN {0} <= 10 THEN '1-10' WHEN {0} <= 50 THEN '11-50' WHEN {0} <= 200 THEN '51-200' WHEN {0} <= 1000 THEN '201-1000' ELSE '1000+' END"
_SAMPLES = "CASE WHEN {0} <= 10 THEN '3-10' WHEN {0} <= 50 THEN '11-50' WHEN {0} <= 200 THEN '51-200' ELSE '200+' END"
_EDGES = "CASE WHEN {0} <= 10 THEN '1-10' WHEN {0} <= 100 THEN '11-100' WHEN {0} <= 1000 THEN '101-1000' ELSE '1000+' END"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


@query(f"""WITH u AS (SELECT user_id, count(*) AS n, list(event_id % 3) AS f, count(*) FILTER (event_type = 'purchase') AS i, count(*) FILTER (event_type = 'click') AS s {_BY_USER})
SELECT user_id, least(n, 64) AS depth, {_NODES.format('n')} AS node_count_bucket, least(1e0, {_Q.format('f', '5e-1').replace('e-1e0', 'e-1')}) AS branching_factor_p50, least(1e0, {_Q.format('f', '95e-2').replace('e-2e0', 'e-2')}) AS branching_factor_p95,
  round(CASE WHEN len(list_filter(f, lambda x: x > 0)) > 0 THEN least(1e0, len(list_filter(f, lambda x: x = 0)) / len(list_filter(f, lambda x: x > 0))) ELSE 0 END, 6) AS leaf_to_internal_ratio,
  CASE WHEN i + s > 0 THEN round(i / (i + s), 6) END AS induced_vs_seed_ratio, 'category:' || len(list_filter(f, lambda x: x = 0)) || ',entity:' || len(list_filter(f, lambda x: x = 1)) || ',topic:' || len(list_filter(f, lambda x: x = 2)) AS kind_distribution FROM u""")
def sig_ontology_shape(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as nodes: event_id % 3 stands for children and for the kind, purchases for induced nodes, clicks for seed ones."""
    e = _events(spark, d).withColumn("f", F.col("event_id") % 3)
    n = lambda cond, name: F.count_if(cond).alias(name)
    u = e.groupBy("user_id").agg(F.count("*").alias("n"), n(F.col("event_type") == "purchase", "i"), n(F.col("event_type") == "click", "s"), *[n(F.col("f") == k, f"f{k}") for k in range(3)])
    u = u.join(signatures.ranked(e, ["user_id"], "f", {"p50": 0.5, "p95": 0.95}), "user_id")
    kinds = F.create_map(F.lit("category"), F.col("f0"), F.lit("entity"), F.col("f1"), F.lit("topic"), F.col("f2"))
    s = signatures.ontology_shape(F.col("n"), F.col("n"), F.col("p50"), F.col("p95"), F.col("f0"), F.col("f1") + F.col("f2"), F.col("i"), F.col("s"), kinds)
    shown = F.array_join(F.transform(F.map_entries(s["kind_distribution"]), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return u.select("user_id", *[(shown if n == "kind_distribution" else F.round(c, 6) if n.endswith("ratio") else c).alias(n) for n, c in s.items()])


_GENERIC = {"view": "drawing", "click": "rfi", "purchase": "drawing"}
_NAMED = "CASE event_type WHEN 'view' THEN 'drawing' WHEN 'click' THEN 'rfi' WHEN 'purchase' THEN 'drawing' ELSE 'other' END"
_BUCKET = "CASE WHEN {0} = 0 THEN '0' WHEN {0} <= 10 THEN '1-10' WHEN {0} <= 50 THEN '11-50' WHEN {0} <= 200 THEN '51-200' WHEN {0} <= 1000 THEN '201-1000' ELSE '1000+' END"


@query("WITH u AS (SELECT user_id, count(*) AS n, list(value / 1e2) AS cs, " + ", ".join(f"count(*) FILTER ({_NAMED} = '{t}') AS {t}" for t in signatures.DOC_TYPES) + f""" FROM events GROUP BY user_id)
SELECT user_id, {" || ',' || ".join(f"'{t}:' || {_BUCKET.format(t)}" for t in sorted(signatures.DOC_TYPES))} AS generic_type_counts, CASE WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' WHEN n <= 1000 THEN '201-1000' WHEN n <= 10000 THEN '1001-10000' ELSE '10000+' END AS total_documents_bucket,
round(greatest(0, least(1, {_Q.format('cs', '5e-1').replace('e-1e0', 'e-1')})), 6) AS classifier_confidence_p50, round(greatest(0, least(1, {_Q.format('cs', '1e-1').replace('e-1e0', 'e-1')})), 6) AS classifier_confidence_p10 FROM u""")
def sig_document_types(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as documents, their types as the tenant's names of types, two of which mean the same; values are confidences."""
    e = _events(spark, d).withColumn("c", F.col("value") / 100)
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    u = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"), F.sum("n").alias("n"))  # a pair a type
    u = u.join(signatures.ranked(e, ["user_id"], "c", {"p50": 0.5, "p10": 0.1}), "user_id", "left")
    s = signatures.document_types(F.col("counts"), F.col("n"), F.col("p50"), F.col("p10"), _GENERIC)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(s["generic_type_counts"])), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    return u.select("user_id", shown.alias("generic_type_counts"), s["total_documents_bucket"].alias("total_documents_bucket"), *[F.round(s[f"classifier_confidence_{p}"], 6).alias(f"classifier_confidence_{p}") for p in ("p50", "p10")])


_RAW = "'<' || event_type || '>-<Phase>_' || CASE WHEN event_id % 5 = 0 THEN '<open' ELSE 'Rev' || (event_id % 10) END"
_RESOLVED = "coalesce(map {{'view': 'phase', 'click': 'discipline', 'purchase': 'type_code', 'error': 'other'{1}}}[lower(trim({0}))], 'other')"


@query(f"""WITH t AS (SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n, count(*) FILTER (value > 10) AS m FROM events GROUP BY ALL),
r AS (SELECT *, regexp_extract_all(regexp_replace({_RAW}, '<[^>]*$', ''), '<[^>]*>|[^<]') AS parts FROM t),
x AS (SELECT *, list_filter(parts, lambda p: p[1] = '<') AS tok FROM r)
SELECT user_id, event_type, trim(array_to_string(list_transform(parts, lambda p: CASE WHEN p[1] = '<' THEN '<' || {_RESOLVED.format("p[2:-2]", "")} || '>' WHEN regexp_matches(lower(p), '[a-z_-]') THEN lower(p) ELSE '-' END), ''), '-') AS template,
  CASE WHEN {_RESOLVED.format("tok[1][2:-2]", "")} = 'other' THEN 'other' ELSE {_RESOLVED.format("tok[1][2:-2]", "")} || ',other' END AS token_vocabulary, round(m / n, 6) AS adherence_rate, {_SAMPLES.format('greatest(n, 3)')} AS sample_count_bucket FROM x""")
def sig_naming_convention(spark: SparkSession, d: str) -> DataFrame:
    """Templates made of a user's event types; an event of value over 10 is one that matches."""
    t = _events(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"), F.count(F.when(F.col("value") > 10, 1)).alias("m"))
    raw = F.concat(F.lit("<"), "event_type", F.lit(">-<Phase>_"), F.when(F.col("event_id") % 5 == 0, F.lit("<open")).otherwise(F.concat(F.lit("Rev"), (F.col("event_id") % 10).cast("string"))))
    s = signatures.naming_convention(raw, F.col("m"), F.col("n"), VOCAB)
    return t.select("user_id", "event_type", s["template"].alias("template"), F.array_join(s["token_vocabulary"], ",").alias("token_vocabulary"), F.round(s["adherence_rate"], 6).alias("adherence_rate"), s["sample_count_bucket"].alias("sample_count_bucket"))


@query(f"SELECT event_type, 'all <' || CASE event_type WHEN 'view' THEN 'topic' WHEN 'click' THEN 'status' ELSE 'other' END || '> of <other>-' AS shape_template, {_SAMPLES.format('count(*)')} AS occurrence_count_bucket FROM events GROUP BY event_type")
def sig_query_pattern(spark: SparkSession, d: str) -> DataFrame:
    t = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    s = signatures.query_pattern(F.concat(F.lit("--All <"), "event_type", F.lit("> of <User>- ")), F.col("n"), {"view": "topic", "click": "status", "error": "phases"})
    return t.select("event_type", s["shape_template"].alias("shape_template"), s["occurrence_count_bucket"].alias("occurrence_count_bucket"))


_STEPS = "WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, least(1e0, value / 100) AS v FROM events), e AS (SELECT user_id, a, b, count(*) AS n, list(v) AS vs FROM s WHERE b IS NOT NULL GROUP BY user_id, a, b)"
_TYPE = "CASE {0} WHEN 'view' THEN 'drawing' WHEN 'click' THEN 'rfi' ELSE 'other' END"


@query(f"{_STEPS} SELECT user_id, a || '>' || b AS edge, {_TYPE.format('a')} AS source_type, {_TYPE.format('b')} AS target_type, 'references' AS relation, {_EDGES.format('n')} AS edge_count_bucket, round({_Q.format('vs', '5e-1').replace('e-1e0', 'e-1')}, 6) AS confidence_p50 FROM e")
def sig_relationship_schema(spark: SparkSession, d: str) -> DataFrame:
    """Steps from one event to the user's next are the edges."""
    step = _events(spark, d).select("user_id", F.col("event_type").alias("source"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("target"), F.least(F.lit(1.0), F.col("value") / 100).alias("v"))
    step = step.where("target IS NOT NULL")
    e = step.groupBy("user_id", "source", "target").agg(F.count("*").alias("n")).join(signatures.ranked(step, ["user_id", "source", "target"], "v", {"p50": 0.5}), ["user_id", "source", "target"])
    one = e.select("user_id", "source", "target", F.array(F.struct("source", "target", F.lit("next").alias("relation"), "n", "p50")).alias("edges"))
    s = signatures.relationship_schema(F.col("edges"), {"view": "drawing", "click": "rfi"}, {"next": "references"})
    return one.select(F.col("user_id"), F.concat("source", F.lit(">"), "target").alias("edge"), F.inline(s)).withColumn("confidence_p50", F.round("confidence_p50", 6))


@query(f"""WITH f AS (SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, list(n) AS ns, sum(n) AS t, string_agg(s, ',' ORDER BY first) AS states FROM (SELECT *, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'responded' WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'rejected' ELSE 'other' END AS s FROM f) GROUP BY user_id)
SELECT user_id, states, least(32, {_Q.format('ns', '5e-1').replace('e-1e0', 'e-1')})::INT AS median_lifecycle_states, {_EDGES.format('t')} AS transitions_observed_bucket FROM u""")
def sig_procedure_pattern(spark: SparkSession, d: str) -> DataFrame:
    """A user's event types in order of first sight are the states."""
    f = _events(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    u = f.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda s: s["event_type"]).alias("states"), F.collect_list(F.col("n").cast("double")).alias("ns"), F.sum("n").alias("t"))
    s = signatures.procedure_pattern(F.col("states"), F.col("ns"), F.col("t"), STATE_VOCAB)
    return u.select("user_id", F.array_join(s["states"], ",").alias("states"), s["median_lifecycle_states"].alias("median_lifecycle_states"), s["transitions_observed_bucket"].alias("transitions_observed_bucket"))


@query(f"""{_STEPS}, t AS (SELECT user_id, count(*) AS n, list(least(1e0, value / 100)) AS cs FROM events GROUP BY user_id), p AS (SELECT user_id, {_TYPE.format('a')} AS type_a, {_TYPE.format('b')} AS type_b, n AS confused FROM e)
SELECT p.user_id, type_a, type_b, round(confused / n, 6) AS confusion_rate, round({_Q.format('cs', '1e-1').replace('e-1e0', 'e-1')}, 6) AS overall_confidence_p10, {_EDGES.format('n')} AS sampled_documents_bucket FROM p JOIN t USING (user_id) WHERE type_a <> type_b""")
def sig_classifier_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    step = e.select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b IS NOT NULL").groupBy("user_id", "a", "b").agg(F.count("*").alias("confused"))
    t = e.groupBy("user_id").agg(F.count("*").alias("n")).join(signatures.ranked(e.withColumn("v", F.least(F.lit(1.0), F.col("value") / 100)), ["user_id"], "v", {"p10": 0.1}), "user_id")
    u = step.join(t, "user_id").withColumn("pairs", F.array(F.struct("a", "b", "confused", F.col("n").alias("total"))))
    s = signatures.classifier_uncertainty(F.col("pairs"), F.col("p10"), F.col("n"), {"view": "drawing", "click": "rfi"})
    out = u.select("user_id", F.inline(s["uncertain_pairs"]), F.round(s["overall_confidence_p10"], 6).alias("overall_confidence_p10"), s["sampled_documents_bucket"].alias("sampled_documents_bucket"))
    return out.withColumn("confusion_rate", F.round("confusion_rate", 6))


@query(f"""WITH c AS (SELECT conv_id % 10 AS tenant, conv_id, count(*)::DOUBLE AS n, bool_or(role = 'system') AS sys FROM conversations GROUP BY conv_id), t AS (SELECT tenant, list(n) AS ns, count(*) AS docs, count(*) FILTER (sys) AS failed, count(*) FILTER (n < 2) AS un FROM c GROUP BY tenant)
SELECT tenant, {_Q.format('ns', '5e-1').replace('e-1e0', 'e-1')}::INT AS chunks_per_doc_p50, {_Q.format('ns', '95e-2').replace('e-2e0', 'e-2')}::INT AS chunks_per_doc_p95, round(failed / docs, 6) AS classification_failure_rate, round(un / docs, 6) AS ontology_assignment_failure_rate, {_EDGES.format('docs')} AS docs_processed_bucket FROM t""")
def sig_pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are documents and their turns chunks; one with a system turn counts as failed, one of a single turn as unassigned."""
    c = read(spark, d, "conversations").groupBy((F.col("conv_id") % 10).alias("tenant"), "conv_id").agg(F.count("*").cast("double").alias("n"), F.bool_or(F.col("role") == "system").alias("sys"))
    t = c.groupBy("tenant").agg(F.count("*").alias("docs"), F.count(F.when(F.col("sys"), 1)).alias("failed"), F.count(F.when(F.col("n") < 2, 1)).alias("un"))
    t = t.join(signatures.ranked(c, ["tenant"], "n", {"p50": 0.5, "p95": 0.95}), "tenant")
    s = signatures.pipeline_metrics(F.col("p50"), F.col("p95"), F.col("docs"), F.col("failed"), F.col("un"))
    return t.select("tenant", *[(F.round(x, 6) if k.endswith("rate") else x).alias(k) for k, x in s.items()])


_PHONE = r"\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}(?:\D|$)"
_IS = {
    "EMAIL": r"regexp_matches(text, '(?i)[\p{L}0-9._%+\-]+@[\p{L}0-9.\-]+\.\p{L}{2,}')", "SSN": r"regexp_matches(text, '(^|\D)\d{3}[-\s]\d{2}[-\s]\d{4}(\D|$)')", "PHONE": f"regexp_matches(text, '{_PHONE}')",
    "URL": r"regexp_matches(text, '(?i)(https?://|www\.)\S|\b[\p{L}0-9\-]+\.(com|org|net|io|co|gov|edu|us|uk|de|fr|jp|cn|au|info)\b')",
}
_DETECT = "CASE " + " ".join(f"WHEN {c} THEN 'NER_HIT_{k}'" for k, c in _IS.items()) + " END"


@query(f"SELECT doc_id, {_DETECT} AS reason FROM documents")
def pii_detect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", R.detect(F.col("text")).alias("reason"))


_LUHN = "(SELECT sum(CASE WHEN (len(g) - i) % 2 = 1 THEN CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END ELSE x END) FROM (SELECT unnest(range(1, len(g) + 1)) AS i, unnest(list_transform(string_split(g, ''), lambda c: c::INT)) AS x)) % 10 = 0"


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM documents), a AS (SELECT doc_id, regexp_extract_all(text, '\b(?:\d[ -]?){{13,19}}\b') AS a FROM d), m AS (SELECT doc_id, unnest(a) AS m, generate_subscripts(a, 1) AS k FROM a), g AS (SELECT doc_id, m, k, regexp_replace(m, '\D', '', 'g') AS g FROM m),
l AS (SELECT doc_id, list(m ORDER BY k) AS ms FROM g WHERE len(g) BETWEEN 13 AND 19 AND {_LUHN} GROUP BY doc_id)
SELECT d.doc_id, sha256(CASE WHEN ms IS NULL THEN text ELSE list_reduce(list_prepend(text, ms), lambda t, m: replace(t, m, '[REDACTED:CC]')) END) AS redacted_sha256, ms IS NOT NULL AS changed FROM d LEFT JOIN l USING (doc_id)""")
def redact_pii(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold neither SSNs nor bearer tokens, so the SQL replaces cards alone; pytest covers the rest.

    Hashes are of the redacted text with letters beyond ASCII as x, since the SQL engine's word bounds know ASCII only.
    """
    t = read(spark, d, "documents").withColumn("r", R.redact(F.col("text")))
    return t.select("doc_id", F.sha2(F.regexp_replace("r", r"[^\x00-\x7F]", "x"), 256).alias("redacted_sha256"), (F.col("r") != F.col("text")).alias("changed"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'value' WHEN event_id % 4 = 1 THEN 'dim_x' END AS bad_key FROM events")
def forbidden_keys(spark: SparkSession, d: str) -> DataFrame:
    """The events' JSON in lists in an envelope that has a forbidden key in half of the rows, now and then in escapes."""
    key = F.when(F.col("event_id") % 8 == 0, "V\\u0061lue").when(F.col("event_id") % 4 == 0, "Value").when(F.col("event_id") % 4 == 1, "dim_x").otherwise("kind")
    e = _events(spark, d).select("event_id", F.concat(F.lit('{"payload": [{"'), key, F.lit('": '), "props", F.lit('}], "a": "\\"value\\": 1"}')).alias("json"))
    return e.select("event_id").join(envelopes.first_hits(envelopes.key_hits(envelopes.walk(e, ["event_id"], "json"), ["event_id"]), ["event_id"], "key"), "event_id", "left").select("event_id", F.col("key").alias("bad_key"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN value > 1 THEN 'adherence_rate' END WHEN 1 THEN 'k' WHEN 3 THEN 'states' WHEN 4 THEN CASE WHEN event_id >= 1000 THEN 'entity' END WHEN 5 THEN CASE WHEN value > 1 THEN 'adherence_rate' END END AS bad_leaf FROM events""")
def numeric_policy(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the events under names that may and may not hold them, in objects and in lists."""
    v = F.format_string("%.2f", "value")
    told = [
        F.concat(F.lit('"adherence_rate": '), v), F.lit('"k": 3'), F.lit('"depth": 7, "embedding_dim": 1024, "flag": true'), F.concat(F.lit('"states": [[], ['), v, F.lit("]]")),
        F.concat(F.lit('"kind_distribution": {"topic": 3, "entity": '), F.col("event_id").cast("string"), F.lit("}")), F.concat(F.lit('"edges": [{"adherence_rate": [0.5, '), v, F.lit("]}]")),
    ]
    e = _events(spark, d).select("event_id", F.concat(F.lit("{"), F.get(F.array(*told), (F.col("event_id") % 6).cast("int")), F.lit("}")).alias("json"))
    return e.select("event_id").join(envelopes.first_hits(envelopes.numeric_hits(envelopes.walk(e, ["event_id"], "json"), ["event_id"]), ["event_id"], "leaf"), "event_id", "left").select("event_id", F.col("leaf").alias("bad_leaf"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, substr(lower(text), i, 3) AS g FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) - 1)) AS i FROM conversations)), c AS (SELECT DISTINCT substr(lower(text), i, 3) AS g FROM (SELECT text, unnest(range(1, length(text) - 1)) AS i FROM benchmark)),
s AS (SELECT conv_id, turn, count(*) AS n, count(c.g) AS m FROM t LEFT JOIN c USING (g) GROUP BY ALL)
SELECT conv_id, turn, coalesce(n, 0) AS n_trigrams, coalesce(m, 0) AS n_shared, CASE WHEN length(text) > 64 THEN 'STRING_TOO_LONG' WHEN coalesce(m, 0) > 3e-1 * coalesce(n, 0) THEN 'QUOTE_OVERLAP' END AS reason FROM conversations LEFT JOIN s USING (conv_id, turn)""")
def quote_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations against the character trigrams of the benchmark."""
    turns = read(spark, d, "conversations")
    return K.quote_check(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"], read(spark, d, "benchmark"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'opt_out_dropped' WHEN text IS NULL OR text = '' THEN 'signature_failed' WHEN r IS NOT NULL THEN 'checker_rejected' ELSE 'accepted' END AS outcome, CASE WHEN doc_id % 10 > 0 THEN r END AS reason
FROM (SELECT doc_id, text, {_DETECT} AS r FROM documents)""")
def checker_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an observation: opt-out first, then computing, then the checks, the first that fails wins."""
    docs = read(spark, d, "documents")
    return K.collected(docs, F.col("doc_id") % 10 == 0, F.coalesce(F.col("text") == "", F.lit(True)), {"pii": R.detect(F.col("text"))}).select("doc_id", "outcome", "reason")


_RULES = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in (n, *ws)) + f" THEN '{n}'" for n, ws, _ in R.FORBIDDEN_ACTIONS)


@query(f"SELECT page_id, CASE {_RULES} END AS action FROM (SELECT page_id, html AS text FROM pages)")
def forbidden_actions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", R.forbidden_action(F.col("html")).alias("action"))


@query("""WITH m AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 10 AS c, conv_id % 6 AS k, turn % 2 = 1 AS odd FROM conversations),
r AS (SELECT *, CASE WHEN c = 9 AND k = 5 THEN 'LLM error: Timeout' WHEN k = 1 THEN 'forbidden action attempted: ' || CASE WHEN odd THEN 'delete_data' ELSE 'issue_refund' END WHEN k = 2 THEN 'forbidden action attempted: delete_data'
  WHEN c < 7 OR k = 3 THEN CASE WHEN odd AND k = 3 THEN 'vip customer' WHEN c < 7 THEN 'low confidence' ELSE 'agent requested' END END AS reason FROM m)
SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'escalated' END AS decision, reason, CASE WHEN c = 9 AND k = 5 THEN 'medium' WHEN k = 1 THEN CASE WHEN odd THEN 'high' ELSE 'medium' END WHEN k = 2 THEN 'high' WHEN reason IS NOT NULL THEN CASE WHEN odd AND k = 3 THEN 'high' ELSE 'low' END END AS severity,
  CASE WHEN c = 9 AND k = 5 THEN 'Something went wrong on our side. I''ve passed this to a teammate who will follow up.' WHEN k IN (1, 2) THEN 'I''m not able to do that myself, so I''m passing this to a teammate who will follow up. ' || 'Done: ' || turn WHEN reason IS NULL AND k = 4 THEN 'I can''t help with that - that''s outside what I''m allowed to look up for this account.' ELSE 'Done: ' || turn END AS reply FROM r""")
def triage(spark: SparkSession, d: str) -> DataFrame:
    """Turns as messages, with answers and tool calls made from their ids: forbidden by name or argument, denied, allowed, or none.

    The customer's own text stands in no call, so "delete" in it escalates nothing.
    """
    k, odd = F.col("conv_id") % 6, F.col("turn") % 2 == 1
    call = lambda name, args, ok=True: F.struct(F.lit(name).alias("name"), F.lit(args).alias("args"), F.lit(ok).alias("allowed"))
    by_name = F.when(odd, F.array(call("issue_refund", "{}"), call("account_DELETE", "{}"))).otherwise(F.array(call("delete_rows", "{}"), call("get_plan", "{}"), call("do", '{"then": "Refund it"}')))
    calls = F.when(k == 1, by_name).when(k == 2, F.array(call("run", "purge=all"))).when(k == 4, F.array(call("get_plan", "{}"), call("get_plan", '{"of": "b"}', False))).when(k == 5, F.array(call("get_plan", "{}"))).otherwise(F.array().cast("array<struct<name:string,args:string,allowed:boolean>>"))
    c = (F.col("conv_id") * 7 + F.col("turn")) % 10
    m = read(spark, d, "conversations").select(
        "conv_id", "turn", calls.alias("calls"), F.concat(F.lit("Done: "), F.col("turn").cast("string")).alias("reply"), (c / 10.0).alias("confidence"), (k == 3).alias("escalate"),
        F.when(odd & (k == 3), "vip customer").alias("given_reason"), F.when(odd & (k == 3), "high").alias("given_severity"), F.when((c == 9) & (k == 5), "Timeout").alias("error"),
    )
    return K.triaged(m).select("conv_id", "turn", "decision", "reason", "severity", "reply")


_H = """h AS (SELECT user_id AS chain, event_id AS id, epoch_us(ts) * 1000 AS ts_ns, event_type, replace(props, ' ', '') AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT h.*, repeat('0', 64) AS prev_hash, sha256('{"event_type":"' || event_type || '","payload":' || payload || ',"prev_hash":"' || repeat('0', 64) || '","ts_ns":' || ts_ns || '}') AS this_hash FROM h WHERE k = 1
UNION ALL SELECT h.*, c.this_hash, sha256('{"event_type":"' || h.event_type || '","payload":' || h.payload || ',"prev_hash":"' || c.this_hash || '","ts_ns":' || h.ts_ns || '}') FROM c JOIN h ON h.chain = c.chain AND h.k = c.k + 1)"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return chains.linked(e.select(F.col("user_id").alias("chain"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "event_type", F.regexp_replace("props", " ", "").alias("payload")))


@query(f"WITH RECURSIVE {_H} SELECT id, prev_hash, this_hash FROM c")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).select("id", "prev_hash", "this_hash")


@query("WITH t AS (SELECT user_id, min(event_id) FILTER (event_id % 499 = 0) AS bad FROM events GROUP BY user_id) SELECT e.user_id AS chain, count(*) AS rows, bad AS bad_id, CASE WHEN bad IS NOT NULL THEN 'hash' END AS fault FROM events e JOIN t USING (user_id) GROUP BY ALL")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """The chain of each user, after the payload of every 499th event was changed."""
    return chains.verified(_chain(spark, d).withColumn("payload", F.when(F.col("id") % 499 == 0, F.lit('{"k":-1}')).otherwise(F.col("payload"))))


@query("""WITH p AS (SELECT user_id, event_id, ts, value::DECIMAL(18, 6) AS v FROM events WHERE event_type = 'purchase'), s AS (SELECT event_id, sum(v) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS d, sum(v) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS w, sum(v) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS m FROM p)
SELECT event_id, CASE WHEN d >= 20 THEN 'daily_cap_hit' WHEN w >= 100 THEN 'weekly_cap_hit' WHEN m >= 350 THEN 'monthly_cap_hit' ELSE 'under_caps' END AS decision, round(d, 4)::DOUBLE AS spent_today, round(w, 4)::DOUBLE AS spent_this_week, round(m, 4)::DOUBLE AS spent_this_month FROM s""")
def spend_decision(spark: SparkSession, d: str) -> DataFrame:
    """After each purchase of a user: which cap its last 1, 7 or 30 days reach. Decimal sums are compared as they are and rounded for show."""
    p = _events(spark, d).where("event_type = 'purchase'").withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "v": F.col("value").cast("decimal(18,6)")})
    over = lambda days: F.sum("v").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-days * 86_400_000_000, 0))
    s = p.select("event_id", over(1).alias("d"), over(7).alias("w"), over(30).alias("m"))
    shown = [F.round(c, 4).cast("double").alias(f"spent_{n}") for c, n in (("d", "today"), ("w", "this_week"), ("m", "this_month"))]
    return s.select("event_id", R.spend_decision(F.col("d"), F.col("w"), F.col("m")).alias("decision"), *shown)


@query("SELECT event_id, round(CASE WHEN value > 15 THEN value ELSE CASE event_id % 3 WHEN 0 THEN user_id * 15e0 + event_id * 75e0 WHEN 1 THEN user_id * 8e-1 + event_id * 4e0 ELSE user_id * 3e0 + event_id * 15e0 END / 1e6 END, 9) AS usd FROM events")
def usd_estimate(spark: SparkSession, d: str) -> DataFrame:
    """A value over 15 stands for a reported figure; user and event ids stand for token counts."""
    model = F.when(F.col("event_id") % 3 == 0, "x-Opus-1").when(F.col("event_id") % 3 == 1, "haiku").otherwise("other")
    told = F.when(F.col("value") > 15, F.col("value")).otherwise(F.lit(0.0))
    return _events(spark, d).select("event_id", F.round(R.spent(told, R.usd(model, F.col("user_id"), F.col("event_id"))), 9).alias("usd"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS files, sum(l_quantity) AS lines, count(*) FILTER (l_linenumber > 1) AS checks, count(*) FILTER (l_linenumber > 1 AND l_linestatus = 'O') AS pending, count(*) FILTER (l_linenumber > 1 AND l_linestatus <> 'O' AND l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN 'head_ref_not_agent' WHEN l_orderkey % 5 = 0 THEN 'needs_review' WHEN files > 5 THEN 'too_many_files' WHEN lines > 100 THEN 'too_many_lines' WHEN l_orderkey % 11 = 0 THEN 'privacy_critical_path' WHEN checks = 0 THEN 'no_checks' WHEN pending > 0 THEN 'wait' WHEN failed > 0 THEN 'block_failed_checks' ELSE 'merge' END AS gate,
  checks, pending, failed FROM o""")
def merge_gates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as changes: lines are files, quantities changed lines; every line but the first is a check run that is open, or has failed, passed or been skipped."""
    line = read(spark, d, "lineitem")
    state = R.run_state(F.when(F.col("l_linestatus") == "O", "in_progress").otherwise("completed"), F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "success").otherwise("skipped"))
    run = lambda s: F.count(F.when((F.col("l_linenumber") > 1) & (state == s), 1)).alias(s)
    o = line.groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum("l_quantity").alias("lines"), F.count(F.when(F.col("l_linenumber") > 1, 1)).alias("checks"), run("pending"), run("failed"))
    key = F.col("l_orderkey")
    c = {n: F.col(n) for n in ("files", "lines", "checks", "failed", "pending")} | {
        "head_ref": F.when(key % 7 == 0, "main").otherwise("agent/fix-1"), "title": F.when(key % 5 == 0, "x [Needs-Review]").otherwise("x"), "body": F.lit(None).cast("string"), "critical": (key % 11 == 0).cast("int"),
    }
    return o.select(key, R.merge_gate(c, files=5, lines=100).alias("gate"), "checks", "pending", "failed")


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, regexp_full_match(s, '[a-z][a-z0-9-]{1,30}[a-z0-9]') AS valid FROM (SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N} _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') AS s FROM pages)""")
def skill_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", R.skill_slug(F.col("url")).alias("slug"))
    return p.withColumn("valid", R.valid_slug(F.col("slug")))


@query("""SELECT DISTINCT event_type, 'AEC ' || upper(event_type[1]) || lower(event_type[2:]) || ' Pattern' AS title, CASE WHEN length(event_type) < 4 THEN upper(event_type[1]) || event_type[2:] || ' Skill' ELSE upper(event_type[1]) || event_type[2:] END AS display FROM events""")
def group_titles(spark: SparkSession, d: str) -> DataFrame:
    t = _events(spark, d).select("event_type").distinct()
    return t.select("event_type", R.group_title(F.lit("AEC"), F.concat("event_type", F.lit("-pattern"))).alias("title"), R.slug_title(F.col("event_type")).alias("display"))


@query("""WITH t AS (SELECT user_id, list_distinct(list(event_type)) AS v FROM events GROUP BY user_id), s(skill, kind, body) AS (VALUES ('one', 'query-pattern', 'uses view and click'), ('two', 'naming-convention', 'uses purchase only'), ('three', 'ontology-shape', 'none of them')),
x AS (SELECT user_id, skill, kind, len(list_filter(v, lambda w: contains(body, w))) AS hit, len(v) AS n FROM t, s)
SELECT user_id, skill, round(3e-1 + 35e-2 * hit / n + 25e-2 * 0 + 1e-1 * (kind = 'query-pattern')::INT, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY 3e-1 + 35e-2 * hit / n + 1e-1 * (kind = 'query-pattern')::INT DESC, kind, skill) AS place FROM x""")
def skill_rank(spark: SparkSession, d: str) -> DataFrame:
    """A user's event types as vocabulary; three made-up skills of the same domain."""
    t = _events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("vocab")).withColumns({"types": F.array().cast("array<string>"), "kinds": F.array(F.lit("query-pattern")), "domain": F.lit("AEC")})
    s = (K.Skill("one", "query-pattern", "AEC", "uses view and click"), K.Skill("two", "naming-convention", "AEC", "uses purchase only"), K.Skill("three", "ontology-shape", "AEC", "none of them"))
    return K.ranked_skills(t, s).select("user_id", "skill", F.round("score", 6).alias("score"), "place")


_KINDS = tuple(signatures.SKILL_KINDS)


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 8 AS k, lower(o_orderpriority[3:]) AS t, lower(o_orderstatus) AS s, (o_orderkey % 11) / 10e0 AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'ontology-shape' WHEN 1 THEN 'naming-convention' WHEN 2 THEN 'ingestion-pattern' WHEN 3 THEN 'relationship-schema' WHEN 4 THEN 'procedure-pattern' WHEN 5 THEN 'query-pattern' WHEN 6 THEN 'classifier-strategy' ELSE 'ingestion-pattern' END AS skill_kind,
round(CASE WHEN k IN (0, 4, 5) THEN 1e0 WHEN k IN (1, 2, 6) THEN c WHEN k = 3 THEN (c + 5e-1) / 2 ELSE 1e0 - greatest(c, 25e-2) END, 6) AS confidence,
CASE k WHEN 0 THEN 'onto::nodes=1-10' WHEN 1 THEN 'naming::' || t WHEN 2 THEN 'dtd::1-10' WHEN 3 THEN 'rel::' || CASE WHEN s = t THEN s ELSE least(s, t) || '+' || greatest(s, t) END WHEN 4 THEN 'proc::' || s || '+' || t WHEN 5 THEN 'query::' || s WHEN 6 THEN 'unc::' || least(s || '~' || t, t || '~' || s) || '+' || greatest(s || '~' || t, t || '~' || s) ELSE 'pipe::' || s || '/' || t END AS shape FROM p""")
def signature_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as signatures of all kinds: status and priority are their names, the key's last digits their figures."""
    o = read(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 3, 100).alias("t"), F.lower("o_orderstatus").alias("s"), ((F.col("o_orderkey") % 11) / 10.0).alias("c"))
    t, s, c = F.lower("t"), F.col("s"), F.col("c")
    bucket = F.lit("1-10")
    fields = {
        "kind": F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 8).cast("int")), "adherence_rate": c, "classifier_confidence_p10": c, "overall_confidence_p10": c,
        "classification_failure_rate": c, "ontology_assignment_failure_rate": F.lit(0.25), "template": t, "shape_template": s, "node_count_bucket": bucket, "total_documents_bucket": bucket,
        "chunker_strategy": s, "embedding_provider_family": t, "states": F.array(s, t),
        "edges": F.array(*[F.struct(r.alias("relation"), x.alias("confidence_p50")) for r, x in ((t, c), (s, F.lit(0.5)))]),
        "uncertain_pairs": F.array(*[F.struct(x.alias("type_a"), y.alias("type_b")) for x, y in ((t, s), (s, t))]),
    }
    p = o.select("o_orderkey", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("p"))
    return p.select("o_orderkey", signatures.skill_kind(F.col("p.kind")).alias("skill_kind"), F.round(signatures.confidence(F.col("p")), 6).alias("confidence"), signatures.fingerprint(F.col("p")).alias("shape"))


@query("""WITH g AS (SELECT event_type, count(DISTINCT user_id) AS tenants, round(avg(event_id % 4), 2) / 4 AS mean FROM events GROUP BY event_type)
SELECT event_type, sha256('## When to apply' || chr(10) || chr(10) || 'Apply when ingesting documents in the AEC domain that produce a ' || event_type || ' signature.' || chr(10) || chr(10) || '## Recurring shape' || chr(10) || chr(10)
|| CASE WHEN event_type = 'click' THEN '- (no shape examples)' ELSE '- `naming::' || event_type || '`' || chr(10) || '- `onto::nodes=1-10`' END || chr(10) || chr(10) || '## Operational guidance' || chr(10) || chr(10)
|| 'This pattern was observed across ' || tenants || ' distinct tenants with a bucketed mean confidence of 0.50.' || chr(10) || 'Future ingestions in this domain should treat the recurring shape above as a default expectation and prompt the classifier to confirm.' || chr(10)) AS body_sha256 FROM g""")
def skill_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Event types as groups of signatures."""
    g = _events(spark, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("tenants"))
    shapes = F.when(F.col("event_type") == "click", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("naming::"), F.col("event_type")), F.lit("onto::nodes=1-10")))
    return g.select("event_type", F.sha2(K.skill_body(F.lit("AEC"), F.col("event_type"), shapes, F.col("tenants"), F.lit(0.5)), 256).alias("body_sha256"))


@query(rf"""WITH w AS (SELECT doc_id, text, string_split(regexp_replace(text, '[,;:()\[\]{{}}<>"`\s]+', ' ', 'g'), ' ') AS w FROM documents),
b AS (SELECT *, list_filter(list_transform(w, lambda x: trim(x, '.,;:!?')), lambda x: regexp_matches(x, '\d')) AS n, list_transform(w, lambda x: trim(trim(lower(x), '.,;:!?'), '_-')) AS f FROM w)
SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') OR length(text) > 64000 THEN 'SCHEMA_VALIDATION_FAILED' WHEN list_has_any(f, {list(R.FORBIDDEN_KEYS)}) OR len(list_filter(f, lambda x: regexp_matches(x, '^(measurement_|dim_)'))) > 0 THEN 'FORBIDDEN_FIELD_NAME'
WHEN {_IS["EMAIL"]} THEN 'NER_HIT_EMAIL' WHEN {_IS["PHONE"]} THEN 'NER_HIT_PHONE' WHEN {_IS["SSN"]} THEN 'NER_HIT_SSN' WHEN {_IS["URL"]} THEN 'NER_HIT_URL'
WHEN len(list_filter(n, lambda x: NOT regexp_full_match(x, '0|1-10|11-50|51-200|201-1000|1001-10000|1000\+|10000\+|3-10|11-100|101-1000|200\+|0(\.\d{{1,4}})?|1(\.0{{1,4}})?'))) > 0 THEN 'RAW_NUMERIC' WHEN len(list_filter(w, lambda x: length(x) > 240)) > 0 THEN 'STRING_TOO_LONG' END AS fault FROM b""")
def skill_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as texts of skills."""
    return read(spark, d, "documents").select("doc_id", K.skill_text_fault(F.col("text")).alias("fault"))
