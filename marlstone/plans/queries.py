"""The library's queries on the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import chunking, graph, taxonomy, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS content_hash FROM documents""")
def normalize_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.content_hash(C.normalize_text(F.col("text"))).alias("content_hash"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents WHERE trim(text) <> '' GROUP BY sha256(text)")
def dedupe_known_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where(F.trim("text") != "").select("doc_id", C.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE doc_id % 3 > 0 AND regexp_matches(text, '\\S') AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def known_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents against the hashes of the rest, which were taken in before: what is left to process."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("file_hash"))
    known = docs.where("doc_id % 3 = 0").select("file_hash")
    return chunking.unseen(docs.where("doc_id % 3 > 0"), known).select("doc_id", "file_hash")


@query(r"""SELECT page_id, substr(CASE WHEN s = '' THEN 'page' ELSE s END, 1, 80) AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def page_slug(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", C.slugify(F.col("url")).alias("slug"))


def _sql_score(t: taxonomy.DocType) -> str:
    """SQL of a type's score, from the taxonomy's words alone."""
    has = lambda words: " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) or "0"
    fits = " OR ".join(f"regexp_full_match(name, '{taxonomy.glob_regex(p)[1:-1]}')" for p in t.patterns) or "false"
    return f"round(least(1e0, CASE WHEN {fits} THEN 4e-1 ELSE 0e0 END + least(3e-1, 3e-1 * (({has(t.tokens)}) / {len(t.tokens)}e0)) + least(3e-1, 5e-2 * ({has(t.keywords)}))), 4)"


_SCORES = (
    "s AS (SELECT doc_id, source, u.type, u.ord, u.score FROM (SELECT doc_id, source, unnest(["
    + ", ".join(f"{{type: '{t.name}', ord: {i}, score: {_sql_score(t)}}}" for i, t in enumerate(taxonomy.LANGUAGE_TYPES))
    + "]) AS u FROM (SELECT *, doc_id::VARCHAR || '.txt' AS name FROM documents)))"
)
_BEST = f"WITH {_SCORES}, b AS (SELECT doc_id, source, CASE WHEN score > 0 THEN type ELSE 'general_document' END AS type, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, d, "documents").select("doc_id", "source", taxonomy.scores(F.col("text"), uri).alias("scores"))


def best_types(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, type and score of the best type."""
    return _scored(spark, d).select("doc_id", "source", taxonomy.best(F.col("scores")).alias("b")).select("doc_id", "source", "b.type", "b.score")


@query(f"WITH {_SCORES} SELECT doc_id, type, score FROM s")
def type_match_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.inline("scores")).select("doc_id", "type", "score")


@query(_BEST + " SELECT doc_id, type, score FROM b")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    return best_types(spark, d).select("doc_id", "type", "score")


@query(f"WITH {_SCORES} SELECT doc_id, type, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type) AS place FROM s QUALIFY place <= 4")
def alternatives_top3(spark: SparkSession, d: str) -> DataFrame:
    """The stub classifier's answer (place 1) and its three alternatives."""
    return _scored(spark, d).select("doc_id", F.posexplode(F.slice(taxonomy.ranked(F.col("scores")), 1, 4)).alias("i", "s")).select("doc_id", "s.type", (-F.col("s.less")).alias("score"), (F.col("i") + 1).alias("place"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Scores beside the answer of a made-up classifier, which is often wrong."""
    names = F.array(*[F.lit(t.name) for t in taxonomy.LANGUAGE_TYPES])
    return _scored(spark, d).withColumns({"predicted": F.get(names, (F.col("doc_id") % 4).cast("int")), "given": (F.col("doc_id") % 11) / 10.0})


_ANSWERS = f"""WITH {_SCORES}, p AS (SELECT doc_id, ['english', 'french_text', 'german_text', 'spanish'][doc_id % 4 + 1] AS predicted, (doc_id % 11) / 10e0 AS given FROM documents),
h AS (SELECT s.*, predicted, given, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM s JOIN p USING (doc_id))"""


@query(_ANSWERS + """, g AS (SELECT doc_id, predicted, given, max(score) AS top, max(CASE WHEN place = 1 THEN CASE WHEN score > 0 THEN type ELSE 'general_document' END END) AS best, max(CASE WHEN place = 2 THEN score END) AS nxt, max(CASE WHEN type = predicted THEN score END) AS own FROM h GROUP BY ALL),
k AS (SELECT *, greatest(0e0, top - own) AS gap FROM g),
r AS (SELECT *, top >= 5e-2 AND own < 5e-2 AND gap >= 25e-2 AS novel, predicted <> best AND gap >= 25e-2 AS apart, top > 0 AND nxt > 0 AND top - nxt < 1e-1 AND given < 55e-2 + 15e-2 AS tied FROM k),
c AS (SELECT *, CASE WHEN novel OR apart THEN greatest(0e0, given - gap) ELSE given END AS adjusted FROM r)
SELECT doc_id, predicted, round(least(1e0, adjusted), 6) AS confidence, CASE WHEN novel THEN 'NOVEL_PATTERN' WHEN apart OR tied THEN 'TIE_BETWEEN_TYPES' WHEN adjusted < 55e-2 THEN 'LOW_CONFIDENCE' END AS reason,
       round(own, 6) AS header_match_score, round(top, 6) AS keyword_density, round(1 - 1 / (1 + (top > 0)::INT + (nxt > 0)::INT)::DOUBLE, 6) AS structural_complexity, round(1 - gap, 6) AS heuristic_agreement, round(given, 6) AS llm_confidence, 0e0 AS alt_count, NULL::DOUBLE AS llm_error FROM c""")
def adjudicate(spark: SparkSession, d: str) -> DataFrame:
    found = taxonomy.adjudicate(F.col("scores"), F.col("predicted"), F.col("given"))
    return _answers(spark, d).select("doc_id", "predicted", *[(c if n == "reason" else F.round(c, 6)).alias(n) for n, c in found.items()])


_LISTED = (("english", "Prose in\nEnglish "), ("general_document", "Anything else"))


@query(f"""SELECT doc_id, sha256('TAXONOMY (pick exactly one):' || chr(10) || '- english: Prose in English' || chr(10) || '- general_document (catch-all): Anything else' || chr(10) || chr(10) || 'SOURCE URI: ' || CASE WHEN doc_id % 4 = 0 THEN '(unknown)' ELSE doc_id || '.txt' END || chr(10) || chr(10) || 'EXTRACTED FIELDS:' || chr(10)
|| '{{"a": ' || doc_id || ', "lang": "' || lang || '"}}' || chr(10) || chr(10) || 'DOCUMENT TEXT' || CASE WHEN length(text) > {taxonomy.SHOWN} THEN ' (truncated)' ELSE '' END || ':' || chr(10) || left(text, {taxonomy.SHOWN}) || chr(10) || chr(10) || 'Respond with the JSON object as instructed.' || chr(10)) AS prompt_sha256 FROM documents""")
def classify_prompts(spark: SparkSession, d: str) -> DataFrame:
    uri = F.when(F.col("doc_id") % 4 > 0, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    fields = F.format_string('{"lang":"%s","a":%d}', "lang", "doc_id")
    told = taxonomy.prompt(F.col("text"), uri, fields, _LISTED, ("general_document",))
    return read(spark, d, "documents").select("doc_id", F.sha2(told, 256).alias("prompt_sha256"))


@query(f"""WITH {_SCORES}, m AS (SELECT doc_id, doc_id % 7 AS k, (doc_id % 11) / 1e1 AS c FROM documents),
p AS (SELECT doc_id, k, CASE WHEN k IN (5, 6) THEN 'unclassified' ELSE ['english', 'french_text', 'german_text', 'spanish'][k % 4 + 1] END AS predicted, CASE k WHEN 6 THEN 0e0 WHEN 3 THEN 5e-1 ELSE c END AS given, k = 6 AS failed, CASE WHEN k IN (3, 4) THEN 1 ELSE 0 END AS alts FROM m),
h AS (SELECT s.*, predicted, given, failed, alts, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM s JOIN p USING (doc_id)),
g AS (SELECT doc_id, predicted, given, failed, alts, max(score) AS top, max(CASE WHEN place = 1 THEN CASE WHEN score > 0 THEN type ELSE 'general_document' END END) AS best, max(CASE WHEN place = 2 THEN score END) AS nxt, coalesce(max(CASE WHEN type = predicted THEN score END), 0) AS own FROM h GROUP BY ALL),
k AS (SELECT *, greatest(0e0, top - own) AS gap FROM g),
r AS (SELECT *, top >= 5e-2 AND own < 5e-2 AND gap >= 25e-2 AS novel, predicted <> best AND gap >= 25e-2 AS apart, top > 0 AND nxt > 0 AND top - nxt < 1e-1 AND given < 55e-2 + 15e-2 AS tied FROM k),
c AS (SELECT *, CASE WHEN novel OR apart THEN greatest(0e0, given - gap) ELSE given END AS adjusted FROM r),
a AS (SELECT doc_id, type, score FROM h WHERE score > 0 AND type <> predicted AND NOT failed UNION ALL SELECT doc_id, 'spanish', 35e-2 FROM p WHERE alts = 1 AND predicted <> 'spanish'),
t AS (SELECT doc_id, type, max(score) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY max(score) DESC, type) AS place FROM a GROUP BY doc_id, type),
l AS (SELECT doc_id, string_agg(type, ',' ORDER BY place) AS alternatives FROM t WHERE place <= 3 GROUP BY doc_id)
SELECT doc_id, predicted, coalesce(alternatives, '') AS alternatives, round(CASE WHEN failed THEN given ELSE least(1e0, adjusted) END, 6) AS confidence, CASE WHEN failed OR novel THEN 'NOVEL_PATTERN' WHEN apart OR tied THEN 'TIE_BETWEEN_TYPES' WHEN adjusted < 55e-2 THEN 'LOW_CONFIDENCE' END AS reason,
  round(CASE WHEN failed THEN top ELSE own END, 6) AS header_match_score, round(CASE WHEN failed THEN 0 ELSE 1 - gap END, 6) AS heuristic_agreement, CASE WHEN NOT failed THEN round(alts / 3e0, 6) END AS alt_count, CASE WHEN failed THEN 1e0 END AS llm_error FROM c LEFT JOIN l USING (doc_id)""")
def classified_documents(spark: SparkSession, d: str) -> DataFrame:
    """From text and a model's reply to the verdict: replies with and without alternatives and confidence, of an unknown type, and unreadable ones."""
    k, c = F.col("doc_id") % 7, F.format_string("%.1f", (F.col("doc_id") % 11) / 10.0)
    name = F.get(F.array(*[F.lit(t.name) for t in taxonomy.LANGUAGE_TYPES]), (k % 4).cast("int"))
    alts = F.lit(', "alternatives": [{"type": "spanish", "confidence": 0.35}, {"type": "klingon", "confidence": 0.9}]')
    told = F.concat(F.lit('Here: {"type": "'), F.when(k == 5, "klingon").otherwise(name), F.lit('"'), F.when(k == 3, "").otherwise(F.concat(F.lit(', "confidence": '), c)), F.when(k.isin(3, 4), alts).otherwise(""), F.lit("} done"))
    docs = read(spark, d, "documents").select("doc_id", "text", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("uri"), F.when(k == 6, "sorry").otherwise(told).alias("answer"))
    r = lambda n: F.round(n, 6).alias(n)
    names = F.array_join(F.transform("alternatives", lambda x: x["type"]), ",").alias("alternatives")
    return taxonomy.classified(docs).select("doc_id", "predicted", names, r("confidence"), "reason", r("header_match_score"), r("heuristic_agreement"), r("alt_count"), "llm_error")


@query(_ANSWERS + """, c AS (SELECT doc_id, type, score FROM h WHERE score > 0 AND type <> predicted UNION ALL SELECT DISTINCT doc_id, 'spanish', given FROM h WHERE predicted <> 'spanish'),
t AS (SELECT doc_id, type, max(score) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY max(score) DESC, type) AS place FROM c GROUP BY doc_id, type)
SELECT doc_id, type, score, place FROM t WHERE place <= 3""")
def alternatives_merged(spark: SparkSession, d: str) -> DataFrame:
    """The classifier names Spanish as its alternative; the merge keeps the greater of its and our score."""
    given = F.array(F.struct(F.lit("spanish").alias("type"), F.col("given").alias("confidence")))
    return _answers(spark, d).select("doc_id", F.posexplode(taxonomy.merged_alternatives(F.col("scores"), F.col("predicted"), given)).alias("i", "s")).select("doc_id", "s.type", (-F.col("s.less")).alias("score"), (F.col("i") + 1).alias("place"))


@query(_BEST + " SELECT source AS tenant, type, count(*) AS n, CASE WHEN count(*) <= 10 THEN '1-10' WHEN count(*) <= 100 THEN '11-100' WHEN count(*) <= 1000 THEN '101-1000' WHEN count(*) <= 10000 THEN '1001-10000' ELSE '10000+' END AS bucket FROM b GROUP BY ALL")
def doc_type_distribution(spark: SparkSession, d: str) -> DataFrame:
    n = best_types(spark, d).groupBy(F.col("source").alias("tenant"), "type").agg(F.count("*").alias("n"))
    return n.withColumn("bucket", C.bucketize(F.col("n")))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(read(spark, d, "documents"))


@query(r"""SELECT doc_id, true AS sound, CASE WHEN length(t) <= 1500 THEN 1 END AS n_chunks, CASE WHEN length(t) <= 1500 THEN sha256(t) END AS only_hash
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents) WHERE regexp_matches(t, '\S')""")
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether each chunk is the slice that its bounds name, no longer than allowed, and they leave no gap; a short text is one chunk."""
    docs = read(spark, d, "documents").select("doc_id", C.normalize_text(F.col("text")).alias("t"))
    c = chunking.chunk(read(spark, d, "documents"))
    after = F.lag("end_char", 1, 0).over(Window.partitionBy("doc_id").orderBy("position"))
    c = c.withColumn("joined", F.col("start_char") <= after).join(docs, "doc_id")
    sound = (F.substring("t", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")) & (F.length("text") <= 1500 + 150) & F.col("joined")
    one = F.length("t") <= 1500
    return c.groupBy("doc_id").agg(F.bool_and(sound).alias("sound"), F.when(F.bool_and(one), F.count("*")).alias("n_chunks"), F.when(F.bool_and(one), F.min("chunk_hash")).alias("only_hash"))


@query()
def chunks_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document counts as a Python file."""
    uri = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".py").otherwise(".txt"))
    return chunking.chunk_by_kind(read(spark, d, "documents").withColumns({"uri": uri, "mime": F.lit(None).cast("string")}))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY place <= 8")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (every twentieth vector) against all vectors, in blocks of queries."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(e.where(F.col("vec_id") % 20 == 0), e, 8)


@query("SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos")
def centroid_mean(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return e.groupBy("label", F.col("p").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c"))


_CENTROIDS = "c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"


@query(f"WITH {_CENTROIDS} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS score FROM c a JOIN c b ON a.label < b.label WHERE list_cosine_similarity(a.c, b.c) >= 0.1")
def centroid_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cluster centroids (a small set: one row a cluster) at a cosine of 0.1 or more."""
    c = _centroids(spark, d)
    x, y = c.alias("x"), c.alias("y")
    s = x.join(y, F.col("x.label") < F.col("y.label")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), C.cosine(F.col("x.c"), F.col("y.c")).alias("score"))
    return s.where("score >= 0.1").withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {_CENTROIDS}, e AS MATERIALIZED (SELECT a.label AS a, b.label AS b FROM c a JOIN c b ON a.label <> b.label WHERE list_cosine_similarity(a.c, b.c) >= 0.1), r AS (SELECT label AS root, label AS v FROM c UNION SELECT root, b FROM r JOIN e ON e.a = r.v) SELECT root AS label, min(v) AS community FROM r GROUP BY root")
def communities(spark: SparkSession, d: str) -> DataFrame:
    edges = centroid_edges(spark, d).select("a", "b")
    found = graph.components(edges).withColumnRenamed("node", "label_").withColumnRenamed("label", "community")
    return _centroids(spark, d).select("label").join(found, F.col("label") == F.col("label_"), "left").select("label", F.coalesce("community", "label").alias("community"))


_STOP = ("the", "and", "for", "that", "with", "this", "from", "are", "was", "not", "but", "have", "has", "had", "its", "will", "can", "our", "you", "all")


@query(f"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS tok FROM documents),
n AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, tok) AS place FROM t WHERE length(tok) > 2 AND tok NOT IN {_STOP} GROUP BY source, tok),
l AS (SELECT source, string_agg(tok, '_' ORDER BY place) AS tail FROM n WHERE place <= 2 GROUP BY source)
SELECT s.source, 'cluster_' || coalesce(tail, s.source) AS label FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN l ON l.source = s.source""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """The two most frequent words of each source that are no stop words; its name where it has none."""
    docs = read(spark, d, "documents")
    tok = docs.select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9]+)"))).alias("tok")).where((F.length("tok") > 2) & ~F.col("tok").isin(*_STOP))
    n = tok.groupBy("source", "tok").agg(F.count("*").alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "tok"))).where("place <= 2")
    named = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tok"))), lambda s: s["tok"]), "_").alias("tail"))
    return docs.select("source").distinct().join(named, "source", "left").select("source", F.concat(F.lit("cluster_"), F.coalesce("tail", "source")).alias("label"))


_GROUPS = "SELECT event_type AS kind, user_id % 7 AS domain, count(DISTINCT user_id) AS tenants, count(*) AS observations, round(avg(greatest(0, least(1, value / 100))), 6) AS confidence FROM events GROUP BY ALL"


@query(_GROUPS)
def signature_groups(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("domain", F.col("user_id") % 7)
    return e.groupBy(F.col("event_type").alias("kind"), "domain").agg(
        F.countDistinct("user_id").alias("tenants"), F.count("*").alias("observations"), F.round(F.avg(C.clamp01(F.col("value") / 100)), 6).alias("confidence"),
    )


@query(f"SELECT * FROM ({_GROUPS}) WHERE tenants >= 3 AND observations >= 25 AND confidence >= CASE WHEN domain = 0 THEN 3e-1 ELSE 65e-2 END")
def threshold_groups(spark: SparkSession, d: str) -> DataFrame:
    """The default thresholds, and a domain with a mean confidence of its own."""
    return signature_groups(spark, d).where("tenants >= 3 AND observations >= 25 AND confidence >= CASE WHEN domain = 0 THEN 0.3D ELSE 0.65D END")


@query("SELECT event_id, " + ", ".join(f"round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {n * 86400000000} PRECEDING AND CURRENT ROW), 4) AS spent_{n}d" for n in (1, 7, 30)) + " FROM events WHERE event_type = 'purchase'")
def spend_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type = 'purchase'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = lambda n: Window.partitionBy("user_id").orderBy("us").rangeBetween(-n * 86_400_000_000, 0)
    return e.select("event_id", *[F.round(F.sum("value").over(w(n)), 4).alias(f"spent_{n}d") for n in (1, 7, 30)])


@query("SELECT event_id, lag(h, 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_hash, h AS row_hash FROM (SELECT event_id, user_id, sha256(event_type || '|' || props || '|' || event_id) AS h FROM events)")
def audit_links(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2(F.concat_ws("|", "event_type", "props", F.col("event_id").cast("string")), 256)
    e = read(spark, d, "events").select("event_id", "user_id", h.alias("row_hash"))
    return e.select("event_id", F.lag("row_hash", 1, "0" * 64).over(Window.partitionBy("user_id").orderBy("event_id")).alias("prev_hash"), "row_hash")


@query("SELECT conv_id, count(*) AS kept, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5 GROUP BY conv_id")
def last_five(spark: SparkSession, d: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    c = read(spark, d, "conversations").withColumn("back", back).where("back <= 5")
    return c.groupBy("conv_id").agg(F.count("*").alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ",").alias("roles"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 197), ' ') || '...' ELSE text END AS card, CASE WHEN length(text) <= 10 THEN 'small' WHEN length(text) <= 50 THEN 'medium' ELSE 'large' END AS band FROM documents")
def summary_cards(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.summary_card(F.col("text")).alias("card"), C.cost_band(F.length("text")).alias("band"))


@query("SELECT lang, CAST(s[CAST(round_even(0.5 * (len(s) - 1), 0) AS INT) + 1] AS BIGINT) AS p50, CAST(s[CAST(round_even(0.95 * (len(s) - 1), 0) AS INT) + 1] AS BIGINT) AS p95 FROM (SELECT lang, list(n_chars ORDER BY n_chars) AS s FROM documents GROUP BY lang)")
def length_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact order statistics by rank, without gathering a group's values in one place."""
    n = read(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    n = n.withColumns({"to": F.sum("c").over(w), "all": F.sum("c").over(Window.partitionBy("lang"))})
    at = lambda q: F.bround(F.lit(q) * (F.col("all") - 1)).cast("long") + 1
    pick = lambda q: F.max(F.when((F.col("to") >= at(q)) & (F.col("to") - F.col("c") < at(q)), F.col("n_chars")))
    return n.groupBy("lang").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example') ORDER BY page_id LIMIT 50 OFFSET 10")
def page_search(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").where(F.contains(F.lower("url"), F.lit("example")))
    return p.select("page_id", "url").orderBy("page_id").offset(10).limit(50)


@query("SELECT doc_id, CASE WHEN prev IS NULL THEN 'added' WHEN cur IS NULL THEN 'deleted' WHEN prev <> cur THEN 'modified' ELSE 'same' END AS kind FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.h AS prev, b.h AS cur FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'fr') a FULL JOIN (SELECT doc_id, md5(CASE WHEN lang = 'de' THEN lower(text) ELSE text END) AS h FROM documents WHERE lang <> 'es') b ON a.doc_id = b.doc_id)")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two snapshots of the documents."""
    docs = read(spark, d, "documents")
    a = docs.where("lang <> 'fr'").select("doc_id", F.md5("text").alias("prev"))
    b = docs.where("lang <> 'es'").select("doc_id", F.md5(F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text"))).alias("cur"))
    kind = F.when(F.col("prev").isNull(), "added").when(F.col("cur").isNull(), "deleted").when(F.col("prev") != F.col("cur"), "modified").otherwise("same")
    return a.join(b, "doc_id", "full").select("doc_id", kind.alias("kind"))
