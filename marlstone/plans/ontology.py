"""Queries on induced trees and the pages of their nodes.

A language is a tenant; its documents that have a vector are the chunks, and
the vector's label is the cluster. Languages with the signal words start from
the seeds, the others do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import ontology as O
from marlstone.operators import pages as P
from marlstone.operators import tree
from marlstone.plans.queries import _BEST, ORACLE, best_types, query, read
from marlstone.plans.wiki import NOW
from marlstone.session import written

ALIKE = 0.1
SIGNALS = ("rewh", "orre", "thatin", "hehely")
SEEDS = [("general", "General text", 0), ("rewh_notes", "Rewh notes", 1), ("orre", "Thatin or orre", 2), ("nothing", "Nothing of the kind", 3)]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("tenant"), "text")
    vec = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("cluster"))
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    source = F.concat("tenant", F.lit("/"), F.col("doc_id").cast("string"))
    return docs.join(vec, "doc_id").select("tenant", key.alias("chunk"), key.alias("document"), F.col("doc_id").alias("position"), source.alias("source"), "text", "embedding", "cluster")


def _induced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, nodes, members)."""
    c = written(chunks(spark, d), "chunks")
    nodes, members = O.induce(c, spark.createDataFrame(SEEDS, "name string, label string, ord int"), signals=SIGNALS, alike=ALIKE)
    return c, nodes, members


_C = "c AS MATERIALIZED (SELECT lang AS tenant, doc_id, label AS cluster, text, sha256(text) AS chunk, embedding::DOUBLE[] AS v, lang || '/' || doc_id AS src FROM documents JOIN embeddings ON vec_id = doc_id)"
_W = _C + ", w AS MATERIALIZED (SELECT tenant, cluster, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS word FROM c)"
_MEAN = "list(x ORDER BY i) AS m FROM (SELECT {keys}, i, avg(x) AS x FROM (SELECT {keys}, unnest({v}) AS x, unnest(range(len({v}))) AS i FROM {of}) GROUP BY ALL) GROUP BY ALL"
_SEEDS = ", ".join(f"('{n}', '{t}', {o})" for n, t, o in SEEDS)
_TREE = f"""{_W},
n AS (SELECT tenant, cluster, word, row_number() OVER (PARTITION BY tenant, cluster ORDER BY count(*) DESC, word) AS place FROM w WHERE length(word) > 2 AND word NOT IN {tuple(x for x in O.STOP_WORDS if "'" not in x)} GROUP BY tenant, cluster, word QUALIFY place <= 2),
l AS (SELECT tenant, cluster, 'cluster_' || coalesce(string_agg(word, '_' ORDER BY place), cluster::VARCHAR) AS label FROM (SELECT DISTINCT tenant, cluster FROM c) LEFT JOIN n USING (tenant, cluster) GROUP BY tenant, cluster),
m AS MATERIALIZED (SELECT tenant, cluster, {_MEAN.format(keys="tenant, cluster", v="v", of="c")}),
e AS MATERIALIZED (SELECT a.tenant, a.cluster AS a, b.cluster AS b FROM m a JOIN m b ON a.tenant = b.tenant AND a.cluster <> b.cluster WHERE list_cosine_similarity(a.m, b.m) >= {ALIKE}),
r AS (SELECT tenant, cluster AS root, cluster AS v FROM m UNION SELECT r.tenant, root, b FROM r JOIN e ON e.tenant = r.tenant AND e.a = r.v),
f AS (SELECT tenant, cluster, first, dense_rank() OVER (PARTITION BY tenant ORDER BY first) - 1 AS community FROM (SELECT tenant, root AS cluster, min(v) AS first FROM r GROUP BY ALL)),
sd AS (SELECT tenant, count(DISTINCT CASE WHEN word IN {SIGNALS} THEN word END) >= {O.LEAST_SIGNALS} AS seeded FROM w GROUP BY tenant),
mm AS (SELECT tenant, community, {_MEAN.format(keys="tenant, community", v="m", of="m JOIN f USING (tenant, cluster)")}),
g AS MATERIALIZED (SELECT f.tenant, community, label, seeded, mm.m, 'ind:' || CASE WHEN seeded THEN 'category' ELSE 'root' END || ':' || substr(sha1(CASE WHEN seeded THEN 'category' ELSE 'root' END || '|' || label || '|' || community), 1, 12) AS id
      FROM f JOIN l USING (tenant, cluster) JOIN sd USING (tenant) JOIN mm USING (tenant, community) WHERE f.first = f.cluster),
k(name, label, ord) AS (VALUES {_SEEDS}),
q AS (SELECT g.tenant, g.id, k.name, k.label AS top, k.ord, row_number() OVER (PARTITION BY g.tenant, g.id ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(g.label), '[a-z][a-z0-9]+')),
        list_distinct(regexp_extract_all(lower(k.label || ' seed:' || k.name), '[a-z][a-z0-9]+')))) DESC, k.ord) AS place FROM g, k WHERE seeded QUALIFY place = 1),
t AS MATERIALIZED (SELECT l.tenant, 'ind:topic:' || substr(sha1('topic|' || l.label || '|' || l.cluster), 1, 12) AS id, g.id AS parent_id, l.label, 'induced' AS kind, l.cluster::BIGINT AS ord, 5e-1 AS confidence, CASE WHEN seeded THEN 2 ELSE 1 END AS depth, m.m, l.cluster
      FROM l JOIN f USING (tenant, cluster) JOIN g USING (tenant, community) JOIN m ON m.tenant = l.tenant AND m.cluster = l.cluster),
nodes AS MATERIALIZED (SELECT DISTINCT tenant, 'seed:' || name AS id, NULL::VARCHAR AS parent_id, top AS label, 'seed' AS kind, ord::BIGINT AS ord, 1e0 AS confidence, 0 AS depth, NULL::DOUBLE[] AS m FROM q
  UNION ALL SELECT g.tenant, g.id, 'seed:' || q.name, g.label, 'induced', community, 5e-1, CASE WHEN seeded THEN 1 ELSE 0 END, g.m FROM g LEFT JOIN q ON q.tenant = g.tenant AND q.id = g.id
  UNION ALL SELECT tenant, id, parent_id, label, kind, ord, confidence, depth, m FROM t),
h2 AS MATERIALIZED (SELECT t.tenant, t.id, chunk FROM t JOIN c USING (tenant, cluster))"""


@query(f"WITH RECURSIVE {_TREE} SELECT tenant, id, parent_id, label, kind, ord, confidence, CAST(coalesce(n, 0) AS BIGINT) AS n_chunks FROM nodes LEFT JOIN (SELECT tenant, id, count(*) AS n FROM h2 GROUP BY ALL) USING (tenant, id)")
def induced_tree(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, members = _induced(spark, d)
    n = members.groupBy("tenant", "id").agg(F.count("*").alias("n_chunks"))
    return nodes.join(n, ["tenant", "id"], "left").select("tenant", "id", "parent_id", "label", "kind", "ord", "confidence", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query(f"WITH {_W} SELECT tenant, count(DISTINCT CASE WHEN word IN {SIGNALS} THEN word END) >= {O.LEAST_SIGNALS} AS seeded FROM w GROUP BY tenant")
def seeded_tenants(spark: SparkSession, d: str) -> DataFrame:
    return O.seeded(chunks(spark, d), SIGNALS)


@query(f"""WITH {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY tenant, cluster ORDER BY doc_id, chunk) AS place, replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), repeat(chr(10), 3), repeat(chr(10), 2)) AS s FROM c QUALIFY place <= 5)
SELECT tenant, cluster, 'Cluster excerpts:' || chr(10) || chr(10) || string_agg('[doc ' || place || '] ' || CASE WHEN length(s) > 600 THEN left(s, 600) || '...' ELSE s END, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Return the JSON object now.' AS prompt FROM p GROUP BY ALL""")
def label_prompts(spark: SparkSession, d: str) -> DataFrame:
    return O.excerpts(chunks(spark, d))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'topic ' || lang WHEN 1 THEN lang END AS label, CASE doc_id % 5 WHEN 0 THEN (doc_id % 10) / 1e1 WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 1e0 ELSE 5e-1 END END AS confidence FROM documents""")
def label_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies made from each document's id and language: whole ones with prose around, ones with an odd confidence, without a label, cut off, and none."""
    lang, one = F.col("lang"), (F.col("doc_id") % 10).cast("string")
    said = [
        F.concat(F.lit('Sure: {"label": "topic '), lang, F.lit('", "confidence": 0.'), one, F.lit("}\nBye.")),
        F.concat(F.lit('{"label": "  '), lang, F.lit('\\t", "confidence": '), F.when(F.col("doc_id") % 2 == 0, F.lit("7}")).otherwise(F.lit('"high"}'))),
        F.concat(F.lit('{"label": " ", "confidence": 0.9, "lang": "'), lang, F.lit('"}')),
        F.concat(F.lit('{"label": "'), lang),
        F.lit(None).cast("string"),
    ]
    told = O.label_answer(F.element_at(F.array(*said), (F.col("doc_id") % 5 + 1).cast("int")))
    return read(spark, d, "documents").select("doc_id", told.alias("t")).select("doc_id", "t.label", "t.confidence")


def built(spark: SparkSession, d: str) -> DataFrame:
    """All pages of the induced trees, with their related pages."""
    c, nodes, members = _induced(spark, d)
    walked = written(tree.walk(nodes), "walked")
    kinds = best_types(spark, d).join(read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("document")), "doc_id").select("document", "type")
    pages = P.build(walked, tree.rollup(walked, members), c, F.lit(NOW).cast("timestamp_ntz"), centroids=nodes, types=kinds)
    return P.with_related(written(pages, "pages"), walked)


_SMALL = "(SELECT tenant, id FROM nodes LEFT JOIN (SELECT tenant, id, count(*) AS n FROM {h} GROUP BY ALL) USING (tenant, id) WHERE depth = {depth} AND coalesce(n, 0) < 2)"
_UP = "SELECT * FROM {h} UNION ALL SELECT {h}.tenant, parent_id, chunk FROM {h} JOIN nodes USING (tenant, id) WHERE depth = {depth} AND (tenant, id) IN " + _SMALL
_TITLE = "array_to_string(list_transform(regexp_split_to_array(trim(regexp_replace(label, '[_-]', ' ', 'g')), '\\s+'), lambda x: CASE WHEN x = lower(x) AND x <> upper(x) THEN upper(x[1]) || x[2:] ELSE x END), ' ')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FLAT = f"replace(trim(text, {_BLANKS}), chr(10), ' ')"


@query(f"""WITH RECURSIVE {_TREE}, {_BEST.removeprefix("WITH ")},
h1 AS MATERIALIZED ({_UP.format(h="h2", depth=2)}), h AS MATERIALIZED ({_UP.format(h="h1", depth=1)}),
one AS (SELECT tenant, chunk, max(doc_id) AS doc_id FROM c GROUP BY ALL),
full_ AS MATERIALIZED (SELECT h.tenant, h.id, h.chunk, c.doc_id, c.src, c.text, row_number() OVER (PARTITION BY h.tenant, h.id ORDER BY round(coalesce(list_cosine_similarity(c.v, nodes.m), 0e0), 9) DESC, c.doc_id, h.chunk) AS place
      FROM h JOIN one USING (tenant, chunk) JOIN c ON c.tenant = h.tenant AND c.doc_id = one.doc_id JOIN nodes ON nodes.tenant = h.tenant AND nodes.id = h.id),
p AS (SELECT tenant, id, count(*) AS n_chunks, count(DISTINCT src) AS source_uri_count FROM full_ GROUP BY ALL HAVING count(*) >= 2),
y AS (SELECT chunk, min(type) AS type FROM b JOIN (SELECT doc_id, sha256(text) AS chunk FROM documents) USING (doc_id) GROUP BY chunk),
z AS (SELECT tenant, id, type, row_number() OVER (PARTITION BY tenant, id ORDER BY count(*) DESC, type) AS place FROM (SELECT DISTINCT tenant, id, chunk FROM full_) JOIN y USING (chunk) GROUP BY tenant, id, type QUALIFY place <= 5),
dt AS (SELECT tenant, id, list(type ORDER BY place) AS doc_types FROM z GROUP BY ALL),
hd AS (SELECT tenant, id, left(split_part(trim(text, {_BLANKS}), chr(10), 1), 200) AS head FROM full_ WHERE place = 1),
tp AS (SELECT tenant, id, count(*) AS k, count(DISTINCT src) AS srcs, substr(sha256(string_agg(chunk, '|' ORDER BY place)), 1, 16) AS mark,
        string_agg(place || '. [' || src || '](' || src || ')' || chr(10) || '   > ' || CASE WHEN length({_FLAT}) > 240 THEN rtrim(left({_FLAT}, 237), {_BLANKS}) || '...' ELSE {_FLAT} END, chr(10) ORDER BY place) AS docs
       FROM full_ WHERE place <= 10 GROUP BY ALL),
kin AS (SELECT a.tenant, a.id, b.id AS other, b.label, CASE WHEN a.parent_id = b.id THEN 0 WHEN a.parent_id = b.parent_id THEN 1 ELSE 2 END AS rank, b.ord
        FROM nodes a JOIN nodes b ON a.tenant = b.tenant AND a.id <> b.id AND (a.parent_id = b.id OR a.parent_id = b.parent_id OR b.parent_id = a.id)),
tl AS (SELECT tenant, id, string_agg('- ' || label, chr(10) ORDER BY w) AS topics FROM (SELECT tenant, id, label, min(CASE rank WHEN 2 THEN 0 ELSE 1 END * 1000000 + ord) AS w FROM kin WHERE rank > 0 AND label <> '' GROUP BY ALL) GROUP BY ALL),
rl AS (SELECT kin.tenant, kin.id, list('pg_' || substr(sha1(kin.tenant || '|' || other), 1, 16) ORDER BY rank, ord, other) AS related FROM kin JOIN p ON p.tenant = kin.tenant AND p.id = kin.other GROUP BY ALL),
u AS (SELECT p.*, label, doc_types, head, k, srcs, mark, docs, topics, related, {_TITLE} AS title,
        'This page summarises the topic ''' || label || '''. It was built from ' || k || ' source chunks across ' || srcs || ' distinct documents. Representative excerpt: ' ||
        CASE WHEN contains(head, '''') AND NOT contains(head, '"') THEN '"' || replace(replace(head, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't') || '"' ELSE '''' || replace(replace(replace(head, chr(92), chr(92) || chr(92)), '''', chr(92) || ''''), chr(9), chr(92) || 't') || '''' END
        || '. {P.CLOSING.replace("%s", "' || mark || '")}' AS summary
      FROM p JOIN nodes USING (tenant, id) JOIN tp USING (tenant, id) JOIN hd USING (tenant, id) LEFT JOIN dt USING (tenant, id) LEFT JOIN tl USING (tenant, id) LEFT JOIN rl USING (tenant, id))
SELECT tenant, 'pg_' || substr(sha1(tenant || '|' || id), 1, 16) AS page_id, id AS node, title, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS slug, summary, n_chunks, source_uri_count, coalesce(array_to_string(doc_types, ','), '') AS doc_types, coalesce(array_to_string(related, ','), '') AS related,
  concat_ws(chr(10) || chr(10), '## Overview', summary, '## Key documents', docs, '## Related topics', coalesce(topics, '_No related topics._'), '## Metadata', '- Source documents: ' || source_uri_count || chr(10) || '- Total chunks: ' || n_chunks || chr(10) || '- Last updated: 2024-02-01T00:00:00+00:00' || coalesce(chr(10) || '- Predominant document types: ' || array_to_string(doc_types, ', '), '')) || chr(10) AS body
FROM u""")
def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return built(spark, d).select("tenant", "page_id", "node", "title", "slug", "summary", "n_chunks", "source_uri_count", joined("doc_types"), joined("related"), "body")


_NEW = "(tenant IN ('de', 'fr') AND doc_id % 9 = 0)"


@query(f"""WITH RECURSIVE {_TREE},
h1 AS MATERIALIZED ({_UP.format(h="h2", depth=2)}), h AS MATERIALIZED ({_UP.format(h="h1", depth=1)}),
one AS (SELECT tenant, chunk, max(doc_id) AS doc_id FROM c GROUP BY ALL),
full_ AS MATERIALIZED (SELECT h.tenant, h.id, h.chunk, c.src, row_number() OVER (PARTITION BY h.tenant, h.id ORDER BY round(coalesce(list_cosine_similarity(c.v, nodes.m), 0e0), 9) DESC, c.doc_id, h.chunk) AS place
      FROM h JOIN one USING (tenant, chunk) JOIN c ON c.tenant = h.tenant AND c.doc_id = one.doc_id JOIN nodes ON nodes.tenant = h.tenant AND nodes.id = h.id),
a1 AS (SELECT DISTINCT t.tenant, t.id FROM t JOIN c USING (tenant, cluster) WHERE {_NEW}), a AS (SELECT tenant, id FROM a1 UNION SELECT a.tenant, parent_id FROM a JOIN nodes USING (tenant, id) WHERE parent_id IS NOT NULL)
SELECT tenant, id AS node, count(*) AS n_chunks, count(DISTINCT src) AS source_uri_count, substr(sha256(string_agg(CASE WHEN place <= 10 THEN chunk END, '|' ORDER BY place)), 1, 16) AS fingerprint, (tenant, id) IN (SELECT tenant, id FROM a) AS rebuilt
FROM full_ GROUP BY tenant, id HAVING count(*) >= 2""")
def rebuilt_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a store that lacks some documents of two languages, after the rebuild of the topics that these fall to."""
    c, nodes, members = _induced(spark, d)
    walked = written(tree.walk(nodes), "walked")
    new = F.col("tenant").isin("de", "fr") & (F.col("position") % 9 == 0)
    known = O.members(c.where(~new), O.labels(c))
    now = F.lit(NOW).cast("timestamp_ntz")
    store = written(P.with_related(written(P.build(walked, tree.rollup(walked, known), c.where(~new), now, centroids=nodes), "pages"), walked).withColumn("version", F.lit(7)), "store")
    changed = O.members(c.where(new), O.labels(c)).select("tenant", "id")
    pages = P.rebuilt(store, walked, members, c, changed, now, centroids=nodes)
    mark = F.regexp_extract("summary", "Content fingerprint: ([0-9a-f]+)", 1)
    return pages.select("tenant", "node", "n_chunks", "source_uri_count", mark.alias("fingerprint"), (F.col("version") != 7).alias("rebuilt"))


@query("""WITH q AS (SELECT d.lang AS tenant, d.source AS node, c.conv_id, c.turn FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.turn >= 1)
SELECT tenant, node FROM q WHERE conv_id % 3 > 0 GROUP BY tenant, node HAVING count(*) >= 3""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Turns as queries about the source of the document of the conversation's number; turn 0 is too old, every third conversation found an answer."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("lang").alias("tenant"), F.col("source").alias("node"))
    q = read(spark, d, "conversations").join(docs, "conv_id")
    q = q.select("tenant", "node", F.timestamp_seconds("turn").alias("ts"), F.when(F.col("conv_id") % 3 == 0, 2).alias("hits"))
    return P.gaps(q, F.timestamp_seconds(F.lit(1))).select("tenant", F.explode("node_ids").alias("node"))


@query(f"""SELECT tenant, node, title, row_number() OVER (PARTITION BY tenant ORDER BY lower(title), page_id) AS place FROM ({ORACLE['page_bodies']}) WHERE contains(lower(title), 'cluster_d') OR contains(lower(summary), 'cluster_d')""")
def wiki_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose title or summary holds a string, whatever its case, in the order of a tenant's list."""
    return P.searched(built(spark, d), " Cluster_D").select("tenant", "node", "title", "place")


@query(f"""WITH p AS ({ORACLE['page_bodies']}), r AS (SELECT tenant, page_id, unnest(string_split(related, ',')) AS other, generate_subscripts(string_split(related, ','), 1) AS i FROM p WHERE related <> '')
SELECT r.tenant AS tenant, r.page_id AS page_id, row_number() OVER (PARTITION BY r.tenant, r.page_id ORDER BY i) AS place, p.slug AS slug, p.title AS title FROM r JOIN p ON p.tenant = r.tenant AND p.page_id = r.other""")
def related_cards(spark: SparkSession, d: str) -> DataFrame:
    return P.related_cards(written(built(spark, d), "built"))
