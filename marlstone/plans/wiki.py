"""Queries on trees and pages.

The tree of each language is a tenant's: its sources are the roots, bands of
text length the nodes below, and bands of a finer step the leaves; a document
is a chunk of its leaf. Documents without an id, a language or a source are in
no tree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import pages as P
from marlstone.operators import tree, vectors
from marlstone.plans.queries import _BEST, _centroids, best_types, query, read
from marlstone.session import written

NOW = "2024-02-01 00:00:00"


def _leaves(spark: SparkSession, d: str, step: int = 500) -> DataFrame:
    docs = read(spark, d, "documents").where("doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    band, leaf = F.concat(F.lit("band_"), F.floor(n / 2000).cast("string")), F.concat(F.lit("leaf_"), F.floor(n / step).cast("string"))
    return docs.select(F.col("lang").alias("tenant"), "source", band.alias("band"), leaf.alias("leaf"), "doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("chunk"))


def _nodes(leaves: DataFrame) -> DataFrame:
    number = F.crc32(F.concat_ws("/", "tenant", "source", "band")).cast("long")
    root = F.concat(F.lit("seed:"), F.col("source"))
    band = tree.node_id(F.lit("category"), F.col("band"), F.crc32(F.concat_ws("/", "tenant", "source").cast("binary")))
    leaf = tree.node_id(F.lit("topic"), F.col("leaf"), number)
    none = F.lit(None).cast("string")
    a = leaves.select("tenant", root.alias("id"), none.alias("parent_id"), F.col("source").alias("label"), F.lit("seed").alias("kind"))
    b = leaves.select("tenant", band.alias("id"), root.alias("parent_id"), F.col("band").alias("label"), F.lit("category").alias("kind"))
    c = leaves.select("tenant", leaf.alias("id"), band.alias("parent_id"), F.col("leaf").alias("label"), F.lit("topic").alias("kind"))
    return a.union(b).union(c).distinct().withColumn("ord", F.lit(0))


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walked nodes, chunks by node, chunks with texts)."""
    leaves = _leaves(spark, d)
    number = F.crc32(F.concat_ws("/", "tenant", "source", "band")).cast("long")
    held = leaves.select("tenant", tree.node_id(F.lit("topic"), F.col("leaf"), number).alias("id"), "chunk")
    texts = leaves.select("tenant", "chunk", F.col("doc_id").alias("position"), F.concat("tenant", F.lit("/"), F.col("doc_id").cast("string")).alias("source"), "text")
    return tree.walk(_nodes(leaves)), held, texts


# DuckDB has no crc32, so the SQL names nodes by their label paths; the ids are compared with it in pytest
_D = "d AS (SELECT lang AS tenant, source, 'band_' || (coalesce(n_chars, 0) // 2000) AS band, 'leaf_' || (coalesce(n_chars, 0) // 500) AS leaf, doc_id, sha256(coalesce(text, '')) AS chunk FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"
_N = _D + """, n AS (SELECT DISTINCT tenant, source AS path, 0 AS depth, NULL::VARCHAR AS up FROM d UNION SELECT tenant, source || '/' || band, 1, source FROM d
UNION SELECT tenant, source || '/' || band || '/' || leaf, 2, source || '/' || band FROM d)"""
_H = _N + """, h2 AS (SELECT tenant, source || '/' || band || '/' || leaf AS path, chunk FROM d),
h1 AS (SELECT * FROM h2 UNION ALL SELECT h2.tenant, n.up, chunk FROM h2 JOIN n USING (tenant, path) WHERE (SELECT count(*) FROM h2 x WHERE x.tenant = h2.tenant AND x.path = h2.path) < 2),
h AS (SELECT * FROM h1 UNION ALL SELECT h1.tenant, n.up, chunk FROM h1 JOIN n USING (tenant, path) WHERE depth = 1 AND (SELECT count(*) FROM h1 x WHERE x.tenant = h1.tenant AND x.path = h1.path) < 2)"""


@query(f"WITH {_N} SELECT tenant, path, depth FROM n")
def label_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d)[0].select("tenant", F.array_join("path", "/").alias("path"), "depth")


@query(f"WITH {_N} SELECT tenant, count(*) AS nodes, count(*) FILTER (depth = 0) AS roots, count(*) FILTER (depth = 2) AS leaves, max(depth) + 1 AS levels, (SELECT count(DISTINCT chunk) FROM d WHERE d.tenant = n.tenant) AS chunks FROM n GROUP BY tenant")
def tree_metrics(spark: SparkSession, d: str) -> DataFrame:
    walked, held, _ = _tree(spark, d)
    return tree.metrics(walked, held)


@query(f"WITH {_N} SELECT tenant, path, row_number() OVER (PARTITION BY tenant ORDER BY depth, path) AS place FROM n WHERE depth = 0")
def bfs_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of the roots, which come first."""
    return _tree(spark, d)[0].where("depth = 0").select("tenant", F.array_join("path", "/").alias("path"), "place")


@query(f"WITH {_N} SELECT tenant, path AS id, CASE WHEN depth = 0 THEN 'dangling' ELSE 'cycle' END AS fault FROM n WHERE split_part(path, '/', 1) = (SELECT min(source) FROM d) AND depth < 2")
def tree_faults(spark: SparkSession, d: str) -> DataFrame:
    """A tree made faulty: of one source the root's parent does not exist, so no root reaches what is below it."""
    leaves = _leaves(spark, d)
    least = leaves.agg(F.min("source")).first()[0]
    ids = lambda *c: F.concat_ws("/", *c)
    a = leaves.select("tenant", F.col("source").alias("id"), F.when(F.col("source") == least, F.lit("nobody")).alias("parent_id"))
    b = leaves.select("tenant", ids("source", "band").alias("id"), F.col("source").alias("parent_id"))
    nodes = a.union(b).distinct().withColumns({"label": F.col("id"), "kind": F.lit("x"), "ord": F.lit(0)})
    return tree.faults(nodes, tree.walk(nodes))


@query(f"WITH {_H} SELECT tenant, path, count(*) AS n_chunks FROM h GROUP BY ALL")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    walked, held, _ = _tree(spark, d)
    rolled = tree.rollup(walked, held)
    return rolled.groupBy("tenant", "id").agg(F.count("*").alias("n_chunks")).join(walked, ["tenant", "id"]).select("tenant", F.array_join("path", "/").alias("path"), "n_chunks")


@query(f"WITH {_N} SELECT tenant, path, CASE WHEN split_part(path, '/', 2) <> 'band_1' THEN 'old:' || path WHEN depth = 0 THEN 'seed:' || path ELSE 'new:' || path END AS stable_id, CASE WHEN depth = 0 THEN NULL WHEN split_part(up, '/', 2) <> 'band_1' THEN 'old:' || up ELSE 'new:' || up END AS stable_parent_id FROM n")
def merge_ids(spark: SparkSession, d: str) -> DataFrame:
    """The tree against an older one, which lacked the second band of every source."""
    walked = _tree(spark, d)[0]
    name = F.array_join("path", "/")
    named = walked.select("tenant", F.concat(F.lit("new:"), name).alias("id"), F.when(F.size("path") > 1, F.concat(F.lit("new:"), F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/"))).alias("parent_id"), "label", "kind", "path", "place")
    old = named.where((F.size("path") < 2) | (F.get("path", F.lit(1)) != "band_1")).withColumn("id", F.concat(F.lit("old:"), name))
    return tree.merged(named, old).join(named.select("tenant", "id", name.alias("path")), ["tenant", "id"]).select("tenant", "path", "stable_id", "stable_parent_id")


@query(f"WITH {_N} SELECT a.tenant, a.path, b.path AS other, CASE WHEN a.up = b.path THEN 0 WHEN a.up = b.up THEN 1 ELSE 2 END AS rank FROM n a JOIN n b ON a.tenant = b.tenant AND a.path <> b.path AND (a.up = b.path OR a.up = b.up OR a.path = b.up)")
def related_nodes(spark: SparkSession, d: str) -> DataFrame:
    walked = _tree(spark, d)[0]
    name = walked.select("tenant", "id", F.array_join("path", "/").alias("path"))
    rel = tree.related(walked, walked).join(name, ["tenant", "id"])
    return rel.join(name.select("tenant", F.col("id").alias("other"), F.col("path").alias("o")), ["tenant", "other"]).select("tenant", "path", F.col("o").alias("other"), "rank")


@query("""WITH l(label) AS (SELECT DISTINCT source || ' english text' FROM documents UNION SELECT DISTINCT source || ' german' FROM documents UNION SELECT DISTINCT source FROM documents),
r(root, ord, words) AS (VALUES ('german text', 0, ['german', 'text']), ('english text', 1, ['english', 'text']), ('a source', 2, ['a', 'source'])),
s AS (SELECT label, root, ord, len(list_filter(words, lambda w: list_contains(regexp_extract_all(lower(label), '[a-z0-9]+'), w))) AS overlap FROM l, r),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY overlap DESC, ord) AS place FROM s)
SELECT label, CASE WHEN overlap > 0 THEN root END AS root, overlap FROM t WHERE place = 1""")
def seed_parents(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select("source").distinct()
    labels = s.select(F.concat("source", F.lit(" english text")).alias("label")).union(s.select(F.concat("source", F.lit(" german")))).union(s).distinct()
    return tree.best_root(labels, spark.createDataFrame([("german text", 0), ("english text", 1), ("a source", 2)], "root string, ord int"))


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 9)"


@query(f"""WITH c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)
SELECT e.label AS node, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY {_COS} DESC, vec_id) AS place, round({_COS}, 6) AS score FROM embeddings e JOIN c ON c.label = e.label QUALIFY place <= 10""")
def page_chunk_rank(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("label").alias("node"), "vec_id", F.col("vec_id").alias("position"), F.sha2(F.col("vec_id").cast("string"), 256).alias("chunk"), "embedding")
    ranked = P.ranked_chunks(e, _centroids(spark, d).select(F.col("label").alias("node"), F.col("c").alias("centroid")))
    return ranked.select("node", "vec_id", "place", F.round("score", 6).alias("score"))


def built(spark: SparkSession, d: str) -> DataFrame:
    """All pages of all tenants' trees of length bands, with their related pages."""
    walked, held, texts = _tree(spark, d)
    walked = written(walked, "walked")
    pages = written(P.build(walked, tree.rollup(walked, held), texts, F.lit(NOW).cast("timestamp_ntz")), "pages")
    return P.with_related(pages, walked).join(walked.select("tenant", F.col("id").alias("node"), F.array_join("path", "/").alias("path")), ["tenant", "node"])


@query(f"""WITH {_H}, one AS (SELECT tenant, chunk, count(*) AS copies, max(doc_id) AS doc_id FROM d GROUP BY ALL),
p AS (SELECT tenant, path, count(*) AS n_chunks, count(DISTINCT doc_id) AS source_uri_count FROM h JOIN one USING (tenant, chunk) GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT p.*, depth, up FROM p JOIN n USING (tenant, path))
SELECT tenant, path, n_chunks, source_uri_count, 1 AS version, (SELECT count(*) FROM w b WHERE a.tenant = b.tenant AND a.path <> b.path AND (a.up = b.path OR a.up = b.up OR a.path = b.up)) AS n_related FROM w a""")
def page_build(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).select("tenant", "path", "n_chunks", "source_uri_count", "version", F.size("related").cast("long").alias("n_related"))


@query(f"""WITH {_H} SELECT tenant, path, tenant IN ('de') OR (tenant = 'fr' AND split_part(path, '/', 2) = '') AS is_stale FROM h GROUP BY tenant, path HAVING count(*) >= 2""")
def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    """One event that affects all of a tenant, and one that names the roots of another."""
    walked, held, texts = _tree(spark, d)
    pages = P.build(walked, tree.rollup(walked, held), texts, F.lit(NOW).cast("timestamp_ntz"))
    roots = walked.where("tenant = 'fr' AND depth = 0").groupBy("tenant").agg(F.collect_list("id").alias("node_ids")).withColumn("affects_all", F.lit(False))
    every = spark.createDataFrame([("de", [], True)], "tenant string, node_ids array<string>, affects_all boolean")
    stale = P.marked_stale(pages, roots.union(every))
    return stale.join(walked.select("tenant", F.col("id").alias("node"), F.array_join("path", "/").alias("path")), ["tenant", "node"]).select("tenant", "path", "is_stale")


@query(_BEST + """, t AS (SELECT d.lang AS tenant, b.source AS page_id, b.type, count(*) AS n FROM b JOIN documents d USING (doc_id) GROUP BY ALL),
f AS (SELECT tenant, page_id, type AS grp FROM t QUALIFY row_number() OVER (PARTITION BY tenant, page_id ORDER BY n DESC, type) = 1)
SELECT tenant, grp, dense_rank() OVER (PARTITION BY tenant ORDER BY lower(grp), grp) AS grp_place, page_id, row_number() OVER (PARTITION BY tenant, grp ORDER BY lower(page_id), page_id) AS place FROM f""")
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each language's sources as pages, grouped by their most frequent document type."""
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("tenant"))
    n = best_types(spark, d).join(docs, "doc_id").groupBy("tenant", F.col("source").alias("page_id"), "type").agg(F.count("*").alias("n"))
    types = n.groupBy("tenant", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))), lambda s: s["type"]).alias("doc_types"))
    return P.groups(types.withColumn("title", F.col("page_id")))


@query("""WITH c AS (SELECT vec_id AS cid, embedding AS c FROM embeddings WHERE vec_id < 8)
SELECT vec_id, cid::INT AS cluster, round(list_distance(embedding::DOUBLE[], c::DOUBLE[]) ** 2, 4) AS distance FROM embeddings, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], c::DOUBLE[]), cid) = 1""")
def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    """One assignment: the first eight vectors are the centroids."""
    e = read(spark, d, "embeddings")
    first = np.array([r.embedding for r in e.where("vec_id < 8").orderBy("vec_id").select("embedding").collect()], dtype=np.float64)
    return vectors.nearest(e, first).withColumn("distance", F.round("distance", 4))


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return vectors.kmeans(read(spark, d, "embeddings"))[0]


@query("SELECT page_id, CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 197), ' ') || '...' ELSE t END AS card FROM (SELECT page_id, html AS t FROM pages)")
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", C.summary_card(F.col("html")).alias("card"))
