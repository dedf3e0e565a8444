"""More queries on the driver tables: sums, ranks, budgets, sets and stub embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.stub_embedding import stub_embedding
from marlstone.plans.queries import _BEST, best_types, query, read
from marlstone.streaming import watch

SINCE = "2024-01-10 00:00:00"
TOKENS = ("de", "a", "wiki")
BUDGET = 400
MARK = "..."


@query(f"SELECT event_type, coalesce(sum(CASE WHEN ts >= TIMESTAMP '{SINCE}' THEN json_extract_string(props, '$.k')::DOUBLE END), 0) AS total FROM events GROUP BY event_type")
def json_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sum of a JSON field from a moment on; 0 for a type without such rows."""
    value = F.when(F.col("ts") >= F.lit(SINCE).cast("timestamp_ntz"), F.get_json_object("props", "$.k").cast("double"))
    return read(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


@query(_BEST + " SELECT source, type, count(DISTINCT doc_id) AS n, row_number() OVER (PARTITION BY source ORDER BY count(DISTINCT doc_id) DESC, type) AS place FROM b GROUP BY source, type QUALIFY place <= 5")
def doc_type_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent document types of each source."""
    n = best_types(spark, d).select("source", "type", "doc_id").distinct().groupBy("source", "type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "type"))).where("place <= 5")


_POINTS = " + ".join(f"(CASE WHEN lang = '{t}' THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(source), '{t}') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END)" for t in TOKENS)


@query(f"SELECT doc_id, score FROM (SELECT doc_id, ({_POINTS})::BIGINT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 3")
def kb_search(spark: SparkSession, d: str) -> DataFrame:
    """Top 3 articles: 3 points a token for a tag, 2 for the name, 1 for the body."""
    docs, points = read(spark, d, "documents"), F.lit(0)
    for t in TOKENS:
        for n, hit in ((3, F.col("lang") == t), (2, F.contains(F.lower("source"), F.lit(t))), (1, F.contains(F.lower("text"), F.lit(t)))):
            points = points + F.when(hit, n).otherwise(0)
    return docs.select("doc_id", points.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(3)


@query(f"""WITH r AS (SELECT conv_id, turn, text, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS upto FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN upto <= {BUDGET} THEN text ELSE substr(text, 1, ({BUDGET} - (upto - length(text) - 2))::BIGINT) || '{MARK}' END AS block, upto > {BUDGET} AS cut FROM r WHERE upto - length(text) - 2 < {BUDGET}""")
def budgeted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns while they and two separators fit the budget; the first beyond is cut, then it ends."""
    upto = F.sum(F.length("text") + 2).over(Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0))
    c = read(spark, d, "conversations").where("text IS NOT NULL").withColumn("upto", upto)
    before = F.col("upto") - F.length("text") - 2
    block = F.when(F.col("upto") <= BUDGET, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), (F.lit(BUDGET) - before).cast("int")), F.lit(MARK)))
    return c.where(before < BUDGET).select("conv_id", "turn", block.alias("block"), (F.col("upto") > BUDGET).alias("cut"))


@query("SELECT user_id, coalesce(max(CASE WHEN place = 2 THEN value END), 0) AS second FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS place FROM events) GROUP BY user_id")
def second_highest(spark: SparkSession, d: str) -> DataFrame:
    """The second value of each user, duplicates counted; 0 where there is only one."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value")))
    two = read(spark, d, "events").select("user_id", "value", place.alias("place")).where("place <= 2")
    return two.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("place") == 2, F.col("value"))), F.lit(0.0)).alias("second"))


@query("SELECT p_brand, max(p_partkey) AS latest, max(p_partkey) + 1 AS next FROM part GROUP BY p_brand")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Highest number of each name, and the next one."""
    return read(spark, d, "part").groupBy("p_brand").agg(F.max("p_partkey").alias("latest"), (F.max("p_partkey") + 1).alias("next"))


_SETS = "SELECT conv_id, {0} AS s FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS w, role FROM conversations) WHERE role = '{1}' AND w <> '' GROUP BY conv_id"


@query(
    f"WITH u AS ({_SETS.format('list(DISTINCT w)', 'user')}), a AS ({_SETS.format('list(DISTINCT w)', 'assistant')}) "
    "SELECT conv_id, round(CASE WHEN u.s IS NULL OR a.s IS NULL THEN 0 ELSE len(list_intersect(u.s, a.s)) / (len(u.s) + len(a.s) - len(list_intersect(u.s, a.s)))::DOUBLE END, 6) AS score FROM u FULL JOIN a USING (conv_id)"
)
def role_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of the words of both roles of a conversation; 0 if either has none."""
    w = read(spark, d, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "role", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    each = w.groupBy("conv_id", "w").agg(F.countDistinct("role").alias("n"))
    return each.groupBy("conv_id").agg(F.round(F.count_if(F.col("n") == 2) / F.count("*"), 6).alias("score"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang <> 'fr') EXCEPT SELECT doc_id FROM documents WHERE lang <> 'es'")
def snapshot_gone(spark: SparkSession, d: str) -> DataFrame:
    """Ids that an earlier snapshot has and the present one lacks."""
    docs = read(spark, d, "documents")
    return docs.where("lang <> 'fr'").select("doc_id").distinct().join(docs.where("lang <> 'es'").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, sum(l_quantity) AS quantity, count(DISTINCT l_partkey) AS parts FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct parts under each customer, as distinct sources under a node."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    found = read(spark, d, "customer").select("c_custkey").join(o, "c_custkey").join(read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    return found.groupBy("c_custkey").agg(F.sum("l_quantity").alias("quantity"), F.countDistinct("l_partkey").alias("parts"))


_DIGEST = "sha256(encode(text) || unhex(lpad(printf('%x', k), 4, '0')))"


@query(f"SELECT doc_id, count(*) AS dims, round(sum(x), 6) AS total, round(max(CASE WHEN k = 127 AND j = 7 THEN x END), 9) AS last FROM (SELECT doc_id, k, j, (('0x' || substr(h, 8 * j + 1, 8))::UBIGINT)::DOUBLE / 4294967295.0 * 2 - 1 AS x FROM (SELECT doc_id, k, {_DIGEST} AS h FROM documents, range(128) t(k)), range(8) u(j)) GROUP BY doc_id")
def stub_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Size, sum and last value of each document's stub embedding."""
    e = read(spark, d, "documents").select("doc_id", stub_embedding(F.col("text")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return e.select("doc_id", F.size("e").cast("long").alias("dims"), F.round(total, 6).alias("total"), F.round(F.element_at("e", -1), 9).alias("last"))


@query("""WITH s AS (SELECT user_id::VARCHAR AS uri, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, count(*)::VARCHAR AS etag FROM events WHERE event_type <> 'view' GROUP BY ALL),
t AS (SELECT uri, etag, day - min(day) OVER () AS tick FROM s), l AS (SELECT max(tick) AS last FROM t),
c AS (SELECT coalesce(n.uri, p.uri) AS uri, coalesce(n.tick, p.tick + 1) AS tick, CASE WHEN p.uri IS NULL THEN 'added' WHEN n.uri IS NULL THEN 'deleted' WHEN n.etag <> p.etag THEN 'modified' END AS kind, n.etag AS etag, p.etag AS prior_etag
  FROM t n FULL JOIN t p ON n.uri = p.uri AND n.tick = p.tick + 1)
SELECT uri, tick, kind, etag, prior_etag FROM c, l WHERE kind IS NOT NULL AND tick <= last""")
def change_ticks(spark: SparkSession, d: str) -> DataFrame:
    """A day is a tick and lists the users with an event that is no view; the number of such events is the etag."""
    e = read(spark, d, "events").where("event_type <> 'view'")
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    s = e.groupBy(F.col("user_id").cast("string").alias("uri"), day.alias("day")).agg(F.count("*").cast("string").alias("etag"))
    first = s.agg(F.min("day").alias("first"))
    t = s.join(F.broadcast(first)).select((F.col("day") - F.col("first")).alias("tick"), "uri", "etag")  # one row on the right
    return watch.replayed(t).select("uri", "tick", "kind", "etag", "prior_etag")
