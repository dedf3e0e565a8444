"""Ontology induction: from clustered chunks to a tree of topics.

Chunks: tenant, chunk (hash), text, embedding and cluster (null: in none). A
cluster gets its mean vector and a label; clusters whose means are alike form
communities. A tenant whose texts hold enough signal words starts from the
seed taxonomy: seeds, below them a category a community, below it a topic a
cluster; seeds without a category are pruned after the categories are
attached. Any other tenant has a root a community, and topics below it.

Every step is a table of all tenants. Tables of clusters have one row a
cluster; what grows with the chunks is counted by key and never sorted whole.

Defined cases: a chunk without an embedding counts for the label and the
members, not for the mean; a cluster without any embedding has no mean and is
a community of its own; a cluster without words is labelled by its number;
without seeds every tenant takes the other path; a label that shares no word
with a seed goes to the first seed; no chunk, no node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import graph, tree, vectors
from marlstone.session import written

# fixed values: words that show that the seed taxonomy suits a tenant, and words that name nothing
SIGNALS = (
    "rfi", "submittal", "spec", "specification", "contract", "drawing", "transmittal", "engineering", "construction", "calculation", "design", "discipline",
    "civil", "structural", "mechanical", "electrical", "subcontract", "amendment",
)
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "these", "those", "have", "has", "are", "was", "were", "been", "being", "any", "all", "but", "not", "you", "your",
    "our", "their", "its", "they", "them", "his", "her", "him", "she", "she's", "he's", "will", "would", "could", "should", "may", "might", "must", "into", "onto", "of", "to",
    "in", "on", "at", "by", "as", "is", "be", "or", "an", "a", "it", "if", "so", "we", "us", "do", "did", "does", "doing", "done", "i", "me", "my", "mine",
)
LEAST_SIGNALS, ALIKE, SURE = 3, 0.85, 0.5
NODE = "tenant string, id string, parent_id string, label string, kind string, ord long, confidence double, centroid array<double>"


def words(text: Column) -> Column:
    """Words of two or more ASCII letters and digits that begin with a letter, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]+)"))


def seeded(chunks: DataFrame, signals: Sequence[str] = SIGNALS, least: int = LEAST_SIGNALS) -> DataFrame:
    """tenant and seeded: whether ``least`` different signal words occur in its texts."""
    hits = chunks.select("tenant", F.explode(F.array_intersect(words(F.col("text")), F.array(*[F.lit(s) for s in signals]))).alias("word"))
    n = hits.groupBy("tenant", "word").agg(F.lit(1).alias("one")).groupBy("tenant").agg(F.sum("one").alias("n"))
    return chunks.select("tenant").distinct().join(n, "tenant", "left").select("tenant", (F.coalesce("n", F.lit(0)) >= least).alias("seeded"))


def labels(chunks: DataFrame, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """tenant, cluster, label and confidence: the two most frequent words of a cluster, ties in order of the alphabet."""
    some = chunks.where("cluster IS NOT NULL")
    found = some.select("tenant", "cluster", F.explode(words(F.col("text"))).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*stop))
    n = found.groupBy("tenant", "cluster", "word").agg(F.count("*").alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("tenant", "cluster").orderBy(F.desc("n"), "word"))).where("place <= 2")
    told = top.groupBy("tenant", "cluster").agg(F.max(F.when(F.col("place") == 1, F.col("word"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("word"))).alias("b"))
    number = F.col("cluster").cast("string")
    every = some.select("tenant", "cluster").distinct().join(told, ["tenant", "cluster"], "left")
    return every.select("tenant", "cluster", F.concat_ws("_", F.lit("cluster"), F.coalesce("a", number), "b").alias("label"), F.lit(SURE).alias("confidence"))


def label_answer(answer: Column) -> Column:
    """struct<label, confidence> of a model's answer: its first brace to its last, read as JSON; null without a label."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    j = F.from_json(F.when(body != "", body), "label string, confidence string")
    label = F.regexp_replace(j["label"], r"(?U)^\s+|\s+$", "")
    sure = C.clamp01(F.coalesce(j["confidence"].try_cast("double"), F.lit(SURE)))
    return F.when(label != "", F.struct(label.alias("label"), sure.alias("confidence")))


def excerpts(chunks: DataFrame, most: int = 5, length: int = 600) -> DataFrame:
    """tenant, cluster and prompt: the first chunks of each cluster by position, cut to ``length``, as a model is asked for a label."""
    place = F.row_number().over(Window.partitionBy("tenant", "cluster").orderBy("position", "chunk"))
    first = chunks.where("cluster IS NOT NULL").withColumn("place", place).where(F.col("place") <= most)
    text = F.replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("\n\n\n"), F.lit("\n\n"))
    cut = F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)
    line = F.struct("place", F.concat(F.lit("[doc "), F.col("place").cast("string"), F.lit("] "), cut).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])  # ``most`` at most
    told = F.concat(F.lit("Cluster excerpts:\n\n"), F.array_join(lines, "\n\n"), F.lit("\n\nReturn the JSON object now."))
    return first.groupBy("tenant", "cluster").agg(told.alias("prompt"))


def communities(means: DataFrame, alike: float = ALIKE) -> DataFrame:
    """tenant, cluster, community (numbered from 0 by the least cluster) and first, that cluster.

    Two clusters of a tenant are joined if the cosine of their means reaches
    ``alike``. There are as many pairs as chunks, as k is the root of their number.
    """
    # a range-ordered table, so that the ids go up with (tenant, cluster)
    c = written(means.select("tenant", "cluster", "centroid").orderBy("tenant", "cluster").withColumn("node", F.monotonically_increasing_id()), "means")
    x, y = c.alias("x"), c.alias("y")
    edges = x.join(y, (F.col("x.tenant") == F.col("y.tenant")) & (F.col("x.node") < F.col("y.node")) & (C.cosine(F.col("x.centroid"), F.col("y.centroid")) >= alike))
    found = graph.components(edges.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).withColumnRenamed("label", "least")
    placed = c.join(found, "node", "left").select("tenant", "cluster", "node", F.coalesce("least", "node").alias("least"))
    number = F.dense_rank().over(Window.partitionBy("tenant").orderBy("least")) - 1  # one row a cluster
    firsts = c.select(F.col("node").alias("least"), F.col("cluster").alias("first"))
    return placed.withColumn("community", number.cast("long")).join(firsts, "least").select("tenant", "cluster", "community", "first")


def best_seed(wanted: DataFrame, seeds: DataFrame) -> DataFrame:
    """label and name of the seed that shares most words with it, its id's words included; ties and strangers go to the first.

    Met by words, so that no pair without a common word is made. ``seeds`` (name, label, ord) is a taxonomy's short list.
    """
    word = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9]+)")))
    have = wanted.select("label").distinct()
    known = seeds.select("name", "ord", F.explode(F.array_union(word(F.col("label")), word(F.concat(F.lit("seed:"), F.col("name"))))).alias("word"))
    n = have.select("label", F.explode(word(F.col("label"))).alias("word")).join(known, "word").groupBy("label", "name", "ord").agg(F.count("*").alias("n"))
    top = n.groupBy("label").agg(F.max_by("name", F.struct("n", (-F.col("ord")).alias("o"))).alias("name"))
    first = seeds.agg(F.min_by("name", "ord").alias("first"))
    return have.join(top, "label", "left").join(F.broadcast(first)).select("label", F.coalesce("name", "first").alias("name"))  # one row on the right


def assemble(named: DataFrame, means: DataFrame, grouped: DataFrame, starts: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """The nodes of every tenant's tree (see ``NODE``).

    named: tenant, cluster, label, confidence. means: tenant, cluster, centroid. grouped: see ``communities``.
    starts: see ``seeded``. seeds: name, label, ord.
    """
    long = F.col("cluster").cast("long")
    primary = named.select("tenant", F.col("cluster").alias("first"), "label", "confidence")
    middle = vectors.means(grouped.join(means, ["tenant", "cluster"]).withColumnRenamed("centroid", "embedding"), ["tenant", "community"])
    comm = grouped.select("tenant", "community", "first").distinct().join(primary, ["tenant", "first"]).join(middle, ["tenant", "community"], "left").join(starts, "tenant")
    comm = written(comm.select("tenant", "community", "label", "confidence", "centroid", "seeded"), "communities")
    leaf = named.join(means, ["tenant", "cluster"], "left").join(grouped.select("tenant", "cluster", "community"), ["tenant", "cluster"])
    above = comm.select("tenant", "community", "seeded", F.col("label").alias("up"))
    kind = F.when(F.col("seeded"), "category").otherwise("root")
    topics = leaf.join(above, ["tenant", "community"]).select(
        "tenant", tree.node_id(F.lit("topic"), F.col("label"), long).alias("id"), tree.node_id(kind, F.col("up"), F.col("community")).alias("parent_id"),
        "label", F.lit("induced").alias("kind"), long.alias("ord"), "confidence", "centroid",
    )
    none = F.lit(None).cast("string")
    own = tree.node_id(kind, F.col("label"), F.col("community")).alias("id")
    shape = ["label", F.lit("induced").alias("kind"), F.col("community").alias("ord"), "confidence", "centroid"]
    roots = comm.where("NOT seeded").select("tenant", own, none.alias("parent_id"), *shape)
    if seeds is None:
        return roots.union(topics)
    seeded_ = comm.where("seeded")
    parents = seeded_.join(best_seed(seeded_, seeds), "label")
    categories = parents.select("tenant", own, F.concat(F.lit("seed:"), F.col("name")).alias("parent_id"), *shape)
    used = parents.select("tenant", "name").distinct()  # seeds that no category refers to are not there
    tops = used.join(seeds, "name").select(
        "tenant", F.concat(F.lit("seed:"), F.col("name")).alias("id"), none.alias("parent_id"), "label", F.lit("seed").alias("kind"), F.col("ord").cast("long").alias("ord"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("array<double>").alias("centroid"),
    )
    return tops.union(roots).union(categories).union(topics)


def members(chunks: DataFrame, named: DataFrame) -> DataFrame:
    """tenant, id (of the topic) and chunk: one row for each chunk row of a cluster."""
    topic = named.select("tenant", "cluster", tree.node_id(F.lit("topic"), F.col("label"), F.col("cluster").cast("long")).alias("id"))
    return chunks.where("cluster IS NOT NULL").select("tenant", "cluster", "chunk").join(topic, ["tenant", "cluster"]).select("tenant", "id", "chunk")


def induce(
    chunks: DataFrame, seeds: DataFrame | None = None, answers: DataFrame | None = None, signals: Sequence[str] = SIGNALS, least_signals: int = LEAST_SIGNALS,
    alike: float = ALIKE, stop: Sequence[str] = STOP_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the trees of all tenants; both are written tables.

    answers: tenant, cluster and answer, a model's reply that names the cluster; a cluster without a readable one keeps its words.
    """
    named = labels(chunks, stop)
    if answers is not None:
        told = answers.select("tenant", "cluster", label_answer(F.col("answer")).alias("told"))
        named = named.join(told, ["tenant", "cluster"], "left").select("tenant", "cluster", F.coalesce("told.label", "label").alias("label"), F.coalesce("told.confidence", "confidence").alias("confidence"))
    named = written(named, "labels")
    mean = vectors.means(chunks.where("cluster IS NOT NULL"), ["tenant", "cluster"])
    mean = written(named.select("tenant", "cluster").join(mean, ["tenant", "cluster"], "left"), "centroids")
    starts = seeded(chunks, signals, least_signals)
    starts = starts if seeds is not None else starts.withColumn("seeded", F.lit(False))
    nodes = written(assemble(named, mean, written(communities(mean, alike), "grouped"), written(starts, "starts"), seeds), "nodes")
    return nodes, written(members(chunks, named), "members")
