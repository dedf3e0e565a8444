"""Wiki pages from a tree's nodes and their chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marlstone.functions import columns as C
from marlstone.operators import tree
from marlstone.session import written

TOP_CHUNKS, SNIPPET, EXCERPT, TOP_TYPES = 10, 240, 200, 5
# fixed values: the sentences of a summary, and the parts of a body
TOPIC, BUILT_FROM, HEAD = "This page summarises the topic '%s'.", "It was built from %s source chunks across %s distinct documents.", "Representative excerpt: %s."
CLOSING = (
    "The chunks under this node share a common theme as identified by the ontology inducer; readers can drill into individual citations via the search tool. "
    "This summary is generated deterministically by the test stub writer and reflects the shape of the production LLM output without calling the network. Content fingerprint: %s."
)
NO_TOPICS = "_No related topics._"
_EDGES = r"(?U)^\s+|\s+$"


def ranked_chunks(chunks: DataFrame, centroids: DataFrame, most: int = TOP_CHUNKS) -> DataFrame:
    """The first chunks of each node by falling cosine to its centroid, then position, then hash.

    chunks: node, chunk, position, embedding. centroids: node, centroid; a node without one keeps the order of positions.
    """
    score = F.when(F.col("centroid").isNotNull() & (F.size("centroid") == F.size("embedding")), F.round(C.cosine(F.col("embedding"), F.col("centroid")), 9)).otherwise(F.lit(0.0))
    scored = chunks.join(centroids, "node", "left").withColumn("score", score)
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "position", "chunk"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


def title(label: Column) -> Column:
    """Words of a label, those in lower case with a capital; ``Untitled`` without any."""
    clean = F.trim(F.regexp_replace(label, "[_-]", " "))
    words = F.split(F.when(clean == "", F.lit("untitled")).otherwise(clean), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.when((w == F.lower(w)) & (w != F.upper(w)), F.initcap(w)).otherwise(w)), " ")


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """A text on one line, cut to ``most`` characters."""
    flat = F.replace(F.regexp_replace(text, _EDGES, ""), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.left(flat, F.lit(most - 3)), r"(?U)\s+$", ""), F.lit("..."))).otherwise(flat)


@F.pandas_udf(StringType())
def quoted(text: pd.Series) -> pd.Series:
    """The first line of a text, cut and written as a quoted literal. One text a page."""
    return text.map(lambda t: repr(((t or "").strip().splitlines() or [""])[0][:EXCERPT]))


def predominant(full: DataFrame, types: DataFrame, most: int = TOP_TYPES) -> DataFrame:
    """tenant, id and doc_types: the most frequent types of a node's different documents, ties in order of the alphabet.

    full: tenant, id, document. types: document, type.
    """
    one = types.groupBy("document").agg(F.min("type").alias("type"))
    n = full.select("tenant", "id", "document").distinct().join(one, "document").groupBy("tenant", "id", "type").agg(F.count("*").alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("tenant", "id").orderBy(F.desc("n"), "type"))).where(F.col("place") <= most)
    return top.groupBy("tenant", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "type"))), lambda s: s["type"]).alias("doc_types"))


def _said(sentence: str, *values: Column) -> Column:
    return F.format_string(sentence, *values)


def build(walked: DataFrame, held: DataFrame, chunks: DataFrame, now: Column, least: int = 2, centroids: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """A page for each node of ``least`` chunks or more, those handed up to it included.

    held: tenant, id, chunk (see ``tree.rollup``). chunks: tenant, chunk, position, source, text, and embedding and
    document where centroids and types are given; of several with one hash the last stands for all. centroids: tenant,
    id, centroid. types: document, type. Chunks rank by falling cosine to the node's centroid, then position, then
    hash; a node without a centroid keeps the order of positions. Ranks are found without the texts, which join the
    first ten of a node only.
    """
    vector = F.col("embedding").cast("array<double>") if centroids is not None else F.lit(None).cast("array<double>")
    document = F.col("document") if types is not None else F.lit(None).cast("string")
    light = chunks.select("tenant", "chunk", "position", "source", document.alias("document"), vector.alias("embedding"))
    one = light.groupBy("tenant", "chunk").agg(F.max_by(F.struct("position", "source", "document", "embedding"), F.struct("position", "source")).alias("c")).select("tenant", "chunk", "c.*")
    full = held.select("tenant", "id", "chunk").join(one, ["tenant", "chunk"])
    if centroids is None:
        scored = full.withColumn("score", F.lit(0.0))
    else:
        like = F.when(F.size("centroid") == F.size("embedding"), F.round(C.cosine(F.col("embedding"), F.col("centroid")), 9))
        scored = full.join(centroids.select("tenant", "id", "centroid"), ["tenant", "id"], "left").withColumn("score", F.coalesce(like, F.lit(0.0)))
    scored = scored.select("tenant", "id", "chunk", "position", "source", "score")
    place = F.row_number().over(Window.partitionBy("tenant", "id").orderBy(F.desc("score"), "position", "chunk"))
    top = scored.withColumn("place", place).where(F.col("place") <= TOP_CHUNKS)
    wanted = chunks.join(top.select("tenant", "chunk").distinct(), ["tenant", "chunk"], "left_semi")
    texts = wanted.groupBy("tenant", "chunk").agg(F.max_by("text", F.struct("position", "source")).alias("text"))
    top = top.join(texts, ["tenant", "chunk"])
    first = F.max(F.when(F.col("place") == 1, F.col("text"))).alias("first")
    shown = F.array_sort(F.collect_list(F.struct("place", "chunk", "source", snippet(F.col("text")).alias("snippet"))))  # TOP_CHUNKS at most
    tops = top.groupBy("tenant", "id").agg(first, shown.alias("top"), F.countDistinct("source").alias("top_sources"))
    counts = full.groupBy("tenant", "id").agg(F.count("*").alias("n_chunks"), F.countDistinct("source").alias("source_uri_count")).where(F.col("n_chunks") >= least)
    page = counts.join(tops, ["tenant", "id"]).join(walked.select("tenant", "id", "label"), ["tenant", "id"])
    page = page.join(predominant(full, types), ["tenant", "id"], "left") if types is not None else page.withColumn("doc_types", F.lit(None).cast("array<string>"))
    page = page.withColumn("doc_types", F.coalesce("doc_types", F.array().cast("array<string>")))
    page = tree.with_kin(page, walked)
    label_of = lambda c: F.transform(c, lambda s: s["label"])
    page = page.withColumn("topics", F.array_distinct(F.filter(F.concat(label_of("children"), label_of("siblings")), lambda x: x != "")))
    mark = F.substring(F.sha2(F.array_join(F.transform("top", lambda t: t["chunk"]), "|"), 256), 1, 16)
    summary = F.concat_ws(
        " ", _said(TOPIC, F.col("label")), _said(BUILT_FROM, F.size("top").cast("string"), F.col("top_sources").cast("string")),
        _said(HEAD, quoted(F.col("first"))), _said(CLOSING, mark),
    )
    page = page.withColumn("summary", summary)
    documents = F.transform("top", lambda t: F.concat(t["place"].cast("string"), F.lit(". ["), t["source"], F.lit("]("), t["source"], F.lit(")\n   > "), t["snippet"]))
    topics = F.when(F.size("topics") > 0, F.array_join(F.transform("topics", lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(NO_TOPICS))
    facts = F.concat_ws(
        "\n", F.concat(F.lit("- Source documents: "), F.col("source_uri_count").cast("string")), F.concat(F.lit("- Total chunks: "), F.col("n_chunks").cast("string")),
        F.concat(F.lit("- Last updated: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
        F.when(F.size("doc_types") > 0, F.concat(F.lit("- Predominant document types: "), F.array_join("doc_types", ", "))),
    )
    parts = (("Overview", F.col("summary")), ("Key documents", F.array_join(documents, "\n")), ("Related topics", topics), ("Metadata", facts))
    body = F.concat(F.concat_ws("\n\n", *[F.concat(F.lit(f"## {name}\n\n"), text) for name, text in parts]), F.lit("\n"))
    name = title(F.col("label"))
    return page.select(
        "tenant", C.page_id(F.col("tenant"), F.col("id")).alias("page_id"), F.col("id").alias("node"), name.alias("title"), C.slugify(name).alias("slug"), "summary", body.alias("body"),
        "n_chunks", "source_uri_count", "doc_types", now.alias("updated_at"), F.lit(False).alias("is_stale"), F.lit(1).alias("version"),
    )


def with_related(pages: DataFrame, walked: DataFrame) -> DataFrame:
    """pages with related: page ids of the node's parent, siblings and children that have pages, in that order."""
    made = pages.select("tenant", F.col("node").alias("id"))
    kin = tree.with_kin(made, walked, made)
    up = made.select("tenant", F.col("id").alias("parent_id"), F.array("id").alias("up"))
    kin = kin.join(up, ["tenant", "parent_id"], "left")
    ids = lambda c: F.transform(c, lambda s: s["id"])
    others = F.concat(F.coalesce("up", F.array().cast("array<string>")), ids("siblings"), ids("children"))
    lists = kin.select("tenant", F.col("id").alias("node"), F.array_distinct(F.transform(others, lambda x: C.page_id(F.col("tenant"), x))).alias("related"))
    return pages.join(lists, ["tenant", "node"])


def upserted(store: DataFrame, pages: DataFrame) -> DataFrame:
    """The store after a build: a page of a known (tenant, page_id) takes its place with the next version, others are added."""
    known = store.select("tenant", "page_id", F.col("version").alias("_old")).dropDuplicates(["tenant", "page_id"])
    new = pages.join(known, ["tenant", "page_id"], "left").withColumn("version", F.coalesce(F.col("_old") + 1, F.col("version"))).select(store.columns)
    return store.join(pages, ["tenant", "page_id"], "left_anti").select(store.columns).union(new)


def marked_stale(pages: DataFrame, events: DataFrame) -> DataFrame:
    """pages with is_stale set where an event of the tenant affects all or names the node.

    events: tenant, node_ids, affects_all. Applying them twice changes nothing.
    """
    every = events.where("affects_all").select("tenant").distinct().withColumn("_all", F.lit(True))
    some = events.select("tenant", F.explode("node_ids").alias("node")).distinct().withColumn("_one", F.lit(True))
    hit = pages.join(every, "tenant", "left").join(some, ["tenant", "node"], "left")
    return hit.withColumn("is_stale", F.col("is_stale") | F.coalesce("_all", F.lit(False)) | F.coalesce("_one", F.lit(False))).select(pages.columns)


def gaps(queries: DataFrame, since: Column, least: int = 3, covered: int = 1) -> DataFrame:
    """Staleness events (tenant, node_ids, affects_all) for nodes that people keep asking about without an answer.

    queries: tenant, node, ts and hits (passages that the node's page gave). A node of ``least`` or more queries since
    then with fewer hits than ``covered`` is one; its events are a tenant's, and a query without a node asks for none.
    """
    open_ = queries.where(F.col("node").isNotNull() & (F.col("ts") >= since) & (F.coalesce("hits", F.lit(0)) < covered))
    often = open_.groupBy("tenant", "node").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.select("tenant", F.array("node").alias("node_ids"), F.lit(False).alias("affects_all"))


def served(pages: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(a tenant's pages as they are, stale ones included and marked; the nodes to rebuild behind them)."""
    own = pages.where(F.col("tenant") == tenant)
    return own, own.where("is_stale").select("tenant", "node")


def rebuilt(
    store: DataFrame, walked: DataFrame, members: DataFrame, chunks: DataFrame, changed: DataFrame, now: Column, least: int = 2, centroids: DataFrame | None = None, types: DataFrame | None = None,
) -> DataFrame:
    """The store after the nodes in ``changed`` (tenant, id) have other chunks: what a full build would give, at the cost of the part.

    Small nodes hand chunks up, so a change reaches all nodes above; those and the changed ones are built again, from
    the members of their trees alone, and take the next version. A page whose node has too few chunks now is gone. All
    other pages stay as they are, but for the related ids of pages in the same trees.
    """
    touched = walked.join(changed.select("tenant", "id").distinct(), ["tenant", "id"], "left_semi").select("tenant", "root").distinct()
    part = written(walked.join(touched, ["tenant", "root"], "left_semi").select(walked.columns), "part")
    again = written(tree.with_ancestors(part, changed), "again")
    ids = part.select("tenant", "id")
    held = tree.rollup(part, members.join(ids, ["tenant", "id"], "left_semi"), least).join(again, ["tenant", "id"], "left_semi")
    fresh = build(part, held, chunks, now, least, centroids, types)
    node = again.select("tenant", F.col("id").alias("node"))
    old = store.join(node, ["tenant", "node"], "left_semi").select("tenant", "page_id", F.col("version").alias("_old")).dropDuplicates(["tenant", "page_id"])
    fresh = fresh.join(old, ["tenant", "page_id"], "left").withColumn("version", F.coalesce(F.col("_old") + 1, F.col("version")))
    kept = store.join(node, ["tenant", "node"], "left_anti")
    near = ids.select("tenant", F.col("id").alias("node"))
    plain = [c for c in store.columns if c != "related"]
    linked = written(kept.join(near, ["tenant", "node"], "left_semi").select(plain).unionByName(fresh.select(plain)), "linked")
    return kept.join(near, ["tenant", "node"], "left_anti").unionByName(with_related(linked, part).select(store.columns))


def groups(pages: DataFrame) -> DataFrame:
    """tenant, grp, grp_place, place and page_id: pages by their first document type, ``Uncategorized`` without one; groups by name, pages by title, whatever their case."""
    grp = F.coalesce(F.get("doc_types", F.lit(0)), F.lit("Uncategorized"))
    w = Window.partitionBy("tenant", "grp").orderBy(F.lower("title"), "page_id")
    return pages.withColumn("grp", grp).withColumn("place", F.row_number().over(w)).withColumn("grp_place", F.dense_rank().over(Window.partitionBy("tenant").orderBy(F.lower("grp"), "grp"))).select("tenant", "grp", "grp_place", "place", "page_id")


def related_cards(pages: DataFrame) -> DataFrame:
    """tenant, page_id, place, slug and title of the pages that each page refers to, in order; ids without a page are left out."""
    asked = pages.select("tenant", "page_id", F.posexplode("related").alias("i", "other"))
    cards = pages.select("tenant", F.col("page_id").alias("other"), "slug", "title")
    met = asked.join(cards, ["tenant", "other"])
    place = F.row_number().over(Window.partitionBy("tenant", "page_id").orderBy("i"))
    return met.select("tenant", "page_id", place.alias("place"), "slug", "title")


def searched(pages: DataFrame, asked: str) -> DataFrame:
    """pages whose title or summary holds what is asked for, whatever its case, with their place in the tenant's list; a blank question finds none."""
    low = asked.strip().lower()
    hit = F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("summary"), F.lit(low)) if low else F.lit(False)
    return pages.where(hit).withColumn("place", F.row_number().over(Window.partitionBy("tenant").orderBy(F.lower("title"), "page_id")))


def listed(pages: DataFrame, tenant: str, slug: str | None = None, node: str | None = None) -> DataFrame:
    """Pages of a tenant by slug, or else by node; one of the two must be given."""
    if slug is None and node is None:
        raise ValueError("slug or node")
    own = pages.where(F.col("tenant") == tenant)
    return own.where(F.col("slug") == slug) if slug is not None else own.where(F.col("node") == node)
