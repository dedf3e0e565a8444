"""Trees of labelled nodes: walks, checks, rollup of small nodes, merge with an older tree, relations.

Nodes: tenant, id, parent_id (null: a root), label, kind, ord (place among
its siblings). What belongs to a node (chunks) is a table of its own. Each
level of a walk is one join and one written table; no tree goes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written


def node_id(kind: Column, label: Column, number: Column) -> Column:
    """``ind:kind:`` and 12 hex digits of what names the node."""
    return F.concat(F.lit("ind:"), kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", kind, label, number.cast("string")).cast("binary")), 1, 12))


def walk(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """nodes that a root reaches, with depth, root, path (labels from the root on) and place (breadth-first).

    A tree deeper than ``most_depth`` is an error, not a shorter answer.
    """
    own = nodes.select("tenant", "id", "parent_id", "label", "kind", "ord")
    level = written(own.where("parent_id IS NULL").withColumns({"depth": F.lit(0), "root": F.col("id"), "path": F.array("label"), "ords": F.array(F.struct("ord", "id"))}), "level")
    levels = []
    while not level.isEmpty():
        if len(levels) > most_depth:
            raise ValueError(f"a tree deeper than {most_depth}")
        levels.append(level)
        up = level.select("tenant", F.col("id").alias("parent_id"), F.col("depth").alias("d"), "root", F.col("path").alias("p"), F.col("ords").alias("o"))
        below = own.join(up, ["tenant", "parent_id"]).select(
            "tenant", "id", "parent_id", "label", "kind", "ord", (F.col("d") + 1).alias("depth"), "root",
            F.concat("p", F.array("label")).alias("path"), F.concat("o", F.array(F.struct("ord", "id"))).alias("ords"),
        )
        level = written(below, "level")
    found = reduce(DataFrame.union, levels) if levels else level
    place = F.row_number().over(Window.partitionBy("tenant").orderBy("depth", "ords"))
    return found.withColumn("place", place).drop("ords")


def with_ancestors(walked: DataFrame, some: DataFrame) -> DataFrame:
    """tenant and id of ``some`` nodes and of all nodes above them; a level a step."""
    level = some.select("tenant", "id").distinct().join(walked.select("tenant", "id", "parent_id", "depth"), ["tenant", "id"])
    level = written(level, "level")
    found = [level]
    for _ in range(level.agg(F.max("depth")).first()[0] or 0):
        above = level.where("parent_id IS NOT NULL").select("tenant", F.col("parent_id").alias("id")).distinct()
        level = written(above.join(walked.select("tenant", "id", "parent_id", "depth"), ["tenant", "id"]), "level")
        found.append(level)
    return reduce(DataFrame.union, found).select("tenant", "id").distinct()


def faults(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """tenant, id and fault of nodes that break the tree: duplicate, dangling (no such parent) or cycle (no root reaches them)."""
    twice = nodes.groupBy("tenant", "id").agg(F.count("*").alias("n")).where("n > 1").select("tenant", "id", F.lit("duplicate").alias("fault"))
    parents = nodes.select("tenant", F.col("id").alias("parent_id")).distinct()
    dangling = nodes.where("parent_id IS NOT NULL").join(parents, ["tenant", "parent_id"], "left_anti").select("tenant", "id", F.lit("dangling").alias("fault"))
    lost = nodes.join(walked, ["tenant", "id"], "left_anti").join(dangling, ["tenant", "id"], "left_anti").select("tenant", "id", F.lit("cycle").alias("fault"))
    return twice.union(dangling).union(lost)


def metrics(walked: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a tenant: nodes, roots, leaves, depth (levels) and distinct chunks."""
    parents = walked.where("parent_id IS NOT NULL").select("tenant", F.col("parent_id").alias("id")).distinct().withColumn("inner", F.lit(1))
    shape = walked.join(parents, ["tenant", "id"], "left").groupBy("tenant").agg(
        F.count("*").alias("nodes"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("roots"),
        F.count(F.when(F.col("inner").isNull(), 1)).alias("leaves"), (F.max("depth") + 1).alias("levels"),
    )
    held = chunks.groupBy("tenant").agg(F.countDistinct("chunk").alias("chunks"))
    return shape.join(held, "tenant", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def rollup(walked: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """(tenant, id, chunk) with the chunks that small nodes hand up.

    From the deepest level on, a node of fewer than ``least`` chunks, its own
    and those handed to it, gives all to its parent and keeps its list.
    """
    deepest = walked.agg(F.max("depth")).first()[0] or 0
    held = written(chunks.select("tenant", "id", "chunk"), "held")
    for depth in range(deepest, 0, -1):
        level = walked.where(F.col("depth") == depth).select("tenant", "id", "parent_id")
        small = level.join(held.groupBy("tenant", "id").agg(F.count("*").alias("n")), ["tenant", "id"], "left").where(F.coalesce("n", F.lit(0)) < least)
        up = held.join(small.select("tenant", "id", "parent_id"), ["tenant", "id"]).select("tenant", F.col("parent_id").alias("id"), "chunk")
        held = written(held.union(up), "held")
    return held


def merged(new: DataFrame, old: DataFrame) -> DataFrame:
    """tenant, id (of the new tree) and stable_id, stable_parent_id.

    A node whose label path stands in the old tree takes that id, the first
    one breadth-first; a seed node takes ``seed:label``; others keep theirs.
    """
    first = old.groupBy("tenant", "path").agg(F.min_by("id", "place").alias("old_id"))
    seed = F.when(F.col("kind") == "seed", F.concat(F.lit("seed:"), F.col("label")))
    to = new.join(first, ["tenant", "path"], "left").select("tenant", "id", "parent_id", F.coalesce("old_id", seed, "id").alias("stable_id"))
    up = to.select("tenant", F.col("id").alias("parent_id"), F.col("stable_id").alias("stable_parent_id"))
    return to.join(up, ["tenant", "parent_id"], "left").select("tenant", "id", "stable_id", "stable_parent_id")


def child_lists(walked: DataFrame) -> DataFrame:
    """tenant, parent and kids: one list a parent, in tree order, of struct<place, id, label>."""
    kid = F.struct("place", "id", "label")
    return walked.where("parent_id IS NOT NULL").groupBy("tenant", F.col("parent_id").alias("parent")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))


def with_kin(nodes: DataFrame, walked: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """nodes (tenant, id) with parent_id, siblings and children: the lists of ``child_lists``, the node itself left out.

    ``listed``: (tenant, id) of the nodes that the lists may hold; all of them without it. A list is made once a parent
    and joined to its children by key: no pair of siblings is made on the way.
    """
    some = walked if listed is None else walked.join(listed.select("tenant", "id").distinct(), ["tenant", "id"], "left_semi")
    lists = child_lists(some)
    own = nodes.join(walked.select("tenant", "id", "parent_id"), ["tenant", "id"])
    above = lists.select("tenant", F.col("parent").alias("parent_id"), F.col("kids").alias("siblings"))
    below = lists.select("tenant", F.col("parent").alias("id"), F.col("kids").alias("children"))
    none = F.array().cast("array<struct<place: int, id: string, label: string>>")
    met = own.join(above, ["tenant", "parent_id"], "left").join(below, ["tenant", "id"], "left")
    return met.withColumns({"siblings": F.filter(F.coalesce("siblings", none), lambda s: s["id"] != F.col("id")), "children": F.coalesce("children", none)})


def related(walked: DataFrame, made: DataFrame) -> DataFrame:
    """tenant, id, other and rank: parent (0), siblings (1) and children (2) among the ``made`` nodes, in tree order."""
    kin = with_kin(walked.select("tenant", "id"), walked, made)
    up = kin.join(made.select("tenant", F.col("id").alias("parent_id")).distinct(), ["tenant", "parent_id"], "left_semi").select("tenant", "id", F.col("parent_id").alias("other"), F.lit(0).alias("rank"))
    lists = lambda name, rank: kin.select("tenant", "id", F.explode(name).alias("s")).select("tenant", "id", F.col("s.id").alias("other"), F.lit(rank).alias("rank"))
    return up.union(lists("siblings", 1)).union(lists("children", 2))


def best_root(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """label, root and overlap: the root that shares most words with a label, ties to the first; null without any.

    ``roots`` (root, ord) is the seed taxonomy's short list; it is exploded by word, so that no pair without a common word is made.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)")))
    have = labels.select("label", F.explode(words("label")).alias("word"))
    want = roots.select("root", "ord", F.explode(words("root")).alias("word"))
    n = have.join(want, "word").groupBy("label", "root", "ord").agg(F.count("*").alias("overlap"))
    top = n.groupBy("label").agg(F.max(F.struct("overlap", (-F.col("ord")).alias("o"), "root")).alias("t"))
    return labels.select("label").distinct().join(top, "label", "left").select("label", "t.root", F.coalesce("t.overlap", F.lit(0)).alias("overlap"))
