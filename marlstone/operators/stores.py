"""Stores as tables of snapshots: latest states, histories, queues, listings, query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(snapshots: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last snapshot of each key."""
    rest = [c for c in snapshots.columns if c not in keys]
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("s")).select(*keys, "s.*")


def history(snapshots: DataFrame, keys: dict[str, str], seq: str = "seq") -> DataFrame:
    for k, v in keys.items():
        snapshots = snapshots.where(F.col(k) == v)
    return snapshots.orderBy(seq)


def queued(rows: DataFrame, day: Column, name: str) -> DataFrame:
    """rows with the file name that each takes: by day and name, with a number from the second of a name on; none is overwritten."""
    place = F.row_number().over(Window.partitionBy("_day", name).orderBy("seq"))
    file = F.concat(F.col("_day"), F.lit("/"), F.col(name).cast("string"), F.when(F.col("_place") > 1, F.concat(F.lit("-"), F.col("_place").cast("string"))).otherwise(F.lit("")), F.lit(".json"))
    return rows.withColumn("_day", F.date_format(day, "yyyy-MM-dd")).withColumn("_place", place).withColumn("file", file).drop("_day", "_place")


def tail(log: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """The last ``n`` rows of a log, newest last."""
    log = log.where(F.col("event_type") == kind) if kind else log
    return log.orderBy(F.desc("id")).limit(n).orderBy("id")


def page(rows: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """(rows of a page, total); the limit is held within 1 and 500."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit))), rows.count()


def recent(queries: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Queries of people within the window, newest first."""
    return queries.where((F.col("caller") == "human") & (F.unix_micros("ts") >= F.unix_micros(now) - seconds * 1_000_000)).orderBy(F.desc("ts"))


def demand(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with the number of queries that led to it, and whether none of its queries found a page (gap)."""
    n = queries.groupBy("node").agg(F.count("*").alias("demand"), F.count(F.when(F.col("found"), 1)).alias("hits"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("demand", F.lit(0)).alias("demand"), ((F.coalesce("demand", F.lit(0)) > 0) & (F.coalesce("hits", F.lit(0)) == 0)).alias("gap"))


def threads(mails: DataFrame) -> DataFrame:
    """conversation, place and id of each mail: one conversation a sender, in order of time."""
    w = Window.partitionBy(F.lower("sender")).orderBy("ts", "id")
    return mails.select(F.lower("sender").alias("conversation"), F.row_number().over(w).alias("place"), "id")


def search_articles(articles: DataFrame, query: str, stop: tuple[str, ...] = (), most: int = 3) -> DataFrame:
    """Articles (name, tags, body, path) with points: 3, 2 and 1 for each word of the query, repeats included, in a tag, the name and the body."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w not in stop]
    tagged = lambda w: F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(w)))
    points = F.lit(0)
    for w in words:
        points = points + F.when(tagged(w), 3).otherwise(0) + F.when(F.contains(F.lower("name"), F.lit(w)), 2).otherwise(0) + F.when(F.contains(F.lower("body"), F.lit(w)), 1).otherwise(0)
    return articles.withColumn("points", points).where("points > 0").orderBy(F.desc("points"), "path").limit(most)
