"""Streams: change feeds of folders, the collector, stale pages, spending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import pages as P
from marlstone.sources.files import OBSERVATION


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """uri, kind (added, modified, deleted), etag and prior_etag between two scans."""
    a, b = before.select("uri", F.col("etag").alias("prior_etag")), now.select("uri", "etag")
    kind = F.when(F.col("prior_etag").isNull(), "added").when(F.col("etag").isNull(), "deleted").when(F.col("etag") != F.col("prior_etag"), "modified")
    return a.join(b, "uri", "full_outer").withColumn("kind", kind).where("kind IS NOT NULL").select("uri", "kind", "etag", "prior_etag")


def observation_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """New JSON-lines files of a folder as a stream; how much one batch takes is bounded."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_a_batch).json(path)


def collect(stream: DataFrame, judged: Callable[[DataFrame], DataFrame], accepted: str, audit: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Judge each batch (columns outcome and reason) and write what is accepted and an audit row for what is not.

    Each batch has a folder of its own that is written anew, so a batch that
    is run twice leaves the same rows. ``drain``: take what is there and end.
    """
    def one(batch: DataFrame, number: int) -> None:
        told = judged(batch)
        told.where("outcome = 'accepted'").drop("outcome", "reason").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        told.where("outcome <> 'accepted'").select(
            F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload_hash"), F.coalesce("reason", "outcome").alias("reason_code"), F.col("outcome").alias("stage"), F.col("observed_at").alias("timestamp"),
        ).write.mode("overwrite").parquet(f"{audit}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="10 seconds")).start()


def stale_stream(events: DataFrame, pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """For each batch of staleness events, the pages that they make stale; the same event twice adds no other page."""
    def one(batch: DataFrame, number: int) -> None:
        hit = P.marked_stale(pages.where("NOT is_stale"), batch).where("is_stale")
        hit.select("tenant", "node").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spend_stream(purchases: DataFrame, days: int = 1, late: str = "1 hour") -> DataFrame:
    """Sum of value a tenant in windows of ``days`` that slide by an hour; later rows than ``late`` are left out."""
    w = F.window("ts", f"{days} days", "1 hour")
    return purchases.withWatermark("ts", late).groupBy("tenant", w).agg(F.sum("value").alias("spent")).select("tenant", F.col("window.end").alias("until"), "spent")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a tenant's events with no pause longer than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("tenant", w).agg(F.count("*").alias("n")).select("tenant", F.col("session_window.start").alias("start"), "n")
