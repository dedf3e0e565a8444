"""A folder watched tick by tick: a keyed state of (uri, etag) that tells what was added, modified and deleted.

A tick lists the whole folder: rows of (tick, uri, etag), and one row with a
null uri that says that the tick has taken place, so that an empty folder is a
tick too. Ticks are numbered from 0 without gaps; tick n is second n + 1 of
the event time, as what is not after the first watermark counts as late. The state of a uri is its etag; a timer at the next tick is put off
whenever the uri is listed again, so it goes off only where it is not, and
tells of a deletion. The state lives in the query's checkpoint: a watch that
is started again goes on where it ended, and every tick counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SNAPSHOT = "tick long, uri string, etag string"
CHANGE = "uri string, tick long, kind string, etag string, prior_etag string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for the null uri of a tick's mark, whose key must not be null.
MARK = "\0tick"


class _Watched(StatefulProcessor):
    """added when a uri is first listed, modified when its etag differs, deleted when a tick passes without it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "etag string, tick long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        uri = key[0]
        if uri == MARK:
            return
        have = self.held.get() if self.held.exists() else None
        for row in sorted(rows, key=lambda r: (r.tick, r.etag)):  # a batch may hold several ticks
            if have is not None and row.tick > have[1] + 1:
                yield Row(uri=uri, tick=have[1] + 1, kind="deleted", etag=None, prior_etag=have[0])
                have = None
            if have is None:
                yield Row(uri=uri, tick=row.tick, kind="added", etag=row.etag, prior_etag=None)
            elif have[0] != row.etag and row.tick > have[1]:
                yield Row(uri=uri, tick=row.tick, kind="modified", etag=row.etag, prior_etag=have[0])
            if have is None or row.tick > have[1]:
                have = (row.etag, row.tick)
        self.held.update(have)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((have[1] + 2) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        etag, tick = self.held.get()
        self.held.clear()
        yield Row(uri=key[0], tick=tick + 1, kind="deleted", etag=None, prior_etag=etag)

    def close(self) -> None:
        pass


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks as they are written into a folder: one JSON-lines file a tick, oldest first."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).json(path)


def watched(snapshots: DataFrame) -> DataFrame:
    """The changes (see ``CHANGE``) of a stream of snapshots.

    A deletion at tick n is told when the stream has seen tick n end, which the stream's watermark says.
    """
    timed = snapshots.select("tick", F.coalesce("uri", F.lit(MARK)).alias("uri"), F.coalesce("etag", F.lit("")).alias("etag"), F.timestamp_seconds(F.col("tick") + 1).alias("at"))
    return timed.withWatermark("at", "0 seconds").groupBy("uri").transformWithState(_Watched(), CHANGE, "Append", "EventTime")


def watch(snapshots: DataFrame, out: str, checkpoint: str, drain: bool = True, seconds: int = 1) -> StreamingQuery:
    """Write the changes of each batch into a folder of its own; ``drain``: take what is there and end, else look every ``seconds``."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    writer = watched(snapshots).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{seconds} seconds")).start()


def replayed(snapshots: DataFrame) -> DataFrame:
    """The same changes from a table of all ticks: what the stream tells, tick after tick.

    A repeated row of a tick counts once, the one with the least etag; the last tick of all deletes nothing.
    """
    one = snapshots.where("uri IS NOT NULL").groupBy("uri", "tick").agg(F.min(F.coalesce("etag", F.lit(""))).alias("etag"))
    last = snapshots.agg(F.max("tick").alias("last"))
    w = Window.partitionBy("uri").orderBy("tick")
    seen = one.withColumns({"before": F.lag("tick").over(w), "was": F.lag("etag").over(w), "next": F.lead("tick").over(w)}).join(F.broadcast(last))  # one row on the right
    kind = F.when(F.col("before").isNull() | (F.col("before") < F.col("tick") - 1), "added").when(F.col("was") != F.col("etag"), "modified")
    told = seen.select("uri", "tick", kind.alias("kind"), "etag", F.when(kind == "modified", F.col("was")).alias("prior_etag")).where("kind IS NOT NULL")
    gone = seen.where((F.col("next").isNull() | (F.col("next") > F.col("tick") + 1)) & (F.col("tick") < F.col("last")))
    return told.union(gone.select("uri", (F.col("tick") + 1).alias("tick"), F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("etag"), F.col("etag").alias("prior_etag")))


def ticks(spark: SparkSession, seconds: int = 300) -> DataFrame:
    """tick and at, from a clock: a row every ``seconds``, counted from the start of the query, without catching up what a slow batch has missed."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rate.where(F.col("value") % seconds == 0).select((F.col("value") / seconds).cast("long").alias("tick"), F.col("timestamp").alias("at"))
