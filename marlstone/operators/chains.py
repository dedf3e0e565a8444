"""Hash chains of audit rows: each row's hash covers the one before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import width

GENESIS = "0" * 64


def row_hash(ts_ns: Column, event_type: Column, payload: Column, prev: Column) -> Column:
    """Hash of a row; ``payload`` is JSON with sorted keys and no blanks, the rest is put around it in the same form."""
    quoted = lambda c: F.to_json(F.array(c))
    name = quoted(event_type)
    text = F.concat(
        F.lit('{"event_type":'), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(',"payload":'), payload, F.lit(',"prev_hash":"'), prev, F.lit('","ts_ns":'), ts_ns.cast("string"), F.lit("}"),
    )
    return F.sha2(text, 256)


def linked(rows: DataFrame, chain: str = "chain") -> DataFrame:
    """rows (chain, id, ts_ns, event_type, payload) with prev_hash and this_hash.

    A chain is sequential; rows are streamed in order of chain and id with one
    hash at hand, so a long chain takes time but no memory.
    """
    head = rows.withColumn("_head", F.concat(F.lit('{"event_type":'), F.expr("substring(to_json(array(event_type)), 2, length(to_json(array(event_type))) - 2)"), F.lit(',"payload":'), F.col("payload"), F.lit(',"prev_hash":"')))
    dealt = head.select(chain, "id", "ts_ns", "event_type", "payload", "_head").repartition(width(rows.sparkSession), F.col(chain)).sortWithinPartitions(chain, "id")
    kind = rows.schema[chain].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prev = None, GENESIS
        for batch in batches:
            before, own = [], []
            for c, ts, head in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                prev = GENESIS if c != last or last is None else prev
                last = c
                before.append(prev)
                prev = hashlib.sha256(f'{head}{prev}","ts_ns":{ts}}}'.encode()).hexdigest()
                own.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*batch.schema.names[:5], "prev_hash", "this_hash"])

    return dealt.mapInArrow(run, f"{chain} {kind}, id long, ts_ns long, event_type string, payload string, prev_hash string, this_hash string")


def verified(rows: DataFrame, chain: str = "chain") -> DataFrame:
    """chain, rows and the first bad row (bad_id, fault: link or hash; both null for a sound chain)."""
    before = F.lag("this_hash", 1, GENESIS).over(Window.partitionBy(chain).orderBy("id"))
    fault = F.when(F.col("prev_hash") != F.col("_before"), "link").when(F.col("this_hash") != row_hash(F.col("ts_ns"), F.col("event_type"), F.col("payload"), F.col("prev_hash")), "hash")
    judged = rows.withColumn("_before", before).select(chain, "id", fault.alias("fault"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("id", "fault")))
    return judged.groupBy(chain).agg(F.count("*").alias("rows"), first.alias("f")).select(chain, "rows", F.col("f.id").alias("bad_id"), "f.fault")
