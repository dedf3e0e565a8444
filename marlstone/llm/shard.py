"""Sharding: a hierarchical weighted hash tree.

Every document descends region, rack and shard. At each level each child
draws ``-ln(u) / weight`` with ``u`` from a hash of the document and the
child's name, and the least draw wins: a child is chosen in proportion to its
weight, and a change of one child's weight moves documents only to or from
it. A shard that is added opens a region of its own, so that the only weights
that change are on the path to the new shard and documents move only there.

Which shard a document has depends on its doc_id and the tree alone. Slots
are gapless within a shard: documents are numbered within buckets of a hash,
and a prefix sum over the (shard, bucket) counts, whose number is set by a
parameter, turns those numbers into slots.

Defined cases: a null text counts as empty (size 1); a null doc_id is hashed
as the word "null"; repeated rows get the same shard and slots of their own;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.tables import table
from marlstone.session import width


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n: int, regions: int = 2, racks: int = 2, base: int = 8) -> tuple[Shard, ...]:
    """``base`` shards spread over regions and racks; each later one in a region of its own.

    From ``base`` on, one more shard takes rows only into itself. A service
    that starts with fewer shards names that number and keeps it.
    """
    if n < base:
        raise ValueError(f"a tree of {n} shards starts with {n} at most, not {base}")
    per = max(1, base // (regions * racks))
    out = []
    for s in range(n):
        if s < base:
            rack = min(s // per, regions * racks - 1)
            out.append(Shard(f"g{rack // racks}", f"g{rack // racks}k{rack % racks}", s))
        else:
            out.append(Shard(f"x{s}", f"x{s}k0", s))
    return tuple(out)


def _draw(key: Column, name: str, weight: float) -> Column:
    """``-ln(u) / weight``; u is in (0, 1), from 52 bits of a hash of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _choose(options: list[tuple[str, float]], key: Column) -> Column:
    """Name of the option with the least draw, ties to the first name."""
    if len(options) == 1:
        return F.lit(options[0][0])
    return F.least(*[F.struct(_draw(key, o, w).alias("d"), F.lit(o).alias("o")) for o, w in options])["o"]


def place(shards: tuple[Shard, ...], key: Column) -> Column:
    """The shard of a document with this key (a string column)."""
    by: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        by.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weigh = lambda racks: sum(s.weight for r in racks.values() for s in r)
    region = _choose([(g, weigh(racks)) for g, racks in sorted(by.items())], key)
    out = F.lit(None).cast("string")
    for g, racks in by.items():
        rack = _choose([(r, sum(s.weight for s in own)) for r, own in sorted(racks.items())], key)
        inner = F.lit(None).cast("string")
        for r, own in racks.items():
            inner = F.when(rack == r, _choose([(f"s{s.shard}", s.weight) for s in own], key)).otherwise(inner)
        out = F.when(region == g, inner).otherwise(out)
    return F.substring(out, 2, 10).cast("int")


def assign(docs: DataFrame, shards: int = 8, buckets: int | None = None, base: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    base: the number of shards at the start (see ``tree``); a corpus that began with fewer names it, here and at every growth.
    """
    n = buckets or max(16, width(docs.sparkSession))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(tree(shards, base=base), key).alias("shard"),
        place(tree(shards + 1, base=base), key).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    # shards x buckets rows: bounded by the parameters, whatever the documents
    small = F.broadcast(offsets) if shards * n <= 1_000_000 else offsets
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(small, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), "grown_shard",
        )
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_shard": op8}
