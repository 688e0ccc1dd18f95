"""Sharding by weighted rendezvous hashing: each record goes to the shard that scores highest for its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each shard's slots are numbered in so many parts, so that no task numbers a whole shard.
SALTS = 256


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) with the highest weight / -ln(u), u in (0, 1) hashed from key and shard.

    Whether a shard wins depends only on the key, so a new shard takes records only into itself and a removed one gives
    away only its own. A null key has a shard like any other.
    """
    u = lambda j: (F.shiftrightunsigned(F.xxhash64(key, F.lit(j)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    scores = [F.struct((F.lit(float(w)) / -F.log(u(j))).alias("score"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size (text bytes + 16), text_crc32, shard, slot (0, 1, ... within the shard), grown_shard (one more shard).

    Null texts count as empty; repeated rows share a shard and have slots of their own; rows without a doc_id all go to
    one shard; empty tables give no rows; other columns are ignored. Slots are numbered in SALTS parts per shard, each
    starting after the counts of those before it: a table of SALTS rows per shard, whatever the input, is broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    part = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(SALTS)).cast("int")
    keyed = docs.select(key.alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, new_weight]).alias("grown_shard"), part.alias("part"))
    counts = docs.select(rendezvous(key, weights).alias("shard"), part.alias("part")).groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "bytes"))
    return keyed.withColumn("place", place).join(F.broadcast(bases), ["shard", "part"]).select(
        "doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", "shard", (F.col("base") + F.col("place") - 1).alias("slot"), "grown_shard"
    )
