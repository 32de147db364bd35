"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) has a hash u in (0, 1) and a score -weight / ln(u); a record goes to the shard of its
highest score. A further shard takes only the records on which it wins and moves no other; a shard's expected
share is its weight over the sum of weights. Nothing is looked up: the key and the list of weights decide.

Nulls: a null key is a key of its own; a null text has no bytes. Repeated rows share a shard and take slots of
their own. Equal scores go to the smaller shard. Very long texts are read once, for their
size and checksum, and never shuffled. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def rendezvous_score(key: Column, shard: Column, weight: Column, seed: int = 7) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -weight / F.ln(u)


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 7) -> Column:
    """The shard of a key: the highest score, ties to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    array = F.array(*[F.lit(float(w)) for w in weights])
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)),
            lambda s: F.struct(rendezvous_score(key, s, F.element_at(array, s + 1), seed).alias("score"), (-s).alias("minus")),
        )
    )
    return (-best["minus"]).cast("int")


def with_slots(df: DataFrame, group: str, ident: Sequence[str], slot: str = "slot", buckets: int = 256) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, with no task holding a whole group.

    Equal rows are counted before they are shuffled. A group's distinct rows fall into `buckets` parts by the
    hash of `ident`; part sizes give each part's first slot, a window inside the part gives the rest. The table
    of part sizes has at most groups x buckets rows, whatever the input. Runs of equal rows expand at the end,
    in chunks that are dealt out again, so that one run can't fill a task.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.pmod(F.xxhash64(*ident), F.lit(buckets)))
    sizes = counted.groupBy(group, "_part").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in ident]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(first, [group, "_part"])
    chunk = 100_000
    return (
        numbered.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
        .withColumn("_k", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + chunk, F.col("_n")) - 1)))
        .withColumn(slot, F.col("_first") + F.col("_before") + F.col("_k"))
        .select(*df.columns, slot)
    )


def shard_documents(documents: DataFrame, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with a further shard of grown_weight, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = keyed.withColumn("shard", rendezvous_shard(F.col("doc_id"), weights))
    n, key = len(weights), F.col("doc_id")
    if grown_weight:
        array = F.array(*[F.lit(float(w)) for w in weights])
        held = rendezvous_score(key, F.col("shard"), F.element_at(array, F.col("shard") + 1))
        keyed = keyed.withColumn("grown_shard", F.when(rendezvous_score(key, F.lit(n), F.lit(float(grown_weight))) > held, n).otherwise(F.col("shard")).cast("int"))
    return with_slots(keyed, "shard", ["doc_id", "size", "text_crc32"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), [1.0] * 40, 1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
