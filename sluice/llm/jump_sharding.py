"""Sharding by jump consistent hashing.

``jump`` maps a 64-bit key and a shard count to a shard without any table:
the key seeds a linear congruential generator whose draws say at which larger
shard counts the key would move, and the last such count below the given one
is its shard.  One more shard takes about 1/(n + 1) of the keys, all of them
into itself.

``assign_shards`` also numbers the rows of each shard without gaps, in the
order of key and tie columns: rows are range-partitioned by key (never by
shard, so no task holds a shard), counted per (part, shard), and numbered from
the prefix sums of those few counts.

Integer keys are used as they are; other types go through xxhash64.  Null keys
count as key 0.  Repeated keys share a shard, each row with its own slot.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, LongType, StructField, StructType

from sluice.llm.shared import cut

#: Fixed values of the published jump hash: multiplier of the generator, and 2 to the 31.
MULTIPLIER = 2862933555777941757
SPAN = 1 << 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key (uint64), vectorised: each round moves the keys
    whose next jump still lands below ``shards``."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        target = np.floor((shard[live] + 1).astype(np.float64) * (SPAN / draw))
        inside = target < shards
        live = live[inside]
        shard[live] = target[inside].astype(np.int64)
    return shard


def key_column(df: DataFrame, name: str) -> Column:
    column = F.col(name).cast("long") if isinstance(df.schema[name].dataType, IntegralType) else F.xxhash64(name)
    return F.coalesce(column, F.lit(0).cast("long"))


def assign_shards(df: DataFrame, key: str, shards: int, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard int, slot long, grown_shard int`` (the shard with one more shard), in place of columns of these names.

    Only pass the columns that are to be kept: rows are written once to the
    shared folder, where the numbering starts from.
    """
    df = df.drop("shard", "slot", "grown_shard")
    keep = [F.col(c) for c in df.columns]
    order = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties or []], F.col("__pos")]
    keyed = cut(df.select(*keep, key_column(df, key).alias("__key"), F.monotonically_increasing_id().alias("__pos")), "shard-keys")
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    fields = df.schema.fields
    schema = StructType([*fields, StructField("__part", IntegerType()), StructField("shard", IntegerType()),
                         StructField("__at", LongType()), StructField("grown_shard", IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column(len(fields)).to_numpy().view(np.uint64)
            shard = jump(keys, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(fields)], batch.column(len(fields) + 2), pa.array(shard, pa.int32()), pa.array(at, pa.int64()),
                 pa.array(jump(keys, shards + 1), pa.int32())], [f.name for f in schema.fields])

    placed = cut(parts.mapInArrow(number, schema), "shard-rows")
    counts = placed.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    bases = bases.withColumnRenamed("shard", "__shard").withColumnRenamed("__part", "__p")
    joined = placed.join(bases, (F.col("shard") == F.col("__shard")) & (F.col("__part") == F.col("__p")))
    return joined.select(*keep, "shard", (F.col("__base") + F.col("__at")).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, target: str, rows_per_file: int = 1_000_000) -> None:
    """Write rows that carry ``shard`` and ``slot`` as one folder per shard; a
    shard is split into blocks of slots, so it is never one task."""
    block = (F.col("slot") / rows_per_file).cast("long")
    df.withColumn("__block", block).repartition("shard", "__block").drop("__block").write.partitionBy("shard").parquet(target)
