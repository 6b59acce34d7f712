"""Stable, distributed row order (the central design problem).

Rows are read in file order.  Spark's readers give no line numbers, but every
row knows its file and the start of the file block (split) it came from, and a
block is read by exactly one task, front to back.  So:

* ``__pos``: ``monotonically_increasing_id()`` taken right after the scan (and
  after any row-deleting filter), in the scan stage: dense and increasing inside
  a block.
* a per-block table ``(file, block, n, first_pos)`` - one row per split, so its
  size is bounded by input bytes / split size - gives running offsets per file.
* ``__rn = offset(block) + (__pos - first_pos) + 1`` is the 1-based row number
  inside the file, with **no shuffle of the data and no global window**.

The per-block table is materialized with ``checkpoint()`` into the shared
checkpoint folder and joined back by broadcast only when its row count is under
``BROADCAST_MAX_ROWS``; above that a shuffle join is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import ensure_checkpoint_dir

FILE = "__file"
BLOCK = "__blk"
POS = "__pos"
RN = "__rn"
LB = "__lb"
HIDDEN = (FILE, BLOCK, POS, RN, LB)

# Logical blocks: consecutive row-number ranges of one file.  Order-sensitive
# steps (fill-down, renumbering) group by (file, logical block), so a group is
# bounded whatever the physical layout (one huge row group, one huge file) and
# there are enough groups to keep every core busy.
MIN_BLOCK_ROWS = 10_000
MAX_BLOCK_ROWS = 10_000_000

# Broadcast bounds for side tables, both measured before a broadcast.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20


def visible_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def with_source_order(df: DataFrame) -> DataFrame:
    """Attach file, block and in-block position to a freshly scanned file DataFrame.

    Must be applied directly on top of the scan (and its filters), before any
    exchange, so positions follow the file.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != "_metadata"]
    return df.select(
        *keep,
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POS),
    )


def renumber_in_scan_order(df: DataFrame) -> DataFrame:
    """Replace ``__pos`` after a row-deleting filter so it is dense again.

    Valid only when nothing between the scan and here moved rows between tasks.
    """
    return df.withColumn(POS, F.monotonically_increasing_id())


def bounded_side(side: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, int]:
    """Materialize a small side table and decide whether it may be broadcast.

    Returns the (checkpointed) table, hinted for broadcast only when its rows
    and bytes are measured to be within the bounds, and its row count.
    """
    side, n, _ = _measured(side, max_rows, F.lit(0))
    return side, n


def _measured(side: DataFrame, max_rows: int, total: Column) -> tuple[DataFrame, int, int]:
    ensure_checkpoint_dir(side.sparkSession)
    side = side.checkpoint(eager=True)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in side.columns])))
    row = side.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.sum(total).alias("t")).first()
    small = row["n"] <= max_rows and (row["b"] or 0) <= BROADCAST_MAX_BYTES
    return (F.broadcast(side) if small else side), int(row["n"]), int(row["t"] or 0)


def bounded_side_with_total(side: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, int, int]:
    """``bounded_side`` for the per-block table, also returning its row total
    (one small job for both numbers)."""
    return _measured(side, max_rows, F.col("__n"))


def block_stats(df: DataFrame, extra_aggs: list[Column] | None = None) -> DataFrame:  # noqa: D401
    """One row per (file, block): rows, first position, running offset and file total."""
    aggs = [F.count(F.lit(1)).alias("__n"), F.min(POS).alias("__first")]
    stats = df.groupBy(FILE, BLOCK).agg(*aggs, *(extra_aggs or []))
    per_file = Window.partitionBy(FILE).orderBy(BLOCK)
    return stats.select(
        "*",
        F.coalesce(
            F.sum("__n").over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
        F.sum("__n").over(Window.partitionBy(FILE)).alias("__total"),
    )


def logical_block_rows(spark, total_rows: int) -> int:
    """Rows per logical block: about four blocks per core, within fixed bounds."""
    cores = max(int(spark.sparkContext.defaultParallelism), 1)
    return int(min(max(-(-total_rows // (4 * cores)), MIN_BLOCK_ROWS), MAX_BLOCK_ROWS))


def number_rows(df: DataFrame, keep_total: bool = False) -> DataFrame:
    """Add ``__rn`` (1-based row number within the file) and ``__lb`` (its
    logical block) without moving data.

    ``df`` must carry ``__file``, ``__blk`` and a dense in-block ``__pos``.
    With ``keep_total`` the file's row count is kept as ``__total``.
    """
    return number_rows_with_heads(df, keep_total)[0]


def number_rows_with_heads(df: DataFrame, keep_total: bool = False, head_cols: list[str] | None = None):
    """``number_rows`` that also returns the first row of every file, taken
    in the same pass that counts the blocks (no extra scan for headers)."""
    extra = []
    if head_cols:
        extra = [F.min_by(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in head_cols]), F.col(POS)).alias("__head")]
    stats, n_blocks, total = bounded_side_with_total(block_stats(df, extra))
    heads = {}
    if head_cols:
        first = Window.partitionBy(FILE).orderBy(BLOCK)
        for r in (stats.where(F.col("__n") > 0).select(FILE, F.first("__head").over(first).alias("__h"))
                  .distinct().collect()):
            heads[r[FILE]] = list(r["__h"])
        stats = stats.drop("__head")
    size = logical_block_rows(df.sparkSession, total)
    cols = ["__off", "__first"] + (["__total"] if keep_total else [])
    joined = df.join(stats.select(FILE, BLOCK, *cols), [FILE, BLOCK], "inner")
    out = joined.withColumn(RN, F.col("__off") + (F.col(POS) - F.col("__first")) + F.lit(1))
    out = out.withColumn(LB, F.floor((F.col(RN) - 1) / F.lit(size)).cast("long"))
    return spread(out.drop("__off", "__first"), n_blocks), heads


def balance(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores when the input is too small to be
    split for them (a single row group, a few files) and the next step is heavy
    per row.  The optimizer's size estimate decides, so nothing is run for it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size // split >= cores else df.repartition(cores)


def spread(df: DataFrame, n_blocks: int) -> DataFrame:
    """Co-locate logical blocks (hash on file and block) when the input has
    fewer splits than there are cores; a later window over (file, block) then needs
    no further exchange.  Large inputs keep their scan partitioning."""
    if n_blocks >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(FILE, LB)


def renumber_survivors(df: DataFrame) -> DataFrame:
    """Dense 1-based ``__rn`` per file over rows that survived a filter or a
    de-duplication, keeping their original order.

    Logical blocks are bounded row ranges, so the in-block window is a shuffle
    into evenly sized groups; offsets come from the small per-block table.
    Row numbers stay dense but logical blocks keep their original ranges.
    """
    stats = df.groupBy(FILE, LB).agg(F.count(F.lit(1)).alias("__n"))
    per_file = Window.partitionBy(FILE).orderBy(LB)
    stats = stats.select(
        FILE, LB,
        F.coalesce(
            F.sum("__n").over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    stats, _ = bounded_side(stats)
    in_block = Window.partitionBy(FILE, LB).orderBy(RN)
    ranked = df.withColumn("__i", F.row_number().over(in_block))
    return (
        ranked.join(stats, [FILE, LB], "inner")
        .withColumn(RN, F.col("__off") + F.col("__i"))
        .drop("__off", "__i")
    )


def table_order(df: DataFrame) -> DataFrame:
    """Source order for a table read from parquet/ORC files: the file row order.

    Same machinery as for delimited files; ``_metadata`` must be available,
    i.e. ``df`` is a fresh file scan.
    """
    return number_rows(with_source_order(df))
