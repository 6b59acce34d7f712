"""STR-1..3: incremental folder ingest with Structured Streaming.

New files in a folder are read once each (the file source's checkpoint
remembers them), every micro-batch is shaped, cleaned, typed and loaded with
the batch operators inside ``foreachBatch``, and order-sensitive steps stay
scoped to one file by the ``__file`` column.  ``available_now`` drains what is
there and stops; ``interval`` polls (STR-3).  Upsert mode (STR-2) is the batch
upsert per micro-batch.  ``foreachBatch`` may run a batch again after a crash;
append and upsert name each load after the stream and the batch, and the table's
ledger lets a named load happen once, so every row arrives exactly once.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.clean import clean
from sluice.operators.load import load
from sluice.operators.order import BLOCK, FILE, POS, number_rows
from sluice.options import CleanOptions, LoadOptions
from sluice.sources.files import _fs


def started(spark: SparkSession, checkpoint: str) -> str:
    """Text that a checkpoint keeps for all its life: a mark written on first use."""
    fs, mark = _fs(spark, f"{checkpoint.rstrip('/')}/sluice-stream")
    if not fs.exists(mark):
        out = fs.create(mark, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    stream = fs.open(mark)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def ingest_folder(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    table: str,
    checkpoint: str,
    *,
    clean_options: CleanOptions = CleanOptions(),
    load_options: LoadOptions = LoadOptions(mode="append"),
    keys: list[str] | None = None,
    delimiter: str = ",",
    header: bool = True,
    available_now: bool = True,
    interval: str = "5 seconds",
    file_glob: str = "*.csv",
):
    """Start the stream; returns the ``StreamingQuery``."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    # the checkpoint names the stream: a new one starts from the first file again
    stream = hashlib.sha1(f"{checkpoint.rstrip('/')}|{started(spark, checkpoint)}".encode()).hexdigest()[:16]
    src = (
        spark.readStream.format("csv").schema(schema)
        .option("header", str(header).lower()).option("sep", delimiter)
        .option("pathGlobFilter", file_glob).option("recursiveFileLookup", "false")
        .load(folder)
        .select(*columns,
                F.col("_metadata.file_path").alias(FILE),
                F.col("_metadata.file_block_start").alias(BLOCK))
    )

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # inside a micro-batch the frame is a plain batch scan of the new files
        numbered = number_rows(batch.withColumn(POS, F.monotonically_increasing_id()))
        cleaned = clean(numbered, clean_options)
        # the micro-batch runs in the stream's own session: use it for the
        # catalog too, so its relation cache sees the files just written
        once = load_options if load_options.mode not in {"append", "update"} else replace(load_options, load_id=f"stream-{stream}-{batch_id}")
        load(batch.sparkSession, cleaned, table, once, keys or columns[:1])

    writer = src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
