"""Database tables over JDBC (SRC-13, SRC-14, SRC-15, LOAD-15).

Reads are partitioned on a numeric/date column when one is given (one range
per task, ``fetchsize`` rows per round trip); Catalyst pushes filters and the
column list into the statement.  Writes go out from every partition in
``batchsize`` batches; overwrite keeps the table definition (``truncate``).
The driver jar for the database must be on the cluster's class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rows per fetch and per insert batch.
FETCH_ROWS = 5000
INSERT_BATCH = 1000


def read_table(
    spark: SparkSession, url: str, *, table: str = "", query: str = "", user: str = "", password: str = "",
    driver: str = "", partition_column: str = "", lower: int | str | None = None, upper: int | str | None = None,
    num_partitions: int = 0, fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    if bool(table) == bool(query):
        raise ValueError("give a table or a query")
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", str(fetch_rows))
    r = r.option("dbtable", table) if table else r.option("query", query)
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v:
            r = r.option(k, v)
    if partition_column:
        if table == "" or lower is None or upper is None or num_partitions <= 0:
            raise ValueError("a partitioned read needs a table, bounds and a partition count")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return r.load()


def write_table(
    df: DataFrame, url: str, table: str, *, mode: str = "append", user: str = "", password: str = "",
    driver: str = "", batch_rows: int = INSERT_BATCH, writers: int = 0,
) -> None:
    """append / overwrite (truncate, keep definition) / rebuild (drop and create)."""
    if writers:
        df = df.repartition(writers)
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(batch_rows))
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v:
            w = w.option(k, v)
    if mode == "overwrite":
        w = w.mode("overwrite").option("truncate", "true")
    elif mode == "rebuild":
        w = w.mode("overwrite").option("truncate", "false")
    else:
        w = w.mode("append")
    w.save()
