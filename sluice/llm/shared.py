"""Shared-folder helpers: intermediate tables and plain files.

Everything an operator must keep between jobs goes under the folder that the
session names in ``spark.checkpoint.dir``; drivers and executors all see it.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from sluice.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sluice-llm/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage ends there, so a lost executor never recomputes what lies above."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a folder and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def publish(files: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file into place.  A repeated task attempt writes the
    same bytes, so whichever attempt comes last may stand."""
    try:
        files.move(temporary, final)
    except OSError:
        if files.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        files.delete_file(temporary)
