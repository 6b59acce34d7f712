"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder every lineage cut goes to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sluice") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is named by the deployment and is read from the
    session.  Only when it is unset (local tests) a private scratch folder is
    taken, so lineage cuts still go through ``checkpoint()`` and never through
    ``localCheckpoint``.  A cluster without the setting is refused: its executors
    would not see a folder of the driver's machine.
    """
    ship_package(spark)
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not current:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="sluice-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends there, and so do the optimizer's size
    estimates, which iterated joins would multiply without end."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/sluice-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sluice`` importable in executor Python workers (Arrow-batched
    steps and the Python data sources run there): zip the package once per
    application and hand it to ``addPyFile``, Spark's own distribution path."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sluice-pkg-"), "sluice.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.join("sluice", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(app)
