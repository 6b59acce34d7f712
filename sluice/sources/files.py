"""File listing, byte samples and format probes (SRC-2, SRC-3, SRC-11, SRC-12).

Probes read a few kilobytes of one file on the driver through the Hadoop
file system, so they work for any path the cluster can read.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Supported suffixes and the encodings tried by "auto", in order.
SUPPORTED_SUFFIXES = (".csv", ".txt", ".json", ".xml", ".xlsx", ".xlsm", ".dbf")
AUTO_ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")
SNIFF_CHARS = 4096
#: Files that the driver looks at itself, and bytes of a file that a task reads whole for its first ones.
DRIVER_FILES, TASK_BYTES = 64, 4 << 20


class SourceError(ValueError):
    pass


@contextmanager
def few_listing_tasks(spark: SparkSession, paths: list[str]) -> Iterator[None]:
    """Scans of many files list them in a few tasks for each core, not in one task a file."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    if len(paths) > DRIVER_FILES:
        spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str, suffixes=SUPPORTED_SUFFIXES, *, recursive: bool = False,
               modified_after_ms: int = 0) -> list[str]:
    """SRC-11: a file, or the supported files inside a folder, sorted by name.

    ``recursive`` also walks sub-folders (DCL-1); ``modified_after_ms`` keeps
    only files changed after that time (DCL-2, e.g. the last import).
    """
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise SourceError(f"path does not exist: {path}")
    status = fs.getFileStatus(p)
    if status.isFile():
        return [status.getPath().toString()]
    out = []
    stack = [p]
    while stack:
        for st in fs.listStatus(stack.pop()):
            found = st.getPath().toString()  # every call to the JVM counts where a folder holds many files
            name = found.rsplit("/", 1)[-1]
            if name.startswith((".", "_")):
                continue
            if st.isDirectory():
                if recursive:
                    stack.append(st.getPath())
            elif name.lower().endswith(tuple(suffixes)) and (not modified_after_ms or st.getModificationTime() > modified_after_ms):
                out.append(found)
    return sorted(out, key=lambda s: (s.rsplit("/", 1)[-1], s))


def file_info(spark: SparkSession, path: str) -> tuple[int, int]:
    """(size, modification time in ms) of one file."""
    fs, p = _fs(spark, path)
    st = fs.getFileStatus(p)
    return int(st.getLen()), int(st.getModificationTime())


def read_head(spark: SparkSession, path: str, n: int = 65536) -> bytes:
    fs, p = _fs(spark, path)
    size = min(n, int(fs.getFileStatus(p).getLen()))
    stream = fs.open(p)
    try:
        # py4j hands a Java byte[] back as Python bytes
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def guess_encoding(sample: bytes, option: str = "auto") -> str:
    """Charset for a look at the first bytes (delimiter, preview): the first candidate that decodes them, a character
    cut off at the end left aside.  The charset that a file is read in comes from all its bytes (``text_probe``)."""
    for enc in AUTO_ENCODINGS if (option or "auto") == "auto" else (option,):
        for cut in range(4):
            try:
                sample[:len(sample) - cut].decode(enc)
                return enc
            except UnicodeDecodeError:
                continue
    return "latin-1"


def java_charset(enc: str) -> str:
    return {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gbk": "GBK", "gb18030": "GB18030"}.get(enc.lower(), enc)


def sniff_delimiter(text: str) -> str:
    """SRC-3: csv.Sniffer on the first 4,096 characters, comma when unsure.

    Prose in quoted cells can make the sniffer take a letter, or a space that the first line does not hold: that is unsure."""
    try:
        found = csv.Sniffer().sniff(text[:SNIFF_CHARS]).delimiter
    except csv.Error:
        return ","
    first = text.split("\n", 1)[0]
    return "," if found.isalnum() or (found == " " and " " not in first and "," in first) else found


def sniff_file(spark: SparkSession, path: str, encoding_option: str = "auto") -> str:
    """SRC-3 for one file."""
    return sniff_head(read_head(spark, path, 4 * SNIFF_CHARS), encoding_option)


def sniff_head(head: bytes, encoding_option: str = "auto") -> str:
    return sniff_delimiter(head.decode(guess_encoding(head, encoding_option), errors="ignore").removeprefix("\ufeff"))


def sniff_files(spark: SparkSession, paths: list[str], encoding_option: str = "auto") -> dict[str, str]:
    """SRC-3 for each file: many small ones by tasks, few or large ones by the driver."""
    found: dict[str, str] = {}
    if len(paths) > DRIVER_FILES:
        from sluice.session import ship_package

        ship_package(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                heads = [sniff_head(head, encoding_option) for head in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string())], ["path", "delimiter"])

        small = spark.read.format("binaryFile").load(paths).where(F.col("length") <= TASK_BYTES)
        heads = small.select("path", F.substring("content", 1, 4 * SNIFF_CHARS).alias("head"))
        found = {r["path"]: r["delimiter"] for r in heads.mapInArrow(run, "path string, delimiter string").collect()}
    rest = [p for p in paths if p not in found]
    with ThreadPoolExecutor(max_workers=16) as pool:
        found |= dict(zip(rest, pool.map(lambda p: sniff_file(spark, p, encoding_option), rest)))
    return {p: found[p] for p in paths}


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return ("." + name.rsplit(".", 1)[-1].lower()) if "." in name else ""


# ---------------------------------------------------------------- task-side I/O

def _task_fs(uri: str):
    """(filesystem, path) usable inside Python tasks: local paths directly,
    other schemes through pyarrow's file systems (HDFS, S3, GCS...)."""
    if uri.startswith("file:"):
        uri = uri[len("file:"):]
        while uri.startswith("//"):
            uri = uri[1:]
    if "://" not in uri:
        return None, uri
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(uri)


def open_read(uri: str):
    """A seekable binary reader for a file, inside or outside tasks."""
    fs, path = _task_fs(uri)
    return open(path, "rb") if fs is None else fs.open_input_file(path)


def open_write(uri: str):
    fs, path = _task_fs(uri)
    if fs is None:
        import os

        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "wb")
    return fs.open_output_stream(path)


def join_uri(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *parts])
