"""Commits into a table's folder: a load owns the files it adds.

A load writes into a staging table whose folder is hidden inside the target's
(``_staging-<load>``), with the target's format, options and partitions.  Its
files are then moved in under names that carry the load's id
(``load-<id>-<number>``).  Undoing a load removes exactly these files, whatever
other writers have committed in the meantime; nothing ever compares the folder
before and after.

A *named* load happens once.  Its ledger (``_loads/<id>``) is written when
everything is done; a second load of the same name finds it and changes
nothing, and one that finds moved files without a ledger (the driver died in
between) removes these first and starts again.

Replacing files: what a load replaces moves into ``_replaced-<load>`` and is
deleted when the load is done.  If a driver dies before that, ``recover`` puts
the files back; loads that replace files do it first, so one such load at a
time may run on a table, beside any number of appends.

Folders and files whose names begin with an underscore are invisible to scans.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from sluice.sources.files import _fs

#: Formats whose tables are folders of files.
FILE_FORMATS = {"parquet", "orc", "csv", "json", "text", "avro"}
#: Renames that run at once.
MOVERS = 16
_NAME = re.compile(r"[^A-Za-z0-9_.]+")


class CommitError(ValueError):
    pass


@dataclass
class Table:
    """Where and how a catalog table keeps its rows."""

    name: str
    location: str
    provider: str
    external: bool
    partitions: list[str]
    database: str

    @property
    def is_folder(self) -> bool:
        return bool(self.location) and self.provider.lower() in FILE_FORMATS


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def describe(spark: SparkSession, table: str) -> Table:
    d = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)} AS JSON").first()[0])
    return Table(table, d.get("location", ""), d.get("provider", ""), d.get("type") == "EXTERNAL", d.get("partition_columns") or [], d.get("schema_name", "default"))


def safe_id(name: str) -> str:
    """A load's id as part of a file name."""
    return _NAME.sub(lambda m: "".join(f"-{ord(c):x}" for c in m[0]), name)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the data files below a folder, relative to it; hidden ones left out."""
    fs, root = _fs(spark, folder)
    out, stack = [], [(root, "")]
    while stack:
        at, rel = stack.pop()
        if not fs.exists(at):
            continue
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                stack.append((status.getPath(), f"{rel}{name}/"))
            else:
                out.append(rel + name)
    return sorted(out)


def move(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Rename files (full paths), several at once; a rename that does not happen raises."""
    def one(pair: tuple[str, str]) -> None:
        fs, source = _fs(spark, pair[0])
        target = spark._jvm.org.apache.hadoop.fs.Path(pair[1])
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise CommitError(f"could not move {pair[0]} to {pair[1]}")

    with ThreadPoolExecutor(max_workers=MOVERS) as pool:
        for done in [pool.submit(one, p) for p in pairs]:
            done.result()


@dataclass
class Commit:
    """One load into one table's folder."""

    spark: SparkSession
    table: Table
    load_id: str
    #: Whether a second load of this id must change nothing.
    named: bool = False
    moved: list[tuple[str, str]] = field(default_factory=list)
    replaced: list[tuple[str, str]] = field(default_factory=list)
    old_schema: T.StructType | None = None
    new_schema: T.StructType | None = None

    @property
    def root(self) -> str:
        return self.table.location.rstrip("/")

    @property
    def staging(self) -> str:
        return f"{self.root}/_staging-{self.load_id}"

    @property
    def aside(self) -> str:
        return f"{self.root}/_replaced-{self.load_id}"

    @property
    def ledger(self) -> str:
        return f"{self.root}/_loads/{self.load_id}"

    def finished(self) -> dict | None:
        """What the ledger says of an earlier load of this name; its unfinished files go."""
        if not self.named:
            return None
        fs, p = _fs(self.spark, self.ledger)
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            finally:
                stream.close()
        delete(self.spark, self.staging)
        own = f"load-{self.load_id}-"
        for f in data_files(self.spark, self.root):
            if f.rsplit("/", 1)[-1].startswith(own):
                delete(self.spark, f"{self.root}/{f}")
        return None

    def publish(self, replaced: list[str] = ()) -> None:
        """Move the staged files in and the replaced ones (relative paths) aside."""
        staged = data_files(self.spark, self.staging)
        suffix = lambda f: "." + f.rsplit("/", 1)[-1].split(".", 1)[1] if "." in f.rsplit("/", 1)[-1] else ""
        folder = lambda f: f.rsplit("/", 1)[0] + "/" if "/" in f else ""
        self.moved = [(f"{self.staging}/{f}", f"{self.root}/{folder(f)}load-{self.load_id}-{i:06d}{suffix(f)}") for i, f in enumerate(staged)]
        self.replaced = [(f"{self.root}/{f}", f"{self.aside}/{f}") for f in replaced]
        move(self.spark, self.replaced)
        move(self.spark, self.moved)
        if self.table.partitions and staged:
            self.spark.sql(f"MSCK REPAIR TABLE {quoted(self.table.name)}")
        self.spark.catalog.refreshTable(quoted(self.table.name))

    def add_columns(self, fields: list[T.StructField]) -> None:
        self.old_schema = self.spark.table(quoted(self.table.name)).schema
        have = {f.name for f in self.old_schema.fields}
        cols = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields if f.name not in have)
        if cols:
            self.spark.sql(f"ALTER TABLE {quoted(self.table.name)} ADD COLUMNS ({cols})")
        self.new_schema = self.spark.table(quoted(self.table.name)).schema

    def write_ledger(self, note: dict) -> None:
        fs, p = _fs(self.spark, self.ledger)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(note).encode()))
        finally:
            out.close()

    def finish(self, note: dict) -> None:
        """The load stands: write its ledger and delete what it replaced."""
        if self.named:
            self.write_ledger(note)
        delete(self.spark, self.aside)
        delete(self.spark, self.staging)

    def undo(self) -> None:
        """Remove the files of this load, put the replaced ones back, and take added columns away again
        (unless another writer has changed the definition or committed rows since)."""
        # a move that failed half way leaves both sides to be looked at
        for _, target in self.moved:
            delete(self.spark, target)
        back = [(aside, home) for home, aside in self.replaced if _exists(self.spark, aside)]
        move(self.spark, back)
        delete(self.spark, self.aside)
        delete(self.spark, self.staging)
        if self.old_schema is not None and self.new_schema != self.old_schema:
            self._drop_added_columns()
        self.spark.catalog.refreshTable(quoted(self.table.name))

    def _drop_added_columns(self) -> None:
        name, spark = quoted(self.table.name), self.spark
        spark.catalog.refreshTable(name)
        added = {f.name for f in self.new_schema.fields} - {f.name for f in self.old_schema.fields}
        rows = spark.table(name)
        used = rows.filter(" OR ".join(f"{quoted(c)} IS NOT NULL" for c in added))
        if rows.schema != self.new_schema or not used.isEmpty():
            return  # someone else's columns now
        old = T.StructType([f for f in self.old_schema.fields if f.name not in self.table.partitions] + [f for f in self.old_schema.fields if f.name in self.table.partitions])
        schema = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(old.json())
        spark._jsparkSession.sharedState().externalCatalog().alterTableDataSchema(self.table.database, self.table.name, schema)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def recover(spark: SparkSession, table: str) -> list[str]:
    """Undo replacements that a dead driver left half done; the ids of their loads."""
    t = describe(spark, table)
    if not t.is_folder:
        return []
    root, done = t.location.rstrip("/"), []
    fs, p = _fs(spark, root)
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if name.startswith("_replaced-"):
            load_id = name.removeprefix("_replaced-")
            own = f"load-{load_id}-"
            for f in data_files(spark, root):
                if f.rsplit("/", 1)[-1].startswith(own):
                    delete(spark, f"{root}/{f}")
            move(spark, [(f"{root}/{name}/{f}", f"{root}/{f}") for f in data_files(spark, f"{root}/{name}")])
            delete(spark, f"{root}/{name}")
            delete(spark, f"{root}/_staging-{load_id}")
            done.append(load_id)
    if done:
        spark.catalog.refreshTable(quoted(table))
    return done
