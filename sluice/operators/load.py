"""Loading into catalog tables (LOAD-1..10, LOAD-15).

Modes: append (create if absent, insert by name, schema evolution), overwrite
(keep the definition, replace the rows), rebuild (drop and recreate with
inferred types) and update (upsert on null-safe match keys).

Upsert without MERGE (plain file tables refuse it): the source is reduced to its
last row per key (``max_by`` aggregates map-side, so a hot key costs one row per
task).  The target's key columns are joined to the reduced keys, which gives the
keys that exist and the files that hold them.  Only those files are written
again; all others stay where they are.  A reduced source of bounded size is
broadcast, so the target is not shuffled at all; beyond that, its keys and then
the rows of the touched files are, once each.  Keys are converted to the table's
types before the reduction, so text ``1`` and ``01`` are one bigint key; rows are
ordered by (file, row number).

Publishing.  Append and update commit files that carry the load's id
(``commit.py``); a load with ``load_id`` happens once.  Rebuild and overwrite
write a staging table, verify its count, rename the old table to a backup and the
staging table into its place, run the caller's ``after`` hook, and only then drop
the backup and its folder; the next load of a table completes a swap that a dead
driver left.  Whatever fails on the way is undone: the old table stands as it
was, its columns too, and so do rows that others have committed meanwhile.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.commit import Commit, delete, describe, recover, safe_id
from sluice.operators.order import FILE, RN, bounded_side, visible_columns
from sluice.operators.types import cast_columns, infer_types
from sluice.options import LoadOptions


class LoadError(ValueError):
    pass


@dataclass
class LoadResult:
    table: str
    mode: str
    rows_written: int = 0
    rows_inserted: int = 0
    rows_updated: int = 0
    rows_skipped: int = 0
    verified_rows: int | None = None
    elapsed_ms: int = 0
    replayed: bool = False      # a named load that had happened before
    failed: dict[str, str] | None = None  # files that were left out, with the reason


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def table_columns(spark: SparkSession, table: str) -> list[T.StructField]:
    return list(spark.table(q(table)).schema.fields)


def choose_table_name(spark: SparkSession, table: str, policy: str) -> str | None:
    """LOAD-6 (append only): same, skip (None), or suffix ``_2``, ``_3``..."""
    if policy == "skip":
        return None if table_exists(spark, table) else table
    if policy == "suffix":
        name, n = table, 1
        while table_exists(spark, name):
            n += 1
            name = f"{table}_{n}"
        return name
    return table


def evolved_fields(spark: SparkSession, table: str, df: DataFrame, types: dict[str, T.DataType], allow: bool) -> list[T.StructField]:
    """LOAD-5: the table's columns, and those the input has beyond them (or a refusal)."""
    fields = table_columns(spark, table)
    missing = [c for c in df.columns if c not in {f.name for f in fields}]
    if missing and not allow:
        raise LoadError(f"target table lacks columns: {', '.join(missing)}")
    return fields + [T.StructField(c, types.get(c, T.StringType())) for c in missing]


def add_columns(spark: SparkSession, table: str, fields: list[T.StructField]) -> None:
    have = {f.name for f in table_columns(spark, table)}
    cols = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in fields if f.name not in have)
    if cols:
        spark.sql(f"ALTER TABLE {q(table)} ADD COLUMNS ({cols})")


def convert(c, src_type: T.DataType, dst_type: T.DataType):
    """Input value to a table column's type: text is parsed leniently (bad or
    empty -> null, as TYP-2), other types are cast."""
    if src_type == dst_type:
        return c
    if isinstance(src_type, T.StringType) and not isinstance(dst_type, T.StringType):
        return F.regexp_replace(c, "^\\+", "").try_cast(dst_type)
    return c.try_cast(dst_type)


def align(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Input in the given column order and types; absent columns as null."""
    return df.select(*[
        (convert(F.col(q(f.name)), df.schema[f.name].dataType, f.dataType) if f.name in df.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def _write_new(df: DataFrame, table: str, fmt: str, path: str) -> None:
    w = df.write.format(fmt).mode("overwrite")
    (w.option("path", path) if path else w).saveAsTable(table)


def _location(path: str) -> str:
    return f" LOCATION '{path}'" if path else ""


def _write_like(spark: SparkSession, df: DataFrame, staging: str, table: str, fields: list[T.StructField], path: str) -> None:
    """Write ``df`` into a new table of ``table``'s definition, with added columns."""
    spark.sql(f"CREATE TABLE {q(staging)} LIKE {q(table)}{_location(path)}")
    add_columns(spark, staging, fields)
    df.write.insertInto(staging)


def _drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {q(table)}")


def _drop_with_folder(spark: SparkSession, table: str, base: str) -> None:
    """Drop a replaced or failed table of ``base`` and, where this module made it, the folder that an external table leaves behind."""
    if not table_exists(spark, table):
        return
    known = describe(spark, table)
    _drop(spark, table)
    folder = known.location.rstrip("/").rsplit("/", 1)[-1]
    if known.external and (folder == base or folder.startswith(f"{base}__data_")):
        delete(spark, known.location)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {q(old)} RENAME TO {q(new)}")


def backup_name(table: str) -> str:
    return f"{table}__replaced"


def complete_swap(spark: SparkSession, table: str) -> None:
    """Finish a swap that a dead driver left: without a table the replaced one comes back, else it goes."""
    backup = backup_name(table)
    if table_exists(spark, backup):
        if table_exists(spark, table):
            _drop_with_folder(spark, backup, table)
        else:
            _rename(spark, backup, table)


def swap_in(spark: SparkSession, staging: str, table: str, after: Callable[[], None] | None) -> None:
    """Put a finished staging table in the place of ``table``, with a way back until ``after`` has run."""
    backup = backup_name(table) if table_exists(spark, table) else None
    if backup:
        _rename(spark, table, backup)
    try:
        _rename(spark, staging, table)
        if after:
            after()
    except BaseException:
        _drop_with_folder(spark, staging if table_exists(spark, staging) else table, table)
        if backup:
            _rename(spark, backup, table)
        raise
    if backup:
        _drop_with_folder(spark, backup, table)


def reduced_source(spark: SparkSession, table: str, source: DataFrame, keys: list[str], fields: list[T.StructField]) -> tuple[DataFrame, list[str]]:
    """One row per key: ``__k0..`` in the table's types and ``__last``, the values of the last row (by ``__file`` and ``__rn``)."""
    scols = [c for c in source.columns if not c.startswith("__")]
    missing = [k for k in keys if k not in scols or k not in spark.table(q(table)).columns]
    if missing:
        raise LoadError(f"match keys not in both input and table: {missing}")
    kinds = {f.name: f.dataType for f in fields}
    order = [F.col(c) for c in (FILE, RN) if c in source.columns] or [F.monotonically_increasing_id()]
    typed = source.select(*[convert(F.col(q(c)), source.schema[c].dataType, kinds[c]).alias(c) for c in scols], F.struct(*order).alias("__order"))
    update_cols = [c for c in scols if c not in keys]
    last = F.max_by(F.struct(F.lit(True).alias("__hit"), *[F.col(q(c)) for c in update_cols]), "__order").alias("__last")
    return typed.groupBy(*[F.col(q(k)).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(last), update_cols


def _same_keys(side: DataFrame, reduced: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & side[q(k)].eqNullSafe(reduced[f"__k{i}"])
    return cond


def matched_keys(target: DataFrame, reduced: DataFrame, keys: list[str], path: str = "_metadata.file_path") -> DataFrame:
    """Distinct keys (and files) of the target's rows that the source has; reads the key columns only."""
    side = target.select(*[F.col(q(k)) for k in keys], F.col(path).alias("__path"))
    return side.join(reduced, _same_keys(side, reduced, keys), "left_semi").distinct()


def upsert_rows(target: DataFrame, reduced: DataFrame, known: DataFrame, keys: list[str], update_cols: list[str],
                fields: list[T.StructField]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``target`` with the source's values, and the rows of keys that are not ``known``, both with the columns ``fields``."""
    kinds = {f.name: f.dataType for f in fields}

    def old(c: str):
        return F.col(q(c)) if c in target.columns else F.lit(None).cast(kinds[c])

    updated = target.join(reduced, _same_keys(target, reduced, keys), "left").select(*[
        (F.when(F.col("__last.__hit"), F.col(f"__last.{q(f.name)}")).otherwise(old(f.name)) if f.name in update_cols else old(f.name)).alias(f.name)
        for f in fields])
    place = {k: F.col(f"__k{i}") for i, k in enumerate(keys)} | {c: F.col(f"__last.{q(c)}") for c in update_cols}
    inserts = reduced.join(known, _same_keys(known, reduced, keys), "left_anti").select(
        *[place.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    return updated, inserts


def load(spark: SparkSession, df: DataFrame, table: str, o: LoadOptions = LoadOptions(), keys: list[str] | None = None,
         fmt: str = "parquet", count_source: bool = True, after: Callable[[], None] | None = None) -> LoadResult:
    """Write ``df`` (visible columns; ``__rn`` used as order for update) into ``table``.

    In update mode ``rows_updated`` needs the number of input rows; with
    ``count_source=False`` the caller supplies it (it usually has it from an
    observation) and ``rows_updated`` is left at -1.  ``after`` runs once the
    rows are in the table; if it fails, the table is as it was before.
    """
    t0 = time.time()
    mode = o.mode
    if mode not in {"append", "overwrite", "rebuild", "update"}:
        raise LoadError(f"unknown load mode {mode}")
    if mode == "append":
        chosen = choose_table_name(spark, table, o.existing_policy)
        if chosen is None:
            n = df.count()
            return LoadResult(table, mode, rows_skipped=n, elapsed_ms=int((time.time() - t0) * 1000))
        table = chosen
    complete_swap(spark, table)
    cols = visible_columns(df)
    data = df.select(*[F.col(q(c)) for c in cols])
    exists = table_exists(spark, table)
    if exists and mode != "rebuild":
        tcols = [f.name for f in table_columns(spark, table)]
        if o.match_by == "order":       # DCL-3: by position onto the table's names
            data = data.toDF(*[tcols[i] if i < len(tcols) else c for i, c in enumerate(cols)])
            df = df.toDF(*[tcols[i] if i < len(tcols) and i < len(cols) else c for i, c in enumerate(df.columns)])
            keys = [tcols[cols.index(k)] if k in cols and cols.index(k) < len(tcols) else k for k in (keys or [])]
            cols = data.columns
        if o.extra_columns == "ignore":  # DCL-4: drop what the table lacks
            cols = [c for c in cols if c in tcols]
            data = data.select(*[F.col(q(c)) for c in cols])
    if mode == "rebuild" or not exists:
        types = infer_types(data, o.type_mode)
    else:
        # an existing table's types win: infer only columns it lacks
        have = {f.name for f in table_columns(spark, table)}
        new = [c for c in cols if c not in have]
        types = infer_types(data, o.type_mode, new) if new else {}
    obs = Observation(f"load_{uuid.uuid4().hex[:8]}")
    seen = F.count(F.lit(1)).alias("n")
    result = LoadResult(table, mode)
    staging = f"{table}__staging_{uuid.uuid4().hex[:8]}"
    own = f"{o.location_root.rstrip('/')}/{table}__data_{uuid.uuid4().hex[:8]}" if o.location_root else ""
    place = describe(spark, table) if exists else None
    in_place = place is not None and place.is_folder and mode in {"append", "update"}
    if mode == "update" and exists:
        if not keys:
            raise LoadError("update mode needs at least one match key")
        if not in_place:
            raise LoadError(f"{table} is no table of files: it cannot be updated")
    commit = Commit(spark, place, safe_id(o.load_id or uuid.uuid4().hex[:16]), bool(o.load_id)) if in_place else None
    if commit and (note := commit.finished()):
        return LoadResult(table, mode, elapsed_ms=int((time.time() - t0) * 1000), replayed=True, **note)
    try:
        if mode == "rebuild" or not exists:
            _write_new(cast_columns(data, types).observe(obs, seen), staging, fmt, own)
        else:
            fields = evolved_fields(spark, table, data, types, o.auto_expand)
            if mode == "overwrite":
                _write_like(spark, align(data, fields).observe(obs, seen), staging, table, fields, own)
            elif not in_place:
                add_columns(spark, table, fields)
                align(data, fields).observe(obs, seen).write.insertInto(table)
            elif mode == "append":
                _write_like(spark, align(data, fields).observe(obs, seen), staging, table, fields, commit.staging)
            else:
                recover(spark, table)
                src = df.select(*[F.col(q(c)) for c in cols], *[F.col(c) for c in (FILE, RN) if c in df.columns])
                touched, kept = _stage_upsert(spark, commit, src, keys, fields, staging, obs)
        result.rows_written = observed(obs, spark, staging if table_exists(spark, staging) and mode != "update" else None)
        merged = exists and mode == "update"
        if merged:
            result.rows_inserted = result.rows_written
            result.rows_updated = src.count() - result.rows_inserted if count_source else -1
        if o.verify and table_exists(spark, staging):
            expected = result.rows_written + (kept if merged else 0)
            result.verified_rows = spark.table(q(staging)).count()
            if result.verified_rows != expected:
                raise LoadError(f"row count check failed for {table}: expected {expected}, found {result.verified_rows}")
        if commit:
            _drop(spark, staging)  # its files stay for the commit
            commit.publish(touched if merged else [])
            commit.add_columns(fields)
            if after:
                after()
            commit.finish(note_of(result))
        elif table_exists(spark, staging):
            if o.load_id:  # the ledger goes in with the table
                Commit(spark, describe(spark, staging), safe_id(o.load_id), True).write_ledger(note_of(result))
            swap_in(spark, staging, table, after)
        elif after:
            after()
    except BaseException:
        if commit:
            _drop(spark, staging)
            commit.undo()
        else:
            _drop_with_folder(spark, staging, table)
        raise
    result.elapsed_ms = int((time.time() - t0) * 1000)
    return result


def note_of(result: LoadResult) -> dict:
    return {"rows_written": result.rows_written, "rows_inserted": result.rows_inserted, "rows_updated": result.rows_updated}


def _stage_upsert(spark: SparkSession, commit: Commit, src: DataFrame, keys: list[str], fields: list[T.StructField],
                  staging: str, obs: Observation) -> tuple[list[str], int]:
    """Write the new content of the files that the source touches, and the new keys; those files, and their number of rows.

    The target is read twice: its key columns against the source's keys, then the rows of the touched files.  Where
    the reduced source is small enough, it is broadcast and the target is never shuffled."""
    table = commit.table.name
    reduced, update_cols = reduced_source(spark, table, src, keys, fields)
    reduced, _ = bounded_side(reduced)
    target = spark.table(q(table)).select("*", F.col("_metadata.file_path").alias("__path"))
    known = matched_keys(target, reduced, keys, "__path").checkpoint()
    paths = [r[0] for r in known.select("__path").distinct().collect()]
    rows = target.filter(F.col("__path").isin(paths)) if paths else target.limit(0)
    kept = Observation(f"kept_{uuid.uuid4().hex[:8]}")
    rows = rows.drop("__path").observe(kept, F.count(F.lit(1)).alias("n"))
    updated, inserts = upsert_rows(rows, reduced, known.drop("__path"), keys, update_cols, fields)
    _write_like(spark, updated.unionByName(inserts.observe(obs, F.count(F.lit(1)).alias("n"))), staging, table, fields, commit.staging)
    base = spark._jvm.org.apache.hadoop.fs.Path(commit.root).toUri().getPath().rstrip("/") + "/"
    names = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(p)).toUri().getPath() for p in paths]
    return [n.removeprefix(base) for n in names], observed(kept, spark, None) if paths else 0


def observed(obs: Observation, spark: SparkSession, staging: str | None) -> int:
    """Rows that a write saw.  A plan that the optimizer reduced to nothing reports no metric; then the rows
    that were written are counted."""
    try:
        return int(obs.get["n"])
    except Exception:  # noqa: BLE001 - the JVM side has no row to convert
        return spark.table(q(staging)).count() if staging else 0
