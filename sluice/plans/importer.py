"""Import plan: files -> shape -> map -> clean -> generate -> load (section 3.1).

Files that share options are read in one scan; every order-sensitive step is
scoped to its file.  Only four small results reach the driver: a byte sample,
the header row, per-block counts and the inferred types.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.functions.names import target_table_name
from sluice.operators import sql as S
from sluice.operators.clean import clean
from sluice.operators.generate import generate
from sluice.operators.load import LoadResult, load, q, table_exists
from sluice.operators.mapping import apply_mapping
from sluice.operators.commit import delete
from sluice.operators.order import FILE, RN, renumber_survivors
from sluice.operators.shape import shape
from sluice.options import (
    CleanOptions, GenerateOptions, LoadOptions, NamingOptions, ReadOptions, ShapeOptions, parse_bool, parse_mapping,
)
from sluice.sources import dispatch

CHECKPOINT_TABLE = "_import_checkpoints"
#: Most blocks that a resumable load is cut into, so that progress never costs more jobs than this.
RESUME_BLOCKS = 64


@dataclass
class Prepared:
    df: DataFrame
    columns: list[str]
    keys: list[str]
    rows_read: Observation | None = None
    rows_kept: Observation | None = None


@dataclass
class ImportSettings:
    read: ReadOptions = field(default_factory=ReadOptions)
    shape: ShapeOptions = field(default_factory=ShapeOptions)
    mapping: list | None = None
    naming: NamingOptions = field(default_factory=NamingOptions)
    clean: CleanOptions = field(default_factory=CleanOptions)
    generate: GenerateOptions = field(default_factory=GenerateOptions)
    load: LoadOptions = field(default_factory=LoadOptions)
    table: str = ""
    table_rule: str = "file"
    table_regex: str = ""
    symbol_to_underscore: bool = False
    table_pinyin: bool = False
    table_prefix: str = ""
    table_suffix: str = ""
    table_case: str = "lower"
    before_all_sql: str = ""
    after_each_sql: str = ""
    after_all_sql: str = ""
    delete_source: bool = False
    export_sql: str = ""          # LOAD-13: query exported after the import
    export_folder: str = ""
    log_table: str = ""           # LOG-1: append one row per file here
    parallel_files: int = 1       # >1: independent files (distinct tables) load concurrently
    on_progress: Callable[[int], None] | None = None  # told the rows done after each block of a resumable load

    @classmethod
    def from_fields(cls, f: dict) -> "ImportSettings":
        return cls(
            read=ReadOptions.from_fields(f),
            shape=ShapeOptions.from_fields(f),
            mapping=parse_mapping(f.get("mapping")),
            naming=NamingOptions.from_fields(f),
            clean=CleanOptions.from_fields(f),
            generate=GenerateOptions.from_fields(f),
            load=LoadOptions.from_fields(f),
            table=f.get("tableName", "") or "",
            table_rule=f.get("tableNameRule", "file") or "file",
            table_regex=f.get("tableRegex", "") or "",
            symbol_to_underscore=parse_bool(f, "symbolToUnderscore"),
            table_pinyin=parse_bool(f, "tablePinyin"),
            table_prefix=f.get("tablePrefix", "") or "",
            table_suffix=f.get("tableSuffix", "") or "",
            table_case=f.get("tableCase", "lower") or "lower",
            before_all_sql=f.get("beforeAllSql", "") or "",
            # custom SQL runs first, then the after-each hook
            after_each_sql=(f.get("customSql", "") or "").strip().rstrip(";") + ";\n" + (f.get("afterEachSql", "") or ""),
            after_all_sql=f.get("afterAllSql", "") or "",
            delete_source=parse_bool(f, "deleteAfterSuccess") or parse_bool(f, "deleteAfterImport"),
            export_sql=f.get("afterQuerySql", "") or f.get("exportSql", "") or "",
            export_folder=f.get("afterQueryExport", "") or f.get("exportFolder", "") or "",
        )


def prepare(raw: DataFrame, header: list[str] | None, s: ImportSettings, sheet: str = "",
            now: dt.datetime | None = None) -> Prepared:
    """Lazy plan from raw cells to the rows to load (no write)."""
    shaped, names = shape(raw, s.shape, header)
    mapped, targets, keys = apply_mapping(shaped, names, s.mapping, s.naming)
    pre = Observation(f"pre_{time.time_ns()}")
    mapped = mapped.observe(pre, F.count(F.lit(1)).alias("n"))
    cleaned = clean(mapped, s.clean)
    final, columns = generate(cleaned, targets, s.generate, s.naming, deduped=bool(s.clean.dedupe), sheet=sheet, now=now)
    post = Observation(f"post_{time.time_ns()}")
    final = final.observe(post, F.count(F.lit(1)).alias("n"))
    return Prepared(final, columns, keys, pre, post)


def metric(obs: Observation) -> int:
    """A row count; 0 where the optimizer found the input empty and reports none."""
    try:
        return int(obs.get["n"])
    except Exception:  # noqa: BLE001
        return 0


def resume_key(spark: SparkSession, path: str, table: str, mode: str) -> str:
    from sluice.sources.files import file_info

    size, mtime = file_info(spark, path)
    raw = f"{path}|{size}|{mtime}|{spark.catalog.currentDatabase()}|{table}|{mode}"
    return hashlib.sha1(raw.encode("utf-8")).hexdigest()


def checkpoint_rows(spark: SparkSession, key: str, table: str = CHECKPOINT_TABLE) -> int:
    """Rows of a file already loaded by an interrupted run (LOAD-9): what was recorded last."""
    if not table_exists(spark, table):
        return 0
    row = spark.table(table).where(F.col("key") == key).agg(F.max_by("rows_done", "updated_at")).first()
    return int(row[0] or 0)


def set_checkpoint(spark: SparkSession, key: str, rows_done: int, table: str = CHECKPOINT_TABLE, root: str = "") -> None:
    """Record rows already loaded for a file (LOAD-9): one more row of the checkpoint log, the latest counts."""
    df = spark.createDataFrame([(key, dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S.%f"), int(rows_done))],
                               "key string, updated_at string, rows_done long").coalesce(1)
    writer = df.write.format("parquet").mode("append")
    if root and not table_exists(spark, table):
        writer = writer.option("path", f"{root.rstrip('/')}/{table}")
    writer.saveAsTable(table)


def clear_checkpoint(spark: SparkSession, key: str, table: str = CHECKPOINT_TABLE, root: str = "") -> None:
    set_checkpoint(spark, key, 0, table, root)


def load_resumable(spark: SparkSession, df: DataFrame, table: str, s: ImportSettings, keys: list[str], key: str,
                   hook: Callable[[], None] | None) -> LoadResult:
    """LOAD-9: load the rows of one file block by block and record the rows done after each.

    The prepared rows are written once into the shared folder, in row order, and every block (``batch_rows`` rows; at
    most ``RESUME_BLOCKS`` blocks) is read from there by its row numbers.  An interrupted load starts behind its last
    full block.  A block is a named load: if it was committed but not recorded, it is not loaded again."""
    from sluice.session import ensure_checkpoint_dir

    rows = renumber_survivors(df) if s.clean.dedupe else df
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sluice-resume/{uuid.uuid4().hex}"
    try:
        rows.sortWithinPartitions(RN).write.parquet(place)
        rows = spark.read.schema(rows.schema).parquet(place)
        total = int(rows.agg(F.max(RN)).first()[0] or 0)
        step = max(s.load.batch_rows or total, -(-total // RESUME_BLOCKS), 1)
        done, result = checkpoint_rows(spark, key), None
        while done < total or result is None:
            end = min(done + step, total)
            options = replace(s.load, mode="append" if done else s.load.mode, load_id=f"{key}-{done}")
            block = rows.where((F.col(RN) > done) & (F.col(RN) <= end))
            res = load(spark, block, table, options, keys, count_source=False, after=hook if end == total else None)
            table = res.table  # a suffix is chosen once
            done = end
            set_checkpoint(spark, key, done, root=s.load.location_root)
            if s.on_progress:
                s.on_progress(done)
            result = res if result is None else replace(res, rows_written=result.rows_written + res.rows_written, elapsed_ms=result.elapsed_ms + res.elapsed_ms,
                                                        verified_rows=(result.verified_rows or 0) + (res.verified_rows or 0))
        clear_checkpoint(spark, key, root=s.load.location_root)
        return result
    finally:
        delete(spark, place)


@dataclass
class FileResult:
    file_name: str
    table: str
    status: str
    message: str = ""
    rows_read: int = 0
    result: LoadResult | None = None


def _import_file(spark: SparkSession, f: str, s: ImportSettings) -> list[FileResult]:
    """One file (each sheet a unit): prepare, load, hooks; failures are reported."""
    results: list[FileResult] = []
    name = f.rsplit("/", 1)[-1]
    units = dispatch.read_units(spark, [f], s.read)
    while True:
        try:
            raw, header, sheet = next(units)
        except StopIteration:
            break
        except Exception as exc:  # noqa: BLE001 - a file that cannot be read fails alone, too
            results.append(FileResult(name, s.table, "failed", str(exc)))
            break
        table_name, rule = s.table, s.table_rule
        if sheet and s.read.sheet_mode == "all":
            # SRC-6: one table per sheet, "{table}_{sheet}" or the sheet itself
            table_name, rule = (f"{s.table}_{sheet}" if s.table else ""), "sheet"
        table = target_table_name(
            name, table_name=table_name, sheet=sheet, rule=rule, regex=s.table_regex,
            symbol_to_underscore=s.symbol_to_underscore, pinyin=s.table_pinyin,
            prefix=s.table_prefix, suffix=s.table_suffix, case=s.table_case,
        )
        try:
            prepared = prepare(raw, header, s, sheet=sheet)
            df = prepared.df
            hook = (lambda: S.execute_batch(spark, s.after_each_sql)) if s.after_each_sql.strip(";\n ") else None
            if s.load.resume and s.load.mode != "update":
                res = load_resumable(spark, df, table, s, prepared.keys, resume_key(spark, f, table, s.load.mode), hook)
            else:
                res = load(spark, df, table, s.load, prepared.keys, count_source=False, after=hook)
            read_n, kept_n = metric(prepared.rows_read), metric(prepared.rows_kept)
            res.rows_skipped += read_n - kept_n
            if res.rows_updated < 0:
                res.rows_updated = kept_n - res.rows_inserted
            results.append(FileResult(name, res.table, "success", "", read_n, res))
        except Exception as exc:  # noqa: BLE001 - one file's failure is reported, the rest go on
            results.append(FileResult(name, table, "failed", str(exc)))
    if s.delete_source and all(r.status == "success" for r in results):
        from sluice.sources.files import _fs

        fs, p = _fs(spark, f)
        fs.delete(p, False)
    return results


def _can_run_files_in_parallel(files: list[str], s: ImportSettings) -> bool:
    """Only files that load into distinct tables, with no shared state between
    them (per-file SQL hooks, resume checkpoints, workbooks fanning out)."""
    if s.parallel_files <= 1 or len(files) < 2 or s.after_each_sql.strip(";\n ") or s.load.resume:
        return False
    if any(f.lower().endswith((".xlsx", ".xlsm")) for f in files):
        return False
    targets = [target_table_name(
        f.rsplit("/", 1)[-1], table_name=s.table, rule=s.table_rule, regex=s.table_regex,
        symbol_to_underscore=s.symbol_to_underscore, pinyin=s.table_pinyin,
        prefix=s.table_prefix, suffix=s.table_suffix, case=s.table_case) for f in files]
    return len(set(targets)) == len(targets)


def import_path(spark: SparkSession, path: str, s: ImportSettings) -> list[FileResult]:
    """Import one path (file or folder).  Each file (or sheet) is its own unit,
    as in the contract: its own header, counts, generated keys, target table
    and failure; a failure is logged and the other files go on (LOAD-10/11)."""
    from sluice.sources.files import list_files

    files = list_files(spark, path, recursive=s.read.recursive, modified_after_ms=s.read.modified_after_ms)
    if not files:
        raise ValueError("no supported files found")
    if s.before_all_sql.strip():
        S.execute_batch(spark, s.before_all_sql)
    if _can_run_files_in_parallel(files, s):
        from concurrent.futures import ThreadPoolExecutor

        # independent files with distinct target tables: concurrent Spark jobs
        with ThreadPoolExecutor(max_workers=s.parallel_files) as pool:
            per_file = list(pool.map(lambda f: _import_file(spark, f, s), files))
    else:
        per_file = [_import_file(spark, f, s) for f in files]
    results: list[FileResult] = [r for rs in per_file for r in rs]
    if s.after_all_sql.strip():
        S.execute_batch(spark, s.after_all_sql)
    if s.log_table:
        from sluice.operators.runlog import append_import_log, import_log_rows

        append_import_log(spark, s.log_table, import_log_rows(spark, results, s.load.mode))
    if s.export_sql.strip() and s.export_folder and any(r.status == "success" for r in results):
        from sluice.operators.export import export_frame
        from sluice.options import ExportOptions

        export_frame(spark.sql(s.export_sql.strip().rstrip(";")), s.export_folder, "query", ExportOptions(fmt="xlsx"))
    if results and all(r.status == "failed" for r in results):
        raise ValueError("all files failed: " + "; ".join(f"{r.file_name}: {r.message}" for r in results))
    return results


def _same_header(raw: DataFrame, header: list[str] | None, s: ImportSettings) -> list[DataFrame]:
    """The rows of one scan by the header of their files; one group in the common case."""
    from sluice.operators.shape import header_groups

    if header is not None or not s.shape.has_header or s.shape.header_row != 1:
        return [raw]
    groups = header_groups(raw, s.shape)
    return [raw] if len(groups) < 2 else [raw.where(F.col(FILE).isin(files)) for _, files in groups]


def import_together(spark: SparkSession, path: str, s: ImportSettings, per_file_counts: bool = False):
    """LOAD-11 at scale: all files of a folder that share options in ONE scan and
    one load for each distinct header into ``s.table``.  Order-sensitive steps stay
    scoped per file (``__file``); overwrite/rebuild clear the table once (the
    ``combine`` reading of a many-file overwrite).  Files that cannot be decoded are
    left out and named in the result's ``failed``; the others load.  Returns the
    load result and, when asked, a DataFrame of rows per file.
    """
    from sluice.sources.files import list_files

    if not s.table:
        raise ValueError("a shared target table is required")
    refused = [n for n, on in (("afterEachSql", s.after_each_sql.strip(";\n ")), ("resumeImport", s.load.resume), ("deleteAfterSuccess", s.delete_source),
                               ("log table", s.log_table), ("afterQuerySql", s.export_sql.strip())) if on]
    if refused:
        raise ValueError(f"one load of all files cannot honour {', '.join(refused)}: use import_path")
    files = list_files(spark, path, recursive=s.read.recursive, modified_after_ms=s.read.modified_after_ms)
    if s.before_all_sql.strip():
        S.execute_batch(spark, s.before_all_sql)
    total, counts, k, failed = None, None, 0, {}
    for raw, header, sheet in dispatch.read_units(spark, files, s.read, failed):
        for part in _same_header(raw, header, s):
            prepared = prepare(part, header, s, sheet=sheet)
            # the first unit (sheet or header) clears the table, the others join it
            opts = s.load if not k or s.load.mode == "update" else replace(s.load, mode="append")
            res = load(spark, prepared.df, s.table, opts, prepared.keys)
            k += 1
            res.rows_skipped += metric(prepared.rows_read) - metric(prepared.rows_kept)
            if per_file_counts:
                per_file = prepared.df.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows"))
                counts = per_file if counts is None else counts.union(per_file)
            if total is None:
                total = res
            else:
                total = replace(total, **{n: getattr(total, n) + getattr(res, n) for n in ("rows_written", "rows_inserted", "rows_updated", "rows_skipped", "elapsed_ms")})
    total.failed = failed
    if s.after_all_sql.strip():
        S.execute_batch(spark, s.after_all_sql)
    return total, counts


def preview_import(spark: SparkSession, path: str, s: ImportSettings, rows: int = 20) -> dict:
    """SHP-9: the first rows as they would load, the columns, the total, the
    sheets and the suggested table name - for the first file of ``path``."""
    from sluice.sources.files import list_files
    from sluice.sources.workbook import sheet_names

    f = list_files(spark, path)[0]
    raw, header, sheet = next(iter(dispatch.read_units(spark, [f], s.read)))
    prepared = prepare(raw, header, s, sheet=sheet)
    df = prepared.df
    head = df.orderBy(RN).limit(rows) if RN in df.columns else df.limit(rows)
    from sluice.functions.totext import as_text_frame

    data = [list(r) for r in as_text_frame(head.select(*prepared.columns)).collect()]
    name = f.rsplit("/", 1)[-1]
    return {
        "columns": prepared.columns,
        "rows": data,
        "total": df.count(),
        "sheets": sheet_names(f) if name.lower().endswith((".xlsx", ".xlsm")) else [],
        "table": target_table_name(name, table_name=s.table, sheet=sheet, rule=s.table_rule, regex=s.table_regex,
                                   symbol_to_underscore=s.symbol_to_underscore, pinyin=s.table_pinyin,
                                   prefix=s.table_prefix, suffix=s.table_suffix, case=s.table_case),
    }
