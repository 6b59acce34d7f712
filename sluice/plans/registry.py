"""Registered queries: every operator family run over the given tables.

Each query reads whole tables from ``sf_dir`` (or data Spark derives from
them), runs the library's operators, and returns a DataFrame; ``ORACLE``
holds the DuckDB statement that computes the same result.  Inputs that the
contract expects as text (cells of a file) are derived from the tables with
the contract's value-to-text rule; blanks and splits are derived from data
values, never from row ids.

Work that must land somewhere (tables, exported files, stream checkpoints)
goes under the session's shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.dates import parse_cascade
from sluice.functions.names import safe_file_stem_col
from sluice.functions.totext import as_text_frame
from sluice.operators import sql as S
from sluice.operators.clean import clean, keep_first
from sluice.operators.commit import data_files, delete, describe
from sluice.operators.export import export_frame
from sluice.operators.generate import generate
from sluice.operators.load import load
from sluice.operators.mapping import apply_mapping
from sluice.operators.order import FILE, RN, balance, number_rows, visible_columns, with_source_order
from sluice.operators.runlog import due, find_cycles, job_kind, latest, merge_runs, nest_steps, prune_runs, with_next_run
from sluice.operators.shape import shape
from sluice.operators.types import cast_columns, infer_types
from sluice.options import (
    CleanOptions, ExportOptions, GenerateOptions, LoadOptions, MappingItem, ReadOptions, ShapeOptions,
)
from sluice.plans import oracle_sql as O
from sluice.session import ensure_checkpoint_dir
from sluice.sources.files import _fs

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ------------------------------------------------------------------ helpers

def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ordered(spark: SparkSession, sf_dir: str, table: str, cols: list[str]) -> DataFrame:
    """Typed columns in file order, with ``__file, __blk, __rn``."""
    df = scan(spark, sf_dir, table).select(*cols, "_metadata")
    return number_rows(with_source_order(df)).drop("__pos")


def text_rows(spark: SparkSession, sf_dir: str, table: str, cols: list[str]) -> DataFrame:
    """The table as contract text cells, in file order (what a file scan yields)."""
    return as_text_frame(ordered(spark, sf_dir, table, cols))


def text_cells(spark: SparkSession, sf_dir: str, table: str, cols: list[str]) -> DataFrame:
    """The same cells for steps that do not depend on the rows' order: no row is numbered."""
    return as_text_frame(balance(scan(spark, sf_dir, table).select(*cols)))


def raw_cells(df: DataFrame) -> DataFrame:
    """Visible columns renamed to raw cells ``c1..cN`` (headerless file rows)."""
    vis = visible_columns(df)
    hidden = [c for c in df.columns if c.startswith("__")]
    return df.select(*[F.col(f"`{c}`").alias(f"c{i + 1}") for i, c in enumerate(vis)], *hidden)


def typed(df: DataFrame) -> DataFrame:
    vis = visible_columns(df)
    return cast_columns(df.select(*vis), infer_types(df.select(*vis)))


def workdir(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sluice-work/{uuid.uuid4().hex[:12]}"


def tname(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:10]}"


def views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for t in names:
        scan(spark, sf_dir, t).createOrReplaceTempView(t)


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


W_EVENT = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


# ------------------------------------------------------------------ flagship

FLAGSHIP_SQL = """
SELECT l_returnflag, l_linestatus,
       count(*) AS count_order,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_discount), 6) AS avg_disc
FROM {t}
WHERE l_shipdate <= '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


@register("flagship", FLAGSHIP_SQL.format(t="(SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem)"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: lineitem as text -> trim, blank set, zero, empty-as-null
    -> inferred types -> rebuild load -> guarded read-only SQL."""
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = text_cells(spark, sf_dir, "lineitem", cols)
    cleaned = clean(rows, CleanOptions(blank_values=("N/A", "-"), zero_for_blank=True, empty_as_null=True))
    table = tname("li_text")
    load(spark, cleaned, table, LoadOptions(mode="rebuild", location_root=workdir(spark)))
    return spark.sql(S.check_read_only(spark, FLAGSHIP_SQL.format(t=table)))


# ------------------------------------------------------------------ cleaning

_CT = dict(blanks=("de",), remove=".", rfrom="é", rto="e")


@register("clean_text", f"""
SELECT doc_id,
  nullif({O.stage_one('text', **_CT)}, '') AS text,
  nullif({O.stage_one('lang', **_CT)}, '') AS lang,
  nullif({O.stage_one('source', **_CT)}, '') AS source
FROM documents""")
def clean_text(spark, sf_dir):
    rows = text_cells(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    o = CleanOptions(blank_values=("de",), remove_text=".", replace_from="é", replace_to="e", empty_as_null=True)
    out = clean(rows, o)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


@register("clean_numbers", """
SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events""")
def clean_numbers(spark, sf_dir):
    rows = text_cells(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    rows = rows.withColumn("value", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("value")))
    return typed(clean(rows, CleanOptions(zero_for_blank=True)))


@register("replace_blank", f"""
SELECT event_id, CASE WHEN event_type = 'view' OR {O.strip('props')} = '' THEN '{{}}' ELSE {O.strip('props')} END AS props
FROM events""")
def replace_blank(spark, sf_dir):
    rows = text_cells(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    rows = rows.withColumn("props", F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("props")))
    out = clean(rows, CleanOptions(replace_blank_with="{}"))
    return out.select(F.col("event_id").cast("long").alias("event_id"), "props")


@register("date_parse", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""")
def date_parse(spark, sf_dir):
    rows = balance(scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    rows = as_text_frame(rows.withColumn("o_orderdate", F.date_format("o_orderdate", "d/M/yyyy")))
    out = clean(rows, CleanOptions(date_formats=(("O_ORDERDATE", "%d/%m/%Y"),)))
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderdate")


@register("fill_down", f"""
SELECT event_id,
  CASE WHEN value < 50 THEN coalesce(last_value(CASE WHEN value >= 50 THEN event_type END IGNORE NULLS) {W_EVENT}, '')
       ELSE event_type END AS event_type
FROM events""")
def fill_down(spark, sf_dir):
    rows = text_rows(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    rows = rows.withColumn("event_type", F.when(F.col("value").cast("double") < 50, F.lit("")).otherwise(F.col("event_type")))
    out = clean(rows, CleanOptions(fill_down=("event_type",)))
    return out.select(F.col("event_id").cast("long").alias("event_id"), "event_type")


@register("keep_first", """
SELECT event_id, user_id, event_type FROM (
  SELECT event_id, user_id, event_type,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def keep_first_q(spark, sf_dir):
    rows = text_rows(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    return typed(clean(rows, CleanOptions(dedupe=("user_id", "event_type"))))


@register("dense_key", """
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS total FROM orders),
d AS (SELECT * FROM r WHERE rn >= 11 AND rn <= total - 5),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rn) AS kr FROM d)
SELECT row_number() OVER (ORDER BY rn) AS id, o_orderkey, o_custkey FROM k WHERE kr = 1""")
def dense_key(spark, sf_dir):
    raw = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "_metadata")
    raw = raw_cells(as_text_frame(with_source_order(raw)))
    shaped, names = shape(raw, ShapeOptions(has_header=False, data_start_row=11, skip_tail_rows=5))
    mapping = [MappingItem(0, "o_orderkey", match_key=True), MappingItem(1, "o_custkey"), MappingItem(2, "o_orderstatus", enabled=False)]
    mapped, targets, _ = apply_mapping(shaped, names, mapping)
    cleaned = clean(mapped, CleanOptions(dedupe=("o_custkey",)))
    out, cols = generate(cleaned, targets, GenerateOptions(key_field="id"), deduped=True)
    return typed(out.select(*cols))


_PO = dict(blanks=("view",), remove="i", rfrom="c", rto="C")


@register("pipeline_order", f"""
WITH s AS (SELECT event_id, {O.stage_one('event_type', **_PO)} AS et, {O.stage_one('props', **_PO)} AS pr FROM events),
f AS (SELECT event_id, CASE WHEN et = '' THEN coalesce(last_value(nullif(et, '') IGNORE NULLS) {W_EVENT}, '') ELSE et END AS et, pr FROM s)
SELECT event_id, CASE WHEN et = '' THEN '0' ELSE et END AS event_type, CASE WHEN pr = '' THEN '0' ELSE pr END AS props FROM f""")
def pipeline_order(spark, sf_dir):
    rows = text_rows(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    o = CleanOptions(blank_values=("view",), remove_text="i", replace_from="c", replace_to="C",
                     fill_down=("event_type",), zero_for_blank=True)
    out = clean(rows, o)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "event_type", "props")


@register("map_defaults", """
SELECT c_name AS customer_name, CASE WHEN c_acctbal < 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS segment,
       c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation_key FROM customer""")
def map_defaults(spark, sf_dir):
    rows = text_cells(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    rows = rows.withColumn("c_mktsegment", F.when(F.col("c_acctbal").cast("double") < 0, F.lit("")).otherwise(F.col("c_mktsegment")))
    mapping = [MappingItem(1, "Customer Name", match_key=True), MappingItem(4, "Segment", default_value="UNKNOWN"),
               MappingItem(3, "Balance"), MappingItem(2, "Nation Key"), MappingItem(0, "", enabled=False)]
    mapped, _, _ = apply_mapping(rows, visible_columns(rows), mapping)
    return typed(clean(mapped, CleanOptions()))


@register("drop_empty_rows", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, row_number() OVER (ORDER BY c_custkey) AS row FROM customer WHERE c_acctbal >= 0""")
def drop_empty_rows(spark, sf_dir):
    """Rows of blank cells go before rows are numbered; blank columns at the end are cut."""
    base = scan(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "_metadata")
    base = as_text_frame(with_source_order(base))
    blank = F.col("c_acctbal").cast("double") < 0
    raw = base.select(
        *[F.when(blank, F.lit(" ")).otherwise(F.col(c)).alias(c) for c in ["c_custkey", "c_name", "c_nationkey"]],
        F.lit(" ").alias("tail1"), F.lit("").alias("tail2"), FILE, "__blk", "__pos",
    )
    shaped, names = shape(raw_cells(raw), ShapeOptions(has_header=False))
    mapping = [MappingItem(i, n) for i, n in enumerate(["c_custkey", "c_name", "c_nationkey"])]
    mapped, _, _ = apply_mapping(shaped, names, mapping)
    cells = mapped.withColumn("row", F.col(RN))
    return typed(cells)


def _infer_oracle() -> str:
    parts = []
    schema = {
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    }
    for t, cols in schema.items():
        for c in cols:
            v = f"CAST({c} AS VARCHAR)" if not c.endswith("shipdate") else f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
            parts.append(
                f"SELECT '{t}' AS tbl, '{c}' AS col, CASE "
                f"WHEN count(*) FILTER (WHERE v <> '') = 0 THEN 'string' "
                f"WHEN bool_and(regexp_full_match(v, '[-+]?\\d+')) FILTER (WHERE v <> '') THEN 'bigint' "
                f"WHEN bool_and(regexp_full_match(v, '[-+]?(\\d+(\\.\\d*)?|\\.\\d+)')) FILTER (WHERE v <> '') THEN 'double' "
                f"ELSE 'string' END AS inferred FROM (SELECT {v} AS v FROM {t})"
            )
    return "\nUNION ALL\n".join(parts)


@register("infer_types", _infer_oracle())
def infer_types_q(spark, sf_dir):
    out = []
    for t in ("part", "lineitem"):
        df = as_text_frame(balance(scan(spark, sf_dir, t)))
        for c, ty in infer_types(df).items():
            out.append((t, c, ty.simpleString()))
    return spark.createDataFrame(out, "tbl string, col string, inferred string")


# ------------------------------------------------------------------ loads

@register("append_verify", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def append_verify(spark, sf_dir):
    src = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    t, o = tname("orders_app"), LoadOptions(mode="append", location_root=workdir(spark))
    load(spark, src.where(F.col("o_orderstatus") == "F"), t, o)
    load(spark, src.where(~(F.col("o_orderstatus") == "F")), t, o)
    return spark.table(t)


@register("upsert", """
WITH tgt AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'),
src0 AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 0 THEN NULL ELSE c_custkey END AS k,
                c_custkey AS ord, c_name, c_acctbal + 100 AS bal, c_mktsegment AS seg
         FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')),
src AS (SELECT k, arg_max(c_name, ord) AS c_name, arg_max(bal, ord) AS bal, arg_max(seg, ord) AS seg FROM src0 GROUP BY k)
SELECT t.c_custkey,
       CASE WHEN s.hit THEN s.c_name ELSE t.c_name END AS c_name,
       t.c_nationkey,
       CASE WHEN s.hit THEN s.bal ELSE t.c_acctbal END AS c_acctbal,
       CASE WHEN s.hit THEN s.seg ELSE t.c_mktsegment END AS c_mktsegment
FROM tgt t LEFT JOIN (SELECT *, true AS hit FROM src) s ON t.c_custkey IS NOT DISTINCT FROM s.k
UNION ALL
SELECT s.k, s.c_name, CAST(NULL AS INTEGER), s.bal, s.seg FROM src s
WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.c_custkey IS NOT DISTINCT FROM s.k)""")
def upsert(spark, sf_dir):
    cust = ordered(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    t, root = tname("cust_up"), workdir(spark)
    load(spark, cust.where(F.col("c_mktsegment") != "MACHINERY"), t, LoadOptions(mode="rebuild", location_root=root))
    src = cust.where(F.col("c_mktsegment").isin("MACHINERY", "BUILDING")).select(
        F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 0), F.lit(None))
        .otherwise(F.col("c_custkey")).cast("long").alias("c_custkey"),
        "c_name", (F.col("c_acctbal") + 100).alias("c_acctbal"), "c_mktsegment", RN,
    )
    load(spark, src, t, LoadOptions(mode="update", location_root=root), ["c_custkey"])
    return spark.table(t)


@register("upsert_last_wins", """
SELECT max(event_id) AS event_id, user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY user_id""")
def upsert_last_wins(spark, sf_dir):
    ev = ordered(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    t, root = tname("ev_up"), workdir(spark)
    first_signup = keep_first(ev.where(F.col("event_type") == "signup"), ["user_id"])
    load(spark, first_signup, t, LoadOptions(mode="rebuild", location_root=root))
    load(spark, ev, t, LoadOptions(mode="update", location_root=root), ["user_id"])
    return spark.table(t)


@register("evolve_schema", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def evolve_schema(spark, sf_dir):
    cust = scan(spark, sf_dir, "customer")
    t, o = tname("cust_ev"), LoadOptions(mode="append", location_root=workdir(spark))
    load(spark, cust.where(F.col("c_mktsegment") == "HOUSEHOLD").select("c_custkey", "c_name"), t, o)
    load(spark, cust.where(F.col("c_mktsegment") != "HOUSEHOLD").select("c_custkey", "c_name", "c_mktsegment"), t, o)
    return spark.table(t)


@register("overwrite_rebuild", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def overwrite_rebuild(spark, sf_dir):
    sup = scan(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    t, root = tname("sup"), workdir(spark)
    load(spark, sup, t, LoadOptions(mode="rebuild", location_root=root))
    load(spark, sup.where(F.col("s_acctbal") > 0), t, LoadOptions(mode="overwrite", location_root=root))
    return spark.table(t)


class Interrupted(RuntimeError):
    """What a query raises to break a load off."""


@register("append_beside_writer", """
SELECT o_orderkey, o_totalprice, CAST(2 AS BIGINT) AS n_columns FROM orders WHERE o_orderstatus <> 'P'""")
def append_beside_writer(spark, sf_dir):
    """Two appends interleave and one fails: the other's rows and the old columns stay."""
    src = scan(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    t, o = tname("orders_two"), LoadOptions(mode="append", location_root=workdir(spark))
    load(spark, src.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), t, o)

    def other():
        load(spark, src.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), t, o)
        raise Interrupted

    try:
        load(spark, src.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice", "o_custkey"), t, o, after=other)
    except Interrupted:
        pass
    table = spark.table(t)
    return table.withColumn("n_columns", F.lit(len(table.columns)).cast("long"))


@register("rebuild_leaves_no_folder", """
SELECT s_suppkey, s_name, CAST(1 AS BIGINT) AS folders FROM supplier WHERE s_nationkey < 10""")
def rebuild_leaves_no_folder(spark, sf_dir):
    """Rebuilds and overwrites leave one data folder, whatever they replace."""
    sup = scan(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    t, root = tname("sup_once"), workdir(spark)
    for mode in ("rebuild", "rebuild", "overwrite"):
        load(spark, sup.where("s_nationkey < 10").drop("s_nationkey"), t, LoadOptions(mode=mode, location_root=root))
    fs, p = _fs(spark, root)
    return spark.table(t).withColumn("folders", F.lit(len(list(fs.listStatus(p)))).cast("long"))


@register("upsert_few_files", """
SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 0.0 ELSE o_totalprice END AS o_totalprice,
       CAST(1 AS BIGINT) AS rewritten FROM orders
UNION ALL SELECT -1, 1.0, 1""")
def upsert_few_files(spark, sf_dir):
    """An update of one known and one new key writes one of the table's files again."""
    src = scan(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    t, root = tname("orders_files"), workdir(spark)
    load(spark, src.repartitionByRange(8, "o_orderkey"), t, LoadOptions(mode="rebuild", location_root=root))
    folder = describe(spark, t).location
    before = set(data_files(spark, folder))
    change = src.agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    new = change.unionByName(change.select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")))
    load(spark, new, t, LoadOptions(mode="update", location_root=root), ["o_orderkey"])
    return spark.table(t).withColumn("rewritten", F.lit(len(before - set(data_files(spark, folder)))).cast("long"))


@register("resume_load", """
SELECT o_orderkey, o_totalprice, CAST(3 AS BIGINT) AS blocks_first, CAST((SELECT ceil((count(*) - 3 * (count(*) // 5)) / (count(*) // 5)) FROM orders) AS BIGINT) AS blocks_then
FROM orders""")
def resume_load(spark, sf_dir):
    """An import that breaks off after three blocks goes on behind them when it runs again."""
    from sluice.plans.importer import ImportSettings, import_path
    from sluice.sources.files import list_files

    root, t = workdir(spark), tname("orders_res")
    src = scan(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    res = export_frame(src.coalesce(1), root, "orders", ExportOptions(fmt="csv"))
    file = list_files(spark, res.path)[0]
    settings = ImportSettings.from_fields({"importMode": "rebuild", "tableName": t, "resumeImport": "1", "batchRows": str(src.count() // 5)})
    settings.load = replace(settings.load, location_root=root)
    first, then = [], []

    def break_off(done: int) -> None:
        first.append(done)
        if len(first) == 3:
            raise Interrupted("broken off")

    try:
        import_path(spark, file, replace(settings, on_progress=break_off))
    except ValueError:  # the one file has failed
        pass
    import_path(spark, file, replace(settings, on_progress=then.append))
    return spark.table(t).withColumns({"blocks_first": F.lit(len(first)).cast("long"), "blocks_then": F.lit(len(then)).cast("long")})


# ------------------------------------------------------------------ catalog and SQL

@register("table_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    from sluice.sources.catalog import source_listing

    views(spark, sf_dir)
    return source_listing(spark, list(TABLES)).select("name", "row_count")


@register("where_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def where_project(spark, sf_dir):
    views(spark, sf_dir, ["lineitem"])
    return S.source_frame(spark, table="lineitem", fields=["l_orderkey", "l_linenumber", "l_quantity"],
                          where_clause="where l_quantity > 30 and l_returnflag = 'R'")


READONLY_SQL = ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty "
                "FROM lineitem GROUP BY l_returnflag, l_linestatus")


@register("readonly_sql", READONLY_SQL)
def readonly_sql(spark, sf_dir):
    views(spark, sf_dir, ["lineitem"])
    return spark.sql(S.check_read_only(spark, READONLY_SQL))


# ------------------------------------------------------------------ export and re-import

def _reimport(spark: SparkSession, path: str, read: ReadOptions = ReadOptions()) -> DataFrame:
    from sluice.sources.dispatch import read_units
    from sluice.sources.files import list_files

    files = list_files(spark, path)
    raw, header, _ = next(iter(read_units(spark, files, read)))
    shaped, names = shape(raw, ShapeOptions(), header)
    mapped, _, _ = apply_mapping(shaped, names, None)
    return typed(clean(mapped, CleanOptions()))


_CUST_RT = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")


def _roundtrip(spark, sf_dir, fmt):
    cust = scan(spark, sf_dir, "customer")
    res = export_frame(cust, workdir(spark), "customer", ExportOptions(fmt=fmt))
    read = ReadOptions(row_tag="row") if fmt == "xml" else ReadOptions()
    return _reimport(spark, res.path, read)


@register("export_roundtrip_csv", _CUST_RT)
def export_roundtrip_csv(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "csv")


@register("export_roundtrip_json", _CUST_RT)
def export_roundtrip_json(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "json")


@register("export_roundtrip_xml", _CUST_RT)
def export_roundtrip_xml(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "xml")


@register("workbook_io", _CUST_RT)
def workbook_io(spark, sf_dir):
    """EXP-9 then SRC-5: every partition writes workbook parts; the scan reads
    them back one partition per (file, sheet)."""
    return _roundtrip(spark, sf_dir, "xlsx")


@register("dbf_io", """
SELECT c_custkey AS custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS segment FROM customer""")
def dbf_io(spark, sf_dir):
    """SRC-7 over DBF files Spark writes from customer (one file per partition)."""
    from sluice.sources.dbf import write_dbf_parts

    cust = scan(spark, sf_dir, "customer")
    fields = [("CUSTKEY", "N", 12, 0), ("NAME", "C", 25, 0), ("NATIONKEY", "N", 4, 0),
              ("ACCTBAL", "N", 14, 2), ("SEGMENT", "C", 12, 0)]
    folder = f"{workdir(spark)}/dbf"
    write_dbf_parts(balance(cust), folder, fields)
    return _reimport(spark, folder)


@register("import_folder", """
SELECT o_orderkey AS order_key, o_custkey AS customer,
       CASE WHEN o_orderstatus = 'P' THEN 'NONE' ELSE o_orderstatus END AS status, o_totalprice AS total
FROM orders""")
def import_folder(spark, sf_dir):
    """LOAD-11 one-scan path: orders written as several CSV part files, then
    all files imported in one scan (header per file, mapping, blank values,
    replace-blank, typing) into one table."""
    from sluice.plans.importer import ImportSettings, import_together

    o = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    res = export_frame(balance(o), workdir(spark), "orders", ExportOptions(fmt="csv"))
    table = tname("orders_folder")
    fields = {
        "importMode": "rebuild", "tableName": table, "blankCellValues": "P", "replaceBlankWith": "NONE",
        "mapping": [{"sourceIndex": 0, "target": "Order Key"}, {"sourceIndex": 1, "target": "Customer"},
                    {"sourceIndex": 2, "target": "Status"}, {"sourceIndex": 3, "target": "Total"}],
    }
    settings = ImportSettings.from_fields(fields)
    settings.load = replace(settings.load, location_root=workdir(spark))
    import_together(spark, res.path, settings)
    return spark.table(table)


_DIGITS, _HAN = "0123456789", "零一二三四五六七八九"


@register("import_mixed_charsets", f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '㐀' ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN c_name
       ELSE translate(c_name, '{_DIGITS}', '{_HAN}') END AS name FROM customer""")
def import_mixed_charsets(spark, sf_dir):
    """Files of three charsets in one scan; one begins with plain ASCII rows and is only then another charset."""
    from sluice.plans.importer import ImportSettings, import_together

    cust, root, table = scan(spark, sf_dir, "customer"), workdir(spark), tname("cust_charsets")
    han = F.translate("c_name", _DIGITS, _HAN)
    for segment, encoding in (("BUILDING", "gbk"), ("MACHINERY", "gb18030"), (None, "utf-8")):
        mine = F.col("c_mktsegment") == segment if segment else ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
        plain = (F.lit(segment) == "BUILDING") & (F.col("c_acctbal") < 0) if segment else F.lit(False)
        name = F.concat(F.lit("㐀" if segment == "MACHINERY" else ""), F.when(plain, F.col("c_name")).otherwise(han))
        rows = cust.where(mine).select("c_custkey", name.alias("name"), plain.alias("plain")).coalesce(1)
        export_frame(rows.sortWithinPartitions(F.desc("plain")).drop("plain"), f"{root}/in", encoding, ExportOptions(fmt="csv", encoding=encoding))
    settings = ImportSettings.from_fields({"importMode": "rebuild", "tableName": table, "includeSubfolders": "1"})
    settings.load = replace(settings.load, location_root=root)
    import_together(spark, f"{root}/in", settings)
    return spark.table(table)


@register("import_quoted_newlines", f"""
SELECT doc_id, {O.strip('text')} AS text FROM documents""")
def import_quoted_newlines(spark, sf_dir):
    """Texts of several lines, written as quoted cells, come back as one record each."""
    from sluice.plans.importer import ImportSettings, import_together

    root, table = workdir(spark), tname("doc_lines")
    res = export_frame(scan(spark, sf_dir, "documents").select("doc_id", "text"), root, "documents", ExportOptions(fmt="csv"))
    settings = ImportSettings.from_fields({"importMode": "rebuild", "tableName": table})
    settings.load = replace(settings.load, location_root=root)
    import_together(spark, res.path, settings)
    return spark.table(table)


@register("json_lines_scan", """
SELECT event_id, event_type, value, props FROM events""")
def json_lines_scan(spark, sf_dir):
    """Objects a line, with braces inside their strings, read in splits."""
    folder = f"{workdir(spark)}/lines"
    scan(spark, sf_dir, "events").select("event_id", "event_type", "value", "props").write.json(folder)
    return _reimport(spark, folder)


@register("json_array_scan", """
SELECT doc_id, lang, text FROM documents""")
def json_array_scan(spark, sf_dir):
    """Arrays of objects, read in splits between their closing braces."""
    res = export_frame(scan(spark, sf_dir, "documents").select("doc_id", "lang", "text"), workdir(spark), "documents", ExportOptions(fmt="json"))
    from sluice.sources.files import list_files
    from sluice.sources.json_source import read_json

    df, keys = read_json(spark, list_files(spark, res.path))
    named = df.select(*[F.col(f"c{i + 1}").alias(k) for i, k in enumerate(keys)])
    return typed(named)


@register("export_split", "SELECT c_mktsegment AS part, count(*) AS n FROM customer GROUP BY c_mktsegment")
def export_split(spark, sf_dir):
    from sluice.sources.delimited import read_delimited
    from sluice.sources.files import list_files

    cust = scan(spark, sf_dir, "customer")
    res = export_frame(cust, workdir(spark), "customer", ExportOptions(fmt="csv", split_field="c_mktsegment"))
    files = [f for part in res.parts.values() for f in list_files(spark, part)]
    shaped, _ = shape(read_delimited(spark, files), ShapeOptions())
    folder = F.regexp_extract(F.col(FILE), "/customer_([^/]*)/[^/]*$", 1)
    return shaped.groupBy(F.url_decode(folder).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@register("export_split_batches", """
SELECT o_orderkey, o_totalprice, CAST(0 AS BIGINT) AS files_too_long FROM orders""")
def export_split_batches(spark, sf_dir):
    """A job that asks for files of 1,000 rows writes every row, 1,000 at most to a file."""
    views(spark, sf_dir, ["orders"])
    src = S.source_frame(spark, sql="SELECT o_orderkey, o_totalprice FROM orders")
    options = ExportOptions.from_fields({"extension": "csv", "splitByBatch": "1", "batchRows": "1000"})
    res = export_frame(src, workdir(spark), "orders_split", options)
    sizes = spark.read.text(res.path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    long = sizes.agg(F.coalesce(F.sum((F.col("n") > 1001).cast("long")), F.lit(0)).alias("files_too_long"))
    return _reimport(spark, res.path).join(F.broadcast(long))


@register("export_twice", """
SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def export_twice(spark, sf_dir):
    """Exporting to the same place again replaces the files."""
    rows = scan(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    folder = workdir(spark)
    export_frame(rows.repartition(3), folder, "people", ExportOptions(fmt="json"))
    res = export_frame(rows, folder, "people", ExportOptions(fmt="json"))
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(res.path, multiLine=True)


@register("export_split_json", """
SELECT c_mktsegment AS segment, count(*) AS rows FROM customer GROUP BY c_mktsegment""")
def export_split_json(spark, sf_dir):
    """One folder per value, however many rows a value has."""
    rows = scan(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(3)
    res = export_frame(rows, workdir(spark), "people", ExportOptions(fmt="json", split_field="c_mktsegment"))
    back = spark.read.schema("c_custkey long, c_mktsegment string").option("recursiveFileLookup", "true").json(res.path, multiLine=True)
    return back.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("rows"))


@register("failed_rebuild_keeps_table", """
SELECT n_nationkey, n_name, 'rebuild,overwrite,append,update,hook' AS failed FROM nation""")
def failed_rebuild_keeps_table(spark, sf_dir):
    """Loads that fail on the way, in every mode and in the hook, leave the table as it was."""
    nation = scan(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t, root = tname("nation_safe"), workdir(spark)
    load(spark, nation, t, LoadOptions(mode="rebuild", location_root=root))
    bad = nation.withColumn("n_name", F.when(F.col("n_nationkey") == 7, F.raise_error(F.lit("bad cell")).cast("string")).otherwise("x"))
    failed = []

    def refuse():
        raise ValueError("hook")

    for name, df, mode, hook in [("rebuild", bad, "rebuild", None), ("overwrite", bad, "overwrite", None), ("append", bad, "append", None),
                                 ("update", bad, "update", None), ("hook", nation, "append", refuse)]:
        try:
            load(spark, df, t, LoadOptions(mode=mode, location_root=root), ["n_nationkey"], after=hook)
        except Exception:  # noqa: BLE001 - each of them must fail
            failed.append(name)
    return spark.table(t).withColumn("failed", F.lit(",".join(failed)))


@register("upsert_text_keys", """
SELECT c_custkey, arg_max(v, o) AS c_name FROM (
  SELECT c_custkey, c_name AS v, 0 AS o FROM customer WHERE c_nationkey < 12
  UNION ALL SELECT c_custkey, 'first', 1 FROM customer WHERE c_nationkey >= 8
  UNION ALL SELECT c_custkey, 'second', 2 FROM customer WHERE c_nationkey >= 10) GROUP BY c_custkey""")
def upsert_text_keys(spark, sf_dir):
    """Text keys of two spellings are one key of the table; the later row wins."""
    cust = scan(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    t, root = tname("cust_text"), workdir(spark)
    load(spark, cust.filter("c_nationkey < 12").drop("c_nationkey"), t, LoadOptions(mode="rebuild", location_root=root))
    key = F.col("c_custkey").cast("string")
    one = cust.filter("c_nationkey >= 8").select(key.alias("c_custkey"), F.lit("first").alias("c_name"), F.col("c_custkey").alias(RN))
    two = cust.filter("c_nationkey >= 10").select(F.concat(F.lit("0"), key).alias("c_custkey"), F.lit("second").alias("c_name"), (F.col("c_custkey") + 10 ** 9).alias(RN))
    load(spark, one.union(two), t, LoadOptions(mode="update", location_root=root), ["c_custkey"])
    return spark.table(t)


@register("upsert_many_files", """
SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'from_b' ELSE 'from_a' END AS n_name FROM nation""")
def upsert_many_files(spark, sf_dir):
    """Two files with clashing keys: the later file wins, whatever the row numbers are."""
    nation = scan(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t, root = tname("nation_files"), workdir(spark)
    load(spark, nation.limit(0), t, LoadOptions(mode="rebuild", type_mode="text", location_root=root))
    a = nation.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), F.lit("from_a").alias("n_name"), F.lit("a.csv").alias(FILE), (F.col("n_nationkey") + 100).alias(RN))
    b = nation.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), F.lit("from_b").alias("n_name"), F.lit("b.csv").alias(FILE), F.col("n_nationkey").alias(RN))
    load(spark, b.union(a), t, LoadOptions(mode="update", location_root=root), ["n_nationkey"])
    return spark.table(t).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@register("file_safe", """
WITH a AS (SELECT page_id, regexp_replace(""" + O.strip("url") + """, '[<>:"/\\\\|?*\\x00-\\x1f]+', '_', 'g') AS s FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(s, '\\s+', ' ', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS s FROM a)
SELECT page_id, left(CASE WHEN s = '' THEN 'export' ELSE s END, 120) AS stem FROM b""")
def file_safe(spark, sf_dir):
    pages = scan(spark, sf_dir, "pages")
    return pages.select("page_id", safe_file_stem_col(F.col("url")).alias("stem"))


@register("flatten_json", """
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events""")
def flatten_json(spark, sf_dir):
    from sluice.sources.json_source import flatten_rows

    ev = ordered(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    docs = ev.select(F.to_json(F.struct("event_id", "event_type", F.parse_json("props").alias("props"))).alias("doc"), FILE, RN)
    flat, keys = flatten_rows(docs, "doc", [FILE, RN])
    named = flat.select(*[F.col(f"c{i + 1}").alias(k) for i, k in enumerate(keys)])
    return typed(named)


# ------------------------------------------------------------------ run-log operators

@register("nest_steps", """
SELECT conv_id AS id, string_agg(role, '|' ORDER BY turn) AS roles,
       count(*) FILTER (WHERE role = 'user') AS succeeded, count(*) FILTER (WHERE role = 'assistant') AS failed
FROM conversations GROUP BY conv_id""")
def nest_steps_q(spark, sf_dir):
    conv = scan(spark, sf_dir, "conversations")
    runs = conv.groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("first_turn")).withColumn("started_at", F.lit(""))
    steps = conv.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("step_index"), F.col("role").alias("step_name"),
        F.when(F.col("role") == "user", "success").when(F.col("role") == "assistant", "failed").otherwise(F.col("role")).alias("status"),
    )
    nested = nest_steps(runs, steps, limit=None)
    return nested.select("id", F.concat_ws("|", F.transform("steps", lambda s: s["step_name"])).alias("roles"), "succeeded", "failed")


@register("merge_runs", """
SELECT user_id AS schedule_id, strftime(ts, '%Y-%m-%d') AS started_at, min(event_id) AS id,
       arg_min(event_type, event_id) AS job_name,
       max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS ended_at, max(value) AS elapsed_ms,
       CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'success' END AS status,
       count(*) AS runs, count(*) FILTER (WHERE event_type <> 'purchase') AS n_steps,
       arg_min(event_type, event_id) FILTER (WHERE event_type <> 'purchase') || ' / s' AS first_step
FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""")
def merge_runs_q(spark, sf_dir):
    ev = scan(spark, sf_dir, "events")
    runs = ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("schedule_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("started_at"), ts_text(F.col("ts")).alias("ended_at"),
        F.col("value").alias("elapsed_ms"), F.col("event_type").alias("job_name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )
    steps = ev.select(
        F.col("event_id").alias("run_id"), F.lit(1).alias("step_index"), F.lit("s").alias("step_name"),
        F.when(F.col("event_type") == "purchase", "job").otherwise("sql").alias("step_type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("value").alias("elapsed_ms"),
    )
    m = merge_runs(runs, steps)
    return m.select("schedule_id", "started_at", "id", "job_name", "ended_at", "elapsed_ms", "status", "runs",
                    F.size("steps").cast("long").alias("n_steps"),
                    F.try_element_at("steps", F.lit(1))["step_name"].alias("first_step"))


_RET_NOW = dt.datetime(2001, 1, 1)
_RET_CUT = (_RET_NOW - dt.timedelta(days=1000)).strftime("%Y-%m-%d %H:%M:%S")


@register("retention", f"""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey
                  AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') < '{_RET_CUT}')""")
def retention(spark, sf_dir):
    runs = scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ts_text(F.col("o_orderdate")).alias("started_at"))
    steps = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber")
    _, kept = prune_runs(runs, steps, 1000, now=_RET_NOW)
    return kept.select(F.col("run_id").alias("l_orderkey"), "l_linenumber")


_NR_MODE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'interval' WHEN '2-HIGH' THEN 'daily' WHEN '3-MEDIUM' THEN 'weekly'
              WHEN '4-NOT SPECIFIED' THEN 'monthly' ELSE 'yearly' END"""


@register("next_run", f"""
WITH r AS (
  SELECT o_orderkey, {_NR_MODE} AS mode,
         o_orderdate + to_seconds(o_orderkey % 86400) AS b,
         o_custkey % 5 + 1 AS amount, o_custkey % 7 + 1 AS weekday, o_custkey % 31 + 1 AS dday, o_custkey % 12 + 1 AS mon,
         o_custkey % 2 = 0 AS has_last
  FROM orders),
c AS (
  SELECT *, date_trunc('day', b) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE AS t,
         b - INTERVAL 1 DAY + to_seconds(amount * 3600) AS c0
  FROM r),
n AS (
  SELECT o_orderkey, mode, CASE mode
    WHEN 'interval' THEN CASE WHEN has_last THEN
         CASE WHEN c0 < b THEN c0 + to_seconds((floor((epoch(b) - epoch(c0)) / (amount * 3600)) + 1) * amount * 3600) ELSE c0 END
         ELSE b + to_seconds(amount * 3600) END
    WHEN 'daily' THEN CASE WHEN t <= b THEN t + INTERVAL 1 DAY ELSE t END
    WHEN 'weekly' THEN CASE WHEN t + to_days(CAST(((weekday - 1) - (isodow(b) - 1) + 7) % 7 AS INTEGER)) <= b
                            THEN t + to_days(CAST(((weekday - 1) - (isodow(b) - 1) + 7) % 7 AS INTEGER) + 7)
                            ELSE t + to_days(CAST(((weekday - 1) - (isodow(b) - 1) + 7) % 7 AS INTEGER)) END
    WHEN 'monthly' THEN CASE
         WHEN make_timestamp(year(b), month(b), least(dday, day(last_day(b))), 9, 30, 0) <= b
         THEN make_timestamp(year(date_trunc('month', b) + INTERVAL 1 MONTH), month(date_trunc('month', b) + INTERVAL 1 MONTH),
                             least(dday, day(last_day(date_trunc('month', b) + INTERVAL 1 MONTH))), 9, 30, 0)
         ELSE make_timestamp(year(b), month(b), least(dday, day(last_day(b))), 9, 30, 0) END
    ELSE CASE
         WHEN make_timestamp(year(b), mon, least(dday, day(last_day(make_date(year(b), mon, 1)))), 9, 30, 0) <= b
         THEN make_timestamp(year(b) + 1, mon, least(dday, day(last_day(make_date(year(b) + 1, mon, 1)))), 9, 30, 0)
         ELSE make_timestamp(year(b), mon, least(dday, day(last_day(make_date(year(b), mon, 1)))), 9, 30, 0) END
  END AS nr FROM c)
SELECT o_orderkey, mode, strftime(nr, '%Y-%m-%d %H:%M:%S') AS next_run FROM n""")
def next_run_q(spark, sf_dir):
    o = scan(spark, sf_dir, "orders")
    mode = F.expr(_NR_MODE)
    base = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate"))
    rules = o.select(
        "o_orderkey", mode.alias("mode"), base.alias("__base"),
        (F.col("o_custkey") % 5 + 1).alias("amount"), F.lit("hours").alias("unit"), F.lit("09:30:00").alias("time"),
        (F.col("o_custkey") % 7 + 1).alias("weekday"), (F.col("o_custkey") % 31 + 1).alias("day"),
        (F.col("o_custkey") % 12 + 1).alias("month"),
        F.when((mode == "interval") & (F.col("o_custkey") % 2 == 0),
               ts_text(F.timestamp_add("DAY", F.lit(-1), base))).otherwise(F.lit("")).alias("last_run_at"),
    )
    out = with_next_run(rules, F.col("__base"), "next_run")
    return out.select("o_orderkey", "mode", "next_run")


@register("parse_cascade", """
WITH t AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M')
    WHEN 'signup' THEN strftime(ts, '%Y-%m-%d') WHEN 'error' THEN 'n/a' ELSE strftime(ts, '%d.%m.%Y') END AS x FROM events)
SELECT event_id, strftime(coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%dT%H:%M'),
                                   try_strptime(x, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS parsed FROM t""")
def parse_cascade_q(spark, sf_dir):
    ev = scan(spark, sf_dir, "events")
    x = (F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
         .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
         .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd"))
         .when(F.col("event_type") == "error", F.lit("n/a"))
         .otherwise(F.date_format("ts", "dd.MM.yyyy")))
    return ev.select("event_id", F.date_format(parse_cascade(x), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("latest_entries", """
SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_type AS status
FROM events ORDER BY created_at DESC, id DESC LIMIT 50""")
def latest_entries(spark, sf_dir):
    """LOG-2: the newest 50 log rows (a top-k, the operator's own limit)."""
    log = scan(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), ts_text(F.col("ts")).alias("created_at"), F.col("event_type").alias("status"))
    return latest(log, "created_at", 50)


@register("due_schedules", """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS next_run_at FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'
  AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') <= '1996-01-01 00:00:00'""")
def due_schedules(spark, sf_dir):
    """LOG-7 over orders read as schedules."""
    o = scan(spark, sf_dir, "orders")
    sched = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("enabled"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("running"),
        ts_text(F.col("o_orderdate")).alias("next_run_at"),
    )
    return due(sched, "1996-01-01 00:00:00").select("id", "next_run_at")


@register("job_kinds", """
WITH RECURSIVE s AS (SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE 'job' END AS step_type,
                  l_partkey AS target FROM lineitem),
k AS (SELECT job_id, count(*) AS steps, count(DISTINCT step_type) AS n, min(step_type) AS t, min(target) AS tgt
      FROM s GROUP BY job_id),
b AS (SELECT job_id, CASE WHEN steps = 1 AND t = 'job' THEN tgt END AS nxt,
             CASE WHEN steps = 1 AND t = 'job' THEN NULL WHEN n = 1 THEN t ELSE 'job' END AS kind FROM k),
walk(job_id, cur, depth) AS (
  SELECT job_id, nxt, 1 FROM b WHERE nxt IS NOT NULL
  UNION ALL
  SELECT w.job_id, b.nxt, w.depth + 1 FROM walk w JOIN b ON w.cur = b.job_id
  WHERE b.nxt IS NOT NULL AND w.depth <= (SELECT count(*) FROM b)),
last AS (SELECT job_id, arg_max(cur, depth) AS cur, max(depth) AS d FROM walk GROUP BY job_id)
SELECT b.job_id, CASE WHEN b.kind IS NOT NULL THEN b.kind
                      WHEN l.d > (SELECT count(*) FROM b) THEN 'job'
                      ELSE coalesce(t.kind, 'job') END AS kind
FROM b LEFT JOIN last l ON b.job_id = l.job_id LEFT JOIN b t ON l.cur = t.job_id""")
def job_kinds(spark, sf_dir):
    """LOG-10 over lineitem read as job steps (closed lines are nested-job steps)."""
    li = scan(spark, sf_dir, "lineitem")
    steps = li.select(
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(F.lit("job")).alias("step_type"),
        F.col("l_partkey").alias("target_job_id"),
    )
    return job_kind(steps)


@register("job_cycles", """
WITH RECURSIVE e AS (
  SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
SELECT DISTINCT CAST(src AS BIGINT) AS job_id FROM reach WHERE src = dst""")
def job_cycles(spark, sf_dir):
    """LOG-11 over a graph derived by joins: customer nation -> supplier nation."""
    li, o = scan(spark, sf_dir, "lineitem"), scan(spark, sf_dir, "orders")
    c, s = scan(spark, sf_dir, "customer"), scan(spark, sf_dir, "supplier")
    edges = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey)
             .select(c.c_nationkey.cast("long").alias("job_id"), s.s_nationkey.cast("long").alias("child_id")))
    return find_cycles(edges)


# ------------------------------------------------------------------ streaming

@register("stream_replay", """
SELECT event_id, event_type, value FROM events""")
def stream_replay(spark, sf_dir):
    """A batch that is run again after a crash (its commit mark is lost) adds no row."""
    from sluice.streaming.ingest import ingest_folder

    root, cols = workdir(spark), ["event_id", "event_type", "value"]
    inbox, t, ck = f"{root}/inbox", tname("ev_replay"), f"{root}/ck"
    ev = scan(spark, sf_dir, "events").select(*cols)
    opts = LoadOptions(mode="append", location_root=root)
    for k, part in enumerate((F.col("value") < 30, F.col("value") >= 30)):
        export_frame(ev.where(part), inbox, f"batch{k}", ExportOptions(fmt="csv"))
        ingest_folder(spark, f"{inbox}/*", cols, t, ck, load_options=opts).awaitTermination()
        delete(spark, f"{ck}/commits/{k}")
        ingest_folder(spark, f"{inbox}/*", cols, t, ck, load_options=opts).awaitTermination()
    spark.catalog.refreshTable(t)
    return spark.table(t)


@register("stream_ingest", "SELECT event_id, event_type, value FROM events")
def stream_ingest(spark, sf_dir):
    from sluice.streaming.ingest import ingest_folder

    root = workdir(spark)
    inbox, t = f"{root}/inbox", tname("ev_stream")
    ev = scan(spark, sf_dir, "events").select("event_id", "event_type", "value")
    cols = ["event_id", "event_type", "value"]
    # two arrivals of files into one folder; one checkpoint: each file is taken once
    opts = LoadOptions(mode="append", location_root=root)
    export_frame(ev.where(F.col("event_type").isin("view", "click")), inbox, "batch1", ExportOptions(fmt="csv"))
    ingest_folder(spark, f"{inbox}/*", cols, t, f"{root}/ck", load_options=opts).awaitTermination()
    export_frame(ev.where(~F.col("event_type").isin("view", "click")), inbox, "batch2", ExportOptions(fmt="csv"))
    ingest_folder(spark, f"{inbox}/*", cols, t, f"{root}/ck", load_options=opts).awaitTermination()
    spark.catalog.refreshTable(t)
    return spark.table(t)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
