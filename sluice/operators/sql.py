"""SQL operators (SQL-1..5, SRC-14).

SQL-1 guards by the *parsed plan*, not by the first word: the statement is
parsed by Spark's own parser and accepted only if no node of the plan is a
command or a write.  Catalyst then analyzes and optimizes as usual.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.totext import as_text_frame

# Result cap of the read-only query and preview size.
QUERY_ROW_CAP = 1000
PREVIEW_ROWS = 20

# Parsed-plan classes that only read metadata.
READ_ONLY_COMMANDS = {
    "ShowTables", "ShowViews", "ShowColumns", "ShowNamespaces", "ShowFunctions",
    "ShowPartitions", "ShowCreateTable", "ShowTableExtended", "ShowTableProperties",
    "DescribeRelation", "DescribeColumn", "DescribeNamespace", "DescribeFunction",
    "ExplainCommand", "ShowCatalogsCommand", "ShowCurrentNamespaceCommand",
}
# Parsed-plan classes that write or change state.
WRITE_PLANS = {
    "InsertIntoStatement", "DeleteFromTable", "UpdateTable", "MergeIntoTable",
    "CreateTable", "CreateTableAsSelect", "ReplaceTable", "ReplaceTableAsSelect",
    "DropTable", "DropView", "CreateView", "CreateViewStatement", "AlterViewAs",
    "TruncateTable", "SetCommand", "ResetCommand", "CacheTable", "CacheTableAsSelect",
    "UncacheTable", "RefreshTable", "SetCatalogAndNamespace", "AddColumns",
    "RenameTable", "DropColumns", "AlterColumns", "RenameColumn", "SetTableProperties",
    "OverwriteByExpression", "OverwritePartitionsDynamic", "AppendData",
}


class ReadOnlyViolation(ValueError):
    pass


def _plan_nodes(plan):
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        children = node.children()
        for i in range(children.size()):
            stack.append(children.apply(i))
        inner = node.innerChildren()
        for i in range(inner.size()):
            child = inner.apply(i)
            if hasattr(child, "children"):
                stack.append(child)


def check_read_only(spark: SparkSession, sql_text: str) -> str:
    text = sql_text.strip().rstrip(";").strip()
    if not text:
        raise ReadOnlyViolation("empty statement")
    if split_statements(text) != [text]:
        raise ReadOnlyViolation("only one statement is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    top = plan.getClass().getSimpleName()
    if top in READ_ONLY_COMMANDS:
        return text
    for node in _plan_nodes(plan):
        name = node.getClass().getSimpleName()
        if name in WRITE_PLANS or (command.isInstance(node) and name not in READ_ONLY_COMMANDS):
            raise ReadOnlyViolation(f"only read-only statements are allowed (found {name})")
    return text


def read_only_query(spark: SparkSession, sql_text: str, cap: int = QUERY_ROW_CAP) -> tuple[list[str], list[list[str]], bool]:
    """SQL-1: run a guarded query; at most ``cap`` rows as text plus a truncated flag."""
    text = check_read_only(spark, sql_text)
    df = spark.sql(text)
    rows = as_text_frame(df.limit(cap + 1)).collect()
    return df.columns, [list(r) for r in rows[:cap]], len(rows) > cap


def split_statements(text: str) -> list[str]:
    """SQL-2 splitter: ``;`` outside quotes, backticks and comments."""
    out, buf, i, n = [], [], 0, len(text)
    quote = None
    while i < n:
        ch = text[i]
        if quote:
            buf.append(ch)
            if ch == "\\" and quote in "'\"" and i + 1 < n:
                buf.append(text[i + 1])
                i += 2
                continue
            if ch == quote:
                quote = None
            i += 1
            continue
        if ch in "'\"`":
            quote = ch
            buf.append(ch)
        elif text.startswith("--", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            buf.append(text[i:j])
            i = j
            continue
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            buf.append(text[i:j])
            i = j
            continue
        elif ch == ";":
            stmt = "".join(buf).strip()
            if stmt:
                out.append(stmt)
            buf = []
        else:
            buf.append(ch)
        i += 1
    stmt = "".join(buf).strip()
    if stmt:
        out.append(stmt)
    return [s for s in out if re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()]


def _written_rows(df: DataFrame) -> int:
    """Rows a write command reported (``numOutputRows``), 0 when none."""
    try:
        plan = df._jdf.queryExecution().executedPlan()
        if plan.getClass().getSimpleName() == "CommandResultExec":
            plan = plan.commandPhysicalPlan()
        stack = [plan]
        while stack:
            node = stack.pop()
            metrics = node.metrics()
            if metrics.contains("numOutputRows"):
                return int(metrics.apply("numOutputRows").value())
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
    except Exception:  # noqa: BLE001 - metrics are informational
        pass
    return 0


def execute_batch(spark: SparkSession, text: str, affected: bool = False) -> int:
    """SQL-2: run statements in order.  Returns the number run, or with
    ``affected`` the rows that write statements reported and queries returned."""
    n = rows = 0
    for stmt in split_statements(text or ""):
        df = spark.sql(stmt)  # commands run eagerly; a bare query has no effect to wait for
        n += 1
        if affected:
            rows += df.count() if df.columns else _written_rows(df)
    return rows if affected else n


def where(df: DataFrame, clause: str) -> DataFrame:
    """SQL-3: a free predicate, optional leading ``where`` removed."""
    clause = re.sub(r"^\s*where\s+", "", clause or "", flags=re.I).strip()
    return df.where(clause) if clause else df


def project(df: DataFrame, fields) -> DataFrame:
    """SQL-4: the listed fields in order, else all."""
    fields = [f for f in fields if f]
    return df.select(*[F.col("`" + f.replace("`", "``") + "`") for f in fields]) if fields else df


def source_frame(spark: SparkSession, *, table: str = "", sql: str = "", fields=(), where_clause: str = "") -> DataFrame:
    """SRC-14 / EXP source: a query, or a table with field list and predicate."""
    if sql.strip():
        return spark.sql(sql.strip().rstrip(";"))
    if not table:
        raise ValueError("a table or a query is required")
    return project(where(spark.table("`" + table.replace("`", "``") + "`"), where_clause), fields)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> tuple[list[str], list[list[str]]]:
    """SQL-5 / SHP-9: the first rows as text."""
    rows = as_text_frame(df.limit(n)).collect()
    return df.columns, [list(r) for r in rows]
