"""Workbook (.xlsx/.xlsm) scan and sink (SRC-5, SRC-6, EXP-9).

Scan: a Python Data Source with one input partition per (file, sheet), so
many workbooks are read in parallel; each task unzips its file and streams
the sheet XML (cached values, not formulas).  Rows come out as
``(file, sheet, row, cells)`` and are widened to ``c1..cN`` in Spark.

Sink: every Spark partition writes its own workbook parts (a new part every
``BOOK_ROWS`` rows), row by row.  More rows than one part holds are first dealt
to as many tasks by ranges of their order, so neither writing nor reading back
is left to one task.  The target folder must be writable by the executors'
Python workers (a local or mounted shared path).
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import zipfile
from collections.abc import Iterator
from itertools import chain, count, groupby, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.functions.names import safe_sheet_name
from sluice.operators.order import BLOCK, FILE, POS
from sluice.options import ReadOptions
from sluice.session import cut
from sluice.sources.files import join_uri, open_read, open_write

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that are dates, and the sheet row limit.
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
MAX_SHEET_ROWS = 1_048_575
#: Rows of a workbook part where the export names no other number.
BOOK_ROWS = 100_000
EXCEL_EPOCH = dt.datetime(1899, 12, 30)


def _sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, member path) in workbook order."""
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels}
    out = []
    for s in wb.iter(f"{NS}sheet"):
        t = target.get(s.get(f"{REL_NS}id"), "")
        t = t.lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return out


def sheet_names(path: str) -> list[str]:
    with open_read(path) as fh, zipfile.ZipFile(fh) as zf:
        return [n for n, _ in _sheets(zf)]


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    out = []
    for si in ET.fromstring(zf.read("xl/sharedStrings.xml")).iter(f"{NS}si"):
        out.append("".join(t.text or "" for t in si.iter(f"{NS}t")))
    return out


def _date_styles(zf: zipfile.ZipFile) -> set[int]:
    """Indices of cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in zf.namelist():
        return set()
    root = ET.fromstring(zf.read("xl/styles.xml"))
    custom = {}
    for nf in root.iter(f"{NS}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code))
    out = set()
    xfs = root.find(f"{NS}cellXfs")
    for i, xf in enumerate(xfs if xfs is not None else []):
        fid = int(xf.get("numFmtId", "0"))
        if fid in DATE_FORMAT_IDS or custom.get(fid):
            out.add(i)
    return out


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n


def _number_text(v: str, is_date: bool) -> str:
    if is_date:
        moment = EXCEL_EPOCH + dt.timedelta(days=float(v))
        moment = moment.replace(microsecond=0) if moment.microsecond < 500000 else (moment + dt.timedelta(seconds=1)).replace(microsecond=0)
        return moment.isoformat(sep=" ", timespec="seconds")
    if re.fullmatch(r"-?\d+", v):
        return str(int(v))
    return str(float(v))


def read_sheet(path: str, member: str) -> Iterator[tuple[int, list[str]]]:
    """(row number, cell texts) of one sheet, gap rows included, from the first row."""
    with open_read(path) as raw, zipfile.ZipFile(raw) as zf:
        strings = _shared_strings(zf)
        dates = _date_styles(zf)
        last = None
        with zf.open(member) as fh:
            for _, el in ET.iterparse(fh):
                if el.tag != f"{NS}row":
                    continue
                r = int(el.get("r") or ((last or 0) + 1))
                cells: dict[int, str] = {}
                for c in el.iter(f"{NS}c"):
                    idx = _col_index(c.get("r", "")) or (max(cells) + 1 if cells else 1)
                    t = c.get("t", "n")
                    v = c.find(f"{NS}v")
                    text = v.text if v is not None and v.text is not None else ""
                    if t == "s" and text:
                        val = strings[int(text)]
                    elif t == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(f"{NS}t"))
                    elif t == "b":
                        val = "True" if text == "1" else ("False" if text else "")
                    elif t in ("str", "e"):
                        val = text
                    elif text:
                        val = _number_text(text, int(c.get("s", "0")) in dates)
                    else:
                        val = ""
                    cells[idx] = val
                if last is not None:
                    for gap in range(last + 1, r):
                        yield gap, []
                width = max(cells) if cells else 0
                yield r, [cells.get(i, "") for i in range(1, width + 1)]
                last = r
                el.clear()


class _SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str, member: str):
        super().__init__(None)
        self.path, self.sheet, self.member = path, sheet, member


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))
        self.sheet = options.get("sheet", "")
        self.mode = options.get("sheet_mode", "specified")
        self.by_index = options.get("sheet_by_index", "false") == "true"

    def partitions(self):
        parts = []
        for p in self.paths:
            with open_read(p) as fh, zipfile.ZipFile(fh) as zf:
                sheets = _sheets(zf)
            if self.mode == "all":
                chosen = sheets
            elif not self.sheet:
                chosen = sheets[:1]
            elif self.by_index:
                if not self.sheet.isdigit():
                    raise ValueError(f"sheet index must be a number: {self.sheet}")
                i = int(self.sheet) - 1
                if not 0 <= i < len(sheets):
                    raise ValueError(f"sheet {self.sheet} does not exist in {p}")
                chosen = [sheets[i]]
            else:
                chosen = [s for s in sheets if s[0] == self.sheet]
                if not chosen:
                    raise ValueError(f"sheet {self.sheet} does not exist in {p}")
            parts += [_SheetPartition(p, n, m) for n, m in chosen]
        return parts

    def read(self, partition):
        for r, cells in read_sheet(partition.path, partition.member):
            yield (partition.path, partition.sheet, r, cells)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls):
        return "sluice_xlsx"

    def schema(self):
        return "file string, sheet string, row long, cells array<string>"

    def reader(self, schema):
        return _Reader(self.options)


def _register(spark: SparkSession) -> None:
    from sluice.session import ship_package

    ship_package(spark)
    spark.dataSource.register(WorkbookSource)


def read_workbook(spark: SparkSession, paths: list[str], o: ReadOptions = ReadOptions()) -> DataFrame:
    """All chosen sheets as rows ``(file, sheet, row, cells)``."""
    _register(spark)
    return (
        spark.read.format("sluice_xlsx")
        .option("paths", json.dumps(list(paths)))
        .option("sheet", o.sheet or "")
        .option("sheet_mode", o.sheet_mode)
        .option("sheet_by_index", str(bool(o.sheet_by_index)).lower())
        .load()
    )


def read_workbook_units(spark: SparkSession, paths: list[str], o: ReadOptions) -> Iterator[tuple[DataFrame, None, str]]:
    """Import units: one per (file, sheet), as the contract imports sheets."""
    rows = cut(read_workbook(spark, paths, o))  # sheets are parsed once, whatever looks at their rows later
    units = rows.select("file", "sheet").distinct().collect() if o.sheet_mode == "all" else None
    if units is None:
        sheet = o.sheet
        if not sheet or o.sheet_by_index:
            names = sheet_names(paths[0])
            i = int(sheet) - 1 if sheet else 0
            sheet = names[i] if 0 <= i < len(names) else ""
        yield _widen(rows), None, sheet
        return
    for u in sorted(units, key=lambda r: (r["file"], sheet_names(r["file"]).index(r["sheet"]))):
        yield _widen(rows.where((F.col("file") == u["file"]) & (F.col("sheet") == u["sheet"]))), None, u["sheet"]


def _widen(rows: DataFrame) -> DataFrame:
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    width = max(int(width), 1)
    return rows.select(
        *[F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(1, width + 1)],
        F.concat_ws("#", "file", "sheet").alias(FILE), F.lit(0).cast("long").alias(BLOCK), F.col("row").alias(POS),
    )


# ---------------------------------------------------------------- sink

def _cell_xml(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and not (isinstance(value, float) and value != value):
        return f'<c r="{ref}"><v>{value!r}</v></c>' if isinstance(value, float) else f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _col_name(i: int) -> str:
    s = ""
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _sheet_file(tmp: str, columns: list[str], rows, header: bool) -> int:
    n = 0
    with open(tmp, "w", encoding="utf-8") as sh:
        sh.write('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
                 f'<worksheet xmlns="{NS[1:-1]}"><sheetData>')
        r = 0
        if header:
            r += 1
            sh.write(f'<row r="{r}">' + "".join(_cell_xml(f"{_col_name(i + 1)}{r}", c) for i, c in enumerate(columns)) + "</row>")
        for row in rows:
            r += 1
            n += 1
            sh.write(f'<row r="{r}">' + "".join(_cell_xml(f"{_col_name(i + 1)}{r}", v) for i, v in enumerate(row)) + "</row>")
        sh.write("</sheetData></worksheet>")
    return n


def write_xlsx_sheets(path: str, sheets: list[tuple[str, list[str], list]], header: bool = True) -> int:
    """Write one workbook with the given (name, columns, rows) sheets.

    Sheet XML is spooled to the task's own scratch space, then the zipped
    workbook is streamed to ``path`` (any file system pyarrow can open).
    """
    import tempfile

    n = 0
    tmps = []
    scratch = tempfile.mkdtemp(prefix="sluice-xlsx-")
    for i, (_, columns, rows) in enumerate(sheets):
        tmp = os.path.join(scratch, f"sheet{i}.xml")
        n += _sheet_file(tmp, columns, rows, header)
        tmps.append(tmp)
    ct = "".join(
        f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" '
        'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        for i in range(len(sheets)))
    entries = "".join(
        f'<sheet name="{escape(safe_sheet_name(name), {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>'
        for i, (name, _, _) in enumerate(sheets))
    rels = "".join(
        f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
        f'Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
    book = os.path.join(scratch, "book.xlsx")
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("[Content_Types].xml",
                    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                    '<Default Extension="xml" ContentType="application/xml"/>'
                    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                    + ct + '</Types>')
        zf.writestr("_rels/.rels",
                    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                    '</Relationships>')
        zf.writestr("xl/workbook.xml",
                    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                    f'<workbook xmlns="{NS[1:-1]}" xmlns:r="{REL_NS[1:-1]}"><sheets>{entries}</sheets></workbook>')
        zf.writestr("xl/_rels/workbook.xml.rels",
                    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                    + rels + '</Relationships>')
        for i, tmp in enumerate(tmps):
            zf.write(tmp, f"xl/worksheets/sheet{i + 1}.xml")
    with open(book, "rb") as src, open_write(path) as dst:
        while chunk := src.read(1 << 20):
            dst.write(chunk)
    for f in [*tmps, book]:
        os.remove(f)
    os.rmdir(scratch)
    return n


def write_xlsx(path: str, sheet: str, columns: list[str], rows, header: bool = True) -> int:
    """Write one workbook with one sheet; returns the data rows written."""
    return write_xlsx_sheets(path, [(sheet, columns, rows)], header)


def write_workbooks(df: DataFrame, path: str, o, partition: bool) -> list[str]:
    """EXP-9: each Spark partition writes workbook parts into folder ``path``
    (per split value a sub-folder ``{stem}_{value}``).  Returns the files."""
    from sluice.operators.export import PART_COLUMN

    folder = path
    stem = folder.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    cols = [c for c in df.columns if c != PART_COLUMN]
    sheet = o.sheet_name or stem
    header = bool(o.header)
    cap = min(int(o.max_records_per_file or BOOK_ROWS), MAX_SHEET_ROWS)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        def keyed():
            for pdf in batches:
                keys = pdf[PART_COLUMN].astype(str) if partition else [""] * len(pdf)
                for k, row in zip(keys, pdf[cols].itertuples(index=False, name=None)):
                    yield k, tuple(None if (isinstance(v, float) and v != v) or v is pd.NaT else (v.item() if hasattr(v, "item") else v) for v in row)

        task = f"{TaskContext.get().partitionId():05d}"  # a repeated task writes the same names
        for k, group in groupby(keyed(), lambda pair: pair[0]):
            target = join_uri(folder, f"{stem}_{k}") if partition else folder
            rows = (row for _, row in group)
            for j in count():
                first = list(islice(rows, 1))
                if not first:
                    break
                f = join_uri(target, f"part-{task}-{j:05d}.xlsx")
                n = write_xlsx(f, sheet, cols, chain(first, islice(rows, cap - 1)), header)
                yield pd.DataFrame({"file": [f], "rows": [n]})

    if partition:
        df = df.sortWithinPartitions(PART_COLUMN)
    elif (parts := -(-df.count() // BOOK_ROWS)) > 1:
        df = df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(parts, "__at").sortWithinPartitions("__at").drop("__at")
    from sluice.session import ship_package

    ship_package(df.sparkSession)
    written = df.mapInPandas(run, "file string, rows long").collect()
    return sorted(r["file"] for r in written)
