"""Workbook fixtures I4, I9, I10 and the workbook sink (E1, E5)."""
import os

from pyspark.sql import functions as F

from sluice.operators.export import export_frame
from sluice.options import ExportOptions, ReadOptions
from sluice.plans.importer import ImportSettings, import_path
from sluice.sources.workbook import read_sheet, sheet_names, write_xlsx_sheets


def test_i4_sheet_by_name_with_column_filter(spark, tmp_dir):
    p = os.path.join(tmp_dir, "qa.xlsx")
    write_xlsx_sheets(p, [("Other", ["x"], [["1"]]), ("SheetA", ["Code", "Value"], [["A", 1], ["B", 2]])])
    assert sheet_names(p) == ["Other", "SheetA"]
    r = import_path(spark, p, ImportSettings.from_fields(
        {"importMode": "rebuild", "tableName": "t_i4", "sheetName": "SheetA", "columnFilter": "Code"}))[0]
    assert r.result.rows_written == 2
    assert spark.table("t_i4").columns == ["code"]
    r = import_path(spark, p, ImportSettings.from_fields(
        {"importMode": "rebuild", "tableName": "t_i4b", "sheetFilterMode": "index", "sheetName": "2", "sheetNameField": "sh"}))[0]
    assert r.result.rows_written == 2 and spark.table("t_i4b").first()["sh"] == "SheetA"


def test_i9_i10_sheets(spark, tmp_dir):
    p = os.path.join(tmp_dir, "mx.xlsx")
    write_xlsx_sheets(p, [("First", ["Code", "Value"], [["A", 1]]), ("Second", ["Code", "Value"], [["B", 2.5]])])
    for sheet, table in (("First", "t_i9a"), ("Second", "t_i9b")):
        r = import_path(spark, p, ImportSettings.from_fields(
            {"importMode": "rebuild", "tableName": table, "sheetName": sheet, "sheetNameField": "sheet"}))[0]
        assert r.result.rows_written == 1
    assert spark.table("t_i9b").first()["value"] == 2.5
    assert spark.table("t_i9b").first()["sheet"] == "Second"
    res = import_path(spark, p, ImportSettings.from_fields({"importMode": "rebuild", "sheetMode": "all"}))
    assert [(r.table, r.result.rows_written) for r in res] == [("first", 1), ("second", 1)]
    res = import_path(spark, p, ImportSettings.from_fields({"importMode": "rebuild", "sheetMode": "all", "tableName": "book"}))
    assert [r.table for r in res] == ["book_first", "book_second"]


def test_index_sheet_and_values(spark, tmp_dir):
    p = os.path.join(tmp_dir, "v.xlsx")
    write_xlsx_sheets(p, [("S", ["n", "f", "b", "t"], [[1, 1.5, True, "x<y"], [None, None, None, None], [3, 2.0, False, ""]])])
    rows = list(read_sheet(p, "xl/worksheets/sheet1.xml"))
    assert rows[1] == (2, ["1", "1.5", "True", "x<y"])
    assert rows[2] == (3, [])


def test_workbook_sink(spark, tmp_dir):
    df = spark.range(1, 20001).select(F.col("id").cast("int").alias("id"), (F.col("id") % 100).alias("amount"))
    res = export_frame(df.repartition(3), tmp_dir, "large", ExportOptions(fmt="xlsx", max_records_per_file=8000))
    assert res.rows == 20000
    total = 0
    for f in res.files:
        data = list(read_sheet(f, "xl/worksheets/sheet1.xml"))
        assert data[0][1] == ["id", "amount"]
        total += len(data) - 1
    assert total == 20000
    split = export_frame(df.where("id <= 10").withColumn("city", F.when(F.col("id") < 5, "北京").otherwise("上海")),
                         tmp_dir, "people", ExportOptions(fmt="xlsx", split_field="city"))
    assert sorted({os.path.basename(os.path.dirname(f)) for f in split.files}) == ["people_上海", "people_北京"]


def test_partitions_without_rows_and_parts_of_many(spark, tmp_dir, monkeypatch):
    """A partition without rows writes nothing; more rows than a part holds go to several, in order, and come back whole."""
    from sluice.sources import workbook
    from sluice.sources.workbook import read_workbook_units

    one = export_frame(spark.range(40, numPartitions=4).where("id >= 30"), tmp_dir, "thin", ExportOptions(fmt="xlsx"))
    assert one.rows == 10 and len(one.files) == 1
    monkeypatch.setattr(workbook, "BOOK_ROWS", 300)
    many = export_frame(spark.range(1000, numPartitions=1), tmp_dir, "wide", ExportOptions(fmt="xlsx"))
    assert len(many.files) >= 3
    ids = [int(r[1][0]) for f in many.files for r in list(read_sheet(f.removeprefix("file:"), "xl/worksheets/sheet1.xml"))[1:]]
    assert ids == list(range(1000))
    raw, _, _ = next(read_workbook_units(spark, many.files, ReadOptions()))
    assert raw.count() == 1000 + len(many.files)
