"""Import fixtures I1-I14 (workbook ones in test_workbook.py)."""
import json
import os

import pytest

from sluice.options import LoadOptions, ReadOptions
from sluice.plans.importer import ImportSettings, checkpoint_rows, import_path, import_together, resume_key, set_checkpoint


def write(path, text, bom=False):
    with open(path, "wb") as fh:
        fh.write((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))
    return path


I1_FIELDS = {
    "mapping": json.dumps([
        {"sourceIndex": 0, "target": "Name", "matchKey": True},
        {"sourceIndex": 1, "target": "Amount", "defaultValue": "0"},
        {"sourceIndex": 2, "target": "Dept"},
    ]),
    "trimValues": "true", "zeroForNumber": "true", "dedupeColumns": "Name", "autoPkField": "id",
    "importTimeField": "imported_at", "sheetNameField": "source_name", "fixedValueField": "batch",
    "fixedValue": "batch1",
}


def run(spark, path, fields):
    return import_path(spark, path, ImportSettings.from_fields(fields))


def test_i1_i2_rebuild_then_update(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "qa.csv"), "Name,Amount,Dept\n Alice ,10,Sales\nBob,,Sales\nBob,,Sales\n", bom=True)
    r = run(spark, p, {**I1_FIELDS, "importMode": "rebuild", "tableName": "t_i1"})[0]
    assert r.status == "success" and r.result.rows_written == 2 and r.result.rows_skipped == 1
    rows = spark.table("t_i1").orderBy("id").collect()
    assert [(x.id, x.name, x.amount, x.dept, x.source_name, x.batch) for x in rows] == [
        (1, "Alice", 10, "Sales", "qa", "batch1"), (2, "Bob", 0, "Sales", "qa", "batch1")]
    write(p, "Name,Amount,Dept\nAlice,99,Ops\nCarol,12,Ops\n")
    r = run(spark, p, {**I1_FIELDS, "importMode": "update", "tableName": "t_i1"})[0]
    assert (r.result.rows_inserted, r.result.rows_updated) == (1, 1)
    got = sorted((x.name, x.amount, x.dept, x.batch) for x in spark.table("t_i1").collect())
    assert got == [("Alice", 99, "Ops", "batch1"), ("Bob", 0, "Sales", "batch1"), ("Carol", 12, "Ops", "batch1")]


def test_i5_after_each_sql(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "mx.csv"), "Name,Amount,Dept\n Alice ,10,Sales\nBob,,Sales\nBob,,Sales\n")
    sql = "CREATE TABLE IF NOT EXISTS mx_sql_marker (name STRING) USING parquet; INSERT INTO mx_sql_marker VALUES ('done')"
    r = run(spark, p, {**I1_FIELDS, "importMode": "rebuild", "tableName": "t_i5", "afterEachSql": sql})[0]
    assert (r.result.rows_written, r.result.rows_skipped) == (2, 1)
    assert spark.table("mx_sql_marker").count() >= 1


def test_i3_i7_json(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "qa.json"),
              json.dumps([{"city": "Shanghai", "qty": 3}, {"city": "Beijing", "qty": 5}], indent=2))
    r = run(spark, p, {"importMode": "rebuild", "tableName": "t_i3"})[0]
    assert r.result.rows_written == 2
    p = write(os.path.join(tmp_dir, "mx.json"),
              json.dumps([{"city": "A", "qty": 1, "extra": {"level": "x"}}, {"city": "B", "qty": 2, "extra": {"level": "y"}}]))
    r = run(spark, p, {"importMode": "rebuild", "tableName": "t_i7"})[0]
    assert r.result.rows_written == 2
    assert spark.table("t_i7").columns == ["city", "qty", "extra_level"]


def test_i8_xml(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "mx.xml"),
              "<?xml version='1.0'?><rows><row><name>A</name><qty>1</qty></row><row><name>B</name><qty>2</qty></row></rows>")
    r = run(spark, p, {"importMode": "rebuild", "tableName": "t_i8", "rowTag": "row"})[0]
    assert r.result.rows_written == 2
    assert sorted(tuple(x) for x in spark.table("t_i8").collect()) == [("A", 1), ("B", 2)]


def test_i11_pinyin_names(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "员工.csv"), "姓名,金额\n张三,8\n", bom=True)
    r = run(spark, p, {"importMode": "rebuild", "tablePinyin": "true", "fieldPinyin": "true"})[0]
    assert r.table == "yg"
    assert spark.table("yg").columns == ["xm", "je"]


def test_i12_row_delimiter(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "mx_pipe.csv"), "Name,Amount|A,1|B,2|")
    r = run(spark, p, {"importMode": "rebuild", "tableName": "t_i12", "lineDelimiter": "|"})[0]
    assert r.result.rows_written == 2


def test_i13_date_column(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "mx_date.csv"), "Name,When\nA,2026/07/06\n")
    r = run(spark, p, {"importMode": "rebuild", "tableName": "t_i13", "dateColumns": "WHEN:%Y/%m/%d"})[0]
    assert r.result.rows_written == 1
    assert spark.table("t_i13").first()["when"] == "2026-07-06 00:00:00"


def test_date_mismatch_fails_the_file(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "bad_date.csv"), "Name,When\nA,06.07.2026\n")
    with pytest.raises(ValueError, match="all files failed"):
        run(spark, p, {"importMode": "rebuild", "tableName": "t_bad", "dateColumns": "When:%Y/%m/%d"})


def test_i14_resume(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "mx_resume.csv"), "Name,Amount\nA,1\nB,2\nC,3\n")
    fields = {"importMode": "append", "tableName": "t_i14", "resumeImport": "true"}
    spark.createDataFrame([("A", 1)], "name string, amount long").write.saveAsTable("t_i14")
    key = resume_key(spark, "file:" + p if not p.startswith("file:") else p, "t_i14", "append")
    set_checkpoint(spark, key, 1)
    r = run(spark, p, fields)[0]
    assert r.result.rows_written == 2
    assert sorted(x.name for x in spark.table("t_i14").collect()) == ["A", "B", "C"]
    assert checkpoint_rows(spark, key) == 0


def test_shape_options(spark, tmp_dir):
    text = "title line\n\nName,Amount\nA,1\n , \nB,2\nC,3\nD,4\ntotal,10\n"
    p = write(os.path.join(tmp_dir, "shape.csv"), text)
    fields = {"importMode": "rebuild", "tableName": "t_shape", "headerRow": "2", "skipTailRows": "1",
              "importRowCount": "2", "trimValues": "true"}
    r = run(spark, p, fields)[0]
    assert r.result.rows_written == 2
    assert sorted(x.name for x in spark.table("t_shape").collect()) == ["A", "B"]


def test_append_policies_and_schema_evolution(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "pol.csv"), "Name,Amount\nA,1\n")
    run(spark, p, {"importMode": "append", "tableName": "t_pol"})
    r = run(spark, p, {"importMode": "append", "tableName": "t_pol", "existingTablePolicy": "suffix"})[0]
    assert r.table == "t_pol_2"
    r = run(spark, p, {"importMode": "append", "tableName": "t_pol", "existingTablePolicy": "skip"})[0]
    assert r.result.rows_written == 0 and r.result.rows_skipped == 1
    write(p, "Name,Amount,City\nB,2,X\n")
    with pytest.raises(ValueError):
        run(spark, p, {"importMode": "append", "tableName": "t_pol", "autoExpand": "false"})
    run(spark, p, {"importMode": "append", "tableName": "t_pol"})
    assert sorted((x.name, x.city) for x in spark.table("t_pol").collect()) == [("A", None), ("B", "X")]


def test_fill_down_and_blank_options(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "fd.csv"), "Region,Item,Qty\nNorth,a,1\n,b,-\n,c,\nSouth,d,2\n,e,N/A\n")
    fields = {"importMode": "rebuild", "tableName": "t_fd", "fillDownColumns": "region",
              "blankCellValues": "-,N/A", "replaceBlankWith": "none", "typeMode": "text"}
    run(spark, p, fields)
    got = sorted(tuple(x) for x in spark.table("t_fd").collect())
    assert got == [("North", "a", "1"), ("North", "b", "none"), ("North", "c", "none"),
                   ("South", "d", "2"), ("South", "e", "none")]


def test_multi_file_folder(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Name,Amount\nA,1\n")
    write(os.path.join(d, "b.csv"), "Name,Amount\nB,2\nC,3\n")
    write(os.path.join(d, "notes.md"), "ignored")
    res = run(spark, d, {"importMode": "append", "tableName": "t_many"})
    assert [r.file_name for r in res] == ["a.csv", "b.csv"]
    assert spark.table("t_many").count() == 3


def test_import_together_one_scan(spark, tmp_dir):
    d = os.path.join(tmp_dir, "together")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Name,Amount\nA,1\nA,1\nB,\n")
    write(os.path.join(d, "b.csv"), "Name,Amount\nA,5\n,6\nC,7\n")
    s = ImportSettings.from_fields({"importMode": "rebuild", "tableName": "t_tog", "dedupeColumns": "name",
                                    "fillDownColumns": "name", "autoPkField": "id"})
    res, counts = import_together(spark, d, s, per_file_counts=True)
    assert res.rows_written == 4 and res.rows_skipped == 2
    got = sorted((r.id, r.name, r.amount) for r in spark.table("t_tog").collect())
    assert got == [(1, "A", 1), (1, "A", 5), (2, "B", None), (2, "C", 7)]
    per = {r["__file"].rsplit("/", 1)[-1]: r["rows"] for r in counts.collect()}
    assert per == {"a.csv": 2, "b.csv": 2}


def test_declared_options(spark, tmp_dir):
    d = os.path.join(tmp_dir, "dcl")
    os.makedirs(os.path.join(d, "sub"))
    write(os.path.join(d, "a.csv"), "Name,When,Extra\nA,2026-01-02,x\n")
    write(os.path.join(d, "sub", "b.csv"), "Name,When,Extra\nB,2026-01-03 04:05:06,y\n")
    res = run(spark, d, {"importMode": "append", "tableName": "t_dcl", "includeSubfolders": "true", "typeMode": "auto_dates"})
    assert [r.file_name for r in res] == ["a.csv", "b.csv"]
    assert spark.table("t_dcl").schema["when"].dataType.simpleString() == "timestamp_ntz"
    write(os.path.join(d, "c.csv"), "Who,At,More\nC,2026-01-04,z\n")
    run(spark, os.path.join(d, "c.csv"), {"importMode": "append", "tableName": "t_dcl", "matchColumnsBy": "order"})
    write(os.path.join(d, "e.csv"), "Name,Other\nE,q\n")
    run(spark, os.path.join(d, "e.csv"), {"importMode": "append", "tableName": "t_dcl", "extraColumns": "ignore"})
    got = sorted((r.name, r.extra) for r in spark.table("t_dcl").collect())
    assert got == [("A", "x"), ("B", "y"), ("C", "z"), ("E", None)]
    assert spark.table("t_dcl").columns == ["name", "when", "extra"]


def test_update_with_empty_numeric_cell(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "upd.csv"), "Name,Amount\nA,1\nB,2\n")
    run(spark, p, {"importMode": "rebuild", "tableName": "t_upd"})
    write(p, "Name,Amount\nA,\nC,+3\nC,4\n")
    r = run(spark, p, {"importMode": "update", "tableName": "t_upd"})[0]
    assert r.status == "success", r.message
    assert (r.result.rows_inserted, r.result.rows_updated) == (1, 2)
    assert sorted(tuple(x) for x in spark.table("t_upd").collect()) == [("A", None), ("B", 2), ("C", 4)]


def test_failure_isolation_and_delete_after_success(spark, tmp_dir):
    d = os.path.join(tmp_dir, "iso")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Name,When\nA,2026/01/02\n")
    write(os.path.join(d, "b.csv"), "Name,When\nB,not a date\n")
    write(os.path.join(d, "c.csv"), "Name,When\nC,2026/01/03\n")
    res = run(spark, d, {"importMode": "append", "tableName": "t_iso", "dateColumns": "When:%Y/%m/%d",
                         "deleteAfterSuccess": "true"})
    assert [(r.file_name, r.status) for r in res] == [("a.csv", "success"), ("b.csv", "failed"), ("c.csv", "success")]
    assert "b.csv" in os.listdir(d) and "a.csv" not in os.listdir(d)
    assert sorted(r.name for r in spark.table("t_iso").collect()) == ["A", "C"]


def test_parallel_files_distinct_tables(spark, tmp_dir):
    d = os.path.join(tmp_dir, "par")
    os.makedirs(d)
    for i in range(4):
        write(os.path.join(d, f"p{i}.csv"), "Name,Amount\n" + "".join(f"n{j},{j}\n" for j in range(i + 1)))
    s = ImportSettings.from_fields({"importMode": "rebuild", "tablePrefix": "par_"})
    s.parallel_files = 4
    res = import_path(spark, d, s)
    assert [(r.file_name, r.table, r.result.rows_written) for r in res] == [
        (f"p{i}.csv", f"par_p{i}", i + 1) for i in range(4)]
