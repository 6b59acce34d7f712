"""Text files judged by all their bytes: charsets, quoted line breaks, blank lines, in many splits."""
import csv
import io
import os
import random

import pytest

from sluice.operators.order import number_rows
from sluice.options import ReadOptions
from sluice.plans.importer import ImportSettings, import_path, import_together
from sluice.sources.delimited import read_delimited
from sluice.sources.files import SourceError
from sluice.sources.text_probe import ends_inside


@pytest.fixture()
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def rows_of(spark, paths, **options):
    df = number_rows(read_delimited(spark, paths, ReadOptions(**options)))
    cells = [c for c in df.columns if not c.startswith("__")]
    return [tuple(r) for r in df.orderBy("__file", "__rn").select(*cells).collect()]


def padded(rows):
    width = max(len(r) for r in rows)
    return [tuple(r) + ("",) * (width - len(r)) for r in rows]


def test_states_agree_with_the_csv_module():
    rng = random.Random(4)
    for _ in range(4000):
        lines = ["".join(rng.choice('ab,"" ') for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        inside, records = False, 0
        for line in lines:
            inside = ends_inside(line, ",", inside)
            records += not inside
        assert records + inside == len(list(csv.reader([line + "\n" for line in lines]))), lines


def test_charset_comes_from_all_bytes(spark, tmp_dir):
    late = put(tmp_dir, "late.csv", b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(12_000)) + "12000,苹果\n".encode("gbk"))
    assert os.path.getsize(late) > 1 << 16
    utf8 = put(tmp_dir, "utf8.csv", "id,name\n1,é苹\n".encode("utf-8-sig"))
    wide = put(tmp_dir, "wide.csv", "id,name\n1,㐀é\n".encode("gb18030"))
    got = {os.path.basename(p): rows_of(spark, [p]) for p in (late, utf8, wide)}
    assert got["late.csv"][-1] == ("12000", "苹果") and len(got["late.csv"]) == 12_002
    assert got["utf8.csv"] == [("id", "name"), ("1", "é苹")] and got["wide.csv"][1] == ("1", "㐀é")
    together = rows_of(spark, [utf8, wide, late])
    assert len(together) == 12_006 and ("1", "㐀é") in together and ("12000", "苹果") in together and ("1", "é苹") in together


def test_undecodable_files_fail(spark, tmp_dir):
    mixed = put(tmp_dir, "mixed.csv", "a,苹\n".encode("gbk") + "a,￿\n".encode() + b"\xff\xff\n")
    with pytest.raises(SourceError, match="mixed.csv"):
        rows_of(spark, [mixed])
    latin = put(tmp_dir, "latin.csv", "a,é\n".encode("latin-1"))
    with pytest.raises(SourceError):
        rows_of(spark, [latin], encoding="utf-8")
    assert rows_of(spark, [latin], encoding="latin-1") == [("a", "é")]
    good = put(tmp_dir, "good.csv", b"k,v\n1,2\n")
    done = import_path(spark, tmp_dir, ImportSettings.from_fields({"importMode": "rebuild"}))
    assert {r.file_name: r.status for r in done}["mixed.csv"] == "failed" and {r.file_name: r.status for r in done}[os.path.basename(good)] == "success"


def test_each_file_has_its_own_delimiter(spark, tmp_dir):
    a, b = put(tmp_dir, "a.csv", b"k;v\n1;x,y\n"), put(tmp_dir, "b.csv", b"k,v\n2,z\n3,w\n")
    assert rows_of(spark, [a, b]) == [("k", "v"), ("1", "x,y"), ("k", "v"), ("2", "z"), ("3", "w")]


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_in_many_splits(spark, tmp_dir, tiny_splits, encoding, end):
    rng = random.Random(7)
    cells = ["", "a", "苹果", "x\ny", "\n", 'say "hi"', "a,b", "line one\nline two\n\nline four, and a long one that fills more than one split\nend", 'q"', "plain text"]
    data = [[rng.choice(cells) if rng.random() < 0.4 else f"r{i}c{k}" for k in range(rng.randint(1, 4))] for i in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(data)
    text = out.getvalue() + f'5" pipe,"last'  # a stray quote, and a cell that is never closed
    path = put(tmp_dir, "q.csv", text.encode(encoding))
    want = padded(list(csv.reader(io.StringIO(text, newline=""))))
    want = [r for r in want if any(c.strip() for c in r)]
    got = [r for r in rows_of(spark, [path], delimiter=",") if any(c.strip() for c in r)]
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 20
    assert [tuple(c for c in r) for r in got] == [r[:len(got[0])] for r in want]


def test_a_cell_longer_than_many_splits(spark, tmp_dir, tiny_splits):
    text = 'a,"' + "\n".join(f"line {i} of the cell" for i in range(40)) + '",z\nb,c,d\n"e\nf",g,h\n'
    path = put(tmp_dir, "long.csv", text.encode())
    assert rows_of(spark, [path], delimiter=",") == [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))]


def test_blank_lines_are_rows_when_asked(spark, tmp_dir):
    path = put(tmp_dir, "blank.csv", b"k,v\n\n1,2\n  \n,\n3,4\n")
    fields = {"importMode": "rebuild", "tableName": "t_blank_rows", "deleteEmptyRows": "0"}
    assert import_path(spark, path, ImportSettings.from_fields(fields))[0].result.rows_written == 5
    assert import_path(spark, path, ImportSettings.from_fields(fields | {"deleteEmptyRows": "1"}))[0].result.rows_written == 2


def test_import_with_breaks_and_empty_rows(spark, tmp_dir, tiny_splits):
    for k in range(3):
        put(tmp_dir, f"f{k}.csv", ("id,text\n" + "".join(f'{k}{i:02d},"a\nb {i}"\n\n' if i % 3 else f"{k}{i:02d},plain\n" for i in range(20))).encode())
    s = ImportSettings.from_fields({"importMode": "rebuild", "tableName": "t_breaks", "autoPk": "n"})
    res, _ = import_together(spark, tmp_dir, s)
    assert res.rows_written == 60
    got = {r["id"]: r["text"] for r in spark.table("t_breaks").collect()}
    assert got[1] == "a\nb 1" and got[203] == "plain" and len(got) == 60


def test_headers_load_in_groups_and_one_bad_file_is_reported(spark, tmp_dir):
    put(tmp_dir, "a.csv", b"id,name\n1,x\n")
    put(tmp_dir, "b.csv", b"name,id,extra\ny,2,e\n")
    put(tmp_dir, "c.csv", b"\n\nid,name\n3,z\n")
    put(tmp_dir, "bad.csv", b"\xff\xff\xff\n")
    res, counts = import_together(spark, tmp_dir, ImportSettings.from_fields({"importMode": "rebuild", "tableName": "t_headers"}), per_file_counts=True)
    assert res.rows_written == 3 and [os.path.basename(f) for f in res.failed] == ["bad.csv"]
    assert sorted((r["id"], r["name"], r["extra"]) for r in spark.table("t_headers").collect()) == [(1, "x", None), (2, "y", "e"), (3, "z", None)]
    assert {os.path.basename(r[0]): r[1] for r in counts.collect()} == {"a.csv": 1, "b.csv": 1, "c.csv": 1}


def test_many_files_are_sniffed_by_tasks(spark, tmp_dir, monkeypatch):
    """Each of many files keeps its own delimiter and charset, without a look by the driver."""
    from sluice.sources import files

    for i in range(files.DRIVER_FILES + 6):
        sep, name = (",", "plain") if i % 2 else (";", "名 字")
        with open(f"{tmp_dir}/{name} {i}.csv", "w", encoding="utf-8" if i % 3 else "gbk") as fh:
            fh.write(f"a{sep}b\n{i}{sep}零{i}\n")
    monkeypatch.setattr(files, "sniff_file", lambda *_: pytest.fail("the driver sniffed a small file"))
    rows = read_delimited(spark, files.list_files(spark, tmp_dir)).where("c1 <> 'a'").select("c1", "c2").collect()
    assert sorted((int(r[0]), r[1]) for r in rows) == [(i, f"零{i}") for i in range(files.DRIVER_FILES + 6)]


def test_quoted_breaks_are_joined_once(spark, tmp_dir):
    """Lines become records in one pass, whatever looks at the records later."""
    from sluice.sources.text_probe import records

    with open(f"{tmp_dir}/a.csv", "w") as fh:
        fh.write('a,b\n1,"x\ny"\n2,z\n')
    rows = records(spark, [f"{tmp_dir}/a.csv"], ",", "utf-8", "\n")
    assert "MapInArrow" not in str(rows._jdf.queryExecution().optimizedPlan())
    assert sorted(r.record for r in rows.collect()) == ['1,"x\ny"', "2,z", "a,b"]
