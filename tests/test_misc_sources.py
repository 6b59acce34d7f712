"""Encoding probe (GBK), import preview, import log, post-load export."""
import os

from sluice.plans.importer import ImportSettings, import_path, preview_import
from sluice.sources.files import guess_encoding, sniff_delimiter


def test_detect_and_read_gbk(spark, tmp_dir):
    p = os.path.join(tmp_dir, "gbk.csv")
    with open(p, "wb") as fh:
        fh.write("名称;数量\n苹果;3\n香蕉;5\n".encode("gbk"))
    assert guess_encoding(open(p, "rb").read()) == "gbk"
    assert sniff_delimiter("a;b\n1;2\n") == ";"
    r = import_path(spark, p, ImportSettings.from_fields({"importMode": "rebuild", "tableName": "t_gbk"}))[0]
    assert r.status == "success", r.message
    assert sorted(tuple(x) for x in spark.table("t_gbk").collect()) == [("苹果", 3), ("香蕉", 5)]


def test_preview_log_and_export(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pv.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("Name,Amount\n" + "".join(f"n{i},{i}\n" for i in range(30)))
    s = ImportSettings.from_fields({"importMode": "rebuild", "autoPkField": "id"})
    pv = preview_import(spark, p, s)
    assert pv["columns"] == ["id", "name", "amount"] and len(pv["rows"]) == 20 and pv["total"] == 30
    assert pv["rows"][0] == ["1", "n0", "0"] and pv["table"] == "pv"
    out = os.path.join(tmp_dir, "out")
    s = ImportSettings.from_fields({"importMode": "rebuild", "exportSql": "select count(*) as n from pv",
                                    "exportFolder": out})
    s.log_table = "import_log_test"
    import_path(spark, p, s)
    log = spark.table("import_log_test").first()
    assert (log.file_name, log.table_name, log.rows_written, log.status) == ("pv.csv", "pv", 30, "success")
    assert any(f.endswith(".xlsx") for _, _, fs in os.walk(out) for f in fs)


def test_pretty_printed_documents(spark, tmp_dir):
    import json

    from sluice.sources.json_source import read_json
    from sluice.sources.xml_source import read_xml

    p = os.path.join(tmp_dir, "root.json")
    with open(p, "w", encoding="utf-8") as fh:
        json.dump({"meta": {"v": 1}, "items": [{"a": 1, "b": {"c": "x"}}, {"a": 2, "d": [1, 2]}, 3]}, fh, indent=2)
    df, keys = read_json(spark, [p], row_tag="items")
    assert keys == ["a", "b_c", "d"]
    assert sorted(tuple(r)[:3] for r in df.collect()) == [("1", "x", ""), ("2", "", "[1, 2]")]
    x = os.path.join(tmp_dir, "pretty.xml")
    with open(x, "w", encoding="utf-8") as fh:
        fh.write("<?xml version='1.0'?>\n<data>\n  <item>\n    <k>1</k>\n    <v>a</v>\n  </item>\n"
                 "  <item>\n    <v>b</v>\n    <k>2</k>\n  </item>\n</data>\n")
    df, keys = read_xml(spark, [x])
    assert keys == ["k", "v"]
    assert sorted(tuple(r)[:2] for r in df.collect()) == [("1", "a"), ("2", "b")]


def test_malformed_json_raises_beside_good_files(spark, tmp_dir):
    import pytest

    from sluice.sources.json_source import read_json

    def put(name, text):
        p = os.path.join(tmp_dir, name)
        with open(p, "w", encoding="utf-8") as fh:
            fh.write(text)
        return p
    good = put("good.json", '[{"a": 1}, {"a": 2}]')
    lines = put("lines.json", '{"a": 3}\n\n{"a": 4}\r\n{"a": 5}\n')
    df, keys = read_json(spark, [good, lines])
    assert keys == ["a"] and sorted(r[0] for r in df.collect()) == ["1", "2", "3", "4", "5"]
    for name, text in [("cut1.json", '[{"a": 1}, {"a": 2'), ("cut2.json", '{"a": 1, "b": {'), ("cut3.json", '{"a": 3}\n{"a": 4\n'),
                       ("cut4.json", '{"rows": [{"a": 1}, {"a"')]:
        with pytest.raises(Exception, match="malformed JSON"):
            read_json(spark, [good, put(name, text)])
    with pytest.raises(Exception, match="malformed JSON"):
        read_json(spark, [put("tag.json", '{"rows": {"a": 1}}')], row_tag="rows")


def test_source_errors(spark, tmp_dir):
    import pytest

    from sluice.sources.dispatch import read_units
    from sluice.sources.files import SourceError
    from sluice.options import ReadOptions

    bad = os.path.join(tmp_dir, "x.parquetish")
    open(bad, "w").write("x")
    with pytest.raises(SourceError):
        next(iter(read_units(spark, [bad], ReadOptions())))
    broken = os.path.join(tmp_dir, "broken.csv")
    open(broken, "wb").write(b"\xff\xfe\xfa\xfb\xfc" * 10)
    with pytest.raises(SourceError, match="broken.csv"):
        next(iter(read_units(spark, [broken], ReadOptions())))


def test_xml_root_children_any_tag(spark, tmp_dir):
    from sluice.sources.xml_source import read_xml

    x = os.path.join(tmp_dir, "mixed.xml")
    with open(x, "w", encoding="utf-8") as fh:
        fh.write("<root><a id='1'><k>1</k><n><x>9</x></n></a><b><v>z</v><k>2</k><k>3</k></b></root>")
    df, keys = read_xml(spark, [x])
    assert keys == ["k", "n_x", "v"]
    assert [tuple(r)[:3] for r in df.orderBy("__pos").collect()] == [("1", "9", ""), ("3", "", "z")]


def test_xml_fields_in_the_order_of_the_data(spark, tmp_dir):
    from sluice.sources.xml_source import field_paths, read_xml

    assert field_paths("<?xml?><rows><!-- <row><no/> --><row a='>'><z>1</z><y><b/><a x=\"</y>\">2</a></y><![CDATA[<q>]]><e/>", "row") == ["z", "y", "y_b", "y_a", "e"]
    filler = "<row><zeta>1</zeta><beta><two>2</two><one>1</one></beta></row>" * 3
    for name, rows in (("a.xml", filler), ("b.xml", filler + "<row><beta><three>3</three></beta><alpha>last</alpha></row>")):
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as fh:
            fh.write(f"<rows>{rows}</rows>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        df, keys = read_xml(spark, [os.path.join(tmp_dir, n) for n in ("a.xml", "b.xml")], "row")
        assert keys == ["zeta", "beta_two", "beta_one", "beta_three", "alpha"]
        assert ("", "", "", "3", "last") in {tuple(r)[:5] for r in df.collect()} and df.count() == 7
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_own_clock(monkeypatch):
    import datetime as dt

    from sluice.functions import clock

    utc = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    for zone, hours in (("UTC", 0), ("", 8), ("No/Such", 8), ("Asia/Tokyo", 9)):
        monkeypatch.setenv("APP_TIMEZONE", zone)
        assert abs((clock.now() - utc).total_seconds() - hours * 3600) < 5, zone


def test_prose_does_not_name_the_delimiter(spark, tmp_dir):
    """Quoted prose in which the sniffer sees spaces or letters leaves the comma; a space that the header holds is one."""
    from sluice.sources.delimited import read_delimited

    text = 'doc_id,text\n' + "".join(f'{i},"Et tre "" a"" b"" c treleai p , ""x"" y "\n' for i in range(20))
    import csv as plain
    for d in (" ", "e"):
        found = type("Found", (), {"delimiter": d})
        kept, plain.Sniffer.sniff = plain.Sniffer.sniff, lambda *_, found=found: found
        try:
            assert sniff_delimiter(text) == "," and sniff_delimiter("a b\n1 2\n") == ("," if d == "e" else " ")
        finally:
            plain.Sniffer.sniff = kept
    p = os.path.join(tmp_dir, "prose.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    assert read_delimited(spark, [p]).sluice_used_width == 2
