"""Large JSON files are read in splits and mean the same as one parse of the whole."""
import json
import os
import random

import pytest

from sluice.operators.order import number_rows
from sluice.sources.json_source import flat_fields, read_json


@pytest.fixture()
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return path


def rows_of(spark, path, tag=""):
    df, keys = read_json(spark, [path], tag)
    rows = number_rows(df).orderBy("__rn").collect()
    return keys, [tuple(r[f"c{i + 1}"] for i in range(len(keys))) for r in rows]


def by_hand(objects):
    flat = [dict(zip(*flat_fields(o))) for o in objects if isinstance(o, dict)]
    keys = list(dict.fromkeys(k for f in flat for k in f))
    return keys, [tuple(f.get(k, "") for k in keys) for f in flat]


def made(rng, n):
    texts = ["", "a", "}", "{", '"', "\\", '\\"}', "]", "[{", "é日", "x" * 90, '},{"k":1}', "\n", "a\\\\"]
    value = lambda: rng.choice([rng.choice(texts), 1, 2.5, 1e20, True, None, [1, {"a": "}"}], {"p": rng.choice(texts), "q": [1, "]"]}, {}])
    return [rng.choice([5, "s}", None, [1, {"z": {}}]]) if rng.random() < 0.1 else {f"f{rng.randint(0, 4)}": value() for _ in range(rng.randint(0, 4))} for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays(spark, tmp_dir, tiny_splits, seed, indent):
    objects = made(random.Random(seed), 50) + [{"last": 1}]
    path = put(tmp_dir, "a.json", json.dumps(objects, indent=indent, ensure_ascii=seed % 2 == 0) + "\n" * seed, "utf-8-sig" if seed == 1 else "utf-8")
    assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 10
    assert rows_of(spark, path) == by_hand(objects)


def test_a_long_element_and_lists_of_no_objects(spark, tmp_dir, tiny_splits):
    objects = [1, "two", {"k": {"deep": "}" * 50, "list": [{"x": 1}] * 30}}, [{"not": "a row"}], {"k": 2}, 3]
    assert rows_of(spark, put(tmp_dir, "b.json", json.dumps(objects))) == by_hand(objects)


def test_lines(spark, tmp_dir, tiny_splits):
    objects = [{"a": i, "b": {"c": "}{"}} for i in range(40)] + [7, {"d": "é"}]
    path = put(tmp_dir, "l.json", "\n".join(json.dumps(o) for o in objects) + "\n\n")
    assert rows_of(spark, path) == by_hand(objects)


def test_documents(spark, tmp_dir, tiny_splits):
    rows = [{"a": i} for i in range(30)]
    path = put(tmp_dir, "d.json", json.dumps({"meta": {"x": [0]}, "first": rows, "rows": [{"z": 1}]}, indent=1))
    assert rows_of(spark, path) == by_hand(rows) and rows_of(spark, path, "rows") == by_hand([{"z": 1}])
    assert rows_of(spark, put(tmp_dir, "one.json", '{"a": {"b": 1},\n "c": 2}')) == by_hand([{"a": {"b": 1}, "c": 2}])


@pytest.mark.parametrize("harm", ["truncated", "truncated in a string", "no comma", "extra", "two commas", "bad member", "open", "close"])
def test_malformed_arrays_raise(spark, tmp_dir, tiny_splits, harm):
    text = json.dumps([{"k": i, "s": "text } of some length"} for i in range(30)])
    text = {"truncated": text[:-300], "truncated in a string": text[:len(text) - 12], "no comma": text.replace("}, ", "} ", 3), "extra": text + "[]", "two commas": text.replace("}, ", "},, ", 1),
            "bad member": text.replace('"k": 20', '"k": 2O'), "open": text[:-1] + ", [ ]", "close": text[:200] + "]" + text[200:]}[harm]
    path = put(tmp_dir, "bad.json", text)
    with pytest.raises(Exception, match="malformed JSON"):
        rows_of(spark, path)


def test_many_kinds_in_one_scan(spark, tmp_dir):
    put(tmp_dir, "1.json", '[{"a": 1}, {"b": 2}]')
    put(tmp_dir, "2.json", '{"a": 3}\n{"c": 4}\n')
    put(tmp_dir, "3 x.json", '{"rows": [{"a": 5}]}')
    df, keys = read_json(spark, [os.path.join(tmp_dir, f) for f in sorted(os.listdir(tmp_dir))])
    rows = [tuple(r) for r in number_rows(df).orderBy("__file", "__rn").select(*[f"c{i + 1}" for i in range(len(keys))]).collect()]
    assert keys == ["a", "b", "c"] and sorted(rows) == sorted([("1", "", ""), ("", "2", ""), ("3", "", ""), ("", "", "4"), ("5", "", "")])


def test_arrays_are_parsed_once_and_in_small_parts(spark, tmp_dir):
    """What reads the rows later does not parse the files again; no more than a few rows become Python objects at a time."""
    import pyarrow as pa

    from sluice.operators.export import export_frame
    from sluice.options import ExportOptions
    from sluice.sources.files import list_files
    from sluice.sources.json_source import flat_fields
    from sluice.sources.json_split import array_rows, layout
    from sluice.sources.text_probe import slices

    res = export_frame(spark.range(700).selectExpr("id", "concat('é\"}', id) AS t"), tmp_dir, "a", ExportOptions(fmt="json"))
    files = list_files(spark, res.path)
    rows = array_rows(spark, files, layout(spark, files)[0], flat_fields)
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1  # only texts that cross splits
    df, keys = read_json(spark, files)
    assert keys == ["id", "t"] and sorted((int(r.c1), r.c2) for r in df.collect()) == [(i, f'é"}}{i}') for i in range(700)]
    assert [b.num_rows for b in slices([pa.RecordBatch.from_pydict({"x": list(range(600))})])] == [256, 256, 88]
