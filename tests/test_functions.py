"""Column functions against their Python definitions."""
import math
import random

from pyspark.sql import functions as F

from sluice.functions.dates import strptime_to_spark, UnsupportedFormat
from sluice.functions.names import (
    safe_file_stem, safe_file_stem_col, sanitize_identifier, sanitize_identifier_col, target_table_name,
    transform_field_name, unique_names,
)
from sluice.functions.pinyin import pinyin_initials, pinyin_initials_col
from sluice.functions.text import py_strip
from sluice.functions.totext import double_to_text

import pytest

WS = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​"]


def test_strip_matches_python(spark):
    rnd = random.Random(7)
    vals = []
    for _ in range(300):
        core = "".join(rnd.choice(["a", "b", " ", "中", "​", "-"]) for _ in range(rnd.randint(0, 5)))
        vals.append("".join(rnd.choice(WS) for _ in range(rnd.randint(0, 3))) + core
                    + "".join(rnd.choice(WS) for _ in range(rnd.randint(0, 3))))
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(py_strip(F.col("v"))).collect()]
    assert got == [v.strip() for v in vals]


def test_double_text_matches_python_repr(spark):
    rnd = random.Random(3)
    vals = [0.0, -0.0, 1.0, 1e7, 1e16, 1.5e16, 1e-5, 1.5e-5, 1e-4, 0.001, 123.456, 1e22, 9999999.999,
            12345678.9, 0.00012345678901234567, float("inf"), float("-inf")]
    # Values whose shortest form has at most 15 digits print exactly as repr();
    # beyond that Java's digits are used (still round-trip exact).
    vals += [float("%.15g" % rnd.uniform(-1e6, 1e6)) for _ in range(200)]
    vals += [float("%.12g" % (10 ** rnd.uniform(-8, 20))) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(double_to_text(F.col("v"))).collect()]
    expect = [repr(v) if not math.isinf(v) else ("inf" if v > 0 else "-inf") for v in vals]
    assert got == expect
    full = [rnd.uniform(-1e6, 1e6) for _ in range(100)] + [10 ** rnd.uniform(-8, 20) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in full], "v double")
    back = [float(r[0]) for r in df.select(double_to_text(F.col("v"))).collect()]
    assert back == full


def test_identifiers():
    assert sanitize_identifier(" Hello World! ", "x") == "Hello_World"
    assert sanitize_identifier("123abc", "x") == "t_123abc"
    assert sanitize_identifier("***", "fallback") == "fallback"
    assert sanitize_identifier("客户 名称", "x") == "客户_名称"
    assert unique_names(["a", "a", "a_2", "b"]) == ["a", "a_2", "a_2_2", "b"]
    assert transform_field_name("Customer Name", "c1") == "customer_name"
    assert transform_field_name("姓名", "c1", pinyin=True) == "xm"
    assert target_table_name("员工.csv", pinyin=True) == "yg"
    assert target_table_name("sales_2024.csv", regex=r"(\d{4})") == "t_2024"
    assert target_table_name("a.csv", prefix="p_", suffix="_s", case="upper") == "P_A_S"


def test_identifier_column_matches_driver(spark):
    vals = [" Hello World! ", "123abc", "***", "客户 名称", "a__b", ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(sanitize_identifier_col(F.col("v"), "fb")).collect()]
    assert got == [sanitize_identifier(v, "fb") for v in vals]


def test_file_stem_column_matches_driver(spark):
    vals = ['a/b:c*?"<>|', "  many   spaces  ", "._x_.", "", "x" * 300, "tab\there", "上海"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(safe_file_stem_col(F.col("v"), "empty")).collect()]
    assert got == [safe_file_stem(v, "empty") for v in vals]


def test_pinyin(spark):
    assert pinyin_initials("员工") == "yg"
    assert pinyin_initials("金额abc") == "jeabc"
    df = spark.createDataFrame([("张三",), ("北京 上海",)], "v string")
    assert [r[0] for r in df.select(pinyin_initials_col(F.col("v"))).collect()] == ["zs", "bj sh"]


def test_strptime_translation():
    assert strptime_to_spark("%Y/%m/%d") == "yyyy'/'M'/'d"
    assert strptime_to_spark("%Y%m%d %H:%M") == "yyyyMMdd' 'H':'m"
    assert strptime_to_spark("%Y-%m-%dT%H:%M:%S") == "yyyy'-'M'-'d'T'H':'m':'s"
    with pytest.raises(UnsupportedFormat):
        strptime_to_spark("%Q")


def test_number_patterns_match_python(spark):
    import re

    from sluice.operators.types import _is_int, _is_real

    vals = ["1", "+1", "-1", "1.", ".5", "-.5", "+5.5", "5+", "1.2.3", ".", "+", "-", "", "١٢", "١.٥", "1e5",
            " 1", "1 ", "0x1", "--1", "+-1", "12a", "٣", "1.5.", "00", "+.", "-0.0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [(r[0], r[1]) for r in df.select(_is_int(F.col("v")), _is_real(F.col("v"))).collect()]
    exp = [(bool(re.fullmatch(r"[-+]?\d+", v)), bool(re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)", v))) for v in vals]
    assert got == exp
