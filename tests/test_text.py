import pytest
from pyspark.sql import functions as F

from lodestone.functions import text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("value, expected", [
    ("\tslate \u00a0 and\r\n  chalk\n", "slate and chalk"),
    ("a Sub\u017fcribe to all of the Newsletter b", "a  b"),
    ("a Coo\u212aie Policy x Accept b", "a  b"),
    ("a Pr\u0131vacy Policy x Terms b", "a  b"),
    ("Home page of x", "page of x"),
    ("home", ""),
    (" Home page", "Home page"),
    ("Homepage", "Homepage"),
    ("Menu Home x", "Home x"),
    ("a Cookie  Policy bla ACCEPT b", "a  b"),
    ("a privacy\npolicy x terms y terms z", "a  y terms z"),
    ("x Subscribe to our Newsletter y Newsletter", "x  y Newsletter"),
    ("Privacy Cookie Policy a Accept Policy b Terms c", "c"),
    ("CooKie Policy x Accept y", "y"),
    ("a  b\x1cc\x85d", "a b c d"),
    ("Contact us", "us"),
    ("", ""),
    (None, ""),
    ("Cookie Policy without an end", "Cookie Policy without an end"),
])
def test_clean_text(spark, value, expected):
    assert one(spark, text.clean_text(F.col("t")), value) == expected


def test_whitespace_is_complete():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("value", ["  a b 　\n", "", " \t", "x", "\x1f y "])
def test_strip_ws(spark, value):
    assert one(spark, text.strip_ws(F.col("t")), value) == value.strip()


@pytest.mark.parametrize("value, expected", [
    ("x" * 200, "x" * 200), ("x" * 201, "x" * 200 + "..."), ("\U0001f600" * 201, "\U0001f600" * 200 + "...")])
def test_snippet(spark, value, expected):
    assert one(spark, text.snippet(F.col("t")), value) == expected
