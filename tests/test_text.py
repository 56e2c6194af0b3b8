import pytest
from pyspark.sql import functions as F

from skillgrid.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("value,expected", [
    ("  Senior, DATA--Analyst!!!  ", "senior data analyst"),
    ("Python\t\tDeveloper\n", "python developer"),
    ("", ""),
    ("!!!", ""),
    ("a b c", "a b c"),
])
def test_clean_text(spark, value, expected):
    assert _one(spark, T.clean_text, value) == expected


def test_collapse_keeps_punctuation(spark):
    assert _one(spark, T.collapse_whitespace, "  a \t b,  c ") == "a b, c"
    assert _one(spark, T.normalize_key, "  Node.JS \n Dev ") == "node.js dev"


def test_strip_punctuation_is_ascii_only(spark):
    assert _one(spark, T.strip_common_punctuation, "a-b's «c»") == "a b s «c»"


@pytest.mark.parametrize("value,expected", [
    ("Sr. Backend Eng", "senior backend engineer"),
    ("jr dev", "junior developer"),
    ("Staff Engineer", "staff engineer"),
    ("", ""),
])
def test_normalize_title(spark, value, expected):
    assert _one(spark, T.normalize_title, value) == expected


@pytest.mark.parametrize("value,expected", [
    ("C++, C#, and SQL", "c++ c# and sql"),
    ("c + + and c #", "c++ and c#"),
    (".NET Core", ".net core"),
    ("ASP.NET", "asp.net"),
    ("Node.js / React", "node.js react"),
])
def test_normalize_skill_token(spark, value, expected):
    assert _one(spark, T.normalize_skill_token, value) == expected


def test_blank_and_name_id(spark):
    df = spark.createDataFrame([(" \t",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(T.is_blank("v")).collect()] == [True, True, False]
    ids = spark.createDataFrame([("a", 1)], "k string, n int").select(T.name_based_id("k", "n")).first()[0]
    import hashlib
    assert ids == hashlib.sha256(b"a|1").hexdigest()
