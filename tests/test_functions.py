"""Column helpers: null rules, rounding, string rules."""

from pyspark.sql import functions as F

from ephysframe.functions import (
    format_probe_name, list_lacks, n_unique, parse_id_list, replace_first, round_half_up_ratio,
    row_mean, split_part, split_terms, strict_concat,
)


def test_parse_id_list_golden():
    assert parse_id_list("1, 2 3  4") == (1, 2, 3, 4)
    assert parse_id_list("5,,6   7") == (5, 6, 7)
    assert parse_id_list(None) == ()
    assert parse_id_list([3, 4]) == (3, 4)


def test_split_terms_drops_empty():
    assert split_terms(" VISp, LGd ,") == ["VISp", "LGd"]
    assert split_terms("") == []


def test_format_probe_name(spark):
    rows = spark.createDataFrame([("c",), ("PROBE_d",), ("probeE ",), ("probe_b",)], "p string").select(format_probe_name("p").alias("n"))
    assert [r.n for r in rows.collect()] == ["probeC", "probeD", "probeE", "probeB"]


def test_list_lacks_null_rules(spark):
    df = spark.createDataFrame(
        [(1, ["templeton"]), (2, ["x"]), (3, None), (4, [None, "y"]), (5, [None, "templeton"])], "id int, k array<string>"
    )
    kept = sorted(r.id for r in df.where(list_lacks("k", "templeton")).collect())
    assert kept == [2, 4]  # a null list drops the row


def test_n_unique_counts_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert df.select(n_unique("v").alias("n")).first().n == 3
    df2 = spark.createDataFrame([("a",), ("b",)], "v string")
    assert df2.select(n_unique("v").alias("n")).first().n == 2


def test_row_mean_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (None, None)], "a double, b double")
    assert [r.m for r in df.select(row_mean("a", "b").alias("m")).collect()] == [2.0, 2.0, None]


def test_string_rules(spark):
    df = spark.createDataFrame([("probeA_probe", "2002 E2", "x")], "g string, loc string, z string")
    r = df.select(
        replace_first("g", "probe").alias("p"),
        split_part("loc", " ", 0).alias("implant"),
        split_part("loc", " ", 1).alias("hole"),
        split_part("z", " ", 1).alias("missing"),
        strict_concat("g", F.lit(None).cast("string")).alias("nullcat"),
    ).first()
    assert (r.p, r.implant, r.hole, r.missing, r.nullcat) == ("A_probe", "2002", "E2", None, None)


def test_round_half_up_ratio(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 5), (1, 0)], "h long, t long")
    got = [r.r for r in df.select(round_half_up_ratio("h", "t").alias("r")).collect()]
    assert got == [0.13, 0.33, 0.67, 0.0, None]
