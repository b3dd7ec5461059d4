"""Scalar and JSON functions."""

import math

import pytest
from pyspark.sql import functions as F

from quintet.functions import jsontree, scalars


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_and_clamping(spark):
    grid = spark.range(0, 20001).select((F.col("id") / 20000.0).alias("x"))
    for r in grid.select("x", scalars.round4("x").alias("y")).collect():
        assert r["y"] == math.floor(r["x"] * 10000.0 + 0.5) / 10000.0
    assert value(spark, scalars.clamp01(F.lit(-0.5))) == 0.0
    assert value(spark, scalars.clamp01(F.lit(float("inf")))) == 1.0
    assert math.isnan(value(spark, scalars.clamp01(F.lit(float("nan")))))
    assert value(spark, scalars.divided(F.lit(-1.0), F.lit(0.0))) == float("-inf")


def test_numbers_and_times_as_text(spark):
    for x, text in [(1.0, "1"), (0.5, "0.5"), (0.05, "0.05"), (29.2331036248, "29.2331036248"), (-1.0, "-1"), (100.0, "100"), (0.1 + 0.2, "0.3")]:
        assert value(spark, scalars.json_number(F.lit(x))) == text
    assert value(spark, scalars.iso_of(F.lit(1773254753))) == "2026-03-11T18:45:53Z"
    assert value(spark, scalars.epoch_of(F.lit("2026-03-11T18:45:53Z"))) == 1773254753
    assert value(spark, scalars.day_of_week(F.lit("2026-03-11").cast("timestamp"))) == 2
    assert value(spark, scalars.percent(F.lit(0.011))) == "1.1%"
    assert value(spark, scalars.numbered("MERC-", F.lit(7), 3)) == "MERC-007"
    assert value(spark, scalars.rotated_right(F.lit(1), 1)) == 1 << 31


def test_distances(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert value(spark, scalars.l2(a, b)) == 5.0
    assert value(spark, scalars.l1(a, b)) == 7.0
    assert value(spark, scalars.cosine(a, a)) == pytest.approx(0.0)
    assert value(spark, scalars.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 1.0


def test_lookup_takes_the_first_match(spark):
    pairs = [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    assert value(spark, scalars.first_match(pairs, F.lit("a"), 0.5)) == 1.0
    assert value(spark, scalars.first_match(pairs, F.lit("z"), 0.5)) == 0.5
    assert value(spark, scalars.first_match([], F.lit("z"), 0.5)) == 0.5


def test_json_trees(spark):
    m = jsontree.parse(F.lit('{"A": 1, "b": 2}'), "map<string,bigint>")
    assert value(spark, jsontree.field(m, "a")) == 1
    assert value(spark, jsontree.field(m, "a", case_sensitive=True)) is None
    assert value(spark, jsontree.has(m, "B")) is True
    assert value(spark, jsontree.without_field(m, "a")) == {"b": 2}
    assert value(spark, jsontree.with_field(m, "b", F.lit(9).cast("long"))) == {"A": 1, "b": 9}
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert value(spark, jsontree.inserted(a, 1, F.lit(9))) == [1, 9, 2, 3]
    assert value(spark, jsontree.inserted(a, 9, F.lit(9))) == [1, 2, 3, 9]
    assert value(spark, jsontree.without_item(a, 0)) == [2, 3]
    assert value(spark, jsontree.replaced_item(a, 2, F.lit(7))) == [1, 2, 7]
    assert value(spark, jsontree.item(a, 5)) is None
    assert value(spark, jsontree.appended(a, F.lit(4))) == [1, 2, 3, 4]
    assert value(spark, jsontree.parse_prefix(F.lit('{"a":1}xxx'), 7, "map<string,bigint>")) == {"a": 1}
    kinds = {"null": "null", "true": "boolean", "1.5": "number", '"x"': "string", "[1]": "array", '{"a":1}': "object", "nope": "invalid"}
    for text, kind in kinds.items():
        assert value(spark, jsontree.kind(jsontree.parse(F.lit(text)))) == kind
    assert value(spark, jsontree.number(jsontree.parse(F.lit('{"a": 2.5}')), "$.a")) == 2.5
    assert value(spark, jsontree.finite(F.lit(float("nan")))) is None


def test_json_numbers_and_depth(spark):
    for x, text in [(1.0, "1"), (-0.0, "0"), (0.1, "0.1"), (1 / 3, "0.33333333333333331"), (0.1 + 0.2, "0.3"), (1e20, "1e+20"), (2147483648.0, "2147483648"), (5e-324, "4.94065645841247e-324"), (float("nan"), "null"), (float("-inf"), "null")]:
        assert value(spark, jsontree.number_text(F.lit(x))) == text
    assert value(spark, jsontree.number_text(F.lit(None).cast("double"))) is None
    for depth, there in ((1000, True), (1001, False)):
        frame = spark.createDataFrame([("[" * depth + "]" * depth,)], "t string")
        assert frame.select(jsontree.parse("t").isNotNull().alias("x")).first()["x"] is there


def test_minify_takes_long_strings(spark):
    text = '{"a":"' + '\\"' * 200_000 + '"}'
    frame = spark.createDataFrame([(text + "  // c",), (None,)], "t string")
    assert [r["x"] for r in frame.select(jsontree.minify("t").alias("x")).collect()] == [text, None]


def test_bits(spark):
    assert value(spark, scalars.xored(F.lit(12), F.lit(10))) == 6
    assert value(spark, scalars.shifted_left(F.lit(1 << 31), 1)) == 0
    assert value(spark, scalars.shifted_right(F.lit(12), 2)) == 3


def test_minify_and_compare(spark):
    assert value(spark, jsontree.minify(F.lit('{ "a" : "x // y /* z */" , // c\n "b": [1, 2] /* d */ }'))) == '{"a":"x // y /* z */","b":[1,2]}'
    same = lambda a, b, **k: value(spark, jsontree.compare(F.lit(a), F.lit(b), **k))
    assert same('{"a":1,"b":[1,2]}', '{"b":[1.0,2],"a":1}') is True
    assert same('{"a":1}', '{"A":1}') is False
    assert same('{"a":1}', '{"A":1}', case_sensitive=False) is True
    assert same("[1,2]", "[2,1]") is False
    assert same("0.30000000000000004", "0.3") is True
    assert same("true", "1") is False
    assert same("x", "1") is None
