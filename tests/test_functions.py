"""Null, NaN and zero rules, dates, text, topics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar as x


def one(spark, c):
    return spark.range(1).select(c.alias("v")).head().v


def test_divide(spark):
    assert one(spark, x.divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, x.ieee_divide(F.lit(1.0), F.lit(0.0))) == math.inf
    assert one(spark, x.ieee_divide(F.lit(-1.0), F.lit(0.0))) == -math.inf
    assert one(spark, x.ieee_divide(F.lit(0.0), F.lit(0.0))) is None


def test_clip_and_finite(spark):
    null = F.lit(None).cast("double")
    assert one(spark, x.clip(null, 2.0, 5.0)) is None
    assert one(spark, x.clip(F.lit(9.0), 2.0, 5.0)) == 5
    assert one(spark, x.clip(F.lit(9.0), null, null)) == 9
    assert one(spark, x.finite(F.lit(float("nan")))) is None
    assert one(spark, x.to_double(F.lit("x"))) is None


@pytest.mark.parametrize(("day", "end"), [("2023-10-31", "2023-12-31"), ("2024-01-01", "2024-03-31"), ("2024-06-30", "2024-06-30")])
def test_quarter_end(spark, day, end):
    assert str(one(spark, x.quarter_end(F.lit(day).cast("date")))) == end


def test_periods(spark):
    d = F.lit("2024-05-07").cast("date")
    assert one(spark, x.period_tag(d)) == "q2y2024"
    assert one(spark, x.period_tag(d, "day")) == "2024-05-07"
    assert one(spark, x.previous_quarter_end(d)) == dt.date(2024, 3, 31)
    assert one(spark, x.shift_period(F.lit("2024-03-31").cast("date"), 1, "q")) == dt.date(2024, 6, 30)
    with pytest.raises(ValueError, match="weekly"):
        x.frequency("weekly")


@pytest.mark.parametrize(("name", "n"), [("15min", 96 * 31), ("4hour", 6 * 31), ("1day", 31), ("1month", 1), ("odd", None)])
def test_available_periods(spark, name, n):
    assert one(spark, x.available_periods(F.lit(name), F.lit("2024-01-01"), F.lit("2024-01-31"))) == n


def test_timestamps(spark):
    assert one(spark, x.published_timestamp(F.lit("20240102T030405"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, x.published_timestamp(F.lit("soon"))) is None
    assert one(spark, x.api_timestamp(F.lit("20240102T0304"))) == dt.datetime(2024, 1, 2, 3, 4)
    assert one(spark, x.to_day(F.lit("bad"))) is None


@pytest.mark.parametrize(("text", "out"), [(" Life  Sciences! ", "life_sciences"), ("--", "value"), (None, "value")])
def test_slug(spark, text, out):
    assert one(spark, x.slug(F.lit(text).cast("string"))) == out


def test_labels(spark):
    assert one(spark, x.is_bullish(F.lit("Somewhat-Bullish")))
    assert not one(spark, x.is_bearish(F.lit(None).cast("string")))
    assert one(spark, x.model_family(F.lit(" "), F.lit("a.b.Net"))) == "net"
    assert one(spark, x.sample_key(F.lit("val"), F.lit("q1y2024"), F.lit("2024-03-31").cast("date"))) == "val__q1y2024__2024-03-31"


@pytest.mark.parametrize(("json", "out"), [
    ('[{"topic":"A b","relevance_score":"0.5"},3,{"topic":""}]', [("a_b", 0.5)]),
    ('[{"topic":"A","relevance_score":"x"}]', [("a", 0.0)]), ("{", []), (None, []), ('{"topic":"A"}', []),
])
def test_topics(spark, json, out):
    assert [tuple(t) for t in one(spark, x.topics(F.lit(json).cast("string")))] == out


@pytest.mark.parametrize(("r", "c"), [(-0.03, 0), (-0.02, 1), (0.02, 1), (0.03, 2), (None, None)])
def test_return_class(spark, r, c):
    assert one(spark, x.return_class(F.lit(r).cast("double"), 0.02)) == c


def test_arrays(spark):
    v = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    assert one(spark, x.arg_max(v)) == 1
    assert one(spark, x.linear(v, [1, 1, 2], 0.5)) == 10.5
    assert abs(one(spark, x.log_sum_exp(v)) - math.log(math.exp(1) + 2 * math.exp(3))) < 1e-12
    s = F.array(F.array(F.lit(1.0), F.lit(2.0)))
    assert one(spark, x.pad_sequence(s, 3, 2)) == [[1, 2], [0, 0], [0, 0]]
    assert one(spark, x.mask(s, 3)) == [True, False, False]


def test_feature_columns(spark):
    df = spark.createDataFrame([], "a double, b string, c boolean, econ_x double")
    assert x.feature_columns(df, ["a"]) == ["c", "econ_x"]
    assert x.feature_profile(x.feature_columns(df))["economics"] == 1
    with pytest.raises(ValueError, match="b"):
        x.feature_columns(df, wanted=["b"])
    assert one(spark, x.first_of(df, ["zz"], 3.0)) == 3.0
