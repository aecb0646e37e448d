"""Scalar helpers on literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from placewise.functions import columns as c
from placewise.functions import geo


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [("7,0625", 7.0625), ("-0.125", -0.125), (" 12,5  ", 12.5), (" ", None), ("7,5 km", None), ("0f", None), (None, None)],
)
def test_decimal_number(spark, text, expected):
    assert value(spark, c.decimal_number(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    "text, expected", [("9.876.543,25", 9876543.25), ("0,5", 0.5), ("...", None), ("80%", 80.0), ("--", None), ("3.25", 3.25)]
)
def test_localized_number(spark, text, expected):
    assert value(spark, c.localized_number(F.lit(text))) == expected


def test_keys(spark):
    assert value(spark, c.place_key(F.lit("1302603.0"))) == "130260"
    assert value(spark, c.place_key_7(F.lit("987"))) == "0000987"
    assert value(spark, c.zero_pad(F.lit("4567"), 3)) == "4567"
    assert value(spark, c.facility_code(F.lit("31.0"))) == "0000031"
    assert value(spark, c.facility_code(F.lit("nan"))) == ""
    assert value(spark, c.facility_digits(F.lit("86.0 "))) == "0000086"


def test_slug(spark):
    assert value(spark, c.slug(F.lit(" Região de Saúde! "))) == "regiao_de_saude"
    assert value(spark, c.slug(F.lit("Straße"))) == "strae"


def test_null_guards(spark):
    none = F.lit(None).cast("double")
    assert value(spark, c.clip(none, 0, 1)) is None
    assert value(spark, c.clip(F.lit(3.0), 0, 1)) == 1.0
    assert value(spark, c.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, c.or_false(none > 1)) is False
    assert value(spark, c.known_only(none, none > 1)) is None


def test_bins_are_right_closed(spark):
    labels = [value(spark, c.right_closed_bins(F.lit(x), (-1, 80, 95, 100), ("a", "b", "c"))) for x in (80.0, 80.1, 95.0, 100.0, 101.0)]
    assert labels == ["a", "b", "b", "c", None]


def test_last_match_wins(spark):
    assert value(spark, c.last_match("z", [(F.lit(True), "a"), (F.lit(True), "b"), (F.lit(False), "c")])) == "b"


def test_largest_measure_prefers_first_on_ties(spark):
    none = F.lit(None).cast("double")
    assert value(spark, c.largest_measure({"a": F.lit(1.0), "b": F.lit(1.0), "c": none}, "none")) == "a"
    assert value(spark, c.largest_measure({"a": none}, "none")) == "none"


def test_periods(spark):
    assert value(spark, c.parse_period(F.lit("03-2026"))) == dt.date(2026, 3, 1)
    assert value(spark, c.parse_period(F.lit("13/2026"))) is None


def test_id_list(spark):
    assert value(spark, c.id_list(F.lit("12, x, -7 ,"))) == [12, -7]
    assert value(spark, c.id_list(F.lit(None).cast("string"))) == []


def test_square_centroid_and_inside(spark):
    ring = F.from_json(F.lit("[[0,0],[2,0],[2,2],[0,2],[0,0]]"), geo.RING)
    got = value(spark, geo.ring_area_centroid(ring))
    assert (got["area"], got["lon"], got["lat"]) == (4.0, 1.0, 1.0)
    assert value(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), ring)) is True
    assert value(spark, geo.in_or_on_ring(F.lit(2.0), F.lit(1.0), ring)) is True
    assert value(spark, geo.in_ring(F.lit(2.0), F.lit(1.0), ring)) is False


def test_flat_ring_falls_back_to_mean_point(spark):
    ring = F.from_json(F.lit("[[0,0],[1,1],[2,2]]"), geo.RING)
    got = value(spark, geo.ring_area_centroid(ring))
    assert (got["area"], got["lon"], got["lat"]) == (0.0, 1.0, 1.0)
