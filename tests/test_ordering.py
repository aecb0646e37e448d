"""Spread ranks and quantiles against pandas, with a third of all rows on one value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.operators import ordering as o


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "g": rng.integers(0, 3, n),
            "a": np.where(rng.random(n) < 0.34, 0.0, rng.normal(size=n).round(3)),
            "b": rng.exponential(size=n),
        }
    )
    pdf.loc[::17, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    return pdf, df


def ordered(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


def test_percentile_ranks(frame):
    pdf, df = frame
    got = ordered(o.percentile_ranks(df, ["id"], {"pa": F.col("a"), "pb": F.col("b")}, descending=["pb"]))
    assert np.allclose(got.pa, pdf.a.rank(pct=True))
    assert np.allclose(got.pb, pdf.b.rank(pct=True, ascending=False), equal_nan=True)


def test_ranks_inside_groups(frame):
    pdf, df = frame
    got = ordered(o.competition_ranks(df, ["id"], {"r": F.col("a")}, by=["g"]))
    assert np.allclose(got.r, pdf.groupby("g").a.rank(ascending=False, method="min"))


def test_winsorized(frame):
    pdf, df = frame
    low, high = pdf.b.quantile([0.01, 0.99])
    got = ordered(o.winsorized_percentiles(df, ["id"], {"p": F.col("b")}))
    assert np.allclose(got.p, pdf.b.clip(low, high).rank(pct=True), equal_nan=True)


def test_quantiles(frame):
    pdf, df = frame
    got = o.quantiles(df, ["g"], {"m": (F.col("a"), 0.5), "q": (F.col("b"), 0.99)}).toPandas().set_index("g").sort_index()
    assert np.allclose(got.m, pdf.groupby("g").a.median())
    assert np.allclose(got.q, pdf.groupby("g").b.quantile(0.99))


def test_weighted_quantiles_by_hand(spark):
    """Of 20 in all, 4 lie at or below 3, 9 at or below 8, 19 at or below 11; weights of nothing, and values unknown, don't count."""
    rows = [(8.0, 5.0), (3.0, 1.0), (11.0, 10.0), (3.0, 3.0), (50.0, 1.0), (1.0, 0.0), (None, 70.0), (0.5, -2.0)]
    df = spark.createDataFrame(rows, "v double, w double")
    got = o.weighted_quantiles(df, [], F.col("v"), F.col("w"), {"a": 0.2, "b": 0.21, "c": 0.45, "d": 0.5, "e": 0.95, "f": 0.96}).first()
    assert tuple(got) == (3, 8, 8, 11, 11, 50)


@pytest.mark.parametrize("ranges", [1, 2, 7, 300, 5000])
def test_any_number_of_ranges(spark, ranges):
    """Running totals don't depend on the number of ranges; with many, each holds few of 40,000 values."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 40_000), "value": np.round(rng.lognormal(0, 2, 40_000), 4)})
    rows = spark.createDataFrame(pdf).repartition(4)
    got = o.cumulative(rows, ["g"], ranges=ranges).toPandas().sort_values(["g", "value"])
    want = pdf.groupby(["g", "value"]).size().rename("n").reset_index()
    want["before"] = want.groupby("g").n.cumsum() - want.n
    assert np.array_equal(got[["g", "value", "weight", "before"]].to_numpy(), want.to_numpy())
    freq = rows.groupBy("value").count().withColumn("_family", F.lit(0))
    sizes = [r["count"] for r in o._with_bucket(freq, "value", ranges).groupBy("_bucket").count().collect()]
    assert abs(len(sizes) - ranges) <= max(0.2 * ranges, 8) and (ranges < 300 or max(sizes) < 0.06 * sum(sizes))
