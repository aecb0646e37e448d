"""Ranks inside weight draws against pandas."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.operators import draws


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"place": np.tile(np.arange(500), 12), "draw": np.repeat(np.arange(12), 500)})
    pdf["value"] = np.where(rng.random(6000) < 0.3, 0.0, rng.gamma(2.0, 9.0, 6000).round(1))
    pdf.loc[::41, "value"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value"))).repartition(5)


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_ranks(scored, ranges):
    """A third of each draw ties at zero; rows without a value go."""
    pdf, df = scored
    got = draws.ranks_in_draws(df, ranges).toPandas().sort_values(["draw", "place"])
    known = pdf.dropna().sort_values(["draw", "place"])
    assert np.array_equal(got[["place", "draw", "value"]].to_numpy(), known[["place", "draw", "value"]].to_numpy())
    assert np.allclose(got["rank"], known.groupby("draw")["value"].rank(ascending=False))
    assert np.array_equal(got["total"], known.groupby("draw")["value"].transform("size"))


def test_rows_travel_once(spark, scored):
    """Of the exchanges only one carries the places; the others carry counts and splits."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        source = spark.range(900).selectExpr("id AS place", "id % 9 AS draw", "double(id) AS value")
        plan = draws.ranks_in_draws(source)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    lines = plan.split("\n")
    exchanges = [k for k, x in enumerate(lines) if re.search("Exchange hashpartitioning", x)]
    below = [next(x for x in lines[k + 1 :] if "Project" in x or "HashAggregate" in x) for k in exchanges]
    assert sum("place#" in x for x in below) == 1, plan
