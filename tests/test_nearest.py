"""Nearest-facility join against brute force, with a dense cluster and a hot coordinate."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.operators import nearest
from placewise.operators.nearest import RADIUS_KM, nearest_facility


def sphere(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.c_[np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n, m = 900, 900
    k = m // 3
    fac = pd.DataFrame(
        {
            "facility_id": [f"f{i:05d}" for i in range(m)],
            "latitude": np.r_[rng.uniform(-34, 6, k), rng.normal(-23.5, 0.01, k), np.full(m - 2 * k, -10.0)],
            "longitude": np.r_[rng.uniform(-74, -34, k), rng.normal(-46.6, 0.01, k), np.full(m - 2 * k, -50.0)],
        }
    )
    org = pd.DataFrame(
        {
            "k": range(n),
            "origin_latitude": np.r_[rng.uniform(-60, 20, n // 2), rng.normal(-23.5, 0.5, n - n // 2)],
            "origin_longitude": np.r_[rng.uniform(-180, 180, n // 2), rng.normal(-46.6, 0.5, n - n // 2)],
        }
    )
    df = spark.createDataFrame(org).withColumn(
        "origin_latitude", F.when(F.col("k") != 7, F.col("origin_latitude"))
    )
    got = nearest_facility(df, spark.createDataFrame(fac), "x").toPandas().sort_values("k")
    a, b = sphere(org.origin_latitude, org.origin_longitude), sphere(fac.latitude, fac.longitude)
    chord = np.linalg.norm(a[:, None, :] - b[None, :, :], axis=2).min(axis=1)
    km = 2 * np.arcsin(np.clip(chord / 2, 0, 1)) * RADIUS_KM
    km[7] = np.nan
    assert np.allclose(got.nearest_x_geodesic_km, km, atol=1e-6, equal_nan=True)
    assert got[got.k == 7].nearest_x_id.isna().all()


def test_same_point_is_zero(spark):
    o = spark.createDataFrame([("1", -10.0, -50.0)], "ibge_municipio_7 string, origin_latitude double, origin_longitude double")
    f = spark.createDataFrame([("x", -10.0, -50.0)], "facility_id string, latitude double, longitude double")
    row = nearest_facility(o, f, "ubs").first()
    assert row.nearest_ubs_id == "x" and row.nearest_ubs_geodesic_km == 0.0


def test_no_valid_facility_is_an_error(spark):
    o = spark.createDataFrame([(-10.0, -50.0)], "origin_latitude double, origin_longitude double")
    f = spark.createDataFrame([("x", 40.0, 10.0)], "facility_id string, latitude double, longitude double")
    with pytest.raises(ValueError):
        nearest_facility(o, f, "ubs")


def test_points_of_a_cell_travel_together(spark, monkeypatch):
    """An origin meets a cell as one row with its points, so that it gives one row, not one for each point."""
    kept = {}

    def stored(df, name):
        kept[name] = df.localCheckpoint()
        return kept[name]

    monkeypatch.setattr(nearest, "stored", stored)
    rng = np.random.default_rng(5)
    rows = [(f"f{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-30, 0, 400), rng.uniform(-70, -40, 400)))]
    points = spark.createDataFrame(rows, "facility_id string, latitude double, longitude double")
    origins = points.selectExpr("latitude + 0.01 AS origin_latitude", "longitude AS origin_longitude")
    assert nearest_facility(origins, points, "x").filter("nearest_x_id IS NULL").count() == 0
    cells = kept["baits"].groupBy(*nearest.CELL).agg(F.count("*").alias("n"))
    assert cells.filter("n > 1").count() == 0 and kept["baits"].agg(F.max(F.size("points"))).first()[0] > 8
