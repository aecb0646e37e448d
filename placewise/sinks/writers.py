"""Result writers: delimited text, map layers, run records, lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.operators.joins import unique

KEEP_NULLS = {"ignoreNullFields": "false"}


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Headered text as other readers expect it: quotes inside quoted text doubled, white space kept."""
    writer = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def point_features(df: DataFrame, lat: str = "latitude", lon: str = "longitude", valid: str = "valid_coordinates") -> DataFrame:
    """One GeoJSON point feature text per row with valid coordinates; nulls stay as JSON null."""
    properties = [c for c in df.columns if c not in (lat, lon, valid)]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.filter(F.col(valid)).select(F.to_json(feature, KEEP_NULLS).alias("value"))


def polygon_features(polygons: DataFrame, indicators: DataFrame, fields: Sequence[str], key: str = "ibge_municipio") -> DataFrame:
    """One GeoJSON polygon feature text per shape that has an indicator row.

    Joined on the six-digit code; a listed field the indicators lack becomes null.
    """
    have = [f for f in fields if f in indicators.columns]
    rows = unique(indicators.select(key, *have), key, "indicators")
    code6 = F.substring("ibge_municipio_7", 1, 6)
    joined = polygons.select(code6.alias(key), "ibge_municipio_7", "coordinates").join(rows, key)
    properties = [F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"),
        F.struct(*properties, "ibge_municipio_7").alias("properties"),
    )
    return joined.select("ibge_municipio_7", F.to_json(feature, KEEP_NULLS).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """Feature texts, one per line."""
    features.select("value").write.mode("overwrite").text(path)


def class_counts(df: DataFrame, c: str) -> DataFrame:
    """Counts per class as one map cell. The number of classes is a property of the rules, not of the data size."""
    counted = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(c).cast("string").alias("k"), "n")))
    return counted.agg(F.map_from_entries(entries).alias(f"{c}_counts"))


def run_metadata(df: DataFrame, classes: Sequence[str], facts: Mapping[str, object] | None = None) -> DataFrame:
    """One row: row count, counts per class column, and constant facts such as weights and limits."""
    out = df.agg(F.count(F.lit(1)).alias("row_count"))
    for c in classes:
        out = out.crossJoin(F.broadcast(class_counts(df, c)))
    return out.withColumns({k: F.lit(v) for k, v in (facts or {}).items()})


def write_metadata(one_row: DataFrame, path: str) -> None:
    one_row.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def lineage(spark: SparkSession, folder: str, datasets: Mapping[str, DataFrame | None]) -> DataFrame:
    """Path, size and SHA-256 of every file under a folder, with rows and columns of the named datasets.

    ``datasets`` maps a path fragment to the frame read from it; absent ones are skipped,
    and files of no dataset keep a null shape.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    )
    match: Column = F.lit(None).cast("string")
    shapes: DataFrame | None = None
    for fragment, df in datasets.items():
        if df is None:
            continue
        match = F.when(F.col("path").contains(fragment), fragment).otherwise(match)
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(fragment).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        shapes = one if shapes is None else shapes.unionByName(one)
    files = files.withColumn("dataset", match)
    if shapes is None:
        return files
    return files.join(F.broadcast(shapes), "dataset", "left")  # one row per named dataset


def narrowed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Published copy: output name -> SQL expression, in that order."""
    return df.select(*[F.expr(e).alias(name) for name, e in columns.items()])


# Columns of the published state layer and where each comes from.
STATE_LAYER = {
    "uf": "uf_sigla",
    "regiao": "regiao_nome",
    "ubs": "ubs_records",
    "municipios": "municipalities",
    "valid_coords": "valid_coordinate_records",
    "missing_coords": "missing_coordinate_records",
    "population_2022": "population",
    "area_km2": "area_km2",
    "ubs_per_100k_pop": "ubs_per_10k_population * 10",
    "ubs_per_1000_km2": "ubs_per_1000_km2",
    "coord_validity_pct": "coordinate_validity_pct",
    "aps_weighted_coverage_pct": "cobertura_aps_ponderada_pct",
    "aps_weighted_capped_coverage_pct": "cobertura_aps_ponderada_capped_pct",
    "priority_score": "aps_priority_score",
}


def state_layer(territory: DataFrame, coverage: DataFrame) -> DataFrame:
    """State territory summary with weighted coverage, narrowed, renamed and rescaled."""
    extra = ["cobertura_aps_ponderada_pct", "cobertura_aps_ponderada_capped_pct", "aps_priority_score"]
    joined = territory.join(coverage.select("uf_sigla", *extra), "uf_sigla", "left")
    return narrowed(joined, STATE_LAYER).orderBy(F.col("ubs").desc(), "uf")
