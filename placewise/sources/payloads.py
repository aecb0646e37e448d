"""JSON payloads to tables. Every function takes a frame of payload texts, one document per row.

A malformed document stops the job. One document is parsed in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.functions.columns import in_box, localized_number, plain_text
from placewise.operators.joins import first_per_key
from placewise.sources import schemas

STRICT = {"mode": "FAILFAST"}


def polygons(payloads: DataFrame, text: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Code, multipolygon and bounding box per feature. A single polygon is wrapped; empty geometry is dropped."""
    parsed = payloads.select(*keep, F.from_json(text, schemas.FEATURE_COLLECTION, STRICT).alias("p"))
    feature = parsed.select(*keep, F.explode("p.features").alias("f")).select(
        *keep,
        F.trim("f.properties.codarea").alias("ibge_municipio_7"),
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("raw"),
    )
    many = F.from_json("raw", geo.MULTIPOLYGON, STRICT)
    one = F.array(F.from_json("raw", "array<array<array<double>>>", STRICT))
    shaped = feature.withColumn(
        "coordinates", F.when(F.col("kind") == "MultiPolygon", many).when(F.col("kind") == "Polygon", one)
    )
    usable = (F.col("ibge_municipio_7") != "") & (F.size("coordinates") > 0)
    return (
        shaped.filter(usable)
        .withColumn("bbox", geo.bounding_box(F.col("coordinates")))
        .select(*keep, "ibge_municipio_7", "coordinates", "bbox")
    )


def place_hierarchy(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Place > micro > meso > state > region, with the second nesting where the first is null."""
    p = payloads.select(F.from_json(text, schemas.PLACE_HIERARCHY, STRICT).alias("p"))
    near = F.col("p.`regiao-imediata`")
    state = F.coalesce(F.col("p.microrregiao.mesorregiao.UF"), near["regiao-intermediaria"]["UF"])
    code = F.col("p.id")
    rows = p.select(
        F.substring(code.cast("string"), 1, 6).alias("ibge_municipio"),
        code.cast("string").alias("ibge_municipio_7"),
        F.col("p.nome").alias("municipio_nome_oficial"),
        F.col("p.microrregiao.nome").alias("microrregiao_nome"),
        F.col("p.microrregiao.mesorregiao.nome").alias("mesorregiao_nome"),
        state["sigla"].alias("uf_sigla_oficial"),
        state["nome"].alias("uf_nome_oficial"),
        state["regiao"]["nome"].alias("regiao_nome_oficial"),
        near["nome"].alias("regiao_imediata_nome"),
        near["regiao-intermediaria"]["nome"].alias("regiao_intermediaria_nome"),
    )
    return first_per_key(rows, "ibge_municipio", [F.col("ibge_municipio_7")])


# Classification, its categories, and the count and percent variables.
INTERNET_CLASSIFICATION = "2072"
INTERNET_CATEGORIES = {"77584": "total", "77585": "with_internet", "77586": "without_internet"}
COUNT_VARIABLE, PERCENT_VARIABLE = "381", "1000381"


def internet_statistics(payloads: DataFrame, text: str = "payload", year: str = "2022") -> DataFrame:
    """One row per place with household counts and percents per internet category."""
    variable = payloads.select(F.explode(F.from_json(text, schemas.STATISTICS, STRICT)).alias("v"))
    result = variable.select(F.col("v.id").alias("variable"), F.explode("v.resultados").alias("r"))
    wanted = F.filter("r.classificacoes", lambda c: c["id"] == INTERNET_CLASSIFICATION)
    category = F.element_at(F.map_keys(F.get(wanted, 0)["categoria"]), 1)
    series = (
        result.withColumn("category", category)
        .filter(F.col("category").isin(*INTERNET_CATEGORIES))
        .select("variable", "category", F.explode("r.series").alias("s"))
        .select(
            "variable",
            "category",
            F.col("s.localidade.id").alias("ibge_municipio_7"),
            F.col("s.localidade.nome").alias("municipio_nome_sidra"),
            localized_number(F.col("s.serie")[year]).alias("value"),
        )
    )

    def cell(variable: str, code: str) -> Column:
        hit = (F.col("variable") == variable) & (F.col("category") == code)
        return F.max(F.when(hit, F.col("value")))

    counts = [cell(COUNT_VARIABLE, k).alias(f"households_{n}") for k, n in INTERNET_CATEGORIES.items()]
    shares = [
        cell(PERCENT_VARIABLE, k).alias(f"households_{n}_pct") for k, n in INTERNET_CATEGORIES.items() if n != "total"
    ]
    return series.groupBy("ibge_municipio_7").agg(
        F.min("municipio_nome_sidra").alias("municipio_nome_sidra"), *counts, *shares
    )


def map_features(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Point or way-centre features with tags as columns, one row per ``type/id``."""
    p = payloads.select(F.from_json(text, schemas.MAP_FEATURES, STRICT).alias("p"))
    e = p.select(F.col("p.osm3s.timestamp_osm_base").alias("base_timestamp"), F.explode("p.elements").alias("e"))
    rows = e.select(
        F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("osm_feature_id"),
        F.col("e.type").alias("osm_type"),
        F.col("e.id").alias("osm_id"),
        *[F.col("e.tags")[t].alias(t) for t in ("name", "operator", "brand")],
        F.coalesce("e.lat", "e.center.lat").alias("latitude"),
        F.coalesce("e.lon", "e.center.lon").alias("longitude"),
        F.lit("OpenStreetMap amenity=pharmacy").alias("source"),
        "base_timestamp",
    ).dropna(subset=["latitude", "longitude"])
    unique = first_per_key(rows, "osm_feature_id", [F.col("latitude"), F.col("longitude"), F.col("name")])
    return unique.withColumn("valid_coordinates", in_box("latitude", "longitude", -28))


def parse_route(c: Column) -> tuple[Column, Column, Column]:
    """Minutes, kilometres and status of one stored route response text."""
    r = F.from_json(c, schemas.ROUTE_RESPONSE)
    ok = F.coalesce((r["code"] == "Ok") & (F.size(r["routes"]) > 0), F.lit(False))
    first = F.get(r["routes"], 0)
    status = F.when(ok, "routed").otherwise(F.concat(F.lit("osrm_"), F.coalesce(r["code"], F.lit("missing_route"))))
    return F.when(ok, first["duration"] / 60), F.when(ok, first["distance"] / 1000), status


def label_metric(label: Column | str) -> Column:
    """Metric name of a variable label."""
    plain = plain_text(label)
    return (
        F.when(plain.contains("populacao"), "populacao_residente")
        .when(plain.contains("area"), "area_km2")
        .when(plain.contains("densidade"), "densidade_demografica")
        .otherwise(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    )


def label_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate column whose content names a known metric (one scalar row is read)."""
    known = [
        F.max(plain_text(c).rlike("populacao|area|densidade").cast("int")).alias(f"c{i}")
        for i, c in enumerate(candidates)
    ]
    row = df.agg(*known).first()
    for i, c in enumerate(candidates):
        if row[i]:
            return c
    raise ValueError("Could not identify the variable label column")


METRICS = ("populacao_residente", "area_km2", "densidade_demografica")


def label_value_table(df: DataFrame, code: str, name: str, label: str, value: str) -> DataFrame:
    """Long key / label / value rows to one row per place with a column per metric."""
    long = df.select(
        F.col(code).cast("string").alias("ibge_municipio_7"),
        F.substring(F.col(code).cast("string"), 1, 6).alias("ibge_municipio"),
        F.col(name).alias("municipio_nome_sidra"),
        label_metric(label).alias("metric"),
        localized_number(value).alias("v"),
    )
    return long.groupBy("ibge_municipio", "ibge_municipio_7", "municipio_nome_sidra").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("v"))).alias(m) for m in METRICS]
    )


# ---- periods and file listings ----------------------------------------------------


def newest_period(df: DataFrame, period: str, order: Column | None = None) -> DataFrame:
    """Rows of the newest period. The newest value is one row, joined back as a filter; no rows are an error."""
    rank = F.col(period) if order is None else order
    newest = F.max(F.struct(rank.alias("o"), F.col(period).alias("p")))["p"]
    top = df.agg(F.coalesce(newest, F.raise_error(F.lit(f"no rows with a period in {period}"))).alias("_newest"))
    return df.join(F.broadcast(top), F.col(period) == F.col("_newest")).drop("_newest")


def recent_files(listing: DataFrame, prefix: str, last: int = 1, name: str = "name") -> DataFrame:
    """The newest ``last`` files per state from a listing of '<prefix><UF><yymm>[a-z].dbc' names.

    The listing is partitioned by state; a file name counts in any letter case.
    """
    pattern = rf"(?i)^{prefix}([A-Z]{{2}})(\d{{4}})[a-z]?\.dbc$"
    hit = listing.filter(F.col(name).rlike(pattern)).select(
        F.regexp_extract(name, pattern, 1).alias("uf"), F.regexp_extract(name, pattern, 2).alias("yymm"), name
    )
    order = Window.partitionBy("uf").orderBy(F.col("yymm").desc(), F.col(name).desc())
    return hit.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= last).drop("rn")


def newest_member(listing: DataFrame, name: str = "name") -> DataFrame:
    """The municipal coverage member with the newest year and month, as one row."""
    pattern = r"^Cobertura_(\d{4})_(\d{2})_Municipios\.csv$"
    hit = listing.filter(F.col(name).rlike(pattern))
    key = F.struct(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2), F.col(name).alias("n"))
    return hit.agg(F.max(key)["n"].alias(name))


def select_seats(records: DataFrame) -> DataFrame:
    """Municipal seat points by category text, one per place; a point outside the national box is an error."""
    category, sub = F.lower("CT_LOCALID"), F.lower("SCT_LOCALI")
    wanted = sub.isin("sede municipal", "capital federal") | (category == "distrito estadual de fernando de noronha")
    rows = records.filter(F.coalesce(wanted, F.lit(False))).select(
        F.col("CD_MUN").cast("string").alias("ibge_municipio_7"),
        F.col("NM_MUN").alias("municipio_nome_ibge_seat"),
        F.col("SIGLA_UF").alias("uf_sigla_ibge_seat"),
        F.col("LAT_LOCALI").cast("double").alias("seat_latitude"),
        F.col("LONG_LOCAL").cast("double").alias("seat_longitude"),
        F.col("CT_LOCALID").alias("seat_category"),
        F.col("SCT_LOCALI").alias("seat_subcategory"),
    )
    one = first_per_key(rows, "ibge_municipio_7", [F.col("seat_subcategory"), F.col("seat_latitude"), F.col("seat_longitude")])
    out_of_box = F.raise_error(F.concat(F.lit("Seat coordinate outside national bounds: "), F.col("ibge_municipio_7")))
    checked = F.when(in_box("seat_latitude", "seat_longitude", -28), F.col("seat_latitude")).otherwise(out_of_box.cast("double"))
    return one.withColumn("seat_latitude", checked)


def stack_coverage(df: DataFrame, media: str, columns: Mapping[str, str] | list[str]) -> DataFrame:
    """Non-null count and share per column named '<x>_<region>_<mode>', as rows."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = []
    for c in columns:
        _, region, mode = c.split("_")
        rows.append(
            F.struct(
                F.lit(media).alias("media"),
                F.lit(region.upper()).alias("region"),
                F.lit(mode).alias("mode"),
                F.col(c).alias("available_count"),
                (F.try_divide(F.col(c).cast("double"), F.col("_n")) * 100).alias("coverage_pct"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))
