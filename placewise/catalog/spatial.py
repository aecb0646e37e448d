"""Geometry, polygon and nearest-facility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case, stage
from placewise.functions import geo
from placewise.functions.columns import great_circle_km, zero_pad
from placewise.operators.aggregates import share_of
from placewise.operators.joins import check_declared_polygon
from placewise.operators.nearest import RADIUS_KM, nearest_facility
from placewise.operators.ordering import weighted_quantiles
from placewise.plans import access, supply
from placewise.plans import territory as terr
from placewise.sources import payloads as payload


def payloads(t):
    """GeoJSON texts, one feature collection per place."""

    def ring(a, b, c, d):
        points = [(a, c), (b, c), (b, d), (a, d), (a, c)]
        return F.array(*[F.array(x, y) for x, y in points])

    lon, lat = F.col("center_lon"), F.col("center_lat")
    outer = ring(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))
    hole = ring(lon - 0.02, lon + 0.02, lat - 0.02, lat + 0.02)
    one = F.to_json(F.array(outer))
    many = F.to_json(F.array(F.array(outer, hole)))
    has_hole = F.coalesce("has_hole", F.lit(False))
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"properties":{"codarea":"'),
        F.col("ibge_municipio_7"),
        F.lit('"},"geometry":{"type":"'),
        F.when(has_hole, "MultiPolygon").otherwise("Polygon"),
        F.lit('","coordinates":'),
        F.when(has_hole, many).otherwise(one),
        F.lit('}},{"properties":{"codarea":"x"},"geometry":{"type":"Polygon","coordinates":[]}}]}'),
    )
    return t.st_squares.select(text.alias("payload"))


def shapes(t):
    return payload.polygons(payloads(t)).filter(F.length("ibge_municipio_7") == 7)


# ---- geometry ---------------------------------------------------------------------------------


def own_square(t):
    """Facilities with the shape of their declared place; those without coordinates too."""
    return t.st_registry.join(stage(t, "shapes", lambda: shapes(t)), "ibge_municipio_7")


def where_located(hit):
    """Null without coordinates."""
    return F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), hit)


LOCATED = "CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN"


@case(
    "ge_01_great_circle",
    """SELECT a.m, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.center_lat - a.center_lat) / 2), 2)
       + cos(radians(a.center_lat)) * cos(radians(b.center_lat)) * pow(sin(radians(b.center_lon - a.center_lon) / 2), 2)))) AS km
       FROM st_places a JOIN st_places b ON b.m = a.m + 1""",
    "km:5",
)
def _(t):
    a = t.st_places.select("m", F.col("center_lat").alias("y1"), F.col("center_lon").alias("x1"))
    b = t.st_places.select((F.col("m") - 1).alias("m"), F.col("center_lat").alias("y2"), F.col("center_lon").alias("x2"))
    km = great_circle_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"), RADIUS_KM)
    return a.join(b, "m").select("m", km.alias("km"))


@case(
    "ge_02_ring_area_centroid",
    "SELECT ibge_municipio_7, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM st_squares",
    "area lon lat",
)
def _(t):
    c = geo.ring_area_centroid(F.col("coordinates")[0][0])
    return shapes(t).select("ibge_municipio_7", c.alias("c")).select("ibge_municipio_7", "c.*")


@case(
    "ge_03_main_ring_centroid",
    "SELECT ibge_municipio_7, (x0 + x1) / 2 AS centroid_longitude, (y0 + y1) / 2 AS centroid_latitude, true AS centroid_inside_main_polygon FROM st_squares",
    "centroid_longitude centroid_latitude",
)
def _(t):
    return access.polygon_centroids(shapes(t))


@case(
    "ge_04_point_in_ring",
    f"""SELECT cnes, {LOCATED} longitude >= x0 AND longitude < x1 AND latitude >= y0 AND latitude < y1 END AS inside FROM st_registry
       JOIN st_squares USING (ibge_municipio_7)""",
)
def _(t):
    hit = geo.in_ring(F.col("longitude"), F.col("latitude"), F.col("coordinates")[0][0])
    return own_square(t).select("cnes", where_located(hit).alias("inside"))


INSIDE = """(longitude BETWEEN x0 - 1e-10 AND x1 + 1e-10 AND latitude BETWEEN y0 - 1e-10 AND y1 + 1e-10
  AND NOT (coalesce(has_hole, false) AND longitude BETWEEN center_lon - 0.02 - 1e-10 AND center_lon + 0.02 + 1e-10
  AND latitude BETWEEN center_lat - 0.02 - 1e-10 AND center_lat + 0.02 + 1e-10))"""


@case(
    "ge_05_point_in_multipolygon",
    f"SELECT cnes, {LOCATED} {INSIDE} END AS inside FROM st_registry JOIN st_squares USING (ibge_municipio_7)",
)
def _(t):
    hit = geo.in_multipolygon(F.col("longitude"), F.col("latitude"), F.col("coordinates"), F.col("bbox"))
    return own_square(t).select("cnes", where_located(hit).alias("inside"))


@case(
    "ge_06_representative_point",
    "SELECT ibge_municipio_7, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM st_squares",
    "lon lat",
)
def _(t):
    p = geo.representative_point(geo.all_rings(F.col("coordinates")))
    return shapes(t).select("ibge_municipio_7", p.alias("p")).select("ibge_municipio_7", "p.*")


ORIGIN_SQL = """SELECT u.ibge_municipio_7, u.ibge_municipio, coalesce(s.seat_latitude, (y0 + y1) / 2) AS origin_latitude,
  coalesce(s.seat_longitude, (x0 + x1) / 2) AS origin_longitude, CASE WHEN s.seat_latitude IS NOT NULL THEN 'official_ibge_2022_municipal_seat'
    ELSE 'centroid_of_largest_simplified_municipal_polygon' END AS origin_method,
  s.seat_latitude IS NOT NULL OR q.x0 IS NOT NULL AS origin_quality_valid
  FROM st_universe u LEFT JOIN st_squares q USING (ibge_municipio_7) LEFT JOIN st_seats s USING (ibge_municipio_7)"""


def origins(t):
    return stage(t, "municipal_origins", lambda: access.municipal_origins(t.st_universe, shapes(t), t.st_seats))


@case("ge_07_origin_choice", ORIGIN_SQL, "origin_latitude origin_longitude")
def _(t):
    return origins(t).select(
        "ibge_municipio_7", "ibge_municipio", "origin_latitude", "origin_longitude", "origin_method", "origin_quality_valid"
    )


@case(
    "ge_09_select_seats",
    """SELECT ibge_municipio_7, center_lat AS seat_latitude, center_lon AS seat_longitude FROM st_places WHERE area_km2 > 1000""",
    "seat_latitude seat_longitude",
)
def _(t):
    kind = F.when(F.col("area_km2") > 4000, "CAPITAL FEDERAL").when(F.col("area_km2") > 1000, "Sede Municipal").otherwise("Vila")
    records = t.st_places.select(
        F.col("ibge_municipio_7").alias("CD_MUN"), F.col("municipio_nome_ibge").alias("NM_MUN"), F.col("uf_sigla").alias("SIGLA_UF"),
        F.col("center_lat").alias("LAT_LOCALI"), F.col("center_lon").alias("LONG_LOCAL"), F.lit("CIDADE").alias("CT_LOCALID"),
        kind.alias("SCT_LOCALI"),
    )
    return payload.select_seats(records.union(records)).select("ibge_municipio_7", "seat_latitude", "seat_longitude")


# ---- joins on position -------------------------------------------------------------------------


@case(
    "jn_12_declared_polygon",
    f"""SELECT cnes, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinates'
        WHEN NOT (latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -34) THEN 'outside_brazil_bbox'
        WHEN x0 IS NULL THEN 'missing_municipal_polygon' WHEN {INSIDE} THEN 'inside_declared_municipality'
        ELSE 'outside_declared_municipality' END AS status FROM st_registry LEFT JOIN st_squares USING (ibge_municipio_7)""",
)
def _(t):
    out = check_declared_polygon(t.st_registry, shapes(t), "ibge_municipio_7")
    return out.select("cnes", F.col("spatial_validation_status").alias("status"))


VALIDATION_SQL = f"""WITH v AS (SELECT uf AS uf_sigla, region, latitude IS NULL OR longitude IS NULL AS miss,
    NOT coalesce(latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -34, true) AS outb, x0 IS NULL AS nop, {INSIDE} AS ins
    FROM st_registry LEFT JOIN st_squares USING (ibge_municipio_7))
  SELECT uf_sigla, region, count(*) AS ubs_records, count(*) FILTER (NOT miss AND NOT outb AND NOT nop AND ins) AS inside_declared_municipality,
    count(*) FILTER (NOT miss AND NOT outb AND NOT nop AND NOT ins) AS outside_declared_municipality, count(*) FILTER (miss) AS missing_coordinates,
    count(*) FILTER (NOT miss AND outb) AS outside_brazil_bbox, count(*) FILTER (NOT miss AND NOT outb AND nop) AS missing_municipal_polygon,
    (count(*) - count(*) FILTER (NOT miss AND NOT outb AND NOT nop AND ins)) * 1e2 / count(*) AS spatial_issue_pct FROM v GROUP BY 1, 2"""


def validation(t):
    return terr.spatial_validation(t.st_registry.withColumnRenamed("uf", "uf_sigla"), stage(t, "shapes", lambda: shapes(t)))


@case("ix_26_spatial_validation", VALIDATION_SQL, "spatial_issue_pct")
def _(t):
    return validation(t)[0].drop("inside_declared_municipality_pct", "spatial_issue_records")


@case(
    "ix_27_active_facilities",
    f"""SELECT r.cnes AS facility_id, latitude, longitude FROM st_registry r JOIN st_registry_latest l USING (cnes) JOIN st_squares q USING (ibge_municipio_7)
        WHERE latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -34 AND {INSIDE}""",
    "latitude longitude",
)
def _(t):
    present = t.st_registry_latest.select("cnes", F.lit(True).alias("cnes_present_latest_st"))
    return supply.active_facilities(t.st_registry, present, validation(t)[1])


def nearest_sql(origins: str, facilities: str, key: str, label: str) -> str:
    """Brute force over all pairs."""
    return f"""(SELECT {key}, min(struct_pack(km := km, id := fid)) AS best FROM (SELECT o.{key}, f.facility_id AS fid,
      floor(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(f.latitude - o.origin_latitude) / 2), 2) + cos(radians(o.origin_latitude))
      * cos(radians(f.latitude)) * pow(sin(radians(f.longitude - o.origin_longitude) / 2), 2)))) * 1e9 + 0.5) / 1e9 AS km
      FROM {origins} o CROSS JOIN {facilities} f WHERE f.latitude BETWEEN -34 AND 6 AND f.longitude BETWEEN -74 AND -28
        AND o.origin_latitude IS NOT NULL) x GROUP BY {key}) AS near_{label}"""


@case(
    "jn_11_nearest_facility",
    f"""WITH o AS ({ORIGIN_SQL}), f AS (SELECT cnes AS facility_id, latitude, longitude FROM st_registry)
        SELECT o.ibge_municipio_7, near_ubs.best.km AS nearest_ubs_geodesic_km, near_ubs.best.id AS nearest_ubs_id
        FROM o LEFT JOIN {nearest_sql('o', 'f', 'ibge_municipio_7', 'ubs')} USING (ibge_municipio_7)""",
    "nearest_ubs_geodesic_km:3",
)
def _(t):
    facilities = t.st_registry.withColumnRenamed("cnes", "facility_id")
    return nearest_facility(origins(t), facilities, "ubs").select("ibge_municipio_7", "nearest_ubs_geodesic_km", "nearest_ubs_id")


CLINICS = "SELECT 'c' || ibge_municipio_7 AS facility_id, seat_latitude AS latitude, seat_longitude AS longitude FROM st_seats"
REACH_CTES = f"""clinic AS ({CLINICS}), acc AS (SELECT o.*, near_ubs.best.km AS ukm, near_ubs.best.id AS uid, near_pharmacy.best.km AS pkm, near_pharmacy.best.id AS pid
  FROM st_origins o LEFT JOIN {nearest_sql('st_origins', 'clinic', 'origin_id', 'ubs')} USING (origin_id)
  LEFT JOIN {nearest_sql('st_origins', 'st_pharmacies', 'origin_id', 'pharmacy')} USING (origin_id))"""


def clinics(t):
    return t.st_seats.select(
        F.concat(F.lit("c"), "ibge_municipio_7").alias("facility_id"), F.col("seat_latitude").alias("latitude"), F.col("seat_longitude").alias("longitude")
    )


def reach(t):
    return stage(t, "origin_access", lambda: access.origin_access(t.st_origins, clinics(t), t.st_pharmacies))


@case(
    "ix_40_origin_access",
    f"WITH {REACH_CTES} SELECT origin_id, ukm AS nearest_ubs_geodesic_km, pkm AS nearest_pharmacy_geodesic_km FROM acc",
    "nearest_ubs_geodesic_km:3 nearest_pharmacy_geodesic_km:3",
)
def _(t):
    return reach(t).select("origin_id", "nearest_ubs_geodesic_km", "nearest_pharmacy_geodesic_km")


WSUM = "sum(CASE WHEN {0} THEN origin_population ELSE 0 END) / nullif(sum(CASE WHEN ukm IS NOT NULL AND pkm IS NOT NULL AND origin_population > 0 THEN origin_population ELSE 0 END), 0)"
ACCESS_SQL = f"""WITH {REACH_CTES},
ru AS (SELECT *, sum(origin_population) OVER (PARTITION BY ibge_municipio_7 ORDER BY ukm) AS cu, sum(origin_population) OVER (PARTITION BY ibge_municipio_7 ORDER BY pkm) AS cp,
    sum(origin_population) OVER (PARTITION BY ibge_municipio_7) AS tot FROM acc WHERE origin_population > 0),
qs AS (SELECT ibge_municipio_7, min(ukm) FILTER (cu >= 0.5 * tot) AS u50, min(ukm) FILTER (cu >= 0.9 * tot) AS u90, min(pkm) FILTER (cp >= 0.5 * tot) AS p50 FROM ru GROUP BY 1),
sm AS (SELECT ibge_municipio_7, count(*) AS phase5_population_origins, sum(origin_population) AS people,
    sum(ukm * origin_population) / nullif(sum(origin_population), 0) AS mean_u, {WSUM.format('ukm > 5')} AS far, {WSUM.format('pkm <= 2')} AS near,
    {WSUM.format('ukm > 5 AND pkm <= 2')} AS both_share FROM acc GROUP BY 1)
SELECT sm.ibge_municipio_7, phase5_population_origins, people AS phase5_origin_population, mean_u AS phase5_weighted_mean_ubs_km, u50 AS phase5_weighted_p50_ubs_km,
  u90 AS phase5_weighted_p90_ubs_km, p50 AS phase5_weighted_p50_pharmacy_km, far AS phase5_population_share_ubs_gt_5km, near AS phase5_population_share_pharmacy_le_2km,
  both_share AS phase5_population_share_hard_ubs_easy_pharmacy, people / nullif(populacao_residente, 0) AS phase5_population_origin_coverage_ratio,
  populacao_residente / nullif(pharmacies, 0) AS phase5_population_per_pfpb_pharmacy FROM sm LEFT JOIN qs USING (ibge_municipio_7) LEFT JOIN st_gap_base USING (ibge_municipio_7)"""
ACCESS_ROUNDED = (
    "phase5_origin_population phase5_weighted_mean_ubs_km:4 phase5_weighted_p50_ubs_km:4 phase5_weighted_p90_ubs_km:4 phase5_weighted_p50_pharmacy_km:4 "
    "phase5_population_share_ubs_gt_5km phase5_population_share_pharmacy_le_2km phase5_population_share_hard_ubs_easy_pharmacy "
    "phase5_population_origin_coverage_ratio phase5_population_per_pfpb_pharmacy"
)


@case("ix_41_municipal_access", ACCESS_SQL, ACCESS_ROUNDED)
def _(t):
    out = access.municipal_access(reach(t), t.st_gap_base)
    return out.select("ibge_municipio_7", "phase5_population_origins", *[c.split(":")[0] for c in ACCESS_ROUNDED.split()])


@case(
    "ag_09_weighted_quantile",
    """WITH r AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS tot FROM lineitem)
       SELECT l_returnflag, min(l_extendedprice) FILTER (c >= 0.5 * tot) AS p50, min(l_extendedprice) FILTER (c >= 0.9 * tot) AS p90 FROM r GROUP BY 1""",
)
def _(t):
    return weighted_quantiles(t.lineitem, ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity"), {"p50": 0.5, "p90": 0.9})


@case(
    "ag_17_population_shares",
    """SELECT ibge_municipio_7, sum(CASE WHEN origin_latitude > -15 THEN origin_population ELSE 0 END) / nullif(sum(origin_population), 0) AS share
       FROM st_origins GROUP BY 1""",
    "share",
)
def _(t):
    share = share_of(F.col("origin_population"), F.col("origin_latitude") > -15, F.col("origin_population") > 0)
    return t.st_origins.groupBy("ibge_municipio_7").agg(share.alias("share"))


@case(
    "ix_28_mismatch_flags",
    """WITH b AS (SELECT s.*, g.pharmacies, nearest_ubs_geodesic_km IS NOT NULL AS ok FROM st_spatial s JOIN st_gap_base g USING (ibge_municipio)),
       q AS (SELECT quantile_cont(nearest_ubs_geodesic_km, 0.75) AS u, quantile_cont(CASE WHEN ok THEN nearest_pharmacy_geodesic_km END, 0.25) AS p FROM b)
       SELECT ibge_municipio, coalesce(ok AND pharmacies > 0 AND nearest_ubs_geodesic_km >= u AND nearest_pharmacy_geodesic_km <= p, false) AS relative_hard_ubs_easy_pharmacy_flag,
         coalesce(ok AND pharmacies > 0 AND nearest_ubs_geodesic_km >= 3 AND nearest_pharmacy_geodesic_km <= 2, false) AS hard_ubs_easy_pharmacy_flag_3km_2km,
         coalesce(ok AND pharmacies > 0 AND nearest_ubs_geodesic_km >= 5 AND nearest_pharmacy_geodesic_km <= 2, false) AS hard_ubs_easy_pharmacy_flag,
         coalesce(ok AND pharmacies > 0 AND nearest_ubs_geodesic_km >= 10 AND nearest_pharmacy_geodesic_km <= 5, false) AS hard_ubs_easy_pharmacy_flag_10km_5km FROM b, q""",
)
def _(t):
    base = t.st_spatial.drop("hard_ubs_easy_pharmacy_flag").join(t.st_gap_base.select("ibge_municipio", "pharmacies"), "ibge_municipio")
    return access.classify_mismatch(base).select(
        "ibge_municipio", "relative_hard_ubs_easy_pharmacy_flag", "hard_ubs_easy_pharmacy_flag_3km_2km", "hard_ubs_easy_pharmacy_flag",
        "hard_ubs_easy_pharmacy_flag_10km_5km",
    )


# ---- population origins -----------------------------------------------------------------------------

PROXY_SQL = """SELECT ibge_municipio_7 || '_municipal_proxy' AS origin_id, ibge_municipio_7, coalesce(CAST(populacao_residente AS DOUBLE), 0) AS origin_population,
  CASE WHEN populacao_residente IS NULL THEN 'missing_population_not_scored' ELSE 'needs_intramunicipal_population_origins' END AS precision_status FROM st_places"""


def proxies(t):
    return access.proxy_origins(
        t.st_places.withColumns({"origin_latitude": F.col("center_lat"), "origin_longitude": F.col("center_lon")})
    )


@case("ix_35_proxy_origins", PROXY_SQL, "origin_population")
def _(t):
    return proxies(t).select("origin_id", "ibge_municipio_7", "origin_population", "precision_status")


@case(
    "ix_36_supplied_origins",
    """SELECT origin_id, ibge_municipio_7, origin_population, source_year, 'intramunicipal_population_origins_loaded' AS precision_status FROM st_origins""",
    "origin_population",
)
def _(t):
    return access.normalize_origins(t.st_origins.withColumn("origin_population", F.col("origin_population").cast("string"))).select(
        "origin_id", "ibge_municipio_7", "origin_population", "source_year", "precision_status"
    )


@case(
    "ix_37_blended_origins",
    f"""SELECT origin_id, ibge_municipio_7, origin_population FROM st_origins UNION ALL SELECT origin_id, ibge_municipio_7, origin_population
        FROM ({PROXY_SQL}) p WHERE ibge_municipio_7 NOT IN (SELECT ibge_municipio_7 FROM st_origins)""",
    "origin_population",
)
def _(t):
    return access.blend_origins(t.st_origins, proxies(t)).select("origin_id", "ibge_municipio_7", "origin_population")


@case(
    "ix_38_origin_rules",
    """SELECT unnest(['repeated_id', 'missing_code', 'outside_box', 'bad_population']) AS rule, unnest([(SELECT count(*) FROM (SELECT origin_id FROM st_origins
       GROUP BY 1 HAVING count(*) > 1) x), 0, (SELECT count(*) FROM st_origins WHERE NOT (origin_latitude BETWEEN -34 AND 6 AND origin_longitude BETWEEN -74 AND -28)), 0]) AS violations""",
)
def _(t):
    return access.violations(t.st_origins)


@case(
    "ix_39_sector_origins",
    """SELECT q.ibge_municipio_7 AS origin_id, (y0 + y1) / 2 AS origin_latitude, coalesce(CAST(p.populacao_residente AS DOUBLE), 0) AS origin_population,
       CASE WHEN p.populacao_residente IS NOT NULL THEN 'available' ELSE 'missing_sector_population_not_scored' END AS origin_population_status
       FROM st_squares q LEFT JOIN (SELECT ibge_municipio_7, area_km2, CASE WHEN area_km2 < 2000 THEN populacao_residente END AS populacao_residente FROM st_places) p USING (ibge_municipio_7)""",
    "origin_latitude origin_population",
)
def _(t):
    sectors = shapes(t).select(
        F.col("ibge_municipio_7").alias("CD_SETOR"), F.col("ibge_municipio_7").alias("CD_MUN"), geo.all_rings(F.col("coordinates")).alias("rings")
    )
    people = t.st_places.filter("area_km2 < 2000").select(F.col("ibge_municipio_7").alias("CD_SETOR"), F.col("populacao_residente").alias("people"))
    return access.sector_origins(sectors, people).select("origin_id", "origin_latitude", "origin_population", "origin_population_status")


# ---- routing --------------------------------------------------------------------------------------------

SHORT_SQL = """SELECT p.ibge_municipio_7, municipio_nome_ibge, uf_sigla, m, center_lat, center_lon, area_km2, nearest_ubs_geodesic_km AS ukm, nearest_pharmacy_geodesic_km AS pkm
  FROM st_places p JOIN st_spatial s USING (ibge_municipio) WHERE hard_ubs_easy_pharmacy_flag"""
PAIR_SQL = f"""WITH sl AS ({SHORT_SQL}), pr AS (
  SELECT ibge_municipio_7, municipio_nome_ibge, uf_sigla, m, 'active_ubs' AS destination_type, lpad(CAST(m AS STRING), CAST(greatest(7, length(CAST(m AS STRING))) AS INT), '0') AS destination_id, ukm AS km,
    CASE WHEN area_km2 IS NULL OR area_km2 < 100 THEN 'missing_coordinate_for_routing' ELSE 'ready_for_network_routing' END AS st FROM sl
  UNION ALL SELECT ibge_municipio_7, municipio_nome_ibge, uf_sigla, m, 'osm_pharmacy', 'node/' || CAST(m AS STRING), pkm, 'ready_for_network_routing' FROM sl),
rt AS (SELECT *, ibge_municipio_7 || '_' || destination_type || '_' || replace(destination_id, '/', '_') AS od_pair_id,
    CASE WHEN st <> 'ready_for_network_routing' THEN st WHEN m % 13 = 0 THEN 'osrm_NoRoute' ELSE 'routed' END AS rs,
    CASE WHEN st = 'ready_for_network_routing' AND m % 13 <> 0 THEN (km * 240) / 60 END AS minutes FROM pr)"""


def shortlist(t):
    spatial = t.st_spatial.filter("hard_ubs_easy_pharmacy_flag").drop("origin_quality_valid")
    return t.st_places.join(spatial, "ibge_municipio").select(
        "ibge_municipio_7", F.col("municipio_nome_ibge").alias("municipio_nome_oficial"), F.col("uf_sigla").alias("uf_sigla_oficial"),
        F.col("center_lat").alias("origin_latitude"), F.col("center_lon").alias("origin_longitude"), F.lit("official_ibge_2022_municipal_seat").alias("origin_method"),
        F.col("m").cast("double").alias("phase2_spatial_target_rank"), F.concat(F.col("m").cast("string"), F.lit(".0")).alias("nearest_ubs_id"),
        "nearest_ubs_geodesic_km", F.concat(F.lit("node/"), F.col("m").cast("string")).alias("nearest_pharmacy_id"), "nearest_pharmacy_geodesic_km",
    )


def pairs(t):
    where = {"destination_latitude": F.col("center_lat"), "destination_longitude": F.col("center_lon")}
    ubs = t.st_places.filter("area_km2 >= 100").select(zero_pad(F.col("m").cast("string"), 7).alias("destination_id"), *[v.alias(k) for k, v in where.items()])
    pharmacies = t.st_places.select(F.concat(F.lit("node/"), F.col("m").cast("string")).alias("destination_id"), *[v.alias(k) for k, v in where.items()])
    return access.od_pairs(shortlist(t), ubs, pharmacies)


def responses(t):
    """Stored route responses of every pair, as text."""
    p = pairs(t)
    no_route = F.col("phase2_spatial_target_rank").cast("bigint") % 13 == 0
    ok = F.to_json(
        F.struct(
            F.lit("Ok").alias("code"),
            F.array(F.struct((F.col("phase2_geodesic_km") * 240).alias("duration"), (F.col("phase2_geodesic_km") * 1300).alias("distance"))).alias("routes"),
        )
    )
    text = F.when(no_route, F.lit('{"code":"NoRoute"}')).otherwise(ok)
    return p.select("od_pair_id", text.alias("response"), F.lit("2026-07-01 00:00:00").cast("timestamp").alias("measured_at"))


@case(
    "ix_30_od_pairs",
    f"{PAIR_SQL} SELECT od_pair_id, ibge_municipio_7, destination_type, destination_id, km AS phase2_geodesic_km, st AS routing_readiness_status FROM rt",
    "phase2_geodesic_km",
)
def _(t):
    return pairs(t).select("od_pair_id", "ibge_municipio_7", "destination_type", "destination_id", "phase2_geodesic_km", "routing_readiness_status")


@case(
    "ix_31_attach_routes",
    f"{PAIR_SQL} SELECT od_pair_id, rs AS routing_readiness_status, minutes AS travel_time_minutes, minutes * 60 / 240 * 1.3 AS network_distance_km FROM rt",
    "travel_time_minutes network_distance_km",
)
def _(t):
    return access.attach_routes(pairs(t), responses(t), "stored").select(
        "od_pair_id", "routing_readiness_status", "travel_time_minutes", "network_distance_km"
    )


@case(
    "src_11_route_responses",
    f"""{PAIR_SQL} SELECT od_pair_id, CASE WHEN m % 13 = 0 THEN 'osrm_NoRoute' ELSE 'routed' END AS status,
        CASE WHEN m % 13 <> 0 THEN km * 4 END AS minutes, CASE WHEN m % 13 <> 0 THEN km * 1.3 END AS km FROM rt""",
    "minutes km",
)
def _(t):
    minutes, km, status = payload.parse_route(F.col("response"))
    return responses(t).select("od_pair_id", minutes.alias("minutes"), km.alias("km"), status.alias("status"))


SUMMARY_CTES = f"""{PAIR_SQL},
rsu AS (SELECT ibge_municipio_7, min(municipio_nome_ibge || '/' || uf_sigla) AS name, min(minutes) FILTER (destination_type = 'active_ubs') AS u,
  min(minutes) FILTER (destination_type = 'osm_pharmacy') AS p FROM rt GROUP BY 1)"""


def routed(t):
    return access.routing_summary(access.attach_routes(pairs(t), responses(t), "stored"))


@case(
    "ix_32_routing_summary",
    f"""{SUMMARY_CTES} SELECT ibge_municipio_7, u AS active_ubs_travel_time_minutes, p AS osm_pharmacy_travel_time_minutes,
        coalesce(u >= 15 AND p <= 5, false) AS phase3_routed_hard_ubs_easy_pharmacy_flag, CASE WHEN u >= 15 AND p > 5 THEN 'routed_hard_ubs_but_not_easy_pharmacy'
        WHEN u >= 15 AND p <= 5 THEN 'routed_hard_ubs_easy_pharmacy_candidate' ELSE 'routed_not_conservative_target' END AS phase3_access_interpretation,
        u / nullif(p, 0) AS phase3_time_ratio_ubs_to_pharmacy FROM rsu""",
    "active_ubs_travel_time_minutes osm_pharmacy_travel_time_minutes phase3_time_ratio_ubs_to_pharmacy",
)
def _(t):
    return routed(t).select(
        "ibge_municipio_7", "active_ubs_travel_time_minutes", "osm_pharmacy_travel_time_minutes", "phase3_routed_hard_ubs_easy_pharmacy_flag",
        "phase3_access_interpretation", "phase3_time_ratio_ubs_to_pharmacy",
    )


@case(
    "ix_33_threshold_sensitivity",
    f"""{SUMMARY_CTES} SELECT h AS ubs_hard_minutes_threshold, e AS pharmacy_easy_minutes_threshold, count(*) FILTER (u >= h AND p <= e) AS candidate_count,
        coalesce(string_agg(name, '; ' ORDER BY u DESC, p, ibge_municipio_7) FILTER (u >= h AND p <= e), '') AS candidate_municipalities
        FROM rsu CROSS JOIN (SELECT unnest([10, 15, 20]) AS h) a CROSS JOIN (SELECT unnest([3, 5, 10]) AS e) b GROUP BY 1, 2""",
)
def _(t):
    return access.threshold_sensitivity(routed(t))


@case(
    "ix_33_threshold_members",
    f"""{SUMMARY_CTES} SELECT h AS ubs_hard_minutes_threshold, e AS pharmacy_easy_minutes_threshold, name AS candidate_municipality,
        row_number() OVER (PARTITION BY h, e ORDER BY u DESC, p, ibge_municipio_7) AS position
        FROM rsu CROSS JOIN (SELECT unnest([10, 15, 20]) AS h) a CROSS JOIN (SELECT unnest([3, 5, 10]) AS e) b WHERE u >= h AND p <= e""",
)
def _(t):
    return access.threshold_members(routed(t)).drop("total")
