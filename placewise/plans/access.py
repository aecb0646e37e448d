"""Origins, nearest facilities, routing pairs and population-weighted access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.functions.columns import (
    composite_key,
    facility_digits,
    in_box,
    last_match,
    or_false,
    place_key_7,
    ratio,
)
from placewise.operators.aggregates import first_known_pivot, joined_values, share_of, weighted_mean
from placewise.operators.draws import ranks_in_draws
from placewise.operators.joins import left_unique, unique
from placewise.operators.nearest import nearest_facilities
from placewise.operators.ordering import quantiles, weighted_quantiles
from placewise.runtime import stored
from placewise.sources.payloads import parse_route
from placewise.sources.readers import require_columns

KEY_7 = "ibge_municipio_7"

# ---- municipal origins -----------------------------------------------------------------


def polygon_centroids(polygons: DataFrame) -> DataFrame:
    """Centroid of the largest ring per place and whether it lies inside that ring."""
    main = polygons.select(KEY_7, geo.main_ring(geo.all_rings(F.col("coordinates"))).alias("m"))
    lon, lat = F.col("m.lon"), F.col("m.lat")
    return main.select(
        KEY_7,
        lon.alias("centroid_longitude"),
        lat.alias("centroid_latitude"),
        geo.in_ring(lon, lat, F.col("m.ring")).alias("centroid_inside_main_polygon"),
    )


def municipal_origins(universe: DataFrame, polygons: DataFrame, seats: DataFrame | None = None) -> DataFrame:
    """Origin per official place: the seat when known, else the centroid of the largest ring."""
    out = left_unique(universe, polygon_centroids(polygons), KEY_7, "polygons")
    if seats is not None:
        out = left_unique(out, seats.select(KEY_7, "seat_latitude", "seat_longitude"), KEY_7, "seats")
    else:
        nothing = F.lit(None).cast("double")
        out = out.withColumns({"seat_latitude": nothing, "seat_longitude": nothing})
    seated = F.col("seat_latitude").isNotNull() & F.col("seat_longitude").isNotNull()
    return out.withColumns(
        {
            "origin_latitude": F.coalesce("seat_latitude", "centroid_latitude"),
            "origin_longitude": F.coalesce("seat_longitude", "centroid_longitude"),
            "origin_method": F.when(seated, "official_ibge_2022_municipal_seat").otherwise(
                "centroid_of_largest_simplified_municipal_polygon"
            ),
            "origin_quality_valid": seated | or_false(F.col("centroid_inside_main_polygon")),
        }
    )


def classify_mismatch(access: DataFrame) -> DataFrame:
    """Far-facility and near-pharmacy flags: relative by quartiles, absolute by three distance pairs."""
    far, near = F.col("nearest_ubs_geodesic_km"), F.col("nearest_pharmacy_geodesic_km")
    complete = far.isNotNull() & near.isNotNull()
    cuts = quantiles(
        access,
        [],
        {
            "phase2_ubs_far_threshold_km_p75": (F.when(complete, far), 0.75),
            "phase2_pharmacy_near_threshold_km_p25": (F.when(complete, near), 0.25),
        },
    )
    present = or_false(F.col("pharmacies").cast("double") > 0)

    def flag(hard: Column, easy: Column) -> Column:
        return or_false(complete & (far >= hard) & (near <= easy) & present)

    return access.crossJoin(F.broadcast(cuts)).withColumns(
        {
            "relative_hard_ubs_easy_pharmacy_flag": flag(
                F.col("phase2_ubs_far_threshold_km_p75"), F.col("phase2_pharmacy_near_threshold_km_p25")
            ),
            "hard_ubs_easy_pharmacy_flag_3km_2km": flag(F.lit(3), F.lit(2)),
            "hard_ubs_easy_pharmacy_flag": flag(F.lit(5), F.lit(2)),
            "hard_ubs_easy_pharmacy_flag_10km_5km": flag(F.lit(10), F.lit(5)),
            "spatial_access_status": F.when(complete, "geodesic_centroid_proxy_not_travel_time").otherwise(
                "insufficient_spatial_data"
            ),
        }
    )


def origin_access(origins: DataFrame, facilities: DataFrame, pharmacies: DataFrame) -> DataFrame:
    """Both nearest-facility joins for every origin, in one search."""
    return nearest_facilities(origins, {"ubs": facilities, "pharmacy": pharmacies})


# ---- population origins -------------------------------------------------------------------

REQUIRED = (
    "origin_id",
    KEY_7,
    "origin_latitude",
    "origin_longitude",
    "origin_population",
    "origin_source",
    "origin_granularity",
)


def violations(origins: DataFrame) -> DataFrame:
    """Rows per broken rule: repeated id, missing place code, coordinates out of box, negative or unknown population."""
    population = F.col("origin_population").cast("double")
    ids = origins.groupBy("origin_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = ids.agg(F.count_if(F.col("_n") > 1).alias("repeated_id"))
    rest = origins.agg(
        F.count_if(F.col(KEY_7).isNull()).alias("missing_code"),
        F.count_if(~in_box(F.col("origin_latitude").cast("double"), F.col("origin_longitude").cast("double"), -28)).alias(
            "outside_box"
        ),
        F.count_if(~or_false(population >= 0)).alias("bad_population"),
    )
    both = repeated.crossJoin(F.broadcast(rest))
    rules = ["repeated_id", "missing_code", "outside_box", "bad_population"]
    rows = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules]
    return both.select(F.inline(F.array(*rows)))


def validate_origins(origins: DataFrame) -> DataFrame:
    """The same rows; raises when a rule is broken. Four counts come to the driver."""
    require_columns(origins, REQUIRED, "Origin table")
    broken = {r["rule"]: r["violations"] for r in violations(origins).collect() if r["violations"]}
    if broken:
        raise ValueError(f"Invalid origins: {broken}")
    return origins


def proxy_origins(spatial: DataFrame) -> DataFrame:
    """One documented proxy origin per place."""
    population = F.col("populacao_residente").cast("double")
    name = "municipio_nome_oficial" if "municipio_nome_oficial" in spatial.columns else "municipio_nome_ibge"
    state = "uf_sigla_oficial" if "uf_sigla_oficial" in spatial.columns else "uf_sigla"
    method = F.col("origin_method") if "origin_method" in spatial.columns else F.lit("phase2_origin")
    code = place_key_7(KEY_7)
    lost = "missing_population_not_scored"
    return spatial.select(
        F.concat(code, F.lit("_municipal_proxy")).alias("origin_id"),
        code.alias(KEY_7),
        F.col(name).alias("municipio_nome"),
        F.col(state).alias("uf_sigla"),
        F.col("origin_latitude").cast("double").alias("origin_latitude"),
        F.col("origin_longitude").cast("double").alias("origin_longitude"),
        F.coalesce(population, F.lit(0.0)).alias("origin_population"),
        F.when(population.isNull(), lost).otherwise("available").alias("origin_population_status"),
        F.lit("existing_phase2_municipal_origin_proxy").alias("origin_source"),
        F.lit("municipality_single_origin").alias("origin_granularity"),
        F.lit(2022).alias("source_year"),
        method.alias("representative_point_method"),
        F.when(population.isNull(), lost).otherwise("needs_intramunicipal_population_origins").alias("precision_status"),
    )


def normalize_origins(origins: DataFrame, any_year: bool = False) -> DataFrame:
    """Supplied origins with types and defaults. A source year other than 2022 fails unless allowed."""
    require_columns(origins, REQUIRED, "Manual origin table")
    defaults = {
        "source_year": F.lit(2022),
        "precision_status": F.lit("intramunicipal_population_origins_loaded"),
        "representative_point_method": F.lit("supplied_representative_point"),
    }
    out = origins.withColumns({c: v for c, v in defaults.items() if c not in origins.columns})
    year = F.col("source_year").cast("int")
    if not any_year:
        wrong = F.raise_error(F.concat(F.lit("Origins must be from 2022; found "), F.coalesce(year.cast("string"), F.lit("null"))))
        year = F.when(or_false(year == 2022), year).otherwise(wrong.cast("int"))
    return out.withColumns(
        {
            KEY_7: place_key_7(KEY_7),
            "origin_id": F.col("origin_id").cast("string"),
            **{c: F.col(c).cast("double") for c in ("origin_latitude", "origin_longitude", "origin_population")},
            "source_year": year,
        }
    )


def blend_origins(supplied: DataFrame, proxies: DataFrame) -> DataFrame:
    """Supplied origins, and the proxy of every place that has none."""
    kept = proxies.join(supplied.select(KEY_7).distinct(), KEY_7, "left_anti")
    return supplied.unionByName(kept, allowMissingColumns=True)


def sector_origins(sectors: DataFrame, population: DataFrame) -> DataFrame:
    """Sector polygons (rings) and population to origins; missing population is zero with a status."""
    code = F.col("CD_MUN").cast("string")
    point = geo.representative_point(F.col("rings"))
    placed = sectors.filter(code.rlike(r"^\d{7}$") & (code != "0000000")).select(
        F.col("CD_SETOR").cast("string").alias("origin_id"),
        code.alias(KEY_7),
        point["lat"].alias("origin_latitude"),
        point["lon"].alias("origin_longitude"),
    )
    people = population.select(
        F.col("CD_SETOR").cast("string").alias("origin_id"), F.col("people").cast("double").alias("origin_population")
    )
    known = F.col("origin_population").isNotNull()
    return (
        left_unique(placed, people, "origin_id", "sector population")
        .withColumns(
            {
                "origin_population_status": F.when(known, "available").otherwise("missing_sector_population_not_scored"),
                "precision_status": F.when(known, "intramunicipal_population_origins_loaded").otherwise(
                    "intramunicipal_geometry_loaded_population_missing"
                ),
                "origin_source": F.lit("IBGE_CD2022_SETOR_V0001"),
                "origin_granularity": F.lit("census_sector"),
                "source_year": F.lit(2022),
                "representative_point_method": F.lit("sector_largest_ring_centroid"),
            }
        )
        .na.fill(0.0, ["origin_population"])
    )


# ---- population-weighted access --------------------------------------------------------------


def municipal_access(access: DataFrame, places: DataFrame) -> DataFrame:
    """Weighted means and quantiles, population shares, coverage ratios and population per resource."""
    ubs, pharmacy = F.col("nearest_ubs_geodesic_km"), F.col("nearest_pharmacy_geodesic_km")
    people = F.coalesce(F.col("origin_population").cast("double"), F.lit(0.0))
    both = ubs.isNotNull() & pharmacy.isNotNull() & (people > 0)
    if "origin_granularity" not in access.columns:
        access = access.withColumn("origin_granularity", F.lit("unspecified_intramunicipal_origin"))
    sums = access.groupBy(KEY_7).agg(
        F.count(F.lit(1)).alias("phase5_population_origins"),
        F.sum(people).alias("phase5_origin_population"),
        F.coalesce(F.sum(F.when(both, people)), F.lit(0.0)).alias("phase5_population_covered_by_distances"),
        weighted_mean(ubs, people).alias("phase5_weighted_mean_ubs_km"),
        weighted_mean(pharmacy, people).alias("phase5_weighted_mean_pharmacy_km"),
        share_of(people, ubs > 5, both).alias("phase5_population_share_ubs_gt_5km"),
        share_of(people, pharmacy <= 2, both).alias("phase5_population_share_pharmacy_le_2km"),
        share_of(people, (ubs > 5) & (pharmacy <= 2), both).alias("phase5_population_share_hard_ubs_easy_pharmacy"),
    )
    middle = {
        name: weighted_quantiles(
            access,
            [KEY_7],
            F.col(f"nearest_{name}_geodesic_km"),
            people,
            {f"phase5_weighted_p50_{name}_km": 0.50, f"phase5_weighted_p90_{name}_km": 0.90},
        )
        for name in ("ubs", "pharmacy")
    }
    kinds = joined_values(
        access.filter(F.col("origin_granularity").isNotNull()), [KEY_7], F.col("origin_granularity"), "phase5_origin_granularity", ";"
    )
    out = sums.join(middle["ubs"], KEY_7, "left").join(middle["pharmacy"], KEY_7, "left").join(kinds, KEY_7, "left")
    numbers = ["populacao_residente", "active_ubs", "physician_fte_40h", "pharmacies"]
    have = [c for c in numbers if c in places.columns]
    one = places.groupBy(KEY_7).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in have], F.lit(True).alias("_found"))
    out = out.join(one, KEY_7, "left")
    out = out.withColumns({c: F.lit(None).cast("double") for c in numbers if c not in have})
    residents = F.when(F.col("_found"), F.col("populacao_residente")).otherwise(F.col("phase5_origin_population"))

    def per(resource: str) -> Column:
        return F.when(F.col(resource) > 0, residents / F.col(resource))

    proxy = or_false(F.col("phase5_origin_granularity") == "municipality_single_origin")
    return out.withColumns(
        {
            "phase5_population_origin_coverage_ratio": F.when(
                residents > 0, F.col("phase5_origin_population") / residents
            ),
            "phase5_distance_coverage_ratio": ratio(
                "phase5_population_covered_by_distances", "phase5_origin_population"
            ),
            "phase5_population_per_active_ubs": per("active_ubs"),
            "phase5_population_per_physician_fte": per("physician_fte_40h"),
            "phase5_population_per_pfpb_pharmacy": per("pharmacies"),
            "phase5_precision_status": F.when(proxy, "municipal_single_origin_proxy_not_intramunicipal").otherwise(
                "intramunicipal_population_weighted_ready"
            ),
            "phase5_access_evidence_grade": F.when(proxy, "B2_municipal_population_proxy").otherwise(
                "A_intramunicipal_population_weighted"
            ),
        }
    ).drop("_found", *numbers)


# ---- routing ------------------------------------------------------------------------------------

DESTINATIONS = {"active_ubs": "ubs", "osm_pharmacy": "pharmacy"}
PENDING, READY, BLOCKED = (
    "phase3_od_pair_pending_travel_time",
    "ready_for_network_routing",
    "missing_coordinate_for_routing",
)


def od_pairs(shortlist: DataFrame, ubs: DataFrame, pharmacies: DataFrame) -> DataFrame:
    """Two origin-destination pairs per shortlisted place, with readiness and a stable id."""
    out: DataFrame | None = None
    for kind, label in DESTINATIONS.items():
        target = F.col(f"nearest_{label}_id")
        rows = shortlist.select(
            KEY_7,
            "municipio_nome_oficial",
            "uf_sigla_oficial",
            "phase2_spatial_target_rank",
            "origin_method",
            F.col("origin_latitude").cast("double").alias("origin_latitude"),
            F.col("origin_longitude").cast("double").alias("origin_longitude"),
            F.lit(kind).alias("destination_type"),
            (facility_digits(target) if kind == "active_ubs" else target).alias("destination_id"),
            F.col(f"nearest_{label}_geodesic_km").cast("double").alias("phase2_geodesic_km"),
        )
        places = ubs if kind == "active_ubs" else pharmacies
        joined = left_unique(rows, places, "destination_id", f"{kind} coordinates")
        out = joined if out is None else out.unionByName(joined)
    coordinates = ["origin_latitude", "origin_longitude", "destination_latitude", "destination_longitude"]
    complete = F.lit(True)
    for c in coordinates:
        complete = complete & F.col(c).isNotNull()
    return out.withColumns(
        {
            "routing_profile": F.lit("driving"),
            "routing_readiness_status": F.when(complete, READY).otherwise(BLOCKED),
            "travel_time_minutes": F.lit(None).cast("double"),
            "network_distance_km": F.lit(None).cast("double"),
            "routing_source": F.lit(None).cast("string"),
            "routing_measured_at_utc": F.lit(None).cast("timestamp"),
            "academic_interpretation": F.lit(PENDING),
            "od_pair_id": composite_key(KEY_7, "destination_type", F.coalesce("destination_id", F.lit("None"))),
        }
    )


def attach_routes(pairs: DataFrame, responses: DataFrame, source: str) -> DataFrame:
    """Travel time and distance of ready pairs from stored route responses; other pairs stay as they are.

    ``responses`` has ``od_pair_id``, ``response`` (text) and ``measured_at``.
    """
    stored = unique(responses.select("od_pair_id", "response", "measured_at"), "od_pair_id", "route responses")
    minutes, km, status = parse_route(F.col("response"))
    ready = (F.col("routing_readiness_status") == READY) & F.col("response").isNotNull()
    changed = {
        "travel_time_minutes": minutes,
        "network_distance_km": km,
        "routing_source": F.lit(source),
        "routing_measured_at_utc": F.col("measured_at").cast("timestamp"),
        "academic_interpretation": F.lit("phase3_network_travel_time_proxy"),
        "routing_readiness_status": status,
    }
    return (
        pairs.join(stored, "od_pair_id", "left")
        .withColumns({c: F.when(ready, v).otherwise(F.col(c)) for c, v in changed.items()})
        .drop("response", "measured_at")
    )


def routing_summary(routed: DataFrame, hard: int = 15, easy: int = 5) -> DataFrame:
    """One row per place with both destinations side by side, the target flag and its reading."""
    base = ["municipio_nome_oficial", "uf_sigla_oficial", "phase2_spatial_target_rank", "origin_method"]
    named = routed.groupBy(KEY_7).agg(F.min(F.struct(*base)).alias("b")).select(KEY_7, "b.*")
    measures = ["phase2_geodesic_km", "network_distance_km", "travel_time_minutes"]
    wide = first_known_pivot(routed, KEY_7, "destination_type", list(DESTINATIONS), measures, ["destination_id"] if "destination_id" in routed.columns else [])
    ubs, pharmacy = F.col("active_ubs_travel_time_minutes"), F.col("osm_pharmacy_travel_time_minutes")
    target = or_false((ubs >= hard) & (pharmacy <= easy))
    return named.join(wide, KEY_7, "left").withColumns(
        {
            "phase3_ubs_hard_minutes_threshold": F.lit(hard),
            "phase3_pharmacy_easy_minutes_threshold": F.lit(easy),
            "phase3_routed_hard_ubs_easy_pharmacy_flag": target,
            "phase3_access_interpretation": last_match(
                "routed_not_conservative_target",
                [
                    (target, "routed_hard_ubs_easy_pharmacy_candidate"),
                    (or_false((ubs >= hard) & (pharmacy > easy)), "routed_hard_ubs_but_not_easy_pharmacy"),
                ],
            ),
            "phase3_time_ratio_ubs_to_pharmacy": ratio(ubs, pharmacy),
        }
    )


#: Names of a pair of thresholds up to which they are also given as one text.
LISTED = 10_000


def threshold_members(summary: DataFrame, hard: tuple[int, ...] = (10, 15, 20), easy: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """(ubs_hard_minutes_threshold, pharmacy_easy_minutes_threshold, position, candidate_municipality, total): a row for each
    target of every pair of thresholds, numbered from the longest way to the one and the shortest to the other.

    Positions come from spread ranks, so no task holds a whole list.
    """
    grid = F.array(
        *[F.struct(F.lit(i).alias("draw"), F.lit(h).alias("hard"), F.lit(e).alias("easy")) for i, (h, e) in enumerate((h, e) for h in hard for e in easy)]
    )
    ubs, pharmacy = F.col("active_ubs_travel_time_minutes"), F.col("osm_pharmacy_travel_time_minutes")
    name = F.concat_ws("/", "municipio_nome_oficial", "uf_sigla_oficial").alias("name")
    cells = summary.select(F.inline(grid), F.struct((-ubs).alias("a"), pharmacy.alias("b"), F.col(KEY_7).alias("k")).alias("value"), name)
    hits = cells.filter((F.col("value.a") <= -F.col("hard")) & (F.col("value.b") <= F.col("easy")))
    return ranks_in_draws(hits).select(
        F.col("hard").alias("ubs_hard_minutes_threshold"),
        F.col("easy").alias("pharmacy_easy_minutes_threshold"),
        (F.col("total") + 1 - F.col("rank")).cast("long").alias("position"),
        F.col("name").alias("candidate_municipality"),
        "total",
    )


def threshold_sensitivity(summary: DataFrame, hard: tuple[int, ...] = (10, 15, 20), easy: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Count and ordered names of the targets for every pair of thresholds.

    The names stand in one text where there are LISTED of them at most, else the text is null and
    :func:`threshold_members` has them as rows.
    """
    pair = ["ubs_hard_minutes_threshold", "pharmacy_easy_minutes_threshold"]
    members = stored(threshold_members(summary, hard, easy), "members")
    counts = members.groupBy(*pair).agg(F.count(F.lit(1)).alias("candidate_count"))
    few = members.filter(F.col("total") <= LISTED).groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("position", "candidate_municipality"))).alias("_n"))
    texts = few.select(*pair, F.array_join(F.transform("_n", lambda s: s["candidate_municipality"]), "; ").alias("candidate_municipalities"))
    grid = summary.sparkSession.createDataFrame([(h, e) for h in hard for e in easy], f"{pair[0]} int, {pair[1]} int")
    found = grid.join(counts, pair, "left").join(texts, pair, "left")
    none = F.col("candidate_count").isNull()
    return found.select(*pair, F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.when(none, "").otherwise(F.col("candidate_municipalities")).alias("candidate_municipalities"))
