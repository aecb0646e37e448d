"""Facility registry audits and place-level enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import clip, in_box, is_named, lookup, or_false, parse_period, ratio, right_closed_bins, slug
from placewise.operators.aggregates import metric_rows, repeated_pairs, share_of_all, side_by_side, total
from placewise.operators.joins import DECLARED_STATUSES, check_declared_polygon, code_or_name_join, first_per_key
from placewise.operators.ordering import percentile_ranks, quantiles

# State number -> abbreviation.
STATE_NUMBERS = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP", 41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}
# Region -> its states.
REGION_STATES = {
    "North": "AC AP AM PA RO RR TO",
    "Northeast": "AL BA CE MA PB PE PI RN SE",
    "Center-West": "DF GO MT MS",
    "Southeast": "ES MG RJ SP",
    "South": "PR RS SC",
}
STATE_REGION = {state: region for region, states in REGION_STATES.items() for state in states.split()}

QUALITY_EDGES, QUALITY_LABELS = (-1, 80, 95, 100), ("high_attention", "monitor", "good")


def add_region(df: DataFrame, state: str = "uf") -> DataFrame:
    """State abbreviation (from a number or text) and region by fixed code tables."""
    numeric = dict(df.dtypes)[state] in ("int", "bigint", "smallint", "tinyint", "double", "float")
    abbreviation = (
        lookup(F.col(state).cast("int"), STATE_NUMBERS) if numeric else F.upper(F.trim(F.col(state)))
    )
    return df.withColumn("uf_sigla", abbreviation).withColumn("region", lookup(F.col("uf_sigla"), STATE_REGION))


# ---- registry audits ---------------------------------------------------------


def _coordinate_flags() -> dict[str, Column]:
    lat, lon = F.col("latitude"), F.col("longitude")
    return {"valid": in_box(lat, lon), "complete": lat.isNotNull() & lon.isNotNull()}


def coordinate_audit(registry: DataFrame, keys: tuple[str, ...] = ("uf_sigla", "region")) -> DataFrame:
    """Coordinate quality per state; states without a name stay as their own group."""
    rows = repeated_pairs(registry, ["latitude", "longitude"], list(keys), _coordinate_flags())
    n = F.col("_n")

    def counted(condition: Column) -> Column:
        return total(F.when(condition, n))

    audit = rows.groupBy(*keys).agg(
        F.sum(n).alias("ubs_records"),
        counted(F.col("latitude").isNull()).alias("missing_latitude"),
        counted(F.col("longitude").isNull()).alias("missing_longitude"),
        counted(F.col("complete")).alias("complete_coordinates"),
        counted(F.col("valid")).alias("valid_coordinates"),
        counted(F.col("complete") & ~F.col("valid")).alias("out_of_brazil_bbox"),
        counted(F.col("valid") & F.col("repeated")).alias("duplicated_valid_coordinates"),
    )
    return audit.withColumns(
        {
            "valid_coordinate_pct": ratio("valid_coordinates", "ubs_records", 100),
            "missing_any_coordinate_pct": ratio(
                F.col("ubs_records") - F.col("complete_coordinates"), "ubs_records", 100
            ),
        }
    )


def registry_summary(registry: DataFrame) -> DataFrame:
    """Long table (metric, value, percentage) over the whole registry."""
    distinct = registry.agg(
        F.countDistinct("cnes").alias("unique_cnes"),
        F.countDistinct("uf_sigla").alias("states"),
        F.countDistinct("ibge").alias("municipalities"),
    )
    rows = repeated_pairs(registry, ["latitude", "longitude"], [], {"valid": _coordinate_flags()["valid"]})
    n = F.col("_n")
    counts = rows.agg(
        F.sum(n).alias("total_records"),
        total(F.when(F.col("valid"), n)).alias("valid_coordinates"),
        total(F.when(~F.col("valid"), n)).alias("missing_complete_coordinates"),
        total(F.when(F.col("repeated"), n)).alias("repeated_coordinates"),
    )
    one = side_by_side(counts, distinct)
    shares = ["total_records", "unique_cnes", "valid_coordinates", "missing_complete_coordinates", "repeated_coordinates"]
    one = one.withColumns({f"{m}_pct": ratio(m, "total_records", 100) for m in shares})
    return metric_rows(
        one, {m: (m, f"{m}_pct" if m in shares else None) for m in [*shares[:2], "states", "municipalities", *shares[2:]]}
    )


def region_distribution(registry: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    return share_of_all(registry, list(keys), "ubs")


def spatial_validation(registry: DataFrame, polygons: DataFrame, code: str = "ibge_municipio_7") -> tuple[DataFrame, DataFrame]:
    """Counts per state and status, and the facilities not inside their declared place."""
    checked = check_declared_polygon(registry, polygons, code)
    status = F.col("spatial_validation_status")
    by_state = checked.groupBy("uf_sigla", "region").agg(
        F.count(F.lit(1)).alias("ubs_records"), *[F.count_if(status == s).alias(s) for s in DECLARED_STATUSES]
    )
    inside = DECLARED_STATUSES[0]
    by_state = by_state.withColumns(
        {
            f"{inside}_pct": ratio(inside, "ubs_records", 100),
            "spatial_issue_records": F.col("ubs_records") - F.col(inside),
        }
    ).withColumn("spatial_issue_pct", ratio("spatial_issue_records", "ubs_records", 100))
    return by_state, checked.filter(status != inside)


# ---- territory enrichment ------------------------------------------------------


def municipality_counts(registry: DataFrame) -> DataFrame:
    """Facility counts and coordinate validity per place; facilities without a place code are left out."""
    valid = _coordinate_flags()["valid"]
    counts = (
        registry.filter(F.col("ibge_municipio").isNotNull())
        .groupBy("ibge_municipio")
        .agg(
            F.count(F.lit(1)).alias("ubs_records"),
            F.count_if(valid).alias("valid_coordinate_records"),
            F.count_if(F.col("latitude").isNull()).alias("latitude_missing"),
            F.count_if(F.col("longitude").isNull()).alias("longitude_missing"),
        )
    )
    return counts.withColumns(
        {
            "coordinate_validity_pct": ratio("valid_coordinate_records", "ubs_records", 100),
            "missing_coordinate_records": F.col("ubs_records") - F.col("valid_coordinate_records"),
        }
    )


def add_priority_metrics(df: DataFrame) -> DataFrame:
    """Rates per population and area with quality, pressure and dispersion flags."""
    have = set(df.columns)
    rates = {
        "ubs_per_10k_population": ratio("ubs_records", "populacao_residente", 10000)
        if "populacao_residente" in have
        else F.lit(None).cast("double"),
        "ubs_per_1000_km2": ratio("ubs_records", "area_km2", 1000)
        if "area_km2" in have
        else F.lit(None).cast("double"),
        "coordinate_quality_flag": right_closed_bins("coordinate_validity_pct", QUALITY_EDGES, QUALITY_LABELS),
    }
    out = df.withColumns(rates)
    cuts = quantiles(
        out, [], {"_q_pop": (F.col("ubs_per_10k_population"), 0.25), "_q_area": (F.col("ubs_per_1000_km2"), 0.25)}
    )

    def flag(rate: str, cut: str, low: str, absent: str) -> Column:
        return F.when(F.col(cut).isNull(), absent).when(F.col(rate) <= F.col(cut), low).otherwise("baseline")

    return (
        out.crossJoin(F.broadcast(cuts))
        .withColumns(
            {
                "population_pressure_flag": flag(
                    "ubs_per_10k_population", "_q_pop", "possible_pressure", "population_not_loaded"
                ),
                "territorial_dispersion_flag": flag(
                    "ubs_per_1000_km2", "_q_area", "possible_dispersion", "area_not_loaded"
                ),
            }
        )
        .drop("_q_pop", "_q_area")
    )


def enrich_territory(registry: DataFrame, places: DataFrame, statistics: DataFrame | None) -> DataFrame:
    """Place frame: registry counts joined to the place hierarchy and, when given, population and area."""
    out = municipality_counts(registry).join(places, "ibge_municipio", "left")
    if statistics is not None:
        out = out.join(statistics, "ibge_municipio", "left")
    return add_priority_metrics(out)


def state_territory_summary(enriched: DataFrame) -> DataFrame:
    known = enriched.dropna(subset=["uf_sigla", "uf_nome", "regiao_nome"])
    return _territory_rates(known.groupBy("uf_sigla", "uf_nome", "regiao_nome").agg(*_territory_sums()))


def region_territory_summary(enriched: DataFrame) -> DataFrame:
    """Territory totals, rates and share of facilities per region."""
    by_region = _territory_rates(enriched.dropna(subset=["regiao_nome"]).groupBy("regiao_nome").agg(*_territory_sums()))
    whole = by_region.agg(F.sum("ubs_records").alias("_all"))
    return (
        by_region.crossJoin(F.broadcast(whole)).withColumn("share_pct", ratio("ubs_records", "_all", 100)).drop("_all")
    )


def _territory_sums() -> list[Column]:
    return [
        F.countDistinct("ibge_municipio").alias("municipalities"),
        *[total(c).alias(c) for c in ("ubs_records", "valid_coordinate_records", "missing_coordinate_records")],
        total("populacao_residente").alias("population"),
        total("area_km2").alias("area_km2"),
    ]


def _territory_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "ubs_per_10k_population": ratio("ubs_records", "population", 10000),
            "ubs_per_1000_km2": ratio("ubs_records", "area_km2", 1000),
            "coordinate_validity_pct": ratio("valid_coordinate_records", "ubs_records", 100),
        }
    )


def priority_matrix(enriched: DataFrame) -> DataFrame:
    return enriched.orderBy(
        F.col("population_pressure_flag").desc_nulls_last(),
        F.col("territorial_dispersion_flag").desc_nulls_last(),
        F.col("coordinate_validity_pct").asc_nulls_last(),
        F.col("ubs_records").desc_nulls_last(),
    )


# ---- coverage ------------------------------------------------------------------


def latest_coverage(coverage: DataFrame) -> DataFrame:
    """Newest period per place, by date. (Ordering 'MM/YYYY' as text would prefer December of any year.)"""
    keys = ["ibge_municipio"] if "ibge_municipio" in coverage.columns else ["uf_sigla", "municipio_key"]
    if "competencia_cnes" not in coverage.columns:
        return first_per_key(coverage, keys, [F.to_json(F.struct("*"))])
    age = -F.datediff(parse_period("competencia_cnes"), F.lit("1970-01-01").cast("date"))
    return first_per_key(coverage, keys, [age.isNull(), age])


def enrich_coverage(territory: DataFrame, coverage: DataFrame) -> DataFrame:
    """Capped coverage, gap, nominal excess, capacity rate and the 45 / 40 / 15 priority score."""
    if "municipio_nome_ibge" in territory.columns:
        territory = territory.withColumn("municipio_key", slug("municipio_nome_ibge"))
    out = code_or_name_join(territory, latest_coverage(coverage), "ibge_municipio", ["uf_sigla", "municipio_key"])
    pct = F.col("cobertura_aps_pct")
    population = "populacao_residente" if "populacao_residente" in out.columns else "aps_populacao"
    out = out.withColumns(
        {
            "aps_capacity_per_10k_population": ratio("aps_capacidade_equipe", population, 10000),
            "cobertura_aps_capped_pct": clip(pct, high=100),
            "coverage_gap_pct": clip(100 - pct, low=0),
            "nominal_capacity_excess_pct": clip(pct - 100, low=0),
        }
    )
    ranked = percentile_ranks(
        out,
        ["ibge_municipio"],
        {"_supply": F.col("ubs_per_10k_population"), "_gap": F.col("coverage_gap_pct")},
    )
    score = (1 - F.col("_supply")) * 0.45 + F.col("_gap") * 0.40 + (1 - F.col("coordinate_validity_pct") / 100) * 0.15
    return ranked.withColumn("aps_priority_score", score * 100).drop("_supply", "_gap")


def state_coverage_summary(enriched: DataFrame) -> DataFrame:
    """State sums and means with weighted coverage, plain and capped per place before summing."""
    sums = ["ubs_records", "valid_coordinate_records", "aps_populacao", "qt_esf", "aps_capacidade_equipe"]
    means = {
        "cobertura_aps_media_pct": "cobertura_aps_pct",
        "cobertura_aps_capped_media_pct": "cobertura_aps_capped_pct",
        "coverage_gap_media_pct": "coverage_gap_pct",
        "nominal_capacity_excess_media_pct": "nominal_capacity_excess_pct",
        "aps_priority_score": "aps_priority_score",
    }
    capped = F.least("aps_capacidade_equipe", "aps_populacao")
    return (
        enriched.filter(is_named("uf_sigla"))
        .groupBy("uf_sigla", "uf_nome", "regiao_nome")
        .agg(
            F.countDistinct("ibge_municipio").alias("municipalities"),
            *[total(c).alias(c) for c in sums if c in enriched.columns],
            *[F.avg(c).alias(name) for name, c in means.items()],
            total(capped).alias("_capped"),
        )
        .withColumns(
            {
                "cobertura_aps_ponderada_pct": ratio("aps_capacidade_equipe", "aps_populacao", 100),
                "cobertura_aps_ponderada_capped_pct": ratio("_capped", "aps_populacao", 100),
            }
        )
        .drop("_capped")
    )


def coverage_series(national: DataFrame) -> DataFrame:
    """National weighted coverage per period, in time order."""
    return (
        national.withColumn("competence", parse_period("nuComp"))
        .withColumn("coverage_weighted_pct", ratio("qtCapacidadeEquipe", "qtPopulacao", 100))
        .orderBy("competence")
    )


# ---- access gap ------------------------------------------------------------------


def extend_with_coverage(territory: DataFrame, coverage: DataFrame) -> DataFrame:
    """Add places known to the coverage table only, with zero facilities."""
    extra = coverage.join(territory.select("ibge_municipio"), "ibge_municipio", "left_anti").select(
        "ibge_municipio",
        "uf_sigla",
        F.col("municipio_nome_aps").alias("municipio_nome_ibge"),
        F.col("aps_populacao").alias("populacao_residente"),
        F.lit(0).cast("long").alias("ubs_records"),
        F.lit(None).cast("double").alias("area_km2"),
    )
    return territory.unionByName(extra, allowMissingColumns=True)


def access_gap(
    territory: DataFrame,
    pharmacies: DataFrame,
    coverage: DataFrame | None = None,
    operational: DataFrame | None = None,
) -> DataFrame:
    """Access-mismatch proxy per place: supply pressure 40, coverage gap 40, pharmacy signal 20."""
    identity = "cnpj" if "cnpj" in pharmacies.columns else "facility_id"
    distinct = first_per_key(
        pharmacies.select(identity, *{"facility_id", "ibge_municipality", "facility_type"} - {identity}),
        identity,
        [F.col("facility_id") if identity != "facility_id" else F.col("ibge_municipality")],
    )
    counts = distinct.groupBy(F.col("ibge_municipality").alias("ibge_municipio")).agg(
        F.count(F.lit(1)).alias("pharmacies"),
        F.count_if(F.col("facility_type") == "farmacia_popular").alias("popular_pharmacies"),
    )
    out = territory.join(counts, "ibge_municipio", "left").na.fill(0, ["pharmacies", "popular_pharmacies"])
    out = out.withColumn("other_pharmacies", F.col("pharmacies") - F.col("popular_pharmacies"))
    if coverage is not None:
        out = out.join(coverage.select("ibge_municipio", "cobertura_aps_pct", "aps_populacao"), "ibge_municipio", "left")
    else:
        nothing = F.lit(None).cast("double")
        out = out.withColumns({"cobertura_aps_pct": nothing, "aps_populacao": nothing})
    if operational is not None:
        active = operational.groupBy("ibge_municipio").agg(
            F.count_if(or_false(F.col("cnes_present_latest_st"))).alias("active_ubs"),
            F.countDistinct("cnes").alias("operational_ubs_observed"),
        )
        out = out.join(active, "ibge_municipio", "left")
    else:
        out = out.withColumns({"active_ubs": F.col("ubs_records"), "operational_ubs_observed": F.col("ubs_records")})
    out = out.na.fill(0, ["active_ubs", "operational_ubs_observed"])
    population = "populacao_residente"
    out = out.withColumns(
        {
            "ubs_per_100k": ratio("ubs_records", population, 1e5),
            "active_ubs_per_100k": ratio("active_ubs", population, 1e5),
            "pharmacies_per_100k": ratio("pharmacies", population, 1e5),
            "popular_pharmacies_per_100k": ratio("popular_pharmacies", population, 1e5),
            "pharmacies_per_ubs": ratio("pharmacies", "ubs_records"),
            "aps_coverage_capped_pct": clip(F.col("cobertura_aps_pct").cast("double"), high=100),
        }
    )
    active_rate, pharmacy_rate = F.col("active_ubs_per_100k"), F.col("pharmacies_per_100k")
    cuts = quantiles(
        out,
        [],
        {
            "_median": (active_rate, 0.5),
            "threshold_active_ubs_per_100k_q25": (active_rate, 0.25),
            "threshold_pharmacies_per_100k_median": (pharmacy_rate, 0.5),
        },
    )
    q25, middle = F.col("threshold_active_ubs_per_100k_q25"), F.col("threshold_pharmacies_per_100k_median")
    capped = F.col("aps_coverage_capped_pct")
    complete = capped.isNotNull() & active_rate.isNotNull()
    consistent = (
        complete & (active_rate <= q25) & (capped < 80) & (pharmacy_rate >= middle) & (F.col("pharmacies") > 0)
    )
    out = out.crossJoin(F.broadcast(cuts)).withColumns(
        {
            # a rate against a median of zero is infinite, so it lands on the bound; 0 / 0 is unknown
            "ubs_supply_pressure": F.when(F.col("_median") == 0, F.when(active_rate > 0, 0.0)).otherwise(
                clip(1 - ratio(active_rate, "_median"), 0, 1)
            ),
            "aps_coverage_gap": clip((80 - capped) / 80, 0, 1),
            "pharmacy_access_signal": F.when(middle == 0, F.when(pharmacy_rate > 0, 1.0)).otherwise(
                clip(ratio(pharmacy_rate, middle * 2), 0, 1)
            ),
        }
    )
    score = F.col("ubs_supply_pressure") * 40 + F.col("aps_coverage_gap") * 40 + F.col("pharmacy_access_signal") * 20
    return out.withColumns(
        {
            "access_mismatch_score": F.round(score, 2),
            "evidence_level": F.when(complete, "complete").otherwise("partial"),
            "access_mismatch_flag": F.when(or_false(consistent), "consistent_mismatch").otherwise(
                "no_consistent_mismatch"
            ),
        }
    ).drop("_median")
