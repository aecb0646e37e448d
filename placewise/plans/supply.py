"""Supply-side layers: operational status, production, workforce, connectivity, pharmacies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import (
    clip,
    decimal_number,
    digits_or_null,
    facility_code,
    identity_chain,
    in_box,
    last_match,
    lenient_number,
    month_text,
    number,
    or_false,
    parse_period,
    ratio,
    same_text,
    two_flag_label,
    upper_trim,
)
from placewise.operators.aggregates import total
from placewise.operators.joins import first_per_key, left_unique, unique
from placewise.operators.ordering import quantiles
from placewise.sources.readers import PHARMACY_ALIASES, find_column, resolve_aliases

# Label for (both signals, registry only, production only, neither).
STATUS_LABELS = (
    "cadastral_active_with_recent_sia_production",
    "cadastral_active_without_recent_sia_production",
    "not_in_latest_cnes_st_but_has_recent_sia_production",
    "registered_only_no_current_cnes_or_sia_signal",
)


def production_by_facility(monthly: DataFrame) -> DataFrame:
    """Rows, sums, newest period and number of periods with data per facility."""
    period = F.nullif(F.col("pa_cmp"), F.lit(""))
    return monthly.groupBy(facility_code("pa_coduni").alias("cnes")).agg(
        F.count(F.lit(1)).alias("sia_records"),
        F.sum(lenient_number("pa_qtdpro")).alias("sia_quantity"),
        F.sum(lenient_number("pa_valpro")).alias("sia_value"),
        F.max(period).alias("sia_latest_competence"),
        F.countDistinct(period).alias("sia_competence_count"),
    )


def operational_status(registry: DataFrame, latest: DataFrame, production: DataFrame) -> DataFrame:
    """One row per registered facility: present in the newest registry file, recent production, label."""
    base = registry.select(
        facility_code("cnes").alias("cnes"),
        F.col("uf").alias("uf_sigla"),
        "region",
        F.col("ibge").alias("ibge_municipio"),
        F.col("nome").alias("ubs_name"),
    ).filter(F.col("cnes") != "")
    base = first_per_key(base, "cnes", [F.col("uf_sigla"), F.col("ibge_municipio"), F.col("ubs_name")])
    present = latest.select(facility_code("cnes").alias("cnes"), F.col("competen").alias("cnes_competence"))
    present = present.groupBy("cnes").agg(F.max("cnes_competence").alias("cnes_competence"), F.lit(True).alias("_st"))
    out = base.join(present, "cnes", "left").join(production_by_facility(production), "cnes", "left")
    known = {
        "cnes_present_latest_st": or_false(F.col("_st")),
        "sia_recent_production": F.col("sia_records").isNotNull(),
    }
    out = out.withColumns(known).drop("_st")
    return out.na.fill(0, ["sia_records", "sia_quantity", "sia_value", "sia_competence_count"]).withColumn(
        "operational_status",
        two_flag_label(F.col("cnes_present_latest_st"), F.col("sia_recent_production"), STATUS_LABELS),
    )


def operational_by_state(status: DataFrame) -> DataFrame:
    by_state = status.groupBy("uf_sigla", "region").agg(
        F.count(F.lit(1)).alias("ubs_records"),
        F.count_if("cnes_present_latest_st").alias("cnes_active_proxy"),
        F.count_if("sia_recent_production").alias("recent_sia_production"),
        F.count_if(F.col("operational_status") == STATUS_LABELS[0]).alias("active_with_recent_sia_production"),
        *[total(c).alias(c) for c in ("sia_records", "sia_quantity", "sia_value")],
    )
    parts = ["cnes_active_proxy", "recent_sia_production", "active_with_recent_sia_production"]
    return by_state.withColumns({f"{p}_pct": ratio(p, "ubs_records", 100) for p in parts})


def assisted_production(status: DataFrame, population: DataFrame) -> DataFrame:
    """Production per place with reporting coverage and rates."""
    active, recent = or_false(F.col("cnes_present_latest_st")), or_false(F.col("sia_recent_production"))
    by_place = status.groupBy("ibge_municipio").agg(
        F.countDistinct("cnes").alias("ubs_in_operational_source"),
        F.count_if(active).alias("active_ubs_cnes_st"),
        F.count_if(recent).alias("ubs_with_recent_sia_production"),
        F.count_if(active & recent).alias("active_ubs_with_recent_sia_production"),
        total("sia_records").alias("sia_record_rows"),
        total("sia_quantity").alias("sia_quantity_all_procedures"),
        total("sia_value").alias("sia_approved_value"),
        total("sia_competence_count").alias("sia_competence_observations"),
    )
    pop = population.groupBy("ibge_municipio").agg(F.max("populacao_residente").alias("populacao_residente"))
    quantity = "sia_quantity_all_procedures"
    return by_place.join(pop, "ibge_municipio", "left").withColumns(
        {
            "sia_reporting_coverage_pct": ratio("active_ubs_with_recent_sia_production", "active_ubs_cnes_st", 100),
            "sia_quantity_all_procedures_per_1000": ratio(quantity, "populacao_residente", 1000),
            "sia_quantity_per_reporting_ubs": ratio(quantity, "ubs_with_recent_sia_production"),
            "production_interpretation": F.when(
                F.col("active_ubs_cnes_st") == 0, "no_active_ubs_denominator"
            ).otherwise("all_outpatient_procedures_reporting_proxy"),
            "consultation_specific_status": F.lit("not_yet_filtered_by_sigtap"),
        }
    )


PHYSICIAN_FAMILY = "225"
OPEN_TEAM_CODES = ("", "900001")


def physician_links(professionals: DataFrame, facilities: DataFrame) -> DataFrame:
    """Longest weekly hours per (place, facility, person, occupation) for physicians of known facilities."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    person = F.trim(F.coalesce(blank("cns_prof"), blank("cpf_prof"), F.lit("")))
    rows = professionals.select(
        facility_code("cnes").alias("cnes"),
        person.alias("person"),
        F.trim("cbo").alias("cbo"),
        lenient_number("hora_amb").alias("hours"),
    ).filter(F.col("cbo").startswith(PHYSICIAN_FAMILY) & (F.col("person") != ""))
    # copies of one link collapse before the join
    links = rows.groupBy("cnes", "person", "cbo").agg(F.max("hours").alias("hours"))
    return links.join(unique(facilities.select("cnes", "ibge_municipio", "active"), "cnes", "facilities"), "cnes")


def physicians_by_place(links: DataFrame) -> DataFrame:
    """Counts, weekly hours and full-time equivalents per place. No person id is kept."""
    return links.groupBy("ibge_municipio").agg(
        F.countDistinct("person").alias("physicians_unique"),
        F.countDistinct("cnes", "person").alias("physician_cnes_links"),
        F.sum("hours").alias("physician_ambulatory_hours_weekly"),
        F.countDistinct("cnes").alias("ubs_with_physician"),
        F.countDistinct(F.when(F.col("active"), F.col("cnes"))).alias("active_ubs_with_physician"),
        (F.sum("hours") / 40).alias("physician_fte_40h"),
    )


def teams_by_place(teams: DataFrame, facilities: DataFrame) -> DataFrame:
    rows = teams.select(
        facility_code("cnes").alias("cnes"),
        F.trim("idequipe").alias("team"),
        F.trim("tipo_eqp").alias("team_type"),
        F.trim(F.coalesce("dt_desat", F.lit(""))).alias("closed"),
    ).filter((F.col("team") != "") & F.col("closed").isin(*OPEN_TEAM_CODES))
    one = rows.groupBy("cnes", "team").agg(F.min("team_type").alias("team_type"))
    placed = one.join(unique(facilities.select("cnes", "ibge_municipio", "active"), "cnes", "facilities"), "cnes")
    return placed.groupBy("ibge_municipio").agg(
        F.countDistinct("team").alias("active_cnes_teams_all_types"),
        F.countDistinct("team_type").alias("active_cnes_team_types"),
        F.countDistinct("cnes").alias("ubs_with_cnes_team"),
        F.countDistinct(F.when(F.col("active"), F.col("cnes"))).alias("active_ubs_with_cnes_team"),
    )


WORKFORCE_COUNTS = [
    "physicians_unique",
    "physician_cnes_links",
    "physician_ambulatory_hours_weekly",
    "physician_fte_40h",
    "ubs_with_physician",
    "active_ubs_with_physician",
    "active_cnes_teams_all_types",
    "active_cnes_team_types",
    "ubs_with_cnes_team",
    "active_ubs_with_cnes_team",
]


def workforce(places: DataFrame, physicians: DataFrame, teams: DataFrame) -> DataFrame:
    """Workforce per place with rates; rates above the 99th percentile are marked for review."""
    out = places.join(physicians, "ibge_municipio", "left").join(teams, "ibge_municipio", "left")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in WORKFORCE_COUNTS}).withColumns(
        {
            "physicians_unique_per_100k": ratio("physicians_unique", "populacao_residente", 1e5),
            "physician_fte_per_100k": ratio("physician_fte_40h", "populacao_residente", 1e5),
            "potentially_uncovered_population_per_physician_fte": ratio(
                "potentially_uncovered_population", "physician_fte_40h"
            ),
            "active_ubs_with_physician_pct": clip(ratio("active_ubs_with_physician", "active_ubs", 100), high=100),
        }
    )
    cut = quantiles(out, [], {"_p99": (F.col("physician_fte_per_100k"), 0.99)})
    high = or_false(F.col("physician_fte_per_100k") > F.col("_p99"))
    return (
        out.crossJoin(F.broadcast(cut))
        .withColumn("workforce_quality_flag", F.when(high, "review_above_national_p99").otherwise("within_national_p99"))
        .withColumn(
            "physician_definition", F.lit("CBO family 225; weekly ambulatory hours from latest CNES PF snapshot")
        )
        .withColumn("team_definition", F.lit("All non-deactivated CNES EP team types; not restricted to eSF/eAP"))
        .drop("_p99")
    )


TECHNOLOGIES = {"4G5G": "mobile_4g5g_resident_coverage_pct", "5G": "mobile_5g_resident_coverage_pct"}


def mobile_coverage(raw: DataFrame) -> DataFrame:
    """Resident coverage percent per place and technology, aggregate operator only.

    A share outside 0-1 or two different values for one cell is an error.
    """
    code, tech = find_column(raw, "codigo", "municipio"), find_column(raw, "tecnologia")
    operator, period = find_column(raw, "operadora"), find_column(raw, "periodo")
    residents = find_column(raw, "moradores", "cobertos")
    rows = raw.filter(same_text(f"`{operator}`", "todas") & F.col(f"`{tech}`").isin(*TECHNOLOGIES)).select(
        F.col(f"`{code}`").cast("long").cast("string").alias("ibge_municipio_7"),
        F.col(f"`{tech}`").alias("technology"),
        (F.col(f"`{residents}`").cast("double") * 100).alias("pct"),
        parse_period(f"`{period}`").alias("period"),
    )
    cells = rows.groupBy("ibge_municipio_7", "technology").agg(
        F.min("pct").alias("low"), F.max("pct").alias("high"), F.max("period").alias("period")
    )
    bad_range = (F.col("low") < 0) | (F.col("high") > 100)
    differs = F.col("high") - F.col("low") > 1e-9
    pct = (
        F.when(bad_range, F.raise_error(F.lit("Mobile resident coverage outside 0-100 after conversion")).cast("double"))
        .when(differs, F.raise_error(F.lit("Conflicting duplicate mobile-coverage rows")).cast("double"))
        .otherwise(F.col("high"))
    )
    wide = (
        cells.withColumn("pct", pct)
        .groupBy("ibge_municipio_7")
        .agg(*[F.max(F.when(F.col("technology") == t, F.col("pct"))).alias(n) for t, n in TECHNOLOGIES.items()])
    )
    newest = cells.agg(month_text(F.max("period")).alias("mobile_reference_period"))
    return wide.crossJoin(F.broadcast(newest))


def fixed_broadband(raw: DataFrame) -> DataFrame:
    """Access density per place in the newest month; a place that occurs twice there is an error."""
    year, code, density = find_column(raw, "ano"), find_column(raw, "codigo", "ibge"), find_column(raw, "densidade")
    month = next(c for c in raw.columns if c.lower() in ("mes", "mês"))
    level = find_column(raw, "nivel")
    rows = raw.filter(same_text(f"`{level}`", "municipio")).select(
        F.struct(F.col(f"`{year}`").cast("int").alias("y"), F.col(f"`{month}`").cast("int").alias("m")).alias("at"),
        F.col(f"`{code}`").cast("long").cast("string").alias("ibge_municipio_7"),
        number(f"`{density}`").alias("fixed_broadband_accesses_per_100_people"),
    )
    newest = rows.filter(F.col("at.y").isNotNull() & F.col("at.m").isNotNull()).agg(F.max("at").alias("_newest"))
    latest = rows.join(F.broadcast(newest), F.col("at") == F.col("_newest"))
    named = latest.withColumn("fixed_broadband_reference_period", F.format_string("%04d-%02d", "at.y", "at.m"))
    return unique(named.drop("at", "_newest"), "ibge_municipio_7", "latest fixed-broadband period")


def connectivity(universe: DataFrame, mobile: DataFrame, fixed: DataFrame) -> DataFrame:
    """Every official place with both sources; missing stays null and is named."""
    out = left_unique(left_unique(universe, mobile, "ibge_municipio_7", "mobile"), fixed, "ibge_municipio_7", "fixed")
    has_mobile = F.col("mobile_4g5g_resident_coverage_pct").isNotNull()
    has_fixed = F.col("fixed_broadband_accesses_per_100_people").isNotNull()
    status = two_flag_label(has_mobile, has_fixed, ("complete", "mobile_only", "fixed_only", "missing"))
    return out.withColumn("anatel_data_status", status)


def internet_readiness(universe: DataFrame, observed: DataFrame) -> DataFrame:
    """Household internet access per official place with a count residual and a quality flag."""
    out = left_unique(universe, observed, "ibge_municipio_7", "internet")
    pct = F.col("households_with_internet_pct")
    residual = F.col("households_total") - F.col("households_with_internet") - F.col("households_without_internet")
    out = out.withColumn("household_count_residual", residual)
    return out.withColumns(
        {
            "internet_data_status": F.when(pct.isNull(), "missing_2022_boundary").otherwise("available_census_2022"),
            "household_internet_readiness": pct / 100,
            "internet_quality_flag": last_match(
                "valid_0_100",
                [
                    (pct.isNotNull() & ~pct.between(0, 100), "invalid_outside_0_100"),
                    (pct.isNull(), "missing"),
                    (or_false(F.abs("household_count_residual") > 1), "count_residual_above_1"),
                ],
            ),
        }
    )


# Columns of the pharmacy layer, in order.
PHARMACY_COLUMNS = [
    "facility_id",
    "facility_type",
    "cnes",
    "cnpj",
    "name",
    "ibge_municipality",
    "municipality",
    "uf",
    "address",
    "neighborhood",
    "accreditation_date",
    "latitude",
    "longitude",
    "valid_coordinates",
    "source",
]


def normalize_pharmacies(raw: DataFrame, source: str = "official input") -> DataFrame:
    """Any known column variant to the canonical pharmacy columns."""
    df = resolve_aliases(raw, PHARMACY_ALIASES)
    everything = F.to_json(F.struct(*df.columns))
    return (
        df.withColumns(
            {
                "cnpj": digits_or_null("cnpj"),
                "cnes": digits_or_null("cnes"),
                "uf": upper_trim("uf"),
                "ibge_municipality": F.regexp_replace(F.col("ibge_municipality").cast("string"), r"\D", ""),
                "latitude": decimal_number("latitude"),
                "longitude": decimal_number("longitude"),
                "facility_type": F.lit("farmacia_popular"),
                "source": F.lit(source),
                "_all": everything,
            }
        )
        .withColumns(
            {
                "valid_coordinates": in_box("latitude", "longitude", -28),
                "facility_id": identity_chain("cnpj", "cnes", fallback=F.col("_all")),
            }
        )
        .select(*PHARMACY_COLUMNS)
    )


def pharmacies_by_state(pharmacies: DataFrame) -> DataFrame:
    return pharmacies.groupBy("uf").agg(
        F.count(F.lit(1)).alias("pharmacies"),
        F.count_if("valid_coordinates").alias("valid_coordinates"),
        F.countDistinct("municipality").alias("municipalities"),
    )


def active_facilities(registry: DataFrame, status: DataFrame, suspects: DataFrame) -> DataFrame:
    """Coordinates of facilities in the newest registry that are not on the suspect list, one row each."""
    active = status.filter("cnes_present_latest_st").select(facility_code("cnes").alias("facility_id"))
    doubtful = suspects.filter(F.col("cnes").isNotNull()).select(facility_code("cnes").alias("facility_id"))
    rows = registry.select(
        facility_code("cnes").alias("facility_id"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )
    kept = rows.join(active, "facility_id", "left_semi").join(doubtful, "facility_id", "left_anti")
    return first_per_key(kept, "facility_id", [F.col("latitude"), F.col("longitude")])


def supplied_rate(n: Column | str, population: Column | str) -> Column:
    return ratio(n, population, 1e5)
