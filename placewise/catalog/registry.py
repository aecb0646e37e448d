"""Registry audits, territory, coverage, supply and access-gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case, stage
from placewise.functions.columns import parse_period
from placewise.operators import aggregates as ag
from placewise.plans import priority, supply
from placewise.plans import territory as terr
from placewise.sources import payloads

BOX = "latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -34"


def registry(t):
    return t.st_registry.withColumnRenamed("uf", "uf_sigla").withColumn("ibge_municipio", F.col("ibge"))


# ---- audits ---------------------------------------------------------------------------

AUDIT_SQL = f"""WITH x AS (SELECT *, coalesce({BOX}, false) AS ok, latitude IS NOT NULL AND longitude IS NOT NULL AS full_pair,
    count(*) OVER (PARTITION BY latitude, longitude) > 1 AS rep FROM st_registry),
  a AS (SELECT uf AS uf_sigla, region, count(*) AS ubs_records, count(*) FILTER (latitude IS NULL) AS missing_latitude,
    count(*) FILTER (longitude IS NULL) AS missing_longitude, count(*) FILTER (full_pair) AS complete_coordinates,
    count(*) FILTER (ok) AS valid_coordinates, count(*) FILTER (full_pair AND NOT ok) AS out_of_brazil_bbox,
    count(*) FILTER (ok AND rep) AS duplicated_valid_coordinates FROM x GROUP BY 1, 2)
  SELECT *, valid_coordinates * 1e2 / ubs_records AS valid_coordinate_pct,
    (ubs_records - complete_coordinates) * 1e2 / ubs_records AS missing_any_coordinate_pct FROM a"""


@case("ix_25_coordinate_audit", AUDIT_SQL, "valid_coordinate_pct missing_any_coordinate_pct")
def _(t):
    return terr.coordinate_audit(registry(t))


@case(
    "ag_05_conditional_counts",
    f"""SELECT uf, count(*) FILTER ({BOX}) AS valid, count(*) FILTER (latitude IS NULL) AS no_lat FROM st_registry GROUP BY uf""",
)
def _(t):
    from placewise.functions.columns import in_box

    return t.st_registry.groupBy("uf").agg(
        F.count_if(in_box("latitude", "longitude")).alias("valid"), F.count_if(F.col("latitude").isNull()).alias("no_lat")
    )


@case(
    "ag_18_null_group",
    """SELECT 'kept' AS way, genres, count(*) AS n FROM st_movies GROUP BY genres
       UNION ALL SELECT 'dropped', genres, count(*) FROM st_movies WHERE genres IS NOT NULL GROUP BY genres""",
)
def _(t):
    kept = t.st_movies.groupBy("genres").agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.lit("kept").alias("way"), "genres", "n").union(
        kept.filter(F.col("genres").isNotNull()).select(F.lit("dropped"), "genres", "n")
    )


@case(
    "ag_20_registry_summary",
    f"""WITH x AS (SELECT *, coalesce({BOX}, false) AS ok, count(*) OVER (PARTITION BY latitude, longitude) > 1 AS rep FROM st_registry),
      a AS (SELECT count(*) AS n, count(DISTINCT cnes) AS c, count(DISTINCT uf) AS s, count(DISTINCT ibge) AS m,
        count(*) FILTER (ok) AS v, count(*) FILTER (NOT ok) AS b, count(*) FILTER (rep) AS r FROM x)
    SELECT unnest(['total_records','unique_cnes','states','municipalities','valid_coordinates','missing_complete_coordinates',
      'repeated_coordinates']) AS metric, unnest([n, c, s, m, v, b, r]) AS value,
      unnest([1e2, c * 1e2 / n, NULL, NULL, v * 1e2 / n, b * 1e2 / n, r * 1e2 / n]) AS percentage FROM a""",
    "value percentage",
)
def _(t):
    return terr.registry_summary(registry(t))


@case(
    "ag_21_share_of_total",
    "SELECT region, count(*) AS ubs, count(*) * 1e2 / (SELECT count(*) FROM st_registry) AS percentage FROM st_registry GROUP BY region",
    "percentage",
)
def _(t):
    return terr.region_distribution(registry(t))


@case(
    "ag_28_status_counts",
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ---- territory ------------------------------------------------------------------------------

TERRITORY_CTES = f"""mu AS (SELECT ibge AS ibge_municipio, count(*) AS ubs_records,
    count(*) FILTER ({BOX}) AS valid_coordinate_records FROM st_registry GROUP BY 1),
te AS (SELECT mu.*, p.uf_sigla, p.uf_nome, p.regiao_nome, p.municipio_nome_ibge, p.populacao_residente, p.area_km2,
    valid_coordinate_records * 1e2 / ubs_records AS coordinate_validity_pct,
    ubs_records - valid_coordinate_records AS missing_coordinate_records,
    ubs_records / nullif(CAST(populacao_residente AS DOUBLE), 0) * 1e4 AS ubs_per_10k_population,
    ubs_records / nullif(area_km2, 0) * 1e3 AS ubs_per_1000_km2 FROM mu LEFT JOIN st_places p USING (ibge_municipio)),
cut AS (SELECT quantile_cont(ubs_per_10k_population, 0.25) AS qp, quantile_cont(ubs_per_1000_km2, 0.25) AS qa FROM te),
tf AS (SELECT te.*, CASE WHEN coordinate_validity_pct > -1 AND coordinate_validity_pct <= 80 THEN 'high_attention'
      WHEN coordinate_validity_pct <= 95 THEN 'monitor' ELSE 'good' END AS coordinate_quality_flag,
    CASE WHEN ubs_per_10k_population <= qp THEN 'possible_pressure' ELSE 'baseline' END AS population_pressure_flag,
    CASE WHEN ubs_per_1000_km2 <= qa THEN 'possible_dispersion' ELSE 'baseline' END AS territorial_dispersion_flag
    FROM te CROSS JOIN cut)"""


def territory(t):
    places = t.st_places.select("ibge_municipio", "ibge_municipio_7", "municipio_nome_ibge", "uf_sigla", "uf_nome", "regiao_nome")
    numbers = t.st_places.select("ibge_municipio", "populacao_residente", "area_km2")
    rows = registry(t).select("ibge_municipio", "latitude", "longitude")
    return stage(t, "territory", lambda: terr.enrich_territory(rows, places, numbers))


TERRITORY_COLUMNS = (
    "ibge_municipio uf_sigla ubs_records valid_coordinate_records missing_coordinate_records coordinate_validity_pct "
    "ubs_per_10k_population ubs_per_1000_km2 coordinate_quality_flag population_pressure_flag territorial_dispersion_flag"
).split()


@case(
    "ix_07_territory_enrichment",
    f"WITH {TERRITORY_CTES} SELECT {', '.join(TERRITORY_COLUMNS)} FROM tf",
    "coordinate_validity_pct ubs_per_10k_population ubs_per_1000_km2",
)
def _(t):
    return terr.priority_matrix(territory(t)).select(*TERRITORY_COLUMNS)


SUMS_SQL = """count(DISTINCT ibge_municipio) AS municipalities, CAST(sum(ubs_records) AS BIGINT) AS ubs_records,
  CAST(sum(valid_coordinate_records) AS BIGINT) AS valid_coordinate_records,
  CAST(sum(missing_coordinate_records) AS BIGINT) AS missing_coordinate_records,
  CAST(coalesce(sum(populacao_residente), 0) AS BIGINT) AS population, coalesce(sum(area_km2), 0) AS area_km2,
  sum(ubs_records) / nullif(sum(CAST(populacao_residente AS DOUBLE)), 0) * 1e4 AS ubs_per_10k_population,
  sum(ubs_records) / nullif(sum(area_km2), 0) * 1e3 AS ubs_per_1000_km2,
  sum(valid_coordinate_records) * 1e2 / sum(ubs_records) AS coordinate_validity_pct"""
SUMS_ROUNDED = "area_km2:1 ubs_per_10k_population ubs_per_1000_km2 coordinate_validity_pct"


@case(
    "ix_07_state_summary",
    f"WITH {TERRITORY_CTES} SELECT uf_sigla, uf_nome, regiao_nome, {SUMS_SQL} FROM te GROUP BY 1, 2, 3",
    SUMS_ROUNDED,
)
def _(t):
    return terr.state_territory_summary(territory(t))


@case(
    "pb_08_region_summary",
    f"""WITH {TERRITORY_CTES} SELECT regiao_nome, {SUMS_SQL},
        sum(ubs_records) * 1e2 / (SELECT sum(ubs_records) FROM te) AS share_pct FROM te GROUP BY 1""",
    SUMS_ROUNDED + " share_pct",
)
def _(t):
    return terr.region_territory_summary(territory(t))


# ---- coverage -------------------------------------------------------------------------------

PCT_RANK = (
    "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY {0} IS NULL ORDER BY {0}) "
    "+ (count(*) OVER (PARTITION BY {0}) - 1) / 2e0) / count({0}) OVER () END"
)
COVERAGE_CTES = f"""{TERRITORY_CTES},
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ibge_municipio
    ORDER BY strptime('01/' || competencia_cnes, '%d/%m/%Y') DESC) AS rn FROM st_coverage) x WHERE rn = 1),
cv AS (SELECT tf.*, lat.competencia_cnes, lat.aps_populacao, lat.qt_esf, lat.aps_capacidade_equipe, lat.cobertura_aps_pct,
    lat.aps_capacidade_equipe / nullif(CAST(populacao_residente AS DOUBLE), 0) * 1e4 AS aps_capacity_per_10k_population,
    CASE WHEN cobertura_aps_pct IS NOT NULL THEN least(cobertura_aps_pct, 100) END AS cobertura_aps_capped_pct,
    CASE WHEN cobertura_aps_pct IS NOT NULL THEN greatest(100 - cobertura_aps_pct, 0) END AS coverage_gap_pct,
    CASE WHEN cobertura_aps_pct IS NOT NULL THEN greatest(cobertura_aps_pct - 100, 0) END AS nominal_capacity_excess_pct
    FROM tf LEFT JOIN lat USING (ibge_municipio)),
cs AS (SELECT *, ((1 - {PCT_RANK.format('ubs_per_10k_population')}) * 0.45 + {PCT_RANK.format('coverage_gap_pct')} * 0.40
    + (1 - coordinate_validity_pct / 100) * 0.15) * 100 AS aps_priority_score FROM cv)"""


def coverage(t):
    return stage(t, "coverage", lambda: terr.enrich_coverage(territory(t), t.st_coverage))


COVERAGE_COLUMNS = (
    "ibge_municipio competencia_cnes aps_populacao aps_capacidade_equipe cobertura_aps_pct aps_capacity_per_10k_population "
    "cobertura_aps_capped_pct coverage_gap_pct nominal_capacity_excess_pct aps_priority_score"
).split()


@case(
    "ix_08_coverage_enrichment",
    f"WITH {COVERAGE_CTES} SELECT {', '.join(COVERAGE_COLUMNS)} FROM cs",
    "cobertura_aps_pct aps_capacity_per_10k_population cobertura_aps_capped_pct coverage_gap_pct nominal_capacity_excess_pct aps_priority_score",
)
def _(t):
    return coverage(t).select(*COVERAGE_COLUMNS)


@case(
    "ag_10_ratio_of_sums",
    f"""WITH {COVERAGE_CTES} SELECT uf_sigla, CAST(sum(aps_capacidade_equipe) AS BIGINT) AS aps_capacidade_equipe,
        avg(coverage_gap_pct) AS coverage_gap_media_pct, avg(aps_priority_score) AS aps_priority_score,
        sum(aps_capacidade_equipe) * 1e2 / sum(aps_populacao) AS cobertura_aps_ponderada_pct,
        sum(least(aps_capacidade_equipe, aps_populacao)) * 1e2 / sum(aps_populacao) AS cobertura_aps_ponderada_capped_pct
        FROM cs GROUP BY uf_sigla""",
    "coverage_gap_media_pct aps_priority_score cobertura_aps_ponderada_pct cobertura_aps_ponderada_capped_pct",
)
def _(t):
    return terr.state_coverage_summary(coverage(t)).select(
        "uf_sigla", "aps_capacidade_equipe", "coverage_gap_media_pct", "aps_priority_score",
        "cobertura_aps_ponderada_pct", "cobertura_aps_ponderada_capped_pct",
    )


@case(
    "ag_25_coverage_series",
    """SELECT competencia_cnes, CAST(strptime('01/' || competencia_cnes, '%d/%m/%Y') AS DATE) AS competence,
       sum(aps_capacidade_equipe) * 1e2 / sum(aps_populacao) AS coverage_weighted_pct FROM st_coverage GROUP BY 1""",
    "coverage_weighted_pct",
)
def _(t):
    national = t.st_coverage.groupBy("competencia_cnes").agg(
        F.sum("aps_capacidade_equipe").alias("qtCapacidadeEquipe"), F.sum("aps_populacao").alias("qtPopulacao")
    )
    return terr.coverage_series(national.withColumn("nuComp", F.col("competencia_cnes"))).select(
        "competencia_cnes", "competence", "coverage_weighted_pct"
    )


# ---- gap ------------------------------------------------------------------------------------


@case(
    "ix_06_extend_universe",
    """WITH b AS (SELECT * FROM st_gap_base WHERE ubs_records > 9) SELECT ibge_municipio, uf_sigla, populacao_residente, ubs_records FROM b
       UNION ALL SELECT ibge_municipio, uf_sigla, aps_populacao, 0 FROM st_coverage WHERE competencia_cnes = '02/2026'
         AND ibge_municipio NOT IN (SELECT ibge_municipio FROM b)""",
)
def _(t):
    base = t.st_gap_base.filter("ubs_records > 9").select("ibge_municipio", "uf_sigla", "municipio_nome_ibge", "populacao_residente", "ubs_records", "area_km2")
    newest = payloads.newest_period(t.st_coverage, "competencia_cnes", parse_period("competencia_cnes"))
    return terr.extend_with_coverage(base, newest).select("ibge_municipio", "uf_sigla", "populacao_residente", "ubs_records")


GAP_CTES = f"""{TERRITORY_CTES},
ph AS (SELECT ibge_municipality AS ibge_municipio, count(*) AS pharmacies,
    count(*) FILTER (facility_type = 'farmacia_popular') AS popular_pharmacies
    FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY facility_id) AS rn FROM st_pharmacies) x WHERE rn = 1 GROUP BY 1),
ac AS (SELECT r.ibge AS ibge_municipio, count(*) FILTER (l.cnes IS NOT NULL) AS active_ubs, count(DISTINCT r.cnes) AS operational_ubs_observed
    FROM st_registry r LEFT JOIN st_registry_latest l ON l.cnes = r.cnes GROUP BY 1),
g0 AS (SELECT tf.ibge_municipio, tf.populacao_residente, tf.ubs_records, coalesce(ph.pharmacies, 0) AS pharmacies,
    coalesce(ph.popular_pharmacies, 0) AS popular_pharmacies, coalesce(ac.active_ubs, 0) AS active_ubs,
    CASE WHEN c.cobertura_aps_pct IS NOT NULL THEN least(c.cobertura_aps_pct, 100) END AS aps_coverage_capped_pct,
    coalesce(ac.active_ubs, 0) / CAST(tf.populacao_residente AS DOUBLE) * 1e5 AS active_ubs_per_100k,
    coalesce(ph.pharmacies, 0) / CAST(tf.populacao_residente AS DOUBLE) * 1e5 AS pharmacies_per_100k
    FROM tf LEFT JOIN ph USING (ibge_municipio) LEFT JOIN ac USING (ibge_municipio)
    LEFT JOIN (SELECT * FROM st_coverage WHERE competencia_cnes = '02/2026') c USING (ibge_municipio)),
gc AS (SELECT median(active_ubs_per_100k) AS am, quantile_cont(active_ubs_per_100k, 0.25) AS q25, median(pharmacies_per_100k) AS pm FROM g0),
gp AS (SELECT g0.*, q25 AS threshold_active_ubs_per_100k_q25, pm AS threshold_pharmacies_per_100k_median,
    CASE WHEN active_ubs_per_100k IS NOT NULL THEN greatest(0, least(1, 1 - active_ubs_per_100k / am)) END AS ubs_supply_pressure,
    CASE WHEN aps_coverage_capped_pct IS NOT NULL THEN greatest(0, least(1, (80 - aps_coverage_capped_pct) / 80)) END AS aps_coverage_gap,
    CASE WHEN pharmacies_per_100k IS NOT NULL AND NOT (pm = 0 AND pharmacies_per_100k = 0)
      THEN greatest(0, least(1, pharmacies_per_100k / (pm * 2))) END AS pharmacy_access_signal
    FROM g0 CROSS JOIN gc),
gap AS (SELECT *, round(ubs_supply_pressure * 40 + aps_coverage_gap * 40 + pharmacy_access_signal * 20, 2) AS access_mismatch_score,
    CASE WHEN aps_coverage_capped_pct IS NOT NULL AND active_ubs_per_100k IS NOT NULL THEN 'complete' ELSE 'partial' END AS evidence_level,
    CASE WHEN active_ubs_per_100k <= threshold_active_ubs_per_100k_q25 AND aps_coverage_capped_pct < 80
      AND pharmacies_per_100k >= threshold_pharmacies_per_100k_median AND pharmacies > 0 THEN 'consistent_mismatch'
      ELSE 'no_consistent_mismatch' END AS access_mismatch_flag FROM gp)"""


def status(t):
    return stage(
        t, "status", lambda: supply.operational_status(t.st_registry, t.st_registry_latest, t.st_production)
    )


def gap(t):
    newest = payloads.newest_period(t.st_coverage, "competencia_cnes", parse_period("competencia_cnes"))
    observed = t.st_registry.select(F.col("ibge").alias("ibge_municipio"), "cnes").join(
        t.st_registry_latest.select("cnes", F.lit(True).alias("cnes_present_latest_st")), "cnes", "left"
    )
    return terr.access_gap(territory(t), t.st_pharmacies, newest, observed)


GAP_COLUMNS = (
    "ibge_municipio pharmacies popular_pharmacies active_ubs aps_coverage_capped_pct active_ubs_per_100k pharmacies_per_100k "
    "ubs_supply_pressure aps_coverage_gap pharmacy_access_signal access_mismatch_score evidence_level access_mismatch_flag "
    "threshold_active_ubs_per_100k_q25 threshold_pharmacies_per_100k_median"
).split()


@case(
    "ix_05_access_gap",
    f"WITH {GAP_CTES} SELECT {', '.join(GAP_COLUMNS)} FROM gap",
    "aps_coverage_capped_pct active_ubs_per_100k pharmacies_per_100k ubs_supply_pressure aps_coverage_gap pharmacy_access_signal "
    "access_mismatch_score:1 threshold_active_ubs_per_100k_q25 threshold_pharmacies_per_100k_median",
)
def _(t):
    return gap(t).select(*GAP_COLUMNS)


# ---- supply ---------------------------------------------------------------------------------

PRODUCTION_SQL = """SELECT pa_coduni AS cnes, count(*) AS sia_records, sum(CAST(pa_qtdpro AS DOUBLE)) AS sia_quantity,
  sum(CAST(replace(pa_valpro, ',', '.') AS DOUBLE)) AS sia_value, max(pa_cmp) AS sia_latest_competence,
  count(DISTINCT pa_cmp) AS sia_competence_count FROM st_production GROUP BY 1"""


@case("ag_13_monthly_files", PRODUCTION_SQL, "sia_quantity sia_value:1")
def _(t):
    return supply.production_by_facility(t.st_production)


STATUS_CTES = f"""pr AS ({PRODUCTION_SQL}),
stt AS (SELECT r.cnes, r.uf AS uf_sigla, r.region, r.ibge AS ibge_municipio, l.cnes IS NOT NULL AS cnes_present_latest_st,
    pr.cnes IS NOT NULL AS sia_recent_production, coalesce(sia_records, 0) AS sia_records, coalesce(sia_quantity, 0) AS sia_quantity,
    coalesce(sia_value, 0) AS sia_value, coalesce(sia_competence_count, 0) AS sia_competence_count, sia_latest_competence,
    CASE WHEN l.cnes IS NOT NULL AND pr.cnes IS NOT NULL THEN 'cadastral_active_with_recent_sia_production'
      WHEN l.cnes IS NOT NULL THEN 'cadastral_active_without_recent_sia_production'
      WHEN pr.cnes IS NOT NULL THEN 'not_in_latest_cnes_st_but_has_recent_sia_production'
      ELSE 'registered_only_no_current_cnes_or_sia_signal' END AS operational_status
    FROM st_registry r LEFT JOIN st_registry_latest l USING (cnes) LEFT JOIN pr USING (cnes))"""
STATUS_COLUMNS = (
    "cnes uf_sigla ibge_municipio cnes_present_latest_st sia_recent_production sia_records sia_quantity sia_value "
    "sia_competence_count sia_latest_competence operational_status"
).split()


@case("ix_23_operational_status", f"WITH {STATUS_CTES} SELECT {', '.join(STATUS_COLUMNS)} FROM stt", "sia_quantity sia_value:1")
def _(t):
    return status(t).select(*STATUS_COLUMNS)


@case(
    "ix_23_operational_by_state",
    f"""WITH {STATUS_CTES} SELECT uf_sigla, region, count(*) AS ubs_records, count(*) FILTER (cnes_present_latest_st) AS cnes_active_proxy,
        count(*) FILTER (sia_recent_production) AS recent_sia_production,
        count(*) FILTER (cnes_present_latest_st AND sia_recent_production) AS active_with_recent_sia_production,
        CAST(sum(sia_records) AS BIGINT) AS sia_records, sum(sia_quantity) AS sia_quantity,
        avg(CAST(cnes_present_latest_st AS INT)) * 100 AS cnes_active_proxy_pct FROM stt GROUP BY 1, 2""",
    "sia_quantity cnes_active_proxy_pct",
)
def _(t):
    return supply.operational_by_state(status(t)).drop(
        "sia_value", "recent_sia_production_pct", "active_with_recent_sia_production_pct"
    )


@case(
    "ix_18_assisted_production",
    f"""WITH {STATUS_CTES}, a AS (SELECT ibge_municipio, count(DISTINCT cnes) AS ubs_in_operational_source,
        count(*) FILTER (cnes_present_latest_st) AS active_ubs_cnes_st, count(*) FILTER (sia_recent_production) AS ubs_with_recent_sia_production,
        count(*) FILTER (cnes_present_latest_st AND sia_recent_production) AS both_n, sum(sia_quantity) AS q FROM stt GROUP BY 1)
      SELECT a.ibge_municipio, ubs_in_operational_source, active_ubs_cnes_st, ubs_with_recent_sia_production,
        q AS sia_quantity_all_procedures, both_n * 1e2 / nullif(active_ubs_cnes_st, 0) AS sia_reporting_coverage_pct,
        q / nullif(populacao_residente, 0) * 1e3 AS sia_quantity_all_procedures_per_1000,
        q / nullif(ubs_with_recent_sia_production, 0) AS sia_quantity_per_reporting_ubs,
        CASE WHEN active_ubs_cnes_st = 0 THEN 'no_active_ubs_denominator' ELSE 'all_outpatient_procedures_reporting_proxy' END
          AS production_interpretation FROM a LEFT JOIN st_places p USING (ibge_municipio)""",
    "sia_quantity_all_procedures sia_reporting_coverage_pct sia_quantity_all_procedures_per_1000 sia_quantity_per_reporting_ubs",
)
def _(t):
    return supply.assisted_production(status(t), t.st_places).select(
        "ibge_municipio", "ubs_in_operational_source", "active_ubs_cnes_st", "ubs_with_recent_sia_production",
        "sia_quantity_all_procedures", "sia_reporting_coverage_pct", "sia_quantity_all_procedures_per_1000",
        "sia_quantity_per_reporting_ubs", "production_interpretation",
    )


def facilities(t):
    present = t.st_registry_latest.select("cnes", F.lit(True).alias("active"))
    return (
        t.st_registry.select("cnes", F.col("ibge").alias("ibge_municipio"))
        .join(present, "cnes", "left")
        .withColumn("active", F.coalesce("active", F.lit(False)))
    )


FACILITY_CTES = """fa AS (SELECT r.cnes, r.ibge AS ibge_municipio, l.cnes IS NOT NULL AS active FROM st_registry r
    LEFT JOIN st_registry_latest l USING (cnes))"""
LINK_CTES = f"""{FACILITY_CTES},
lk AS (SELECT ibge_municipio, f.cnes, person, cbo, active, max(hours) AS hours FROM (SELECT lpad(cnes, CAST(greatest(7, length(cnes)) AS INT), '0') AS cnes,
    trim(coalesce(nullif(cns_prof, ''), nullif(cpf_prof, ''), '')) AS person, cbo, CAST(hora_amb AS DOUBLE) AS hours
    FROM st_professionals) p JOIN fa f ON f.cnes = p.cnes WHERE starts_with(cbo, '225') AND person <> '' GROUP BY ALL),
py AS (SELECT ibge_municipio, count(DISTINCT person) AS physicians_unique, count(DISTINCT (cnes, person)) AS physician_cnes_links,
    sum(hours) AS physician_ambulatory_hours_weekly, count(DISTINCT cnes) AS ubs_with_physician,
    count(DISTINCT CASE WHEN active THEN cnes END) AS active_ubs_with_physician, sum(hours) / 40 AS physician_fte_40h FROM lk GROUP BY 1),
tm AS (SELECT ibge_municipio, count(DISTINCT team) AS active_cnes_teams_all_types, count(DISTINCT team_type) AS active_cnes_team_types,
    count(DISTINCT cnes) AS ubs_with_cnes_team, count(DISTINCT CASE WHEN active THEN cnes END) AS active_ubs_with_cnes_team
    FROM (SELECT f.ibge_municipio, f.cnes, f.active, idequipe AS team, min(tipo_eqp) AS team_type FROM st_teams s
      JOIN fa f ON f.cnes = lpad(s.cnes, CAST(greatest(7, length(s.cnes)) AS INT), '0') WHERE dt_desat IN ('', '900001') AND idequipe <> '' GROUP BY ALL) x GROUP BY 1)"""


@case("ag_12_max_then_sum", f"WITH {LINK_CTES} SELECT ibge_municipio, sum(hours) / 40 AS fte FROM lk GROUP BY 1", "fte")
def _(t):
    links = supply.physician_links(t.st_professionals, facilities(t))
    return links.groupBy("ibge_municipio").agg((F.sum("hours") / 40).alias("fte"))


@case(
    "ag_11_distinct_pairs",
    f"""WITH {LINK_CTES} SELECT ibge_municipio, count(DISTINCT (cnes, person)) AS pairs,
        count(DISTINCT CASE WHEN active THEN cnes END) AS active_facilities FROM lk GROUP BY 1""",
)
def _(t):
    links = supply.physician_links(t.st_professionals, facilities(t))
    return supply.physicians_by_place(links).select(
        "ibge_municipio", F.col("physician_cnes_links").alias("pairs"), F.col("active_ubs_with_physician").alias("active_facilities")
    )


@case(
    "ix_19_workforce",
    f"""WITH {LINK_CTES}, w AS (SELECT b.ibge_municipio, b.populacao_residente, b.active_ubs, coalesce(physicians_unique, 0) AS physicians_unique,
        coalesce(physician_fte_40h, 0) AS physician_fte_40h, coalesce(active_cnes_teams_all_types, 0) AS active_cnes_teams_all_types,
        coalesce(active_cnes_team_types, 0) AS active_cnes_team_types,
        coalesce(active_ubs_with_physician, 0) AS awp, coalesce(active_ubs_with_cnes_team, 0) AS active_ubs_with_cnes_team,
        coalesce(physician_fte_40h, 0) / CAST(b.populacao_residente AS DOUBLE) * 1e5 AS physician_fte_per_100k
        FROM st_gap_base b LEFT JOIN py USING (ibge_municipio) LEFT JOIN tm USING (ibge_municipio))
      SELECT ibge_municipio, physicians_unique, physician_fte_40h, active_cnes_teams_all_types, active_cnes_team_types,
        active_ubs_with_cnes_team, physician_fte_per_100k,
        CASE WHEN active_ubs > 0 THEN least(awp * 1e2 / active_ubs, 100) END AS active_ubs_with_physician_pct,
        CASE WHEN physician_fte_per_100k > (SELECT quantile_cont(physician_fte_per_100k, 0.99) FROM w) THEN 'review_above_national_p99'
          ELSE 'within_national_p99' END AS workforce_quality_flag FROM w""",
    "physicians_unique physician_fte_40h active_cnes_teams_all_types active_cnes_team_types active_ubs_with_cnes_team "
    "physician_fte_per_100k active_ubs_with_physician_pct",
)
def _(t):
    places = t.st_gap_base.withColumn("potentially_uncovered_population", F.col("populacao_residente") * 0.5)
    fac = facilities(t)
    py = supply.physicians_by_place(supply.physician_links(t.st_professionals, fac))
    out = supply.workforce(places, py, supply.teams_by_place(t.st_teams, fac))
    return out.select(
        "ibge_municipio", "physicians_unique", "physician_fte_40h", "active_cnes_teams_all_types", "active_cnes_team_types",
        "active_ubs_with_cnes_team", "physician_fte_per_100k", "active_ubs_with_physician_pct", "workforce_quality_flag",
    )


def mobile_raw(t):
    base = t.st_connectivity.filter("mobile_4g5g_resident_coverage_pct IS NOT NULL")
    tech = F.explode(F.array(F.lit("4G5G"), F.lit("5G"), F.lit("3G"))).alias("Tecnologia")
    rows = base.select(
        F.col("ibge_municipio_7").cast("long").alias("Código Município"),
        tech,
        (F.col("mobile_4g5g_resident_coverage_pct") / 100).alias("v"),
    )
    carriers = F.explode(F.array(F.lit("Todas"), F.lit("CLARO"))).alias("Operadora")
    return rows.select("*", carriers).select(
        "Código Município", "Tecnologia", "Operadora", F.lit("03-2026").alias("Período"),
        F.when(F.col("Operadora") == "CLARO", F.col("v") / 4).when(F.col("Tecnologia") == "5G", F.col("v") / 2)
        .otherwise(F.col("v")).alias("% moradores cobertos"),
    )


MOBILE_SQL = """SELECT ibge_municipio_7, mobile_4g5g_resident_coverage_pct, mobile_4g5g_resident_coverage_pct / 2
  AS mobile_5g_resident_coverage_pct, '2026-03' AS mobile_reference_period FROM st_connectivity
  WHERE mobile_4g5g_resident_coverage_pct IS NOT NULL"""


@case("ix_20_mobile_coverage", MOBILE_SQL, "mobile_4g5g_resident_coverage_pct mobile_5g_resident_coverage_pct")
def _(t):
    return supply.mobile_coverage(mobile_raw(t))


@case(
    "ag_15_first_known_pivot",
    """SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A_l_quantity",
       min(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "N_l_quantity" FROM lineitem GROUP BY 1""",
)
def _(t):
    return ag.first_known_pivot(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N"], ["l_quantity"], ["l_quantity"])


@case(
    "ag_16_conflicts",
    "SELECT l_orderkey, l_linenumber, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) - min(l_quantity) > 1e-9",
)
def _(t):
    return ag.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], "l_quantity")


def fixed_raw(t):
    base = t.st_connectivity.filter("fixed_broadband_accesses_per_100_people IS NOT NULL")
    months = F.explode(F.array(F.lit(4), F.lit(5))).alias("Mes")
    return base.select(
        F.lit(2026).alias("Ano"), months, F.col("ibge_municipio_7").cast("long").alias("Codigo IBGE"),
        F.col("fixed_broadband_accesses_per_100_people").alias("Densidade"), F.lit("Municipio").alias("Nivel"),
    ).unionByName(
        base.groupBy().agg(F.avg("fixed_broadband_accesses_per_100_people").alias("Densidade")).select(
            F.lit(2026).alias("Ano"), F.lit(6).alias("Mes"), F.lit(0).cast("long").alias("Codigo IBGE"), "Densidade", F.lit("Brasil").alias("Nivel"))
    )


@case(
    "ix_21_fixed_broadband",
    """SELECT ibge_municipio_7, fixed_broadband_accesses_per_100_people, '2026-05' AS fixed_broadband_reference_period
       FROM st_connectivity WHERE fixed_broadband_accesses_per_100_people IS NOT NULL""",
    "fixed_broadband_accesses_per_100_people",
)
def _(t):
    return supply.fixed_broadband(fixed_raw(t))


@case(
    "jn_08_connectivity_universe",
    """SELECT ibge_municipio_7, mobile_4g5g_resident_coverage_pct, fixed_broadband_accesses_per_100_people,
       CASE WHEN mobile_4g5g_resident_coverage_pct IS NOT NULL AND fixed_broadband_accesses_per_100_people IS NOT NULL THEN 'complete'
         WHEN mobile_4g5g_resident_coverage_pct IS NOT NULL THEN 'mobile_only'
         WHEN fixed_broadband_accesses_per_100_people IS NOT NULL THEN 'fixed_only' ELSE 'missing' END AS anatel_data_status
       FROM st_connectivity""",
    "mobile_4g5g_resident_coverage_pct fixed_broadband_accesses_per_100_people",
)
def _(t):
    out = supply.connectivity(t.st_universe, supply.mobile_coverage(mobile_raw(t)), supply.fixed_broadband(fixed_raw(t)))
    return out.select(
        "ibge_municipio_7", "mobile_4g5g_resident_coverage_pct", "fixed_broadband_accesses_per_100_people", "anatel_data_status"
    )


@case(
    "ix_22_internet_readiness",
    """WITH h AS (SELECT ibge_municipio_7, 1000e0 + m AS households_total, (1000e0 + m) * 0.5 AS w,
         (1000e0 + m) * 0.5 - CASE WHEN m % 41 = 0 THEN 5 ELSE 0 END AS wo, households_with_internet_pct * 1.02 AS pct
         FROM st_connectivity JOIN st_places USING (ibge_municipio_7) WHERE households_with_internet_pct IS NOT NULL)
       SELECT u.ibge_municipio_7, households_total - w - wo AS household_count_residual,
         CASE WHEN pct IS NULL THEN 'missing_2022_boundary' ELSE 'available_census_2022' END AS internet_data_status,
         CASE WHEN abs(households_total - w - wo) > 1 THEN 'count_residual_above_1' WHEN pct IS NULL THEN 'missing'
           WHEN pct NOT BETWEEN 0 AND 100 THEN 'invalid_outside_0_100' ELSE 'valid_0_100' END AS internet_quality_flag
       FROM st_universe u LEFT JOIN h USING (ibge_municipio_7)""",
    "household_count_residual",
)
def _(t):
    observed = t.sql(
        """SELECT ibge_municipio_7, 1000e0 + m AS households_total, (1000e0 + m) * 0.5 AS households_with_internet,
           (1000e0 + m) * 0.5 - CASE WHEN m % 41 = 0 THEN 5 ELSE 0 END AS households_without_internet,
           households_with_internet_pct * 1.02 AS households_with_internet_pct
           FROM st_connectivity JOIN st_places USING (ibge_municipio_7) WHERE households_with_internet_pct IS NOT NULL"""
    )
    out = supply.internet_readiness(t.st_universe, observed)
    return out.select("ibge_municipio_7", "household_count_residual", "internet_data_status", "internet_quality_flag")


def pharmacy_raw(t):
    comma = lambda c: F.replace(F.format_string("%.4f", c), F.lit("."), F.lit(","))
    return t.st_pharmacies.select(
        F.concat(F.lit("n. "), "cnpj").alias("CNPJ"), F.col("name").alias("Razão Social"), F.col("municipality").alias("Município"),
        F.concat(F.lower("uf"), F.lit(" ")).alias("UF"), F.col("ibge_municipality").alias("Código IBGE"),
        comma("latitude").alias("Latitude"), comma("longitude").alias("Longitude"),
    )


@case(
    "ix_24_pharmacy_layer",
    """SELECT cnpj AS facility_id, 'farmacia_popular' AS facility_type, cnpj, name, ibge_municipality, municipality, uf,
       latitude, longitude, latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -28 AS valid_coordinates FROM st_pharmacies""",
    "latitude:3 longitude:3",
)
def _(t):
    out = supply.normalize_pharmacies(pharmacy_raw(t))
    return out.drop("cnes", "address", "neighborhood", "accreditation_date", "source")


@case(
    "pb_10_pharmacies_by_state",
    """SELECT uf, count(*) AS pharmacies, count(*) FILTER (latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -28) AS valid_coordinates,
       count(DISTINCT municipality) AS municipalities FROM st_pharmacies GROUP BY uf""",
)
def _(t):
    return supply.pharmacies_by_state(supply.normalize_pharmacies(pharmacy_raw(t)))


# ---- state priority -----------------------------------------------------------------------------

SENS_CTES = f"""{COVERAGE_CTES},
pc AS (SELECT *, 1 - {PCT_RANK.format('ubs_per_10k_population')} AS a, {PCT_RANK.format('coverage_gap_pct')} AS b,
    1 - coordinate_validity_pct / 100 AS c, 1 - {PCT_RANK.format('ubs_per_1000_km2')} AS d FROM cs),
sc AS (SELECT uf_sigla, avg(a * 0.45 + b * 0.40 + c * 0.15 + d * 0.00) * 100 AS score_base,
    avg(a * 0.30 + b * 0.55 + c * 0.15 + d * 0.00) * 100 AS score_coverage_led,
    avg(a * 0.30 + b * 0.30 + c * 0.10 + d * 0.30) * 100 AS score_territory_led,
    avg(a * 0.25 + b * 0.25 + c * 0.40 + d * 0.10) * 100 AS score_data_quality_led FROM pc GROUP BY 1),
sr AS (SELECT *, CAST(rank() OVER (ORDER BY score_base DESC) AS DOUBLE) AS r1, CAST(rank() OVER (ORDER BY score_coverage_led DESC) AS DOUBLE) AS r2,
    CAST(rank() OVER (ORDER BY score_territory_led DESC) AS DOUBLE) AS r3,
    CAST(rank() OVER (ORDER BY score_data_quality_led DESC) AS DOUBLE) AS r4 FROM sc)"""


@case(
    "ix_09_priority_sensitivity",
    f"""WITH {SENS_CTES} SELECT uf_sigla, score_base, score_coverage_led, score_territory_led, score_data_quality_led,
        r1 AS rank_base, least(r1, r2, r3, r4) AS rank_min, greatest(r1, r2, r3, r4) AS rank_max,
        greatest(r1, r2, r3, r4) - least(r1, r2, r3, r4) AS rank_range,
        list_aggregate([r1, r2, r3, r4], 'stddev_samp') AS rank_std FROM sr""",
    "score_base score_coverage_led score_territory_led score_data_quality_led rank_std",
)
def _(t):
    out = priority.priority_sensitivity(coverage(t))
    return out.drop("uf_nome", "regiao_nome", "rank_coverage_led", "rank_territory_led", "rank_data_quality_led")


@case(
    "ag_24_mean_scenario_scores",
    f"WITH {SENS_CTES} SELECT uf_sigla, score_base, score_territory_led FROM sc",
    "score_base score_territory_led",
)
def _(t):
    return priority.priority_sensitivity(coverage(t)).select("uf_sigla", "score_base", "score_territory_led")


@case(
    "ch_01_scenario_band",
    f"""WITH {SENS_CTES} SELECT uf_sigla, score_base AS base, least(score_base, score_coverage_led, score_territory_led, score_data_quality_led) AS low,
        greatest(score_base, score_coverage_led, score_territory_led, score_data_quality_led) AS high FROM sc ORDER BY score_base DESC LIMIT 10""",
    "base low high",
)
def _(t):
    out = priority.priority_sensitivity(coverage(t))
    return priority.scenario_band(out, "score_base", [f"score_{s}" for s in priority.PRIORITY_SCENARIOS])
