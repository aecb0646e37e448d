"""Decision classes, state strategy, cross-output audit and the published layer with its views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import largest_measure, last_match, lookup, or_false, ratio
from placewise.operators.aggregates import counts_to_columns, side_by_side, total, weighted_mean
from placewise.operators.joins import left_unique
from placewise.operators.ordering import medians, small_rank_desc
from placewise.sinks.writers import class_counts

KEY = "ibge_municipio"

# Decision classes with their label, positioning tier and next action.
CLASS_TABLE = {
    "pharmacy_assisted_pilot": (
        "Piloto farmácia assistida",
        "pilot_with_local_partner",
        "Validar parceiro, privacidade, escala clínica e OSRM local antes de piloto.",
    ),
    "pharmacy_assisted_geodesic_candidate": (
        "Candidato farmácia assistida",
        "validate_route_and_partner",
        "Roteirizar localmente e confirmar farmácia parceira antes de mídia.",
    ),
    "national_priority_high_readiness": (
        "Prioridade nacional com prontidão",
        "test_digital_ads_now",
        "Priorizar teste de mídia agregado por município ou UF com medição de conversão.",
    ),
    "national_priority_inclusion_first": (
        "Prioridade nacional com inclusão digital antes",
        "test_assisted_or_low_bandwidth_offer",
        "Testar oferta assistida ou baixo consumo de dados antes de campanha puramente digital.",
    ),
    "high_need_digital_inclusion_first": (
        "Alta necessidade, baixa prontidão digital",
        "digital_inclusion_first",
        "Tratar como território de inclusão digital, não como campanha digital simples.",
    ),
    "regional_scale_opportunity": (
        "Oportunidade regional para teste",
        "regional_experiment",
        "Usar em experimento regional ou lista ampliada, com controle de robustez.",
    ),
    "monitor_or_low_priority": (
        "Monitorar",
        "monitor",
        "Manter em monitoramento até nova evidência ou atualização de dados.",
    ),
    "insufficient_evidence": (
        "Evidência insuficiente",
        "do_not_target_before_data_fix",
        "Corrigir ou complementar dados antes de qualquer decisão operacional.",
    ),
}
DECISION_CLASSES = list(CLASS_TABLE)
# State strategy tiers with their action.
STATE_ACTIONS = {
    "hybrid_national_and_pharmacy_pilot": "Combinar teste digital estadual com validação local dos pilotos farmácia.",
    "national_ads_priority": "Priorizar geoexperimento digital em municípios Top 100 e medir funil por UF.",
    "selective_city_ads": "Testar mídia apenas nos municípios líderes, sem extrapolar para todo o estado.",
    "digital_inclusion_first": "Desenhar oferta assistida ou de baixo consumo antes de campanha digital ampla.",
    "regional_experiment": "Usar como lista ampliada ou experimento regional controlado.",
    "data_quality_first": "Complementar dados antes de recomendar investimento territorial.",
    "monitor": "Manter em monitoramento até nova evidência ou atualização de dados.",
}
# Method notes of pilots and of all other places.
PILOT_NOTE = "Roteamento público OSRM; exige rerodagem local antes de claim acadêmico."
SCREEN_NOTE = "Triagem municipal ecológica; não usar como targeting individual ou prova causal."


def _class_column(part: int) -> Column:
    return lookup("decision_class", {k: v[part] for k, v in CLASS_TABLE.items()})


def evidence_grade() -> Column:
    pilot = or_false(F.col("phase4_interpretation") == "phase4_primary_routed_target")
    return (
        F.when(pilot, "B_routed_public_osrm_proxy")
        .when(F.col("phase2_rank_balanced").isNotNull(), "C_geodesic_municipal_proxy")
        .otherwise("D_incomplete")
    )


def explanation() -> Column:
    rank = F.col("phase2_rank_balanced")
    rank_text = F.when(rank.isNull(), "sem rank nacional").otherwise(
        F.format_string("rank nacional %d", rank.cast("long"))
    )
    return F.format_string(
        "%s/%s: %s; %s; principal sinal: %s.",
        F.coalesce("municipio_nome_ibge", F.lit("Município")),
        F.coalesce("uf_sigla", F.lit("")),
        F.col("decision_label"),
        rank_text,
        F.col("primary_driver"),
    )


def decision_matrix(source: DataFrame) -> DataFrame:
    """Class by ordered rules, with label, tier, action, driver, grade and sentence."""
    rank, digital = F.col("phase2_rank_balanced"), F.col("digital_readiness_score").cast("double")
    eligible = or_false(F.col("phase2_eligibility") == "eligible_phase2_geodesic_proxy") & rank.isNotNull()
    middle = medians(source, [], {"_median": F.when(eligible, digital)})
    low, high = or_false(digital < F.col("_median")), or_false(digital >= F.col("_median"))
    top100, top500 = or_false(rank <= 100), or_false(rank <= 500)
    need = or_false(F.col("phase2_need_pillar") >= 75)
    rules = [
        (~eligible, "insufficient_evidence"),
        (eligible & top500, "regional_scale_opportunity"),
        (eligible & need & low, "high_need_digital_inclusion_first"),
        (eligible & top100 & low, "national_priority_inclusion_first"),
        (eligible & top100 & high, "national_priority_high_readiness"),
        (eligible & or_false(F.col("phase2_spatial_target_rank") > 0), "pharmacy_assisted_geodesic_candidate"),
        (
            eligible & or_false(F.col("phase4_interpretation") == "phase4_primary_routed_target"),
            "pharmacy_assisted_pilot",
        ),
    ]
    driver = largest_measure(
        {
            "necessidade": "phase2_need_pillar",
            "barreira espacial": "phase2_spatial_mismatch_score",
            "viabilidade": "phase2_feasibility_pillar",
            "prontidão digital": "digital_readiness_score",
        },
        "dados insuficientes",
    )
    return (
        source.crossJoin(F.broadcast(middle))
        .withColumn("decision_class", last_match("monitor_or_low_priority", rules))
        .withColumns(
            {
                "decision_label": _class_column(0),
                "ads_positioning_tier": _class_column(1),
                "recommended_next_action": _class_column(2),
                "primary_driver": driver,
                "evidence_grade": evidence_grade(),
                "method_notes": F.when(F.col("decision_class") == "pharmacy_assisted_pilot", PILOT_NOTE).otherwise(
                    SCREEN_NOTE
                ),
            }
        )
        .withColumn("explanation", explanation())
        .drop("_median")
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    rank = F.col("phase2_rank_balanced")
    return side_by_side(
        matrix.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(rank <= 100).alias("top100_rows"),
            F.count_if(F.col("decision_class") == "pharmacy_assisted_pilot").alias("phase4_pilot_rows"),
            F.count_if(F.col("decision_class").contains("inclusion_first")).alias("digital_inclusion_first_rows"),
        ),
        class_counts(matrix, "decision_class"),
    )


# ---- states -------------------------------------------------------------------------------

WEIGHTED = {
    "population_weighted_phase2_score": "telemedicine_phase2_balanced",
    "population_weighted_need": "phase2_need_pillar",
    "population_weighted_spatial_mismatch": "phase2_spatial_mismatch_score",
    "population_weighted_feasibility": "phase2_feasibility_pillar",
    "population_weighted_digital_readiness": "digital_readiness_score",
}


def state_summary(matrix: DataFrame) -> DataFrame:
    """Counts, weighted means, class counts, blended score, strategy tier and rank. One row per state."""
    rank = F.col("phase2_rank_balanced")
    base = matrix.groupBy("uf_sigla").agg(
        F.min("regiao_nome_oficial").alias("regiao_nome"),
        F.count(F.lit(1)).alias("municipalities"),
        total("populacao_residente").cast("long").alias("population"),
        F.count("telemedicine_phase2_balanced").alias("scored_municipalities"),
        F.count_if(rank <= 100).alias("top100_municipalities"),
        F.count_if(rank <= 500).alias("top500_municipalities"),
        *[weighted_mean(F.col(c), F.col("populacao_residente")).alias(n) for n, c in WEIGHTED.items()],
    )
    counts = counts_to_columns(matrix, "uf_sigla", "decision_class", DECISION_CLASSES)
    states = base.join(counts, base["uf_sigla"].eqNullSafe(counts["uf_sigla"])).drop(counts["uf_sigla"])
    limits = states.agg(
        F.greatest(F.lit(1), F.max("top100_municipalities")).alias("_top"),
        F.greatest(F.lit(1), F.max("population")).alias("_pop"),
        F.median("population_weighted_digital_readiness").alias("_digital"),  # one value per state
    )
    zero = F.lit(0.0)
    score = (
        0.35 * F.coalesce("population_weighted_phase2_score", zero)
        + 0.20 * F.coalesce("population_weighted_need", zero)
        + 0.10 * F.coalesce("population_weighted_digital_readiness", zero)
        + 0.25 * (100 * F.col("top100_municipalities") / F.col("_top"))
        + 0.10 * (100 * F.sqrt(F.col("population") / F.col("_pop")))
    )
    out = states.crossJoin(F.broadcast(limits)).withColumns(
        {
            "scored_municipality_share_pct": ratio("scored_municipalities", "municipalities", 100),
            "top100_per_million_population": F.when(
                F.col("population") > 0, F.col("top100_municipalities") / (F.col("population") / 1_000_000)
            ),
            "digital_inclusion_first_count": F.col("high_need_digital_inclusion_first_count")
            + F.col("national_priority_inclusion_first_count"),
            "state_opportunity_score": score,
        }
    )
    tier = (
        F.when((F.col("pharmacy_assisted_pilot_count") > 0) & (F.col("top100_municipalities") > 0), "hybrid_national_and_pharmacy_pilot")
        .when(F.col("top100_municipalities") >= 5, "national_ads_priority")
        .when(F.col("top100_municipalities") >= 1, "selective_city_ads")
        .when(
            (F.col("digital_inclusion_first_count") > 0)
            | or_false(
                (F.col("population_weighted_need") >= 45)
                & (F.col("population_weighted_digital_readiness") < F.col("_digital"))
            ),
            "digital_inclusion_first",
        )
        .when((F.col("top500_municipalities") >= 5) | (F.col("regional_scale_opportunity_count") >= 5), "regional_experiment")
        .when(
            (F.col("scored_municipalities") / F.col("municipalities") < 0.60) | (F.col("insufficient_evidence_count") >= 10),
            "data_quality_first",
        )
        .otherwise("monitor")
    )
    return (
        out.withColumn("state_strategy_tier", tier)
        .withColumns(
            {
                "recommended_state_action": lookup("state_strategy_tier", STATE_ACTIONS),
                "state_rank": small_rank_desc("state_opportunity_score").cast("int"),
            }
        )
        .drop("_top", "_pop", "_digital")
    )


# ---- audit -----------------------------------------------------------------------------------


def output_audit(phase2: DataFrame, phase4: DataFrame, matrix: DataFrame, states: DataFrame, precision: DataFrame) -> DataFrame:
    """One record of row and class counts over all outputs, with consistency rules as booleans."""
    record = side_by_side(
        phase2.agg(
            F.count(F.lit(1)).alias("phase2_rows"),
            F.count("telemedicine_phase2_balanced").alias("phase2_scored_municipalities"),
            F.count_if(F.col("phase2_rank_balanced") <= 100).alias("phase2_top100_municipalities"),
        ),
        phase4.agg(
            F.count(F.lit(1)).alias("phase4_rows"),
            F.count_if(F.col("phase4_interpretation") == "phase4_primary_routed_target").alias(
                "phase4_primary_routed_targets"
            ),
        ),
        matrix.agg(
            F.count(F.lit(1)).alias("decision_matrix_rows"),
            F.count_if(F.col("decision_class") == "pharmacy_assisted_pilot").alias("pilot_class_rows"),
        ),
        states.agg(
            F.count(F.lit(1)).alias("state_summary_rows"),
            total("top100_municipalities").alias("state_top100_total"),
            total("pharmacy_assisted_pilot_count").alias("state_phase4_pilot_total"),
            F.min_by("uf_sigla", F.struct("state_rank", "uf_sigla")).alias("top_state"),
        ),
        precision.agg(
            F.count(F.lit(1)).alias("phase5_precision_rows"),
            F.count_if(F.col("phase5_index_eligibility") == "eligible_phase5_precision").alias(
                "phase5_precision_eligible"
            ),
        ),
    )
    return record.withColumns(
        {
            "national_view_is_wider": F.col("phase2_scored_municipalities") > F.col("phase4_primary_routed_targets"),
            "pilots_match_targets": F.col("pilot_class_rows") == F.col("phase4_primary_routed_targets"),
            "state_top100_agrees": F.col("state_top100_total") == F.col("phase2_top100_municipalities"),
            "state_pilots_agree": F.col("state_phase4_pilot_total") == F.col("phase4_primary_routed_targets"),
            "precision_rows_agree": F.col("phase5_precision_rows") == F.col("phase4_rows"),
            "precision_within_scored": F.col("phase5_precision_eligible") <= F.col("phase2_scored_municipalities"),
        }
    )


# ---- published layer -----------------------------------------------------------------------------


def dashboard_layer(gap: DataFrame, outputs: Mapping[str, tuple[DataFrame | None, list[str]]]) -> DataFrame:
    """The gap table with the named columns of every index output that exists."""
    out = gap
    for name, (df, fields) in outputs.items():
        if df is not None:
            out = left_unique(out, df.select(KEY, *fields), KEY, name)
    return out


def views() -> dict[str, Column]:
    """Named row filters of the published layer."""
    rank = F.col("phase2_rank_balanced")
    return {
        "national": F.lit(True),
        "phase5": or_false(F.col("telemedicine_precision_index").isNotNull() & (F.col("phase5_precision_rank") > 0)),
        "top100": or_false((rank > 0) & (rank <= 100)),
        "phase4": or_false(F.col("phase4_interpretation") == "phase4_primary_routed_target"),
        "phase2": or_false(F.col("hard_ubs_easy_pharmacy_flag") & (F.col("phase2_spatial_target_rank") > 0)),
        "consistent": or_false(F.col("access_mismatch_flag") == "consistent_mismatch"),
        "no_active": or_false(F.col("active_ubs") == 0),
        "insufficient": or_false(F.col("decision_class") == "insufficient_evidence"),
    }


def is_scored() -> Column:
    return or_false(
        F.col("telemedicine_phase2_balanced").isNotNull()
        & (F.col("phase2_rank_balanced") > 0)
        & (F.col("decision_class") != "insufficient_evidence")
    )


def headline(layer: DataFrame) -> DataFrame:
    v = views()
    return layer.agg(
        F.count_if(is_scored()).alias("scored"),
        F.count_if(v["top100"]).alias("top100"),
        F.count_if(v["insufficient"]).alias("under_review"),
        F.count_if(v["phase4"]).alias("pilots"),
    )


# Row limit of each ranked table.
TABLE_LIMITS = {"phase5": 50, "insufficient": 100, "national": 30}


def ranked_table(layer: DataFrame, view: str) -> DataFrame:
    """Rows of a view in their display order, up to the table's limit."""
    rows = layer.filter(views()[view])
    if view == "phase4":
        return rows.orderBy(F.col("phase4_routed_target_rank").asc_nulls_last(), KEY)
    if view == "phase5":
        return rows.orderBy("phase5_precision_rank", KEY).limit(TABLE_LIMITS["phase5"])
    if view == "insufficient":
        return rows.orderBy("uf_sigla", "municipio_nome_ibge", KEY).limit(TABLE_LIMITS["insufficient"])
    return rows.filter(is_scored()).orderBy("phase2_rank_balanced", KEY).limit(TABLE_LIMITS.get(view, 100))


def score_band(score: Column | str) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 80, "80+").when(score >= 70, "70-80").when(score >= 60, "60-70").otherwise("below 60")


def national_totals(territory: DataFrame, spatial: DataFrame, operational: DataFrame, coverage: DataFrame) -> DataFrame:
    """National totals and shares over the state tables, in one row."""
    one = side_by_side(
        territory.agg(F.sum("ubs_records").alias("total")),
        spatial.agg(
            F.sum("inside_declared_municipality").alias("inside"), F.sum("outside_declared_municipality").alias("outside")
        ),
        operational.agg(
            F.sum("cnes_active_proxy").alias("cnes"),
            F.sum("recent_sia_production").alias("sia"),
            F.sum("active_with_recent_sia_production").alias("both"),
        ),
        coverage.agg(ratio(F.sum("aps_capacidade_equipe"), F.sum("aps_populacao"), 100).alias("aps_cov")),
    )
    return one.withColumns({f"{c}_pct": ratio(c, "total", 100) for c in ("inside", "cnes", "sia", "both")})
