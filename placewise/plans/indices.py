"""Place-level opportunity indices, from the preliminary proxy to the routed and precision variants.

Each builder is DataFrame -> DataFrame with one row per place. Stages that feed several later
steps are written to the shared folder in between, as the hand-over between phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import clip, last_match, or_false
from placewise.operators import draws as dr
from placewise.operators.joins import enrich, left_unique
from placewise.operators.ordering import competition_ranks, percentile_ranks
from placewise.operators.scoring import Component, add_percentiles, add_scenarios, weighted_geometric
from placewise.runtime import cut

KEY = "ibge_municipio"
KEY_7 = "ibge_municipio_7"

# Component and scenario weights of every index.
NEED_WEIGHTS = {"uncovered_volume": 0.50, "aps_gap": 0.25, "ubs_scarcity": 0.25}
LAUNCH_WEIGHTS = {"count": 0.50, "density": 0.50}
OPPORTUNITY_SCENARIOS = {
    "balanced": {"need": 0.50, "launchability": 0.50},
    "equity_led": {"need": 0.70, "launchability": 0.30},
    "deployment_led": {"need": 0.40, "launchability": 0.60},
}
PHASE1_NEED_WEIGHTS = {
    "uncovered_volume": 0.45,
    "aps_gap": 0.20,
    "ubs_scarcity": 0.15,
    "physician_fte_scarcity": 0.20,
}
DIGITAL_WEIGHTS = {"household_internet": 0.50, "mobile_4g5g": 0.30, "fixed_broadband": 0.20}
FEASIBILITY_WEIGHTS = {"pharmacy": 0.70, "digital": 0.30}
PHASE1_SCENARIOS = {
    "balanced": {"need": 0.50, "feasibility": 0.50},
    "equity_led": {"need": 0.70, "feasibility": 0.30},
    "deployment_led": {"need": 0.40, "feasibility": 0.60},
}
SPATIAL_WEIGHTS = {"ubs_barrier": 0.60, "pharmacy_ease": 0.40}
PHASE2_SCENARIOS = {
    "balanced": {"need": 0.45, "spatial_mismatch": 0.30, "feasibility": 0.25},
    "equity_led": {"need": 0.60, "spatial_mismatch": 0.25, "feasibility": 0.15},
    "deployment_led": {"need": 0.35, "spatial_mismatch": 0.25, "feasibility": 0.40},
}
ROUTED_ACCESS_WEIGHTS = {"ubs_barrier": 0.65, "pharmacy_ease": 0.35}
PHASE4_WEIGHTS = {"need": 0.45, "routed_access": 0.35, "feasibility": 0.20}
PRECISION_SPATIAL_WEIGHTS = {"ubs_p90_barrier": 0.45, "pharmacy_near_share": 0.25, "hard_easy_share": 0.30}
PRECISION_WEIGHTS = {"need": 0.45, "spatial_precision": 0.35, "feasibility": 0.20}
# Dirichlet parameters of the weight draws.
OPPORTUNITY_DRAWS = {"need": (10, 5, 5), "launch": (5, 5)}
PHASE1_DRAWS = {"need": (9, 4, 3, 4), "digital": (5, 3, 2), "pharmacy": (5, 5)}
PHASE2_DRAWS = {"pillar": (9, 6, 5)}


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def _known(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def _top_decile_limit(df: DataFrame, eligible: Column) -> DataFrame:
    """Rank limit of the top tenth as a one-row frame."""
    return df.agg(F.greatest(F.lit(1), F.floor(F.count_if(eligible) * 0.10)).alias("_limit"))


# ---- preliminary index ---------------------------------------------------------------


def opportunity_index(source: DataFrame) -> DataFrame:
    """Need, pharmacy launchability, three scenarios, ranks, positioning segment, stable top decile."""
    population, active = _num("populacao_residente"), _num("active_ubs_per_100k")
    covered = clip(_num("aps_coverage_capped_pct"), 0, 100)
    zero = F.lit(0.0)
    count, rate = (clip(F.coalesce(_num(c), zero), 0) for c in ("pharmacies", "pharmacies_per_100k"))
    gap = clip(1 - covered / 100, 0, 1)
    core = or_false(population > 0) & _known(covered, active)
    observed = count > 0
    base = source.withColumns(
        {
            "aps_relative_gap": gap,
            "potentially_uncovered_population": population * gap,
            "_core": core,
            "_observed": observed,
            "_count": count,
            "_rate": rate,
        }
    )
    core, observed = F.col("_core"), F.col("_observed")
    ranked = add_percentiles(
        base,
        KEY,
        {
            "uncovered_volume_percentile": Component(
                "potentially_uncovered_population", core, log=True, structural_zero=True
            ),
            "aps_gap_percentile": Component("aps_relative_gap", core, structural_zero=True),
            "active_ubs_scarcity_percentile": Component(_num("active_ubs_per_100k"), core, inverse=True),
            "pharmacy_count_percentile": Component("_count", core & observed, log=True, missing=0.0),
            "pharmacy_density_percentile": Component("_rate", core & observed, missing=0.0),
        },
    )
    need = weighted_geometric(
        {
            "uncovered_volume": "uncovered_volume_percentile",
            "aps_gap": "aps_gap_percentile",
            "ubs_scarcity": "active_ubs_scarcity_percentile",
        },
        NEED_WEIGHTS,
    )
    launch = weighted_geometric(
        {"count": "pharmacy_count_percentile", "density": "pharmacy_density_percentile"}, LAUNCH_WEIGHTS
    )
    no_gap = core & or_false(F.col("aps_relative_gap") == 0)
    scored = cut(
        ranked.withColumns(
            {
                "need_score": F.when(no_gap, 0.0).otherwise(need * 100),
                "pharmacy_launchability_score": F.when(observed, launch * 100).otherwise(0.0),
                "academic_eligibility": last_match(
                    "eligible_proxy",
                    [(core & ~observed, "no_observed_pfpb_pharmacy"), (~core, "insufficient_core_data")],
                ),
                "evidence_grade": F.when(core, "B_proxy_only").otherwise("C_incomplete"),
                **{
                    c: F.lit("not_measured")
                    for c in ("spatial_access_status", "digital_readiness_status", "clinical_demand_status")
                },
            }
        )
    )
    eligible = F.col("academic_eligibility") == "eligible_proxy"
    out = add_scenarios(
        scored,
        KEY,
        {"need": F.col("need_score") / 100, "launchability": F.col("pharmacy_launchability_score") / 100},
        OPPORTUNITY_SCENARIOS,
        score_prefix="telemedicine_opportunity_",
        rank_prefix="",
        zero=or_false(F.col("need_score") == 0),
        scored=core,
        eligible=eligible,
    )
    out = percentile_ranks(
        out,
        [KEY],
        {
            "need_priority_percentile": F.when(eligible, F.col("need_score")),
            "launchability_priority_percentile": F.when(eligible, F.col("pharmacy_launchability_score")),
        },
    )
    high_need = or_false(F.col("need_priority_percentile") >= 0.80)
    launchable = or_false(F.col("launchability_priority_percentile") >= 0.80)
    segment = last_match(
        "monitor",
        [
            (eligible & high_need, "high_need_build_supply"),
            (eligible & launchable, "launchable_secondary"),
            (eligible & high_need & launchable, "pilot_candidate"),
            (core & ~observed, "infrastructure_gap"),
            (~core, "insufficient_data"),
        ],
    )
    stable = eligible & or_false(F.col("rank_worst") <= F.col("_limit"))
    return (
        out.crossJoin(F.broadcast(_top_decile_limit(scored, eligible)))
        .withColumns({"positioning_segment": segment, "stable_top_decile": stable})
        .drop("_limit", "_core", "_observed", "_count", "_rate")
    )


def scenario_rows(index: DataFrame) -> DataFrame:
    """Scores and ranks in long form: one row per place and scenario."""
    rows = [
        F.struct(
            F.lit(s).alias("scenario"),
            F.col(f"telemedicine_opportunity_{s}").alias("opportunity_score"),
            F.col(f"rank_{s}").alias("rank"),
        )
        for s in OPPORTUNITY_SCENARIOS
    ]
    return index.select(KEY, "municipio_nome_ibge", "uf_sigla", F.inline(F.array(*rows)))


CANDIDATE_SEGMENTS = ("pilot_candidate", "high_need_build_supply", "launchable_secondary")


def candidates(index: DataFrame) -> DataFrame:
    return index.filter(F.col("positioning_segment").isin(*CANDIDATE_SEGMENTS))


def opportunity_draws(index: DataFrame, draws: int = dr.DEFAULT_DRAWS, seed: int = dr.DEFAULT_SEED) -> DataFrame:
    """Rank uncertainty of the eligible places; other places keep nulls."""
    subset = index.filter(F.col("academic_eligibility") == "eligible_proxy")
    table = dr.draw_table(index.sparkSession, draws, seed, OPPORTUNITY_DRAWS, {"share": (0.40, 0.70)})
    need = dr.geometric_draw(
        ["uncovered_volume_percentile", "aps_gap_percentile", "active_ubs_scarcity_percentile"], "need"
    )
    launch = dr.geometric_draw(["pharmacy_count_percentile", "pharmacy_density_percentile"], "launch")
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), need))
    score = F.exp(F.ln(held) * F.col("share") + F.ln(launch) * (1 - F.col("share"))) * 100
    score = F.when(F.col("aps_relative_gap") == 0, 0.0).otherwise(score)
    stats = dr.simulate(subset, KEY, table, score, "mc_", True, draws)
    return index.select(KEY, "municipio_nome_ibge", "uf_sigla", "academic_eligibility").join(stats, KEY, "left")


# ---- phase 1 -----------------------------------------------------------------------------

# Columns taken from each source.
PHASE1_SOURCES = {
    "workforce": [
        "physicians_unique",
        "physician_fte_40h",
        "physician_fte_per_100k",
        "active_ubs_with_physician_pct",
        "active_cnes_teams_all_types",
        "workforce_quality_flag",
    ],
    "internet": ["households_with_internet_pct", "internet_data_status", "internet_quality_flag"],
    "connectivity": [
        "mobile_4g5g_resident_coverage_pct",
        "mobile_5g_resident_coverage_pct",
        "mobile_reference_period",
        "fixed_broadband_accesses_per_100_people",
        "fixed_broadband_reference_period",
        "anatel_data_status",
    ],
    "production": [
        "sia_quantity_all_procedures",
        "sia_reporting_coverage_pct",
        "production_interpretation",
        "consultation_specific_status",
    ],
}


def phase1_sources(base: DataFrame, **sources: DataFrame | None) -> DataFrame:
    """The preliminary index with the columns each optional source has."""
    return enrich(base, [(sources.get(name), columns) for name, columns in PHASE1_SOURCES.items()], KEY)


def phase1_index(source: DataFrame) -> DataFrame:
    """Need, digital readiness and pharmacy feasibility in three scenarios. Production is carried, never scored."""
    zero = F.lit(0.0)
    covered = clip(_num("aps_coverage_capped_pct"), 0, 100)
    count, rate = (clip(F.coalesce(_num(c), zero), 0) for c in ("pharmacies", "pharmacies_per_100k"))
    uncovered, active, physicians = (
        _num(c) for c in ("potentially_uncovered_population", "active_ubs_per_100k", "physician_fte_per_100k")
    )
    internet, mobile, fixed = (
        _num(c)
        for c in (
            "households_with_internet_pct",
            "mobile_4g5g_resident_coverage_pct",
            "fixed_broadband_accesses_per_100_people",
        )
    )
    base = source.withColumns(
        {
            "aps_relative_gap": clip(1 - covered / 100, 0, 1),
            "_need": or_false(_num("populacao_residente") > 0) & _known(uncovered, covered, active, physicians),
            "_digital": _known(internet, mobile, fixed),
            "_observed": count > 0,
            "_count": count,
            "_rate": rate,
        }
    )
    need_ok, digital_ok, observed = F.col("_need"), F.col("_digital"), F.col("_observed")
    complete = need_ok & digital_ok & observed
    ranked = add_percentiles(
        base,
        KEY,
        {
            "phase1_uncovered_volume_percentile": Component(uncovered, need_ok, log=True, structural_zero=True),
            "phase1_aps_gap_percentile": Component("aps_relative_gap", need_ok, structural_zero=True),
            "phase1_ubs_scarcity_percentile": Component(active, need_ok, inverse=True),
            "phase1_physician_fte_scarcity_percentile": Component(physicians, need_ok, inverse=True),
            "household_internet_percentile": Component(internet, digital_ok),
            "mobile_4g5g_coverage_percentile": Component(mobile, digital_ok),
            "fixed_broadband_density_percentile": Component(fixed, digital_ok, log=True),
            "phase1_pharmacy_count_percentile": Component("_count", need_ok & observed, log=True, missing=0.0),
            "phase1_pharmacy_density_percentile": Component("_rate", need_ok & observed, missing=0.0),
        },
    )
    need = weighted_geometric(
        {
            "uncovered_volume": "phase1_uncovered_volume_percentile",
            "aps_gap": "phase1_aps_gap_percentile",
            "ubs_scarcity": "phase1_ubs_scarcity_percentile",
            "physician_fte_scarcity": "phase1_physician_fte_scarcity_percentile",
        },
        PHASE1_NEED_WEIGHTS,
    )
    digital = weighted_geometric(
        {
            "household_internet": "household_internet_percentile",
            "mobile_4g5g": "mobile_4g5g_coverage_percentile",
            "fixed_broadband": "fixed_broadband_density_percentile",
        },
        DIGITAL_WEIGHTS,
    )
    launch = weighted_geometric(
        {"count": "phase1_pharmacy_count_percentile", "density": "phase1_pharmacy_density_percentile"}, LAUNCH_WEIGHTS
    )
    no_gap = need_ok & or_false(F.col("aps_relative_gap") == 0)
    pillars = ranked.withColumns(
        {
            "phase1_need_score": F.when(no_gap, 0.0).otherwise(need * 100),
            "digital_readiness_score": digital * 100,
            "phase1_pharmacy_launchability_score": F.when(observed, launch * 100).otherwise(0.0),
        }
    )
    feasibility = weighted_geometric(
        {
            "pharmacy": F.col("phase1_pharmacy_launchability_score") / 100,
            "digital": F.col("digital_readiness_score") / 100,
        },
        FEASIBILITY_WEIGHTS,
    )
    scored = cut(
        pillars.withColumns(
            {
                "phase1_deployment_feasibility_score": feasibility * 100,
                "phase1_eligibility": last_match(
                    "eligible_phase1_proxy",
                    [
                        (need_ok & digital_ok & ~observed, "no_observed_pfpb_pharmacy"),
                        (~need_ok | ~digital_ok, "insufficient_phase1_data"),
                    ],
                ),
                "phase1_evidence_grade": F.when(complete, "B_enhanced_ecological_proxy").otherwise("C_incomplete"),
                "spatial_travel_time_status": F.lit("not_measured"),
                "sia_score_role": F.lit("audit_only_not_scored"),
            }
        )
    )
    return add_scenarios(
        scored,
        KEY,
        {
            "need": F.col("phase1_need_score") / 100,
            "feasibility": F.col("phase1_deployment_feasibility_score") / 100,
        },
        PHASE1_SCENARIOS,
        score_prefix="telemedicine_phase1_",
        rank_prefix="phase1_",
        zero=or_false(F.col("phase1_need_score") == 0),
        scored=complete,
        eligible=F.col("phase1_eligibility") == "eligible_phase1_proxy",
    ).drop("_need", "_digital", "_observed", "_count", "_rate")


def phase1_draws(index: DataFrame, draws: int = dr.DEFAULT_DRAWS, seed: int = dr.DEFAULT_SEED) -> DataFrame:
    subset = index.filter(F.col("phase1_eligibility") == "eligible_phase1_proxy")
    shares = {"pharmacy_share": (0.60, 0.80), "need_share": (0.40, 0.70)}
    table = dr.draw_table(index.sparkSession, draws, seed, PHASE1_DRAWS, shares)
    need = dr.geometric_draw(
        [
            "phase1_uncovered_volume_percentile",
            "phase1_aps_gap_percentile",
            "phase1_ubs_scarcity_percentile",
            "phase1_physician_fte_scarcity_percentile",
        ],
        "need",
    )
    digital = dr.geometric_draw(
        ["household_internet_percentile", "mobile_4g5g_coverage_percentile", "fixed_broadband_density_percentile"],
        "digital",
    )
    pharmacy = dr.geometric_draw(
        ["phase1_pharmacy_count_percentile", "phase1_pharmacy_density_percentile"], "pharmacy"
    )
    split, share = F.col("pharmacy_share"), F.col("need_share")
    feasibility = F.pow(pharmacy, split) * F.pow(digital, 1 - split)
    score = F.pow(need, share) * F.pow(feasibility, 1 - share) * 100
    score = F.when(F.col("aps_relative_gap") == 0, 0.0).otherwise(score)
    stats = dr.simulate(subset, KEY, table, score, "phase1_mc_", False, draws)
    return index.select(KEY, "municipio_nome_ibge", "uf_sigla", "phase1_eligibility").join(stats, KEY, "left")


# ---- phase 2 -----------------------------------------------------------------------------


def phase2_index(source: DataFrame) -> DataFrame:
    """Spatial mismatch next to need and feasibility, three scenarios, and the rank among spatial targets."""
    far, near = _num("nearest_ubs_geodesic_km"), _num("nearest_pharmacy_geodesic_km")
    quality = F.col("origin_quality_valid" if "origin_quality_valid" in source.columns else "origin_inside_main_polygon")
    flag = "hard_ubs_easy_pharmacy_flag"
    if flag not in source.columns:
        hard = or_false((far >= 5) & (near <= 2) & (_num("pharmacies") > 0))
        source = source.withColumn(flag, hard)
    phase1 = or_false(F.col("phase1_eligibility") == "eligible_phase1_proxy")
    base = source.withColumns(
        {"_spatial": or_false(quality) & _known(far, near), "_phase1": phase1}
    )
    spatial, phase1 = F.col("_spatial"), F.col("_phase1")
    eligible = spatial & phase1
    ranked = add_percentiles(
        base,
        KEY,
        {
            "phase2_ubs_geographic_barrier_percentile": Component(far, spatial),
            "phase2_pharmacy_geographic_ease_percentile": Component(near, spatial, inverse=True),
        },
    )
    mismatch = weighted_geometric(
        {
            "ubs_barrier": "phase2_ubs_geographic_barrier_percentile",
            "pharmacy_ease": "phase2_pharmacy_geographic_ease_percentile",
        },
        SPATIAL_WEIGHTS,
    )
    scored = cut(
        ranked.withColumns(
            {
                "phase2_spatial_mismatch_score": mismatch * 100,
                "phase2_need_pillar": _num("phase1_need_score"),
                "phase2_feasibility_pillar": _num("phase1_deployment_feasibility_score"),
                "phase2_eligibility": last_match(
                    "eligible_phase2_geodesic_proxy",
                    [
                        (~phase1, "phase1_ineligible"),
                        (phase1 & ~spatial, "insufficient_spatial_data"),
                        (phase1 & or_false(~quality), "invalid_origin_proxy"),
                    ],
                ),
                "phase2_evidence_grade": F.when(eligible, "B_spatial_centroid_proxy").otherwise("C_incomplete"),
                "travel_time_status": F.lit("not_measured_geodesic_only"),
            }
        )
    )
    need = F.col("phase2_need_pillar")
    target = eligible & or_false(F.col(flag)) & or_false(need > 0)
    return add_scenarios(
        scored,
        KEY,
        {
            "need": need / 100,
            "spatial_mismatch": F.col("phase2_spatial_mismatch_score") / 100,
            "feasibility": F.col("phase2_feasibility_pillar") / 100,
        },
        PHASE2_SCENARIOS,
        score_prefix="telemedicine_phase2_",
        rank_prefix="phase2_",
        zero=or_false(need == 0),
        scored=eligible,
        eligible=eligible,
        extra_ranks={"phase2_spatial_target_rank": ("telemedicine_phase2_balanced", target)},
    ).drop("_spatial", "_phase1")


def phase2_draws(index: DataFrame, draws: int = dr.DEFAULT_DRAWS, seed: int = dr.DEFAULT_SEED) -> DataFrame:
    subset = index.filter(F.col("phase2_eligibility") == "eligible_phase2_geodesic_proxy").withColumns(
        {
            "_a": F.col("phase2_need_pillar") / 100,
            "_b": F.col("phase2_spatial_mismatch_score") / 100,
            "_c": F.col("phase2_feasibility_pillar") / 100,
        }
    )
    table = dr.draw_table(index.sparkSession, draws, seed, PHASE2_DRAWS)
    score = dr.geometric_draw(["_a", "_b", "_c"], "pillar") * 100
    score = F.when(F.col("phase2_need_pillar") == 0, 0.0).otherwise(score)
    stats = dr.simulate(subset, KEY, table, score, "phase2_mc_", False, draws)
    return index.select(KEY, "uf_sigla", "phase2_eligibility").join(stats, KEY, "left")


def shortlist(index: DataFrame, keep: Column, draws: DataFrame, prefix: str, score: str, n: int = 100) -> DataFrame:
    """The first n kept rows by chance of the top decile, then score, with their draw statistics."""
    stats = [f"{prefix}{c}" for c in ("rank_median", "rank_p05", "rank_p95", "probability_top_decile")]
    return (
        index.filter(keep)
        .join(draws.select(KEY, *stats), KEY, "left")
        .orderBy(F.col(stats[-1]).desc_nulls_last(), F.col(score).desc_nulls_last(), KEY)
        .limit(n)
    )


# ---- routed validation and precision -------------------------------------------------------


def phase4_index(source: DataFrame) -> DataFrame:
    """Score and ranks of the routed subset only; plain percentiles without winsorizing."""
    ubs, pharmacy = _num("active_ubs_travel_time_minutes"), _num("osm_pharmacy_travel_time_minutes")
    routed = _known(ubs, pharmacy)
    target = routed & or_false(F.col("phase3_routed_hard_ubs_easy_pharmacy_flag"))
    ranked = add_percentiles(
        source,
        KEY_7,
        {
            "phase4_ubs_travel_barrier_percentile_routed_subset": Component(ubs, routed),
            "phase4_pharmacy_travel_ease_percentile_routed_subset": Component(pharmacy, routed, inverse=True),
        },
        winsorize=False,
    )
    access = weighted_geometric(
        {
            "ubs_barrier": "phase4_ubs_travel_barrier_percentile_routed_subset",
            "pharmacy_ease": "phase4_pharmacy_travel_ease_percentile_routed_subset",
        },
        ROUTED_ACCESS_WEIGHTS,
    )
    pillars = ranked.withColumns(
        {
            "phase4_routed_access_score": access * 100,
            "phase4_need_pillar": _num("phase2_need_pillar"),
            "phase4_feasibility_pillar": _num("phase2_feasibility_pillar"),
            "phase4_eligibility": F.when(routed, "eligible_phase4_routed_validation").otherwise("not_routed_phase4"),
            "phase4_evidence_grade": F.when(routed, "B_routed_public_osrm_proxy").otherwise("C_not_routed"),
            "phase4_interpretation": last_match(
                "not_routed_in_phase4",
                [(routed, "routed_validation_not_primary_target"), (target, "phase4_primary_routed_target")],
            ),
        }
    )
    total = weighted_geometric(
        {
            "need": F.col("phase4_need_pillar") / 100,
            "routed_access": F.col("phase4_routed_access_score") / 100,
            "feasibility": F.col("phase4_feasibility_pillar") / 100,
        },
        PHASE4_WEIGHTS,
    )
    name = "telemedicine_phase4_routed_validation"
    scored = pillars.withColumn(name, F.when(routed, total * 100))
    return competition_ranks(
        scored,
        [KEY_7],
        {
            "phase4_routed_validation_rank": F.when(routed, F.col(name)),
            "phase4_routed_target_rank": F.when(target, F.col(name)),
        },
    )


def precision_index(phase2: DataFrame, access: DataFrame) -> DataFrame:
    """Index on population-weighted access; places need 90% origin and 95% distance coverage."""
    have = set(access.columns)
    origin_ratio, distance_ratio = "phase5_population_origin_coverage_ratio", "phase5_distance_coverage_ratio"
    if distance_ratio not in have:
        access = access.withColumn(distance_ratio, F.col(origin_ratio))
    wanted = PRECISION_ACCESS_COLUMNS
    right = access.select(
        KEY_7, *[F.col(c) if c in access.columns else F.lit(None).cast(kind).alias(c) for c, kind in wanted.items()]
    )
    joined = left_unique(phase2, right, KEY_7, "precision access")
    p90, near_share = _num("phase5_weighted_p90_ubs_km"), _num("phase5_population_share_pharmacy_le_2km")
    valid = or_false((_num(origin_ratio) >= 0.90) & (_num(distance_ratio) >= 0.95)) & _known(p90, near_share)
    base = joined.withColumns(
        {"_valid": valid, "_phase2": or_false(F.col("phase2_eligibility") == "eligible_phase2_geodesic_proxy")}
    )
    valid, phase2_ok = F.col("_valid"), F.col("_phase2")
    ranked = add_percentiles(
        base,
        KEY_7,
        {
            "phase5_ubs_p90_barrier_percentile": Component(p90, valid),
            "phase5_pharmacy_near_share_percentile": Component(near_share, valid),
            "phase5_hard_easy_share_percentile": Component(
                _num("phase5_population_share_hard_ubs_easy_pharmacy"), valid
            ),
        },
    )
    spatial = weighted_geometric(
        {
            "ubs_p90_barrier": "phase5_ubs_p90_barrier_percentile",
            "pharmacy_near_share": "phase5_pharmacy_near_share_percentile",
            "hard_easy_share": "phase5_hard_easy_share_percentile",
        },
        PRECISION_SPATIAL_WEIGHTS,
    )
    with_spatial = ranked.withColumn("phase5_spatial_precision_mismatch_score", spatial * 100)
    total = weighted_geometric(
        {
            "need": _num("phase2_need_pillar") / 100,
            "spatial_precision": F.col("phase5_spatial_precision_mismatch_score") / 100,
            "feasibility": _num("phase2_feasibility_pillar") / 100,
        },
        PRECISION_WEIGHTS,
    )
    eligible = valid & phase2_ok
    grade = F.col("phase5_access_evidence_grade")
    scored = with_spatial.withColumns(
        {
            "telemedicine_precision_index": F.when(eligible, total * 100),
            "phase5_index_eligibility": last_match(
                "eligible_phase5_precision",
                [
                    (~phase2_ok, "phase2_ineligible"),
                    (phase2_ok & ~valid, "insufficient_phase5_spatial_precision_data"),
                ],
            ),
            "phase5_evidence_grade": F.coalesce(grade, F.lit("C_incomplete")),
            "phase5_method_note": F.when(
                grade == "A_intramunicipal_population_weighted",
                "Population-weighted geodesic access using intramunicipal origins.",
            ).otherwise(
                "Municipal single-origin proxy; use as process scaffold until IBGE 2022 sector/grid origins are loaded."
            ),
        }
    )
    return competition_ranks(
        scored, [KEY_7], {"phase5_precision_rank": F.when(eligible, F.col("telemedicine_precision_index"))}
    ).drop("_valid", "_phase2")


# Columns of the access table with their types.
PRECISION_ACCESS_COLUMNS = {
    "phase5_population_origins": "bigint",
    "phase5_origin_granularity": "string",
    "phase5_origin_population": "double",
    "phase5_population_origin_coverage_ratio": "double",
    "phase5_distance_coverage_ratio": "double",
    "phase5_weighted_mean_ubs_km": "double",
    "phase5_weighted_p50_ubs_km": "double",
    "phase5_weighted_p90_ubs_km": "double",
    "phase5_weighted_mean_pharmacy_km": "double",
    "phase5_weighted_p50_pharmacy_km": "double",
    "phase5_weighted_p90_pharmacy_km": "double",
    "phase5_population_share_ubs_gt_5km": "double",
    "phase5_population_share_pharmacy_le_2km": "double",
    "phase5_population_share_hard_ubs_easy_pharmacy": "double",
    "phase5_population_per_active_ubs": "double",
    "phase5_population_per_physician_fte": "double",
    "phase5_population_per_pfpb_pharmacy": "double",
    "phase5_precision_status": "string",
    "phase5_access_evidence_grade": "string",
}


def precision_shortlist(index: DataFrame, n: int = 100) -> DataFrame:
    """The n best eligible places by the precision index."""
    return (
        index.filter(F.col("phase5_index_eligibility") == "eligible_phase5_precision")
        .orderBy(F.col("telemedicine_precision_index").desc_nulls_last(), KEY_7)
        .limit(n)
    )
