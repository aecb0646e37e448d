"""Index behavior on small literal frames."""

import pytest
from pyspark.sql import functions as F

from placewise.plans import indices as ix

BASE = "ibge_municipio string, municipio_nome_ibge string, uf_sigla string, populacao_residente long, aps_coverage_capped_pct double, active_ubs_per_100k double, pharmacies long, pharmacies_per_100k double"
ROWS = [
    ("310010", "Alfa", "MG", 400_000, 75.0, 6.0, 40, 10.0),
    ("310020", "Beta", "MG", 80_000, 75.0, 9.0, 4, 5.0),
    ("310030", "Gama", "ES", 120_000, 20.0, 2.5, 0, 0.0),
    ("310040", "Delta", "ES", 60_000, None, 4.0, 6, 10.0),
    ("310050", "Zeta", "SP", 900_000, 100.0, 12.0, 90, 10.0),
]


@pytest.fixture(scope="module")
def opportunity(spark):
    return ix.opportunity_index(spark.createDataFrame(ROWS, BASE)).cache()


def by_key(df, key="ibge_municipio"):
    return {r[key]: r for r in df.collect()}


def test_opportunity(opportunity):
    """By hand: a quarter of 400,000 is uncovered; 100,000 > 96,000 > 20,000 > 0; gaps are 25, 25, 80 and 0."""
    r = {x.municipio_nome_ibge: x for x in opportunity.collect()}
    assert [r[k].potentially_uncovered_population for k in ("Alfa", "Beta", "Gama", "Zeta")] == pytest.approx([100_000, 20_000, 96_000, 0])
    volumes = [r[k].uncovered_volume_percentile for k in ("Alfa", "Gama", "Beta", "Zeta")]
    assert volumes == sorted(volumes, reverse=True) and volumes[-1] == 0
    assert r["Alfa"].aps_gap_percentile == r["Beta"].aps_gap_percentile < r["Gama"].aps_gap_percentile
    assert (r["Zeta"].need_score, r["Gama"].pharmacy_launchability_score) == (0, 0)
    assert (r["Gama"].academic_eligibility, r["Gama"].positioning_segment) == ("no_observed_pfpb_pharmacy", "infrastructure_gap")
    assert (r["Delta"].academic_eligibility, r["Delta"].telemedicine_opportunity_balanced) == ("insufficient_core_data", None)


def test_scenario_rows(opportunity):
    assert ix.scenario_rows(opportunity).count() == 3 * len(ROWS)


def test_draws_repeat_for_one_seed(opportunity):
    first = sorted(map(tuple, ix.opportunity_draws(opportunity, 30, 7).collect()))
    second = sorted(map(tuple, ix.opportunity_draws(opportunity, 30, 7).collect()))
    assert first == second and len(first) == len(ROWS)


P1 = BASE + ", potentially_uncovered_population double, physician_fte_per_100k double, households_with_internet_pct double, mobile_4g5g_resident_coverage_pct double, fixed_broadband_accesses_per_100_people double, sia_quantity_all_procedures double"


def phase1(spark, physicians=12.0, production=40.0):
    same = (350_000, 60.0, 8.0, 21, 6.0, 140_000.0)
    rows = [
        ("310010", "Alfa", "MG", *same, physicians, 82.0, 91.0, 24.0, production),
        ("310020", "Beta", "MG", *same, 45.0, 61.0, 70.0, 9.0, 2_500.0),
    ]
    return by_key(ix.phase1_index(spark.createDataFrame(rows, P1)))


def test_phase1(spark):
    """Alike in all but physicians and connection: fewer physicians is more need, better lines more readiness."""
    a, b = (phase1(spark)[k] for k in ("310010", "310020"))
    assert a.phase1_need_score > b.phase1_need_score
    assert a.digital_readiness_score > b.digital_readiness_score
    assert a.phase1_deployment_feasibility_score > b.phase1_deployment_feasibility_score


def test_production_is_never_scored(spark):
    scores = {phase1(spark, production=n)["310010"].telemedicine_phase1_balanced for n in (0.0, 40.0, 7e8)}
    assert len(scores) == 1


def test_phase1_missing_input_is_not_scored(spark):
    r = phase1(spark, physicians=None)["310010"]
    assert r.phase1_eligibility == "insufficient_phase1_data" and r.telemedicine_phase1_balanced is None


P2 = "ibge_municipio string, phase1_need_score double, phase1_deployment_feasibility_score double, phase1_eligibility string, origin_inside_main_polygon boolean, nearest_ubs_geodesic_km double, nearest_pharmacy_geodesic_km double, pharmacies long"


@pytest.fixture(scope="module")
def phase2(spark):
    """Four places whose far ranks are 1, 2, 3, 4 of 4 and whose near ranks are 4, 2, 3, 1; four more that can't be placed or scored."""
    ok = "eligible_phase1_proxy"
    rows = [
        ("410010", 36.0, 49.0, ok, True, 3.0, 0.4, 5),
        ("410020", 25.0, 81.0, ok, True, 7.0, 6.0, 1),
        ("410030", 64.0, 64.0, ok, True, 12.0, 1.5, 9),
        ("410040", 0.0, 100.0, ok, True, 40.0, 9.0, 3),
        ("410050", 70.0, 70.0, "insufficient_phase1_data", None, None, None, 2),
        ("410060", 70.0, 70.0, ok, True, 8.0, None, 2),
        ("410070", 70.0, 70.0, ok, False, 8.0, 1.0, 2),
        ("410080", 70.0, 70.0, ok, None, 8.0, 1.0, 0),
    ]
    return by_key(ix.phase2_index(spark.createDataFrame(rows, P2)))


def test_phase2_mismatch_by_hand(phase2):
    """barrier**0.6 * ease**0.4; equal percentiles p give p itself."""
    scores = [phase2[f"4100{k}0"].phase2_spatial_mismatch_score for k in (1, 2, 3, 4)]
    assert scores == pytest.approx([100 * 0.25**0.6, 50, 75, 100 * 0.25**0.4])
    assert phase2["410030"].telemedicine_phase2_balanced == pytest.approx(100 * 0.64**0.7 * 0.75**0.3)
    assert phase2["410020"].telemedicine_phase2_deployment_led == pytest.approx(100 * 0.25**0.35 * 0.5**0.25 * 0.81**0.4)
    assert phase2["410040"].telemedicine_phase2_equity_led == 0  # without need


def test_phase2_targets_and_reasons(phase2):
    """At least 5 km to the one and at most 2 to the other, with a pharmacy: only the third place."""
    assert {k: r.phase2_spatial_target_rank for k, r in phase2.items() if r.phase2_spatial_target_rank} == {"410030": 1}
    reasons = [phase2[f"4100{k}0"].phase2_eligibility for k in (5, 6, 7, 8)]
    assert reasons == ["phase1_ineligible", "insufficient_spatial_data", "invalid_origin_proxy", "insufficient_spatial_data"]
    assert all(phase2[f"4100{k}0"].telemedicine_phase2_balanced is None for k in (5, 6, 7, 8))


def test_phase4_by_hand(spark):
    """Routed minutes rank 1 to 4 one way and 2, 4, 1, 3 the other way; the fifth place has only one route."""
    schema = "ibge_municipio_7 string, phase2_need_pillar double, phase2_feasibility_pillar double, active_ubs_travel_time_minutes double, osm_pharmacy_travel_time_minutes double, phase3_routed_hard_ubs_easy_pharmacy_flag boolean"
    rows = [
        ("5100102", 50.0, 40.0, 6.0, 11.0, False),
        ("5100201", 50.0, 40.0, 19.0, 2.5, True),
        ("5100250", 90.0, 10.0, 22.0, 30.0, None),
        ("5100300", 70.0, 90.0, 75.0, 4.0, True),
        ("5100359", 70.0, 90.0, 75.0, None, True),
    ]
    r = by_key(ix.phase4_index(spark.createDataFrame(rows, schema)), "ibge_municipio_7")
    barrier, ease = (0.25, 0.5, 0.75, 1.0), (0.5, 1.0, 0.25, 0.75)
    for (key, need, feasible, *_), b, e in zip(rows, barrier, ease):
        access = b**0.65 * e**0.35
        assert r[key].phase4_routed_access_score == pytest.approx(100 * access)
        assert r[key].telemedicine_phase4_routed_validation == pytest.approx(100 * (need / 100) ** 0.45 * access**0.35 * (feasible / 100) ** 0.2)
    assert [r[k[0]].phase4_routed_target_rank for k in rows] == [None, 2, None, 1, None]
    lost = r["5100359"]
    assert (lost.phase4_interpretation, lost.phase4_evidence_grade, lost.phase4_routed_validation_rank) == ("not_routed_in_phase4", "C_not_routed", None)
    assert r["5100250"].phase4_interpretation == "routed_validation_not_primary_target"


def test_precision_by_hand(spark):
    """Two of five places count: one knows too few origins, one too few distances, one has no access row."""
    ok = "eligible_phase2_geodesic_proxy"
    places = [(f"510{k}000", 49.0 + k, 81.0, ok if k != 5 else "phase1_ineligible") for k in range(1, 7)]
    access = [
        ("5101000", 18.0, 0.2, 0.6, 0.9, 0.95),
        ("5102000", 4.0, 0.7, 0.1, 1.0, 0.96),
        ("5103000", 9.0, 0.5, 0.3, 0.89, 1.0),
        ("5104000", 9.0, 0.5, 0.3, 1.0, 0.94),
        ("5105000", None, 0.5, 0.3, 1.0, 1.0),
    ]
    p2 = spark.createDataFrame(places, "ibge_municipio_7 string, phase2_need_pillar double, phase2_feasibility_pillar double, phase2_eligibility string")
    right = spark.createDataFrame(access, "ibge_municipio_7 string, phase5_weighted_p90_ubs_km double, phase5_population_share_pharmacy_le_2km double, phase5_population_share_hard_ubs_easy_pharmacy double, phase5_population_origin_coverage_ratio double, phase5_distance_coverage_ratio double")
    r = by_key(ix.precision_index(p2, right.withColumn("phase5_access_evidence_grade", F.lit("B2_municipal_population_proxy"))), "ibge_municipio_7")
    # percentiles are 1, 1/2, 1 and 1/2, 1, 1/2
    spatial = {"5101000": 0.5**0.25, "5102000": 0.5**0.75}
    for key, s in spatial.items():
        need = r[key].phase2_need_pillar / 100
        assert r[key].telemedicine_precision_index == pytest.approx(100 * need**0.45 * s**0.35 * 0.81**0.2)
    assert [r[k].phase5_precision_rank for k in ("5101000", "5102000")] == [1, 2]
    reasons = [r[f"510{k}000"].phase5_index_eligibility for k in (3, 4, 5, 6)]
    assert reasons == ["insufficient_phase5_spatial_precision_data"] * 2 + ["phase2_ineligible", "insufficient_phase5_spatial_precision_data"]
    assert r["5106000"].phase5_evidence_grade == "C_incomplete" and r["5101000"].phase5_method_note.startswith("Municipal")
