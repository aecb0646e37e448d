"""State priority scores and their sensitivity to the weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import clip, is_named, ratio, right_closed_bins, row_std
from placewise.operators.ordering import percentile_ranks, small_percentile_rank, small_rank_desc
from placewise.operators.scoring import weighted_linear

# Weights per scenario, in the order of PRIORITY_PARTS.
PRIORITY_PARTS = ("ubs_pressure", "coverage_gap", "coord_gap", "territory_gap")
PRIORITY_SCENARIOS = {
    "base": (0.45, 0.40, 0.15, 0.00),
    "coverage_led": (0.30, 0.55, 0.15, 0.00),
    "territory_led": (0.30, 0.30, 0.10, 0.30),
    "data_quality_led": (0.25, 0.25, 0.40, 0.10),
}
# Weights per scenario, in the order of ROBUST_PARTS.
ROBUST_PARTS = (
    "ubs_population_gap",
    "aps_coverage_gap",
    "operational_gap",
    "spatial_quality_gap",
    "territorial_vulnerability_proxy",
)
ROBUST_SCENARIOS = {
    "balanced": (0.25, 0.25, 0.20, 0.15, 0.15),
    "coverage_led": (0.18, 0.40, 0.18, 0.12, 0.12),
    "operations_led": (0.18, 0.18, 0.40, 0.12, 0.12),
    "data_quality_led": (0.18, 0.18, 0.14, 0.35, 0.15),
    "vulnerability_led": (0.20, 0.18, 0.17, 0.10, 0.35),
}
STABILITY_EDGES, STABILITY_LABELS = (-1, 2, 6, 27), ("stable", "moderate", "sensitive")


def priority_sensitivity(places: DataFrame) -> DataFrame:
    """Four scenarios scored per place, averaged and ranked per state. Ranks run over states, a bounded set."""
    ranked = percentile_ranks(
        places.filter(is_named("uf_sigla")),
        ["ibge_municipio"],
        {
            "_supply": F.col("ubs_per_10k_population"),
            "coverage_gap": F.col("coverage_gap_pct"),
            "_density": F.col("ubs_per_1000_km2"),
        },
    ).withColumns(
        {
            "ubs_pressure": 1 - F.col("_supply"),
            "coord_gap": 1 - F.col("coordinate_validity_pct") / 100,
            "territory_gap": 1 - F.col("_density"),
        }
    )
    scores = {f"score_{s}": weighted_linear(dict(zip(PRIORITY_PARTS, w))) for s, w in PRIORITY_SCENARIOS.items()}
    states = (
        ranked.withColumns(scores)
        .groupBy("uf_sigla", "uf_nome", "regiao_nome")
        .agg(*[F.avg(s).alias(s) for s in scores])
    )
    ranks = [f"rank_{s}" for s in PRIORITY_SCENARIOS]
    return states.withColumns({f"rank_{s}": small_rank_desc(f"score_{s}") for s in PRIORITY_SCENARIOS}).withColumns(
        {
            "rank_min": F.least(*ranks),
            "rank_max": F.greatest(*ranks),
            "rank_range": F.greatest(*ranks) - F.least(*ranks),
            "rank_std": row_std(ranks),
        }
    )


def robust_state_index(
    territory: DataFrame, coverage: DataFrame, spatial: DataFrame, operational: DataFrame
) -> DataFrame:
    """Five components, five scenarios, rank range and stability label. One row per state."""
    states = (
        territory.join(coverage.select("uf_sigla", "cobertura_aps_ponderada_capped_pct"), "uf_sigla", "left")
        .join(spatial.select("uf_sigla", "spatial_issue_pct"), "uf_sigla", "left")
        .join(operational.select("uf_sigla", "active_with_recent_sia_production_pct"), "uf_sigla", "left")
        .withColumn("population_density", ratio("population", "area_km2"))
    )
    zero = F.lit(0.0)
    parts = states.withColumns(
        {
            "ubs_population_gap": 1 - small_percentile_rank("ubs_per_10k_population"),
            "aps_coverage_gap": clip(100 - F.col("cobertura_aps_ponderada_capped_pct"), low=0) / 100,
            "operational_gap": 1 - F.coalesce("active_with_recent_sia_production_pct", zero) / 100,
            "spatial_quality_gap": F.coalesce("spatial_issue_pct", zero) / 100,
            "territorial_vulnerability_proxy": 0.5 * small_percentile_rank("population_density")
            + 0.5 * (1 - small_percentile_rank("ubs_per_1000_km2")),
        }
    )
    scores = {f"robust_priority_{s}": weighted_linear(dict(zip(ROBUST_PARTS, w))) for s, w in ROBUST_SCENARIOS.items()}
    ranks = {f"rank_{s}": small_rank_desc(f"robust_priority_{s}") for s in ROBUST_SCENARIOS}
    out = parts.withColumns(scores).withColumns(ranks)
    return out.withColumns(
        {
            "robust_priority_min": F.least(*scores),
            "robust_priority_max": F.greatest(*scores),
            "robust_priority_range": F.greatest(*scores) - F.least(*scores),
            "rank_min": F.least(*ranks),
            "rank_max": F.greatest(*ranks),
            "rank_range": F.greatest(*ranks) - F.least(*ranks),
        }
    ).withColumn("priority_stability_flag", right_closed_bins("rank_range", STABILITY_EDGES, STABILITY_LABELS))


def robust_sensitivity(index: DataFrame) -> DataFrame:
    """The index in long form: one row per state and scenario."""
    rows = [
        F.struct(
            F.lit(s).alias("scenario"),
            F.col(f"robust_priority_{s}").alias("robust_priority_score"),
            F.col(f"rank_{s}").alias("rank"),
        )
        for s in ROBUST_SCENARIOS
    ]
    return index.select("uf_sigla", "uf_nome", "regiao_nome", F.inline(F.array(*rows)))


def scenario_band(index: DataFrame, base: str, scores: list[str], n: int = 10) -> DataFrame:
    """Base score with the lowest and highest scenario, for the n states with the largest base score."""
    return (
        index.select("uf_sigla", F.col(base).alias("base"), F.least(*scores).alias("low"), F.greatest(*scores).alias("high"))
        .orderBy(F.col("base").desc(), "uf_sigla")
        .limit(n)
    )


def extremes(states: DataFrame, by: str, key: str, n: int = 7) -> DataFrame:
    """The n smallest and n largest rows, each once."""
    low = states.orderBy(F.col(by).asc_nulls_last(), key).limit(n)
    high = states.orderBy(F.col(by).desc_nulls_last(), key).limit(n)
    return low.union(high).dropDuplicates([key])
