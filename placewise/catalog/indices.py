"""Score, index, decision, state and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case, stage
from placewise.operators import draws as dr
from placewise.operators.scoring import Component, add_percentiles, weighted_geometric, weighted_linear
from placewise.plans import decisions as dec
from placewise.plans import indices as ix
from placewise.plans import priority
from placewise.runtime import cut

# ---- SQL pieces for the checks --------------------------------------------------------------


def pct(v: str, down: bool = False) -> str:
    order = " DESC" if down else ""
    return (
        f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {v} IS NULL ORDER BY {v}{order}) "
        f"+ (count(*) OVER (PARTITION BY {v}) - 1) / 2e0) / count({v}) OVER () END"
    )


def rank_of(v: str, mask: str) -> str:
    return f"CASE WHEN {mask} THEN CAST(rank() OVER (PARTITION BY {mask} ORDER BY {v} DESC) AS DOUBLE) END"


def ln(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN ln(least(greatest({x}, 1e-6), 1e0)) END"


def geometric(parts: dict[str, float]) -> str:
    return "exp(" + " + ".join(f"{w} * ({ln(x)})" for x, w in parts.items()) + ")"


def percentiles(out: str, src: str, key: str, specs: dict[str, dict], winsor: bool = True) -> str:
    """CTEs that add percentile columns to ``src`` under the name ``out``."""
    v, cuts, clipped, final = [], [], [], []
    for i, (name, s) in enumerate(specs.items()):
        value = s["value"]
        keep = f"({s['valid']})" + (f" AND {value} > 0" if s.get("zero") else "")
        body = f"ln(1 + greatest({value}, 0))" if s.get("log") else value
        v.append(f"CASE WHEN {keep} THEN {body} END AS v{i}")
        cuts.append(f"quantile_cont(v{i}, 0.01) AS lo{i}, quantile_cont(v{i}, 0.99) AS hi{i}")
        clipped.append(f"CASE WHEN v{i} IS NOT NULL THEN {f'least(greatest(v{i}, lo{i}), hi{i})' if winsor else f'v{i}'} END AS v{i}")
        p = pct(f"v{i}", s.get("down", False))
        if s.get("zero"):
            p = f"CASE WHEN ({s['valid']}) AND {value} <= 0 THEN 0e0 ELSE {p} END"
        final.append(f"coalesce({p}, {s['missing']}) AS {name}" if "missing" in s else f"{p} AS {name}")
    return (
        f"{out}_v AS (SELECT *, {', '.join(v)} FROM {src}), {out}_q AS (SELECT {', '.join(cuts)} FROM {out}_v), "
        f"{out}_c AS (SELECT {out}_v.* REPLACE ({', '.join(clipped)}) FROM {out}_v CROSS JOIN {out}_q), "
        f"{out} AS (SELECT * EXCLUDE ({', '.join(f'v{i}' for i in range(len(specs)))}), {', '.join(final)} FROM {out}_c)"
    )


# ---- preliminary index ------------------------------------------------------------------------

OPP_CTES = f"""ob AS (SELECT *, greatest(0, least(1, 1 - aps_coverage_capped_pct / 100)) * CASE WHEN aps_coverage_capped_pct IS NOT NULL THEN 1 END AS gap,
    coalesce(populacao_residente > 0 AND aps_coverage_capped_pct IS NOT NULL AND active_ubs_per_100k IS NOT NULL, false) AS core,
    pharmacies > 0 AS obs, coalesce(pharmacies_per_100k, 0) AS prate FROM st_gap_base),
ob2 AS (SELECT *, populacao_residente * gap AS uncovered FROM ob),
{percentiles('op', 'ob2', 'ibge_municipio', {
    'p_vol': dict(value='uncovered', valid='core', log=True, zero=True),
    'p_gap': dict(value='gap', valid='core', zero=True),
    'p_ubs': dict(value='active_ubs_per_100k', valid='core', down=True),
    'p_cnt': dict(value='pharmacies', valid='core AND obs', log=True, missing=0),
    'p_den': dict(value='prate', valid='core AND obs', missing=0)})},
os AS (SELECT *, CASE WHEN core AND gap = 0 THEN 0 ELSE 100 * {geometric({'p_vol': 0.5, 'p_gap': 0.25, 'p_ubs': 0.25})} END AS need_score,
    CASE WHEN obs THEN 100 * {geometric({'p_cnt': 0.5, 'p_den': 0.5})} ELSE 0 END AS launch,
    CASE WHEN NOT core THEN 'insufficient_core_data' WHEN NOT obs THEN 'no_observed_pfpb_pharmacy' ELSE 'eligible_proxy' END AS academic_eligibility FROM op),
ot AS (SELECT *, academic_eligibility = 'eligible_proxy' AS el,
    {', '.join(f"CASE WHEN core THEN CASE WHEN need_score = 0 THEN 0 ELSE 100 * {geometric({'(need_score / 100)': a, '(launch / 100)': b})} END END AS s_{n}"
      for n, a, b in (('balanced', 0.5, 0.5), ('equity_led', 0.7, 0.3), ('deployment_led', 0.4, 0.6)))} FROM os),
orr AS (SELECT *, {rank_of('s_balanced', 'el')} AS r1, {rank_of('s_equity_led', 'el')} AS r2, {rank_of('s_deployment_led', 'el')} AS r3,
    {pct('(CASE WHEN el THEN need_score END)')} AS np, {pct('(CASE WHEN el THEN launch END)')} AS lp FROM ot),
oi AS (SELECT *, CASE WHEN NOT core THEN 'insufficient_data' WHEN NOT obs THEN 'infrastructure_gap'
      WHEN el AND np >= 0.8 AND lp >= 0.8 THEN 'pilot_candidate' WHEN el AND lp >= 0.8 THEN 'launchable_secondary'
      WHEN el AND np >= 0.8 THEN 'high_need_build_supply' ELSE 'monitor' END AS positioning_segment,
    coalesce(el AND greatest(r1, r2, r3) <= greatest(1, floor((SELECT count(*) FROM ot WHERE el) * 0.10)), false) AS stable_top_decile FROM orr)"""


def opportunity(t):
    return stage(t, "opportunity", lambda: ix.opportunity_index(stage(t, "gap_base", lambda: t.st_gap_base)))


@case(
    "ix_11_opportunity_index",
    f"""WITH {OPP_CTES} SELECT ibge_municipio, need_score, launch AS pharmacy_launchability_score, academic_eligibility,
        s_balanced AS telemedicine_opportunity_balanced, s_equity_led AS telemedicine_opportunity_equity_led,
        s_deployment_led AS telemedicine_opportunity_deployment_led, r1 AS rank_balanced, least(r1, r2, r3) AS rank_best,
        greatest(r1, r2, r3) AS rank_worst, greatest(r1, r2, r3) - least(r1, r2, r3) AS rank_range FROM oi""",
    "need_score pharmacy_launchability_score telemedicine_opportunity_balanced telemedicine_opportunity_equity_led telemedicine_opportunity_deployment_led",
)
def _(t):
    return opportunity(t).select(
        "ibge_municipio", "need_score", "pharmacy_launchability_score", "academic_eligibility",
        *[f"telemedicine_opportunity_{s}" for s in ix.OPPORTUNITY_SCENARIOS],
        "rank_balanced", "rank_best", "rank_worst", "rank_range",
    )


@case("ix_12_positioning", f"WITH {OPP_CTES} SELECT ibge_municipio, positioning_segment, stable_top_decile FROM oi")
def _(t):
    return opportunity(t).select("ibge_municipio", "positioning_segment", "stable_top_decile")


@case(
    "st_07_split_outputs",
    f"""WITH {OPP_CTES} SELECT 'candidate' AS output, ibge_municipio FROM oi
        WHERE positioning_segment IN ('pilot_candidate', 'high_need_build_supply', 'launchable_secondary')
        UNION ALL SELECT 'shortlist', ibge_municipio FROM oi WHERE stable_top_decile""",
)
def _(t):
    index = opportunity(t)
    return ix.candidates(index).select(F.lit("candidate").alias("output"), "ibge_municipio").union(
        index.filter("stable_top_decile").select(F.lit("shortlist"), "ibge_municipio")
    )


@case(
    "st_03_scenario_rows",
    f"""WITH {OPP_CTES} SELECT ibge_municipio, unnest(['balanced', 'equity_led', 'deployment_led']) AS scenario,
        unnest([s_balanced, s_equity_led, s_deployment_led]) AS opportunity_score, unnest([r1, r2, r3]) AS rank FROM oi""",
    "opportunity_score",
)
def _(t):
    return ix.scenario_rows(opportunity(t)).drop("municipio_nome_ibge", "uf_sigla")


# ---- score building blocks ---------------------------------------------------------------------


@case(
    "ix_01_winsorized_percentile",
    f"""WITH b AS (SELECT *, o_orderstatus <> 'P' AS ok FROM orders), {percentiles('r', 'b', 'o_orderkey', {
        'plain': dict(value='o_totalprice', valid='ok'), 'down': dict(value='o_totalprice', valid='ok', down=True),
        'zeroed': dict(value='(o_orderkey % 7)', valid='ok', log=True, zero=True)})} SELECT o_orderkey, plain, down, zeroed FROM r""",
    "plain down zeroed",
)
def _(t):
    ok = F.col("o_orderstatus") != "P"
    specs = {
        "plain": Component("o_totalprice", ok),
        "down": Component("o_totalprice", ok, inverse=True),
        "zeroed": Component(F.col("o_orderkey") % 7, ok, log=True, structural_zero=True),
    }
    return add_percentiles(t.orders, "o_orderkey", specs).select("o_orderkey", "plain", "down", "zeroed")


@case(
    "ix_02_plain_percentile",
    f"WITH r AS (SELECT o_orderkey, {pct('o_totalprice', True)} AS p FROM orders WHERE o_orderstatus <> 'P') SELECT * FROM r UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'",
    "p",
)
def _(t):
    """Orders outside the mask keep their row, without a score."""
    spec = {"p": Component("o_totalprice", F.col("o_orderstatus") != "P", inverse=True)}
    return add_percentiles(t.orders, "o_orderkey", spec, winsorize=False).select("o_orderkey", "p")


@case(
    "ix_03_weighted_geometric",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN {geometric({'l_discount': 0.6, '(l_tax * 10)': 0.4})} END AS g FROM lineitem""",
    "g",
)
def _(t):
    first = F.when(F.col("l_linenumber") != 7, F.col("l_discount"))
    g = weighted_geometric({"a": first, "b": F.col("l_tax") * 10}, {"a": 0.6, "b": 0.4})
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", g.alias("g"))


@case(
    "ix_04_weighted_linear",
    "SELECT l_orderkey, l_partkey, l_linenumber, (l_discount * 0.45 + l_tax * 0.55) * 100 AS s FROM lineitem",
    "s",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", weighted_linear({"l_discount": 0.45, "l_tax": 0.55}).alias("s"))


# ---- draws ---------------------------------------------------------------------------------------


def uniform_sql(slot: str, j: int) -> str:
    return (
        f"((CAST('0x' || substr(md5('{dr.DEFAULT_SEED}:' || CAST(draw AS STRING) || ':{slot}:{j}'), 1, 13) AS BIGINT) + 1e0) / 4503599627370496e0)"
    )


def dirichlet_sql(group: str, alphas) -> str:
    gammas = ["(" + " + ".join(f"-ln({uniform_sql(f'{group}{i}', j)})" for j in range(k)) + ")" for i, k in enumerate(alphas)]
    return ", ".join(f"{g} AS {group}_g{i}" for i, g in enumerate(gammas))


def draws_cte(groups: dict, shares: dict) -> str:
    parts = [dirichlet_sql(g, a) for g, a in groups.items()]
    parts += [f"{lo} + {uniform_sql(n, 0)} * {hi - lo} AS {n}" for n, (lo, hi) in shares.items()]
    norm = []
    for g, a in groups.items():
        whole = " + ".join(f"{g}_g{i}" for i in range(len(a)))
        norm += [f"{g}_g{i} / ({whole}) AS {g}_w{i}" for i in range(len(a))]
    numbered = f"(SELECT CAST(range AS INT) AS draw FROM range({dr.DEFAULT_DRAWS})) x"
    return f"dg AS (SELECT draw, {', '.join(parts)} FROM {numbered}), dw AS (SELECT *, {', '.join(norm)} FROM dg)"


def draw_score(columns: list[str], group: str) -> str:
    return "exp(" + " + ".join(f"{group}_w{i} * ({ln(c)})" for i, c in enumerate(columns)) + ")"


def stats_cte(subset: str, score: str, band: bool, prefix: str) -> str:
    extra = f"quantile_cont(score, 0.05) AS {prefix}score_p05, quantile_cont(score, 0.95) AS {prefix}score_p95, " if band else ""
    return f"""sim AS (SELECT ibge_municipio, draw, {score} AS score FROM {subset} CROSS JOIN dw),
rk AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY score DESC) + (count(*) OVER (PARTITION BY draw, score) - 1) / 2e0 AS rank,
    count(*) OVER (PARTITION BY draw) AS n FROM sim),
stats AS (SELECT ibge_municipio, quantile_cont(score, 0.5) AS {prefix}score_median, {extra}quantile_cont(rank, 0.5) AS {prefix}rank_median,
    quantile_cont(rank, 0.05) AS {prefix}rank_p05, quantile_cont(rank, 0.95) AS {prefix}rank_p95,
    avg(CASE WHEN rank <= greatest(1, ceil(n * 0.10)) THEN 1e0 ELSE 0e0 END) AS {prefix}probability_top_decile FROM rk GROUP BY 1)"""


OPP_SCORE = (
    "CASE WHEN gap = 0 THEN 0 ELSE exp(ln(greatest(1e-6, least(1e0, "
    + draw_score(["p_vol", "p_gap", "p_ubs"], "need")
    + "))) * share + ln("
    + draw_score(["p_cnt", "p_den"], "launch")
    + ") * (1 - share)) * 100 END"
)
OPP_DRAW_CTES = (
    f"{OPP_CTES}, {draws_cte(ix.OPPORTUNITY_DRAWS, {'share': (0.40, 0.70)})}, oe AS (SELECT * FROM oi WHERE el), "
    + stats_cte("oe", OPP_SCORE, True, "mc_")
)
MC = "score_median rank_median:2 rank_p05:2 rank_p95:2 probability_top_decile"


def rounded_stats(prefix: str, band: bool = False) -> str:
    names = MC.split() + (["score_p05", "score_p95"] if band else [])
    return " ".join(f"{prefix}{n}" if ":" in n else f"{prefix}{n}:4" for n in names)


@case(
    "ix_13_weight_draws",
    f"WITH {OPP_DRAW_CTES} SELECT oi.ibge_municipio, oi.academic_eligibility, stats.* EXCLUDE (ibge_municipio) FROM oi LEFT JOIN stats USING (ibge_municipio)",
    rounded_stats("mc_", True),
)
def _(t):
    return ix.opportunity_draws(opportunity(t)).drop("municipio_nome_ibge", "uf_sigla")


@case(
    "ix_16_shortlist",
    f"""WITH {OPP_DRAW_CTES} SELECT ibge_municipio, mc_probability_top_decile, s_balanced AS telemedicine_opportunity_balanced FROM oi
        LEFT JOIN stats USING (ibge_municipio) WHERE stable_top_decile ORDER BY mc_probability_top_decile DESC, s_balanced DESC, ibge_municipio LIMIT 100""",
    "mc_probability_top_decile:4 telemedicine_opportunity_balanced",
)
def _(t):
    index = opportunity(t)
    out = ix.shortlist(index, F.col("stable_top_decile"), ix.opportunity_draws(index), "mc_", "telemedicine_opportunity_balanced")
    return out.select("ibge_municipio", "mc_probability_top_decile", "telemedicine_opportunity_balanced")


@case(
    "wn_06_rank_per_draw",
    f"WITH {OPP_DRAW_CTES} SELECT draw, count(*) AS n, max(rank) AS worst, min(rank) AS best FROM rk GROUP BY draw",
    "worst best",
)
def _(t):
    subset = opportunity(t).filter("academic_eligibility = 'eligible_proxy'")
    table = dr.draw_table(t.spark, dr.DEFAULT_DRAWS, dr.DEFAULT_SEED, ix.OPPORTUNITY_DRAWS, {"share": (0.40, 0.70)})
    need = dr.geometric_draw(["uncovered_volume_percentile", "aps_gap_percentile", "active_ubs_scarcity_percentile"], "need")
    launch = dr.geometric_draw(["pharmacy_count_percentile", "pharmacy_density_percentile"], "launch")
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), need))
    score = F.exp(F.ln(held) * F.col("share") + F.ln(launch) * (1 - F.col("share"))) * 100
    score = F.when(F.col("aps_relative_gap") == 0, 0.0).otherwise(score)
    scored = subset.crossJoin(F.broadcast(table)).select("draw", score.alias("value"))
    return dr.ranks_in_draws(scored).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("worst"), F.min("rank").alias("best"))


# ---- phase 1 -----------------------------------------------------------------------------------

P1_CTES = f"""pb AS (SELECT *, CASE WHEN aps_coverage_capped_pct IS NOT NULL THEN greatest(0, least(1, 1 - aps_coverage_capped_pct / 100)) END AS gap,
    coalesce(populacao_residente > 0, false) AND potentially_uncovered_population IS NOT NULL AND aps_coverage_capped_pct IS NOT NULL
      AND active_ubs_per_100k IS NOT NULL AND physician_fte_per_100k IS NOT NULL AS nok,
    households_with_internet_pct IS NOT NULL AND mobile_4g5g_resident_coverage_pct IS NOT NULL AND fixed_broadband_accesses_per_100_people IS NOT NULL AS dok,
    pharmacies > 0 AS obs, coalesce(pharmacies_per_100k, 0) AS prate FROM st_phase1_base),
{percentiles('pp', 'pb', 'ibge_municipio', {
    'p_vol': dict(value='potentially_uncovered_population', valid='nok', log=True, zero=True),
    'p_gap': dict(value='gap', valid='nok', zero=True),
    'p_ubs': dict(value='active_ubs_per_100k', valid='nok', down=True),
    'p_fte': dict(value='physician_fte_per_100k', valid='nok', down=True),
    'p_int': dict(value='households_with_internet_pct', valid='dok'),
    'p_mob': dict(value='mobile_4g5g_resident_coverage_pct', valid='dok'),
    'p_fix': dict(value='fixed_broadband_accesses_per_100_people', valid='dok', log=True),
    'p_cnt': dict(value='pharmacies', valid='nok AND obs', log=True, missing=0),
    'p_den': dict(value='prate', valid='nok AND obs', missing=0)})},
ps AS (SELECT *, CASE WHEN nok AND gap = 0 THEN 0 ELSE 100 * {geometric({'p_vol': 0.45, 'p_gap': 0.2, 'p_ubs': 0.15, 'p_fte': 0.2})} END AS phase1_need_score,
    100 * {geometric({'p_int': 0.5, 'p_mob': 0.3, 'p_fix': 0.2})} AS digital_readiness_score,
    CASE WHEN obs THEN 100 * {geometric({'p_cnt': 0.5, 'p_den': 0.5})} ELSE 0 END AS launch FROM pp),
pf AS (SELECT *, 100 * {geometric({'(launch / 100)': 0.7, '(digital_readiness_score / 100)': 0.3})} AS phase1_deployment_feasibility_score,
    CASE WHEN NOT nok OR NOT dok THEN 'insufficient_phase1_data' WHEN NOT obs THEN 'no_observed_pfpb_pharmacy' ELSE 'eligible_phase1_proxy' END AS phase1_eligibility FROM ps),
pt AS (SELECT *, phase1_eligibility = 'eligible_phase1_proxy' AS el1,
    {', '.join(f"CASE WHEN nok AND dok AND obs THEN CASE WHEN phase1_need_score = 0 THEN 0 ELSE 100 * {geometric({'(phase1_need_score / 100)': a, '(phase1_deployment_feasibility_score / 100)': b})} END END AS telemedicine_phase1_{n}"
      for n, a, b in (('balanced', 0.5, 0.5), ('equity_led', 0.7, 0.3), ('deployment_led', 0.4, 0.6)))} FROM pf),
p1 AS (SELECT *, {rank_of('telemedicine_phase1_balanced', 'el1')} AS phase1_rank_balanced, {rank_of('telemedicine_phase1_equity_led', 'el1')} AS phase1_rank_equity_led,
    {rank_of('telemedicine_phase1_deployment_led', 'el1')} AS phase1_rank_deployment_led FROM pt)"""


def phase1(t):
    return stage(t, "phase1", lambda: ix.phase1_index(stage(t, "phase1_base", lambda: t.st_phase1_base)))


P1_COLUMNS = (
    "ibge_municipio phase1_need_score digital_readiness_score phase1_deployment_feasibility_score phase1_eligibility "
    "telemedicine_phase1_balanced telemedicine_phase1_equity_led telemedicine_phase1_deployment_led phase1_rank_balanced phase1_rank_equity_led"
).split()


@case(
    "ix_17_phase1_index",
    f"WITH {P1_CTES} SELECT {', '.join(P1_COLUMNS)} FROM p1",
    "phase1_need_score digital_readiness_score phase1_deployment_feasibility_score telemedicine_phase1_balanced telemedicine_phase1_equity_led telemedicine_phase1_deployment_led",
)
def _(t):
    return phase1(t).select(*P1_COLUMNS)


P1_SCORE = (
    "CASE WHEN gap = 0 THEN 0 ELSE pow("
    + draw_score(["p_vol", "p_gap", "p_ubs", "p_fte"], "need")
    + ", need_share) * pow(pow("
    + draw_score(["p_cnt", "p_den"], "pharmacy")
    + ", pharmacy_share) * pow("
    + draw_score(["p_int", "p_mob", "p_fix"], "digital")
    + ", 1 - pharmacy_share), 1 - need_share) * 100 END"
)


@case(
    "ix_14_phase1_draws",
    f"WITH {P1_CTES}, {draws_cte(ix.PHASE1_DRAWS, {'pharmacy_share': (0.60, 0.80), 'need_share': (0.40, 0.70)})}, pe AS (SELECT * FROM p1 WHERE el1), "
    + stats_cte("pe", P1_SCORE, False, "phase1_mc_")
    + " SELECT p1.ibge_municipio, stats.* EXCLUDE (ibge_municipio) FROM p1 LEFT JOIN stats USING (ibge_municipio)",
    rounded_stats("phase1_mc_"),
)
def _(t):
    return ix.phase1_draws(phase1(t)).drop("municipio_nome_ibge", "uf_sigla", "phase1_eligibility")


# ---- phase 2 -----------------------------------------------------------------------------------

P2_CTES = f"""{P1_CTES},
qb AS (SELECT p1.*, s.* EXCLUDE (ibge_municipio), coalesce(origin_quality_valid, false) AND nearest_ubs_geodesic_km IS NOT NULL
    AND nearest_pharmacy_geodesic_km IS NOT NULL AS sok FROM p1 LEFT JOIN st_spatial s USING (ibge_municipio)),
{percentiles('qp', 'qb', 'ibge_municipio', {'b_far': dict(value='nearest_ubs_geodesic_km', valid='sok'),
    'b_near': dict(value='nearest_pharmacy_geodesic_km', valid='sok', down=True)})},
qs AS (SELECT *, 100 * {geometric({'b_far': 0.6, 'b_near': 0.4})} AS phase2_spatial_mismatch_score, phase1_need_score AS phase2_need_pillar,
    phase1_deployment_feasibility_score AS phase2_feasibility_pillar, sok AND el1 AS el2,
    CASE WHEN el1 AND origin_quality_valid = false THEN 'invalid_origin_proxy' WHEN el1 AND NOT sok THEN 'insufficient_spatial_data'
      WHEN NOT el1 THEN 'phase1_ineligible' ELSE 'eligible_phase2_geodesic_proxy' END AS phase2_eligibility FROM qp),
qt AS (SELECT *, el2 AND hard_ubs_easy_pharmacy_flag AND phase2_need_pillar > 0 AS tg,
    {', '.join(f"CASE WHEN el2 THEN CASE WHEN phase2_need_pillar = 0 THEN 0 ELSE 100 * {geometric({'(phase2_need_pillar / 100)': a, '(phase2_spatial_mismatch_score / 100)': b, '(phase2_feasibility_pillar / 100)': c})} END END AS telemedicine_phase2_{n}"
      for n, a, b, c in (('balanced', 0.45, 0.30, 0.25), ('equity_led', 0.6, 0.25, 0.15), ('deployment_led', 0.35, 0.25, 0.4)))} FROM qs),
p2 AS (SELECT *, {rank_of('telemedicine_phase2_balanced', 'el2')} AS phase2_rank_balanced,
    {rank_of('telemedicine_phase2_equity_led', 'el2')} AS phase2_rank_equity_led, {rank_of('telemedicine_phase2_deployment_led', 'el2')} AS phase2_rank_deployment_led,
    {rank_of('telemedicine_phase2_balanced', 'coalesce(tg, false)')} AS phase2_spatial_target_rank FROM qt)"""


def phase2(t):
    return stage(t, "phase2", lambda: ix.phase2_index(phase1(t).join(t.st_spatial, "ibge_municipio", "left")))


P2_COLUMNS = (
    "ibge_municipio phase2_spatial_mismatch_score phase2_need_pillar phase2_feasibility_pillar phase2_eligibility "
    "telemedicine_phase2_balanced telemedicine_phase2_equity_led telemedicine_phase2_deployment_led phase2_rank_balanced "
    "phase2_rank_equity_led phase2_rank_deployment_led phase2_spatial_target_rank"
).split()


@case(
    "ix_29_phase2_index",
    f"WITH {P2_CTES} SELECT {', '.join(P2_COLUMNS)} FROM p2",
    "phase2_spatial_mismatch_score phase2_need_pillar phase2_feasibility_pillar telemedicine_phase2_balanced telemedicine_phase2_equity_led telemedicine_phase2_deployment_led",
)
def _(t):
    return phase2(t).select(*P2_COLUMNS)


P2_SCORE = (
    "CASE WHEN phase2_need_pillar = 0 THEN 0 ELSE "
    + draw_score(["(phase2_need_pillar / 100)", "(phase2_spatial_mismatch_score / 100)", "(phase2_feasibility_pillar / 100)"], "pillar")
    + " * 100 END"
)


@case(
    "ix_15_phase2_draws",
    f"WITH {P2_CTES}, {draws_cte(ix.PHASE2_DRAWS, {})}, qe AS (SELECT * FROM p2 WHERE el2), "
    + stats_cte("qe", P2_SCORE, False, "phase2_mc_")
    + " SELECT p2.ibge_municipio, stats.* EXCLUDE (ibge_municipio) FROM p2 LEFT JOIN stats USING (ibge_municipio)",
    rounded_stats("phase2_mc_"),
)
def _(t):
    return ix.phase2_draws(phase2(t)).drop("uf_sigla", "phase2_eligibility")


# ---- routed and precision -------------------------------------------------------------------------

P4_CTES = f"""{P2_CTES},
tb AS (SELECT p2.*, r.* EXCLUDE (ibge_municipio_7), active_ubs_travel_time_minutes IS NOT NULL AND osm_pharmacy_travel_time_minutes IS NOT NULL AS rok
    FROM p2 LEFT JOIN st_routes r USING (ibge_municipio_7)),
{percentiles('tp', 'tb', 'ibge_municipio_7', {'t_far': dict(value='active_ubs_travel_time_minutes', valid='rok'),
    't_near': dict(value='osm_pharmacy_travel_time_minutes', valid='rok', down=True)}, winsor=False)},
ts AS (SELECT *, 100 * {geometric({'t_far': 0.65, 't_near': 0.35})} AS phase4_routed_access_score,
    rok AND coalesce(phase3_routed_hard_ubs_easy_pharmacy_flag, false) AS ptg FROM tp),
tt AS (SELECT *, CASE WHEN rok THEN 100 * {geometric({'(phase2_need_pillar / 100)': 0.45, '(phase4_routed_access_score / 100)': 0.35, '(phase2_feasibility_pillar / 100)': 0.2})} END
    AS telemedicine_phase4_routed_validation FROM ts),
p4 AS (SELECT *, CASE WHEN telemedicine_phase4_routed_validation IS NOT NULL THEN {rank_of('telemedicine_phase4_routed_validation', '(telemedicine_phase4_routed_validation IS NOT NULL)')} END AS phase4_routed_validation_rank,
    {rank_of('telemedicine_phase4_routed_validation', '(ptg AND telemedicine_phase4_routed_validation IS NOT NULL)')} AS phase4_routed_target_rank,
    CASE WHEN ptg THEN 'phase4_primary_routed_target' WHEN rok THEN 'routed_validation_not_primary_target' ELSE 'not_routed_in_phase4' END AS phase4_interpretation FROM tt)"""


def phase4(t):
    return stage(t, "phase4", lambda: ix.phase4_index(phase2(t).join(t.st_routes, "ibge_municipio_7", "left")))


@case(
    "ix_34_phase4_index",
    f"""WITH {P4_CTES} SELECT ibge_municipio_7, phase4_routed_access_score, telemedicine_phase4_routed_validation, phase4_routed_validation_rank,
        phase4_routed_target_rank, phase4_interpretation FROM p4""",
    "phase4_routed_access_score telemedicine_phase4_routed_validation",
)
def _(t):
    return phase4(t).select(
        "ibge_municipio_7", "phase4_routed_access_score", "telemedicine_phase4_routed_validation",
        "phase4_routed_validation_rank", "phase4_routed_target_rank", "phase4_interpretation",
    )


P5_CTES = f"""{P2_CTES},
xb AS (SELECT p2.*, a.* EXCLUDE (ibge_municipio_7), coalesce(phase5_population_origin_coverage_ratio >= 0.90 AND phase5_distance_coverage_ratio >= 0.95, false)
    AND phase5_weighted_p90_ubs_km IS NOT NULL AND phase5_population_share_pharmacy_le_2km IS NOT NULL AS xok FROM p2 LEFT JOIN st_access a USING (ibge_municipio_7)),
{percentiles('xp', 'xb', 'ibge_municipio_7', {'x1': dict(value='phase5_weighted_p90_ubs_km', valid='xok'),
    'x2': dict(value='phase5_population_share_pharmacy_le_2km', valid='xok'), 'x3': dict(value='phase5_population_share_hard_ubs_easy_pharmacy', valid='xok')})},
xs AS (SELECT *, 100 * {geometric({'x1': 0.45, 'x2': 0.25, 'x3': 0.3})} AS phase5_spatial_precision_mismatch_score, xok AND el5 AS ok5
    FROM (SELECT *, phase2_eligibility = 'eligible_phase2_geodesic_proxy' AS el5 FROM xp) x),
xt AS (SELECT *, CASE WHEN ok5 THEN 100 * {geometric({'(phase2_need_pillar / 100)': 0.45, '(phase5_spatial_precision_mismatch_score / 100)': 0.35, '(phase2_feasibility_pillar / 100)': 0.2})} END AS telemedicine_precision_index FROM xs),
p5 AS (SELECT *, {rank_of('telemedicine_precision_index', 'ok5')} AS phase5_precision_rank,
    CASE WHEN NOT el5 THEN 'phase2_ineligible' WHEN NOT xok THEN 'insufficient_phase5_spatial_precision_data' ELSE 'eligible_phase5_precision' END AS phase5_index_eligibility,
    coalesce(phase5_access_evidence_grade, 'C_incomplete') AS phase5_evidence_grade FROM xt)"""


def precision(t):
    return stage(t, "precision", lambda: ix.precision_index(phase2(t), t.st_access))


P5_COLUMNS = (
    "ibge_municipio_7 phase5_spatial_precision_mismatch_score telemedicine_precision_index phase5_precision_rank "
    "phase5_index_eligibility phase5_evidence_grade"
).split()


@case(
    "ix_42_precision_index",
    f"WITH {P5_CTES} SELECT {', '.join(P5_COLUMNS)} FROM p5",
    "phase5_spatial_precision_mismatch_score telemedicine_precision_index",
)
def _(t):
    return precision(t).select(*P5_COLUMNS)


# ---- decisions -------------------------------------------------------------------------------------

PILLARS = ["phase2_need_pillar", "phase2_spatial_mismatch_score", "phase2_feasibility_pillar", "digital_readiness_score"]
BEST = f"greatest({', '.join(PILLARS)})"
DM_CTES = f"""{P4_CTES},
md AS (SELECT median(digital_readiness_score) AS mid FROM p4 WHERE phase2_eligibility = 'eligible_phase2_geodesic_proxy' AND phase2_rank_balanced IS NOT NULL),
dm AS (SELECT p4.*, CASE WHEN NOT (phase2_eligibility = 'eligible_phase2_geodesic_proxy' AND phase2_rank_balanced IS NOT NULL) THEN 'insufficient_evidence'
      WHEN phase4_interpretation = 'phase4_primary_routed_target' THEN 'pharmacy_assisted_pilot'
      WHEN phase2_spatial_target_rank > 0 THEN 'pharmacy_assisted_geodesic_candidate'
      WHEN phase2_rank_balanced <= 100 AND digital_readiness_score >= mid THEN 'national_priority_high_readiness'
      WHEN phase2_rank_balanced <= 100 AND digital_readiness_score < mid THEN 'national_priority_inclusion_first'
      WHEN phase2_need_pillar >= 75 AND digital_readiness_score < mid THEN 'high_need_digital_inclusion_first'
      WHEN phase2_rank_balanced <= 500 THEN 'regional_scale_opportunity' ELSE 'monitor_or_low_priority' END AS decision_class,
    CASE WHEN {BEST} IS NULL THEN 'dados insuficientes' WHEN phase2_need_pillar = {BEST} THEN 'necessidade' WHEN phase2_spatial_mismatch_score = {BEST} THEN 'barreira espacial'
      WHEN phase2_feasibility_pillar = {BEST} THEN 'viabilidade' ELSE 'prontidão digital' END AS primary_driver,
    CASE WHEN phase4_interpretation = 'phase4_primary_routed_target' THEN 'B_routed_public_osrm_proxy'
      WHEN phase2_rank_balanced IS NOT NULL THEN 'C_geodesic_municipal_proxy' ELSE 'D_incomplete' END AS evidence_grade FROM p4 CROSS JOIN md)"""


def matrix(t):
    named = lambda: phase4(t).withColumn("regiao_nome_oficial", F.col("regiao_nome"))
    return stage(t, "matrix", lambda: dec.decision_matrix(named()))


@case(
    "ix_43_decision_matrix",
    f"""WITH {DM_CTES} SELECT ibge_municipio, decision_class, primary_driver, CASE decision_class
        {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in dec.CLASS_TABLE.items())} END AS decision_label,
        municipio_nome_ibge || '/' || uf_sigla || ': ' || CASE decision_class {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in dec.CLASS_TABLE.items())} END
        || '; ' || CASE WHEN phase2_rank_balanced IS NULL THEN 'sem rank nacional' ELSE 'rank nacional ' || CAST(CAST(phase2_rank_balanced AS BIGINT) AS STRING) END
        || '; principal sinal: ' || primary_driver || '.' AS explanation FROM dm""",
)
def _(t):
    return matrix(t).select("ibge_municipio", "decision_class", "primary_driver", "decision_label", "explanation")


@case("ix_44_evidence_grade", f"WITH {DM_CTES} SELECT ibge_municipio, evidence_grade FROM dm")
def _(t):
    return matrix(t).select("ibge_municipio", "evidence_grade")


WMEAN = "sum({0} * populacao_residente) / nullif(sum(CASE WHEN {0} IS NOT NULL THEN populacao_residente END), 0)"
STATE_CTES = f"""{DM_CTES},
sb AS (SELECT uf_sigla, count(*) AS municipalities, CAST(coalesce(sum(populacao_residente), 0) AS BIGINT) AS population,
    count(telemedicine_phase2_balanced) AS scored, count(*) FILTER (phase2_rank_balanced <= 100) AS top100, count(*) FILTER (phase2_rank_balanced <= 500) AS top500,
    {WMEAN.format('telemedicine_phase2_balanced')} AS w_score, {WMEAN.format('phase2_need_pillar')} AS w_need, {WMEAN.format('digital_readiness_score')} AS w_dig,
    {', '.join(f"count(*) FILTER (decision_class = '{c}') AS {c}_count" for c in dec.DECISION_CLASSES)} FROM dm GROUP BY 1),
sl AS (SELECT greatest(1, max(top100)) AS mt, greatest(1, max(population)) AS mp, median(w_dig) AS mdg FROM sb),
ss AS (SELECT *, 0.35 * coalesce(w_score, 0) + 0.20 * coalesce(w_need, 0) + 0.10 * coalesce(w_dig, 0) + 0.25 * (100e0 * top100 / mt)
    + 0.10 * (100 * sqrt(population / CAST(mp AS DOUBLE))) AS state_opportunity_score,
    high_need_digital_inclusion_first_count + national_priority_inclusion_first_count AS dif FROM sb CROSS JOIN sl),
sr AS (SELECT *, CAST(rank() OVER (ORDER BY state_opportunity_score DESC) AS INT) AS state_rank,
    CASE WHEN pharmacy_assisted_pilot_count > 0 AND top100 > 0 THEN 'hybrid_national_and_pharmacy_pilot' WHEN top100 >= 5 THEN 'national_ads_priority'
      WHEN top100 >= 1 THEN 'selective_city_ads' WHEN dif > 0 OR (w_need >= 45 AND w_dig < mdg) THEN 'digital_inclusion_first'
      WHEN top500 >= 5 OR regional_scale_opportunity_count >= 5 THEN 'regional_experiment'
      WHEN scored / CAST(municipalities AS DOUBLE) < 0.6 OR insufficient_evidence_count >= 10 THEN 'data_quality_first' ELSE 'monitor' END AS state_strategy_tier FROM ss)"""


@case(
    "ix_45_state_summary",
    f"""WITH {STATE_CTES} SELECT uf_sigla, municipalities, population, scored AS scored_municipalities, top100 AS top100_municipalities,
        w_score AS population_weighted_phase2_score, w_need AS population_weighted_need, state_opportunity_score, state_rank, state_strategy_tier,
        dif AS digital_inclusion_first_count, top100 / (population / 1e6) AS top100_per_million_population FROM sr""",
    "population_weighted_phase2_score population_weighted_need state_opportunity_score top100_per_million_population",
)
def _(t):
    return dec.state_summary(matrix(t)).select(
        "uf_sigla", "municipalities", "population", "scored_municipalities", "top100_municipalities", "population_weighted_phase2_score",
        "population_weighted_need", "state_opportunity_score", "state_rank", "state_strategy_tier", "digital_inclusion_first_count",
        "top100_per_million_population",
    )


@case(
    "ag_08_weighted_mean",
    f"WITH {P2_CTES} SELECT uf_sigla, {WMEAN.format('phase2_need_pillar')} AS need FROM p2 GROUP BY 1",
    "need",
)
def _(t):
    from placewise.operators.aggregates import weighted_mean

    return phase2(t).groupBy("uf_sigla").agg(weighted_mean("phase2_need_pillar", "populacao_residente").alias("need"))


@case(
    "ag_14_class_counts",
    f"""WITH {DM_CTES} SELECT uf_sigla, {', '.join(f"count(*) FILTER (decision_class = '{c}') AS {c}_count" for c in dec.DECISION_CLASSES)} FROM dm GROUP BY 1""",
)
def _(t):
    from placewise.operators.aggregates import counts_to_columns

    return counts_to_columns(matrix(t), "uf_sigla", "decision_class", dec.DECISION_CLASSES)


@case(
    "ix_46_output_audit",
    f"""WITH {STATE_CTES.replace(P2_CTES, P5_CTES, 1)} SELECT (SELECT count(*) FROM p2) AS phase2_rows, (SELECT count(telemedicine_phase2_balanced) FROM p2) AS phase2_scored_municipalities,
        (SELECT count(*) FROM p4 WHERE ptg) AS phase4_primary_routed_targets, (SELECT count(*) FROM dm WHERE decision_class = 'pharmacy_assisted_pilot') AS pilot_class_rows,
        (SELECT count(*) FROM sr) AS state_summary_rows, (SELECT CAST(sum(top100) AS BIGINT) FROM sr) AS state_top100_total,
        (SELECT uf_sigla FROM sr ORDER BY state_rank, uf_sigla LIMIT 1) AS top_state,
        (SELECT count(*) FROM p5 WHERE phase5_index_eligibility = 'eligible_phase5_precision') AS phase5_precision_eligible,
        (SELECT sum(top100) FROM sr) = (SELECT count(*) FROM p2 WHERE phase2_rank_balanced <= 100) AS state_top100_agrees""",
)
def _(t):
    m = matrix(t)
    out = dec.output_audit(phase2(t), phase4(t), m, cut(dec.state_summary(m)), precision(t))
    return out.select(
        "phase2_rows", "phase2_scored_municipalities", "phase4_primary_routed_targets", "pilot_class_rows", "state_summary_rows",
        "state_top100_total", "top_state", "phase5_precision_eligible", "state_top100_agrees",
    )


# ---- published layer ---------------------------------------------------------------------------------

LAYER_CTES = DM_CTES.replace(P2_CTES, P5_CTES, 1) + """,
ly AS (SELECT g.ibge_municipio, g.municipio_nome_ibge, g.uf_sigla, g.active_ubs, dm.telemedicine_phase2_balanced, dm.phase2_rank_balanced,
    dm.phase2_spatial_target_rank, dm.hard_ubs_easy_pharmacy_flag, dm.phase4_interpretation, dm.phase4_routed_target_rank, dm.decision_class,
    p5.telemedicine_precision_index, p5.phase5_precision_rank,
    CASE WHEN g.active_ubs_per_100k < 5 AND g.pharmacies > 0 THEN 'consistent_mismatch' ELSE 'no_consistent_mismatch' END AS access_mismatch_flag
    FROM st_gap_base g LEFT JOIN dm USING (ibge_municipio) LEFT JOIN p5 USING (ibge_municipio))"""


def layer(t):
    flag = F.when((F.col("active_ubs_per_100k") < 5) & (F.col("pharmacies") > 0), "consistent_mismatch")
    gap = stage(t, "gap_base", lambda: t.st_gap_base).withColumn("access_mismatch_flag", flag.otherwise("no_consistent_mismatch"))
    return stage(
        t,
        "layer",
        lambda: dec.dashboard_layer(
            gap,
            {
                "phase2": (phase2(t), ["telemedicine_phase2_balanced", "phase2_rank_balanced", "phase2_spatial_target_rank", "hard_ubs_easy_pharmacy_flag"]),
                "phase4": (phase4(t), ["phase4_interpretation", "phase4_routed_target_rank"]),
                "matrix": (matrix(t), ["decision_class"]),
                "precision": (precision(t), ["telemedicine_precision_index", "phase5_precision_rank"]),
                "absent": (None, ["not_built"]),
            },
        ),
    )


@case(
    "ix_50_dashboard_layer",
    f"WITH {LAYER_CTES} SELECT ibge_municipio, telemedicine_phase2_balanced, decision_class, phase4_interpretation, telemedicine_precision_index FROM ly",
    "telemedicine_phase2_balanced telemedicine_precision_index",
)
def _(t):
    return layer(t).select(
        "ibge_municipio", "telemedicine_phase2_balanced", "decision_class", "phase4_interpretation", "telemedicine_precision_index"
    )


VIEW_SQL = {
    "national": "true",
    "phase5": "telemedicine_precision_index IS NOT NULL AND phase5_precision_rank > 0",
    "top100": "phase2_rank_balanced > 0 AND phase2_rank_balanced <= 100",
    "phase4": "phase4_interpretation = 'phase4_primary_routed_target'",
    "phase2": "hard_ubs_easy_pharmacy_flag AND phase2_spatial_target_rank > 0",
    "consistent": "access_mismatch_flag = 'consistent_mismatch'",
    "no_active": "active_ubs = 0",
    "insufficient": "decision_class = 'insufficient_evidence'",
}
SCORED_SQL = "telemedicine_phase2_balanced IS NOT NULL AND phase2_rank_balanced > 0 AND decision_class <> 'insufficient_evidence'"


@case(
    "db_01_named_filters",
    f"WITH {LAYER_CTES} " + " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS n FROM ly WHERE {c}" for v, c in VIEW_SQL.items()),
)
def _(t):
    counted = layer(t).agg(*[F.count_if(c).alias(v) for v, c in dec.views().items()])
    return counted.unpivot([], list(dec.views()), "view", "n")


@case(
    "db_02_headline",
    f"""WITH {LAYER_CTES} SELECT count(*) FILTER ({SCORED_SQL}) AS scored, count(*) FILTER ({VIEW_SQL['top100']}) AS top100,
        count(*) FILTER ({VIEW_SQL['insufficient']}) AS under_review, count(*) FILTER ({VIEW_SQL['phase4']}) AS pilots FROM ly""",
)
def _(t):
    return dec.headline(layer(t))


@case(
    "db_03_ranked_tables",
    f"""WITH {LAYER_CTES} (SELECT 'phase4' AS view, ibge_municipio FROM ly WHERE {VIEW_SQL['phase4']})
      UNION ALL (SELECT 'phase5', ibge_municipio FROM ly WHERE {VIEW_SQL['phase5']} ORDER BY phase5_precision_rank, ibge_municipio LIMIT 50)
      UNION ALL (SELECT 'national', ibge_municipio FROM ly WHERE {SCORED_SQL} ORDER BY phase2_rank_balanced, ibge_municipio LIMIT 30)
      UNION ALL (SELECT 'insufficient', ibge_municipio FROM ly WHERE {VIEW_SQL['insufficient']} ORDER BY uf_sigla, municipio_nome_ibge, ibge_municipio LIMIT 100)""",
)
def _(t):
    rows = layer(t)
    out = None
    for view in ("phase4", "phase5", "national", "insufficient"):
        one = dec.ranked_table(rows, view).select(F.lit(view).alias("view"), "ibge_municipio")
        out = one if out is None else out.union(one)
    return out


@case(
    "db_04_score_bands",
    f"""WITH {P2_CTES} SELECT CASE WHEN telemedicine_phase2_balanced >= 80 THEN '80+' WHEN telemedicine_phase2_balanced >= 70 THEN '70-80'
        WHEN telemedicine_phase2_balanced >= 60 THEN '60-70' ELSE 'below 60' END AS band, count(*) AS n FROM p2 GROUP BY 1""",
)
def _(t):
    return phase2(t).groupBy(dec.score_band("telemedicine_phase2_balanced").alias("band")).agg(F.count(F.lit(1)).alias("n"))
