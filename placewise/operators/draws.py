"""Rank uncertainty under random weights.

Draws come from hashed uniforms, so a weight depends only on (seed, draw, slot): any
executor can recompute any draw, and the result is the same for one seed. All Dirichlet
parameters are whole numbers, so a Gamma(k) is the sum of k values of -ln(u).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.functions.columns import clip
from placewise.operators.ordering import with_range
from placewise.operators.scoring import EPSILON

DEFAULT_SEED = 20260712
DEFAULT_DRAWS = 1000


def hashed_uniform(seed: int, draw: Column, slot: str, j: int) -> Column:
    """Uniform in (0, 1] from 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.lit(slot), F.lit(str(j)))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 1.0) / F.lit(float(2**52))


def dirichlet(seed: int, draw: Column, slot: str, alphas: Sequence[int]) -> list[Column]:
    gammas = []
    for i, k in enumerate(alphas):
        parts = [-F.ln(hashed_uniform(seed, draw, f"{slot}{i}", j)) for j in range(k)]
        gammas.append(sum(parts[1:], parts[0]))
    whole = sum(gammas[1:], gammas[0])
    return [g / whole for g in gammas]


def uniform(seed: int, draw: Column, slot: str, low: float, high: float) -> Column:
    return F.lit(low) + hashed_uniform(seed, draw, slot, 0) * F.lit(high - low)


def draw_table(
    spark: SparkSession,
    draws: int,
    seed: int,
    weight_groups: Mapping[str, Sequence[int]],
    shares: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """One row per draw: ``<group>_w<i>`` per Dirichlet group and one column per uniform share."""
    draw = F.col("draw")
    cols = {}
    for group, alphas in weight_groups.items():
        for i, w in enumerate(dirichlet(seed, draw, group, alphas)):
            cols[f"{group}_w{i}"] = w
    for name, (low, high) in (shares or {}).items():
        cols[name] = uniform(seed, draw, name, low, high)
    return spark.range(draws).select(F.col("id").cast("int").alias("draw")).withColumns(cols)


def geometric_draw(components: Sequence[str], group: str) -> Column:
    """exp(sum w * ln x) with the weights of one draw."""
    logs = [F.ln(clip(c, EPSILON, 1.0)) * F.col(f"{group}_w{i}") for i, c in enumerate(components)]
    return F.exp(sum(logs[1:], logs[0]))


def ranks_in_draws(scored: DataFrame, ranges: int | None = None) -> DataFrame:
    """``scored`` (draw, value and any more) with ``rank``, from the largest value of the draw down, ties sharing their
    mean, and ``total``, the values of the draw. Rows without a value go.

    First the rows of each draw are counted in ranges of values, which needs no row to travel. Then all rows go once
    to the task of their draw and range, where they are ranked with whatever columns they have, and the counts of the
    lower ranges are added.
    """
    placed = with_range(scored.filter(F.col("value").isNotNull()), "value", ranges)
    counts = placed.groupBy("draw", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy("draw").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("draw", "_bucket", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy("draw")).alias("total"))
    own = Window.partitionBy("draw", "_bucket").orderBy("value")
    ties = Window.partitionBy("draw", "_bucket", "value")
    ranked = placed.withColumn("_rank", F.rank().over(own)).withColumn("_ties", F.count(F.lit(1)).over(ties))
    from_below = F.col("_below") + F.col("_rank") + (F.col("_ties") - 1) / F.lit(2.0)
    joined = ranked.join(counts.hint("merge"), ["draw", "_bucket"])
    return joined.select(*scored.columns, (F.col("total") + 1 - from_below).alias("rank"), "total")


def simulate(
    subset: DataFrame,
    key: str,
    table: DataFrame,
    score: Column,
    prefix: str,
    score_band: bool,
    draws: int,
) -> DataFrame:
    """Median and band of score and rank per row, and the chance of the top decile.

    The draw table has ``draws`` rows, a fixed small number, and is broadcast; the rows x draws travel twice, to be
    ranked inside each draw and to be gathered by row. The per-row statistics see ``draws`` values each.
    """
    scored = subset.crossJoin(F.broadcast(table)).select(key, "draw", score.alias("value"))
    ranked = ranks_in_draws(scored)
    inside = F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("total") * 0.10))
    aggs = [
        F.percentile("value", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("_s"),
        F.percentile("rank", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("_r"),
        F.avg(inside.cast("double")).alias(f"{prefix}probability_top_decile"),
    ]
    out = ranked.groupBy(key).agg(*aggs)
    names = [(f"{prefix}score_median", "_s", 0)]
    if score_band:
        names += [(f"{prefix}score_p05", "_s", 1), (f"{prefix}score_p95", "_s", 2)]
    names += [(f"{prefix}rank_median", "_r", 0), (f"{prefix}rank_p05", "_r", 1), (f"{prefix}rank_p95", "_r", 2)]
    return out.select(key, *[F.col(a)[i].alias(n) for n, a, i in names], f"{prefix}probability_top_decile")
