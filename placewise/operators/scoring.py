"""Composite scores from percentile components."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import clip, col
from placewise.operators.ordering import competition_ranks, percentile_ranks, winsorized_percentiles

EPSILON = 1e-6


def weighted_geometric(components: Mapping[str, Column | str], weights: Mapping[str, float]) -> Column:
    """exp(sum of w * ln x) with every component held in [1e-6, 1]; null when any component is null."""
    logs = [F.ln(clip(components[name], EPSILON, 1.0)) * F.lit(float(w)) for name, w in weights.items()]
    return F.exp(sum(logs[1:], logs[0]))


def weighted_linear(weights: Mapping[str, float], scale: float = 100.0) -> Column:
    """Weighted sum of the named columns, times the scale; null propagates."""
    terms = [F.col(name) * F.lit(float(w)) for name, w in weights.items()]
    return sum(terms[1:], terms[0]) * F.lit(scale)


class Component:
    """One percentile component: which value, over which rows, and how it is ranked."""

    def __init__(self, value, valid, *, inverse=False, log=False, structural_zero=False, missing=None):
        self.value, self.valid = col(value).cast("double"), valid
        self.inverse, self.log, self.structural_zero, self.missing = inverse, log, structural_zero, missing

    def sample(self) -> Column:
        keep = self.valid & (self.value > 0) if self.structural_zero else self.valid
        v = F.log1p(clip(self.value, 0.0)) if self.log else self.value
        return F.when(keep, v)

    def finish(self, ranked: Column) -> Column:
        out = ranked
        if self.structural_zero:
            out = F.when(self.valid & (self.value <= 0), F.lit(0.0)).otherwise(out)
        return out if self.missing is None else F.coalesce(out, F.lit(self.missing))


def add_percentiles(df: DataFrame, key: str, specs: Mapping[str, Component], winsorize: bool = True) -> DataFrame:
    """Percentile components as columns, all ordered in one pass.

    With ``structural_zero`` values at or below zero get 0 and leave the sample before
    quantiles and ranks are taken.
    """
    samples = {name: s.sample() for name, s in specs.items()}
    down = [name for name, s in specs.items() if s.inverse]
    rank = winsorized_percentiles if winsorize else percentile_ranks
    ranked = rank(df, [key], samples, descending=down)
    return ranked.withColumns({name: s.finish(F.col(name)) for name, s in specs.items()})


def add_scenarios(
    df: DataFrame,
    key: str,
    components: Mapping[str, Column],
    scenarios: Mapping[str, Mapping[str, float]],
    *,
    score_prefix: str,
    rank_prefix: str,
    zero: Column,
    scored: Column,
    eligible: Column,
    extra_ranks: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Score, rank among eligible rows, and best / worst / range of the ranks per scenario.

    ``zero`` rows score 0, rows outside ``scored`` score null. ``extra_ranks`` maps a new
    rank column to (score column, mask).
    """
    scores = {}
    for name, weights in scenarios.items():
        raw = weighted_geometric(components, weights) * 100
        scores[f"{score_prefix}{name}"] = F.when(scored, F.when(zero, 0.0).otherwise(raw))
    out = df.withColumns(scores)
    ranks = {f"{rank_prefix}rank_{n}": F.when(eligible, F.col(f"{score_prefix}{n}")) for n in scenarios}
    for name, (score, mask) in (extra_ranks or {}).items():
        ranks[name] = F.when(mask, F.col(score))
    out = competition_ranks(out, [key], ranks)
    names = [f"{rank_prefix}rank_{n}" for n in scenarios]
    return out.withColumns(
        {
            f"{rank_prefix}rank_best": F.least(*names),
            f"{rank_prefix}rank_worst": F.greatest(*names),
            f"{rank_prefix}rank_range": F.greatest(*names) - F.least(*names),
        }
    )
