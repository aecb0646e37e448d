"""Exact ranks and quantiles without a one-task sort.

A window without a partition key, or one over a group that holds a third of the
rows, sorts that group in a single task. Here the work is spread by value:

1. rows collapse to (keys, value, weight) with map-side combine, so copies of one
   value never travel;
2. a sample of values, picked by hash and therefore the same on every run, gives
   split points per measure, as many as ranges are asked for;
3. running totals are taken inside (keys, bucket), and the totals of the earlier
   buckets of the same keys are added.

The hash-picked sample is what keeps the result stable when a lost executor makes
Spark recompute a branch: splits never depend on timing or partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled values for each range.
PER_RANGE = 4


def _halved(splits: Column, most: int, value: Column) -> Column:
    """Number of ascending splits <= value, by halving; there are ``most`` splits at most."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= F.size(splits)) & (F.get(splits, at + s - 1) <= value), at + s).otherwise(at),
    )


def _with_bucket(freq: DataFrame, value: str, ranges: int) -> DataFrame:
    """``freq`` (with _family) and the number of the range that its value lies in.

    About PER_RANGE values for each range are picked by hash out of all distinct values of a family, so the same ones
    on every run and whatever task computes them, and every PER_RANGE-th is a split. A value first finds its
    stretch of about sqrt(ranges) splits, then its place in it, so that a row meets two short arrays however many ranges
    there are. Both tables have a row for each family, or stretch of one, and are broadcast.
    """
    wide = max(2, round(ranges**0.5))
    share = F.lit(float(PER_RANGE * ranges)) / F.col("_n")
    sizes = freq.groupBy("_family").agg(F.count(F.lit(1)).alias("_n"))
    picked = freq.join(F.broadcast(sizes), "_family").filter(F.pmod(F.xxhash64(value), F.lit(1 << 40)) < share * float(1 << 40))
    every = picked.groupBy("_family").agg(F.array_sort(F.collect_list(value)).alias("_s"))
    every = every.select("_family", F.filter("_s", lambda _, i: i % PER_RANGE == PER_RANGE - 1).alias("_s"))
    coarse = every.select("_family", F.filter("_s", lambda _, i: i % wide == wide - 1).alias("_coarse"))
    at = F.explode(F.sequence(F.lit(0), F.floor(F.size("_s") / wide).cast("int"))).alias("_stretch")
    fine = every.select("_family", "_s", at).select("_family", "_stretch", F.slice("_s", F.col("_stretch") * wide + 1, F.lit(wide - 1)).alias("_fine"))
    # a sample is larger than expected by a few hundredths at most; more than twice would need a broken hash
    most = 2 * ranges // wide + wide
    found = freq.join(F.broadcast(coarse), "_family", "left").withColumn("_stretch", F.coalesce(_halved(F.col("_coarse"), most, F.col(value)), F.lit(0))).drop("_coarse")
    found = found.join(F.broadcast(fine), ["_family", "_stretch"], "left")
    return found.withColumn("_bucket", F.col("_stretch") * wide + F.coalesce(_halved(F.col("_fine"), wide, F.col(value)), F.lit(0))).drop("_stretch", "_fine")


def with_range(rows: DataFrame, value: str = "value", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``_bucket``, the number of the range of values that theirs lies in; null isn't allowed."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _with_bucket(rows.withColumn("_family", F.lit(0)), value, ranges).drop("_family")


def cumulative(
    rows: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    weight: Column | None = None,
    measure: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Distinct values per key group with their running totals, taken over ``ranges`` ranges of values (as many as
    the session has shuffle partitions).

    Result: ``keys, value, weight, before, total`` where ``before`` is the weight of
    all smaller values of the group and ``total`` the weight of the group. ``measure``
    names a column of ``keys`` with few distinct values whose scales differ; split
    points are then taken per measure.
    """
    keys = list(keys)
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    known = rows.filter(F.col(value).isNotNull())
    freq = known.groupBy(*keys, value).agg(w.alias("weight"))

    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _with_bucket(freq.withColumn("_family", F.col(measure) if measure else F.lit(0)), value, ranges).drop("_family")
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.sum("weight").alias("_sum"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_sum").over(whole).alias("total"),
        )
    )
    running = placed.withColumn("_run", F.coalesce(F.sum("weight").over(in_bucket), F.lit(0)))
    return running.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, "weight", (F.col("_run") + F.col("_offset")).alias("before"), "total"
    )


def _melt(df: DataFrame, ids: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Wide to long: ids, measure, value; null values dropped."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in measures.items()]
    )
    return (
        df.select(*ids, F.explode(F.filter(pairs, lambda s: s["value"].isNotNull())).alias("_p"))
        .select(*ids, "_p.measure", "_p.value")
    )


def _spread(scored: DataFrame, ids: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    """Long to wide, one column per measure."""
    return scored.groupBy(*ids).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(value))).alias(m) for m in names]
    )


def _interpolated(prob: float) -> Column:
    """Value at a linear-interpolated quantile, as an aggregate over ``cumulative`` rows."""
    at = F.lit(float(prob)) * (F.col("total") - 1)
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("weight"))
    low = F.max(F.when(holds(F.floor(at)), F.col("value")))
    high = F.max(F.when(holds(F.ceil(at)), F.col("value")))
    return low + (high - low) * F.max(at - F.floor(at))


def quantiles(
    df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[Column, float]]
) -> DataFrame:
    """Exact quantiles: one output column per ``name: (column, probability)``.

    With no keys the result has one row. Groups whose values are all null give null.
    """
    keys = list(keys)
    sources: list[Column] = []
    names: dict[str, str] = {}
    for name, (c, _) in measures.items():
        known = next((i for i, s in enumerate(sources) if s is c), None)
        if known is None:
            known = len(sources)
            sources.append(c)
        names[name] = f"m{known}"
    long = _melt(df, keys, {f"m{i}": c for i, c in enumerate(sources)})
    pos = cumulative(long, [*keys, "measure"], measure="measure")
    per = pos.groupBy(*keys, "measure").agg(
        *[_interpolated(p).alias(name) for name, (_, p) in measures.items()]
    )
    return per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == names[name], F.col(name))).alias(name) for name in measures]
    )


def medians(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    return quantiles(df, keys, {name: (c, 0.5) for name, c in measures.items()})


def weighted_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, weight: Column, probs: dict[str, float]
) -> DataFrame:
    """Smallest value whose cumulative weight reaches q times the total; null values and weights <= 0 ignored."""
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("value"), weight.cast("double").alias("_w"))
    pos = cumulative(rows.filter(F.col("_w") > 0), keys, weight=F.col("_w"))
    reached = F.col("before") + F.col("weight")
    return pos.groupBy(*keys).agg(
        *[F.min(F.when(reached >= F.lit(q) * F.col("total"), F.col("value"))).alias(n) for n, q in probs.items()]
    )


def _scored(df: DataFrame, key: Sequence[str], measures: dict[str, Column], by: Sequence[str], rank) -> DataFrame:
    long = _melt(df, [*key, *by], measures)
    pos = cumulative(long, [*by, "measure"], measure="measure")
    return long.join(rank(pos), [*by, "measure", "value"])


AVERAGE_RANK = "before + (weight + 1) / 2.0D"


def percentile_ranks(
    df: DataFrame,
    key: Sequence[str],
    specs: dict[str, Column],
    descending: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds one column per spec: average-tie rank / number of known values. Null stays null.

    ``key`` identifies a row; ``by`` ranks inside groups.
    """
    key, by = list(key), list(by)
    average = F.expr(AVERAGE_RANK)
    share = F.when(F.col("measure").isin(list(descending) or [""]), F.col("total") + 1 - average).otherwise(average)
    scored = _scored(
        df, key, specs, by, lambda p: p.select(*by, "measure", "value", (share / F.col("total")).alias("_r"))
    )
    return df.join(_spread(scored, key, list(specs), "_r"), key, "left")


def competition_ranks(
    df: DataFrame,
    key: Sequence[str],
    specs: dict[str, Column],
    by: Sequence[str] = (),
    average: bool = False,
) -> DataFrame:
    """Adds one column per spec: rank from the largest value down, ties share the best rank.

    ``average=True`` gives tied values their mean rank instead. Null stays null, so a
    rank inside a subset is the rank of a value masked outside the subset.
    """
    key, by = list(key), list(by)
    best = F.expr("total - before - weight + 1").cast("double")
    mean = F.expr(f"total + 1 - ({AVERAGE_RANK})")
    scored = _scored(
        df, key, specs, by, lambda p: p.select(*by, "measure", "value", (mean if average else best).alias("_r"))
    )
    return df.join(_spread(scored, key, list(specs), "_r"), key, "left")


def winsorized_percentiles(
    df: DataFrame,
    key: Sequence[str],
    specs: dict[str, Column],
    descending: Sequence[str] = (),
    low: float = 0.01,
    high: float = 0.99,
) -> DataFrame:
    """Percentile ranks after clipping every measure to its own [low, high] quantiles.

    One ordering pass serves both steps: the clipped tails are ties whose size is the
    cumulative count at the cut, so nothing is sorted twice.
    """
    key = list(key)

    def rank(pos: DataFrame) -> DataFrame:
        def at(prob: float, f) -> Column:
            return f(F.lit(prob) * (F.col("total") - 1))

        def pick(i: Column, what: Column) -> Column:
            holds = (F.col("before") <= i) & (i < F.col("before") + F.col("weight"))
            return F.max(F.when(holds, what))

        upto, start, v = F.col("before") + F.col("weight"), F.col("before"), F.col("value")
        cuts = pos.groupBy("measure").agg(
            pick(at(low, F.floor), v).alias("l0"),
            pick(at(low, F.ceil), v).alias("l1"),
            pick(at(low, F.floor), upto).alias("l0_upto"),
            pick(at(low, F.ceil), upto).alias("l1_upto"),
            F.max(at(low, lambda h: h - F.floor(h))).alias("lf"),
            pick(at(high, F.floor), v).alias("h0"),
            pick(at(high, F.ceil), v).alias("h1"),
            pick(at(high, F.floor), start).alias("h0_before"),
            pick(at(high, F.ceil), start).alias("h1_before"),
            F.max(at(high, lambda h: h - F.floor(h))).alias("hf"),
        ).select(
            "measure",
            F.expr("l0 + (l1 - l0) * lf").alias("cut_low"),
            F.expr("IF(l0 + (l1 - l0) * lf >= l1, l1_upto, l0_upto)").alias("n_low"),
            F.expr("h0 + (h1 - h0) * hf").alias("cut_high"),
            F.expr("IF(h0 + (h1 - h0) * hf <= h0, h0_before, h1_before)").alias("before_high"),
        )
        average = F.expr(
            "CASE WHEN value <= cut_low THEN (n_low + 1) / 2.0D "
            "WHEN value >= cut_high THEN before_high + (total - before_high + 1) / 2.0D "
            f"ELSE {AVERAGE_RANK} END"
        )
        flipped = F.when(
            F.col("measure").isin(list(descending) or [""]), F.col("total") + 1 - average
        ).otherwise(average)
        # cuts: one row per measure
        return pos.join(F.broadcast(cuts), "measure").select(
            "measure", "value", (flipped / F.col("total")).alias("_r")
        )

    scored = _scored(df, key, specs, [], rank)
    return df.join(_spread(scored, key, list(specs), "_r"), key, "left")


# ---- small frames ----------------------------------------------------------


def small_percentile_rank(c: Column | str, descending: bool = False) -> Column:
    """Average-tie percentile rank by a plain window, for frames of bounded size (states, regions)."""
    c = F.col(c) if isinstance(c, str) else c
    order = c.desc() if descending else c.asc()
    known = Window.partitionBy(c.isNull()).orderBy(order)
    ties = Window.partitionBy(c)
    rank = F.rank().over(known) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return F.when(c.isNotNull(), rank / F.count(c).over(Window.partitionBy(c.isNull())))


def small_rank_desc(c: Column | str) -> Column:
    """Competition rank, largest first, by a plain window, for frames of bounded size."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.rank().over(Window.partitionBy(c.isNull()).orderBy(c.desc())).cast("double"))
