"""Aggregate expressions and grouped reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.columns import ratio


def total(c: Column | str) -> Column:
    """Sum where nothing to add is zero."""
    return F.coalesce(F.sum(c), F.lit(0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean over rows with a known value and a positive weight."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def share_of(weight: Column, condition: Column, valid: Column) -> Column:
    """Weight of the rows meeting the condition over the weight of the valid rows."""
    covered = F.sum(F.when(valid, weight))
    return F.try_divide(
        F.coalesce(F.sum(F.when(valid & condition, weight)), F.lit(0.0)), F.nullif(covered, F.lit(0.0))
    )


def known_share(c: Column | str) -> Column:
    """Percent of rows where the column is known."""
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(c.isNotNull().cast("double")) * 100


def any_known(c: str) -> Column:
    return F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False))


def joined_values(df: DataFrame, keys: Sequence[str], c: Column, name: str, sep: str = "|") -> DataFrame:
    """Sorted distinct values per group as one text. Duplicates go before any list is built."""
    pairs = df.select(*keys, c.cast("string").alias("_v")).distinct()
    return pairs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(name))


def counts_to_columns(df: DataFrame, key: str, c: str, values: Sequence[str], suffix: str = "_count") -> DataFrame:
    """One count column per listed value; a value a group lacks counts as zero."""
    return df.groupBy(key).agg(*[F.count_if(F.col(c) == v).alias(f"{v}{suffix}") for v in values])


def first_known_pivot(
    df: DataFrame, key: str, c: str, values: Sequence[str], measures: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Columns ``<value>_<measure>`` with the first known measure per group and value, under an explicit order."""
    aggs = []
    for v in values:
        for m in measures:
            ranked = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(m).alias("v"))
            seen = F.when((F.col(c) == v) & F.col(m).isNotNull(), ranked)
            aggs.append(F.min(seen)["v"].alias(f"{v}_{m}"))
    return df.groupBy(key).agg(*aggs)


def share_of_all(df: DataFrame, keys: Sequence[str], count_name: str, share_name: str = "percentage") -> DataFrame:
    """Row count per group and its percent of all rows. The total is one row, taken from the grouped frame."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    whole = counted.agg(F.sum(count_name).alias("_all"))
    return (
        counted.crossJoin(F.broadcast(whole))
        .withColumn(share_name, F.col(count_name) / F.col("_all") * 100)
        .drop("_all")
    )


def metric_rows(one_row: DataFrame, metrics: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One-row aggregate to long rows (metric, value, percentage)."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(v).cast("double").alias("value"),
            (F.lit(None) if p is None else F.col(p)).cast("double").alias("percentage"),
        )
        for name, (v, p) in metrics.items()
    ]
    return one_row.select(F.inline(F.array(*rows)))


def conflicts(df: DataFrame, keys: Sequence[str], c: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose values of one column differ by more than the tolerance."""
    return (
        df.groupBy(*keys)
        .agg((F.max(c) - F.min(c)).alias("spread"))
        .filter(F.col("spread") > tolerance)
    )


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One-row aggregates next to each other."""
    out = one_row_frames[0]
    for df in one_row_frames[1:]:
        out = out.crossJoin(F.broadcast(df))
    return out


def table_quality(df: DataFrame, target: str, zero_columns: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, target rate, null cells, repeated rows, zeros per named column."""
    cols = df.columns
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in cols), F.lit(0))
    # identical rows collapse before anything is summed
    distinct = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    return distinct.agg(
        F.sum(n).alias("rows"),
        F.lit(len(cols)).alias("columns"),
        (F.sum(F.col(target) * n) / F.sum(F.when(F.col(target).isNotNull(), n))).alias("target_rate"),
        total(nulls * n).alias("missing_cells"),
        F.sum(n - 1).alias("duplicates"),
        *[total(F.when(F.col(c) == 0, n)).alias(f"zero_{c}") for c in zero_columns],
    )


def repeated_pairs(df: DataFrame, pair: Sequence[str], keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Rows per key group, and how many of them share their pair with another row; null pairs are equal.

    Works on rows already collapsed to (pair, keys, flags), so the null pair, which may
    hold a third of the table, is a handful of rows.
    """
    collapsed = df.groupBy(*pair, *keys, *[f.alias(n) for n, f in flags.items()]).agg(F.count(F.lit(1)).alias("_n"))
    copies = F.sum("_n").over(Window.partitionBy(*pair))
    return collapsed.withColumn("repeated", copies > 1)


def rate_by(df: DataFrame, by: str, target: str) -> DataFrame:
    """Records and target rate per category."""
    rate = F.avg(F.col(target).cast("double"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("records"), rate.alias("rate")).withColumn(
        "rate_pct", F.round(F.col("rate") * 100, 1)
    )


def ratio_of_sums(x: str, d: str, scale: float = 100.0) -> Column:
    return ratio(F.sum(x), F.sum(d), scale)
