"""Join patterns beyond a plain ``DataFrame.join``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.functions.columns import in_box


def unique(df: DataFrame, keys: Sequence[str] | str, what: str = "right side") -> DataFrame:
    """The same rows, failing at run time if a key occurs twice.

    The check is part of the plan (one partial aggregate on the key), so it costs no
    separate job and the later join reuses its partitioning.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    message = F.concat(F.lit(f"Duplicate key in {what}: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    safe = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_row"))
    return grouped.withColumn("_row", safe).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def left_unique(left: DataFrame, right: DataFrame, on: Sequence[str] | str, what: str = "right side") -> DataFrame:
    """Left join that may not multiply rows."""
    on = [on] if isinstance(on, str) else list(on)
    return left.join(unique(right, on, what), on, "left")


def first_per_key(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column]) -> DataFrame:
    """First whole row per key under a total order.

    An aggregate with map-side combine instead of a window: a key with a third of the
    rows sends one row per task. Pass descending numeric columns negated.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    packed = F.min(F.struct(rank.alias("o"), F.struct(*rest).alias("r")))
    return df.groupBy(*keys).agg(packed.alias("_p")).select(*keys, *[F.col("_p.r")[c].alias(c) for c in rest])


def conform(universe: DataFrame, source: DataFrame, key: str, repeats: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keep every row of the universe, tag the unmatched, and split off unknown source codes.

    Columns found on both sides are taken from the universe. A code found twice in the source fails, or with
    ``repeats`` gives a row for each of its source rows.
    """
    shared = [c for c in source.columns if c in universe.columns and c != key]
    official = universe.groupBy(key).agg(F.min(F.struct(*[c for c in universe.columns if c != key])).alias("_u"))
    official = official.select(key, "_u.*")
    invalid = source.join(official.select(key), key, "left_anti")
    present = source.drop(*shared).withColumn("source_row_present", F.lit(True))
    present = present if repeats else unique(present, key, "source")
    found = F.coalesce("source_row_present", F.lit(False))
    matched = (
        official.join(present, key, "left")
        .withColumn("source_row_present", found)
        .withColumn(
            "universe_status",
            F.when(F.col("source_row_present"), "matched_source").otherwise("missing_source_record"),
        )
    )
    return matched, invalid


def fill_from(df: DataFrame, target: str, other: str) -> DataFrame:
    """Nulls of ``target`` (or the whole column, when absent) come from ``other``."""
    value = F.coalesce(F.col(target), F.col(other)) if target in df.columns else F.col(other)
    return df.withColumn(target, value)


def enrich(base: DataFrame, sources: Sequence[tuple[DataFrame | None, Sequence[str]]], key: str) -> DataFrame:
    """Left-join several sources on one key: existing columns only, one row per key, absent sources skipped."""
    out = base
    for df, wanted in sources:
        if df is None:
            continue
        have = [c for c in wanted if c in df.columns]
        picked = df.select(key, *have)
        if have:
            picked = picked.groupBy(key).agg(F.min(F.struct(*have)).alias("_r")).select(key, "_r.*")
        else:
            picked = picked.distinct()
        out = out.join(picked, key, "left")
    return out


def code_or_name_join(base: DataFrame, lookup: DataFrame, code: str, names: Sequence[str]) -> DataFrame:
    """Join on the code when the lookup has it, else on the name columns; overlaps stay with the base."""
    on = [code] if code in lookup.columns else list(names)
    overlap = [c for c in lookup.columns if c in base.columns and c not in on]
    return base.join(lookup.drop(*overlap), on, "left")


def two_roles(base: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], attrs: Sequence[str]) -> DataFrame:
    """Join one dimension once per role. ``roles`` maps a name prefix to the key column of the base."""
    out = base
    for prefix, fk in roles.items():
        named = dim.select(F.col(key).alias(fk), *[F.col(a).alias(f"{prefix}_{a}") for a in attrs])
        out = out.join(named, fk, "left")
    return out


def resolved_share(edges: DataFrame, target: str, known: DataFrame, key: str) -> DataFrame:
    """Percent of edge targets found among the known ids.

    Edges collapse to (target, count) before the join, so a target that takes a third
    of all edges is one row.
    """
    per_target = edges.groupBy(F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    ids = known.select(F.col(key).alias("_t"), F.lit(1).alias("_hit")).distinct()
    hit = F.when(F.col("_hit").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    return per_target.join(ids, "_t", "left").agg(
        (F.try_divide(F.sum(hit).cast("double"), F.sum("_n")) * 100).alias("coverage_pct")
    )


DECLARED_STATUSES = [
    "inside_declared_municipality",
    "outside_declared_municipality",
    "missing_coordinates",
    "outside_brazil_bbox",
    "missing_municipal_polygon",
]


def check_declared_polygon(points: DataFrame, polygons: DataFrame, code: str) -> DataFrame:
    """Status of each point against the polygon of its own declared place.

    ``points`` has ``code``, ``latitude``, ``longitude``; ``polygons`` has ``code``,
    ``coordinates`` (multipolygon) and ``bbox``. One equi-join; the ring test runs only
    for points in the national box and in the polygon's box.
    """
    shapes = unique(polygons.select(code, "coordinates", "bbox"), code, "polygons")
    lat, lon = F.col("latitude"), F.col("longitude")
    inside, outside, missing, out_of_box, no_shape = DECLARED_STATUSES
    status = (
        F.when(lat.isNull() | lon.isNull(), missing)
        .when(~in_box(lat, lon), out_of_box)
        .when(F.col("coordinates").isNull(), no_shape)
        .when(geo.in_multipolygon(lon, lat, F.col("coordinates"), F.col("bbox")), inside)
        .otherwise(outside)
    )
    return points.join(shapes, code, "left").withColumn("spatial_validation_status", status).drop("coordinates", "bbox")
