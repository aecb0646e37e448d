"""Nearest-facility join: exact, without a cross join, whatever the density.

Facilities of all kinds form one table of square cells, the kind in the key, whose side shrinks by four per level. A
cell with more than ``LEAF_CAPACITY`` points is open; where none is open any more, a cell is a leaf. So a city with a
third of all facilities is split further than the countryside, and an origin never meets more than a few leaves.

A search has two rounds. In the first, an origin takes the nearest point of the leaf that it lies in, and is done if
the disc of that distance stays inside the leaf. In the second, the others open the cells that their disc touches, down to
leaves. All steps are equi-joins on the cell.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import half_chord_sq
from placewise.runtime import stored

RADIUS_KM = 6371.0088
ROOT_SIDE = 64.0
MAX_LEVEL = 12
LEAF_CAPACITY = 32
COARSE = 2  # levels 0..2 have at most 18 * (1 + 16 + 256) cells of a kind on the whole globe
CELL = ["kind", "level", "x", "y"]
SLACK = 1.0 + 1e-9


def _scale(level: Column) -> Column:
    # an exact power of two, by a shift
    return F.call_function("shiftleft", F.lit(1).cast("long"), (level * 2).cast("int")).cast("double") / F.lit(ROOT_SIDE)


def _index(degrees: Column, offset: float, level: Column) -> Column:
    return F.floor((degrees + F.lit(offset)) * _scale(level)).cast("long")


def _on_levels(points: DataFrame, deepest: int = MAX_LEVEL) -> DataFrame:
    """One row per point and level with the cell it lies in."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest)))
    return (
        points.withColumn("level", levels)
        .withColumn("x", _index(F.col("lon"), 180.0, F.col("level")))
        .withColumn("y", _index(F.col("lat"), 90.0, F.col("level")))
    )


def _probe(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Equi-join on the cell. The few coarse cells are broadcast: every row would share their keys."""
    coarse = rows.filter(F.col("level") <= COARSE).join(F.broadcast(cells.filter(F.col("level") <= COARSE)), CELL)
    fine = rows.filter(F.col("level") > COARSE).join(cells.filter(F.col("level") > COARSE), CELL)
    return coarse.unionByName(fine)


BOX = ["south", "north", "west", "east", "lean"]


def _box() -> list[Column]:
    """The edges of a cell in degrees, and the least cosine of a latitude on them."""
    side = F.lit(1.0) / _scale(F.col("level"))
    south, west = F.col("y") * side - 90.0, F.col("x") * side - 180.0
    lean = F.greatest(F.lit(0.0), F.least(F.cos(F.radians(south)), F.cos(F.radians(south + side))))
    return [c.alias(n) for c, n in zip((south, south + side, west, west + side, lean), BOX, strict=True)]


def _touched(of: str = "") -> Column:
    """Whether the disc of the bound reaches the cell whose box is in the columns of that prefix. The lower bound of the
    squared half chord is a short expression on purpose: a filter evaluates all that stands in it."""
    south, north, west, east, lean = (F.col(of + c) for c in BOX)
    lat, lon = F.col("olat"), F.col("olon")
    high = F.greatest(F.lit(0.0), south - lat, lat - north)
    wide = F.least(*[F.greatest(F.lit(0.0), west - lon - turn, lon + turn - east) for turn in (0.0, 360.0, -360.0)])
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    return half(high) + F.cos(F.radians(lat)) * lean * half(wide) <= F.col("bound") * SLACK + 1e-18


def _to(lat: str, lon: str) -> Column:
    return half_chord_sq(F.col("olat"), F.col("olon"), F.col(lat), F.col(lon))


def _unit(lat: str, lon: str, prefix: str) -> list[Column]:
    """Unit-sphere coordinates, so that a pair costs three subtractions instead of trigonometry."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    return [
        (F.cos(phi) * F.cos(lam)).alias(f"{prefix}x"),
        (F.cos(phi) * F.sin(lam)).alias(f"{prefix}y"),
        F.sin(phi).alias(f"{prefix}z"),
    ]


def _disc(bound: str = "bound") -> tuple[Column, Column]:
    """Half the height and half the width, in degrees, of the disc of the bound around each origin."""
    rho = F.asin(F.sqrt(F.least(F.lit(1.0), F.col(bound)))) * 2
    high = F.degrees(rho) * SLACK + 1e-9
    lean = F.sin(rho) / F.cos(F.radians(F.col("olat")))
    all_round = (F.abs(F.col("olat")) + high >= 89.0) | (rho >= 1.5)
    wide = F.when(all_round, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), lean))) * SLACK + 1e-9)
    crosses = (F.col("olon") - wide < -180.0) | (F.col("olon") + wide > 180.0)
    return high, F.when(crosses, F.lit(360.0)).otherwise(wide)


def _inside() -> Column:
    """Whether the disc stays inside the cell."""
    side = F.lit(1.0) / _scale(F.col("level"))
    south, west = F.col("y") * side - 90.0, F.col("x") * side - 180.0
    high, wide = _disc()
    lat, lon = F.col("olat"), F.col("olon")
    return (lat - high > south) & (lat + high < south + side) & (lon - wide > west) & (lon + wide < west + side)


def _start_cells(bounded: DataFrame, deepest: int) -> DataFrame:
    """The few cells that cover the disc of the upper bound around each origin."""
    high, wide = _disc()
    framed = (
        bounded.withColumn("_a", high)
        .withColumn("_o", wide)
        .withColumn("_fit", F.floor(F.log(F.lit(ROOT_SIDE) / (F.greatest("_a", "_o") * 2)) / F.log(F.lit(4.0))))
        .withColumn("level", F.greatest(F.lit(0), F.least(F.lit(deepest), F.col("_fit"))).cast("int"))
    )

    def span(center: str, half: str, offset: float, limit: float) -> Column:
        low = F.greatest(F.col(center) - F.col(half), F.lit(-offset))
        high = F.least(F.col(center) + F.col(half), F.lit(limit))
        return F.sequence(_index(low, offset, F.col("level")), _index(high, offset, F.col("level")))

    return (
        framed.withColumn("x", F.explode(span("olon", "_o", 180.0, 180.0)))
        .withColumn("y", F.explode(span("olat", "_a", 90.0, 90.0)))
        .select("olat", "olon", "bound", *CELL)
    )


def _parents(cells: DataFrame, levels: int) -> list[Column]:
    return [F.col("kind"), (F.col("level") - levels).alias("level"), F.shiftright("x", 2 * levels).alias("x"), F.shiftright("y", 2 * levels).alias("y")]


def _descent(cells: DataFrame, opened: DataFrame) -> DataFrame:
    """An open cell and, as ``to``, each cell one or two levels below it that is a leaf or lies two below, with its box."""
    deeper = cells.filter(F.col("level") > 0)
    children = opened.join(deeper.select(*_parents(deeper, 1), F.struct(*CELL, *BOX).alias("to")), CELL)
    below = children.select(*[F.col("to")[c].alias(c) for c in CELL], F.struct(*CELL).alias("_from"), F.col("to").alias("_first"))
    twice = below.join(children, CELL, "left")
    return twice.select(*[F.col("_from")[c].alias(c) for c in CELL], F.coalesce("to", "_first").alias("to"))


def _micrometres(point: Column, radius: float) -> Column:
    """Whole micrometres between two unit vectors: equal distances compare equal, and no decimal rounding runs per pair."""
    return F.floor(F.asin(F.least(F.lit(1.0), F.sqrt(_chord_sq(point)) / 2)) * (2e9 * radius) + 0.5)


def _chord_sq(point: Column) -> Column:
    gap = [point[f"f{a}"] - F.col(f"o{a}") for a in "xyz"]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def _best(points: str, radius: float) -> Column:
    """The nearest of a cell's points, which come as an array: an origin gives one row for a cell, not one for a point."""
    return F.array_min(F.transform(points, lambda p: F.struct(_micrometres(p, radius).alias("d"), p["fid"].alias("id"))))


def nearest_facilities(
    origins: DataFrame,
    facilities: Mapping[str, DataFrame],
    lat: str = "origin_latitude",
    lon: str = "origin_longitude",
    facility_id: str = "facility_id",
    radius: float = RADIUS_KM,
) -> DataFrame:
    """Adds ``nearest_<label>_id`` and ``nearest_<label>_geodesic_km`` to the origins for each label of ``facilities``.

    Facilities need ``latitude`` and ``longitude``; those outside the national box are ignored, and none left of a
    label is an error. Origins without coordinates get nulls. Equal distances go to the smallest id.
    """
    labels = list(facilities)
    points = None
    for kind, label in enumerate(labels):
        own = facilities[label].select(
            F.lit(kind).alias("kind"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), F.col(facility_id).cast("string").alias("fid")
        )
        points = own if points is None else points.unionByName(own)
    points = points.filter(F.col("lat").between(-34, 6) & F.col("lon").between(-74, -28)).groupBy("kind", "lat", "lon").agg(F.min("fid").alias("fid"))
    cells = stored(
        _on_levels(points).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("lat", "lon")).alias("rep")).select(*CELL, "n", F.col("rep.lat").alias("lat"), F.col("rep.lon").alias("lon"), *_box()),
        "cells",
    )
    # a row for each kind: is there any facility, and how deep does the densest area reach
    is_open = (F.col("n") > LEAF_CAPACITY) & (F.col("level") < MAX_LEVEL)
    found = {r.kind: r.deepest for r in cells.groupBy("kind").agg(F.max(F.when(is_open, F.col("level"))).alias("deepest")).collect()}
    for kind, label in enumerate(labels):
        if kind not in found:
            raise ValueError(f"No valid {label} facility coordinates")
    steps = max((-1 if d is None else d) for d in found.values()) + 1
    cells = cells.filter(F.col("level") <= steps)  # nothing is opened below
    opened = cells.filter(is_open).select(*CELL)

    # what an origin meets in the first round: the points of a leaf, and for the empty parts of an open cell one point of each
    # cell one and two levels below it. Points are there on all levels from their leaf down, where a disc may begin.
    depth = _probe(_on_levels(points, steps), opened).groupBy("kind", "lat", "lon").agg((F.max("level") + 1).alias("leaf"))
    leveled = points.join(depth, ["kind", "lat", "lon"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    baits = _on_levels(leveled, steps).filter(F.col("level") >= F.col("leaf")).select(*CELL, "fid", (F.col("level") == F.col("leaf")).alias("tree"), *_unit("lat", "lon", "f"))
    for k in (1, 2):
        deeper = cells.filter(F.col("level") >= k)
        above = deeper.select(*_parents(deeper, k), "lat", "lon").join(opened, CELL, "left_semi")
        baits = baits.unionByName(above.select(*CELL, F.lit(None).cast("string").alias("fid"), F.lit(True).alias("tree"), *_unit("lat", "lon", "f")))
    point = F.struct("fid", "fx", "fy", "fz")
    baits = baits.groupBy(*CELL).agg(F.collect_list(F.when(F.col("tree"), point)).alias("baits"), F.collect_list(F.when(F.col("fid").isNotNull(), point)).alias("points"))
    baits = stored(baits, "baits")

    # each distinct place is searched once for every kind
    spots = origins.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(lat).cast("double").alias("olat"), F.col(lon).cast("double").alias("olon")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(labels))])).alias("kind")
    on_cells = _on_levels(spots.select("olat", "olon", F.col("olat").alias("lat"), F.col("olon").alias("lon"), kinds), steps).select("olat", "olon", *CELL)
    held = _probe(on_cells, cells.select(*CELL, is_open.alias("open")))
    place = F.struct("level", "x", "y")
    located = held.groupBy("olat", "olon", "kind").agg(F.coalesce(F.min(F.when(~F.col("open"), place)), F.max(F.when(F.col("open"), place))).alias("at"))
    located = located.select("olat", "olon", "kind", "at.*", *_unit("olat", "olon", "o"))
    # a leaf's baits are its points; those of an open cell have no id
    near = located.join(baits.filter("size(baits) > 0").select(*CELL, "baits", (F.col("baits")[0]["fid"].isNotNull()).alias("leaf")), CELL).select(
        "olat", "olon", *CELL, F.when(F.col("leaf"), _best("baits", radius)).alias("best"), (F.array_min(F.transform("baits", _chord_sq)) / 4).alias("a")
    )
    anywhere = cells.groupBy("kind").agg(F.min(F.struct("lat", "lon")).alias("p"))  # a row for each kind
    far = spots.crossJoin(F.broadcast(anywhere)).select("olat", "olon", "kind", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("x", "long"), ("y", "long"), ("best", "struct<d:bigint,id:string>"))], _to("p.lat", "p.lon").alias("a"))
    own = F.max(F.when(F.col("best").isNotNull(), F.struct("level", "x", "y"))).alias("own")
    bounded = near.unionByName(far).groupBy("olat", "olon", "kind").agg(F.min("a").alias("bound"), F.min("best").alias("best"), own)
    bounded = bounded.select("olat", "olon", "kind", "bound", "best", "own.*")
    bounded = stored(bounded.withColumn("done", F.coalesce(_inside(), F.lit(False))), "bounded")

    frontier = _probe(_start_cells(bounded.filter("NOT done").select("olat", "olon", "kind", "bound"), steps), cells.select(*CELL, *BOX)).filter(_touched()).drop(*BOX)
    descent = _descent(cells.select(*CELL, *BOX), opened)
    for _ in range((steps + 1) // 2):
        below = frontier.join(descent, CELL, "left").filter(F.col("to").isNull() | _touched("to."))
        frontier = below.select("olat", "olon", "bound", *[F.coalesce(F.col("to")[c], F.col(c)).alias(c) for c in CELL])
    searched = frontier.select("olat", "olon", *CELL, *_unit("olat", "olon", "o")).join(baits.filter("size(points) > 0").select(*CELL, "points"), CELL)
    second = searched.select("olat", "olon", "kind", _best("points", radius).alias("best"))
    result = bounded.filter("done").select("olat", "olon", "kind", "best").unionByName(second)
    columns = []
    for kind, label in enumerate(labels):
        own = F.min(F.when(F.col("kind") == kind, F.col("best")))
        columns += [own["id"].alias(f"nearest_{label}_id"), (own["d"] / 1e9).alias(f"nearest_{label}_geodesic_km")]
    result = result.groupBy(F.col("olat").alias("_olat"), F.col("olon").alias("_olon")).agg(*columns)
    on = (F.col(lat).cast("double") == F.col("_olat")) & (F.col(lon).cast("double") == F.col("_olon"))
    return origins.join(result, on, "left").drop("_olat", "_olon")


def nearest_facility(
    origins: DataFrame,
    facilities: DataFrame,
    label: str,
    lat: str = "origin_latitude",
    lon: str = "origin_longitude",
    facility_id: str = "facility_id",
    radius: float = RADIUS_KM,
) -> DataFrame:
    """:func:`nearest_facilities` of one kind."""
    return nearest_facilities(origins, {label: facilities}, lat, lon, facility_id, radius)
