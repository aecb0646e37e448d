"""Ring and polygon expressions on nested arrays of [lon, lat] points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<array<double>>"
MULTIPOLYGON = "array<array<array<array<double>>>>"
FLAT_AREA = 1e-12
EDGE_TOLERANCE = 1e-10


def _edges(ring: Column, closed: Column) -> Column:
    """Struct (a, b) per consecutive pair of the closed point list."""
    n = F.size(closed)
    return F.zip_with(
        F.slice(closed, 1, n - 1),
        F.slice(closed, F.lit(2), n - 1),
        lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")),
    )


def _closed(ring: Column) -> Column:
    same = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(same, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + f(e))


def ring_area_centroid(ring: Column) -> Column:
    """Struct (area, lon, lat): signed shoelace area and centroid; a flat ring falls back to the mean point."""
    edges = _edges(ring, _closed(ring))
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    area = _total(edges, cross) / 2
    lon = F.try_divide(_total(edges, lambda e: (e["ax"] + e["bx"]) * cross(e)), area * 6)
    lat = F.try_divide(_total(edges, lambda e: (e["ay"] + e["by"]) * cross(e)), area * 6)
    flat = F.abs(area) < FLAT_AREA
    n = F.size(ring)
    return F.struct(
        F.when(flat, 0.0).otherwise(area).alias("area"),
        F.when(flat, _total(ring, lambda p: p[0]) / n).otherwise(lon).alias("lon"),
        F.when(flat, _total(ring, lambda p: p[1]) / n).otherwise(lat).alias("lat"),
    )


def all_rings(multipolygon: Column) -> Column:
    """Every ring, outer or hole, of a multipolygon."""
    return F.flatten(multipolygon)


def all_points(multipolygon: Column) -> Column:
    return F.flatten(F.flatten(multipolygon))


def bounding_box(multipolygon: Column) -> Column:
    points = all_points(multipolygon)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def _walk(ring: Column) -> Column:
    """Edges as (previous, current) with the last point before the first one."""
    n = F.size(ring)
    previous = F.concat(F.slice(ring, n, 1), F.slice(ring, F.lit(1), n - 1))
    return F.zip_with(
        previous,
        ring,
        lambda p, c: F.struct(p[0].alias("px"), p[1].alias("py"), c[0].alias("cx"), c[1].alias("cy")),
    )


def _crossings_odd(lon: Column, lat: Column, ring: Column, left_of) -> Column:
    hits = F.filter(
        _walk(ring),
        lambda e: ((e["py"] > lat) != (e["cy"] > lat))
        & left_of(lon, F.try_divide((e["cx"] - e["px"]) * (lat - e["py"]), e["cy"] - e["py"]) + e["px"]),
    )
    return F.size(hits) % 2 == 1


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test; a point exactly on an edge is not treated specially."""
    return _crossings_odd(lon, lat, ring, lambda x, edge: x < edge)


def _on_edge(lon: Column, lat: Column, ring: Column) -> Column:
    eps = EDGE_TOLERANCE

    def touches(e: Column) -> Column:
        cross = (lon - e["px"]) * (e["cy"] - e["py"]) - (lat - e["py"]) * (e["cx"] - e["px"])
        return (
            (F.abs(cross) <= eps)
            & lon.between(F.least(e["px"], e["cx"]) - eps, F.greatest(e["px"], e["cx"]) + eps)
            & lat.between(F.least(e["py"], e["cy"]) - eps, F.greatest(e["py"], e["cy"]) + eps)
        )

    return F.exists(_walk(ring), touches)


def in_or_on_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test where edge points are inside; rings of fewer than four points hold nothing."""
    inside = _on_edge(lon, lat, ring) | _crossings_odd(lon, lat, ring, lambda x, edge: x <= edge)
    return (F.size(ring) >= 4) & inside


def in_multipolygon(lon: Column, lat: Column, multipolygon: Column, bbox: Column) -> Column:
    """Inside an outer ring and outside its holes; the box test runs first."""
    in_box = lon.between(bbox["min_x"], bbox["max_x"]) & lat.between(bbox["min_y"], bbox["max_y"])
    hit = F.exists(
        multipolygon,
        lambda poly: in_or_on_ring(lon, lat, F.element_at(poly, 1))
        & ~F.exists(F.slice(poly, F.lit(2), F.size(poly)), lambda hole: in_or_on_ring(lon, lat, hole)),
    )
    return F.when(in_box, hit).otherwise(F.lit(False))


def main_ring(rings: Column) -> Column:
    """Struct (size, order, lon, lat, ring) of the ring with the largest absolute area; the first wins a tie."""
    sized = F.transform(
        rings,
        lambda ring, i: F.struct(ring_area_centroid(ring).alias("c"), (-i).alias("order"), ring.alias("ring")),
    )
    keyed = F.transform(
        sized,
        lambda s: F.struct(
            F.abs(s["c"]["area"]).alias("size"),
            s["order"].alias("order"),
            s["c"]["lon"].alias("lon"),
            s["c"]["lat"].alias("lat"),
            s["ring"].alias("ring"),
        ),
    )
    return F.array_max(keyed)


def representative_point(rings: Column) -> Column:
    """Struct (lon, lat): centroid of the largest ring with three points or more, else the mean of all points."""
    usable = F.filter(rings, lambda r: F.size(r) >= 3)
    main = main_ring(usable)
    points = F.flatten(rings)
    n = F.nullif(F.size(points), F.lit(0))
    return F.struct(
        F.coalesce(main["lon"], F.try_divide(_total(points, lambda p: p[0]), n)).alias("lon"),
        F.coalesce(main["lat"], F.try_divide(_total(points, lambda p: p[1]), n)).alias("lat"),
    )
