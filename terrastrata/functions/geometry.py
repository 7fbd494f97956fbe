"""Geometry as a nested struct, and what can be computed of it by built-in expressions.

A geometry is struct<type, parts, members>: parts are lists of rings of vertices (x, y, z), one shape for all types. A point
is one part of one ring of one vertex, a multipoint has a part for each point, a line string one part of one ring, a polygon
one part whose first ring is the outer one. A geometry collection has members instead, nested ones flattened.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double,z:double>"
PARTS = f"array<array<array<{VERTEX}>>>"
GEOM = f"struct<type:string,parts:{PARTS},members:array<struct<type:string,parts:{PARTS}>>>"

# Radius and lengths of a degree in metres.
EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = 111320.0
#: Divisor of the ring area. 4 gives half the true area and is the default for equal results; exact areas take 2.
AREA_DIVISOR = 4.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero."""
    by = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * by + 0.5) / by


# --- constructors ----------------------------------------------------------------------------------------------------


def vertex(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if z is None else z).cast("double").alias("z"))


def geom(kind: Column | str, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), parts.alias("parts"), F.lit(None).cast(f"array<struct<type:string,parts:{PARTS}>>").alias("members")).cast(GEOM)


def point(x: Column, y: Column) -> Column:
    return geom("Point", F.array(F.array(F.array(vertex(x, y)))))


def line(vertices: Column) -> Column:
    return geom("LineString", F.array(F.array(vertices)))


def polygon(ring: Column) -> Column:
    return geom("Polygon", F.array(F.array(ring)))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, counter-clockwise from the lower left."""
    return polygon(F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0)))


# --- access ----------------------------------------------------------------------------------------------------------


def all_parts(g: Column | str) -> Column:
    """Parts, of a collection those of all members."""
    g = col(g)
    of_members = F.flatten(F.transform(g["members"], lambda m: m["parts"]))
    return F.coalesce(g["parts"], of_members, F.array().cast(PARTS))


def vertices(g: Column | str) -> Column:
    """All vertices of all rings, in order."""
    return F.flatten(F.flatten(all_parts(g)))


def outer_vertices(g: Column | str) -> Column:
    """The vertices of each part's first ring, closing vertices included."""
    return F.flatten(F.transform(all_parts(g), lambda p: F.get(p, F.lit(0))))


def first_vertex(g: Column | str) -> Column:
    return F.get(vertices(g), F.lit(0))


def finite(v: Column) -> Column:
    return v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"]) & (F.abs(v["x"]) != float("inf")) & (F.abs(v["y"]) != float("inf"))


def bounds(g: Column | str) -> Column:
    """struct<x0, y0, x1, y1> of the finite vertices."""
    vs = F.filter(vertices(g), finite)
    xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def segments(ring: Column) -> Column:
    """array<struct<a, b>> of consecutive vertices."""
    n = F.size(ring) - 1
    return F.when(n > 0, F.zip_with(F.slice(ring, F.lit(1), F.greatest(n, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast(f"array<struct<a:{VERTEX},b:{VERTEX}>>"))


def around(ring: Column) -> Column:
    """Like segments, and from the last vertex back to the first."""
    return F.when(F.size(ring) > 0, F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast(f"array<struct<a:{VERTEX},b:{VERTEX}>>"))


def total(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


# --- measures --------------------------------------------------------------------------------------------------------


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres along a great circle."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(y1, y2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half(x1, x2)
    return F.lit(2.0 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def length_m(ring: Column) -> Column:
    return total(segments(ring), lambda s: haversine(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))


def ring_area(ring: Column, divisor: float = AREA_DIVISOR) -> Column:
    """Square metres on the sphere."""
    s = total(around(ring), lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (F.lit(2.0) + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"]))))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(s) * (EARTH_RADIUS * EARTH_RADIUS / divisor))


def part_area(part: Column, divisor: float = AREA_DIVISOR) -> Column:
    holes = total(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda r: ring_area(r, divisor))
    return F.greatest(ring_area(F.get(part, F.lit(0)), divisor) - holes, F.lit(0.0))


def area_m2(g: Column | str, divisor: float = AREA_DIVISOR) -> Column:
    """Polygons: outer rings less holes; 0 for other types."""
    g = col(g)
    return F.when(g["type"].isin("Polygon", "MultiPolygon"), total(g["parts"], lambda p: part_area(p, divisor))).otherwise(0.0)


def perimeter_m(g: Column | str) -> Column:
    """Of outer rings."""
    return total(col(g)["parts"], lambda p: length_m(F.get(p, F.lit(0))))


def mean_vertex(vs: Column) -> Column:
    """struct<x, y>: the mean of finite vertices; null without any."""
    good = F.filter(vs, finite)
    n = F.size(good)
    return F.when(n > 0, F.struct((total(good, lambda v: v["x"]) / n).alias("x"), (total(good, lambda v: v["y"]) / n).alias("y")))


def statistics_centre(g: Column | str) -> Column:
    """The mean of outer vertices, closing ones included; what the statistics stand on."""
    return mean_vertex(outer_vertices(g))


def ring_centroid(ring: Column) -> Column:
    """The planar centroid of a ring's area; the mean vertex where it has none, null for under three vertices."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    edges = around(ring)
    a = total(edges, cross) / 2
    cx = total(edges, lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / (a * 6)
    cy = total(edges, lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)) / (a * 6)
    return F.when(F.size(ring) < 3, F.lit(None)).when(F.abs(a) < 1e-12, mean_vertex(ring)).otherwise(F.struct(cx.alias("x"), cy.alias("y")))


def centroid(g: Column | str) -> Column:
    """struct<x, y>: points as they are, polygons by area (holes ignored), multipolygons the unweighted mean of their parts' centroids, others the mean vertex."""
    g = col(g)
    parts = F.array_compact(F.transform(g["parts"], lambda p: ring_centroid(F.get(p, F.lit(0)))))
    several = F.when(F.size(parts) > 0, F.struct((total(parts, lambda c: c["x"]) / F.size(parts)).alias("x"), (total(parts, lambda c: c["y"]) / F.size(parts)).alias("y")))
    return F.when(g["type"].isin("Polygon", "MultiPolygon"), several).otherwise(mean_vertex(vertices(g)))


# --- predicates ------------------------------------------------------------------------------------------------------


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule, half-open in y."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return (F.size(ring) >= 3) & F.aggregate(around(ring), F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))


def in_part(x: Column, y: Column, part: Column) -> Column:
    holes = F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))
    return in_ring(x, y, F.get(part, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(x, y, r))


def in_polygon(x: Column, y: Column, g: Column | str) -> Column:
    return F.exists(col(g)["parts"], lambda p: in_part(x, y, p))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(around(ring), on)


def strictly_in(x: Column, y: Column, g: Column | str) -> Column:
    """Inside, the boundary being outside."""
    return F.exists(col(g)["parts"], lambda p: in_part(x, y, p) & ~F.exists(p, lambda r: on_ring(x, y, r)))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


# --- buffers ---------------------------------------------------------------------------------------------------------


def narrowing(lat: Column) -> Column:
    """How much shorter a degree of longitude is than one of latitude."""
    return F.greatest(F.lit(0.001), F.abs(F.cos(F.radians(lat))))


def off_poles(lat: Column) -> Column:
    return F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat))


def point_buffer(x: Column, y: Column, metres: float, steps: int) -> Column:
    """A closed ring of steps vertices around a point; it stays a tenth of a degree from the poles."""
    dx = F.lit(metres) / (F.lit(METRES_PER_DEGREE) * narrowing(y))
    dy = metres / METRES_PER_DEGREE
    at = lambda i: vertex(x + dx * math.cos(2 * math.pi * i / steps), off_poles(y + dy * math.sin(2 * math.pi * i / steps)))
    return F.array(*(at(i) for i in range(steps)), at(0))


def line_buffer(ring: Column, metres: float, steps: int) -> Column:
    """A closed ring along a line: every vertex moved to the left of its neighbours' chord, then back along the right. No caps."""
    last = F.size(ring) - 1

    def moved(i: Column, side: float) -> Column:
        p, a, b = F.get(ring, i), F.get(ring, F.greatest(i - 1, F.lit(0))), F.get(ring, F.least(i + 1, last))
        by_x = F.lit(METRES_PER_DEGREE) * narrowing(p["y"])
        dx, dy = (b["x"] - a["x"]) * by_x, (b["y"] - a["y"]) * METRES_PER_DEGREE
        size = F.greatest(F.lit(1e-6), F.sqrt(dx * dx + dy * dy))
        return vertex(p["x"] + F.lit(side * metres) * (-dy) / size / by_x, off_poles(p["y"] + F.lit(side * metres) * dx / size / METRES_PER_DEGREE))

    places = F.sequence(F.lit(0), last)
    left, right = F.transform(places, lambda i: moved(i, 1.0)), F.transform(places, lambda i: moved(i, -1.0))
    band = F.concat(left, F.reverse(right), F.slice(left, 1, 1))
    p = F.get(ring, F.lit(0))
    return F.when(F.size(ring) < 2, point_buffer(p["x"], p["y"], metres, steps)).otherwise(band)


def buffer(g: Column | str, metres: float, steps: int) -> Column:
    """The buffered geometry; null for collections. Polygons: a band along the outer ring, holes dropped."""
    g = col(g)
    parts = F.transform(g["parts"], lambda p: F.array(F.when(F.size(F.get(p, F.lit(0))) == 1, point_buffer(F.get(F.get(p, F.lit(0)), F.lit(0))["x"], F.get(F.get(p, F.lit(0)), F.lit(0))["y"], metres, steps)).otherwise(line_buffer(F.get(p, F.lit(0)), metres, steps))))
    kind = F.when(g["type"].startswith("Multi"), "MultiPolygon").otherwise("Polygon")
    return F.when(g["parts"].isNotNull() & (F.size(g["parts"]) > 0), geom(kind, parts))


# --- text ------------------------------------------------------------------------------------------------------------


def number_text(x: Column) -> Column:
    """The shortest text of a number, without '.0'."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def wkt(g: Column | str) -> Column:
    """Two-dimensional text; null for collections and empty geometries."""
    g = col(g)
    pair = lambda v: F.concat_ws(" ", number_text(v["x"]), number_text(v["y"]))
    run = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    rings = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, run), ", "), F.lit(")"))
    ps, zero = g["parts"], F.lit(0)
    one = F.get(ps, zero)
    listed = lambda f: F.concat(F.lit("("), F.array_join(F.transform(ps, f), ", "), F.lit(")"))
    text = (
        F.when(g["type"] == "Point", run(F.get(one, zero)))
        .when(g["type"] == "MultiPoint", listed(lambda p: run(F.get(p, zero))))
        .when(g["type"] == "LineString", run(F.get(one, zero)))
        .when(g["type"] == "MultiLineString", listed(lambda p: run(F.get(p, zero))))
        .when(g["type"] == "Polygon", rings(one))
        .when(g["type"] == "MultiPolygon", listed(rings))
    )
    return F.when(F.size(ps) > 0, F.concat(F.upper(g["type"]), F.lit(" "), text))
