"""Joins by place and by key, filters by attribute and mask.

Points meet polygons through tiles: each polygon part goes to the tiles of its box, each point to its own tile, an equi-join
brings them together and the exact test decides. Tiled parts of a checked count are broadcast, so points aren't shuffled;
beyond it both sides are, and Spark splits tiles that are hot. A handful of parts needs no tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from .result import ToolResult, attributes, checkpoints, count, need, parts, polygons, small

TILE = 5.0  # degrees
FEW = 16  # parts that every point may be tested against


def tile(v: Column, size: float) -> Column:
    return F.floor(v / size)


def part_bounds(p: Column) -> Column:
    ring = F.get(p, F.lit(0))
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def point_in_parts(points: DataFrame, shapes: DataFrame, x: Column, y: Column, strict: bool = False, tile_deg: float = TILE) -> DataFrame:
    """points joined to the polygon parts that hold them: adds part (the geometry), p_fid and part_index of shapes, and shapes' attributes in a struct p. Each pair comes once."""
    keep = attributes(shapes)
    rows = parts(polygons(shapes), *keep).select(F.col("_fid").alias("p_fid"), "part_index", "part", F.struct(*keep).alias("p") if keep else F.lit(None).alias("p")).withColumn("__b", part_bounds(F.col("part"))).where("__b.x0 is not null")
    pts = points.withColumns({"__x": x, "__y": y})
    inside = (F.col("__x") >= F.col("__b.x0")) & (F.col("__x") <= F.col("__b.x1")) & (F.col("__y") >= F.col("__b.y0")) & (F.col("__y") <= F.col("__b.y1"))
    if small(rows, FEW):
        joined = pts.join(F.broadcast(rows), inside)
    else:
        span = lambda a, b: F.explode(F.sequence(tile(F.col(f"__b.{a}"), tile_deg), tile(F.col(f"__b.{b}"), tile_deg)))
        tiled = rows.withColumn("__tx", span("x0", "x1")).withColumn("__ty", span("y0", "y1"))
        joined = pts.withColumns({"__tx": tile(F.col("__x"), tile_deg), "__ty": tile(F.col("__y"), tile_deg)}).join(F.broadcast(tiled) if small(tiled) else tiled, ["__tx", "__ty"]).where(inside).drop("__tx", "__ty")
    exact = G.in_part(F.col("__x"), F.col("__y"), F.col("part"))
    if strict:
        exact = exact & ~F.exists("part", lambda r: G.on_ring(F.col("__x"), F.col("__y"), r))
    return joined.where(exact).drop("__x", "__y", "__b")


def within_any(points: DataFrame, shapes: DataFrame, x: Column, y: Column, strict: bool = False, key: str = "id") -> DataFrame:
    """The points (known by key) that some polygon holds, once each."""
    ids = point_in_parts(points.select(key, x.alias("__px"), y.alias("__py")), shapes, F.col("__px"), F.col("__py"), strict).select(key).distinct()
    return points.join(ids, key, "left_semi")


# --- filters ---------------------------------------------------------------------------------------------------------


def attribute_test(df: DataFrame, field: str | None, op: str | None, value: str | None) -> Column:
    """The test of one attribute: numbers by = == != > >= < <= (equal within 1e-9), texts without regard to case by = == != contains > <, booleans by = == !=. Nulls and other kinds fail; anything missing or a blank field passes."""
    if not field or not field.strip() or op is None or value is None:
        return F.lit(True)
    kinds = dict(df.dtypes)
    if field not in kinds:
        return F.lit(False)
    c, kind = F.col(f"`{field}`"), kinds[field]
    if kind == "boolean":
        want = value.strip().lower() in ("true", "1")
        test = {"=": c == want, "==": c == want, "!=": c != want}.get(op)
    elif kind == "string":
        low, v = F.lower(c), value.lower()
        test = {"=": low == v, "==": low == v, "!=": low != v, "contains": low.contains(v), ">": low > v, "<": low < v}.get(op)
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        try:
            v = float(value)
        except ValueError:
            return F.lit(False)
        d = c.cast("double")
        same = F.abs(d - v) < 1e-9
        test = {"=": same, "==": same, "!=": ~same, ">": d > v, ">=": d >= v, "<": d < v, "<=": d <= v}.get(op)
    else:
        test = None
    return F.coalesce(test, F.lit(False)) if test is not None else F.lit(False)


def mask_points(df: DataFrame, strict_types: bool) -> tuple[DataFrame, Column]:
    """(the vertices to test, whether a feature passes untested)."""
    simple = F.col("geom.type").isin("Point", "MultiPoint", "LineString")
    return df.where(simple | F.lit(strict_types)).select("_fid", F.explode(G.vertices("geom")).alias("v")), ~simple & ~F.lit(strict_types)


def spatial_query(df: DataFrame, field: str | None = None, op: str | None = None, value: str | None = None, mask: DataFrame | None = None, relation: str = "intersects", strict: bool = False) -> ToolResult:
    """Features that meet the attribute test and the mask. A mask without polygons passes everything; points, multipoints and lines need a vertex in it, other types pass (strict: they need one too)."""
    out = df.where(attribute_test(df, field, op, value))
    if mask is not None and not polygons(mask).isEmpty():
        vs, free = mask_points(out, strict)
        held = point_in_parts(vs, mask, F.col("v.x"), F.col("v.y")).select("_fid").distinct()
        out = out.where(free).unionByName(out.where(~free).join(held, "_fid", "left_semi").select(*out.columns))
    s = df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("matched_features")))
    rate = G.rounded(F.coalesce(F.col("matched_features") * 100.0 / F.nullif(F.col("input_features"), F.lit(0)), F.lit(0.0)), 1)
    return ToolResult(out, s.withColumns({"match_rate_percent": rate, "spatial_relation": F.lit(relation), "attribute_condition": F.lit(f"{field} {op} {value}" if field and op and value is not None else None).cast("string")}))


def free_text(df: DataFrame, query: str) -> DataFrame:
    """Rows with a cell that holds the text, without regard to case."""
    cells = F.array(*(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in attributes(df)))
    return df.where(F.exists(cells, lambda c: c.contains(query.lower())))


# --- joins -----------------------------------------------------------------------------------------------------------


def key_join(df: DataFrame, table: DataFrame, field: str, key: str | None = None) -> ToolResult:
    """A table's columns by key, its first row (by column _row if there is one) winning: join_<column>, numeric texts as numbers where all of a column are. Keys are trimmed texts; the table's header is matched without regard to case."""
    names = {c.lower(): c for c in table.columns}
    key = names.get((key or field).lower())
    need(key is not None, f"the table has no column {key or field}")
    need(field in df.columns, f"no field {field}")
    own = [c for c in table.columns if c not in (key, "_row")]
    k = F.trim(F.col(f"`{key}`").cast("string"))
    if "_row" in table.columns:
        first = table.withColumn("__k", k).groupBy("__k").agg(F.min_by(F.struct(*own), "_row").alias("__t"))
    else:
        first = table.withColumn("__k", k).groupBy("__k").agg(F.first(F.struct(*own)).alias("__t"))
    numbers = numeric_columns(table, own)
    cells = [(F.col(f"__t.`{c}`").cast("double") if c in numbers else F.col(f"__t.`{c}`")).alias(f"join_{c}") for c in own]
    side = F.broadcast(first) if small(first) else first
    joined = df.join(side, F.trim(F.col(f"`{field}`").cast("string")) == F.col("__k"), "left")
    out = joined.select(*df.columns, *cells)
    s = joined.agg(count(F.col("__k").isNotNull()).alias("matched_features"), count(F.col("__k").isNull()).alias("unmatched_features"))
    return ToolResult(out, s.crossJoin(table.agg(count().alias("csv_rows"))).withColumns({"key_field": F.lit(field), "csv_key": F.lit(key), "joined_columns": F.lit([f"join_{c}" for c in own])}))


def numeric_columns(table: DataFrame, columns: list[str]) -> set[str]:
    texts = [c for c, t in table.dtypes if c in columns and t == "string"]
    if not texts:
        return set()
    bad = table.agg(*(count(F.trim(f"`{c}`").try_cast("double").isNull() & F.col(f"`{c}`").isNotNull() & (F.trim(f"`{c}`") != "")).alias(c) for c in texts), *(count(F.trim(f"`{c}`").try_cast("double").isNotNull()).alias(f"__{c}") for c in texts)).first()
    return {c for c in texts if not bad[c] and bad[f"__{c}"]}


def representative_vertices(g: Column | str, capped: bool = True) -> Column:
    """Points and lines: all vertices; polygons: the first 32 of the outer ring; multipolygons: the first 16 of each part's. Not capped: all of them."""
    g = G.col(g)
    if not capped:
        return F.when(g["type"].isin("Polygon", "MultiPolygon"), F.flatten(F.transform(g["parts"], lambda p: F.get(p, F.lit(0))))).otherwise(G.vertices(g))
    first = lambda n: F.flatten(F.transform(g["parts"], lambda p: F.slice(F.get(p, F.lit(0)), 1, n)))
    return F.when(g["type"] == "Polygon", first(32)).when(g["type"] == "MultiPolygon", first(16)).otherwise(G.vertices(g))


def spatial_join(df: DataFrame, target: DataFrame, fields: list[str] | None = None, capped: bool = True) -> ToolResult:
    """Each feature with the polygons that hold one of its representative vertices: sj_join_count, and sj_<field>, which is null for none, the value for one, 'N matches' for more. Parts of a multipolygon count separately; the order of target decides nothing. Not capped, polygons are judged by all vertices of their outer rings."""
    need(not polygons(target).isEmpty(), "the target has no polygons")
    fields = fields or sorted(attributes(target))
    vs = df.select("_fid", F.explode(representative_vertices("geom", capped)).alias("v"))
    pairs = point_in_parts(vs, target.select("_fid", "geom", *fields), F.col("v.x"), F.col("v.y")).select("_fid", "p_fid", "part_index", "p").dropDuplicates(["_fid", "p_fid", "part_index"])
    got = pairs.groupBy("_fid").agg(count().alias("__n"), *(F.min(F.col(f"p.`{f}`").cast("string")).alias(f"__{i}") for i, f in enumerate(fields)))
    n = F.coalesce("__n", F.lit(0)).cast("long")
    joined = df.join(got, "_fid", "left")
    out = joined.select(*df.columns, n.alias("sj_join_count"), *(F.when(n == 0, F.lit(None)).when(n == 1, F.col(f"__{i}")).otherwise(F.concat(n.cast("string"), F.lit(" matches"))).cast("string").alias(f"sj_{f}") for i, f in enumerate(fields)))
    s = out.agg(count().alias("source_features"), count(F.col("sj_join_count") > 0).alias("joined_features"), count(F.col("sj_join_count") == 0).alias("unmatched_features"))
    return ToolResult(out, s.withColumn("joined_fields", F.lit([f"sj_{f}" for f in fields])))


def sample_points(df: DataFrame, *keep: str) -> DataFrame:
    """A point for each feature: points as they are, multipoints exploded, else the first vertex."""
    multi = F.col("geom.type") == "MultiPoint"
    vs = F.when(multi, G.vertices("geom")).otherwise(F.slice(G.vertices("geom"), 1, 1))
    return df.select("_fid", *keep, F.posexplode(vs).alias("place", "v")).select("_fid", *keep, "place", F.col("v.x").alias("x"), F.col("v.y").alias("y")).where("x is not null and y is not null")


MOST_SHARED = 1_000_000  # targets, of 48 bytes each, that go to every task


def nearest_shared(points: DataFrame, t: DataFrame, same: bool) -> DataFrame:
    """nearest() for targets (t_fid, t_place, tx, ty) that fit a task."""
    held = t.select(F.col("t_fid").cast("long"), F.col("t_place").cast("long"), "tx", "ty").where("tx is not null and ty is not null and not isnan(tx) and not isnan(ty)").toArrow().to_pandas().sort_values(["t_fid", "t_place"], kind="stable")
    fid, place, tx, ty = (held[c].to_numpy() for c in ("t_fid", "t_place", "tx", "ty"))
    shared = points.sparkSession.sparkContext.broadcast((fid, place, tx, ty))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fid, place, tx, ty = shared.value
        index = K.Nearest(K.on_sphere(tx, ty)) if len(fid) else None
        own = {k: i for i, k in enumerate(zip(fid.tolist(), place.tolist(), strict=True))} if same else {}
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            got = np.full(b.num_rows, -1)
            good = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
            if index is not None and len(good):
                mine = np.array([own.get(k, -1) for k in zip(b.column("_fid").to_pylist(), b.column("place").to_pylist(), strict=True)])[good] if same else None
                got[good] = index.places(K.on_sphere(x[good], y[good]), mine)
            some = np.flatnonzero(got >= 0)
            at = got[some]
            kept = b.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v[at]) for v in (fid, place, tx, ty))], names=[*b.schema.names, "t_fid", "t_place", "tx", "ty"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in points.dtypes)
    fid_kind, place_kind = (dict(t.dtypes)[c] for c in ("t_fid", "t_place"))
    found = points.mapInArrow(ask, f"{kinds}, t_fid long, t_place long, tx double, ty double")
    return found.select(*points.columns, G.haversine(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")).alias("metres"), F.col("t_fid").cast(fid_kind), F.col("t_place").cast(place_kind), "tx", "ty")


def nearest(points: DataFrame, targets: DataFrame, same: bool, cell_deg: float = 4.0, most_shared: int = MOST_SHARED) -> DataFrame:
    """(_fid, place, t_fid, t_place, metres): each point's nearest target by great circle, ties to the smallest target.

    Targets of a checked count go to every task, which asks its points of a grid on the sphere (K.Nearest), so that no pair
    becomes a row. Else both sides go to a grid of cells that double: a point asks
    the three by three cells around it, which settles it if the nearest found is nearer than the ring's edge could be; what
    isn't settled asks again with cells of twice the size, until the cells cover the globe.
    """
    t = targets.select(F.col("_fid").alias("t_fid"), F.col("place").alias("t_place"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    other = (F.col("_fid") != F.col("t_fid")) | (F.col("place") != F.col("t_place")) if same else F.lit(True)
    metres = G.haversine(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    best = F.min(F.struct(metres.alias("metres"), "t_fid", "t_place", "tx", "ty")).alias("b")
    keys = [c for c in points.columns]
    if small(t, most_shared):
        return nearest_shared(points, t, same)
    checkpoints(points.sparkSession)
    done, open_, size = None, points, cell_deg
    while size < 720:
        cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        asked = open_.withColumn("__n", around).withColumns({"__cx": cx + F.col("__n.i"), "__cy": cy + F.col("__n.j")}).drop("__n")
        held = t.withColumns({"__cx": F.floor(F.col("tx") / size), "__cy": F.floor(F.col("ty") / size)})
        found = asked.join(held, ["__cx", "__cy"]).where(other).groupBy(*keys).agg(best).select(*keys, "b.*")
        # Nothing outside the nine cells is nearer than their border: a cell's height, or its width where meridians are closest (and the date line far).
        edge_y = F.least(F.col("y") - cy * size, (cy + 1) * size - F.col("y")) + size
        edge_x = F.least(F.col("x") - cx * size, (cx + 1) * size - F.col("x")) + size
        top = F.least(F.lit(90.0), F.abs(F.col("y")) + edge_y)
        safe = F.least(edge_y * 110_000.0, F.when(F.col("x").between(-180 + 2 * size, 180 - 2 * size), edge_x * 110_000.0 * F.greatest(F.lit(0.0), F.cos(F.radians(top)))).otherwise(0.0))
        settled = found.where(F.col("metres") <= safe).checkpoint()  # else each round would run those before it again
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.join(settled.select("_fid", "place"), ["_fid", "place"], "left_anti")
        size *= 4
    rest = open_.join(t, other).groupBy(*keys).agg(best).select(*keys, "b.*") if not open_.isEmpty() else None
    return done if rest is None else done.unionByName(rest)


def nearest_neighbours(df: DataFrame, target: DataFrame | None = None) -> ToolResult:
    """A line from each point to its nearest: in the same layer, or in a target layer."""
    mine, yours = attributes(df), attributes(target if target is not None else df)
    found = nearest(sample_points(df), sample_points(target if target is not None else df), target is None)
    src = df.select("_fid", *(F.col(f"`{c}`").alias(f"src_{c}") for c in mine))
    tgt = (target if target is not None else df).select(F.col("_fid").alias("t_fid"), *(F.col(f"`{c}`").alias(f"tgt_{c}") for c in yours))
    joined = found.join(src, "_fid").join(tgt, "t_fid")
    out = joined.select("_fid", G.line(F.array(G.vertex(F.col("x"), F.col("y")), G.vertex(F.col("tx"), F.col("ty")))).alias("geom"), G.rounded(F.col("metres"), 1).alias("distance_meters"), G.rounded(F.col("metres") / 1000, 3).alias("distance_km"), F.col("_fid").alias("source_index"), F.col("t_fid").alias("target_index"), *(f"src_{c}" for c in mine), *(f"tgt_{c}" for c in yours))
    km = F.col("metres") / 1000
    s = found.agg(count().alias("connections_count"), *(G.rounded(f(km), 2).alias(f"{n}_distance_km") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))
    return ToolResult(out, s)


# --- the attribute table ---------------------------------------------------------------------------------------------


def sorted_by_text(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    key = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    return df.orderBy(key.desc() if descending else key.asc(), "_fid")


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    v = F.col(f"`{column}`").try_cast("double")
    return df.agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum"))


def first_per_key(df: DataFrame, key: str, order: str = "_fid") -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
