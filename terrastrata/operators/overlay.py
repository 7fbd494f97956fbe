"""Geometric set operations: overlay, clip, dissolve, and the topology rules that need them.

Masks are matched by tiles of their boxes, so a feature's task gets the mask parts near it only. Parts of a mask aren't united.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from .joins import FEW, TILE, point_in_parts, tile
from .result import ToolResult, attributes, count, need, parts, polygons, small, total_area_km2

OPS = ("intersection", "difference", "symmetric_difference", "union")


def plain(ps) -> list:
    return [[[(v["x"], v["y"]) for v in r] for r in p] for p in ps]


def rows(ps: list) -> list:
    return [[[{"x": x, "y": y, "z": None} for x, y in r] for r in p] for p in ps]


def near_parts(df: DataFrame, mask: DataFrame) -> DataFrame:
    """df with __mask: the mask parts whose boxes meet the feature's."""
    m = parts(polygons(mask)).select("part").withColumn("__mb", G.bounds(G.geom("Polygon", F.array("part")))).where("__mb.x0 is not null").withColumn("__id", F.xxhash64(F.to_json("part")))
    f = df.select("_fid", "geom").withColumn("__b", G.bounds("geom"))
    meets = G.boxes_meet(F.col("__b"), F.col("__mb"))
    if small(m, FEW):
        pairs = f.join(F.broadcast(m), meets)
    else:
        def spread(x: DataFrame, b: str) -> DataFrame:
            span = lambda lo, hi: F.explode(F.sequence(tile(F.col(f"{b}.{lo}"), TILE), tile(F.col(f"{b}.{hi}"), TILE)))
            return x.withColumn("__tx", span("x0", "x1")).withColumn("__ty", span("y0", "y1"))

        pairs = spread(f, "__b").join(spread(m, "__mb"), ["__tx", "__ty"]).where(meets).dropDuplicates(["_fid", "__id"])
    near = pairs.groupBy("_fid").agg(F.collect_list("part").alias("__mask"))
    return df.join(near, "_fid", "left").withColumn("__mask", F.coalesce("__mask", F.array().cast(G.PARTS)))


def boolean_udf(op: str):
    @F.pandas_udf(G.PARTS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rows(K.boolean(plain(x), plain(y), op)) for x, y in zip(a, b, strict=True)])

    return run


def overlay(df: DataFrame, mask: DataFrame, op: str = "intersection") -> ToolResult:
    """Each polygon feature against the mask; empty results and other types go. Every output is a multipolygon with overlay_op."""
    need(op in OPS, f"no operation {op}")
    need(not polygons(mask).isEmpty(), "the mask has no polygons")
    source = polygons(df)
    if op in ("symmetric_difference", "union"):  # the whole mask takes part, also what is far from the feature
        whole = parts(polygons(mask)).agg(F.collect_list("part").alias("__mask"))
        both = source.crossJoin(F.broadcast(whole))
    else:
        both = near_parts(source, mask)
    out = both.withColumn("__p", boolean_udf(op)(F.col("geom.parts"), F.col("__mask"))).where(F.size("__p") > 0)
    out = out.select("_fid", *attributes(df), G.geom("MultiPolygon", F.col("__p")).alias("geom"), F.lit(op).alias("overlay_op"))
    s = df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("output_features"), total_area_km2(out, "output_area_sqkm")))
    return ToolResult(out, s.withColumn("operation", F.lit(op)))


def clip(df: DataFrame, mask: DataFrame) -> ToolResult:
    """Polygons are cut to the mask, attributes as they were; other features stay whole if a vertex lies strictly inside."""
    need(not polygons(mask).isEmpty(), "the mask has no polygons")
    areal = polygons(df)
    cut = near_parts(areal, mask).withColumn("__p", boolean_udf("intersection")(F.col("geom.parts"), F.col("__mask"))).where(F.size("__p") > 0).withColumn("geom", G.geom("MultiPolygon", F.col("__p"))).select(*df.columns)
    others = df.where(~F.col("geom.type").isin("Polygon", "MultiPolygon"))
    vs = others.select("_fid", F.explode(G.vertices("geom")).alias("v"))
    held = point_in_parts(vs, mask, F.col("v.x"), F.col("v.y"), strict=True).select("_fid").distinct()
    out = cut.unionByName(others.join(held, "_fid", "left_semi").select(*df.columns))
    s = df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("clipped_features"), total_area_km2(out, "clipped_area_sqkm")))
    return ToolResult(out, s)


def dissolve(df: DataFrame, field: str | None = None) -> ToolResult:
    """Polygons united by a field (null is a group), or all of them; _fid is the group's first feature's. Parts are united within tiles first, the tiles' results by group then, so that no task starts from a whole group's features."""
    source = polygons(df)
    need(not source.isEmpty(), "there are no polygons")
    key = F.to_json(F.struct(F.col(f"`{field}`"))) if field else F.lit("{}")

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        done = K.boolean([p for ps in pdf["parts"] for p in plain(ps)], [], "union")
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "fid": [int(pdf["fid"].min())], "n": [int(pdf["n"].sum())], "parts": [rows(done)]})

    each = source.select(key.alias("key"), F.col("_fid").alias("fid"), F.lit(1).cast("long").alias("n"), F.col("geom.parts").alias("parts"), G.bounds("geom").alias("b"))
    first = each.withColumn("t", F.concat_ws("/", tile(F.col("b.x0"), 4 * TILE), tile(F.col("b.y0"), 4 * TILE)))
    schema = f"key string, fid bigint, n bigint, parts {G.PARTS}"
    tiled = first.drop("b").groupBy("key", "t").applyInPandas(union, schema)
    whole = tiled.groupBy("key").applyInPandas(union, schema)
    value = F.from_json("key", source.select(field).schema)[field] if field else None
    out = whole.select(F.col("fid").alias("_fid"), G.geom("MultiPolygon", F.col("parts")).alias("geom"), *([value.alias(field)] if field else []), F.size("parts").cast("long").alias("dissolved_parts"), F.col("n").alias("source_features"))
    s = df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("output_groups"), total_area_km2(out, "merged_area_sqkm")))
    rate = G.rounded((F.col("input_features") - F.col("output_groups")) * 100.0 / F.col("input_features"), 1)
    return ToolResult(out, s.withColumns({"group_field": F.lit(field).cast("string"), "feature_reduction_percent": rate}))


# --- topology rules --------------------------------------------------------------------------------------------------

FIXES = {
    "must_not_overlap": "Edit or clip one of the polygons so that they only share a border",
    "must_not_have_dangles": "Snap the end to another line or extend the line",
    "must_be_covered_by": "Move the feature into a covering polygon or extend the cover",
}


def violation(rule: str, index: Column, detail: Column) -> list[Column]:
    return [F.lit(rule).alias("violation"), index.alias("feature_index"), detail.alias("detail"), F.lit(FIXES[rule]).alias("suggested_fix")]


def must_not_overlap(df: DataFrame) -> ToolResult:
    """Pairs of polygon parts (also of one feature) that overlap by over a square metre, in plane degrees of 111,320 m."""
    ps = parts(polygons(df)).withColumn("__b", G.bounds(G.geom("Polygon", F.array("part")))).where("__b.x0 is not null")
    n = ps.count()
    need(n >= 2, "the rule needs two polygons")
    span = lambda lo, hi: F.explode(F.sequence(tile(F.col(f"__b.{lo}"), TILE), tile(F.col(f"__b.{hi}"), TILE)))
    tiled = ps.withColumn("__tx", span("x0", "x1")).withColumn("__ty", span("y0", "y1"))
    a, b = tiled, tiled.select(F.col("_fid").alias("o_fid"), F.col("part_index").alias("o_index"), F.col("part").alias("o_part"), F.col("__b").alias("__ob"), "__tx", "__ty")
    later = (F.col("o_fid") > F.col("_fid")) | (F.col("o_fid") == F.col("_fid")) & (F.col("o_index") > F.col("part_index"))
    pairs = a.join(b, ["__tx", "__ty"]).where(later & G.boxes_meet(F.col("__b"), F.col("__ob"))).dropDuplicates(["_fid", "part_index", "o_fid", "o_index"])
    met = pairs.withColumn("__p", boolean_udf("intersection")(F.array("part"), F.array("o_part"))).where(F.size("__p") > 0)
    plane = lambda p: F.abs(G.total(G.around(F.get(p, F.lit(0))), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2
    area = G.total(F.col("__p"), plane) * G.METRES_PER_DEGREE**2
    bad = met.withColumn("__area", area).where("__area > 1")
    detail = F.struct(F.col("o_fid").alias("with_feature_index"), G.rounded(F.col("__area"), 2).alias("overlap_area_m2"))
    out = bad.select("_fid", G.geom("Polygon", F.slice("__p", 1, 1)).alias("geom"), *violation("must_not_overlap", F.col("_fid"), F.to_json(detail)), F.col("o_fid").alias("with_feature_index"), G.rounded(F.col("__area"), 2).alias("overlap_area_m2"))
    return ToolResult(out, checked(out, "must_not_overlap", F.lit(n).alias("polygons_checked")))


def checked(out: DataFrame, rule: str, n: Column) -> DataFrame:
    return out.agg(count().alias("violations")).select(F.lit(rule).alias("rule"), n, "violations", (F.col("violations") == 0).alias("valid"))


def must_not_have_dangles(df: DataFrame) -> ToolResult:
    """Line ends (to 1e-7 degrees) that no other line end shares."""
    lines = parts(df.where(F.col("geom.type").isin("LineString", "MultiLineString"))).select("_fid", F.get("part", F.lit(0)).alias("r")).where(F.size("r") >= 2)
    need(not lines.isEmpty(), "the rule needs lines")
    ends = lines.select("_fid", F.explode(F.array(F.get("r", F.lit(0)), F.element_at("r", -1))).alias("v")).select("_fid", "v.x", "v.y")
    key = [F.round(F.col(c) * 1e7).cast("long").alias(f"k{c}") for c in "xy"]
    lone = ends.groupBy(*key).agg(count().alias("n"), F.min(F.struct("_fid", "x", "y")).alias("e")).where("n = 1").select("e.*")
    out = lone.select("_fid", G.point(F.col("x"), F.col("y")).alias("geom"), *violation("must_not_have_dangles", F.col("_fid"), F.to_json(F.struct(F.array("x", "y").alias("endpoint")))))
    return ToolResult(out, checked(out, "must_not_have_dangles", F.lit(ends.count()).alias("endpoints_checked")))


def must_be_covered_by(df: DataFrame, cover: DataFrame) -> ToolResult:
    """Features whose first, middle and last vertices all lie outside every covering polygon."""
    need(not polygons(cover).isEmpty(), "there is no cover")
    vs = df.withColumn("__vs", G.vertices("geom")).where(F.size("__vs") > 0)
    three = F.array(F.get("__vs", F.lit(0)), F.get("__vs", F.floor(F.size("__vs") / 2).cast("int")), F.element_at("__vs", -1))
    tested = vs.select("_fid", F.explode(three).alias("v"))
    held = point_in_parts(tested, cover, F.col("v.x"), F.col("v.y"), strict=True).select("_fid").distinct()
    bad = vs.join(held, "_fid", "left_anti")
    p = F.get("__vs", F.lit(0))
    out = bad.select("_fid", "geom", *violation("must_be_covered_by", F.col("_fid"), F.to_json(F.struct(F.array(p["x"], p["y"]).alias("representative_point")))))
    return ToolResult(out, checked(out, "must_be_covered_by", F.lit(df.count()).alias("features_checked")))


def topology_check(df: DataFrame, rule: str = "must_not_overlap", cover: DataFrame | None = None) -> ToolResult:
    need(rule in FIXES, f"unknown rule {rule}")
    if rule == "must_be_covered_by":
        need(cover is not None, "there is no cover")
        return must_be_covered_by(df, cover)
    return must_not_overlap(df) if rule == "must_not_overlap" else must_not_have_dangles(df)
