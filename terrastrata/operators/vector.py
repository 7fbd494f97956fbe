"""Tools on single features and whole layers: buffers, hulls, centroids, boxes, simplification, measures, random points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import geometry as G
from ..functions import kernels as K
from .result import ToolResult, attributes, count, need, polygons, total_area_km2


def buffer(df: DataFrame, metres: float = 50_000.0, steps: int = 16) -> ToolResult:
    need(metres > 0, "the distance must be positive")
    steps = steps if steps >= 8 else 16
    out = df.withColumn("geom", G.buffer("geom", metres, steps)).where("geom is not null").withColumns({"buffer_distance_m": F.lit(float(metres)), "buffer_type": F.lit("geodesic_approximation")})
    area = out.agg(count().alias("buffered_features"), total_area_km2(out, "total_buffered_area_sqkm"))
    summary = df.agg(count().alias("input_features")).crossJoin(area).withColumns({"buffer_radius_meters": F.lit(float(metres)), "buffer_radius_km": F.lit(metres / 1000), "segments": F.lit(steps)})
    return ToolResult(out, summary)


def centroids(df: DataFrame) -> ToolResult:
    out = df.withColumn("__c", G.centroid("geom")).where("__c is not null")
    out = out.select("_fid", *attributes(df), G.point(F.col("__c.x"), F.col("__c.y")).alias("geom"), F.col("__c.x").alias("centroid_lng"), F.col("__c.y").alias("centroid_lat"), F.col("_fid").alias("source_feature_index"))
    return ToolResult(out, df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("computed_centroids"))))


def boxes(df: DataFrame, per_feature: bool = False) -> ToolResult:
    b = df.withColumn("__b", G.bounds("geom")).where("__b.x0 is not null")
    if per_feature:
        out = b.select("_fid", *attributes(df), G.rectangle(*(F.col(f"__b.{k}") for k in ("x0", "y0", "x1", "y1"))).alias("geom"), *(F.col(f"__b.{k}").alias(f"bbox_{n}") for k, n in (("x0", "min_lng"), ("y0", "min_lat"), ("x1", "max_lng"), ("y1", "max_lat"))), F.col("_fid").alias("source_feature_idx"))
    else:
        one = b.agg(F.min("__b.x0").alias("min_lng"), F.min("__b.y0").alias("min_lat"), F.max("__b.x1").alias("max_lng"), F.max("__b.y1").alias("max_lat")).where("min_lng is not null")
        out = one.select(F.lit(0).cast("long").alias("_fid"), F.lit("Layer Bounding Box").alias("name"), G.rectangle(F.col("min_lng"), F.col("min_lat"), F.col("max_lng"), F.col("max_lat")).alias("geom"), "min_lng", "min_lat", "max_lng", "max_lat", (F.col("max_lng") - F.col("min_lng")).alias("width_deg"), (F.col("max_lat") - F.col("min_lat")).alias("height_deg"))
    summary = df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("output_bboxes"), total_area_km2(out, "enclosed_area_sqkm"))).withColumn("mode", F.lit("per_feature" if per_feature else "layer"))
    return ToolResult(out, summary)


VERTEX = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
RING = T.ArrayType(VERTEX)


@pandas_udf(RING)
def hull_udf(vs: pd.Series) -> pd.Series:
    return vs.map(lambda r: [{"x": x, "y": y, "z": None} for x, y in K.hull([(v["x"], v["y"]) for v in r])])


def convex_hull(df: DataFrame, per_feature: bool = False) -> ToolResult:
    if per_feature:
        out = df.where(F.size(G.vertices("geom")) >= 3).withColumn("__h", hull_udf(G.vertices("geom"))).where(F.size("__h") > 0)
        out = out.select("_fid", *attributes(df), G.polygon(F.col("__h")).alias("geom"), F.lit("feature").alias("hull_type"), F.col("_fid").alias("feature_index"))
    else:
        # A hull of hulls: each task sends the few corners of its own.
        def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple[float, float]] = []
            for b in batches:
                held = [*held, *zip(b["x"], b["y"], strict=True)]
                ring = K.hull(held)
                held = ring[:-1] if ring else sorted(set(held))
            yield pd.DataFrame(held, columns=["x", "y"])

        xy = df.select(F.explode(G.vertices("geom")).alias("v")).select("v.x", "v.y").where("x is not null and y is not null")
        few = xy.mapInPandas(corners, "x double, y double")
        ring = few.agg(F.collect_list(G.vertex(F.col("x"), F.col("y"))).alias("vs")).withColumn("__h", hull_udf("vs")).where(F.size("__h") > 0)
        n = df.agg(count().alias("source_features_count"))
        out = ring.crossJoin(n).select(F.lit(0).cast("long").alias("_fid"), G.polygon(F.col("__h")).alias("geom"), F.lit("Layer Convex Hull").alias("name"), F.lit("layer").alias("hull_type"), "source_features_count", F.size("__h").cast("long").alias("hull_vertices_count"))
    summary = df.agg(count().alias("input_features")).crossJoin(out.agg(count().alias("output_hulls"), total_area_km2(out, "enclosed_area_sqkm"))).withColumn("mode", F.lit("per_feature" if per_feature else "layer"))
    return ToolResult(out, summary)


def simplify(df: DataFrame, tolerance: float = 0.05) -> ToolResult:
    """Lines and polygons only; rings stay closed and fall back to what they were with under four vertices left."""
    tol = tolerance if tolerance > 0 else 0.001

    @pandas_udf(G.PARTS)
    def run(kind: pd.Series, parts: pd.Series) -> pd.Series:
        def ring(vs, closed):
            ps = [(v["x"], v["y"]) for v in vs]
            if closed and len(ps) > 3:
                # A closed ring has no chord; it is cut at its farthest vertex.
                far = max(range(len(ps)), key=lambda i: (ps[i][0] - ps[0][0]) ** 2 + (ps[i][1] - ps[0][1]) ** 2)
                out = K.simplified(ps[: far + 1], tol)[:-1] + K.simplified(ps[far:], tol)
                return out if len(out) >= 4 else ps
            return K.simplified(ps, tol)

        return pd.Series([[[[{"x": x, "y": y, "z": None} for x, y in ring(r, k.endswith("Polygon"))] for r in p] for p in ps] for k, ps in zip(kind, parts, strict=True)])

    shaped = F.col("geom.type").isin("LineString", "MultiLineString", "Polygon", "MultiPolygon")
    new = F.when(shaped, G.geom(F.col("geom.type"), run(F.col("geom.type"), F.when(shaped, F.col("geom.parts")).otherwise(F.array().cast(G.PARTS))))).otherwise(F.col("geom"))
    n = lambda g: F.when(shaped, F.size(G.vertices(g))).otherwise(1).cast("long")
    out = df.withColumn("__new", new).withColumns({"simplified_tolerance": F.lit(tol), "original_vertices": n("geom"), "simplified_vertices": n("__new")}).withColumn("geom", F.col("__new")).drop("__new")
    s = out.agg(count().alias("input_features"), F.sum("original_vertices").alias("initial_vertices"), F.sum("simplified_vertices").alias("final_vertices"))
    return ToolResult(out, s.withColumns({"tolerance": F.lit(tol), "vertex_reduction_percent": G.rounded(F.coalesce((F.col("initial_vertices") - F.col("final_vertices")) * 100.0 / F.nullif(F.col("initial_vertices"), F.lit(0)), F.lit(0.0)), 1)}))


MILE = 1609.344


def metrics(df: DataFrame, divisor: float = G.AREA_DIVISOR) -> ToolResult:
    """Areas, perimeters and lengths; the summary has totals, and statistics of every numeric attribute as rows (attribute, count, min, max, mean, sum) in attribute_statistics."""
    areal, linear = F.col("geom.type").isin("Polygon", "MultiPolygon"), F.col("geom.type").isin("LineString", "MultiLineString")
    area, edge = G.area_m2("geom", divisor), G.perimeter_m("geom")
    out = df.withColumns({"__area": F.when(areal, area), "__edge": F.when(areal | linear, edge)}).withColumns(
        {
            "area_sqkm": F.when(areal, G.rounded(F.col("__area") / 1e6, 3)),
            "area_hectares": F.when(areal, G.rounded(F.col("__area") / 1e4, 2)),
            "perimeter_km": F.when(areal, G.rounded(F.col("__edge") / 1000, 3)),
            "length_km": F.when(linear, G.rounded(F.col("__edge") / 1000, 3)),
            "length_miles": F.when(linear, G.rounded(F.col("__edge") / MILE, 3)),
        }
    )
    a, e = F.coalesce(F.sum("__area"), F.lit(0.0)), F.coalesce(F.sum(F.when(linear, F.col("__edge"))), F.lit(0.0))
    summary = out.agg(count().alias("feature_count"), G.rounded(a, 2).alias("total_area_sqm"), G.rounded(a / 1e6, 3).alias("total_area_sqkm"), G.rounded(e, 2).alias("total_length_m"), G.rounded(e / 1000, 3).alias("total_length_km"))
    features = out.drop("__area", "__edge")
    stats = attribute_statistics(features).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("attribute_statistics"))
    return ToolResult(features, summary.crossJoin(stats))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def attribute_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """attribute, count, min, max, mean and sum (two places) of numeric attributes, unpivoted so that one pass serves all."""
    names = [c for c, t in df.dtypes if c in (columns or attributes(df)) and (t in NUMBERS or t.startswith("decimal"))]
    if not names:
        return df.sparkSession.createDataFrame([], "attribute string, count bigint, min double, max double, mean double, sum double")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("v")) for c in names)))
    rows = df.select(pairs.alias("p")).select("p.*").where("v is not null and not isnan(v)")
    r = lambda c: G.rounded(c, 2)
    return rows.groupBy("attribute").agg(count().alias("count"), r(F.min("v")).alias("min"), r(F.max("v")).alias("max"), r(F.avg("v")).alias("mean"), r(F.sum("v")).alias("sum"))


def random_points(df: DataFrame, n: int = 100, within_polygons: bool = False, seed: int = 0) -> ToolResult:
    """Points in the layer's box, or in its polygons; at most 50 tries for each point asked for."""
    n = max(1, min(10_000, n))
    spark = df.sparkSession
    box = boxes(df).features.select("min_lng", "min_lat", "max_lng", "max_lat")
    tries = spark.range(n * 50 if within_polygons else n).crossJoin(F.broadcast(box)).select("id", (F.col("min_lng") + F.rand(seed) * (F.col("max_lng") - F.col("min_lng"))).alias("lng"), (F.col("min_lat") + F.rand(seed + 1) * (F.col("max_lat") - F.col("min_lat"))).alias("lat"), F.rand(seed + 2).alias("w"))
    if within_polygons:
        from .joins import within_any

        tries = within_any(tries, polygons(df), F.col("lng"), F.col("lat"))
    # At most n * 50 rows, of a bounded n.
    picked = tries.orderBy("id").limit(n).withColumn("point_id", F.row_number().over(Window.orderBy("id")).cast("long"))
    r = lambda c, k: G.rounded(c, k)
    out = picked.select((F.col("point_id") - 1).alias("_fid"), G.point(F.col("lng"), F.col("lat")).alias("geom"), "point_id", r(F.col("lng"), 5).alias("lng"), r(F.col("lat"), 5).alias("lat"), r(F.lit(10.0) + F.col("w") * 90.0, 1).alias("sample_weight"))
    return ToolResult(out, out.agg(count().alias("generated_count")).withColumns({"requested_count": F.lit(n), "restricted_to_polygons": F.lit(within_polygons)}))
