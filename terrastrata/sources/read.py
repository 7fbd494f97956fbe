"""Reading layers, tables and rasters into DataFrames, and writing them."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.raster import Grid
from ..operators.result import ToolError, attributes, need
from . import decode

LAT = ("lat", "latitude", "y", "centroid_lat")
LNG = ("lng", "lon", "longitude", "x", "centroid_lng")


def format_of(path: str) -> str:
    kind = decode.SUFFIXES.get(os.path.splitext(path.lower())[1])
    need(kind is not None, f"no format for {path}")
    return kind


# --- layers ----------------------------------------------------------------------------------------------------------


def layer(raw: DataFrame) -> DataFrame:
    """raw (file, n, geom, props as JSON texts) as features: _fid in order of files and places, a typed column for each property, of the type of its first value that isn't null."""
    spark = raw.sparkSession
    schema = schema_of(raw)
    sizes = raw.groupBy("file").agg(F.count(F.lit(1)).alias("size")).orderBy("file").collect()  # a row a file
    starts, at = [], 0
    for r in sizes:
        starts.append((r.file, at))
        at += r.size
    offsets = spark.createDataFrame(starts or [("", 0)], "file string, start long")
    cells = []
    for r in schema.collect():
        text = F.element_at("props", F.lit(r.name))
        if r.field_type == "number":
            c = text.try_cast("double")
        elif r.field_type == "boolean":
            c = text.try_cast("boolean")
        else:  # a JSON text is unquoted, other values stay as they read
            c = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).when(text == "null", None).otherwise(text)
        cells.append(c.alias(r.name))
    rows = raw.join(F.broadcast(offsets), "file")
    return rows.select((F.col("start") + F.col("n")).alias("_fid"), "geom", *cells)


def schema_of(raw: DataFrame) -> DataFrame:
    """name, field_type and sample_value of each property, by its first value that isn't null."""
    p = raw.select("file", "n", F.explode("props").alias("name", "v"))
    kind = F.when(F.col("v") == "null", "null").when(F.col("v").startswith('"'), "string").when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").startswith("["), "array").when(F.col("v").startswith("{"), "object").otherwise("number")
    first = p.withColumn("kind", kind).groupBy("name").agg(F.min_by(F.struct("kind", "v"), F.struct((F.col("kind") == "null").alias("late"), "file", "n")).alias("f"))
    sample = F.when(F.col("f.kind") == "array", "[Array]").when(F.col("f.kind") == "object", "[Object]").when(F.col("f.kind") == "string", F.get_json_object(F.concat(F.lit('{"v":'), F.col("f.v"), F.lit("}")), "$.v")).otherwise(F.col("f.v"))
    return first.select("name", F.col("f.kind").alias("field_type"), sample.alias("sample_value")).orderBy("name")


def decoded(files: DataFrame, kind: str) -> DataFrame:
    """files (path, content) as raw features; a file is one task's work."""
    read = decode.DECODERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                out = []
                for n, (g, props) in enumerate(read(bytes(content), path)):
                    out.append((path, n, g, {str(k): json.dumps(v, ensure_ascii=False) for k, v in props.items()}))
                    if len(out) == 2_000:
                        yield pd.DataFrame(out, columns=["file", "n", "geom", "props"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["file", "n", "geom", "props"])

    return files.select("path", "content").mapInPandas(run, f"file string, n long, geom {G.GEOM}, props map<string,string>")


def read_vector(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Features of one or more files of a format (by suffix if not named); empty input is an error."""
    kind = {"json": "geojson"}.get(kind or format_of(path), kind or format_of(path))
    if kind == "csv":
        out = csv_points(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True))
    elif kind == "wkt":
        out = wkt_features(spark.read.text(path))
    else:
        need(kind in decode.DECODERS, f"unknown format {kind}")
        raw = decoded(spark.read.format("binaryFile").load(path), kind).cache()
        out = layer(raw)
    need(not out.isEmpty(), "there are no features")
    return out


def from_payload(spark: SparkSession, payload: str, kind: str = "geojson") -> DataFrame:
    """Features of a text (GeoJSON, KML, GPX) or of base64 of a binary format."""
    kind = {"json": "geojson"}.get(kind, kind)
    need(kind in decode.DECODERS, f"unknown format {kind}")
    data = payload.encode() if kind in ("geojson", "kml", "gpx") else base64.b64decode(payload)
    list(zip(range(1), decode.DECODERS[kind](data, ""), strict=False))  # fails here rather than in a task
    files = spark.createDataFrame([("payload", bytearray(data))], "path string, content binary")
    out = layer(decoded(files, kind).cache())
    need(not out.isEmpty(), "there are no features")
    return out


def raster_cells(files: DataFrame) -> DataFrame:
    """file, x, y, value of GeoTIFFs (path, content). A file is one task's work, its rows go out in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                values, _, _ = decode.geotiff(bytes(content))
                h, w = values.shape
                step = max(1, 200_000 // max(1, w))
                for at in range(0, h, step):
                    ys, xs = np.mgrid[at : min(h, at + step), 0:w]
                    yield pd.DataFrame({"file": path, "x": xs.ravel().astype("int32"), "y": ys.ravel().astype("int32"), "value": values[at : at + step].ravel()})

    return files.select("path", "content").mapInPandas(run, "file string, x int, y int, value double")


def raster_grids(files: DataFrame) -> dict[str, Grid]:
    """The grid of each file, a few numbers a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                values, extent, nodata = decode.geotiff(bytes(content))
                yield pd.DataFrame([(path, *values.shape, *extent, nodata)], columns=["file", "h", "w", "x0", "y0", "x1", "y1", "nodata"])

    rows = files.select("path", "content").mapInPandas(run, "file string, h int, w int, x0 double, y0 double, x1 double, y1 double, nodata double")
    return {r.file: Grid(r.w, r.h, r.x0, r.y0, r.x1, r.y1, None if r.nodata is None or r.nodata != r.nodata else r.nodata) for r in rows.collect()}


def read_rasters(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Grid]]:
    """All GeoTIFFs of a path as cells (file, x, y, value), decoded by the executors, and the grid of each file."""
    files = spark.read.format("binaryFile").load(path)
    return raster_cells(files), raster_grids(files)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """One GeoTIFF as cells and their grid; several are an error, read_rasters() reads them."""
    cells, grids = read_rasters(spark, path)
    need(len(grids) == 1, f"{path} holds {len(grids)} rasters: use read_rasters()")
    return cells.drop("file"), next(iter(grids.values()))


def raster_of(spark: SparkSession, data: bytes) -> tuple[DataFrame, Grid]:
    files = spark.createDataFrame([("payload", bytearray(data))], "path string, content binary")
    decode.geotiff(data)  # fails here rather than in a task
    return raster_cells(files).drop("file"), raster_grids(files)["payload"]


# --- text formats, all in built-in expressions -----------------------------------------------------------------------


def named(columns: list[str], names: tuple[str, ...]) -> str:
    found = [c for c in columns if c.strip().lower() in names]
    if not found:
        raise ToolError(f"no column among {', '.join(names)}")
    return found[-1]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of texts with its order in _row: quotes doubled inside quotes, blank lines skipped; a row of another length than the header is an error."""
    t = spark.read.csv(path, header=True, quote='"', escape='"', mode="FAILFAST", multiLine=True, inferSchema=False, ignoreLeadingWhiteSpace=False)
    need(bool(t.columns), "the table is empty")
    return t.withColumn("_row", F.monotonically_increasing_id())


def csv_points(table: DataFrame, order: Column | None = None) -> DataFrame:
    """Points of a table with a latitude and a longitude column; rows without both are left out, columns whose values are all numbers become numbers."""
    from ..operators.joins import numeric_columns

    lat, lng = named(table.columns, LAT), named(table.columns, LNG)
    others = [c for c in table.columns if c != "_row"]
    numbers = numeric_columns(table, others)
    fid = F.col("_row").cast("long") if "_row" in table.columns else (order if order is not None else F.monotonically_increasing_id())
    x, y = F.trim(F.col(f"`{lng}`").cast("string")).try_cast("double"), F.trim(F.col(f"`{lat}`").cast("string")).try_cast("double")
    rows = table.withColumns({"__x": x, "__y": y, "__fid": fid}).where("__x is not null and __y is not null")
    return rows.select(F.col("__fid").alias("_fid"), G.point(F.col("__x"), F.col("__y")).alias("geom"), *((F.col(f"`{c}`").cast("double") if c in numbers else F.col(f"`{c}`")).alias(c.strip()) for c in others))


def wkt_geometry(text: Column) -> Column:
    """A geometry from a line of text; null for collections, EMPTY and what can't be read."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a lambda's variable is computed once

    def at(pair: Column) -> Column:
        return once(F.split(F.trim(pair), r"\s+"), lambda xy: G.vertex(F.get(xy, F.lit(0)).try_cast("double"), F.get(xy, F.lit(1)).try_cast("double")))

    run = lambda r: F.transform(F.split(F.translate(r, "()", ""), ","), at)
    # Rings and parts are split where parentheses close before a comma.
    rings = lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), run)

    def parts(k: Column) -> Column:
        kind, body = k["kind"], k["body"]
        return (
            F.when(kind.isin("POINT", "LINESTRING"), F.array(F.array(run(body))))
            .when(kind == "POLYGON", F.array(rings(body)))
            .when(kind == "MULTIPOINT", F.transform(run(body), lambda v: F.array(F.array(v))))
            .when(kind == "MULTILINESTRING", F.transform(F.split(body, r"\)\s*,\s*\("), lambda r: F.array(run(r))))
            .when(kind == "MULTIPOLYGON", F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), rings))
        )

    name = F.create_map(*(F.lit(x) for k in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon") for x in (k.upper(), k)))
    fine = lambda ps: F.forall(ps, lambda p: F.forall(p, lambda r: F.forall(r, lambda v: v["x"].isNotNull() & v["y"].isNotNull())))
    made = lambda k: once(parts(k), lambda ps: F.when((k["body"] != "") & fine(ps), G.geom(F.element_at(name, k["kind"]), ps)))
    upper = F.upper(F.trim(text))
    kind = F.regexp_extract(upper, r"^(MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|POINT|LINESTRING|POLYGON)\b", 1)
    body = F.regexp_extract(upper, r"^[A-Z]+\s*\((.*)\)\s*$", 1)
    return once(F.struct(kind.alias("kind"), body.alias("body")), lambda k: F.when(k["kind"] != "", made(k)))


def wkt_features(lines: DataFrame, column: str = "value") -> DataFrame:
    """A feature for each line that isn't blank or a comment (#), with feature_id and wkt_source."""
    rows = lines.where((F.trim(column) != "") & ~F.trim(column).startswith("#"))
    fid = F.col("_row").cast("long") if "_row" in lines.columns else F.monotonically_increasing_id()
    return rows.select(fid.alias("_fid"), wkt_geometry(F.col(column)).alias("geom"), (fid + 1).alias("feature_id"), F.trim(column).alias("wkt_source")).where("geom is not null")


def quoted(c: Column) -> Column:
    return F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_rows(df: DataFrame) -> DataFrame:
    """_fid and a line of CSV for each feature: feature_id, geometry_type, centroid_lng and centroid_lat (of the first vertex), then the attributes in order, quoted where needed."""
    v = G.first_vertex("geom")
    cells = [(F.col("_fid") + 1).cast("string"), F.col("geom.type"), G.number_text(v["x"]), G.number_text(v["y"]), *((G.number_text(F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`").cast("string")) for c, t in df.dtypes if c in attributes(df))]
    return df.select("_fid", F.concat_ws(",", *(F.coalesce(quoted(c), F.lit("")) for c in cells)).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(["feature_id", "geometry_type", "centroid_lng", "centroid_lat", *attributes(df)])


def wkt_rows(df: DataFrame) -> DataFrame:
    """_fid and the text of each geometry; collections are left out."""
    return df.select("_fid", G.wkt("geom").alias("line")).where("line is not null")


def attribute_rows(df: DataFrame) -> DataFrame:
    """The attribute table as lines: columns by name, every cell quoted, missing ones empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return df.select("_fid", F.concat_ws(",", *(cell(c) for c in sorted(attributes(df)))).alias("line"))


def json_geometry(g: Column | str) -> Column:
    """A geometry as GeoJSON text; null for collections (to_geojson writes those)."""
    g = G.col(g)
    pos = lambda v: F.concat(F.lit("["), G.number_text(v["x"]), F.lit(","), G.number_text(v["y"]), F.when(v["z"].isNotNull(), F.concat(F.lit(","), G.number_text(v["z"]))).otherwise(F.lit("")), F.lit("]"))
    listed = lambda xs, f: F.concat(F.lit("["), F.array_join(F.transform(xs, f), ","), F.lit("]"))
    run = lambda r: listed(r, pos)
    zero = F.lit(0)
    p = g["parts"]
    c = F.when(g["type"] == "Point", pos(F.get(F.get(F.get(p, zero), zero), zero))).when(g["type"] == "MultiPoint", listed(p, lambda x: pos(F.get(F.get(x, zero), zero)))).when(g["type"] == "LineString", run(F.get(F.get(p, zero), zero))).when(g["type"] == "MultiLineString", listed(p, lambda x: run(F.get(x, zero)))).when(g["type"] == "Polygon", listed(F.get(p, zero), run)).when(g["type"] == "MultiPolygon", listed(p, lambda x: listed(x, run)))
    return F.when(c.isNotNull(), F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), c, F.lit("}")))


def geojson_rows(df: DataFrame) -> DataFrame:
    """_fid and the text of each feature."""
    members = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform("geom.members", lambda m: json_geometry(F.struct(m["type"].alias("type"), m["parts"].alias("parts")))), ","), F.lit("]}"))
    g = F.coalesce(json_geometry("geom"), F.when(F.col("geom.members").isNotNull(), members), F.lit("null"))
    names = [c for c in attributes(df) if c != "_id"]
    props = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    own = F.lit("")
    if "_id" in df.columns:  # a feature's own id stands beside its properties
        quoted_id = F.to_json(F.array("_id"))
        own = F.when(F.col("_id").isNotNull(), F.concat(F.lit(',"id":'), F.substring(quoted_id, F.lit(2), F.length(quoted_id) - 2))).otherwise(F.lit(""))
    return df.select("_fid", F.concat(F.lit('{"type":"Feature"'), own, F.lit(',"geometry":'), g, F.lit(',"properties":'), props, F.lit("}")).alias("line"))


def write_feature_collection(df: DataFrame, path: str) -> None:
    """A layer as one GeoJSON document: a file, written feature by feature in order by one task. write_lines(geojson_rows(df), path) writes features a line each by many; both read back."""
    lines = geojson_rows(df)
    ends = df.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "part int, line string")
    last = lines.agg(F.max("_fid").alias("last"))  # one row
    body = lines.crossJoin(F.broadcast(last)).select(F.lit(1).alias("part"), "_fid", F.concat("line", F.when(F.col("_fid") < F.col("last"), ",").otherwise("")).alias("line"))
    whole = body.unionByName(ends.withColumn("_fid", F.lit(0).cast("long")))
    whole.orderBy("part", "_fid").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Lines in order of _fid as text files."""
    rows.orderBy("_fid").select("line").write.mode("overwrite").text(path)
