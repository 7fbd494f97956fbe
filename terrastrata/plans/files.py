"""Registered queries of sources and sinks: the driver's tables go out as files of each format and come back in.

Formats of lines (GeoJSON, CSV, WKT) are written and read by executors. A file of another format is put together here from
the 25 nations, whatever the scale, and goes in as a payload. Files lie beside the checkpoints.
"""

from __future__ import annotations

import base64
import io
import json
import sqlite3
import struct
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from ..operators.result import checkpoints
from ..sources import read as IO
from . import catalog
from . import views as W
from .queries import query

r6 = lambda c: F.round(c, 6)


def folder(s: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    checkpoints(s)
    return f"{s.sparkContext.getCheckpointDir()}/files/{name}-{uuid.uuid4().hex}"


def boxes(df: DataFrame, name: str = "n_name") -> DataFrame:
    """Each feature's name, type, corners and number of vertices."""
    v = df.select(F.col(name).cast("string").alias("name"), F.col("geom.type").alias("type"), F.explode(G.vertices("geom")).alias("v"))
    ends = [f(F.col(f"v.{c}")).alias(f"{c}{i}") for i, f in ((0, F.min), (1, F.max)) for c in "xy"]
    return v.groupBy("name", "type").agg(F.count(F.lit(1)).alias("vertices"), *ends)


BOXES = f"WITH {W.NATIONS} SELECT n_name AS name, 'Polygon' AS type, 5::BIGINT AS vertices, x0, y0, x1, y1 FROM nations"
POINTS = f"WITH {W.SUPPLIERS} SELECT s_name AS name, x, y, CAST(s_acctbal AS DOUBLE) AS balance FROM suppliers"


def points(df: DataFrame, name: str = "s_name", balance: str = "s_acctbal") -> DataFrame:
    v = G.first_vertex("geom")
    return df.select(F.col(name).alias("name"), v["x"].alias("x"), v["y"].alias("y"), F.col(balance).cast("double").alias("balance"))


# --- formats of lines ------------------------------------------------------------------------------------------------


@query(f"WITH {W.SUPPLIERS} SELECT s_name AS name, x, y, CAST(s_acctbal AS DOUBLE) AS balance, CAST(fid AS DOUBLE) AS id FROM suppliers")
def import_geojson_lines(s, d):
    """Features with ids, a line each, written by many tasks."""
    path = folder(s, "geojson")
    IO.write_lines(IO.geojson_rows(W.suppliers(s, d).withColumn("_id", F.col("_fid"))), path)
    back = IO.read_vector(s, path, "geojson")
    v = G.first_vertex("geom")
    return back.select(F.col("s_name").alias("name"), v["x"].alias("x"), v["y"].alias("y"), F.col("s_acctbal").alias("balance"), F.col("_id").alias("id"))


@query(BOXES)
def import_feature_collection(s, d):
    path = folder(s, "collection")
    IO.write_feature_collection(W.nations(s, d), path)
    return boxes(IO.read_vector(s, path, "geojson"))


@query("SELECT n_name AS field, 'string' AS field_type FROM (VALUES ('n_name')) t(n_name) UNION ALL SELECT 'n_regionkey', 'number'")
def import_schema(s, d):
    """The fields that a detected file has, with their types."""
    path = folder(s, "schema") + ".geojson"
    IO.write_feature_collection(W.nations(s, d), path)
    kinds = {"string": "string", "double": "number"}
    back = IO.read_vector(s, f"{path}/part-*", IO.format_of(path))
    return s.createDataFrame([(c, kinds[t]) for c, t in back.dtypes if c not in ("_fid", "geom")], "field string, field_type string")


@query(POINTS)
def import_csv(s, d):
    path = folder(s, "csv")
    v = G.first_vertex("geom")
    W.suppliers(s, d).select("s_name", "s_acctbal", v["x"].alias("Longitude"), v["y"].alias("lat")).write.csv(path, header=True)
    return points(IO.read_vector(s, path, "csv"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS n, CAST(n_nationkey AS VARCHAR) AS key, n_name AS label FROM nation")
def import_csv_table(s, d):
    """A table without places, rows in order."""
    path = folder(s, "table")
    W.read(s, d, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("key"), F.concat(F.lit('say "'), "n_name", F.lit('", twice')).alias("label")).coalesce(1).write.csv(path, header=True, escape='"')
    t = IO.read_table(s, path)
    return t.select(F.row_number().over(Window.orderBy("_row")).cast("long").alias("n"), "key", F.regexp_extract("label", '^say "(.*)", twice$', 1).alias("label"))


@query(f"WITH {W.NATIONS} SELECT 'Polygon' AS type, 5::BIGINT AS vertices, x0, y0, x1, y1 FROM nations")
def import_wkt_polygons(s, d):
    path = folder(s, "wkt")
    IO.write_lines(IO.wkt_rows(W.nations(s, d)), path)
    return boxes(IO.read_vector(s, path, "wkt"), "_fid").drop("name")


@query(f"WITH {W.SUPPLIERS} SELECT fid, 'POINT (' || CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END || ' ' || CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) ELSE CAST(y AS VARCHAR) END || ')' AS text FROM suppliers")
def csv_to_wkt(s, d):
    """CSV in, WKT out."""
    path = folder(s, "csv")
    v = G.first_vertex("geom")
    W.suppliers(s, d).select("_fid", v["x"].alias("x"), v["y"].alias("y")).withColumnRenamed("_fid", "key").write.csv(path, header=True)
    return IO.csv_points(s.read.csv(path, header=True)).select(F.col("key").cast("long").alias("fid"), G.wkt("geom").alias("text"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS fid, '"' || n_name || '","' || n_regionkey || '"' AS line FROM nation""")
def export_attributes(s, d):
    return IO.attribute_rows(W.nations(s, d)).select(F.col("_fid").alias("fid"), "line")


# --- other formats ---------------------------------------------------------------------------------------------------


def nation_rings(s: SparkSession, d: str) -> list[tuple[int, str, list[tuple[float, float]]]]:
    rows = W.nations(s, d).select("_fid", "n_name", G.vertices("geom").alias("v")).orderBy("_fid").collect()
    return [(r._fid, r.n_name, [(p.x, p.y) for p in r.v]) for r in rows]


def payload(s: SparkSession, data: bytes, kind: str) -> DataFrame:
    return IO.from_payload(s, base64.b64encode(data).decode(), kind)


def kml_of(rings: list) -> bytes:
    marks = "".join(f"<Placemark><name>{n}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{' '.join(f'{x!r},{y!r},0' for x, y in v)}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>" for _, n, v in rings)
    return f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>'.encode()


@query(BOXES)
def import_kml(s, d):
    return boxes(IO.from_payload(s, kml_of(nation_rings(s, d)).decode(), "kml"), "name")


@query(BOXES)
def import_kmz(s, d):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", kml_of(nation_rings(s, d)))
    return boxes(payload(s, out.getvalue(), "kmz"), "name")


@query(f"WITH {W.NATIONS} SELECT n_name AS name, 'waypoint' AS kind, 'Point' AS type, 1::BIGINT AS vertices, x0 AS x, y0 AS y FROM nations UNION ALL SELECT n_name, 'track', 'LineString', 5, x0, y0 FROM nations")
def import_gpx(s, d):
    rings = nation_rings(s, d)
    marks = "".join(f'<wpt lat="{v[0][1]!r}" lon="{v[0][0]!r}"><name>{n}</name></wpt>' for _, n, v in rings)
    tracks = "".join(f"<trk><name>{n}</name><trkseg>{''.join(f'<trkpt lat={chr(34)}{y!r}{chr(34)} lon={chr(34)}{x!r}{chr(34)}/>' for x, y in v)}</trkseg></trk>" for _, n, v in rings)
    back = IO.from_payload(s, f"<gpx>{marks}{tracks}</gpx>", "gpx")
    v = G.first_vertex("geom")
    return back.select("name", F.col("gpx_kind").alias("kind"), F.col("geom.type").alias("type"), F.size(G.vertices("geom")).cast("long").alias("vertices"), v["x"].alias("x"), v["y"].alias("y"))


def shapefile_of(rings: list) -> bytes:
    """A zipped shapefile of polygons (outer rings run clockwise) with a name and a number."""
    bodies = []
    for _, _, v in rings:
        xs, ys = [x for x, _ in v], [y for _, y in v]
        bodies.append(struct.pack("<i4diii", 5, min(xs), min(ys), max(xs), max(ys), 1, len(v), 0) + b"".join(struct.pack("<dd", *p) for p in reversed(v)))
    records = b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    shp = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + records
    column = lambda name, kind, width: name.ljust(11, "\0").encode() + kind.encode() + b"\0" * 4 + bytes([width]) + b"\0" * 15
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rings), 32 + 64 + 1, 1 + 25 + 6) + column("NAME", "C", 25) + column("KEY", "N", 6) + b"\r" + b"".join(f" {n:<25}{k:>6}".encode() for k, n, _ in rings)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("nations.shp", shp)
        z.writestr("nations.dbf", dbf)
    return out.getvalue()


@query(f"WITH {W.NATIONS} SELECT n_name AS name, 'Polygon' AS type, 5::BIGINT AS vertices, x0, y0, x1, y1, CAST(fid AS DOUBLE) AS key FROM nations")
def import_shapefile(s, d):
    back = payload(s, shapefile_of(nation_rings(s, d)), "shapefile")
    return boxes(back, "NAME").join(back.select(F.col("NAME").alias("name"), F.col("KEY").alias("key")), "name")


@query(BOXES)
def import_geopackage(s, d):
    """Blobs of the format around the polygons' binary form; a table of attributes comes first in the file and isn't read."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # on the driver, read and gone here
        db = sqlite3.connect(f.name)
        db.executescript("""CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT);
CREATE TABLE area (fid INTEGER PRIMARY KEY, n_name TEXT, geom BLOB); INSERT INTO gpkg_contents VALUES ('a_notes', 'attributes'), ('area', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('area', 'geom')""")
        head = b"GP\0\x01" + struct.pack("<i", 4326)
        db.executemany("INSERT INTO area VALUES (?, ?, ?)", [(k, n, head + K.to_wkb(K.geometry("Polygon", [[v]]))) for k, n, v in nation_rings(s, d)])
        db.commit()
        db.close()
        data = f.read()
    return boxes(payload(s, data, "gpkg"))


def tiff_of(values: list[list[float]], x0: float, y1: float, size: float) -> bytes:
    """An uncompressed single-band raster of doubles with a place and a size of cells, in one strip."""
    h, w = len(values), len(values[0])
    body = struct.pack(f"<{w * h}d", *(v for row in values for v in row))
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [64]), (259, 3, [1]), (273, 4, [0]), (277, 3, [1]), (279, 4, [len(body)]), (339, 3, [3]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y1, 0.0])]
    at = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    for tag, kind, v in tags:
        if kind == 12:
            entries += struct.pack("<HHII", tag, kind, len(v), at + len(extra))
            extra += struct.pack(f"<{len(v)}d", *v)
        else:
            v = [at + 9 * 8] if tag == 273 else v
            entries += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", v[0], 0) if kind == 3 else struct.pack("<I", v[0]))
    return b"II" + struct.pack("<HIH", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + extra + body


@query("SELECT CAST(n_nationkey % 5 AS INTEGER) AS x, CAST(n_nationkey // 5 AS INTEGER) AS y, CAST(n_regionkey AS DOUBLE) + 0.25 AS value, -10.0::DOUBLE AS left_edge, 12.5::DOUBLE AS top_edge FROM nation")
def import_geotiff(s, d):
    rows = W.read(s, d, "nation").orderBy("n_nationkey").collect()  # 25
    cells, grid = IO.raster_of(s, tiff_of([[rows[y * 5 + x].n_regionkey + 0.25 for x in range(5)] for y in range(5)], -10.0, 12.5, 0.5))
    return cells.select("x", "y", "value", F.lit(float(grid.x0)).alias("left_edge"), F.lit(float(grid.y1)).alias("top_edge"))


# --- a project -------------------------------------------------------------------------------------------------------


@query(f"WITH {W.NATIONS}, {W.SUPPLIERS} SELECT 'nations' AS name, count(*) AS features, 'Polygon' AS type, min(x0) AS x0, max(y1) AS y1, 1::BIGINT AS layers FROM nations UNION ALL SELECT 'suppliers', count(*), 'Point', min(x), max(y), 1 FROM suppliers")
def project_datasets(s, d):
    """Layers go into a project, one is deleted with its layer, and the catalog tells what is there."""
    p = catalog.Project(s, folder(s, "project"))
    for name, df in (("nations", W.nations(s, d)), ("gone", W.nations(s, d)), ("suppliers", W.suppliers(s, d))):
        saved = p.save_dataset(df, name)
        if name == "gone":
            p.delete("datasets", saved["dataset_id"])
    box = F.from_json("bbox", "array<double>")
    t = p.table("datasets").select("id", "name", F.col("feature_count").alias("features"), F.get(F.from_json("geom_types", "array<string>"), F.lit(0)).alias("type"), F.get(box, F.lit(0)).alias("x0"), F.get(box, F.lit(3)).alias("y1"))
    layers = p.table("layers").groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("layers"))
    return t.join(layers, "id").drop("id")


@query(f"WITH {W.SUPPLIERS} SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM suppliers GROUP BY 1")
def project_console(s, d):
    """A dataset of a project, asked by SQL."""
    p = catalog.Project(s, folder(s, "project"))
    key = p.save_dataset(W.suppliers(s, d), "suppliers")["dataset_id"].replace("-", "_")
    return p.query(f"SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM dataset_{key} GROUP BY 1")


@query(f"WITH {W.NATIONS} SELECT n_name AS name, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM nations")
def inline_payload(s, d):
    """A layer that comes as text with the call, and a tool's features of it."""
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in v]]}, "properties": {"name": n}} for _, n, v in nation_rings(s, d)]
    from ..operators import vector as V

    out = V.centroids(IO.from_payload(s, json.dumps({"type": "FeatureCollection", "features": features}))).features
    return out.select("name", r6(F.col("centroid_lng")).alias("x"), r6(F.col("centroid_lat")).alias("y"))
