import base64
import io
import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastrata.functions import geometry as G
from terrastrata.functions import kernels as K
from terrastrata.operators.result import ToolError
from terrastrata.sources import decode as D
from terrastrata.sources import read as IO

from .shapes import layer, line, point, square


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": p} for g, p in features]})


PAIR = collection(({"type": "Point", "coordinates": [1.5, 2]}, {"city": "a", "pop": 5, "on": True, "tags": [1]}), ({"type": "Point", "coordinates": [3, 4, 9]}, {"city": "b", "pop": None}))


def test_geojson(spark, tmp_path):
    df = IO.from_payload(spark, PAIR)
    rows = df.orderBy("_fid").collect()
    assert [(r.city, r.pop, r.on, r.tags) for r in rows] == [("a", 5.0, True, "[1]"), ("b", None, None, None)] and rows[1].geom.parts[0][0][0].z == 9
    assert IO.from_payload(spark, '{"type":"Point","coordinates":[1,2]}').first().geom.type == "Point"
    lines = '{"type":"Feature","id":7,"geometry":null,"properties":{"a":1}}\n\n{"type":"Feature","id":8,"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":2}}\n'
    assert [(r._id, r.a) for r in IO.from_payload(spark, lines).orderBy("_fid").collect()] == [(7.0, 1.0), (8.0, 2.0)]
    for bad in ("hello", "{", "", "{\n}", '{"type":"FeatureCollection","features":[]}'):
        with pytest.raises((D.FormatError, ToolError)):
            IO.from_payload(spark, bad)
    for n in range(2):
        (tmp_path / f"{n}.geojson").write_text(PAIR)
    assert sorted(r._fid for r in IO.read_vector(spark, f"{tmp_path}/*.geojson", "geojson").collect()) == [0, 1, 2, 3]


def test_every_geometry_goes_to_geojson_and_back(spark):
    gs = [point(1, 2), line((0, 0), (1, 1.5)), square(0, 0, 1), K.geometry("MultiPoint", [[[(1, 2)]], [[(3, 4)]]]), K.geometry("MultiLineString", [[[(0, 0), (1, 1)]], [[(2, 2), (3, 3)]]]), K.geometry("MultiPolygon", [[[(0, 0), (1, 0), (1, 1), (0, 0)], [(0.5, 0.1), (0.6, 0.1), (0.6, 0.2), (0.5, 0.1)]]]), K.geometry("GeometryCollection", None, [point(1, 2), line((0, 0), (1, 1))])]
    df = layer(spark, [(g, "x", 1.5) for g in gs], "a string, b double")
    rows = [json.loads(r.line) for r in IO.geojson_rows(df).orderBy("_fid").collect()]
    assert [D.json_geometry(r["geometry"]) for r in rows] == gs and rows[0]["properties"] == {"a": "x", "b": 1.5}
    assert [D.json_geometry(D.to_json_geometry(g)) for g in gs] == gs
    texts = IO.wkt_rows(df).orderBy("_fid").collect()
    assert texts[0].line == "POINT (1 2)" and texts[5].line == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0.5 0.1, 0.6 0.1, 0.6 0.2, 0.5 0.1)))" and len(texts) == 6
    back = IO.wkt_features(spark.createDataFrame([(i, t.line) for i, t in enumerate(texts)], "_row long, value string")).orderBy("_fid").collect()
    assert [r.geom.asDict(True) for r in back] == gs[:6]
    assert [K.from_wkb(K.to_wkb(g)) for g in gs] == gs


def test_wkt_and_csv(spark):
    lines = spark.createDataFrame([(0, "# note"), (1, " "), (2, "point(12.5 55.6)"), (3, "MULTIPOINT (1 2, (3 4))"), (4, "POINT EMPTY"), (5, "GEOMETRYCOLLECTION (POINT (1 2))"), (6, "POINT (a b)")], "_row long, value string")
    assert [(r._fid, r.geom.type, len(r.geom.parts)) for r in IO.wkt_features(lines).orderBy("_fid").collect()] == [(2, "Point", 1), (3, "MultiPoint", 2)]
    t = spark.createDataFrame([(0, "1", "2", "x,y"), (1, "bad", "2", "z")], "_row long, Latitude string, lon string, name string")
    df = IO.csv_points(t)
    assert df.count() == 1 and IO.csv_header(df) == "feature_id,geometry_type,centroid_lng,centroid_lat,Latitude,lon,name"
    assert IO.csv_rows(df).first().line == '1,Point,2,1,1,2,"x,y"'
    assert IO.attribute_rows(df.select("_fid", "geom", "name")).first().line == '"x,y"'


def shp(kind, bodies):
    records = b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8) + records


def ring_body(*rings):
    n = sum(map(len, rings))
    starts = np.cumsum([0, *map(len, rings[:-1])])
    return struct.pack("<i4dii", 5, 0, 0, 9, 9, len(rings), n) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for r in rings for p in r)


def test_shapefile():
    pts = shp(1, [struct.pack("<idd", 1, 1.0, 2.0), struct.pack("<idd", 1, 3.0, 4.0)])
    assert [g["parts"][0][0][0]["x"] for g, _ in D.shapefile(pts)] == [1.0, 3.0]
    outer, hole, other = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]
    got = [g for g, _ in D.shapefile(shp(5, [ring_body(outer, hole), ring_body(outer, other)]))]
    assert [(g["type"], [len(p) for p in g["parts"]]) for g in got] == [("Polygon", [2]), ("MultiPolygon", [1, 1])]
    head = struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 32 + 64 + 1, 1 + 5 + 8) + b"NAME\0\0\0\0\0\0\0C\0\0\0\0\x05\0" + b"\0" * 14 + b"DAY\0\0\0\0\0\0\0\0D\0\0\0\0\x08\0" + b"\0" * 14 + b"\r"
    table = head + b" one  20240102" + b" two  20240103"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("data/x.shp", pts)
        f.writestr("data/x.dbf", table)
        f.writestr("__MACOSX/y.shp", b"")
    assert [p for _, p in D.shapefile(z.getvalue())] == [{"NAME": "one", "DAY": "2024-01-02"}, {"NAME": "two", "DAY": "2024-01-03"}]
    with pytest.raises(D.FormatError):
        list(D.shapefile(b"nothing"))


KML = b"""<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>A</name><ExtendedData><Data name="owner"><value>me</value></Data><SchemaData><SimpleData name="k">v</SimpleData></SchemaData></ExtendedData><Point><coordinates>1,2,30</coordinates></Point></Placemark>
<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>0,0 1,1</coordinates></LineString></MultiGeometry></Placemark></Document></kml>"""
GPX = b"""<gpx><wpt lat="1" lon="2"><name>w</name><ele>5</ele></wpt><trk><name>t</name><trkseg><trkpt lat="0" lon="0"/><trkpt lat="1" lon="1"/><trkpt lat="2" lon="1"/></trkseg><trkseg><trkpt lat="0" lon="0"/></trkseg></trk><rte><rtept lat="0" lon="0"/><rtept lat="1" lon="0"/></rte></gpx>"""


def test_xml_formats(spark):
    got = list(D.kml(KML))
    assert [g["type"] for g, _ in got] == ["Point", "Polygon", "GeometryCollection"] and got[0][1] == {"name": "A", "owner": "me", "k": "v"} and len(got[2][0]["members"]) == 2
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("other.kml", b"<kml/>")
        f.writestr("doc.kml", KML)
    assert len(list(D.kmz(z.getvalue()))) == 3
    assert [(g["type"], p["gpx_kind"]) for g, p in D.gpx(GPX)] == [("Point", "waypoint"), ("LineString", "track"), ("LineString", "route")]
    with pytest.raises(D.FormatError):
        list(D.kml(b"<kml><open>"))
    df = IO.from_payload(spark, KML.decode(), "kml")
    assert df.count() == 3 and df.where("owner = 'me'").count() == 1


def test_geopackage(spark, tmp_path):
    path = tmp_path / "x.gpkg"
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, identifier TEXT, srs_id INT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT); CREATE TABLE pts (fid INTEGER PRIMARY KEY, label TEXT, raw BLOB, geom BLOB); INSERT INTO gpkg_contents VALUES ('pts','features','pts',4326); INSERT INTO gpkg_geometry_columns VALUES ('pts','geom','POINT',4326);")
    blob = b"GP\0\x01" + struct.pack("<i", 4326) + K.to_wkb(point(7, 8))
    db.executemany("INSERT INTO pts VALUES (?, ?, ?, ?)", [(1, "a", b"x", blob), (2, "b", None, b"junk")])
    db.commit()
    db.close()
    rows = IO.read_vector(spark, str(path)).orderBy("_fid").collect()
    assert [(r.label, r.fid, r.geom and r.geom.parts[0][0][0].x) for r in rows] == [("a", 1.0, 7.0), ("b", 2.0, None)]
    assert IO.from_payload(spark, base64.b64encode(path.read_bytes()).decode(), "gpkg").count() == 2
    with pytest.raises(ToolError):
        IO.read_vector(spark, "x.docx")


def tiff(values, order="<", compression=1, kind=1):
    h, w = values.shape
    body = values.astype(f"{order}{'uif'[kind - 1]}{values.itemsize}").tobytes()
    entries = [(256, 3, w), (257, 3, h), (258, 3, values.itemsize * 8), (259, 3, compression), (273, 4, 8 + 2 + 12 * 8 + 4), (277, 3, 1), (279, 4, len(body)), (339, 3, kind)]
    ifd = struct.pack(order + "H", len(entries))
    for tag, t, v in entries:
        ifd += struct.pack(order + "HHI", tag, t, 1) + (struct.pack(order + "HH", v, 0) if t == 3 else struct.pack(order + "I", v))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + ifd + struct.pack(order + "I", 0) + body


def test_geotiff(spark):
    for order in "<>":
        for dtype, kind in (("uint16", 1), ("int16", 2), ("float32", 3), ("float64", 3), ("uint8", 1), ("int32", 2)):
            want = (np.arange(16).reshape(4, 4) - (5 if kind > 1 else 0)).astype(dtype)
            got, extent, nodata = D.geotiff(tiff(want, order, kind=kind))
            assert (got == want).all() and extent == (0, 0, 1, 1) and nodata is None
    cells, grid = IO.raster_of(spark, tiff(np.arange(16, dtype="uint16").reshape(4, 4)))
    assert (grid.width, grid.height) == (4, 4) and cells.where("x = 3 and y = 1").first().value == 7
    for bad in (tiff(np.zeros((2, 2), "uint8"), compression=5), b"no tiff"):
        with pytest.raises(D.FormatError):
            D.geotiff(bad)


def test_blobs():
    assert K.from_gpkg(None) is None and K.from_gpkg(b"GP\0\x10" + b"\0" * 20) is None and K.from_wkb(b"\x01\x01") is None
    z = struct.pack("<BI3d", 1, 0x80000001, 1, 2, 3)
    iso = struct.pack(">BI3d", 0, 1001, 1, 2, 3)
    assert K.from_wkb(z) == K.from_wkb(iso) == point(1, 2)


def test_files_of_lines(spark, tmp_path):
    df = layer(spark, [(point(i, i), f"n{i}") for i in range(5)], "name string")
    IO.write_lines(IO.wkt_rows(df), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 5
    assert IO.read_vector(spark, f"{tmp_path}/out", "wkt").select(F.max(G.first_vertex("geom")["x"])).first()[0] == 4


def test_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text('fid,label\r\n1,"a ""b"", c"\r\n\r\n2,x\r\n')
    t = IO.read_table(spark, f"{tmp_path}/t.csv")
    assert [(r.fid, r.label) for r in t.orderBy("_row").collect()] == [("1", 'a "b", c'), ("2", "x")]
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        IO.read_table(spark, f"{tmp_path}/r.csv").collect()


def test_feature_collection_out_and_in(spark, tmp_path):
    df = layer(spark, [(point(i, -i), f"n{i}", f"id {i}") for i in range(5)], "name string, _id string").repartition(3)
    IO.write_feature_collection(df, f"{tmp_path}/one")
    (part,) = [p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-")]
    doc = json.loads(part.read_text())
    assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == [f"id {i}" for i in range(5)] and doc["features"][2]["properties"] == {"name": "n2"}
    IO.write_lines(IO.geojson_rows(df), f"{tmp_path}/many")
    for folder in ("one", "many"):
        back = IO.read_vector(spark, f"{tmp_path}/{folder}/part-*", "geojson").orderBy("name").collect()
        assert [(r.name, r._id, r.geom.parts[0][0][0].y) for r in back] == [(f"n{i}", f"id {i}", -float(i)) for i in range(5)]


def test_folders_of_rasters(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.tif").write_bytes(tiff(np.arange(4 + 2 * n, dtype="uint16").reshape(2, 2 + n) + n))
    cells, grids = IO.read_rasters(spark, f"{tmp_path}/*.tif")
    assert sorted((g.width, g.height) for g in grids.values()) == [(2, 2), (3, 2), (4, 2)] and cells.count() == 18 and cells.agg(F.sum("value")).first()[0] == sum(range(4)) + sum(range(1, 7)) + sum(range(2, 10))
    with pytest.raises(ToolError):
        IO.read_raster(spark, f"{tmp_path}/*.tif")
    assert IO.read_raster(spark, f"{tmp_path}/1.tif")[1].width == 3


def test_quoted_line_breaks_in_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('lat,lon,note\n1,2,"two\nlines"\n3,4,x\n')
    assert sorted(r.note for r in IO.read_vector(spark, f"{tmp_path}/p.csv", "csv").collect()) == ["two\nlines", "x"]
