"""Decoders of vector and raster files: each takes a file's bytes (and name) and yields features as (geometry, properties)."""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np

from ..functions.kernels import from_gpkg, geometry, signed_area

Feature = tuple[dict | None, dict]


class FormatError(ValueError):
    """A file isn't what it should be."""


# --- GeoJSON ---------------------------------------------------------------------------------------------------------


def json_geometry(g: dict | None) -> dict | None:
    if g is None:
        return None
    kind, c = g.get("type"), g.get("coordinates")
    if kind == "GeometryCollection":
        inner = [json_geometry(m) for m in g.get("geometries", [])]
        return geometry(kind, None, [y for x in inner if x for y in (x["members"] or [x])])
    wrap = {"Point": lambda: [[[c]]], "MultiPoint": lambda: [[[p]] for p in c], "LineString": lambda: [[c]], "MultiLineString": lambda: [[r] for r in c], "Polygon": lambda: [c], "MultiPolygon": lambda: c}
    if kind not in wrap:
        raise FormatError(f"no geometry type {kind}")
    return geometry(kind, wrap[kind]() if c else [])


def geojson(data: bytes, name: str = "") -> Iterator[Feature]:
    """A feature collection, a feature or a bare geometry; or such documents a line each. A feature's id is its property _id, unless it has one of that name."""
    try:
        docs = [json.loads(data)]
    except ValueError as e:
        lines = data.split(b"\n")
        try:
            docs = [json.loads(x) for x in (line.strip(b" \t\r\x1e") for line in lines) if x] if len(lines) > 1 else []
        except ValueError:
            docs = []
        if not docs:
            raise FormatError(f"not GeoJSON: {e}") from e
    for doc in docs:
        if not isinstance(doc, dict) or "type" not in doc:
            raise FormatError("not GeoJSON")
        features = doc.get("features", []) if doc["type"] == "FeatureCollection" else [doc] if doc["type"] == "Feature" else [{"geometry": doc, "properties": {}}]
        for f in features:
            props = dict(f.get("properties") or {})
            if f.get("id") is not None:
                props = {"_id": f["id"]} | props
            yield json_geometry(f.get("geometry")), props


def to_json_geometry(g: dict | None) -> dict | None:
    if g is None:
        return None
    at = lambda v: [v["x"], v["y"]] if v["z"] is None else [v["x"], v["y"], v["z"]]
    if g["type"] == "GeometryCollection":
        return {"type": g["type"], "geometries": [to_json_geometry({**m, "members": None}) for m in g["members"]]}
    rings = [[[at(v) for v in r] for r in p] for p in g["parts"]]
    unwrap = {"Point": lambda: rings[0][0][0] if rings else [], "MultiPoint": lambda: [p[0][0] for p in rings], "LineString": lambda: rings[0][0], "MultiLineString": lambda: [p[0] for p in rings], "Polygon": lambda: rings[0], "MultiPolygon": lambda: rings}
    return {"type": g["type"], "coordinates": unwrap[g["type"]]()}


# --- Shapefile -------------------------------------------------------------------------------------------------------


def dbf(data: bytes) -> list[dict]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        pos, row = head + i * size + 1, {}
        for name, kind, width in fields:
            text = data[pos : pos + width].decode("utf-8", "replace").strip()
            pos += width
            if kind in "NF":
                try:
                    row[name] = float(text)
                except ValueError:
                    row[name] = None
            elif kind == "L":
                row[name] = {"t": True, "y": True, "f": False, "n": False}.get(text.lower())
            elif kind == "D":
                row[name] = f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 else None
            else:
                row[name] = text
        out.append(row)
    return out


def shape(body: bytes) -> dict | None:
    """A record's geometry; rings are grouped by their turn: clockwise ones are outer, the others their holes."""
    kind = struct.unpack_from("<i", body)[0]
    flat, has_z = kind % 10, kind // 10 == 1
    if kind == 0:
        return geometry("GeometryCollection", None, [])
    if flat == 1:
        return geometry("Point", [[[struct.unpack_from("<ddd" if has_z else "<dd", body, 4)]]])
    if flat == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        xy, at = np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2), 40 + 16 * n
        z = np.frombuffer(body, "<f8", n, at + 16) if has_z else [None] * n
        return geometry("MultiPoint", [[[(x, y, t)]] for (x, y), t in zip(xy, z, strict=True)])
    if flat not in (3, 5):
        return None
    parts, n = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    at = 44 + 4 * parts
    xy = np.frombuffer(body, "<f8", 2 * n, at).reshape(n, 2).tolist()
    z = np.frombuffer(body, "<f8", n, at + 16 * n + 16).tolist() if has_z else [None] * n
    rings = [[(x, y, t) for (x, y), t in zip(xy[a:b], z[a:b], strict=True)] for a, b in zip(starts, starts[1:], strict=False)]
    if flat == 3:
        return geometry("LineString" if parts == 1 else "MultiLineString", [[r] for r in rings])
    rings = [r if r[0][:2] == r[-1][:2] else [*r, r[0]] for r in rings if r]
    polygons: list[list] = []
    holes = []
    for r in rings:
        (polygons.append([r]) if signed_area([p[:2] for p in r]) <= 0 else holes.append(r))
    if not polygons:
        polygons, holes = [[r] for r in holes], []
    from ..functions.kernels import inside_any

    for hole in holes:
        around = [p for p in polygons if inside_any(np.array([hole[0][:2]]), [[[q[:2] for q in p[0]]]])[0]]
        (around[0] if around else polygons[-1]).append(hole)
    return geometry("Polygon" if len(polygons) == 1 else "MultiPolygon", polygons)


def shapefile(data: bytes, name: str = "") -> Iterator[Feature]:
    """A .shp, or a ZIP with one (the last if several) and its .dbf; without a readable .dbf features have no attributes."""
    table: list[dict] = []
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = {n.lower(): n for n in z.namelist() if "__macosx" not in n.lower() and not os.path.basename(n).startswith(".")}
            shps, dbfs = [n for n in inside if n.endswith(".shp")], [n for n in inside if n.endswith(".dbf")]
            if not shps:
                raise FormatError("the archive has no .shp")
            data = z.read(inside[shps[-1]])
            if dbfs:
                try:
                    table = dbf(z.read(inside[dbfs[-1]]))
                except (struct.error, IndexError):
                    table = []
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise FormatError("not a shapefile")
    at, i = 100, 0
    while at + 8 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        if (g := shape(data[at + 8 : at + 8 + 2 * words])) is not None:
            yield g, dict(table[i]) if i < len(table) else {}
        at, i = at + 8 + 2 * words, i + 1


# --- XML: KML, KMZ, GPX ----------------------------------------------------------------------------------------------


def tree(data: bytes) -> ET.Element:
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise FormatError(f"not XML: {e}") from e
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""
    return root


def text_of(e: ET.Element, tag: str) -> str | None:
    c = e.find(tag)
    return c.text.strip() if c is not None and c.text and c.text.strip() else None


def kml_geometry(e: ET.Element) -> dict | None:
    def run(x: ET.Element | None) -> list:
        c = None if x is None else x.find(".//coordinates")
        return [tuple(map(float, p.split(",")[:2])) for p in (c.text or "").split()] if c is not None else []

    if e.tag == "point":
        return geometry("Point", [[run(e)[:1]]]) if run(e) else None
    if e.tag == "linestring":
        return geometry("LineString", [[run(e)]]) if run(e) else None
    if e.tag == "polygon":
        outer = run(e.find("outerboundaryis"))
        return geometry("Polygon", [[outer, *(run(x) for x in e.findall("innerboundaryis"))]]) if outer else None
    if e.tag == "multigeometry":
        inner = [x for k in ("point", "linestring", "polygon", "multigeometry") for c in e.findall(k) if (x := kml_geometry(c))]
        return geometry("GeometryCollection", None, [y for x in inner for y in (x["members"] or [x])])
    return None


def kml(data: bytes, name: str = "") -> Iterator[Feature]:
    for p in tree(data).iter("placemark"):
        props = {k: v for k in ("name", "description") if (v := text_of(p, k)) is not None}
        for d in p.iterfind("extendeddata//data"):
            props[d.get("name") or ""] = text_of(d, "value")
        for d in p.iterfind("extendeddata//simpledata"):
            props[d.get("name") or ""] = (d.text or "").strip()
        for k in ("point", "linestring", "polygon", "multigeometry"):
            for e in p.findall(k):
                if g := kml_geometry(e):
                    yield g, dict(props)


def kmz(data: bytes, name: str = "") -> Iterator[Feature]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
        pick = next((n for n in names if os.path.basename(n).lower() == "doc.kml"), next((n for n in names if "metadata" not in n.lower()), None))
        if pick is None:
            raise FormatError("the archive has no .kml")
        yield from kml(z.read(pick))


def gpx(data: bytes, name: str = "") -> Iterator[Feature]:
    root = tree(data)
    at = lambda e: (float(e.get("lon")), float(e.get("lat")))
    props = lambda e, kind: {k: v for k in ("name", "desc", "sym", "type", "time") if (v := text_of(e, k)) is not None} | {"gpx_kind": kind}
    for e in root.iter("wpt"):
        yield geometry("Point", [[[at(e)]]]), props(e, "waypoint")
    for t in root.iter("trk"):
        for s in t.iter("trkseg"):
            if len(ps := [at(p) for p in s.iter("trkpt")]) >= 2:
                yield geometry("LineString", [[ps]]), props(t, "track")
    for t in root.iter("rte"):
        if len(ps := [at(p) for p in t.iter("rtept")]) >= 2:
            yield geometry("LineString", [[ps]]), props(t, "route")


# --- GeoPackage ------------------------------------------------------------------------------------------------------


def gpkg(data: bytes, name: str = "") -> Iterator[Feature]:
    """The first feature table by name; only integer, real and text attributes."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # read and gone within the task
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            found = db.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY c.table_name LIMIT 1").fetchone()
            if not found:
                raise FormatError("there is no feature table")
            quoted = found[0].replace('"', '""')
            rows = db.execute(f'SELECT * FROM "{quoted}"')
            names = [d[0] for d in rows.description]
            for row in rows:
                values = dict(zip(names, row, strict=True))
                blob = values.pop(found[1], None)
                yield from_gpkg(blob), {k: v for k, v in values.items() if isinstance(v, int | float | str)}
        except sqlite3.DatabaseError as e:
            raise FormatError(f"not a GeoPackage: {e}") from e
        finally:
            db.close()


# --- GeoTIFF ---------------------------------------------------------------------------------------------------------

SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}


def geotiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """(values by row from the north, extent, no-data value) of an uncompressed single-band file in strips; without a georeference the extent is the unit square."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise FormatError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        form = SIZES.get(kind)
        if form is None:
            continue
        size = struct.calcsize("=" + form) * n
        pos = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * i + 8)[0]
        tags[tag] = [data[pos : pos + n]] if kind == 2 else list(struct.unpack_from(order + form * n, data, pos))
    get = lambda tag, other: tags.get(tag, [other])[0]
    if get(259, 1) != 1:
        raise FormatError("compressed files can't be read")
    if get(277, 1) != 1 or 273 not in tags:
        raise FormatError("only files of one band in strips can be read")
    w, h, bits, kind = get(256, 0), get(257, 0), get(258, 8), get(339, 1)
    code = {1: "u", 2: "i", 3: "f"}.get(kind, "u")
    if (code, bits) not in {("u", 8), ("i", 8), ("u", 16), ("i", 16), ("u", 32), ("i", 32), ("f", 32), ("f", 64)}:
        raise FormatError(f"{bits} bits of sample kind {kind} can't be read")
    counts = tags.get(279, [w * h * bits // 8])
    body = b"".join(data[o : o + n] for o, n in zip(tags[273], counts, strict=True))
    values = np.frombuffer(body, f"{order}{code}{bits // 8}", w * h).astype(np.float64).reshape(h, w)
    extent = (0.0, 0.0, 1.0, 1.0)
    if 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        extent = (x - i * sx, y + j * sy - h * sy, x - i * sx + w * sx, y + j * sy)
    nodata = None
    if 42113 in tags:
        try:
            nodata = float(tags[42113][0].split(b"\0")[0])
        except ValueError:
            nodata = None
    return values, extent, nodata


DECODERS = {"geojson": geojson, "shapefile": shapefile, "kml": kml, "kmz": kmz, "gpx": gpx, "gpkg": gpkg}
SUFFIXES = {".shp": "shapefile", ".zip": "shapefile", ".kml": "kml", ".kmz": "kmz", ".gpx": "gpx", ".gpkg": "gpkg", ".geojson": "geojson", ".json": "geojson", ".txt": "geojson", ".tif": "geotiff", ".tiff": "geotiff"}
