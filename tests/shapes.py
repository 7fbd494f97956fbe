"""Small layers for tests."""

from terrastrata.functions import kernels as K
from terrastrata.functions.geometry import GEOM


def layer(spark, rows, attributes=""):
    """rows: (geometry, *attributes); attributes: a DDL list."""
    data = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"_fid long, geom {GEOM}" + (f", {attributes}" if attributes else ""))


def point(x, y):
    return K.geometry("Point", [[[(x, y)]]])


def line(*ps):
    return K.geometry("LineString", [[list(ps)]])


def square(x, y, s):
    return K.geometry("Polygon", [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]])


def area(ps):
    return sum(abs(K.signed_area([(v["x"], v["y"]) for v in p[0]])) - sum(abs(K.signed_area([(v["x"], v["y"]) for v in r])) for r in p[1:]) for p in ps)
