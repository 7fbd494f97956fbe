"""The registered queries of the spatial operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import interpolation as I
from ..operators import joins as J
from ..operators import network as N
from ..operators import overlay as O
from ..operators import raster as R
from ..operators import statistics as S
from ..operators import vector as V
from ..sources import read as IO
from . import catalog, reports
from . import views as W
from .views import sql_haversine as hav
from .views import sql_round as rnd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- layers and catalog ----------------------------------------------------------------------------------------------


@query(f"WITH {W.CUSTOMERS} SELECT min(x) AS min_lng, min(y) AS min_lat, max(x) AS max_lng, max(y) AS max_lat, max(x) - min(x) AS width_deg, max(y) - min(y) AS height_deg FROM customers")
def layer_bbox(s, d):
    return V.boxes(W.customers(s, d)).features.drop("_fid", "geom", "name")


@query("SELECT 'LineString' AS geom_type UNION ALL SELECT 'Point' UNION ALL SELECT 'Polygon'")
def geom_type_set(s, d):
    kinds = [df.select(F.col("geom.type").alias("geom_type")) for df in (W.customers(s, d), W.nations(s, d), W.user_lines(s, d))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct()


@query("SELECT 'k' AS name, 'number' AS field_type, (SELECT json_extract_string(props, '$.k') FROM events ORDER BY event_id LIMIT 1) AS sample_value")
def schema_inference(s, d):
    e = W.read(s, d, "events")
    return IO.schema_of(e.select(F.lit("events").alias("file"), F.col("event_id").alias("n"), F.from_json("props", "map<string,string>").alias("props")))


@query("SELECT count(*) AS n, (SELECT count(*) FROM supplier) AS m, (SELECT count(*) FROM nation) AS k FROM customer")
def store_stats(s, d):
    tables = {"n": W.customers(s, d), "m": W.suppliers(s, d), "k": W.nations(s, d)}
    return catalog.counts(tables)


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def history_topk(s, d):
    return W.read(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id", "event_type", "value")


JOIN = "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
UNION = "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region EXCEPT SELECT 'AFRICA'"
WINDOW = "WITH t AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) SELECT s_suppkey, s_nationkey, s_acctbal FROM t WHERE n <= 2"


def console(s: SparkSession, d: str, text: str) -> DataFrame:
    return catalog.sql_console(s, text, {t: W.read(s, d, t) for t in ("customer", "nation", "region", "supplier")})


@query(JOIN)
def sql_console_join(s, d):
    return console(s, d, JOIN)


@query(UNION)
def sql_console_union(s, d):
    return console(s, d, UNION)


@query(WINDOW)
def sql_console_window(s, d):
    return console(s, d, WINDOW)


# --- filters ---------------------------------------------------------------------------------------------------------


@query(f"WITH {W.CUSTOMERS} SELECT fid, c_acctbal FROM customers WHERE c_acctbal >= 5000")
def attr_filter_num(s, d):
    return J.spatial_query(W.customers(s, d), "c_acctbal", ">=", "5000").features.select(F.col("_fid").alias("fid"), "c_acctbal")


@query("SELECT CAST(c_custkey AS BIGINT) AS fid FROM customer WHERE lower(c_mktsegment) = 'building'")
def attr_filter_str_ci(s, d):
    return J.spatial_query(W.customers(s, d), "c_mktsegment", "=", "Building").features.select(F.col("_fid").alias("fid"))


@query("SELECT CAST(c_custkey AS BIGINT) AS fid FROM customer WHERE contains(lower(c_mktsegment), 'ma')")
def attr_filter_contains(s, d):
    return J.spatial_query(W.customers(s, d), "c_mktsegment", "contains", "MA").features.select(F.col("_fid").alias("fid"))


PIP = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT c.fid FROM customers c JOIN nations n ON {PIP} WHERE n_regionkey = 1 AND c_acctbal > 0")
def spatial_query_mask(s, d):
    mask = W.nations(s, d).where("n_regionkey = 1")
    return J.spatial_query(W.customers(s, d), "c_acctbal", ">", "0", mask).features.select(F.col("_fid").alias("fid"))


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT count(*) AS input_features, count(n.fid) AS matched_features, {rnd('(count(n.fid) * 100.0::DOUBLE / count(*))', 1)} AS match_rate_percent FROM customers c LEFT JOIN nations n ON {PIP} AND n_regionkey = 1")
def spatial_query_summary(s, d):
    return J.spatial_query(W.customers(s, d), mask=W.nations(s, d).where("n_regionkey = 1")).summary.select("input_features", "matched_features", "match_rate_percent")


@query("SELECT CAST(c_custkey AS BIGINT) AS fid FROM customer WHERE contains(lower(c_name), '00012') OR contains(CAST(c_nationkey AS VARCHAR), '00012') OR contains(lower(c_mktsegment), '00012')")
def free_text_search(s, d):
    return J.free_text(W.customers(s, d).drop("c_acctbal"), "00012").select(F.col("_fid").alias("fid"))


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT c.fid, n.fid AS nation FROM customers c JOIN nations n ON {PIP}")
def pip_exact(s, d):
    c = W.customers(s, d)
    return J.point_in_parts(c, W.nations(s, d), F.col("geom.parts")[0][0][0]["x"], F.col("geom.parts")[0][0][0]["y"]).select(F.col("_fid").alias("fid"), F.col("p_fid").alias("nation"))


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT c.fid, n.fid AS nation FROM customers c JOIN nations n ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def pip_strict(s, d):
    c = W.customers(s, d)
    v = G.first_vertex("geom")
    return J.point_in_parts(c, W.nations(s, d), v["x"], v["y"], strict=True).select(F.col("_fid").alias("fid"), F.col("p_fid").alias("nation"))


# --- single features -------------------------------------------------------------------------------------------------

r6 = lambda c: F.round(c, 6)


OFF_POLES = "least(89.9::DOUBLE, greatest(-89.9::DOUBLE, {}))"
RING = f"""SELECT fid, CAST(i AS INTEGER) AS i, round(x + 50000.0::DOUBLE / (111320.0::DOUBLE * greatest(0.001::DOUBLE, abs(cos(radians(y))))) * cos(2 * pi() * (i % 16) / 16), 6) AS x,
round({OFF_POLES.format("y + 50000.0::DOUBLE / 111320.0::DOUBLE * sin(2 * pi() * (i % 16) / 16)")}, 6) AS y FROM p, range(0, 17) AS t(i)"""


def ring_rows(df):
    b = V.buffer(df).features.select(F.col("_fid").alias("fid"), F.posexplode(G.vertices("geom")).alias("i", "v"))
    return b.select("fid", "i", r6(F.col("v.x")).alias("x"), r6(F.col("v.y")).alias("y"))


@query(f"WITH {W.SUPPLIERS}, p AS (SELECT fid, x, y FROM suppliers) {RING}")
def buffer_point_ring(s, d):
    return ring_rows(W.suppliers(s, d))


# All places moved to within a degree of a pole.
POLAR = "CASE WHEN y < 0 THEN -90.0::DOUBLE - y / 100 - 0.05::DOUBLE ELSE 90.0::DOUBLE - y / 100 + 0.05::DOUBLE END"


def polar(y):
    return F.when(y < 0, F.lit(-90.0) - y / 100 - F.lit(0.05)).otherwise(F.lit(90.0) - y / 100 + F.lit(0.05))


@query(f"WITH {W.SUPPLIERS}, p AS (SELECT fid, x, {POLAR} AS y FROM suppliers) {RING}")
def buffer_polar_ring(s, d):
    v = G.first_vertex("geom")
    return ring_rows(W.suppliers(s, d).select("_fid", G.point(v["x"], polar(v["y"])).alias("geom")))


def sql_offsets(y: str) -> str:
    return f"""e AS (SELECT fid, n, x, {y} AS y FROM ev), w AS (SELECT fid, n, x, y, coalesce(lag(x) OVER o, x) AS ax, coalesce(lag(y) OVER o, y) AS ay, coalesce(lead(x) OVER o, x) AS bx, coalesce(lead(y) OVER o, y) AS b_y, count(*) OVER (PARTITION BY fid) AS c FROM e WINDOW o AS (PARTITION BY fid ORDER BY n)),
q AS (SELECT *, 111320.0::DOUBLE * greatest(0.001::DOUBLE, abs(cos(radians(y)))) AS mx FROM w WHERE c > 1),
v AS (SELECT *, (bx - ax) * mx AS dx, (b_y - ay) * 111320.0::DOUBLE AS dy FROM q), u AS (SELECT *, greatest(1e-6::DOUBLE, sqrt(dx * dx + dy * dy)) AS len FROM v)"""


def sql_side(sign: str) -> str:
    moved = OFF_POLES.format(f"y {sign} 1000.0::DOUBLE * dx / len / 111320.0::DOUBLE")
    return f"round(x {sign} 1000.0::DOUBLE * (-dy) / len / mx, 6) AS x, round({moved}, 6) AS y"


@query(f"WITH {W.EVENTS}, {sql_offsets('y')} SELECT fid, CAST(n - 1 AS INTEGER) AS i, {sql_side('+')} FROM u")
def buffer_line_offsets(s, d):
    """The left side of each buffered line."""
    lines = W.user_lines(s, d).withColumn("n", F.size(G.vertices("geom")))
    b = V.buffer(lines, 1000.0).features.where("n > 1").select(F.col("_fid").alias("fid"), "n", F.posexplode(G.vertices("geom")).alias("i", "v"))
    return b.where("i < n").select("fid", "i", r6(F.col("v.x")).alias("x"), r6(F.col("v.y")).alias("y"))


@query(f"WITH {W.EVENTS}, {sql_offsets(POLAR)}, r AS (SELECT fid, c, n, {sql_side('+')} FROM u UNION ALL SELECT fid, c, 2 * c + 1 - n, {sql_side('-')} FROM u UNION ALL SELECT fid, c, 2 * c + 1, {sql_side('+')} FROM u WHERE n = 1) SELECT fid, CAST(n - 1 AS INTEGER) AS i, x, y FROM r")
def buffer_polar_lines(s, d):
    """The whole ring of each buffered line, near the poles."""
    vs = F.transform(G.vertices("geom"), lambda v: G.vertex(v["x"], polar(v["y"])))
    lines = W.user_lines(s, d).where(F.size(G.vertices("geom")) > 1).select("_fid", G.line(vs).alias("geom"))
    b = V.buffer(lines, 1000.0).features.select(F.col("_fid").alias("fid"), F.posexplode(G.vertices("geom")).alias("i", "v"))
    return b.select("fid", "i", r6(F.col("v.x")).alias("x"), r6(F.col("v.y")).alias("y"))


@query(f"WITH {W.NATIONS} SELECT fid, round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y FROM nations")
def centroid_polygon(s, d):
    return V.centroids(W.nations(s, d)).features.select(F.col("_fid").alias("fid"), r6(F.col("centroid_lng")).alias("x"), r6(F.col("centroid_lat")).alias("y"))


@query(f"WITH {W.EVENTS} SELECT fid, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM ev GROUP BY fid")
def centroid_line(s, d):
    return V.centroids(W.user_lines(s, d)).features.select(F.col("_fid").alias("fid"), r6(F.col("centroid_lng")).alias("x"), r6(F.col("centroid_lat")).alias("y"))


@query(f"WITH {W.NATIONS} SELECT fid, round((3 * x0 + 2 * x1) / 5, 6) AS x, round((3 * y0 + 2 * y1) / 5, 6) AS y FROM nations")
def vertex_mean_centroid(s, d):
    return S.centres(W.nations(s, d)).select(F.col("_fid").alias("fid"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"WITH {W.EVENTS} SELECT fid, min(x) AS bbox_min_lng, min(y) AS bbox_min_lat, max(x) AS bbox_max_lng, max(y) AS bbox_max_lat FROM ev GROUP BY fid")
def bbox_per_feature(s, d):
    return V.boxes(W.user_lines(s, d), True).features.select(F.col("_fid").alias("fid"), "bbox_min_lng", "bbox_min_lat", "bbox_max_lng", "bbox_max_lat")


LENGTH = f"sum({hav('x1', 'y1', 'x2', 'y2')})"


@query(f"WITH {W.SEGMENTS} SELECT fid, {rnd(f'({LENGTH} / 1000)', 3)} AS length_km, {rnd(f'({LENGTH} / 1609.344::DOUBLE)', 3)} AS length_miles FROM seg GROUP BY fid")
def line_length(s, d):
    return V.metrics(W.user_lines(s, d).where(F.size(G.vertices("geom")) > 1)).features.select(F.col("_fid").alias("fid"), "length_km", "length_miles")


AREA = "(abs(radians(x1 - x0) * 2 * (sin(radians(y0)) - sin(radians(y1)))) * (6378137.0::DOUBLE * 6378137.0::DOUBLE / 4))"
EDGE = f"({hav('x0', 'y0', 'x1', 'y0')} + {hav('x1', 'y0', 'x1', 'y1')} + {hav('x1', 'y1', 'x0', 'y1')} + {hav('x0', 'y1', 'x0', 'y0')})"


@query(f"WITH {W.NATIONS} SELECT fid, round({AREA} / 1e6, 1) AS area_sqkm, round({AREA} / 1e6 * 2, 1) AS exact_sqkm FROM nations")
def polygon_area(s, d):
    return W.nations(s, d).select(F.col("_fid").alias("fid"), F.round(G.area_m2("geom") / 1e6, 1).alias("area_sqkm"), F.round(G.area_m2("geom", 2.0) / 1e6, 1).alias("exact_sqkm"))


@query(f"WITH {W.NATIONS} SELECT fid, {rnd(f'({EDGE} / 1000)', 3)} AS perimeter_km, CAST(NULL AS DOUBLE) AS length_km FROM nations")
def metrics_enrich(s, d):
    return V.metrics(W.nations(s, d)).features.select(F.col("_fid").alias("fid"), "perimeter_km", "length_km")


@query(f"WITH {W.NATIONS} SELECT count(*) AS feature_count, round(sum({AREA}) / 1e6, 0) AS total_area_sqkm, 0.0::DOUBLE AS total_length_km FROM nations")
def metrics_totals(s, d):
    return V.metrics(W.nations(s, d)).summary.select("feature_count", F.round("total_area_sqkm", 0).alias("total_area_sqkm"), "total_length_km")


@query("SELECT CAST(5 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS features FROM nation")
def representative_vertices(s, d):
    return W.nations(s, d).select(F.size(J.representative_vertices("geom")).cast("long").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("features"))


@query(f"WITH {W.EVENTS} SELECT fid, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy, count(*) AS n FROM ev GROUP BY fid")
def vertex_extraction(s, d):
    v = W.user_lines(s, d).select(F.col("_fid").alias("fid"), F.explode(G.vertices("geom")).alias("v"))
    return v.groupBy("fid").agg(r6(F.sum("v.x")).alias("sx"), r6(F.sum("v.y")).alias("sy"), F.count(F.lit(1)).alias("n"))


@query()
def simplify_lines(s, d):
    return V.simplify(W.user_lines(s, d), 5.0).features.select(F.col("_fid").alias("fid"), "original_vertices", "simplified_vertices")


@query()
def hull_area(s, d):
    return V.convex_hull(W.customers(s, d)).summary


@query(f"WITH {W.NATIONS} SELECT fid, CAST(5 AS BIGINT) AS vertices, 'feature' AS hull_type FROM nations")
def hull_per_feature(s, d):
    return V.convex_hull(W.nations(s, d), True).features.select(F.col("_fid").alias("fid"), F.size(G.vertices("geom")).cast("long").alias("vertices"), "hull_type")


@query()
def random_points(s, d):
    return V.random_points(W.nations(s, d), 100, True, 7).features.drop("geom")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS BIGINT) AS fid, n_name AS join_n_name, CAST(n_regionkey AS DOUBLE) AS join_n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5")
def csv_join_first_match(s, d):
    """The table's keys are moved by five, so that some features match none of its rows."""
    n = W.read(s, d, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 5).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), F.col("n_nationkey").cast("string").alias("N_KEY"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    table = n.select((F.col("copy") * 100 + F.col("N_KEY").cast("long")).alias("_row"), "N_KEY", F.when(F.col("copy") == 0, F.col("n_name")).otherwise("later").alias("n_name"), "n_regionkey")
    return J.key_join(W.customers(s, d), table, "c_nationkey", "n_key").features.select(F.col("_fid").alias("fid"), "join_n_name", "join_n_regionkey")


# Nations with gaps between them and a copy moved by half a cell, so that points lie in no, one or two polygons.
GAPS = W.sql_nations("nations", 0, 0, 50, 22)
MOVED = W.sql_nations("moved", 36, 16, 50, 22)


def both_lattices(s, d):
    a = W.nations(s, d, 0.0, 0.0, 50.0, 22.0)
    b = W.nations(s, d, 36.0, 16.0, 50.0, 22.0).withColumn("_fid", F.col("_fid") + 100)
    return a.unionByName(b)


@query(f"WITH {W.CUSTOMERS}, {GAPS}, {MOVED}, z AS (SELECT * FROM nations UNION ALL SELECT * FROM moved), m AS (SELECT c.fid, count(z.fid) AS n, min(n_name) AS v FROM customers c LEFT JOIN z ON {PIP} GROUP BY c.fid) SELECT fid, n AS sj_join_count, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN v ELSE n || ' matches' END AS sj_n_name FROM m")
def spatial_join_cardinality(s, d):
    return J.spatial_join(W.customers(s, d), both_lattices(s, d), ["n_name"]).features.select(F.col("_fid").alias("fid"), "sj_join_count", "sj_n_name")


def sql_nearest(a: str, b: str, other: str) -> str:
    m = hav("a.x", "a.y", "b.x", "b.y")
    return f"SELECT a.fid, min({m}) AS m FROM {a} a JOIN {b} b ON {other} GROUP BY a.fid"


@query(f"WITH {W.SUPPLIERS}, m AS ({sql_nearest('suppliers', 'suppliers', 'a.fid <> b.fid')}) SELECT fid, round(m / 1000, 3) AS km FROM m")
def nearest_neighbor_self(s, d):
    p = J.sample_points(W.suppliers(s, d))
    return J.nearest(p, p, True).select(F.col("_fid").alias("fid"), F.round(F.col("metres") / 1000, 3).alias("km"))


@query(f"WITH {W.CUSTOMERS}, {W.SUPPLIERS}, m AS ({sql_nearest('customers', 'suppliers', 'true')}) SELECT fid, {rnd('(m / 1000)', 3)} AS distance_km FROM m")
def nearest_neighbor_target(s, d):
    return J.nearest_neighbours(W.customers(s, d), W.suppliers(s, d)).features.select(F.col("_fid").alias("fid"), "distance_km")


@query(f"WITH {W.SUPPLIERS}, m AS ({sql_nearest('suppliers', 'suppliers', 'a.fid <> b.fid')}) SELECT count(*) AS connections_count, {rnd('avg(m / 1000)', 2)} AS avg_distance_km, {rnd('min(m / 1000)', 2)} AS min_distance_km, {rnd('max(m / 1000)', 2)} AS max_distance_km FROM m")
def nn_summary(s, d):
    return J.nearest_neighbours(W.suppliers(s, d)).summary


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT c.fid FROM customers c WHERE NOT EXISTS (SELECT 1 FROM nations WHERE n_regionkey < 3 AND x > x0 AND x < x1 AND y > y0 AND y < y1)")
def covered_by(s, d):
    return O.topology_check(W.customers(s, d), "must_be_covered_by", W.nations(s, d).where("n_regionkey < 3")).features.select(F.col("_fid").alias("fid"))


@query("SELECT CAST(c_mktsegment AS VARCHAR) AS segment, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def first_per_key(s, d):
    return J.first_per_key(W.customers(s, d), "c_mktsegment").select(F.col("c_mktsegment").alias("segment"), F.col("_fid").alias("first_key"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS fid, row_number() OVER (ORDER BY coalesce(CAST(s_name AS VARCHAR), '') DESC, s_suppkey) AS place FROM supplier QUALIFY place <= 10")
def attribute_table_sort(s, d):
    top = J.sorted_by_text(W.suppliers(s, d), "s_name", True).limit(10)
    return top.select(F.col("_fid").alias("fid"), F.row_number().over(Window.orderBy(F.desc("s_name"), "_fid")).cast("long").alias("place"))


# --- aggregates ------------------------------------------------------------------------------------------------------

BINS = f"""WITH {W.CUSTOMERS}, b AS (SELECT min(x) AS x0, min(y) AS y0, 500.0::DOUBLE / (111.32::DOUBLE * greatest(0.01::DOUBLE, abs(cos(radians((min(y) + max(y)) / 2))))) AS dx, 500.0::DOUBLE / 111.32::DOUBLE AS dy FROM customers)
SELECT CAST(floor((x - (x0 - dx)) / dx) AS BIGINT) AS grid_x, CAST(floor((y - (y0 - dy)) / dy) AS BIGINT) AS grid_y, count(*) AS point_count, {rnd('(count(*) / 250000.0::DOUBLE)', 2)} AS density_per_sqkm FROM customers, b GROUP BY 1, 2"""


@query(BINS)
def square_binning(s, d):
    return S.binning(W.customers(s, d), "square", 500.0).features.select("grid_x", "grid_y", "point_count", "density_per_sqkm")


@query(BINS)
def hex_binning_counts(s, d):
    return S.binning(W.customers(s, d), "hexbin", 500.0).features.select("grid_x", "grid_y", "point_count", "density_per_sqkm")


def sql_stats(c: str, table: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"SELECT '{c}' AS attribute, count({v}) AS \"count\", {rnd(f'min({v})', 2)} AS \"min\", {rnd(f'max({v})', 2)} AS \"max\", {rnd(f'avg({v})', 2)} AS mean, round(sum({v}), 1) AS \"sum\" FROM {table}"


@query(f"{sql_stats('c_nationkey', 'customer')} UNION ALL {sql_stats('c_acctbal', 'customer')}")
def attribute_stats(s, d):
    return V.attribute_statistics(W.customers(s, d)).withColumn("sum", F.round("sum", 1))


@query("SELECT count(s_acctbal) AS \"count\", min(s_acctbal) AS \"min\", max(s_acctbal) AS \"max\", round(avg(s_acctbal), 6) AS mean, round(sum(s_acctbal), 4) AS \"sum\" FROM supplier")
def column_stats(s, d):
    return J.column_statistics(W.suppliers(s, d), "s_acctbal").withColumns({"mean": F.round("mean", 6), "sum": F.round("sum", 4)})


@query(f"WITH {W.CUSTOMERS} SELECT count(*) AS feature_count, round(avg(x), 6) AS center_lng, round(avg(y), 6) AS center_lat FROM customers")
def mean_center(s, d):
    return S.mean_centre(W.customers(s, d)).summary.select("feature_count", r6("center_lng").alias("center_lng"), r6("center_lat").alias("center_lat"))


@query(f"WITH {W.SUPPLIERS}, m AS (SELECT avg(x) AS mx, avg(y) AS my FROM suppliers), w AS (SELECT x, y, 1 / ({hav('mx', 'my', 'x', 'y')} + 1e-6) AS w FROM suppliers, m) SELECT round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM w")
def median_center_step(s, d):
    pts = S.centres(W.suppliers(s, d))
    m = pts.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return S.weiszfeld_step(pts.crossJoin(F.broadcast(m)), F.col("mx"), F.col("my")).select(r6("nx").alias("x"), r6("ny").alias("y"))


@query()
def median_center(s, d):
    return S.median_centre(W.suppliers(s, d)).summary


@query(f"WITH {W.EVENTS}, e AS (SELECT fid, arg_min(x, n) AS ax, arg_min(y, n) AS ay, arg_max(x, n) AS bx, arg_max(y, n) AS b_y FROM ev GROUP BY fid HAVING count(*) > 1), t AS (SELECT count(*) AS line_count, degrees(atan2(sum(radians(bx - ax)), sum(radians(b_y - ay)))) AS g FROM e) SELECT line_count, {rnd('(CASE WHEN g < 0 THEN g + 360 ELSE g END)', 1)} AS direction_deg FROM t")
def directional_mean(s, d):
    return S.directional_mean(W.user_lines(s, d)).summary.select("line_count", "direction_deg")


@query(
    f"""WITH {W.SUPPLIERS}, g AS (SELECT count(*)::DOUBLE AS n, avg(s_acctbal) AS m FROM suppliers), q AS (SELECT sum(power(s_acctbal - m, 2)) AS den FROM suppliers, g),
p AS (SELECT sum(1 / greatest(1, {hav('a.x', 'a.y', 'b.x', 'b.y')})) AS s0, sum(1 / greatest(1, {hav('a.x', 'a.y', 'b.x', 'b.y')}) * (a.s_acctbal - m) * (b.s_acctbal - m)) AS num FROM suppliers a JOIN suppliers b ON a.fid <> b.fid, g),
i AS (SELECT n, s0, n / s0 * num / den AS i, -1 / (n - 1) AS e FROM p, q, g),
v AS (SELECT *, (n * n - 3 * n + 3) * s0 * s0 / ((n - 1) * (n - 1) * (n - 2) * (n - 3) + 1e-12) - (n * n + 3 * n - 6) / ((n - 1) * (n - 2) * (n - 3) + 1e-12) - e * e AS va FROM i),
z AS (SELECT *, CASE WHEN va > 0 THEN (i - e) / sqrt(va) ELSE 0 END AS z FROM v)
SELECT {rnd('i', 4)} AS morans_i, {rnd('e', 4)} AS expected_i, {rnd('z', 3)} AS z_score, {rnd(W.sql_p_value('z'), 4)} AS p_value, CASE WHEN z > 1.96 THEN 'clustered' WHEN z < -1.96 THEN 'dispersed' ELSE 'random' END AS pattern, CAST(n AS BIGINT) AS feature_count FROM z"""
)
def morans_i(s, d):
    return S.morans_i(W.suppliers(s, d), "s_acctbal").summary.select("morans_i", "expected_i", "z_score", "p_value", "pattern", "feature_count")


@query(
    f"""WITH {W.SUPPLIERS}, g AS (SELECT count(*)::DOUBLE AS n, avg(s_acctbal) AS m, sqrt(greatest(0, sum(s_acctbal * s_acctbal) / count(*) - avg(s_acctbal) * avg(s_acctbal))) AS sd FROM suppliers),
p AS (SELECT a.fid, count(*)::DOUBLE AS w, sum(b.s_acctbal) AS s FROM suppliers a JOIN suppliers b ON {hav('a.x', 'a.y', 'b.x', 'b.y')} <= 3000000 GROUP BY a.fid),
z AS (SELECT fid, (s - m * w) / (sd * sqrt(greatest(1e-12, (n * w - w * w) / (n - 1)))) AS z FROM p, g)
SELECT fid, {rnd('z', 3)} AS gi_z_score, {rnd(W.sql_p_value('z'), 4)} AS gi_p_value, CASE WHEN z >= 2.576 THEN 'hot_99pct' WHEN z >= 1.96 THEN 'hot_95pct' WHEN z <= -2.576 THEN 'cold_99pct' WHEN z <= -1.96 THEN 'cold_95pct' ELSE 'not_significant' END AS gi_class FROM z"""
)
def getis_ord(s, d):
    return S.getis_ord(W.suppliers(s, d), "s_acctbal", 3_000_000.0).features.select(F.col("_fid").alias("fid"), "gi_z_score", "gi_p_value", "gi_class")


@query(f"WITH t AS (SELECT count(*) AS n, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, regr_r2(p_retailprice, p_size) AS r FROM part) SELECT n AS observations, {rnd('a', 3)} AS intercept, {rnd('b', 3)} AS slope, {rnd('r', 4)} AS r_squared FROM t")
def ols_1(s, d):
    p = W.read(s, d, "part").select(F.col("p_partkey").cast("long").alias("_fid"), "p_size", "p_retailprice")
    return S.ols(p, "p_retailprice", ["p_size"]).summary.select("observations", F.col("coefficients")["intercept"].alias("intercept"), F.col("coefficients")["p_size"].alias("slope"), "r_squared")


@query(
    f"""WITH c AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
t AS (SELECT n, ma, mb, my, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS b_y, var_pop(l_extendedprice) AS yy FROM lineitem, c GROUP BY ALL),
k AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS p, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM t)
SELECT CAST(n AS BIGINT) AS observations, round(my - p * ma - q * mb, 2) AS intercept, round(p, 2) AS a, round(q, 1) AS b, {rnd('((p * ay + q * b_y) / yy)', 4)} AS r_squared FROM k"""
)
def ols_2(s, d):
    li = W.read(s, d, "lineitem").select(F.col("l_orderkey").alias("_fid"), "l_quantity", "l_discount", "l_extendedprice")
    c = F.col("coefficients")
    return S.ols(li, "l_extendedprice", ["l_quantity", "l_discount"]).summary.select("observations", F.round(c["intercept"], 2).alias("intercept"), F.round(c["l_quantity"], 2).alias("a"), F.round(c["l_discount"], 1).alias("b"), "r_squared")


@query("WITH t AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) SELECT CAST(i AS INTEGER) AS class, round(a + (b - a) * i / 5, 6) AS \"min\", round(CASE WHEN i = 4 THEN b ELSE a + (b - a) * (i + 1) / 5 END, 6) AS \"max\" FROM t, range(0, 5) AS r(i)")
def class_breaks_equal(s, d):
    return S.class_breaks(W.customers(s, d), "c_acctbal").select("class", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query("WITH t AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS p, count(*) OVER () AS n FROM customer), e AS (SELECT i, (SELECT v FROM t WHERE p = floor((n - 1) * i / 4.0 + 0.5)) AS v FROM range(0, 5) AS r(i)) SELECT CAST(a.i AS INTEGER) AS class, round(a.v, 6) AS \"min\", round(b.v, 6) AS \"max\" FROM e a JOIN e b ON b.i = a.i + 1")
def class_breaks_quantile(s, d):
    return S.class_breaks(W.customers(s, d), "c_acctbal", "quantile", 4).select("class", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


# --- rasters ---------------------------------------------------------------------------------------------------------

NB = "n AS (SELECT a.x, a.y, a.v, coalesce(e.v, a.v) AS e, coalesce(w.v, a.v) AS w, coalesce(t.v, a.v) AS nn, coalesce(u.v, a.v) AS s FROM dem a LEFT JOIN dem e ON e.x = a.x + 1 AND e.y = a.y LEFT JOIN dem w ON w.x = a.x - 1 AND w.y = a.y LEFT JOIN dem t ON t.x = a.x AND t.y = a.y - 1 LEFT JOIN dem u ON u.x = a.x AND u.y = a.y + 1), g AS (SELECT x, y, (e - w) / (2 * m) AS gx, (s - nn) / (2 * m) AS gy FROM n, cel)"
SLOPE = "degrees(atan(sqrt(gx * gx + gy * gy)))"
ASPECT = "(CASE WHEN gx = 0 AND gy = 0 THEN 180.0::DOUBLE ELSE fmod(fmod(180 - degrees(atan2(gx, gy)) + 360, 360) + 360, 360) END)"
cell_value = lambda df, n=6: df.select("x", "y", F.round("value", n).alias("value"))


@query(f"WITH {W.sql_dem()}, {NB} SELECT x, y, round({SLOPE}, 6) AS value FROM g")
def slope(s, d):
    return cell_value(R.slope(*W.dem(s, d)))


@query(f"WITH {W.sql_dem()}, {NB} SELECT x, y, round({ASPECT}, 6) AS value FROM g")
def aspect(s, d):
    return cell_value(R.aspect(*W.dem(s, d)))


@query(f"WITH {W.sql_dem()}, {NB} SELECT x, y, round(greatest(0, least(1, cos(radians({SLOPE})) * cos(radians(45)) + sin(radians({SLOPE})) * sin(radians(45)) * cos(radians(315) - radians({ASPECT})))), 6) AS value FROM g")
def hillshade(s, d):
    return cell_value(R.hillshade(*W.dem(s, d)))


@query(f"WITH {W.sql_dem()} SELECT x, y, round(sqrt(abs(v - 950)) * 2 + ln(v) / 3, 6) AS value FROM dem")
def raster_calc_one(s, d):
    return cell_value(R.calculator(W.dem(s, d)[0], "sqrt(abs(a - 950)) * 2 + log(a) / 3"))


@query(f"WITH {W.sql_dem()} SELECT x, y, round(greatest(v, CAST(x * 40 AS DOUBLE)) - v / (CAST(x * 40 AS DOUBLE) + 1), 6) AS value FROM dem")
def raster_calc_two(s, d):
    a = W.dem(s, d)[0]
    return cell_value(R.calculator(a, "max(a, b) - a / (b + 1)", a.withColumn("value", (F.col("x") * 40).cast("double"))))


D8 = """nb AS (SELECT a.x, a.y, a.v, k.i, k.code, a.x + k.dx AS tx, a.y + k.dy AS ty, (a.v - b.v) / (CASE WHEN k.dx <> 0 AND k.dy <> 0 THEN sqrt(2::DOUBLE) ELSE 1 END) AS dr FROM dem a CROSS JOIN (VALUES (0, 1, 0, -1), (1, 2, 1, -1), (2, 4, 1, 0), (3, 8, 1, 1), (4, 16, 0, 1), (5, 32, -1, 1), (6, 64, -1, 0), (7, 128, -1, -1)) k(i, code, dx, dy) LEFT JOIN dem b ON b.x = a.x + k.dx AND b.y = a.y + k.dy),
dir AS (SELECT x, y, CASE WHEN coalesce(dr, 0) > 0 THEN code ELSE 0 END AS value, CASE WHEN coalesce(dr, 0) > 0 THEN tx END AS tx, CASE WHEN coalesce(dr, 0) > 0 THEN ty END AS ty FROM nb QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY greatest(coalesce(dr, 0), 0) DESC, i) = 1)"""


@query(f"WITH {W.sql_dem(1e-6)}, {D8} SELECT x, y, CAST(value AS INTEGER) AS value FROM dir")
def d8_direction(s, d):
    return R.d8(*W.dem(s, d, 1e-6)).select("x", "y", F.col("value").cast("int").alias("value"))


@query(f"WITH RECURSIVE {W.sql_dem(1e-6)}, {D8}, f(x, y) AS (SELECT x, y FROM dir UNION ALL SELECT dir.tx, dir.ty FROM f JOIN dir ON f.x = dir.x AND f.y = dir.y WHERE dir.tx IS NOT NULL) SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(count(*) AS DOUBLE) AS value FROM f GROUP BY 1, 2")
def flow_accumulation(s, d):
    return R.flow_accumulation(R.d8(*W.dem(s, d, 1e-6))).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "value")


@query(f"WITH {W.sql_dem()} SELECT count(*) AS cells, {rnd('min(v)', 3)} AS \"min\", {rnd('max(v)', 3)} AS \"max\", {rnd('avg(v)', 3)} AS mean FROM dem")
def grid_summary(s, d):
    return R.summary(W.dem(s, d)[0])


@query(f"WITH {W.sql_dem()}, st AS (SELECT greatest(1, CAST(ceil(sqrt(50 * h / 100.0)) AS INTEGER)) AS st, h FROM cel) SELECT CAST(y AS BIGINT) * 50 + x AS fid, round(0.1::DOUBLE * (x + 0.5), 6) AS lng, round(h / 10.0::DOUBLE - 0.1::DOUBLE * (y + 0.5), 6) AS lat, {rnd('v', 3)} AS value FROM dem, st WHERE x % st = 0 AND y % st = 0")
def grid_decimate(s, d):
    out = R.shown(*W.dem(s, d), most=100)
    v = G.first_vertex("geom")
    return out.select(F.col("_fid").alias("fid"), r6(v["x"]).alias("lng"), r6(v["y"]).alias("lat"), "value")


ZONES = "z AS (SELECT i AS zone, i * 1.0::DOUBLE AS x0, i * 1.0::DOUBLE + 0.93 AS x1, 0.17::DOUBLE AS y0, 0.17::DOUBLE + (i + 1) * 0.31 AS y1 FROM range(0, 5) AS r(i))"


def zones(s):
    i = F.col("id").cast("double")
    return s.range(5).select(F.col("id").alias("_fid"), G.rectangle(i, F.lit(0.17), i + 0.93, F.lit(0.17) + (i + 1) * 0.31).alias("geom"))


@query(
    f"""WITH {W.sql_dem()}, {ZONES}, c AS (SELECT zone, v, floor(v * 100 + 0.5) / 100 AS hv FROM dem, cel, z WHERE 0.1::DOUBLE * (x + 0.5) > x0 AND 0.1::DOUBLE * (x + 0.5) < x1 AND h / 10.0::DOUBLE - 0.1::DOUBLE * (y + 0.5) > y0 AND h / 10.0::DOUBLE - 0.1::DOUBLE * (y + 0.5) < y1),
m AS (SELECT zone, hv FROM (SELECT zone, hv, count(*) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, hv) = 1)
SELECT c.zone AS zone_id, count(*) AS cell_count, {rnd('min(v)', 3)} AS zonal_min, {rnd('max(v)', 3)} AS zonal_max, {rnd('avg(v)', 3)} AS zonal_mean, {rnd('median(v)', 3)} AS zonal_median, {rnd('stddev_pop(v)', 3)} AS zonal_std, min(m.hv) AS zonal_majority FROM c JOIN m USING (zone) GROUP BY c.zone"""
)
def zonal_stats(s, d):
    cells, grid = W.dem(s, d)
    return R.zonal(zones(s), cells, grid).features.drop("_fid", "geom")


@query()
def viewshed(s, d):
    cells, grid = W.dem(s, d)
    return R.viewshed(cells, grid, 2.5, grid.y1 / 2)


# --- interpolation ---------------------------------------------------------------------------------------------------

GRID = """b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, 0.02::DOUBLE * greatest(max(x) - min(x), max(y) - min(y), 0.01) AS pad, greatest(1e-4, {km}::DOUBLE / 111.32::DOUBLE) AS st FROM suppliers),
q AS (SELECT x0 - pad AS x0, y0 - pad AS y0, st, least({most}, CAST(ceil((x1 + pad - (x0 - pad)) / st) AS BIGINT) + 1) AS c, least({most}, CAST(ceil((y1 + pad - (y0 - pad)) / st) AS BIGINT) + 1) AS r FROM b),
cells AS (SELECT j * c + i AS cell, x0 + i * st AS x, y0 + j * st AS y FROM q, range(0, {most}) AS ti(i), range(0, {most}) AS tj(j) WHERE i < c AND j < r)"""


@query(
    f"""WITH {W.SUPPLIERS}, {GRID.format(km='500.0', most=200)}, k AS (SELECT cell, {hav('c.x', 'c.y', 's.x', 's.y')} AS dd, s.fid, s_acctbal AS v FROM cells c, suppliers s QUALIFY row_number() OVER (PARTITION BY cell ORDER BY dd, s.fid) <= 12)
SELECT cell, {rnd('(CASE WHEN min(dd) < 1 THEN arg_min(v, dd) ELSE sum(v * power(dd, -2.0)) / sum(power(dd, -2.0)) END)', 3)} AS predicted FROM k GROUP BY cell"""
)
def idw_surface(s, d):
    return I.idw(W.suppliers(s, d), "s_acctbal", cell_km=500.0).features.select(F.col("_fid").alias("cell"), "predicted")


BINNED = f"""pr AS (SELECT {hav('a.x', 'a.y', 'b.x', 'b.y')} AS dd, power(a.s_acctbal - b.s_acctbal, 2) / 2 AS g FROM suppliers a JOIN suppliers b ON a.fid < b.fid), tp AS (SELECT greatest(1, max(dd)) / 2 AS t FROM pr),
bn AS (SELECT CAST(least(11, floor(dd / t * 12)) AS INTEGER) AS bin, sum(g) AS total, count(*) AS n, t FROM pr, tp WHERE dd <= t GROUP BY 1, t)"""


@query(f"WITH {W.SUPPLIERS}, {BINNED} SELECT bin, n, round(total / n, 2) AS gamma FROM bn")
def semivariogram_bins(s, d):
    return I.semivariogram(I.samples(W.suppliers(s, d), "s_acctbal"))[0].select("bin", "n", F.round(F.col("total") / F.col("n"), 2).alias("gamma"))


@query(
    f"""WITH {W.SUPPLIERS}, {BINNED}, sl AS (SELECT greatest(1e-9, avg(g) * 2) AS sill, max(t) AS t FROM pr, tp),
cd AS (SELECT a * sill AS nug, sill, r * t AS rg FROM sl, (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5)) x(a), (VALUES (0.15::DOUBLE), (0.3), (0.5), (0.75), (1.0)) y(r)),
er AS (SELECT nug, sill, rg, sum(n * power(CASE WHEN (bin + 0.5) / 12 * t >= rg THEN sill ELSE nug + greatest(0, sill - nug) * (1.5 * ((bin + 0.5) / 12 * t / rg) - 0.5 * power((bin + 0.5) / 12 * t / rg, 3)) END - total, 2)) AS e FROM cd, bn GROUP BY ALL)
SELECT round(nug, 1) AS nugget, round(sill, 1) AS sill, round(rg, 0) AS reach FROM er ORDER BY e, nug, rg LIMIT 1"""
)
def variogram_fit(s, d):
    fit = I.variogram_fit(*I.semivariogram(I.samples(W.suppliers(s, d), "s_acctbal")))
    return fit.select(F.round("nugget", 1).alias("nugget"), F.round("sill", 1).alias("sill"), F.round("reach", 0).alias("reach"))


@query()
def kriging_surface(s, d):
    """Over as many samples as kriging takes; the reference tables have more at larger scales, so the bound is set to theirs."""
    sup = W.suppliers(s, d)
    return I.kriging(sup, "s_acctbal", cell_km=500.0, most_samples=max(I.MOST_SAMPLES, sup.count())).features.select(F.col("_fid").alias("cell"), "predicted", "standard_error")


# --- networks --------------------------------------------------------------------------------------------------------

# Up to the row where it ends or, if that is farther from the equator, starts (degrees are shorter there), and along it.
H = hav("0", "CAST(greatest(j, j0) AS DOUBLE) / 10", "0.1::DOUBLE", "CAST(greatest(j, j0) AS DOUBLE) / 10")
FROM = f"c AS (SELECT i, j, j0, i * {H} + abs(j - j0) * {hav('0', '0', '0', '0.1::DOUBLE')} AS c FROM nd, (VALUES (0), (1)) o(j0))"
LEAST = f"WITH {W.sql_lattice()}, {FROM}, p AS (SELECT i, j, c FROM c WHERE j0 = 0)"


@query(f"WITH {W.sql_lattice()} SELECT count(*) AS edges, (SELECT count(*) FROM nd) AS nodes, round(sum({hav('x1', 'y1', 'x2', 'y2')}), 3) AS metres FROM ed")
def graph_build(s, d):
    nodes, edges = N.build(W.lattice(s, d))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("metres"), 3).alias("metres")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes"))).select("edges", "nodes", "metres")


@query(f"{LEAST}, g AS (SELECT i, j FROM nd ORDER BY i DESC, j DESC LIMIT 1) SELECT round(c, 1) AS total_distance_m, CAST(p.i + p.j AS BIGINT) AS legs FROM p JOIN g USING (i, j)")
def shortest_path_cost(s, d):
    nodes = W.lattice(s, d).select(F.explode(G.vertices("geom")).alias("v"))
    x, y = nodes.agg(F.max("v.x"), F.max(F.struct("v.x", "v.y"))["y"]).first()
    out = N.shortest_path(W.lattice(s, d), (0.0, 0.0), (x, y), "astar")
    return out.summary.select("total_distance_m").crossJoin(out.features.agg(F.count(F.lit(1)).alias("legs")))  # one row each


@query(f"{LEAST} SELECT i AS kx, j AS ky, round(c, 3) AS metres FROM p")
def network_costs(s, d):
    _, edges = N.build(W.lattice(s, d))
    source = s.createDataFrame([(0, 0, 0)], "source long, kx long, ky long")
    return N.costs(edges, source).select((F.col("kx") / 100).cast("long").alias("kx"), (F.col("ky") / 100).cast("long").alias("ky"), F.round("metres", 3).alias("metres"))


@query(f"{LEAST}, w AS (SELECT i, j, i2, j2, {hav('x1', 'y1', 'x2', 'y2')} AS m FROM ed UNION ALL SELECT i2, j2, i, j, {hav('x1', 'y1', 'x2', 'y2')} FROM ed), f AS (SELECT least(w.i * 100000 + w.j, w.i2 * 100000 + w.j2) AS a, greatest(w.i * 100000 + w.j, w.i2 * 100000 + w.j2) AS b, min(c + m) AS c FROM w JOIN p ON w.i = p.i AND w.j = p.j WHERE c + m <= 400000 GROUP BY 1, 2) SELECT count(*) AS edges, round(sum({rnd('c', 1)}), 0) AS total FROM f")
def service_area_edges(s, d):
    out = N.service_area(W.lattice(s, d), (0.0, 0.0), 400_000.0).features.where("type = 'reachable_edge'")
    return out.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("cost_from_facility_m"), 0).alias("total"))


@query(f"WITH {W.sql_lattice()}, {FROM} SELECT CAST(j0 AS BIGINT) AS origin_id, i * 100000 + j AS destination_id, {rnd('c', 1)} AS network_distance_m FROM c")
def od_matrix(s, d):
    """From two origins to every node, so that the bound on pairs is set to the table's."""
    net = W.lattice(s, d)
    v = net.select(F.explode(G.vertices("geom")).alias("v")).select("v.x", "v.y").distinct()
    fid = F.round(F.col("x") * 10).cast("long") * 100_000 + F.round(F.col("y") * 10).cast("long")
    targets = v.select(fid.alias("_fid"), G.point(F.col("x"), F.col("y")).alias("geom"))
    origins = s.range(2).select(F.col("id").alias("_fid"), G.point(F.lit(0.0), F.col("id") / 10).alias("geom"))
    return N.od_matrix(net, origins, targets, most_pairs=max(10_000, 2 * targets.count())).features.select("origin_id", "destination_id", "network_distance_m")


# --- topology and overlay --------------------------------------------------------------------------------------------

MOVE = W.sql_nations("mask", 30, 10)
CUT = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
plane = lambda g: F.aggregate(F.col(f"{g}.parts"), F.lit(0.0), lambda acc, p: acc + F.aggregate(p, F.lit(0.0), lambda t, r: t + G.total(G.around(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2))


@query(f"WITH {GAPS}, {MOVED}, z AS (SELECT * FROM nations UNION ALL SELECT fid + 100, x0, y0, x1, y1, n_name, n_regionkey FROM moved) SELECT a.fid, b.fid AS with_feature_index, round({CUT} * 12392142400.0::DOUBLE / 1e6, 0) AS km2 FROM z a JOIN z b ON a.fid < b.fid WHERE {CUT} > 0")
def overlap_rects(s, d):
    out = O.topology_check(both_lattices(s, d)).features
    return out.select(F.col("_fid").alias("fid"), "with_feature_index", F.round(F.col("overlap_area_m2") / 1e6, 0).alias("km2"))


@query(f"WITH {W.EVENTS}, e AS (SELECT fid, arg_min(x, n) AS x, arg_min(y, n) AS y FROM ev GROUP BY fid HAVING count(*) > 1 UNION ALL SELECT fid, arg_max(x, n), arg_max(y, n) FROM ev GROUP BY fid HAVING count(*) > 1) SELECT min(fid) AS fid, round(min(x), 6) AS x, round(min(y), 6) AS y FROM e GROUP BY round(x * 1e7), round(y * 1e7) HAVING count(*) = 1")
def dangles(s, d):
    out = O.topology_check(W.user_lines(s, d), "must_not_have_dangles").features
    v = G.first_vertex("geom")
    return out.select(F.col("_fid").alias("fid"), r6(v["x"]).alias("x"), r6(v["y"]).alias("y"))


def sql_overlay(area: str) -> str:
    return f"WITH {W.NATIONS}, {MOVE}, m AS (SELECT * FROM mask WHERE n_regionkey = 2), t AS (SELECT a.fid, 2304.0::DOUBLE AS own, sum({CUT}) AS cut, (SELECT sum((x1 - x0) * (y1 - y0)) FROM m) AS whole FROM nations a, m b GROUP BY a.fid) SELECT fid, round({area}, 6) AS area FROM t WHERE {area} > 0"


def overlaid(s, d, op):
    out = O.overlay(W.nations(s, d), W.nations(s, d, 30.0, 10.0).where("n_regionkey = 2"), op).features
    return out.select(F.col("_fid").alias("fid"), r6(plane("geom")).alias("area"))


@query(sql_overlay("cut"))
def overlay_intersection_rects(s, d):
    return overlaid(s, d, "intersection")


@query(sql_overlay("own - cut"))
def overlay_difference_area(s, d):
    return overlaid(s, d, "difference")


@query(sql_overlay("own + whole - 2 * cut"))
def overlay_symdiff_area(s, d):
    return overlaid(s, d, "symmetric_difference")


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT DISTINCT c.fid FROM customers c JOIN nations n ON x > x0 AND x < x1 AND y > y0 AND y < y1 WHERE n_regionkey = 3")
def clip_points(s, d):
    return O.clip(W.customers(s, d), W.nations(s, d).where("n_regionkey = 3")).features.select(F.col("_fid").alias("fid"))


@query(sql_overlay("cut"))
def clip_polygons(s, d):
    out = O.clip(W.nations(s, d), W.nations(s, d, 30.0, 10.0).where("n_regionkey = 2")).features
    return out.select(F.col("_fid").alias("fid"), r6(plane("geom")).alias("area"))


@query(f"WITH {W.NATIONS} SELECT n_regionkey, CAST(1 AS BIGINT) AS dissolved_parts, round(sum((x1 - x0) * (y1 - y0)), 6) AS area FROM nations GROUP BY 1")
def dissolve_region_area(s, d):
    return O.dissolve(W.nations(s, d), "n_regionkey").features.select("n_regionkey", "dissolved_parts", r6(plane("geom")).alias("area"))


# --- reports ---------------------------------------------------------------------------------------------------------


@query(f"WITH {W.SUPPLIERS} SELECT fid, CAST(s_acctbal AS VARCHAR) AS s_acctbal, CAST(s_name AS VARCHAR) AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, x AS lng, y AS lat FROM suppliers")
def attribute_table(s, d):
    return reports.attribute_table(W.suppliers(s, d)).withColumnRenamed("_fid", "fid")


@query(f"WITH {W.NATIONS} SELECT fid, round({EDGE} / 1000, 3) AS length_km, round({AREA} / 1e6, 1) AS area_sqkm FROM nations")
def measure_tools(s, d):
    ring = G.outer_vertices("geom")
    return W.nations(s, d).select(F.col("_fid").alias("fid"), F.round(reports.measured_length(ring) / 1000, 3).alias("length_km"), F.round(reports.measured_area(ring) / 1e6, 1).alias("area_sqkm"))


@query("WITH t AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), c AS (SELECT CAST(c_custkey AS BIGINT) AS fid, least(4, CAST(ceil((c_acctbal - a) / ((b - a) / 5)) AS INTEGER) - 1) AS k FROM customer, t) SELECT fid, (['#edf8b1', '#c7e9b4', '#7fcdbb', '#419eb6', '#225ea8'])[greatest(k, 0) + 1] AS color FROM c")
def class_color_lookup(s, d):
    c = W.customers(s, d)
    return c.select(F.col("_fid").alias("fid"), S.class_of(F.col("c_acctbal"), S.class_breaks(c, "c_acctbal")).alias("color"))


@query("SELECT r_name, CAST(count(*) AS BIGINT) AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sql_console_semi_anti(s, d):
    text = "SELECT r_name, count(*) AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c_nationkey) AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = -1 - c_nationkey) GROUP BY r_name"
    return console(s, d, text)


@query(f"WITH {W.NATIONS}, {MOVE}, m AS (SELECT * FROM mask WHERE n_regionkey = 2), t AS (SELECT a.fid, sum({CUT}) AS cut FROM nations a, m b GROUP BY a.fid) SELECT count(*) AS input_features, count(*) FILTER (cut > 0) AS output_features FROM t")
def overlay_summary(s, d):
    return O.overlay(W.nations(s, d), W.nations(s, d, 30.0, 10.0).where("n_regionkey = 2")).summary.select("input_features", "output_features")


@query(f"WITH {W.NATIONS} SELECT CAST(count(*) AS BIGINT) AS input_features, count(DISTINCT n_regionkey) AS output_groups, {rnd('((count(*) - count(DISTINCT n_regionkey)) * 100.0::DOUBLE / count(*))', 1)} AS feature_reduction_percent FROM nations")
def dissolve_summary(s, d):
    return O.dissolve(W.nations(s, d), "n_regionkey").summary.select("input_features", "output_groups", "feature_reduction_percent")


@query(f"WITH {W.CUSTOMERS} SELECT fid, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || {{NX}} || ',' || {{NY}} || ']}},\"properties\":{{\"c_nationkey\":' || c_nationkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}}}}' AS line FROM customers".replace("{NX}", "CASE WHEN round(x, 2) = floor(round(x, 2)) THEN CAST(CAST(round(x, 2) AS BIGINT) AS VARCHAR) ELSE CAST(round(x, 2) AS VARCHAR) END").replace("{NY}", "CASE WHEN round(y, 2) = floor(round(y, 2)) THEN CAST(CAST(round(y, 2) AS BIGINT) AS VARCHAR) ELSE CAST(round(y, 2) AS VARCHAR) END"))
def to_geojson(s, d):
    return IO.geojson_rows(tidy_customers(s, d).drop("c_name", "c_acctbal")).withColumnRenamed("_fid", "fid")


# --- formats ---------------------------------------------------------------------------------------------------------

NUM = "CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"
POINT_TEXT = f"'POINT (' || {NUM.format(v='round(x, 2)')} || ' ' || {NUM.format(v='round(y, 2)')} || ')'"


def tidy_customers(s, d):
    v = G.first_vertex("geom")
    return W.customers(s, d).withColumn("geom", G.point(F.round(v["x"], 2), F.round(v["y"], 2)))


@query(f"WITH {W.CUSTOMERS} SELECT fid, {POINT_TEXT} AS line FROM customers")
def to_wkt(s, d):
    return IO.wkt_rows(tidy_customers(s, d)).withColumnRenamed("_fid", "fid")


@query(f"WITH {W.CUSTOMERS} SELECT fid, round(x, 2) AS x, round(y, 2) AS y FROM customers")
def from_wkt(s, d):
    rows = IO.wkt_rows(tidy_customers(s, d)).select(F.col("_fid").alias("_row"), F.col("line").alias("value"))
    v = G.first_vertex("geom")
    return IO.wkt_features(rows).select(F.col("_fid").alias("fid"), v["x"].alias("x"), v["y"].alias("y"))


@query(f"WITH {W.CUSTOMERS} SELECT fid, (fid + 1) || ',Point,' || {NUM.format(v='round(x, 2)')} || ',' || {NUM.format(v='round(y, 2)')} || ',' || c_name || ',' || c_mktsegment AS line FROM customers")
def to_csv_rows(s, d):
    return IO.csv_rows(tidy_customers(s, d).drop("c_nationkey", "c_acctbal")).withColumnRenamed("_fid", "fid")


@query(f"WITH {W.CUSTOMERS} SELECT fid, round(x, 2) AS x, round(y, 2) AS y, CAST(c_nationkey AS DOUBLE) AS nation FROM customers WHERE fid % 7 <> 0")
def from_csv_points(s, d):
    v = G.first_vertex("geom")
    t = W.customers(s, d).select(F.col("_fid").alias("_row"), F.when(F.col("_fid") % 7 == 0, "none").otherwise(F.round(v["y"], 2).cast("string")).alias("Lat"), F.round(v["x"], 2).cast("string").alias("LON"), F.col("c_nationkey").cast("string").alias("nation"))
    out = IO.csv_points(t)
    return out.select(F.col("_fid").alias("fid"), v["x"].alias("x"), v["y"].alias("y"), "nation")


@query(f"WITH {W.CUSTOMERS} SELECT fid, x, y FROM customers")
def wkb_roundtrip(s, d):
    v = G.first_vertex("geom")
    return catalog.from_wkb(catalog.to_wkb(W.customers(s, d))).select(F.col("_fid").alias("fid"), v["x"].alias("x"), v["y"].alias("y"))


# --- streams' batch twin ---------------------------------------------------------------------------------------------


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(floor({W.LNG.format(k='event_id')} / 30) AS BIGINT) AS gx, CAST(floor({W.LAT.format(k='event_id')} / 30) AS BIGINT) AS gy, count(*) AS n FROM events GROUP BY ALL")
def windowed_bins(s, d):
    from ..streaming.live import binned

    e = W.read(s, d, "events").select("ts", W.lng("event_id").alias("x"), W.lat("event_id").alias("y"))
    return binned(e, 30.0, "1 hour")


def entry(s: SparkSession, d: str) -> DataFrame:
    """Customers by the nation's rectangle that holds them."""
    held = J.point_in_parts(W.customers(s, d), W.nations(s, d), G.first_vertex("geom")["x"], G.first_vertex("geom")["y"])
    return held.groupBy(F.col("p_fid").alias("nation"), F.col("p.n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("mean_acctbal"))


@query(f"WITH {W.CUSTOMERS}, {W.NATIONS} SELECT n.fid AS nation, n_name, count(*) AS customers, round(avg(c_acctbal), 6) AS mean_acctbal FROM customers c JOIN nations n ON {PIP} GROUP BY 1, 2")
def points_by_polygon(s, d):
    return entry(s, d)


from . import files  # noqa: E402, F401 - registers its queries
