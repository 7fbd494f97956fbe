import math

import pytest
from pyspark.sql import functions as F

from terrastrata.functions import geometry as G
from terrastrata.functions import kernels as K
from terrastrata.operators import joins as J
from terrastrata.operators import overlay as O
from terrastrata.operators import vector as V
from terrastrata.operators.result import ToolError

from .shapes import area, layer, line, point, square


@pytest.fixture(scope="module")
def cities(spark):
    return layer(spark, [(point(139.7, 35.7), "Tokyo", 37.4e6), (point(-74.0, 40.7), "New York", 18.8e6), (point(-0.1, 51.5), "London", 9.5e6)], "name string, pop double")


def test_buffer_keeps_its_distance(spark, cities):
    out = V.buffer(cities, 10_000.0, 32)
    rows = out.features.select("geom", F.col("_fid"), "buffer_distance_m").collect()
    assert len(rows) == 3 and out.summary.first().buffered_features == 3
    for r, (x, y) in zip(sorted(rows, key=lambda r: r._fid), ((139.7, 35.7), (-74.0, 40.7), (-0.1, 51.5)), strict=True):
        ring = r.geom.parts[0][0]
        assert ring[0] == ring[-1] and len(ring) == 33
        assert all(abs(K.great_circle(x, y, v.x, v.y) - 10_000) < 60 for v in ring)
    with pytest.raises(ToolError):
        V.buffer(cities, -1.0)
    mixed = layer(spark, [(line((0, 0), (1, 0)),), (square(0, 0, 1),), (K.geometry("GeometryCollection", None, [point(0, 0)]),)])
    got = V.buffer(mixed, 1000.0).features.collect()
    assert [r._fid for r in got] == [0, 1] and [len(r.geom.parts[0][0]) for r in got] == [5, 11]
    assert V.buffer(cities.limit(0)).features.count() == 0


def test_centroids_boxes_hulls(spark, cities):
    zone = layer(spark, [(square(-10, -10, 20), "z")], "zone string")
    c = V.centroids(zone).features.first()
    assert abs(c.centroid_lng) < 1e-9 and abs(c.centroid_lat) < 1e-9 and c.zone == "z"
    multi = layer(spark, [(K.geometry("MultiPolygon", [square(0, 0, 1)["parts"][0] and [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]], [[(10, 0), (14, 0), (14, 4), (10, 4), (10, 0)]]]),)])
    assert V.centroids(multi).features.first().centroid_lng == pytest.approx((0.5 + 12) / 2)
    b = V.boxes(cities).features.first()
    assert (b.min_lng, b.max_lat) == (-74.0, 51.5)
    h = V.convex_hull(cities).features.first()
    assert h.hull_vertices_count == 4 and h.source_features_count == 3
    assert V.convex_hull(cities, True).features.count() == 0 and V.convex_hull(zone, True).features.count() == 1


def test_layer_hull_holds_every_vertex(spark):
    pts = [(math.sin(i * 12.9) * 50, math.cos(i * 7.3) * 40) for i in range(500)]
    ring = [(v.x, v.y) for v in V.convex_hull(layer(spark, [(point(*p),) for p in pts]).repartition(7)).features.first().geom.parts[0][0]]
    assert ring == K.hull(pts)


def test_simplify_and_metrics(spark):
    wavy = layer(spark, [(line(*((i / 10, 0.001 * (i % 2)) for i in range(21))),), (point(0, 0),), (square(0, 0, 1),)])
    out = V.simplify(wavy, 0.01)
    assert [(r.original_vertices, r.simplified_vertices) for r in out.features.orderBy("_fid").collect()] == [(21, 2), (1, 1), (5, 5)]
    assert out.summary.first().vertex_reduction_percent == pytest.approx(70.4)
    m = V.metrics(layer(spark, [(square(-10, -10, 20), 4.0), (line((0, 0), (0, 1)), None)], "v double"))
    rows = m.features.orderBy("_fid").collect()
    assert rows[0].area_sqkm == pytest.approx(2465842, rel=1e-3) and rows[1].length_km == pytest.approx(111.319, abs=0.01) and rows[1].area_sqkm is None
    s = m.summary.first()
    assert s.feature_count == 2 and {x.attribute for x in s.attribute_statistics} >= {"v", "area_sqkm"}
    exact = layer(spark, [(square(-10, -10, 20),)]).select(G.area_m2("geom", 2.0)).first()[0]
    assert exact == pytest.approx(4.931684e12, rel=1e-3)


def test_random_points(spark):
    zone = layer(spark, [(square(0, 0, 1),), (square(3, 3, 1),)])
    rows = V.random_points(zone, 50, True, 1).features.collect()
    assert len(rows) == 50 and all(0 <= r.lng <= 1 and 0 <= r.lat <= 1 or 3 <= r.lng <= 4 and 3 <= r.lat <= 4 for r in rows)
    assert rows == V.random_points(zone, 50, True, 1).features.collect()


def test_attribute_filters(cities):
    names = lambda *a: {r.name for r in J.spatial_query(cities, *a).features.collect()}
    assert names("pop", ">", "3e7") == {"Tokyo"} and names("name", "contains", "LON") == {"London"} and names("name", "=", "tokyo") == {"Tokyo"}
    assert names("pop", ">", "many") == set() and names(None, "=", "1") == {"Tokyo", "New York", "London"} and names("nothing", "=", "1") == set() and names("name", ">=", "a") == set()


def test_mask_and_join(spark):
    pts = layer(spark, [(point(5, 5), "in"), (point(50, 50), "out")], "name string")
    mask = layer(spark, [(square(0, 0, 10), "A")], "zone string")
    assert [r.name for r in J.spatial_query(pts, mask=mask).features.collect()] == ["in"]
    s = J.spatial_query(pts, mask=mask).summary.first()
    assert (s.input_features, s.matched_features, s.match_rate_percent) == (2, 1, 50.0)
    assert J.spatial_query(pts, mask=pts).features.count() == 2
    shapes = layer(spark, [(square(40, 40, 1), "s")], "name string")
    assert J.spatial_query(shapes, mask=mask).features.count() == 1 and J.spatial_query(shapes, mask=mask, strict=True).features.count() == 0
    rows = {r.name: r for r in J.spatial_join(pts, mask).features.collect()}
    assert (rows["in"].sj_zone, rows["in"].sj_join_count, rows["out"].sj_zone, rows["out"].sj_join_count) == ("A", 1, None, 0)
    twice = layer(spark, [(square(0, 0, 10), "A"), (square(4, 4, 10), "B")], "zone string")
    assert {r.sj_zone for r in J.spatial_join(pts, twice).features.collect()} == {"2 matches", None}


def test_tiles_equal_brute_force(spark, monkeypatch):
    shapes = layer(spark, [(square(i * 3.3 % 40, i * 7.1 % 40, 4 + i % 9),) for i in range(60)])
    pts = layer(spark, [(point(i * 0.37 % 45, i * 0.91 % 45),) for i in range(400)])
    v = G.first_vertex("geom")
    want = {(r._fid, r.p_fid) for r in J.point_in_parts(pts, shapes, v["x"], v["y"]).collect()}
    monkeypatch.setattr(J, "small", lambda *a: False)
    got = [(r._fid, r.p_fid) for r in J.point_in_parts(pts, shapes, v["x"], v["y"]).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 400


def test_nearest_through_the_grid_equals_brute_force(spark, monkeypatch):
    pts = layer(spark, [(point((i * 77.7) % 360 - 180, (i * 31.3) % 170 - 85),) for i in range(120)])
    p = J.sample_points(pts)
    want = {r._fid: r.t_fid for r in J.nearest(p, p, True).collect()}
    monkeypatch.setattr(J, "small", lambda *a: False)
    got = J.nearest(p, p, True).collect()
    assert {r._fid: r.t_fid for r in got} == want and len(got) == 120


def test_key_join(spark):
    df = layer(spark, [(point(0, 0), "1"), (point(1, 1), " 2 "), (point(2, 2), "9")], "fid string")
    table = spark.createDataFrame([(0, "1", "10", 'a,"b"'), (1, "2", "20", "x"), (2, "1", "99", "later"), (3, "7", "5", "y")], "_row int, FID string, population string, label string")
    out = J.key_join(df, table, "fid")
    rows = [(r.join_population, r.join_label) for r in out.features.orderBy("_fid").collect()]
    assert rows == [(10.0, 'a,"b"'), (20.0, "x"), (None, None)]
    assert (out.summary.first().matched_features, out.summary.first().csv_rows) == (2, 4)
    with pytest.raises(ToolError):
        J.key_join(df, table, "fid", "nothing")


def test_overlay_and_dissolve(spark):
    a = layer(spark, [(square(0, 0, 2), "a")], "id string")
    b = layer(spark, [(square(1, 1, 2), "b")], "id string")
    for op, want in (("intersection", 1), ("difference", 3), ("symmetric_difference", 6), ("union", 7)):
        r = O.overlay(a, b, op).features.collect()
        assert len(r) == 1 and r[0].id == "a" and r[0].geom.type == "MultiPolygon" and area(r[0].geom.parts) == pytest.approx(want)
    hole = O.overlay(layer(spark, [(square(0, 0, 4),)]), layer(spark, [(square(1, 1, 1),)]), "difference").features.first().geom.parts
    assert len(hole) == 1 and len(hole[0]) == 2 and area(hole) == pytest.approx(15)
    two = layer(spark, [(square(0, 0, 1), "g"), (square(1, 0, 1), "g"), (square(9, 9, 1), None)], "k string")
    rows = {r.k: r for r in O.dissolve(two, "k").features.collect()}
    assert rows["g"].dissolved_parts == 1 and area(rows["g"].geom.parts) == pytest.approx(2) and rows[None].dissolved_parts == 1
    assert O.dissolve(two).features.first().dissolved_parts == 2
    with pytest.raises(ToolError):
        O.overlay(a, layer(spark, [(point(0, 0),)]))


def test_booleans_agree_with_areas():
    r = __import__("random").Random(5)
    box = lambda: [[(x := r.uniform(0, 5)), (y := r.uniform(0, 5)), x + r.uniform(0.5, 3), y + r.uniform(0.5, 3)] for _ in range(1)][0]  # noqa: E731, F841
    ring = lambda b: [[(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]]
    total = lambda ps: sum(K.signed_area(p[0]) + sum(K.signed_area(h) for h in p[1:]) for p in ps)
    for _ in range(60):
        a, b = box(), box()
        cut = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        sa, sb = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
        for op, want in (("intersection", cut), ("difference", sa - cut), ("symmetric_difference", sa + sb - 2 * cut), ("union", sa + sb - cut)):
            assert total(K.boolean([ring(a)], [ring(b)], op)) == pytest.approx(want, abs=1e-7)


def test_topology(spark):
    over = layer(spark, [(square(0, 0, 1),), (square(0.5, 0.5, 1),)])
    out = O.topology_check(over)
    assert out.features.first().overlap_area_m2 == pytest.approx(0.25 * 111320**2, rel=1e-6) and not out.summary.first().valid
    assert O.topology_check(layer(spark, [(square(0, 0, 1),), (square(1, 0, 1),)])).summary.first().valid
    lines = layer(spark, [(line((0, 0), (1, 0)),), (line((1, 0), (2, 0)),), (line((2, 0), (3, 0)),)])
    assert O.topology_check(lines, "must_not_have_dangles").features.count() == 2
    cover, pts = layer(spark, [(square(0, 0, 10),)]), layer(spark, [(point(5, 5),), (point(50, 5),)])
    assert [r.feature_index for r in O.topology_check(pts, "must_be_covered_by", cover).features.collect()] == [1]
    for bad in (("nothing", None), ("must_not_overlap", None)):
        with pytest.raises(ToolError):
            O.topology_check(pts, *bad)


def test_costs_settle_or_fail(spark):
    from terrastrata.operators import network as N

    path = layer(spark, [(line(*((i / 10, 0) for i in range(31))),)])
    _, edges = N.build(path)
    source = spark.createDataFrame([(0, 0, 0)], "source long, kx long, ky long")
    local = {(r.kx, r.ky): r.metres for r in N.costs(edges, source).collect()}
    far = {(r.kx, r.ky): r.metres for r in N.costs(edges, source, most_local=0).collect()}
    assert len(local) == 31 and local.keys() == far.keys() and all(abs(local[k] - far[k]) < 1e-6 for k in local)
    with pytest.raises(ToolError):
        N.costs(edges, source, rounds=5, most_local=0)
    assert N.costs(edges, source, most=50_000.0).count() == N.costs(edges, source, most=50_000.0, most_local=0).count() == 5


def test_polygons_judged_by_all_vertices(spark):
    ring = [(i / 100, 0) for i in range(39)] + [(10, 10), (0, 10), (0, 0)]
    many = layer(spark, [(K.geometry("Polygon", [ring]),)])
    target = layer(spark, [(square(9, 9, 2), "t")], "name string")
    assert J.spatial_join(many, target).features.first().sj_join_count == 0
    assert J.spatial_join(many, target, capped=False).features.first().sj_join_count == 1
