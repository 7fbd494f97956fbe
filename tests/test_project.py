import json

import pytest

from terrastrata.operators.result import ToolError
from terrastrata.plans import catalog, toolbox
from terrastrata.streaming import live

from .shapes import layer, point, square
from .test_raster import cone, raster
from .test_sources import PAIR


@pytest.fixture
def project(spark, tmp_path):
    return catalog.Project(spark, f"file://{tmp_path}/project")


def test_datasets_and_layers(spark, project):
    a = project.save_dataset(layer(spark, [(point(1, 2), "x"), (point(3, 4), "y")], "name string"), "one")
    b = project.save_dataset(layer(spark, [(square(0, 0, 1),)]), "two")
    row = {r.name: r for r in project.table("datasets").collect()}["one"]
    assert (row.feature_count, json.loads(row.geom_types), json.loads(row.bbox)) == (2, ["Point"], [1, 2, 3, 4]) and json.loads(row.properties_schema) == [{"name": "name", "field_type": "string"}]
    assert [r.z_index for r in project.table("layers").collect()] == [0, 1] and project.dataset(a["dataset_id"]).count() == 2
    created = row.created_at
    project.upsert("datasets", {**row.asDict(), "name": "renamed"})
    row = project.table("datasets").where("name = 'renamed'").first()
    assert row.created_at == created and row.updated_at >= created and project.table("datasets").count() == 2
    assert project.delete("layers", b["layer_id"]) and project.table("datasets").count() == 1
    assert project.delete("datasets", a["dataset_id"]) and project.table("layers").count() == 0 and not project.delete("datasets", "none")
    with pytest.raises(ToolError):
        project.save_dataset(layer(spark, []), "empty")


def test_console(spark, project):
    a = project.save_dataset(layer(spark, [(point(1, 2), 5.0), (point(3, 4), 7.0)], "v double"), "one")
    name = "dataset_" + a["dataset_id"].replace("-", "_")
    assert project.query(f"WITH t AS (SELECT * FROM {name}) SELECT sum(v) AS s FROM t").first().s == 12
    assert project.query("select name from datasets where name <> 'drop table x; --'").count() == 1
    for bad in ("DROP TABLE datasets", "SELECT 1; DELETE FROM datasets", "WITH t AS (SELECT 1) INSERT INTO datasets SELECT * FROM t", "", "/* x */ SET a = 1", "select reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.Math', 'random')", "SELECT 1 WHERE EXISTS (SELECT try_reflect('a', 'b'))",
                "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/x`", "SELECT * FROM read_files('/etc')", "SELECT * FROM elsewhere", "WITH a AS (SELECT * FROM b) SELECT * FROM a", "SELECT (SELECT count(*) FROM csv.`/etc/passwd`)", "SHOW TABLES", "EXPLAIN DROP TABLE datasets", "SELECT input_file_name() FROM datasets"):
        with pytest.raises(ToolError):
            project.query(bad)


def test_console_reads_what_only_looks_like_writing(spark):
    from terrastrata.plans import catalog

    t = spark.createDataFrame([(1, "x"), (2, "y")], "load int, `set` string")
    spark.createDataFrame([(9,)], "a int").createOrReplaceTempView("t")
    assert catalog.sql_console(spark, "SELECT load, `set` FROM t ORDER BY load", {"t": t}).first().load == 1
    assert spark.table("t").columns == ["a"]
    for text, n in (("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", 5), ("SELECT * FROM T WHERE load IN (SELECT load FROM t)", 2), ("TABLE t", 2), ("VALUES (1), (2)", 2), ("SELECT row_number() OVER w AS n FROM t WINDOW w AS (ORDER BY load)", 2), ("SELECT * FROM range(3)", 3), ("(SELECT 1) UNION (SELECT 2);", 2), ("SELECT explode(array(load, 7)) FROM t", 4), ("SELECT load FROM t GROUP BY load HAVING count(*) > 0", 2), ("SELECT a.load FROM t a, LATERAL (SELECT a.load + 1 AS z) b", 2)):
        assert catalog.sql_console(spark, text, {"t": t}).count() == n, text
    assert catalog.sql_console(spark, "EXPLAIN SELECT * FROM t", {"t": t}).count() == 1


def test_tools_end_to_end(spark, project):
    a = project.save_dataset(layer(spark, [(point(1, 2), 5.0), (point(3, 4), 7.0), (point(5, 1), 9.0)], "v double"), "pts")["dataset_id"]
    zone = project.save_dataset(layer(spark, [(square(0, 0, 4),)]), "zone")["dataset_id"]
    assert toolbox.run(project, "buffer", a, distance_m=1000.0).features.count() == 3
    assert toolbox.run(project, "spatial_query", a, mask=zone).features.count() == 1
    assert toolbox.run(project, "mean_center", geojson=PAIR).summary.first().feature_count == 2
    saved = project.add_result(toolbox.run(project, "centroid", a), "centroids")
    assert project.dataset(saved["dataset_id"]).count() == 3
    h = project.history().collect()
    assert [r.tool_name for r in h] == ["centroid", "mean_center", "spatial_query", "buffer"] and json.loads(h[-1].result_summary_json)["buffered_features"] == 3
    assert project.stats().first().calculations == 4
    for bad in (lambda: toolbox.run(project, "nothing", a), lambda: toolbox.run(project, "buffer", "none"), lambda: toolbox.run(project, "buffer")):
        with pytest.raises(ToolError):
            bad()


def test_every_tool_runs(spark, project):
    pts = layer(spark, [(point(i * 1.3 % 5, i * 0.7 % 4), float(i), float(i * i % 7), f"k{i}") for i in range(12)], "v double, w double, id string")
    zone, roads = layer(spark, [(square(0, 0, 3), "a"), (square(2, 2, 3), "b")], "z string"), layer(spark, [(__import__("tests.shapes", fromlist=["line"]).line((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)),)])
    table = spark.createDataFrame([("k1", "5")], "id string, n string")
    how = {
        "buffer": (pts, {}), "convex_hull": (pts, {}), "centroid": (pts, {}), "bbox": (pts, {}), "simplify": (roads, {}), "metrics": (zone, {}), "spatial_binning": (pts, {}), "random_points": (zone, {"count": 5}), "spatial_query": (pts, {"field": "v", "op": ">", "value": "3"}),
        "distance_matrix": (pts, {}), "overlay": (zone, {"mask": zone, "operation": "clip"}), "dissolve": (zone, {}), "spatial_join": (pts, {"target": zone}), "mean_center": (pts, {}), "median_center": (pts, {}), "directional_mean": (roads, {}), "morans_i": (pts, {"field": "v"}), "getis_ord": (pts, {"field": "v"}),
        "ols_regression": (pts, {"dependent": "v", "explanatory": "w"}), "idw": (pts, {"field": "v"}), "kriging": (pts, {"field": "v", "cell_size_km": 100.0}), "shortest_path": (roads, {"start": (0.0, 0.0), "end": (1.0, 1.0)}), "service_area": (roads, {"facility": (0.0, 0.0), "max_distance_m": 150_000.0}), "od_matrix": (roads, {"origins": pts, "destinations": pts}), "topology_check": (zone, {}), "join_csv": (pts, {"table": table}),
    }
    assert how.keys() == toolbox.VECTOR.keys()
    for tool, (df, parameters) in how.items():
        out = toolbox.VECTOR[tool](df, **parameters)
        assert out.features.columns and out.summary.count() == 1, tool
    cells, grid = raster(spark, cone)
    key = project.save_raster(cells, grid, "hill")
    for tool, parameters in {"slope": {}, "hillshade": {}, "raster_calculator": {"expression": "a + b", "b": key}, "d8_flow": {}, "zonal_stats": {"zones": layer(spark, [(square(0.01, 0.01, 0.05),)])}, "viewshed": {"observer": (0.04, 0.04)}}.items():
        assert toolbox.run(project, tool, key, **parameters).features.count() > 0, tool
    assert len(toolbox.VECTOR) + len(toolbox.RASTER) == 32
    assert project.delete("rasters", key) and project.table("rasters").count() == 0


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id * 7) AS ts, id % 5 * 1.0D AS x, id % 3 * 1.0D AS y FROM range(40)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = live.binned(stream, 2.0, "1 hour", "10 minutes").writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, live.binned(rows, 2.0, "1 hour").collect()))
    q = live.located(stream, layer(spark, [(square(-0.5, -0.5, 2),)])).select("x", "y").writeStream.format("memory").queryName("held").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("held").count() == rows.where("x < 1.5 and y < 1.5").count() > 0


def test_reports(spark):
    from terrastrata.plans import reports

    assert [reports.human(x) for x in (5, 5.0, 0.12345, 3.14159, 12_345, 2_500_000, 7.1e9)] == ["5", "5", "0.1235", "3.14", "12.3k", "2.5M", "7.1B"]
    s = spark.sql("SELECT 3 AS a, named_struct('b', 1.5D, 'c', named_struct('d', true)) AS s, array(1, 2, 3, 4, 5, 6, 7) AS l, null AS n")
    assert reports.flattened(s) == [("a", "3"), ("s.b", "1.50"), ("s.c.d", "True"), *((f"l[{i}]", str(i + 1)) for i in range(6))]
    t = reports.preview(layer(spark, [(point(1, 2), "x", None), (point(3, 4), "y", 2.0)], "b string, a double"), 1)
    assert t.columns == ["_fid", "a", "b", "lng", "lat"] and tuple(t.first()) == (0, "", "x", 1.0, 2.0)
