import math

import pytest

from terrastrata.operators import raster as R
from terrastrata.operators.result import ToolError

from .shapes import layer, square


def raster(spark, f, n=8):
    return spark.createDataFrame([(x, y, float(f(x, y))) for y in range(n) for x in range(n)], "x int, y int, value double"), R.Grid(n, n, 0.0, 0.0, n / 100, n / 100)


cone = lambda x, y: 100 - 10 * math.hypot(x - 3.5, y - 3.5)


def values(df):
    return {(r.x, r.y): r.value for r in df.collect()}


def test_surfaces(spark):
    flat, grid = raster(spark, lambda x, y: 5)
    assert set(values(R.slope(flat, grid)).values()) == {0.0} and set(values(R.aspect(flat, grid)).values()) == {180.0}
    hill, grid = raster(spark, cone)
    assert all(0 <= v <= 1 for v in values(R.hillshade(hill, grid)).values()) and max(values(R.slope(hill, grid)).values()) > 0
    east, grid = raster(spark, lambda x, y: x)
    a, b = values(R.aspect(east, grid)), values(R.aspect(east, grid, "downslope"))
    assert a[4, 4] == 90.0 and b[4, 4] == 270.0
    s = values(R.slope(east, grid))
    assert s[0, 0] == pytest.approx(math.degrees(math.atan(0.5 / grid.metres))) and s[4, 4] == pytest.approx(math.degrees(math.atan(1 / grid.metres)))


def test_calculator(spark):
    a, _ = raster(spark, cone)
    b = a.withColumn("value", a.value * 0 + 2)
    va = values(a)
    for text, f in (("a / b", lambda v: v / 2), ("min(a, b) + max a b", lambda v: v + 2), ("-a * (1 + 2e0) - -b", lambda v: -3 * v + 2), ("SQRT(abs(a - 90)) + log(b)", lambda v: math.sqrt(abs(v - 90)) + math.log(2))):
        assert values(R.calculator(a, text, b)) == pytest.approx({k: f(v) for k, v in va.items()})
    assert all(math.isnan(v) for v in values(R.calculator(a, "a / (b - b) + 1", b)).values())
    assert all(math.isnan(v) for v in values(R.calculator(a, "log(a - a)")).values())
    s = R.summary(R.calculator(a, "a * 1.0")).first()
    assert s.cells == 64 and s.max == pytest.approx(max(va.values()), abs=1e-3)
    for bad in ("a +", "(a", "a b", "foo(a)", "a / b", "a ; b"):
        with pytest.raises(ToolError):
            R.calculator(a, bad)


def test_flow(spark):
    pit, grid = raster(spark, lambda x, y: -cone(x, y) + 0.01 * x + 0.003 * y)
    d = R.d8(pit, grid)
    assert d.where("value = 0").count() == 1
    acc = values(R.flow_accumulation(d))
    assert max(acc.values()) == 64
    down = {(r.x, r.y): (r.tx, r.ty) for r in d.collect()}
    want = dict.fromkeys(down, 0)
    for c in down:
        while c[0] is not None:
            want[c] += 1
            c = down[c]
    assert acc == want


def test_zones_sight_and_display(spark):
    hill, grid = raster(spark, cone)
    z = R.zonal(layer(spark, [(square(0.015, 0.015, 0.04), "z"), (square(5, 5, 1), "far")], "name string"), hill, grid).features.collect()
    assert len(z) == 1 and z[0].cell_count > 4 and z[0].zonal_max > z[0].zonal_min and z[0].name == "z"
    flat, grid = raster(spark, lambda x, y: 5)
    assert sum(values(R.viewshed(flat, grid, 0.04, 0.04)).values()) == 64
    wall, grid = raster(spark, lambda x, y: 1000 if x == 4 else 0)
    seen = values(R.viewshed(wall, grid, 0.01, 0.04))
    assert seen[2, 4] == 1 and seen[7, 4] == 0
    assert R.shown(hill, grid, 16).count() == 16 and R.shown(hill, grid).count() == 64
    holes = hill.withColumn("value", R.F.when(hill.x == 0, float("nan")).otherwise(hill.value))
    assert R.summary(holes).first().cells == 56 and R.slope(holes, grid).count() == 56
