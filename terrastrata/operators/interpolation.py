"""Surfaces from samples: prediction grids, inverse distance weighting, variograms, ordinary kriging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from . import pairs
from .result import ToolResult, count, need, small
from .statistics import KM_PER_DEGREE, numeric

LAGS = 12
MOST_IDW, MOST_KRIGING, MOST_SAMPLES = 200, 150, 400


def samples(df: DataFrame, field: str) -> DataFrame:
    return numeric(df, field)


def grid(pts: DataFrame, cell_km: float, most: int) -> DataFrame:
    """(cell, x, y): a grid over the samples' extent, padded by a fiftieth of its larger span; steps are equal in degrees and at most `most` columns and rows are made, from the lower left."""
    b = pts.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    pad = F.lit(0.02) * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(0.01))
    step = max(1e-4, cell_km / KM_PER_DEGREE)
    b = b.select((F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))
    n = lambda lo, hi: F.least(F.lit(most), (F.ceil((F.col(hi) - F.col(lo)) / step) + 1).cast("int"))
    b = b.withColumns({"cols": n("x0", "x1"), "rows": n("y0", "y1")})
    cells = b.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return cells.select((F.col("row").cast("long") * F.col("cols") + F.col("col")).alias("cell"), (F.col("x0") + F.col("col") * step).alias("x"), (F.col("y0") + F.col("row") * step).alias("y"))


def nearest_k(cells: DataFrame, pts: DataFrame, k: int) -> DataFrame:
    """(cell, x, y, d, v, n): each cell's k nearest samples by great circle, ties by _fid. Cells are bounded by the grid's cap; samples beyond a checked count are joined by blocks, each block keeping its own k nearest before they meet."""
    p = pts.select("_fid", F.col("x").alias("px"), F.col("y").alias("py"), "v")
    d = G.haversine(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    if small(p, 5_000):
        pairs = cells.crossJoin(F.broadcast(p)).select("cell", "x", "y", "_fid", "v", d.alias("d"))
    else:
        blocks = max(1, -(-p.count() // 2_000))
        spread = cells.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = spread.join(p.withColumn("g", F.pmod(F.xxhash64("_fid"), F.lit(blocks))), "g").select("cell", "x", "y", "g", "_fid", "v", d.alias("d"))
        pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("g", "cell").orderBy("d", "_fid"))).where(F.col("n") <= k).drop("n", "g")
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("d", "_fid"))).where(F.col("n") <= k)


def surface_summary(out: DataFrame) -> DataFrame:
    r = lambda c: G.rounded(c, 3)
    return out.agg(count().alias("grid_cells"), r(F.min("predicted")).alias("predicted_min"), r(F.max("predicted")).alias("predicted_max"), r(F.avg("predicted")).alias("predicted_mean"))


def idw(df: DataFrame, field: str, power: float = 2.0, cell_km: float = 50.0, neighbours: int = 12) -> ToolResult:
    """Each cell's nearest samples weighted by distance to the power; a sample within a metre gives its value alone."""
    need(power > 0, "the power must be positive")
    pts = samples(df, field)
    need(pts.limit(3).count() >= 3, "three samples are needed")
    near = nearest_k(grid(pts, cell_km, MOST_IDW), pts, neighbours)
    w = F.pow(F.greatest(F.col("d"), F.lit(1e-12)), F.lit(-float(power)))
    got = near.groupBy("cell", "x", "y").agg(F.min(F.when(F.col("d") < 1.0, F.struct("d", "n", "v"))).alias("hit"), F.sum(w * F.col("v")).alias("wv"), F.sum(w).alias("w"))
    value = F.when(F.col("hit").isNotNull(), F.col("hit.v")).otherwise(F.col("wv") / F.col("w"))
    out = got.select(F.col("cell").alias("_fid"), G.point(F.col("x"), F.col("y")).alias("geom"), G.rounded(value, 3).alias("predicted"), G.rounded(F.when(F.col("hit").isNotNull(), 1.0).otherwise(F.col("w")), 3).alias("idw_weight_sum"))
    return ToolResult(out, surface_summary(out).withColumns({"method": F.lit("idw"), "field": F.lit(field), "power": F.lit(float(power)), "cell_size_km": F.lit(float(cell_km)), "max_neighbors": F.lit(neighbours)}))


def model_value(model: str, h: Column, nugget: Column, sill: Column, reach: Column) -> Column:
    c, r = F.greatest(F.lit(0.0), sill - nugget), h / reach
    if model == "exponential":
        return nugget + c * (F.lit(1.0) - F.exp(r * -3.0))
    inner = nugget + c * (F.lit(1.0) - F.exp(r * r * -3.0)) if model == "gaussian" else nugget + c * (r * 1.5 - r * r * r * 0.5)
    return F.when(h >= reach, sill).otherwise(inner)


def semivariogram(pts: DataFrame, lags: int = LAGS) -> tuple[DataFrame, float, float]:
    """(bins, largest lag, mean): bins are (bin, h, total, n), half squared differences of pairs by lags up to half the largest distance (at least half a metre), h being the lag's middle; the mean is over all pairs."""
    pts = pts.cache()
    n, mean = pts.agg(count(), F.var_samp("v")).first()  # the mean of half squared differences is the variance
    units = pairs.all_units(pts, n)
    far = pairs.over(units, pairs.farthest, "far double").agg(F.max("far")).first()[0]
    top = max(1.0, far or 0.0) / 2
    bins = pairs.over(units, lambda a, b, same: pairs.lag_sums(a, b, same, top, lags), "bin int, n long, total double").groupBy("bin").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return bins.select("bin", ((F.col("bin") + 0.5) / lags * top).alias("h"), "total", "n"), top, mean or 0.0


def variogram_fit(bins: DataFrame, lag_max: float, mean: float, model: str = "spherical") -> DataFrame:
    """nugget, sill and reach of the candidate (shares of sill and lag) with the least weighted error against the bins' sums; of equals the first."""
    spark, sill = bins.sparkSession, max(1e-9, 2 * mean)
    tries = spark.createDataFrame([(a * sill, sill, b * lag_max) for a in (0.0, 0.1, 0.25, 0.5) for b in (0.15, 0.3, 0.5, 0.75, 1.0)], "nugget double, sill double, reach double")
    miss = F.col("n") * F.pow(model_value(model, F.col("h"), F.col("nugget"), F.col("sill"), F.col("reach")) - F.col("total"), F.lit(2.0))
    errors = tries.join(F.broadcast(bins), F.lit(True), "left").groupBy("nugget", "sill", "reach").agg(F.coalesce(F.sum(miss), F.lit(0.0)).alias("error"))  # 20 candidates, 12 bins
    return errors.agg(F.min(F.struct("error", "nugget", "reach", "sill")).alias("b")).select("b.nugget", "b.sill", "b.reach", "b.error")


def kriging(df: DataFrame, field: str, model: str = "spherical", cell_km: float = 50.0, neighbours: int = 12, most_samples: int = MOST_SAMPLES, reference_compat: bool = False) -> ToolResult:
    """Ordinary kriging. Samples are at most most_samples, so they go to every task; cells are dealt out. reference_compat sets the system's last right-hand side to 0 (weights that sum to 0) instead of 1."""
    pts = samples(df, field)
    n = pts.limit(most_samples + 1).count()
    need(n >= 3, "three samples are needed")
    need(n <= most_samples, f"more than {most_samples} samples")
    fit = variogram_fit(*semivariogram(pts), model).first()
    held = np.array([(r.x, r.y, r.v) for r in pts.orderBy("_fid").select("x", "y", "v").collect()])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, e = K.kriged(b[["x", "y"]].to_numpy(), held, neighbours, model, fit.nugget, fit.sill, fit.reach, 0.0 if reference_compat else 1.0)
            yield b.assign(p=p, e=e)[["cell", "x", "y", "p", "e"]]

    cells = grid(pts, cell_km, MOST_KRIGING)
    got = cells.repartition("cell").mapInPandas(solve, "cell long, x double, y double, p double, e double").where("not isnan(p)")
    out = got.select(F.col("cell").alias("_fid"), G.point(F.col("x"), F.col("y")).alias("geom"), G.rounded(F.col("p"), 3).alias("predicted"), G.rounded(F.col("e"), 3).alias("standard_error"))
    s = out.agg(count().alias("grid_cells"), G.rounded(F.avg("standard_error"), 3).alias("mean_standard_error"))
    r = lambda x, d: G.rounded(F.lit(float(x)), d)
    return ToolResult(out, s.withColumns({"method": F.lit("ordinary_kriging"), "field": F.lit(field), "variogram_model": F.lit(model), "nugget": r(fit.nugget, 3), "sill": r(fit.sill, 3), "range_km": r(fit.reach / 1000, 1)}))
