"""What a tool returns, and checks that tools share.

Features are rows of _fid (their order), geom and attributes; a summary is a DataFrame of one row, computed when asked for.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Rows of a side that may be broadcast, checked by a count; beyond it joins go by tiles or shuffles.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class ToolResult:
    features: DataFrame
    summary: DataFrame


class ToolError(ValueError):
    """A tool can't run on this input."""


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ToolError(message)


def checkpoints(spark: SparkSession) -> None:
    """Sees to it that checkpoint() has a folder: the shared one that spark.checkpoint.dir names; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        need(named is not None or sc.master.startswith("local"), "spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_fid", "geom")]


def count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count(F.when(condition, 1))


def polygons(df: DataFrame) -> DataFrame:
    return df.where(F.col("geom.type").isin("Polygon", "MultiPolygon"))


def parts(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each part of a geometry (collections: of each member), with its place."""
    return df.select("_fid", *keep, F.posexplode(G.all_parts("geom")).alias("part_index", "part"))


def small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether df has few enough rows to be broadcast; stops counting beyond the bound."""
    return df.limit(most + 1).count() <= most


def total_area_km2(df: DataFrame, name: str) -> Column:
    return G.rounded(F.coalesce(F.sum(G.area_m2("geom")), F.lit(0.0)) / 1e6, 3).alias(name)
