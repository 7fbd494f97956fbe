"""Geodata derived from the driver's tables by integer arithmetic, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.raster import Grid


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lng(k: Column | str) -> Column:
    return (G.col(k).cast("long") * 7919 % 36000).cast("double") / 100.0 - 180.0


def lat(k: Column | str) -> Column:
    return (G.col(k).cast("long") * 104729 % 16000).cast("double") / 100.0 - 80.0


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("_fid"), G.point(lng("c_custkey"), lat("c_custkey")).alias("geom"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("_fid"), G.point(lng("s_suppkey"), lat("s_suppkey")).alias("geom"), "s_name", "s_nationkey", "s_acctbal")


def nations(spark: SparkSession, d: str, dx: float = 0.0, dy: float = 0.0, w: float = 72.0, h: float = 32.0) -> DataFrame:
    """Rectangles on a lattice of five by five."""
    n = F.col("n_nationkey").cast("long")
    x, y = (n % 5).cast("double") * 72.0 - 180.0 + dx, F.floor(n / 5).cast("double") * 32.0 - 80.0 + dy
    return read(spark, d, "nation").select(n.alias("_fid"), G.rectangle(x, y, x + w, y + h).alias("geom"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def user_lines(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    v = F.struct("ts", "event_id", lng("event_id").alias("x"), lat("event_id").alias("y"))
    return e.groupBy(F.col("user_id").cast("long").alias("_fid")).agg(F.sort_array(F.collect_list(v)).alias("vs")).select("_fid", G.line(F.transform("vs", lambda v: G.vertex(v["x"], v["y"]))).alias("geom"))


def lattice(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a street lattice of a tenth of a degree, fifty nodes wide: from each node (a part) to the one right of it and the one above."""
    k = F.col("p_partkey").cast("long")
    nodes = read(spark, d, "part").select(k.alias("k"), (k % 50).alias("i"), F.floor(k / 50).alias("j"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj"))))
    e = nodes.select("k", "i", "j", step.alias("s")).withColumn("to", F.col("k") + F.col("s.di") + F.col("s.dj") * 50).join(nodes.select(F.col("k").alias("to")), "to", "left_semi")
    e = e.where(F.col("i") + F.col("s.di") < 50)
    at = lambda c, o: (F.col(c) + F.col(f"s.{o}")) / 10.0
    return e.select((F.col("k") * 2 + F.col("s.dj")).alias("_fid"), G.line(F.array(G.vertex(F.col("i") / 10.0, F.col("j") / 10.0), G.vertex(at("i", "di"), at("j", "dj")))).alias("geom"))


def dem(spark: SparkSession, d: str, tilt: float = 0.0) -> tuple[DataFrame, Grid]:
    p = read(spark, d, "part")
    k = F.col("p_partkey").cast("long")
    height = -(-p.count() // 50)
    cells = p.select((k % 50).cast("int").alias("x"), F.floor(k / 50).cast("int").alias("y"), (F.col("p_retailprice") + k * tilt).alias("value"))
    return cells, Grid(50, height, 0.0, 0.0, 5.0, height / 10.0)


# --- the same in SQL -------------------------------------------------------------------------------------------------

LNG = "(CAST(CAST({k} AS BIGINT) * 7919 % 36000 AS DOUBLE) / 100 - 180)"
LAT = "(CAST(CAST({k} AS BIGINT) * 104729 % 16000 AS DOUBLE) / 100 - 80)"


def sql_points(table: str, key: str) -> str:
    return f"SELECT CAST({key} AS BIGINT) AS fid, {LNG.format(k=key)} AS x, {LAT.format(k=key)} AS y, t.* FROM {table} t"


CUSTOMERS = f"customers AS ({sql_points('customer', 'c_custkey')})"
SUPPLIERS = f"suppliers AS ({sql_points('supplier', 's_suppkey')})"


def sql_nations(name: str = "nations", dx: float = 0, dy: float = 0, w: float = 72, h: float = 32) -> str:
    x, y = f"(CAST(n_nationkey % 5 AS DOUBLE) * 72 - 180 + {dx})", f"(CAST(n_nationkey // 5 AS DOUBLE) * 32 - 80 + {dy})"
    return f"{name} AS (SELECT CAST(n_nationkey AS BIGINT) AS fid, {x} AS x0, {y} AS y0, {x} + {w} AS x1, {y} + {h} AS y1, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)"


NATIONS = sql_nations()
EVENTS = f"ev AS (SELECT CAST(user_id AS BIGINT) AS fid, {LNG.format(k='event_id')} AS x, {LAT.format(k='event_id')} AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
SEGMENTS = f"{EVENTS}, seg AS (SELECT a.fid, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ev a JOIN ev b ON a.fid = b.fid AND b.n = a.n + 1)"


def sql_lattice() -> str:
    return """nd AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey AS BIGINT) % 50 AS i, CAST(p_partkey AS BIGINT) // 50 AS j FROM part),
ed AS (SELECT k * 2 + dj AS fid, i, j, i + di AS i2, j + dj AS j2, CAST(i AS DOUBLE) / 10 AS x1, CAST(j AS DOUBLE) / 10 AS y1, CAST(i + di AS DOUBLE) / 10 AS x2, CAST(j + dj AS DOUBLE) / 10 AS y2 FROM nd, (VALUES (1, 0), (0, 1)) s(di, dj) WHERE i + di < 50 AND k + di + dj * 50 IN (SELECT k FROM nd))"""


def sql_dem(tilt: float = 0) -> str:
    t = f" + CAST(p_partkey AS DOUBLE) * {tilt}" if tilt else ""
    return f"""dem AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_partkey // 50 AS INTEGER) AS y, p_retailprice{t} AS v FROM part),
hgt AS (SELECT ceil(count(*) / 50.0) AS h FROM part),
cel AS (SELECT greatest(0.1::DOUBLE * 111320 * greatest(0.01, cos(h / 10 / 2)), 0.1::DOUBLE * 110540, 1e-6) AS m, CAST(h AS INTEGER) AS h FROM hgt)"""


def sql_round(x: str, n: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e{n}::DOUBLE + 0.5) / 1e{n}::DOUBLE)"


def sql_haversine(x1: str, y1: str, x2: str, y2: str) -> str:
    a = f"(power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2))"
    return f"(12756274.0::DOUBLE * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0))))"


def sql_p_value(z: str) -> str:
    x, t = f"(abs({z}) / sqrt(2::DOUBLE))", f"(1 / (1 + abs({z}) / sqrt(2::DOUBLE) * 0.3275911::DOUBLE))"
    poly = f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))))"
    return f"(1 - (1 - {poly} * exp(-{x} * {x})))"
