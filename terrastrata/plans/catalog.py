"""A project: datasets, layers, tabs, history, bookmarks and rasters as Parquet tables of a folder, and a guarded SQL console over them.

Each table is small (a row a thing); features and cells are Parquet folders of their own, partitioned by nothing and read by
id. A change writes a new version of a table and then moves the pointer, so a failed write leaves the old version in place.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import kernels as K
from ..operators.raster import Grid
from ..operators.result import ToolError, ToolResult, attributes, need

TABLES = {
    "datasets": "id string, name string, format string, feature_count bigint, geom_types string, bbox string, properties_schema string, created_at string, updated_at string",
    "layers": "id string, dataset_id string, name string, is_visible boolean, opacity double, style string, z_index int, created_at string",
    "calculation_tabs": "id string, title string, active_tool string, created_at string, updated_at string",
    "calculations": "id string, tab_id string, tool_name string, parameters_json string, result_summary_json string, execution_time_ms bigint, created_at string",
    "bookmarks": "id string, name string, center_lat double, center_lng double, zoom double, created_at string",
    "rasters": "id string, name string, width int, height int, cell_size_m double, bbox string, nodata double, created_at string",
}
ORDER = {"datasets": ("created_at", False), "layers": ("z_index", True), "calculation_tabs": ("created_at", True), "calculations": ("created_at", False), "bookmarks": ("created_at", False), "rasters": ("created_at", False)}
HISTORY, MOST_HISTORY = 15, 100


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


# --- the console -----------------------------------------------------------------------------------------------------

#: What a statement's plan may consist of, by the names of the parser's nodes.
QUERY_NODES = set("""Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Join LateralJoin AsOfJoin SubqueryAlias UnresolvedSubqueryColumnAliases
UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation Distinct Deduplicate Union Intersect Except UnresolvedWith UnresolvedHaving Window
WithWindowDefinition Generate Pivot UnresolvedPivot Unpivot Expand Sample ExplainCommand UnresolvedTableValuedFunction ParameterizedQuery""".split())
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "sequence", "values"}
#: Functions that call code, or tell of files and the session.
CLOSED = set("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_catalog current_database current_schema version raise_error session_user user current_user".split())


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def guard(spark: SparkSession, text: str, tables: set[str]) -> None:
    """Only one statement that reads, judged by its parsed plan: nodes of queries, the given tables and the statement's own names, no functions that call code."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";"))
    except Exception as e:  # the parser's own error, which comes wrapped
        raise ToolError(f"the statement can't be read: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
    known = {t.lower() for t in tables}

    def of_plan(node, names: set[str]) -> None:
        kind = node.getClass().getSimpleName()
        need(kind in QUERY_NODES, f"only statements that read are allowed, not {kind}")
        if kind == "ExplainCommand":
            return of_plan(node.logicalPlan(), names)
        if kind == "UnresolvedWith":
            own = set(names)
            for pair in _each(node.cteRelations()):
                of_plan(pair._2(), own | ({pair._1().lower()} if node.allowRecursion() else set()))
                own.add(pair._1().lower())
            return of_plan(node.child(), own)
        if kind == "UnresolvedRelation":
            parts = _each(node.multipartIdentifier())
            need(len(parts) == 1 and parts[0].lower() in names, f"there is no table {'.'.join(parts)}")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_each(node.name())).lower()
            need(name in TABLE_FUNCTIONS, f"{name} is not allowed")
        for e in _each(node.expressions()):
            of_expression(e, names)
        for child in _each(node.children()):
            of_plan(child, names)

    def of_expression(e, names: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = ".".join(_each(e.nameParts())).lower()
            need(name not in CLOSED and "." not in name, f"{name} is not allowed")
        need(kind not in ("CallMethodViaReflection", "Reflect"), f"{kind} is not allowed")
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "UnresolvedExists"):
            of_plan(e.plan(), names)
        for child in _each(e.children()):
            of_expression(child, names)

    of_plan(plan, known)


def sql_console(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The statement's rows over the given tables, which it sees by name. It runs in a session of its own, so the caller's views stay as they are and it sees none of them."""
    guard(spark, text, set(tables))
    own = spark.newSession()
    for name, df in tables.items():
        own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return own.sql(text.strip().rstrip(";"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def _wkb_struct() -> T.StructType:
    vertex = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
    parts = T.ArrayType(T.ArrayType(T.ArrayType(vertex)))
    member = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", parts)])
    return T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", parts), T.StructField("members", T.ArrayType(member))])


def to_wkb(df: DataFrame) -> DataFrame:
    """geom as little-endian WKB."""

    @F.pandas_udf(T.BinaryType())
    def run(g: pd.DataFrame) -> pd.Series:
        return pd.Series([K.to_wkb(r) for r in g.to_dict("records")])

    return df.withColumn("geom", run("geom"))


def from_wkb(df: DataFrame) -> DataFrame:
    """geom from WKB; null where it can't be read."""

    @F.pandas_udf(_wkb_struct())
    def run(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.from_wkb(bytes(x)) or {"type": None, "parts": None, "members": None} for x in b], columns=["type", "parts", "members"])

    g = df.withColumn("geom", run("geom"))
    return g.withColumn("geom", F.when(F.col("geom.type").isNotNull(), F.col("geom")))


# --- the project -----------------------------------------------------------------------------------------------------

#: The styles that new layers start with.
STYLES = {"imported": {"color": "#3b82f6", "fill_opacity": 0.4, "weight": 2}, "result": {"color": "#f59e0b", "fill_opacity": 0.5, "weight": 2}}


class Project:
    """Tables and data under a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Versions are folders; the newest one with a _SUCCESS file counts. The file system is Spark's.
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[str]:
        fs, path = self._fs()
        top = path(f"{self.folder}/{name}")
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        return sorted(p.toString() for p in found)

    def table(self, name: str) -> DataFrame:
        """A catalog table in its listing order."""
        need(name in TABLES, f"no table {name}")
        found = self._versions(name)
        df = self.spark.read.schema(TABLES[name]).parquet(found[-1]) if found else self.spark.createDataFrame([], TABLES[name])
        by, up = ORDER[name]
        return df.orderBy(F.col(by).asc() if up else F.col(by).desc(), "id")

    def _write(self, name: str, df: DataFrame) -> None:
        old = self._versions(name)
        at = int(old[-1].rsplit("v", 1)[1]) + 1 if old else 0
        df.coalesce(1).write.parquet(f"{self.folder}/{name}/v{at:010d}")
        fs, path = self._fs()
        for v in old[:-1]:
            fs.delete(path(v), True)

    def upsert(self, name: str, row: dict) -> str:
        """Adds a row or replaces the one of its id, whose created_at stays."""
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        old = self.table(name)
        before = old.where(F.col("id") == row["id"]).first() if row.get("id") else None
        row = {"id": str(uuid.uuid4()), **{k: v for k, v in row.items() if v is not None or k != "id"}}
        row["created_at"] = before["created_at"] if before else row.get("created_at") or now()
        if "updated_at" in schema.names:
            row["updated_at"] = now()
        new = self.spark.createDataFrame([tuple(row.get(c) for c in schema.names)], schema)
        self._write(name, old.where(F.col("id") != row["id"]).unionByName(new))
        return row["id"]

    def delete(self, name: str, key: str) -> bool:
        """Removes a row; a dataset takes its layers along, a layer that was its dataset's last takes the dataset."""
        old = self.table(name)
        row = old.where(F.col("id") == key).first()
        if row is None:
            return False
        self._write(name, old.where(F.col("id") != key))
        if name == "datasets":
            self._write("layers", self.table("layers").where(F.col("dataset_id") != key))
        if name == "layers" and self.table("layers").where(F.col("dataset_id") == row["dataset_id"]).isEmpty():
            self.delete("datasets", row["dataset_id"])
        return True

    def save_dataset(self, df: DataFrame, name: str, kind: str = "geojson", style: str = "imported", key: str | None = None) -> dict:
        """Features as a dataset with a layer of its own."""
        key = key or str(uuid.uuid4())
        path = f"{self.folder}/data/{key}"
        df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.parquet(path)
        b = F.struct(*(f(f"b.{k}").alias(k) for f, k in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
        one = saved.withColumn("b", G.bounds("geom")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("geom.type")).alias("types"), b.alias("b")).first()
        need(one.n > 0, "there are no features")
        types = {"double": "number", "bigint": "number", "int": "number", "boolean": "boolean"}
        schema = [{"name": c, "field_type": types.get(t, "string")} for c, t in sorted(saved.dtypes) if c in attributes(saved)]
        self.upsert("datasets", {"id": key, "name": name, "format": kind, "feature_count": one.n, "geom_types": json.dumps(one.types), "bbox": json.dumps(list(one.b) if one.b.x0 is not None else None), "properties_schema": json.dumps(schema)})
        top = self.table("layers").agg(F.coalesce(F.max("z_index"), F.lit(-1))).first()[0]
        layer = self.upsert("layers", {"dataset_id": key, "name": name, "is_visible": True, "opacity": 1.0, "style": json.dumps(STYLES[style]), "z_index": top + 1})
        return {"dataset_id": key, "layer_id": layer, "feature_count": one.n}

    def add_result(self, result: ToolResult, name: str) -> dict:
        return self.save_dataset(result.features, name, "result", "result")

    def dataset(self, key: str) -> DataFrame:
        need(not self.table("datasets").where(F.col("id") == key).isEmpty(), f"no dataset {key}")
        return self.spark.read.parquet(f"{self.folder}/data/{key}")

    def save_raster(self, cells: DataFrame, grid: Grid, name: str) -> str:
        key = str(uuid.uuid4())
        cells.select("x", "y", "value").write.parquet(f"{self.folder}/rasters_data/{key}")
        return self.upsert("rasters", {"id": key, "name": name, "width": grid.width, "height": grid.height, "cell_size_m": round(grid.metres, 2), "bbox": json.dumps([grid.x0, grid.y0, grid.x1, grid.y1]), "nodata": grid.nodata})

    def raster(self, key: str) -> tuple[DataFrame, Grid]:
        r = self.table("rasters").where(F.col("id") == key).first()
        need(r is not None, f"no raster {key}")
        return self.spark.read.parquet(f"{self.folder}/rasters_data/{key}"), Grid(r.width, r.height, *json.loads(r.bbox), r.nodata)

    def log(self, tool: str, parameters: dict, summary: dict | None, ms: int, tab: str | None = None) -> None:
        self.upsert("calculations", {"tab_id": tab, "tool_name": tool, "parameters_json": json.dumps(parameters, default=str), "result_summary_json": json.dumps(summary, default=str), "execution_time_ms": ms})

    def history(self, n: int = HISTORY) -> DataFrame:
        """The last runs, 15 unless asked for 1 to 100."""
        return self.table("calculations").limit(max(1, min(MOST_HISTORY, n)))

    def stats(self) -> DataFrame:
        return counts({t: self.table(t) for t in ("datasets", "layers", "calculation_tabs", "calculations")})

    def query(self, text: str) -> DataFrame:
        """SQL over the catalog tables and every dataset, which is seen as dataset_<id with underscores>."""
        tables = {t: self.table(t) for t in TABLES}
        for r in self.table("datasets").select("id").collect():
            tables["dataset_" + r.id.replace("-", "_")] = self.dataset(r.id)
        return sql_console(self.spark, text, tables)
