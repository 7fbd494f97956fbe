"""What a desktop shows of results: flattened summaries, the attribute table, ad-hoc measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.result import attributes

MOST_ROWS, MOST_DEPTH, MOST_ITEMS = 60, 3, 6


def human(x: float) -> str:
    """A number as people read it: 12, 3.14, 1.5k, 2.0M, 7.1B."""
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e4, "k")):
        if abs(x) >= size:
            return f"{x / (1e3 if unit == 'k' else size):.1f}{unit}"
    return str(int(x)) if x == int(x) else f"{x:.4g}" if abs(x) < 1 else f"{x:.2f}"


def flattened(summary: DataFrame) -> list[tuple[str, str]]:
    """(label, value) of a one-row summary: nested fields by dotted names to a depth of three, the first six items of lists, sixty rows at most."""
    row = summary.first()
    out: list[tuple[str, str]] = []

    def walk(label: str, v: object, depth: int) -> None:
        if len(out) >= MOST_ROWS or v is None:
            return
        if isinstance(v, dict) and depth < MOST_DEPTH:
            for k, x in v.items():
                walk(f"{label}.{k}" if label else str(k), x, depth + 1)
        elif isinstance(v, list | tuple):
            for i, x in enumerate(v[:MOST_ITEMS]):
                walk(f"{label}[{i}]", x, depth + 1)
        elif isinstance(v, bool) or not isinstance(v, int | float):
            out.append((label, str(v)))
        else:
            out.append((label, human(v) if math.isfinite(v) else "-"))

    walk("", row.asDict(recursive=True) if row else {}, 0)
    return out


def attribute_table(df: DataFrame) -> DataFrame:
    """_fid, the attributes by name as texts, and the first vertex to centre on."""
    v = G.first_vertex("geom")
    return df.select("_fid", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in sorted(attributes(df))), v["x"].alias("lng"), v["y"].alias("lat"))


def preview(df: DataFrame, rows: int = 200) -> DataFrame:
    return attribute_table(df).orderBy("_fid").limit(rows)


def measured_length(vertices: Column) -> Column:
    """Metres along places clicked one after the other."""
    return G.length_m(vertices)


def measured_area(vertices: Column) -> Column:
    """Square metres of the ring of places clicked."""
    return G.ring_area(vertices)
