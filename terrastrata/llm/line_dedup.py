"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines of a text is a window, known by hashes of its lines (96 bits). A window's first
occurrence, by doc_id, then text, then line, stays; the lines that any later occurrence covers go, covers being merged
across overlapping windows. An occurrence that overlaps the first one within the same text is no later occurrence (so of
ten equal lines three stay). Windows of blank lines only don't count; texts of under three lines have no window.

A null text stays null, an empty one empty; a text of which nothing is left becomes empty and its row stays. Rows with
equal doc_id and text are one document: all get the same result. Rows with a null doc_id come first. Other columns pass
through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LINES = 3
MOST_BROADCAST = 32_000_000  # bytes of places


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows_of(docs: DataFrame, keys: list[Column], lines: int = LINES) -> DataFrame:
    """keys, pos, k1 and k2 of the windows with anything in them. Lines are hashed once, in a projection of their own."""
    names = [f"__k{i}" for i in range(len(keys))]
    hashed = docs.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.transform(lines_of(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) == "").alias("blank"))).alias("__one"))
    rows = hashed.where(F.size("__one") >= lines).select(*names, F.size("__one").alias("__n"), F.posexplode(F.arrays_zip(F.col("__one").alias("w0"), *(F.slice("__one", k + 1, F.size("__one")).alias(f"w{k}") for k in range(1, lines)))).alias("pos", "w"))
    part = [F.col(f"w.w{k}") for k in range(lines)]
    some = ~part[0]["blank"]
    for p in part[1:]:
        some = some | ~p["blank"]
    inside = rows.where((F.col("pos") <= F.col("__n") - lines) & some)
    return inside.select(*names, "pos", F.xxhash64(*(p["a"] for p in part)).alias("k1"), F.hash(*(p["b"] for p in part)).alias("k2"))


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc, th, covered): for documents with later occurrences, the sorted places of the lines that go. doc and th are doc_key() and text_key()."""
    windows = windows_of(docs, [doc_key(), text_key()], lines).withColumnsRenamed({"__k0": "doc", "__k1": "th"})
    at = F.struct("doc", "th", "pos")
    first = windows.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("k1", "k2", "first")
    same = (F.col("doc") == F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    later = windows.join(first, ["k1", "k2"]).where(~(same & (F.col("pos") < F.col("first.pos") + lines))).select("doc", "th", "pos")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + lines - 1))))
    return later.groupBy("doc", "th").agg(F.collect_set("pos").alias("starts")).select("doc", "th", F.sort_array(gone).alias("covered"))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def text_key() -> Column:
    return F.xxhash64("text")


def deduped(docs: DataFrame, lines: int = LINES, dropped: str = "dropped_lines") -> DataFrame:
    """docs with text as it stays, n_chars (if there is one) counted anew, and dropped, an array of the places that went; it takes the place of a column of that name."""
    own = [c for c in docs.columns if c != dropped]
    keyed = docs.select(F.struct(*own).alias("__row"), "text", doc_key().alias("__doc"), text_key().alias("__th"))
    gone = cut(repeated_lines(docs.select("doc_id", "text"), lines).withColumnsRenamed({"doc": "__doc", "th": "__th", "covered": "__gone"}))
    rows, places = gone.agg(F.count(F.lit(1)), F.sum(F.size("__gone"))).first()
    if 64 * rows + 4 * (places or 0) <= MOST_BROADCAST:
        gone = F.broadcast(gone)  # else the texts are shuffled to it
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    out = keyed.join(gone, ["__doc", "__th"], "left").withColumn("__new", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    cells = {c: F.col(f"__row.`{c}`") for c in own} | {"text": F.col("__new")}
    if "n_chars" in own:
        cells["n_chars"] = F.when(F.col("__gone").isNull(), cells["n_chars"]).otherwise(F.length("__new").cast("long"))
    return out.select(*(v.alias(c) for c, v in cells.items()), F.coalesce("__gone", F.array().cast("array<int>")).alias(dropped))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduped(docs)
    return out.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped_lines", lambda i: i.cast("string")), ",").alias("dropped_lines"), "text")


SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, text, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS k
  FROM cut, range(1, greatest(len(l) - 1, 1)) AS t(p)
  WHERE trim(l[p], ' ') <> '' OR trim(l[p + 1], ' ') <> '' OR trim(l[p + 2], ' ') <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, text, pos) AS n FROM w),
f AS (SELECT k, doc_id AS fd, text AS ft, pos AS fp FROM r WHERE n = 1),
later AS (SELECT doc_id, text, pos FROM w JOIN f USING (k) WHERE NOT (doc_id IS NOT DISTINCT FROM fd AND text = ft AND pos < fp + 3)),
gone AS (SELECT DISTINCT doc_id, text, pos + d AS i FROM later, range(0, 3) AS t(d)),
lists AS (SELECT doc_id, text, count(*) AS n_dropped, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS dropped_lines, list(i) AS g FROM gone GROUP BY ALL),
kept AS (
  SELECT doc_id, text, string_agg(l[p], chr(10) ORDER BY p) AS t
  FROM cut JOIN lists USING (doc_id, text), range(1, len(l) + 1) AS s(p) WHERE NOT list_contains(g, p - 1) GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines,
  CASE WHEN n_dropped IS NULL THEN d.text ELSE coalesce(t, '') END AS text
FROM documents d LEFT JOIN lists ON d.doc_id = lists.doc_id AND d.text = lists.text LEFT JOIN kept ON d.doc_id = kept.doc_id AND d.text = kept.text
"""
