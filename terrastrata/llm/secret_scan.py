"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression gives a Boolean trigram query. The index holds, for each trigram that some query names and
each block of documents (a hash of doc_id), a posting list; lists of a block are intersected within each conjunction, and
the candidates of the conjunctions are united. Candidates are verified by the expression itself; rules without a mandatory
trigram scan every text. Posting lists are as long as a block at most, however common a trigram is.

Spans count code points, end exclusive; matches of a kind are leftmost and don't overlap, and a match whose measured group
is too short is dropped without another try. A null text is empty. Rows with equal or null doc_ids are each scanned and
returned (they share a key, so a rule that one of them is a candidate of is tried on all). Matches that start together are in
the order of the rules. An empty table gives an empty result. Other columns pass through; one named found is replaced. Very
long texts are scanned whole, the index by one pass for all trigrams, in time in proportion to their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams
from .common import cut

BLOCK_DOCS = 512
MOST_BROADCAST = 500_000  # candidates, of 16 bytes each; more are joined by a shuffle
KEY, MARKS = "__scan_key", "__scan_rules"  # while a scan runs


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group
    base: bool = False


RULES = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def alternation(terms: list[str]) -> str:
    """An expression that finds, at each place of a text where one of the terms (trigrams) starts, that term as group 1: one pass for all."""
    by: dict[str, dict[str, list[str]]] = {}
    for t in terms:
        by.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    one_of = lambda cs: "[" + "".join(map(re.escape, sorted(set(cs)))) + "]"
    tree = "|".join(re.escape(x) + "(?:" + "|".join(re.escape(y) + one_of(zs) for y, zs in sorted(ys.items())) + ")" for x, ys in sorted(by.items()))
    # Most places fail at the first class, most others at the second.
    return f"(?={''.join(one_of(t[k] for t in terms) for k in range(3))})(?=({tree}))"


def index(docs: DataFrame, terms: list[str], blocks: int) -> DataFrame:
    """(block, trigram, postings): the sorted keys of a block's documents that hold the trigram in lower case."""
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_distinct(F.regexp_extract_all(low, F.lit(alternation(terms)), F.lit(1)))
    rows = docs.select(key().alias("key"), held.alias("held")).select("key", F.explode("held").alias("trigram"))
    return rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "trigram").agg(F.sort_array(F.collect_set("key")).alias("postings"))


def candidates(postings: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """(key, rules): a bit mask of the rules whose query the document meets."""
    of = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def conjunction(terms: list[str]) -> Column:
        lists = [F.coalesce(F.element_at("lists", F.lit(t)), none) for t in terms]
        out = lists[0]
        for x in lists[1:]:
            out = F.array_intersect(out, x)
        return out

    def marked(keys: Column, rule: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(1 << rule).alias("rule")))

    met = [marked(conjunction(c), r) for r, q in queries.items() for c in q]
    return of.select(F.explode(F.concat(*met)).alias("x")).groupBy("x.key").agg(F.bit_or("x.rule").alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end>> of the rule's matches."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    measured = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    before = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), measured.alias("g"), F.slice(before, 1, F.size(found)).alias("b"))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def listed(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end, by start and then kind as listed, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: list[Rule] = RULES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with found, array<struct<start, order, end>> sorted by start and order: order is the rule's place in rules."""
    queries = {i: trigrams.query(r.pattern) for i, r in enumerate(rules)}
    terms = sorted({t for q in queries.values() if q for c in q for t in c})
    docs = docs.drop("found")
    blocks = max(1, docs.count() // block_docs)
    joined = docs.withColumn(KEY, key())
    if terms:
        some = cut(candidates(index(docs, terms, blocks), {r: q for r, q in queries.items() if q}))
        few = some.count() <= MOST_BROADCAST
        marks = some.select(F.col("key").alias(KEY), F.col("rules").alias(MARKS))
        joined = joined.join(F.broadcast(marks) if few else marks, KEY, "left")
    else:
        joined = joined.withColumn(MARKS, F.lit(0))
    text, mask = F.coalesce("text", F.lit("")), F.coalesce(MARKS, F.lit(0))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def holds(i: int, r: Rule) -> Column:
        if queries[i]:
            return mask.bitwiseAND(F.lit(1 << i)) != 0
        # A run of one class that is long enough: a cheap test before positions are counted.
        return text.rlike(f"{r.pattern.removesuffix('+')}{{{r.least}}}") if r.pattern.endswith("]+") and not r.group else F.lit(True)

    found = F.sort_array(F.concat(*(F.when(holds(i, r), spans_of(text, r, i)).otherwise(none) for i, r in enumerate(rules))))
    return joined.withColumn("found", found).drop(KEY, MARKS)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = [i for i, r in enumerate(RULES) if r.base]
    found, order = F.col("found"), {r.kind: i for i, r in enumerate(RULES)}

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["order"] == order[kind])).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    return scan(docs).select("doc_id", *counts, F.sha2(listed(F.filter(found, lambda s: s["order"].isin(base)), RULES), 256).alias("base_sha256"), listed(found, RULES).alias("spans"))


def _sql() -> str:
    """The same rows in SQL: matches and what stands between them give the places by running sums."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"SELECT row, {i} AS o, {quoted(r.kind)} AS kind, {r.least} AS least, {str(r.base).lower()} AS base, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {r.group})) AS g, unnest(string_split_regex(t, {p})) AS b, generate_subscripts(string_split_regex(t, {p}), 1) AS k FROM d")
    n = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, sum(length(b) + coalesce(length(m), 0)) OVER (PARTITION BY row, o ORDER BY k) AS e FROM m),
q AS (SELECT row, o, kind, base, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p WHERE m IS NOT NULL AND length(g) >= least),
a AS (SELECT row, {n('assign')}, {n('access')}, {n('hex')}, {text} FILTER (base) AS b, {text} AS spans FROM q GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row)
"""


SQL = _sql()
