"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows of a tree: domain, language, source. A token budget goes down the tree by the weights of
siblings. What a subtree can give is its tokens times MAX_EPOCHS; a node whose share exceeds that is filled, and its
shortage goes to its siblings by their weights, so that it leaves the family only when all siblings are full (then the
parent is full too, and its own siblings take the rest). Each level is solved at once for all families, from the sorted
ratios of capacity to weight. A leaf passes over its documents in epochs, each in an order of its own that the seed gives:
whole epochs as long as the budget lasts, then the prefix of the next whose tokens fit.

The prefix is found without sorting a leaf in one place: tokens are summed by leaf and slice of the hash order, and only
the slice that the budget ends in is ordered. Documents of equal hash (repeated rows) go in or stay out together.

Tokens are runs of other characters than white space; a null text has none. A null domain, lang or source is a name of its
own ('?'). Documents without tokens go with their epoch's prefix. Weights not given are 1; a weight of 0 or less takes nothing
out of its family. A budget above what all can give is met as far as it can be. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

LEVELS = ("domain", "lang", "source")
SLICES = 12  # bits of the hash that make a slice
MOST_BROADCAST = 100_000  # leaves
DOMAINS = 4

#: Weights by path; what isn't named weighs 1.
WEIGHTS: Mapping[str, float] = {"*/en": 2.0, "*/de": 1.0, "*/fr": 1.0, "*/es": 1.0}


def domain_of(source: Column, domains: int = DOMAINS) -> Column:
    """The table has no domains, so each source belongs to one of a few by its CRC-32."""
    return F.concat(F.lit("d"), (F.crc32(F.coalesce(source, F.lit("?")).cast("binary")) % domains).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def weight_of(path: list[Column], weights: Mapping[str, float]) -> Column:
    """The weight of a node: by its whole path, else by '*/' and its name at that level, else 1."""
    exact, depth = F.concat_ws("/", *path), len(path)
    anywhere = F.concat_ws("/", *[F.lit("*")] * (depth - 1), path[-1])
    out = F.lit(1.0)
    for k, w in sorted(weights.items()):
        if k.count("/") == depth - 1 and k.startswith("*/"):
            out = F.when(anywhere == k, float(w)).otherwise(out)
    for k, w in sorted(weights.items()):
        if k.count("/") == depth - 1 and not k.startswith("*/"):
            out = F.when(exact == k, float(w)).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def share(nodes: DataFrame, family: list[str]) -> DataFrame:
    """nodes (family, name, capacity, weight, given: the family's budget) with budget, the water level of each family applied.

    With members sorted by capacity over weight, those before the level are full: member k's level is (given - capacities
    before k) / (weights from k on), and the first member whose capacity over weight is at least that sets it for the rest.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*family).orderBy("ratio", "name").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*family).orderBy("ratio", "name").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*family)
    n = nodes.withColumn("ratio", ratio)
    n = n.withColumn("before", F.coalesce(F.sum("capacity").over(w), F.lit(0.0))).withColumn("heavy", F.sum("weight").over(rest))
    n = n.withColumn("level", F.when(F.col("heavy") > 0, (F.col("given") - F.col("before")) / F.col("heavy")))
    n = n.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "name", "level"))).over(whole)["level"])
    full = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)
    return n.withColumn("budget", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")))).drop("ratio", "before", "heavy", "level")


def budgets(leaves: DataFrame, total: float, weights: Mapping[str, float], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget."""
    # A name of weight 0 takes nothing, so what lies under it counts for nothing above.
    leaf = leaves
    for depth in range(1, len(LEVELS) + 1):
        leaf = leaf.withColumn(f"w{depth}", weight_of([F.col(c) for c in LEVELS[:depth]], weights))
    open_ = (F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0)
    leaf = cut(leaf.withColumn("capacity", F.when(open_, F.col("tokens").cast("double") * max_epochs).otherwise(0.0)))
    family: list[str] = []
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS, 1):
        path = list(LEVELS[:depth])
        nodes = leaf.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first(f"w{depth}").alias("weight"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("given", F.lit(float(total))) if above is None else nodes.join(above, family)
        named = nodes.withColumn("name", F.col(level))
        shared = share(named.withColumn("root", F.lit(0)), ["root"] if not family else family)
        above = shared.select(*path, F.col("budget").alias("given"))
        family = path
    return shared.select(*LEVELS, "tokens", "budget")


def plan(docs: DataFrame, total: float | None = None, fraction: float = 0.8, weights: Mapping[str, float] = WEIGHTS, max_epochs: int = 4, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lean, leaves): lean has doc_id, LEVELS and tokens by document; leaves has LEVELS, tokens, budget, epochs (whole ones) and cut_at (the last hash of the epoch after them). total is in tokens; without it, it is a fraction of all tokens."""
    levels = {c: F.coalesce(F.col(c) if c in docs.columns else domain_of(F.col("source")), F.lit("?")) for c in LEVELS}
    lean = cut(docs.select("doc_id", *(v.alias(k) for k, v in levels.items()), tokens_of(F.col("text")).alias("tokens")))
    leaves = lean.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    if total is None:
        total = fraction * (lean.agg(F.sum("tokens")).first()[0] or 0)
    shared = cut(budgets(leaves, total, weights, max_epochs))
    # Budgets are whole tokens; a rounding error of the shares doesn't end an epoch early.
    whole = F.floor(F.col("budget") + 1e-6)
    goal = shared.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(whole / F.col("tokens"))).otherwise(0)).withColumn("left", whole - F.col("epochs") * F.col("tokens"))
    placed = with_leaf(lean, goal.select(*LEVELS, "epochs", "left")).withColumn("u", order_of(seed)).withColumn("slice", F.shiftright("u", 64 - SLICES))
    sums = placed.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("sum"), F.first("left").alias("left"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = sums.withColumn("upto", F.sum("sum").over(upto)).where("upto > left").groupBy(*LEVELS).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("sum")).alias("before")), "slice").alias("edge")).select(*LEVELS, "edge.*")
    over = cut(over)
    inside = placed.join(over, [*LEVELS, "slice"]).groupBy(*LEVELS, "u", "before", "left").agg(F.sum("tokens").alias("tokens"))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("u"))
    last = inside.withColumn("run", run).where("run <= left").groupBy(*LEVELS).agg(F.max("u").alias("last"))
    # Nothing of the slice: up to the end of the slice before it, if there is one.
    none = F.when(F.col("slice") > -(1 << (SLICES - 1)), F.shiftleft(F.col("slice").cast("long"), 64 - SLICES) - 1).otherwise(F.lit(-(1 << 63)))
    cuts = over.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", none).alias("cut_at"))
    top = F.lit((1 << 63) - 1)
    leaves = goal.join(cuts, list(LEVELS), "left").withColumn("cut_at", F.coalesce("cut_at", top)).withColumn("done", F.col("epochs") >= max_epochs)
    # With every epoch that is allowed already whole, or no budget at all, there is no prefix.
    leaves = leaves.withColumn("cut_at", F.when(F.col("done") | (whole <= 0), F.lit(None)).otherwise(F.col("cut_at"))).drop("left", "done")
    return lean, cut(leaves)


def order_of(seed: int) -> Column:
    """A document's place in the epoch after its leaf's whole ones."""
    return F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))


def with_leaf(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """docs joined to their leaf's row: by broadcast if leaves are few, else by a join that splits hot leaves."""
    few = leaves.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(leaves) if few else leaves, list(LEVELS))


def mixed(docs: DataFrame, seed: int = 3, epoch: str = "epoch", **how) -> DataFrame:
    """docs, each as many times as it is chosen, with epoch (from 0), which takes the place of a column of that name; other columns as they were."""
    docs = docs.drop(epoch)
    _, leaves = plan(docs, seed=seed, **how)
    own = docs.columns
    taken = {c: f"__{c}" for c in LEVELS}
    names = {c: F.coalesce(F.col(c) if c in own else domain_of(F.col("source")), F.lit("?")) for c in LEVELS}
    wide = docs.select(F.struct(*own).alias("__row"), *(v.alias(taken[k]) for k, v in names.items()))
    leaf = leaves.select(*(F.col(c).alias(taken[c]) for c in LEVELS), F.col("epochs").alias("__epochs"), F.col("cut_at").alias("__cut"))
    few = leaf.count() <= MOST_BROADCAST
    joined = wide.join(F.broadcast(leaf) if few else leaf, list(taken.values()))
    u = F.xxhash64(F.lit(seed), F.col("__epochs"), F.col("__row.doc_id"))
    times = F.col("__epochs") + F.when(u <= F.col("__cut"), 1).otherwise(0)
    return joined.where(times > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).select("__row.*", F.col("__epoch").alias(epoch))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    seed = 3
    lean, leaves = plan(docs, seed=seed)
    joined = with_leaf(lean.withColumnRenamed("tokens", "doc_tokens"), leaves)
    times = F.col("epochs") + F.when(order_of(seed) <= F.col("cut_at"), 1).otherwise(0)
    return joined.select("doc_id", *LEVELS, F.col("doc_tokens").alias("tokens"), F.round("budget", 3).alias("leaf_budget"), times.cast("long").alias("copies"))
