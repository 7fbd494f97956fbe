"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A text's paragraphs are what its line breaks and the ends of its sentences part, whatever their length, but for blank ones.
Each distinct paragraph has a 64-bit digest; a sketch of CELLS cells holds, for three cells of each digest, a count, the
digests' XOR and the XOR of their checks. Subtracting two versions' sketches leaves the digests that one has and the other
hasn't, and peeling cells with a single digest recovers them. Where that fails, the digests are dealt to more sketches of
the same size (4, 16, ... times as many cells in all, none larger than the first) and each part is peeled again; what no
size frees is compared by its digests. ``differences`` gives the digests recovered and the number of tries. Likeness is the
Jaccard index that follows from them.

A fingerprint shows the number of digests and the sketch's cells. Equal texts have equal fingerprints; two texts without
paragraphs have likeness 1. A null text is empty. The next document is the next by doc_id, rows of equal doc_id being in
order of a hash of their texts and then of the texts, and null ids coming first; after the last comes the first, which may
be the document itself. Every row of the table has a row in the result; other columns are ignored by the query, and
``fingerprinted`` replaces those whose names it adds. Very long texts are read whole; a text's sketch has at most CELLS
cells, its digests as many as it has paragraphs.

Documents are dealt to ranges of doc_id and hash, so a doc_id that many rows share is split too, and pass through one
window a range; the first document of a range also goes to the range before it. Texts are shuffled once, and their digests
with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 768  # room for some 600 differing digests; only cells in use cost anything, and at low loads one round peels all
ROUNDS = 24
RETRIES = 10
RANGE_DOCS = 512
MOST_RANGES = 65_536  # their bounds go through the driver; beyond it ranges hold more documents and a window sorts them with spills
SALTS = 65_536

ENTRY = "struct<cell:int,n:int,key:bigint,chk:bigint>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, sorted."""
    pieces = F.split(text, r"\n|(?<=[.!?]) ", -1)
    return F.sort_array(F.array_distinct(F.transform(F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p))))


def entries(digest: Column, sign: Column, cells: int = CELLS) -> Column:
    """What a digest adds to its three cells, one in each third of the sketch."""
    third = cells // 3

    def of(check: Column) -> Column:
        return F.array(*(F.struct((F.lit(i * third) + F.pmod(F.shiftrightunsigned(check, 20 * i), F.lit(third))).cast("int").alias("cell"), sign.cast("int").alias("n"), digest.alias("key"), check.alias("chk")) for i in range(3)))

    return once(F.xxhash64(digest, F.lit(7)), of)


def once(value: Column, f) -> Column:
    """f of a value that is computed once: lambdas have no common subexpressions, but a lambda's variable is one."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def merged(rows: Column) -> Column:
    """Entries added up by cell (counts summed, the rest XORed), without empty cells, sorted by cell."""

    def added(a: Column, e: Column) -> Column:
        return F.struct(a["cell"].alias("cell"), (a["n"] + e["n"]).alias("n"), a["key"].bitwiseXOR(e["key"]).alias("key"), a["chk"].bitwiseXOR(e["chk"]).alias("chk"))

    def by_cell(s: Column) -> Column:
        at = lambda i: F.get(s, i)
        last = F.size(s) - 1
        starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == 0) | (at(i)["cell"] != at(i - 1)["cell"]))).otherwise(F.array().cast("array<int>"))

        def groups(t: Column) -> Column:
            def group(i: Column, k: Column) -> Column:
                n = F.coalesce(F.get(t, k + 1), last + 1) - i
                return F.when(n == 1, at(i)).otherwise(F.aggregate(F.slice(s, i + 2, n - 1), at(i), added))

            return F.transform(t, group)

        return once(starts, groups)

    return F.filter(once(F.sort_array(rows), by_cell), lambda e: (e["n"] != 0) | (e["key"] != 0) | (e["chk"] != 0))


def sketch(ds: Column) -> Column:
    return merged(F.flatten(F.transform(ds, lambda d: entries(d, F.lit(1)))))


def subtracted(a: Column, b: Column) -> Column:
    less = F.transform(b, lambda e: F.struct(e["cell"].alias("cell"), (-e["n"]).alias("n"), e["key"].alias("key"), e["chk"].alias("chk")))
    return merged(F.concat(a, less))


FOUND = "struct<more:array<bigint>,less:array<bigint>>"


def peeled(cells: Column) -> Column:
    """struct<more, less>: the digests that the cells of a difference give up, those of the first and those of the second; null if some stay locked."""

    def keys(alone: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(alone, lambda e: e["n"] == n), lambda e: e["key"]))

    def pure(rest: Column) -> Column:
        """The digests that stand alone in a cell, by their sign."""
        alone = F.filter(rest, lambda e: (F.abs(e["n"]) == 1) & (e["chk"] == F.xxhash64(e["key"], F.lit(7))))
        return once(alone, lambda x: F.struct(keys(x, 1).alias("more"), keys(x, -1).alias("less")))

    def xor(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(f(x)))

    def all_of(rest: Column, p: Column) -> Column:
        """Whether the digests alone are all there is: a digest is in three cells, so keys and checks of all cells XOR to those of all digests."""
        both = F.concat(p["more"], p["less"])
        count = F.aggregate(rest, F.lit(0), lambda acc, e: acc + e["n"]) == (F.size(p["more"]) - F.size(p["less"])) * 3
        return count & (xor(rest, lambda e: e["key"]) == xor(both, lambda d: d)) & (xor(rest, lambda e: e["chk"]) == xor(both, lambda d: F.xxhash64(d, F.lit(7))))

    def state_of(rest: Column, more: Column, less: Column, stuck: bool) -> Column:
        return F.struct(rest.alias("rest"), more.alias("more"), less.alias("less"), F.lit(stuck).alias("stuck"))

    def taken(state: Column) -> Column:
        """The state without the digests that stand alone in a cell."""

        def without(p: Column) -> Column:
            gone = F.flatten(F.concat(F.transform(p["more"], lambda d: entries(d, F.lit(-1))), F.transform(p["less"], lambda d: entries(d, F.lit(1)))))
            more, less = F.concat(state["more"], p["more"]), F.concat(state["less"], p["less"])
            done = state_of(F.array().cast(f"array<{ENTRY}>"), more, less, False)
            stuck = state_of(state["rest"], state["more"], state["less"], True)
            on = state_of(merged(F.concat(state["rest"], gone)), more, less, False)
            return F.when(F.size(p["more"]) + F.size(p["less"]) == 0, stuck).when(all_of(state["rest"], p), done).otherwise(on)

        return once(pure(state["rest"]), without)

    none = F.array().cast("array<bigint>")
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state_of(cells, none, none, False), lambda s, _: F.when(s["stuck"] | (F.size(s["rest"]) == 0), s).otherwise(taken(s)))
    return once(done, lambda s: F.when(F.size(s["rest"]) == 0, F.struct(s["more"].alias("more"), s["less"].alias("less"))))


def differences(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """struct<more, less, tries>: the digests that a has and b hasn't, those that b has and a hasn't, each sorted, and how many
    sizes of sketches were tried (1: the first; RETRIES + 2: none was large enough, and the digests were compared)."""

    def part(ds: Column, k: Column, parts: Column) -> Column:
        return F.filter(ds, lambda d: F.pmod(F.shiftrightunsigned(F.xxhash64(d, F.lit(11)), 3), parts) == k)

    def again(parts: Column) -> Column:
        """What parts sketches give up; null as soon as one part stays locked."""

        def joined(acc: Column, x: Column) -> Column:
            return F.when(x.isNotNull(), F.struct(F.concat(acc["more"], x["more"]).alias("more"), F.concat(acc["less"], x["less"]).alias("less")))

        none = F.array().cast("array<bigint>")
        start = F.struct(none.alias("more"), none.alias("less")).cast(FOUND)
        return F.aggregate(F.sequence(F.lit(0).cast("long"), parts - 1), start, lambda acc, k: F.when(acc.isNotNull(), once(peeled(subtracted(sketch(part(a, k, parts)), sketch(part(b, k, parts)))), lambda x: joined(acc, x))))

    def tried(found: Column, tries: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(F.sort_array(found["more"]).alias("more"), F.sort_array(found["less"]).alias("less"), tries.cast("int").alias("tries")))

    # More parts than digests don't help.
    sizes = F.array(*(F.struct(F.lit(4**r).cast("long").alias("parts"), F.lit(r + 1).alias("tries")) for r in range(1, RETRIES + 1)))
    none = F.lit(None).cast("struct<more:array<bigint>,less:array<bigint>,tries:int>")
    retried = F.aggregate(sizes, none, lambda acc, s: F.when(acc.isNotNull() | (s["parts"] > 64 + F.size(a) + F.size(b)), acc).otherwise(once(again(s["parts"]), lambda x: tried(x, s["tries"]))))
    compared = F.struct(F.sort_array(F.array_except(a, b)).alias("more"), F.sort_array(F.array_except(b, a)).alias("less"), F.lit(RETRIES + 2).alias("tries"))
    return F.coalesce(once(peeled(subtracted(sketch_a, sketch_b)), lambda x: tried(x, F.lit(1))), retried, compared)


def likeness(n_a: Column, n_b: Column, apart: Column) -> Column:
    union = (n_a + n_b + apart) / 2
    return F.when(union == 0, 1.0).otherwise(((n_a + n_b - apart) / 2) / union)


def shown(n: Column, cells: Column) -> Column:
    """A fingerprint: the number of digests, then cell.count.key.check of each cell that isn't empty."""
    hexed = F.transform(cells, lambda e: F.concat_ws(".", e["cell"].cast("string"), e["n"].cast("string"), F.hex(e["key"]), F.hex(e["chk"])))
    return F.lower(F.concat_ws(":", n.cast("string"), F.array_join(hexed, ",")))


def next_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), digests (of the text), and next_text and next_digests, the next document's."""
    text = F.coalesce("text", F.lit(""))
    # One exact number that orders ids and, within an id, hashes.
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).cast("decimal(20,0)") * SALTS + F.pmod(F.xxhash64(text), F.lit(SALTS))
    rows = docs.select("doc_id", text.alias("text"), at.cast("decimal(26,0)").alias("__at"))
    keys = rows.select("__at")
    n = keys.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_DOCS))

    def place(bounds: list) -> Column:
        """How many bounds are at most a row's place, less one: a binary search."""
        held, size = F.lit(bounds), len(bounds)
        powers = [F.lit(1 << i) for i in reversed(range(size.bit_length()))]
        return F.aggregate(F.array(*powers), F.lit(0), lambda acc, p: F.when((acc + p <= size) & (F.get(held, acc + p - 1) <= F.col("__at")), acc + p).otherwise(acc)) - 1

    bounds = []
    if ranges > 1:
        shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        near = sorted(set(keys.agg(F.percentile_approx("__at", shares, F.lit(max(10_000, 10 * ranges)))).first()[0]))
        # Quantiles are approximate; the ranges start at rows that exist.
        bounds = sorted(r.least for r in keys.groupBy(place(near)).agg(F.min("__at").alias("least")).collect())
    elif n:
        bounds = [keys.agg(F.min("__at")).first()[0]]
    size = max(1, len(bounds))
    placed = rows.withColumn("__digests", digests(F.col("text"))).withColumn("__range", place(bounds) if bounds else F.lit(0))
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("__range") - 1, F.lit(size)).alias("range"), F.lit(True).alias("extra"))
    first = F.get(F.lit(bounds), F.col("__range")) == F.col("__at") if bounds else F.lit(False)
    dealt = placed.withColumn("__to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))).select("doc_id", "text", "__at", F.col("__digests").alias("digests"), "__to.*")
    following = F.lead(F.struct("text", "digests")).over(Window.partitionBy("range").orderBy("extra", "__at", "text"))
    return dealt.withColumn("next", following).where(~F.col("extra")).select("doc_id", "text", "digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with {name}, {name}_n, {name}_digests and {name}_cells of a text column, in place of columns of those names."""
    d, s = f"{name}_digests", f"{name}_cells"
    docs = docs.drop(*({name, f"{name}_n", d, s} - {text}))
    out = docs.withColumn(d, digests(F.col(text))).withColumn(s, sketch(F.col(d)))
    return out.withColumn(f"{name}_n", F.size(d)).withColumn(name, shown(F.size(d), F.col(s)))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the digests that the edit took away and brought, and how many sizes of sketches were tried for them and for the next document's."""
    docs = next_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    out = out.withColumn("edited_digests", digests(F.col("edited")))
    for name in ("", "edited_", "next_"):
        out = out.withColumn(f"{name}cells", sketch(F.col(f"{name}digests")))
    for name in ("edited", "next"):
        out = out.withColumn(f"to_{name}", differences(F.col("digests"), F.col(f"{name}_digests"), F.col("cells"), F.col(f"{name}_cells")))
    near = [likeness(F.size("digests"), F.size(f"{x}_digests"), F.size(f"to_{x}.more") + F.size(f"to_{x}.less")).alias(f"near_{x}") for x in ("edited", "next")]
    more = [F.col("to_edited.more").alias("lost"), F.col("to_edited.less").alias("gained"), F.col("to_edited.tries").alias("tries_edited"), F.col("to_next.tries").alias("tries_next")]
    return out.select("doc_id", "n_chars", "edited_sha256", shown(F.size("digests"), F.col("cells")).alias("fingerprint"), shown(F.size("edited_digests"), F.col("edited_cells")).alias("edited_fingerprint"), *near, *more)
