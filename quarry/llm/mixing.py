"""Mixing sources to target weights by Pareto order sampling.

Sources get shares of all words by weight, none above max_copies times its own words; the excess goes to the others
by weight (water filling, solved in closed form over the sorted ratios of bound to weight). Within a source every
document expects e = min(max_copies, c * m) copies, and c makes the expected words meet the target. m, its measure, is 1
from short_words to long_words; it halves with every doubling of the size beyond, so that no long text fills a target by
itself, and falls by the square root of two with every halving below, as short texts carry less. floor(e) copies are certain. The rest of e is an inclusion
probability p: documents are ranked by random odds over inclusion odds, u / (1 - u) / (p / (1 - p)), and taken in that
order up to the words still open, so the sample has a fixed size in words. u is a hash of the document, so reruns agree.
The place in the order is found by two passes of bounded histograms, then among the few rows of one cell; no source is
ever gathered or sorted as a whole. Sources, of which there may be many, are ranked by range partitions.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source, ordered last; rows
equal in doc_id, size and source share one random number, and are taken or left together; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, Scratch, pick

WEIGHTS = (1, 2, 3)
CELLS = 1024


#: Sources that one task ranks.
RANKED = 100_000


def _in_order(df: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """A kept df with place (from 0) in order, and before_<k>: the sum of column sums[k] over all rows before. Rows are
    sorted by ranges; the driver sees one row of totals per RANKED rows."""
    n = max(1, -(-df.count() // RANKED))
    at = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    at = scratch.keep(at, name)
    totals = at.groupBy("part").agg(F.count("*").cast("double").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(k) for k, c in sums.items()]).orderBy("part").collect()
    run, rows = [0.0] * (1 + len(sums)), []
    for r in totals:
        rows.append((r["part"], *run))
        run = [a + r[k] for a, k in zip(run, ["n", *sums], strict=True)]
    known = df.sparkSession.createDataFrame(rows or [(0, *run)], ", ".join(["part int", "o_n double", *(f"o_{k} double" for k in sums)]))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = at.join(F.broadcast(known), "part")
    at = at.withColumns({"place": (F.coalesce(F.count("part").over(w), F.lit(0)) + F.col("o_n")).cast("long")} | {f"before_{k}": F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"o_{k}") for k, c in sums.items()})
    return at.drop("part", "o_n", *(f"o_{k}" for k in sums))


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, max_copies: int = 3) -> DataFrame:
    """source, source_size, target of sizes(source, size)."""
    s = scratch.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    s = _in_order(s, [F.col("source").asc_nulls_last()], {}, scratch, "by_name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("most", max_copies * F.col("source_size")).drop("place")
    s = scratch.keep(s.withColumn("ratio", F.col("most") / F.col("weight")), "weighted")
    total, all_weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    s = _in_order(s, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"most": "most", "weight": "weight"}, scratch, "by_ratio")
    level = (total - F.col("before_most")) / (all_weights - F.col("before_weight"))
    s = scratch.keep(s.withColumn("full", F.col("ratio") <= level), "levels")
    used, used_weights = s.where("full").agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = (total - used) / (all_weights - used_weights) if all_weights > used_weights else None
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(share).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _keys(df: DataFrame) -> DataFrame:
    """Join keys that hold null too."""
    return df.withColumns({"s": F.coalesce("source", F.lit("")), "no_source": F.col("source").isNull()})


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, source: Column, text: Column, seed: int = 7) -> Column:
    """The number by which a row is drawn; equal rows share it."""
    return F.xxhash64(doc_id, source, size_of(text), F.lit(seed))


def grade(size: Column, short_words: int, long_words: int) -> Column:
    """How often the measure of a text of this size is divided by the square root of two."""
    n = F.greatest(size, F.lit(1))
    long = 2 * (F.floor(F.log2(n / long_words)) + 1)
    short = F.floor(F.log2(short_words / n)) + 1
    return F.when(size > long_words, long).when(size < short_words, short).otherwise(0).cast("int")


def mix(documents: DataFrame, weights=WEIGHTS, max_copies: int = 3, short_words: int = 64, long_words: int = 4096, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies int, taken, row_hash for every row of documents."""
    with Scratch(documents.sparkSession, "mixing") as scratch:
        return scratch.finish(_mixed(documents, scratch, weights, max_copies, short_words, long_words, seed))


def _mixed(documents: DataFrame, scratch: Scratch, weights, max_copies: int, short_words: int, long_words: int, seed: int) -> DataFrame:
    on = ["s", "no_source"]
    d = pick(documents, doc_id="long", source="string", text="string")
    d = _keys(d.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    d = d.withColumn("row_hash", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
    d = scratch.keep(d.withColumn("band", grade(F.col("size"), short_words, long_words)), "sizes")
    targets = scratch.keep(_keys(source_targets(d.select("source", "size"), scratch, weights, max_copies)), "targets")

    # c: bands fill up to max_copies from the first on; the first level that its own band can hold is the one
    bands = d.groupBy(*on, "band").agg(F.sum("size").alias("words")).join(targets.select(*on, "target"), on)
    bands = bands.withColumn("m", F.pow(F.lit(2.0), -F.col("band") / 2))
    w = Window.partitionBy(*on)
    before, after = w.orderBy("band").rowsBetween(Window.unboundedPreceding, -1), w.orderBy("band").rowsBetween(0, Window.unboundedFollowing)
    open_ = F.col("target") - max_copies * F.coalesce(F.sum("words").over(before), F.lit(0))
    bands = bands.withColumn("c", open_ / F.nullif(F.sum(F.col("words") * F.col("m")).over(after), F.lit(0.0)))
    bands = bands.withColumn("full", F.coalesce(F.col("c") * F.col("m") >= max_copies, F.lit(False)))
    c = F.min(F.when(~F.col("full"), F.struct("band", "c"))).over(w)["c"]
    e = F.when(F.col("full"), F.lit(float(max_copies))).otherwise(F.least(F.lit(float(max_copies)), F.coalesce(c * F.col("m"), F.lit(0.0))))
    plan = scratch.keep(bands.select(*on, "band", e.alias("e")), "bands")

    d = d.join(plan, [*on, "band"])
    certain = F.floor(F.col("e") + 1e-12)
    p = F.greatest(F.col("e") - certain, F.lit(0.0))
    u = (F.pmod(F.col("row_hash"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    q = u / (1 - u) * (1 - p) / p
    d = d.select("doc_id", "source", *on, "size", "row_hash", certain.cast("int").alias("certain"), F.when((p > 0) & (F.col("size") > 0), q / (1 + q)).alias("v"))
    d = scratch.keep(d, "ranked")
    todo = d.groupBy(*on).agg(F.sum(F.col("certain") * F.col("size")).alias("had")).join(targets, on)
    todo = scratch.keep(todo.select(*on, (F.col("target") - F.col("had")).alias("open"), F.lit(0).cast("long").alias("cell")), "todo")

    # the cell in which the open words run out: CELLS cells of v, then CELLS cells of that one
    step = 1.0
    for level in (1, 2):
        step /= CELLS
        inside = d.where("v is not null").join(todo, on).withColumn("at", F.floor(F.col("v") / F.lit(step)))
        if level > 1:
            inside = inside.where(F.floor(F.col("at") / CELLS) == F.col("cell"))
        cells = inside.groupBy(*on, "at").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
        run = F.coalesce(F.sum("words").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("left", F.col("open") - run).where("left > 0")
        last = cells.groupBy(*on).agg(F.max_by(F.struct("left", "at"), "at").alias("x"))
        todo = scratch.keep(last.select(*on, F.col("x.left").alias("open"), F.col("x.at").alias("cell")), f"todo{level}")
    rest = d.where("v is not null").join(todo, on).where(F.floor(F.col("v") / F.lit(step)) == F.col("cell"))
    rest = rest.groupBy(*on, "v").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
    run = F.coalesce(F.sum("words").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.abs(F.col("open") - run - F.col("words")) <= F.abs(F.col("open") - run)
    rest = rest.withColumn("fits", fits).groupBy(*on).agg(F.max(F.when(F.col("fits"), F.col("v"))).alias("last"), F.min("v").alias("first"))
    cut = scratch.keep(rest.select(*on, F.col("last"), F.col("first")), "cut")

    out = d.join(targets.drop("source"), on, "left").join(cut, on, "left")
    taken = F.coalesce((F.col("v") <= F.col("last")) | (F.col("v") < F.col("first")), F.lit(False))
    copies = F.when(F.col("size") > 0, F.least(F.col("certain") + taken.cast("int"), F.lit(max_copies))).otherwise(F.lit(0))
    out = out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.cast("int").alias("copies"), "row_hash")
    return out.withColumn("taken", F.col("copies") * F.col("size"))
