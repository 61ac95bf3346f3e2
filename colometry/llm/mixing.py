"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997). DataFrame functions only.

Within a source a document's expected number of copies is least(MOST, level * weight), the source's level being such
that the expected words are its target. A document's weight grows slowly with its length: the fourth root of its
size's power of two, or what a column says. The whole part of the expected copies is certain. The rest is the
inclusion probability of one copy more, which differs from document to document: they are ranked by
random odds over inclusion odds, and a source takes the ranks from the lowest on until its words are met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash

#: Fixed by the contract: weights of sources in code point order, repeating; all targets over all sizes; a target's most over its source's size.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
SEED = 20231
#: Documents double in weight as their size grows by this power of two.
OCTAVES = 4
_BITS, _LEVEL = 52, 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size), by filling up: target = least(most * size, weight * level).

    With sources sorted by cap over weight, the full ones come first; the level is that of the first that
    isn't full. One row for each source is sorted in one task, no more.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) * float(total) - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    level = left / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = src.select("*", level.alias("level"), F.row_number().over(order).alias("rn"))
    final = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("rn", "level"))).over(everything)["level"]
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * final, F.col("cap"))).alias("target"))


def weight(size: Column) -> Column:
    """2 ** (b / OCTAVES), b being the power of two at or below the size (1 for no words): few different values, whatever the corpus."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)))) / OCTAVES)


def levels(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sums with a column expected: copies expected of a document, from sums (g, target, weight, s) of sizes by weight, g being the source.

    By filling up: sorted by weight, largest first, the first ones are full (most copies each); the level is that
    of the first that isn't. A source's rows are its different weights.
    """
    order = Window.partitionBy("g").orderBy(F.desc("weight"))
    full = (F.sum("s").over(order) - F.col("s")) * float(most)
    level = F.try_divide(F.col("target") - full, F.sum(F.col("s") * F.col("weight")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = sizes.select("*", level.alias("level"), F.row_number().over(order).alias("rn"))
    first = F.min(F.when(F.col("weight") * F.col("level") <= float(most), F.struct("rn", "level"))).over(Window.partitionBy("g"))["level"]
    return rows.select("g", "weight", "s", "source_size", "target", F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("weight") * first, F.lit(float(most))))).alias("expected"))


def mix(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", odds: str | None = None, seed: int = SEED) -> DataFrame:
    """key, size, source_size, target, taken, expected, copies: one row for each row of docs.

    size: words of the text, 0 for null or empty. A null source is a source of its own. expected: copies
    to expect of the document; copies is its whole part or one more. odds: a column of positive
    weights (null: 1) instead of `weight`, rounded to powers of 2 ** (1 / OCTAVES), so that a source has few different
    ones. Random numbers are hashes of the key and seed, so reruns agree whatever the partitions; rows with equal
    keys, sources and weights are taken together. A source stops where its words are nearest to its target, at
    most half a document (or half of such rows) away. An empty table gives no rows; extra columns don't matter.

    No source is gathered: ranks are cut into 4096 ranges by value, sums of ranges give the range in
    which the target falls, and that one is cut again; only the last range, a 16-millionth of the source,
    is sorted.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    given = None if odds is None else F.coalesce(F.when(F.col(odds) > 0, F.col(odds).cast("double")), F.lit(1.0))
    f = weight(words) if given is None else F.pow(F.lit(2.0), F.round(F.log2(given) * OCTAVES) / OCTAVES)
    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("g")
    base = stash(spark, docs.select(F.col(key).alias("k"), F.col(source).alias("source"), words.alias("size"), f.alias("weight")).select("k", named, "source", "size", "weight"))
    src = targets(base).select(named, "source_size", "target")
    sums = base.groupBy("g", "weight").agg(F.sum("size").cast("double").alias("s"))
    by_weight = sums.join(src, "g")
    plan = levels(by_weight)
    # chances so near to a whole number that only rounding keeps them apart are whole
    whole = F.floor(F.col("expected") + 1e-9).cast("bigint")
    p = F.greatest(F.col("expected") - whole, F.lit(0.0))
    plan = stash(spark, plan.select("*", whole.alias("whole"), F.when(p > 1e-9, p).otherwise(0.0).alias("p")))
    need = plan.groupBy("g").agg((F.max("target") - F.sum(F.col("whole") * F.col("s"))).alias("need"))
    plan = F.broadcast(stash(spark, plan.join(need, "g").drop("s")))  # one row for each source and weight
    u = (F.xxhash64("k", F.lit(seed)).bitwiseAND((1 << 53) - 1) + 0.5) / float(1 << 53)
    rank = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # those without a chance come last, beyond all others
    place = F.when(F.col("p") > 0, F.floor(rank / (1 + rank) * float((1 << _BITS) - 2))).otherwise(float((1 << _BITS) - 1)).cast("bigint")
    rows = base.join(plan, ["g", "weight"]).select("k", "g", "size", "source_size", "target", "expected", "whole", "p", "need", place.alias("place"))

    def cut(now: DataFrame, shift: int) -> DataFrame:
        """Sums of ranges: (g, b, before, through), before counted from the range that was cut."""
        sums = now.groupBy("g", F.shiftright("place", shift).alias("b")).agg(F.sum("size").alias("s"), F.min("need").alias("n"))
        w = Window.partitionBy("g").orderBy("b")
        return sums.select("g", "b", "n", (F.sum("s").over(w) - F.col("s")).alias("before"), F.sum("s").over(w).alias("through"))

    def apply(now: DataFrame, shift: int) -> tuple[DataFrame, DataFrame]:
        """Rows that a range decides (with `more`), and those of the ranges in which a target falls (need counted within)."""
        ranges = stash(spark, cut(now, shift))
        joined = now.withColumn("b", F.shiftright("place", shift)).join(ranges, ["g", "b"])
        open_ = (F.col("before") < F.col("need")) & (F.col("through") > F.col("need"))
        done = joined.where(~open_).select(*now.columns, (F.col("through") <= F.col("need")).alias("more"))
        rest = joined.where(open_).select(*[(F.col("need") - F.col("before")).alias("need") if c == "need" else c for c in now.columns])
        return done, rest

    first, rest = apply(rows, _BITS - _LEVEL)
    rest = stash(spark, rest)
    second, rest = apply(rest, _BITS - 2 * _LEVEL)
    # the last range: rows of equal place go together, up to the middle of the group
    peers = Window.partitionBy("g", "place")
    upto = Window.partitionBy("g").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    third = rest.select("*", (F.sum("size").over(upto) - F.sum("size").over(peers) / 2 <= F.col("need")).alias("more"))
    out = first.unionByName(second).unionByName(third)
    copies = F.col("whole") + (F.col("more") & (F.col("p") > 0)).cast("bigint")
    return out.select(F.col("k").alias(key), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "expected", copies.alias("copies"))
