"""Similarity join of sets by an exact prefix filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.materialize import materialize, rows_of, salted_join

#: Elements of the left side up to which they are sent to the rows instead of shuffling all elements.
ELEMENTS = 500_000


#: Size of a set for which one more element must be shared within the first ones.
STEP = 64


def _shared(n: Column, t: float) -> Column:
    """How many elements must be shared within the first ones: no more than in all."""
    return F.least(F.floor(n / STEP) + 1, F.greatest(F.lit(1), F.ceil(n * F.lit(t) - 1e-9))).cast("int")


def similar_sets(units: DataFrame, t: float, ready: bool = False) -> DataFrame:
    """left, right: units of the left side and of the right side with Jaccard similarity of at least t.

    units: u, is_left, is_right, grams (distinct, never null), and optionally n, the size of
    a set whose grams hold only what may occur on the other side. A unit isn't paired with
    itself. Units without grams match none. Exact: elements are put in one order, rarest
    first, and two sets of the wanted similarity share one within the first few of both;
    only those are joined. Large sets are given a few elements more, one for each STEP of
    their size, and must share as many more. How few the first ones are depends on both
    sizes: what two sets share beyond these is dropped in the join, before it is shuffled by
    pair. Length and position filters drop pairs that cannot reach the overlap, the others
    are verified. No frequency is cut off; rows of a frequent element are salted. units is
    written once before it is used, unless it is ready; the smaller side should be the left
    one.
    """
    cut_before = "n" in units.columns
    size = F.col("n") if cut_before else F.size("grams")
    units = units.select("u", "is_left", "is_right", size.alias("n"), "grams").filter(F.size("grams") > 0)
    units = units if ready else materialize(units, "sets")
    grams = units.select("u", "is_left", "is_right", "n", F.explode("grams").alias("g"))
    if not cut_before:
        own = materialize(grams.filter("is_left").select("g").distinct(), "elements")
        if rows_of(own) <= ELEMENTS:
            grams = grams.join(F.broadcast(own), "g", "left_semi")
    # elements of one side only can't match; they come first in the order and fill prefixes for free
    useful = grams.groupBy("g").agg(F.count("*").alias("df"), F.max("is_left").alias("a"), F.max("is_right").alias("b")).filter("a and b and df > 1").select("g", "df")
    sized = grams.join(useful, "g").groupBy("u", "is_left", "is_right", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("order"))
    free = F.col("n") - F.size("order")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9).cast("int") + _shared(F.col("n"), t)
    cut = sized.withColumn("take", F.greatest(length - free, F.lit(0))).filter("take > 0")
    prefix = materialize(
        cut.select("u", "is_left", "is_right", "n", free.alias("free"), F.posexplode(F.expr("slice(order, 1, take)")).alias("at", "x")).select("u", "is_left", "is_right", "n", (F.col("free") + F.col("at")).alias("at"), F.col("x.g").alias("g")),
        "prefix",
    )
    left = prefix.filter("is_left").select("g", F.col("u").alias("left"), F.col("n").alias("nl"), F.col("at").alias("pl"))
    right = prefix.filter("is_right").select("g", F.col("u").alias("right"), F.col("n").alias("nr"), F.col("at").alias("pr"))
    need = F.lit(t / (1 + t)) * (F.col("nl") + F.col("nr")) - 1e-9
    least = F.least(_shared(F.col("nl"), t), _shared(F.col("nr"), t))
    # the overlap is at most what lies ahead from the first common element on; from the k-th on, k - 1 less
    ahead = F.least(F.col("nl") - F.col("pl"), F.col("nr") - F.col("pr"))
    met = salted_join(left, right, "g", "right", rows_of(prefix)).filter((F.col("left") != F.col("right")) & (F.col("nl") >= t * F.col("nr") - 1e-9) & (F.col("nr") >= t * F.col("nl") - 1e-9) & (ahead + least - 1 >= need))
    pairs = met.groupBy("left", "right", "nl", "nr").agg(F.count("*").alias("common"), F.min("pl").alias("pl"), F.min("pr").alias("pr"))
    pairs = pairs.filter((ahead >= need) & (F.col("common") >= least)).select("left", "right")
    sets = units.select("u", "n", "grams")
    side = lambda u, g, n: sets.select(F.col("u").alias(u), F.col("grams").alias(g), F.col("n").alias(n))
    both = pairs.join(side("left", "gl", "nl"), "left").join(side("right", "gr", "nr"), "right")
    common = F.size(F.array_intersect("gl", "gr"))
    return both.filter(common >= t * (F.col("nl") + F.col("nr") - common) - 1e-9).select("left", "right")
