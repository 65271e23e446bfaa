"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words; the ratio of target to size says how many whole copies every
document of it gets for certain. One more copy goes to a sample that fills the rest of the target. In it a
document's inclusion probability rises with its length (one more than the binary order of magnitude of its
words, scaled so that the expected words are the rest; where that reaches 1 the copy is certain). The others
are ranked by the odds of a number drawn from their id over the odds of their own probability, and the
lowest ranks are taken until their words fill what is left.

The cut is found in two steps of a histogram (4,096 bins of the rank a source, then 4,096 of the bin that
holds the cut), so that no source, however large, is sorted in one task: only the documents of one fine
bin, about one in 16.8 million of a source, are put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, materialise

BINS = 4096


def draw(doc_id: Column, seed: int) -> Column:
    """A 53-bit whole number drawn from the id and the seed alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), doc_id), 11)


def targets(sizes: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0, weights: dict | None = None) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source, null a source of its own.

    Sources by code point, null last, weigh ``cycle`` in turn (or ``weights`` by name, 0 if absent) and share
    ``budget`` times all sizes; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight among the others until none is above. In closed form: by ascending cap/weight, the
    sources filled to their cap are a prefix, found with running sums over one row a source.
    """
    one = F.lit(1)
    order = W.partitionBy(one).orderBy(F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    if weights is None:
        w = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    else:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")] if weights else F.lit(None), F.lit(0.0)).cast("double")
    s = sizes.select("source", F.col("source_size").cast("long"), w.alias("w")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    up = W.partitionBy(one).orderBy(F.when(F.col("w") > 0, F.col("most") / F.col("w")).otherwise(F.lit(float("inf"))), F.col("source").isNull(), "source")
    everything = W.partitionBy(one)
    s = s.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(budget)))
    s = s.withColumn("filled", F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
    # the level if this source is the first one not filled; the true level is the first that its cap covers
    s = s.withColumn("level", F.when(F.col("w_left") > 0, (F.col("all") - F.col("filled")) / F.col("w_left")))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("filled", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.when(F.col("w") > 0, F.col("most")).otherwise(F.lit(0.0))).otherwise(F.least(F.col("most"), F.col("level") * F.col("w"))).alias("target"))


def order_of_size(size: Column) -> Column:
    """What the inclusion probability of a document is proportional to: one more than floor(log2(words))."""
    return F.floor(F.log2(size) + 1e-9) + 1


def inclusion(levels: DataFrame) -> DataFrame:
    """(source, scale, certain): probabilities min(1, scale x order) with which the expected words are ``rest``, and the words that are certain.

    ``levels``: (source, rest, order, words), a few rows a source. In closed form: the certain orders are the
    highest ones, and the scale is that of the first order which it leaves at 1 or less.
    """
    down = W.partitionBy("source").orderBy(F.desc("order"))
    s = levels.withColumn("certain", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("scale", (F.col("rest") - F.col("certain")) / F.sum(F.col("order") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing)))
    return s.where(F.col("scale") * F.col("order") <= 1 + 1e-12).groupBy("source").agg(F.max_by(F.struct("scale", "certain"), "order").alias("x")).select("source", "x.scale", "x.certain")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Copies of each document in the mix: doc_id, size, source, source_size, target, copies, taken (words), ``keep``.

    Whole copies only: ``floor(target / source_size)`` are certain, and one more goes to the documents whose
    probability is 1 and to those of lowest Pareto rank while their running words stay within half a document
    of what is left. Null text has size 0 and is taken 0 words; a source of size 0 has target 0. Rows that
    share an id are drawn alike and ordered by size; rows of null id draw from their text.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"), F.col(source).alias("source"), F.coalesce(draw(F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(doc_id))), seed), F.lit(0)).alias("_u"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    # all that finds the cuts reads short rows; texts are read once for these and once more where they are kept
    d = materialise(rows.select("_id", "size", "source", "_u"), "mix-sizes")
    rows = rows if keep else d
    size = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, budget, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    size = size.withColumn("whole", F.floor(ratio + 1e-12))
    size = materialise(size.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "mix-targets")
    levels = d.where("size > 0").groupBy("source", order_of_size(F.col("size")).alias("order")).agg(F.sum("size").alias("words"))
    levels = levels.join(size.select(F.col("source").alias("s0"), "rest"), F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    odds = inclusion(levels).withColumnRenamed("source", "s0")
    size = materialise(size.join(odds, F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0").withColumn("left", F.col("rest") - F.coalesce("certain", F.lit(0))), "mix-targets")

    def ranked(d: DataFrame, sources: DataFrame) -> DataFrame:
        """Rows beside what ``sources`` says of theirs, with probability, rank and bins."""
        # sources are few against documents, yet unbounded: the join is left to the planner, which measures the side
        r = d.join(sources, d["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        p, u = F.coalesce(F.col("scale") * order_of_size(F.col("size")), F.lit(0.0)), (F.col("_u") + 0.5) / F.lit(float(1 << 53))
        r = r.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), p)).otherwise(F.lit(0.0)))
        drawn = (F.col("p") > 0) & (F.col("p") < 1)
        r = r.withColumn("rank", F.when(drawn, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        # bins of rank / (1 + rank), which lies between 0 and 1
        bin_ = (F.col("rank") / (1 + F.col("rank")) * F.lit(float(BINS))).cast("double")
        b1 = F.least(F.floor(bin_), F.lit(BINS - 1)).cast("int")
        return r.withColumn("b1", b1).withColumn("b2", F.least(F.floor((bin_ - F.col("b1")) * BINS), F.lit(BINS - 1)).cast("int"))

    def cut(h: DataFrame, by: str, left: str) -> DataFrame:
        """Of each source the bin that holds the cut, and the words still to fill in it."""
        w = W.partitionBy("source").orderBy(by)
        h = h.withColumn("upto", F.sum("words").over(w.rowsBetween(W.unboundedPreceding, 0)))
        at = h.where(F.col("upto") > F.col(left)).groupBy("source").agg(F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before"), left)).alias("m"))
        return at.select("source", F.col(f"m.{by}").alias(f"cut_{by}"), (F.col(f"m.{left}") - F.col("m.before")).alias(f"left_{by}"))

    some = ranked(d, size).where(F.col("rank").isNotNull())
    c1 = materialise(cut(some.groupBy("source", "b1").agg(F.sum("size").alias("words"), F.first("left").alias("left")), "b1", "left"), "mix-cut")
    inner = some.join(c1.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("cut_b1"))).drop("s1")
    c2 = materialise(cut(inner.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("left_b1").alias("left_b1")), "b2", "left_b1"), "mix-cut")
    fine = inner.join(c2.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("b2") == F.col("cut_b2"))).drop("s2")
    w = W.partitionBy("source").orderBy("rank", "_id", "size").rowsBetween(W.unboundedPreceding, 0)
    fine = fine.withColumn("upto", F.sum("size").over(w)).where(F.col("upto") - F.col("size") / 2.0 > F.col("left_b2"))
    c3 = fine.groupBy("source").agg(F.min(F.struct("rank", "_id", "size")).alias("stop"))
    cuts = c1.join(c2.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    cuts = cuts.join(c3.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3").withColumnRenamed("source", "s0")
    # one row a source with all that the last pass looks up
    r = ranked(rows, materialise(size.join(cuts, F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0"), "mix-cut"))
    here = F.struct("rank", "_id", "size")
    more = (
        F.when(F.col("rank").isNull(), F.col("p") >= 1)
        .when(F.col("cut_b1").isNull() | (F.col("b1") < F.col("cut_b1")), True)
        .when(F.col("b1") > F.col("cut_b1"), False)
        .when(F.col("cut_b2").isNull() | (F.col("b2") < F.col("cut_b2")), True)
        .when(F.col("b2") > F.col("cut_b2"), False)
        .otherwise(F.col("stop").isNull() | (here < F.col("stop")))
    )
    r = r.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.when(more, 1).otherwise(0)).otherwise(F.lit(0)).cast("long"))
    return r.select(F.col("_id").alias(doc_id), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
