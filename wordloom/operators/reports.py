"""Reports over result rows, explanations and fusion summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ordering import running


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seed_summary(rows: DataFrame, keys: tuple[str, ...], metric: str) -> DataFrame:
    """(keys, n, mean, std, spread): sample standard deviation as in seed tables, population as in text; null keys are kept."""
    ok = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.stddev_pop(metric).alias("spread"))


def baseline_deltas(rows: DataFrame, keys: tuple[str, ...], metric: str, variant: str = "variant", base: str = "baseline") -> DataFrame:
    """(keys, variant, metric, delta) against the baseline row of the same keys; null where there is none."""
    b = rows.where(F.col(variant) == base).select(*keys, F.col(metric).alias("_base"))
    return rows.join(b, list(keys), "left").select(*keys, variant, metric, (F.col(metric) - F.col("_base")).alias("delta"))


def wins(rows: DataFrame, keys: tuple[str, ...], a: str, b: str) -> DataFrame:
    """(keys, n, wins, mean_delta): how often a exceeds b by more than 1e-12."""
    d = F.col(a) - F.col(b)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((d > 1e-12).cast("int")).alias("wins"), F.avg(d).alias("mean_delta"))


#: Differences up to which the null distribution is exact.
EXACT = 200


def _upper_tail(z):
    """P(Z >= z) of a standard normal; for the one row of a test."""
    return None if z is None else 0.5 * math.erfc(z / math.sqrt(2.0))


def wilcoxon_greater(rows: DataFrame, col: str = "d", exact: int = EXACT) -> DataFrame:
    """(n, w_plus, p): one-sided signed-rank test; differences up to 1e-12 are dropped and fewer than 3 give null.

    Ties have average ranks. Up to ``exact`` differences p is exact: the probability of each rank sum is built
    rank by rank, in steps of a half, which takes n x n (n + 1) additions in place of 2 ** n sign vectors.
    Beyond it p is the normal approximation with the variance corrected for ties. Ranks come from counts by
    distinct magnitude, so only these are put in one order.
    """
    d = rows.where(F.abs(col) > 1e-12).select(F.col(col).alias("d"), F.round(F.abs(col), 12).alias("m"))
    sizes = d.groupBy("m").agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    sizes = running(sizes, ["m"], {"upto": "t"}).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    one = sizes.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    one = one.select("n", "w_plus", F.when(F.col("n") > exact, z).alias("z"))
    few = sizes.join(F.broadcast(one.where(F.col("n").between(3, exact)).select(F.col("n").alias("_n"), "w_plus")))
    few = few.groupBy("_n", "w_plus").agg(F.flatten(F.collect_list(F.array_repeat((2 * F.col("rank")).cast("int"), F.col("t").cast("int")))).alias("ranks"))  # at most `exact`
    start = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") * (F.col("_n") + 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    shift = lambda acc, r: F.transform(acc, lambda x, i: 0.5 * (x + F.when(i >= r, F.coalesce(F.get(acc, i - r), F.lit(0.0))).otherwise(0.0)))
    chances = few.select("_n", "w_plus", F.posexplode(F.aggregate("ranks", start, shift)).alias("s", "c"))
    p = chances.where(F.col("s") >= 2 * F.col("w_plus") - 1e-9).groupBy("_n").agg(F.sum("c").alias("_p"))
    out = one.join(p, F.col("n") == F.col("_n"), "left")
    return out.select("n", "w_plus", F.when(F.col("n") > exact, F.udf(_upper_tail, DoubleType())("z")).otherwise(F.col("_p")).alias("p"))


def compact(rows: DataFrame, nested: tuple[str, ...]) -> DataFrame:
    """``rows`` without nested fields."""
    return rows.drop(*nested)


def explanations(features: DataFrame, dictionary: DataFrame, attributions: DataFrame, window: int, top: int = 3) -> DataFrame:
    """(series, rank, code, attribution, start, end, ig, class, support): attributions summed over a word's kinds, largest magnitude first, with the matched span."""
    a = attributions.groupBy("series", "code").agg(F.sum("part").alias("attribution"))
    w = W.partitionBy("series").orderBy(F.desc(F.round(F.abs("attribution"), 9)), "code")
    best = a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    d = best.join(features, ["series", "code"]).join(F.broadcast(dictionary.select("code", "ig", F.col("dominant").alias("class"), "support")), "code")
    return d.select("series", "rank", "code", "attribution", F.col("location").alias("start"), (F.col("location") + window).alias("end"), "distance", "ig", "class", "support")


def verify(records: DataFrame, recomputed: DataFrame, length: int, tolerance: float = 1e-3) -> DataFrame:
    """Records with a problem: bounds outside the series, or a distance that recomputation does not give."""
    d = records.join(recomputed.select("series", "code", F.col("distance").alias("again")), ["series", "code"], "left")
    bad = F.when((F.col("start") < 0) | (F.col("end") > length), "bounds").when(F.col("again").isNull() | (F.abs(F.col("again") - F.col("distance")) > tolerance), "distance")
    return d.withColumn("problem", bad).where("problem is not null")


def placeholder_check(records: DataFrame) -> DataFrame:
    """One row of counts that show explanations which do not vary."""
    return records.agg(F.count_distinct("start").alias("starts"), F.count_distinct("code").alias("words"), F.min("attribution").alias("least"), F.max("attribution").alias("most"))


def gate_summary(rows: DataFrame, col: str = "gate") -> DataFrame:
    """(mean, std, least, most) of a gate 1/(1 + exp(-x)); the sample standard deviation."""
    g = 1.0 / (1.0 + F.exp(-F.col(col)))
    return rows.agg(F.avg(g).alias("mean"), F.stddev_samp(g).alias("std"), F.min(g).alias("least"), F.max(g).alias("most"))


def markdown(rows: DataFrame, limit: int = 10_000) -> str:
    """A report table as Markdown; report rows are few and at most ``limit`` are read."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    for r in rows.limit(limit).collect():
        lines.append("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"
