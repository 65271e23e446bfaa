"""Places and running sums in one order of all rows, without a task that sees them all."""

from __future__ import annotations

import math
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and sorted there, with ``_part`` and ``_at``, which ascends inside a part."""
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return fixed(d.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def places(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in ascending ``order``: the place inside a part plus the rows of earlier parts (one row a part)."""
    d = parts(rows, order)
    n = d.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.select("_part", "_first", before.alias("_before"))
    return d.join(F.broadcast(n), "_part").withColumn(out, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums up to and with each row: ``sums`` maps a new column to the one it adds up."""
    d = parts(rows, order)
    n = d.groupBy("_part").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    n = n.select("_part", *[F.coalesce(F.sum(f"_s{k}").over(w), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    d = d.join(F.broadcast(n), "_part").select("*", *[(F.sum(c).over(inside) + F.col(f"_b{k}")).alias(name) for k, (name, c) in enumerate(sums.items())])
    return d.drop("_part", "_at", *[f"_b{k}" for k in range(len(sums))])


def quantiles(rows: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """(k, i, value): the exact quantile qs[i] of cols[k], interpolated between neighbours, nulls left out; no rows where a column has no value.

    All columns are put in one order by ranges, and only the values at the places in question are picked, so no
    task gets a whole column and nothing grows with the number of distinct values.
    """
    long = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("k", "v")).where("v is not null")
    d = places(long, ["k", "v"], "_place")
    n = d.groupBy("k").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))  # one row a column
    at = F.col("q") * (F.col("_n") - 1)
    want = n.select("k", "_first", "_n", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("i", "q")).withColumn("_at", at).withColumn("_low", F.floor("_at"))
    picks = F.array(F.struct(F.col("_low").alias("p"), (F.col("_low") + 1 - F.col("_at")).alias("w")), F.struct(F.least(F.col("_low") + 1, F.col("_n") - 1).alias("p"), (F.col("_at") - F.col("_low")).alias("w")))
    want = want.select("k", "i", "_first", F.inline(picks)).select("k", "i", (F.col("_first") + F.col("p")).alias("_place"), "w")
    return d.join(F.broadcast(want), ["k", "_place"]).groupBy("k", "i").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


#: Part of the rows by which the sketch of ``close_quantiles`` may miss a place, inverted.
SKETCH = 10_000


def close_quantiles(rows: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """What ``quantiles`` gives, without putting all values in order: for rows that are cached or cheaply made, which are read three times.

    A sketch brackets each quantile, values below the brackets are counted, and only those inside, a few in ten thousand or
    many alike, are grouped by value and ordered. If a count shows that a bracket misses its places, the values are
    put in order after all.
    """
    near = [p for q in qs for p in (max(0.0, q - 3 / SKETCH), min(1.0, q + 3 / SKETCH))]
    x = [F.col(c).cast("double") for c in cols]
    s = rows.agg(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, near, SKETCH).alias("p")).alias(f"s{k}") for k, v in enumerate(x)]).first()
    ends = {(k, i): (s[k].n, s[k].p[2 * i], s[k].p[2 * i + 1]) for k in range(len(cols)) for i in range(len(qs)) if s[k].n}  # columns x quantiles numbers
    if not ends:
        return quantiles(rows, cols, qs)
    inside = {(k, i): x[k].between(F.lit(a), F.lit(b)) for (k, i), (_, a, b) in ends.items()}
    counts = [F.struct(F.count_if(x[k] < F.lit(a)).alias("below"), F.count_if(inside[k, i]).alias("n")).alias(f"c{k}_{i}") for (k, i), (_, a, _) in ends.items()]
    c = dict(zip(ends, rows.agg(*counts).first(), strict=True))
    low = {(k, i): math.floor(qs[i] * (n - 1)) for (k, i), (n, _, _) in ends.items()}
    if any(not c[e].below <= low[e] or c[e].below + c[e].n <= min(low[e] + 1, ends[e][0] - 1) for e in ends):
        return quantiles(rows, cols, qs)
    hit = F.array_compact(F.array(*[F.when(inside[k, i], F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), x[k].alias("v"))) for k, i in ends]))
    some = reduce(lambda a, b: a | b, inside.values())
    v = rows.where(some).select(F.inline(hit)).groupBy("k", "i", "v").agg(F.count("*").alias("n"))
    picks = []
    for (k, i), (n, _, _) in ends.items():
        at = qs[i] * (n - 1)
        picks += [(k, i, low[k, i] - c[k, i].below, low[k, i] + 1 - at), (k, i, min(low[k, i] + 1, n - 1) - c[k, i].below, at - low[k, i])]
    want = rows.sparkSession.createDataFrame(picks, "k int, i int, place long, w double")
    v = v.withColumn("upto", F.sum("n").over(W.partitionBy("k", "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    d = v.join(F.broadcast(want), ["k", "i"]).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    return d.groupBy("k", "i").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def quantile_row(rows: DataFrame, col: str, qs: list[float], out: str = "q") -> DataFrame:
    """One row with an array of the quantiles of one column."""
    q = quantiles(rows, [col], qs)
    return q.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_x")).select(F.transform("_x", lambda x: x["value"]).alias(out))  # one value a quantile
