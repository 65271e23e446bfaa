"""Retrieval of historical continuations, prototype memory, fusion weights, ridge correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.symbols import hash_order


def unit(df: DataFrame, col: str, floor: float = 1e-6) -> DataFrame:
    """``df`` with ``col`` (an array) scaled to length 1; shorter than ``floor`` counts as ``floor``."""
    norm = F.greatest(F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x)), F.lit(floor))
    return df.withColumn("_n", norm).withColumn(col, F.transform(col, lambda x: x / F.col("_n"))).drop("_n")


def bounded_bank(keys: DataFrame, limit: int = 4096, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """At most ``limit`` rows of (bank, v, by) (of each ``by``): those of least hash of the id, an exact sample that is the same in every run."""
    w = W.partitionBy(*by).orderBy(hash_order("bank", seed), "bank")  # only the first rows of each task are shuffled
    return keys.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def standard_keys(queries: DataFrame, bank: DataFrame, by: tuple[str, ...] = (), floor: float = 1e-6, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``queries`` and ``bank`` with v in the bank's scale: each dimension less its mean over its sd (of each ``by``); an sd below ``floor`` counts as ``least``."""
    s = bank.select(*by, F.posexplode("v").alias("_j", "_x")).groupBy(*by, "_j").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    s = s.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "m", F.when(F.col("s") < floor, least).otherwise(F.col("s")).alias("s")))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("_k"))  # one entry a dimension

    def scaled(df: DataFrame) -> DataFrame:
        d = df.join(s, list(by)) if by else df.join(F.broadcast(s))
        return d.withColumn("v", F.zip_with("v", "_k", lambda x, k: (x - k["m"]) / k["s"])).drop("_k")

    return scaled(queries), scaled(bank)


def nearest(queries: DataFrame, bank: DataFrame, k: int, n: int, metric: str = "cosine", block: int = 16_384, by: str | None = None) -> DataFrame:
    """(query, bank, rank, score): the k best bank rows of each query, score first, rounded to nine places, then bank id.

    ``queries`` (query, v) and ``bank`` (bank, v) with arrays of n numbers; the score is their product (the
    cosine of unit vectors) or minus their Euclidean distance. With ``by`` a query meets the bank rows of its
    own value of this column. Both are dealt by hash into blocks of about ``block`` rows; each pair of blocks
    keeps the k best of its queries, so that k rows a query and bank block are shuffled, never the product.
    The work is queries x bank: bound the bank (``bounded_bank``) where the table grows.
    """
    parts = [max(1, -(-d.count() // block)) for d in (queries, bank)]
    own = [F.col(by)] if by else [F.lit(0)]
    q = queries.select(own[0].alias("g"), F.col("query").alias("query"), F.col("v").alias("v"), F.pmod(F.xxhash64("query"), F.lit(parts[0])).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[1] - 1).cast("long"))).alias("bb"))
    b = bank.select(own[0].alias("of_g"), F.col("bank").alias("bank"), F.col("v").alias("u"), F.pmod(F.xxhash64("bank"), F.lit(parts[1])).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[0] - 1).cast("long"))).alias("of"))

    def best(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "bank": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(own) and len(others):
            others = others.sort_values("bank", ignore_index=True)
            x, y, ids = np.stack(own["v"]).astype(float)[:, :n], np.stack(others["u"]).astype(float)[:, :n], others["bank"].to_numpy()
            for lo in range(0, len(x), step := max(1, (1 << 22) // len(y))):
                some = x[lo : lo + step]
                if metric == "cosine":
                    score = some @ y.T
                else:
                    score = np.zeros((len(some), len(y)))
                    for j in range(n):  # differences themselves: near rows would lose their digits in x2 + y2 - 2xy
                        score -= (some[:, j, None] - y[None, :, j]) ** 2
                    score = -np.sqrt(-score)
                r = -score.round(9)
                r_k = np.partition(r, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                i, j = np.nonzero(r <= r_k[:, None])
                order = np.lexsort((j, r[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[keep], j[keep]
                out.append(pd.DataFrame({"query": own["query"].to_numpy()[lo + i], "bank": ids[j], "score": score[i, j]}))
        return pd.concat(out)

    found = q.groupBy("g", "qb", "bb").cogroup(b.groupBy("of_g", "of", "own")).applyInPandas(best, "query long, bank long, score double")
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "bank")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "bank", "rank", "score")


def two_views(queries: DataFrame, bank: DataFrame, k: int, dims: tuple[int, int], beta: float = 0.2, by: str | None = None) -> DataFrame:
    """(query, bank, rank, score, weight): the k bank rows of largest embedding cosine plus ``beta`` x symbolic cosine.

    ``queries`` (query, e, s) and ``bank`` (bank, e, s): embeddings of dims[0] numbers, symbolic features of
    dims[1], which are standardised over the bank first (sd at least 1e-5). The sum of both cosines is one
    product of joined vectors, so the whole bank is searched by it and a row that neither view would list alone
    can win. Weights are exp(score - best score) of the k rows, normalised.
    """
    symbolic = [d.withColumn("v", F.col("s")) for d in (queries, bank)]
    symbolic = standard_keys(*symbolic, (by,) if by else (), 1e-5, 1e-5)
    q, b = (unit(unit(d, "e"), "v") for d in symbolic)
    q = q.withColumn("v", F.concat("e", F.transform("v", lambda x: x * F.lit(float(beta)))))
    found = nearest(q, b.withColumn("v", F.concat("e", "v")), k, sum(dims), by=by)
    w = W.partitionBy("query")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return found.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_weights(neighbours: DataFrame) -> DataFrame:
    """(query, bank, rank, weight): exp(-(d - d1)/max(median d, 1e-4)) normalised, d = -score."""
    w = W.partitionBy("query")
    d = neighbours.withColumn("d", -F.col("score")).withColumn("m", F.greatest(F.percentile("d", 0.5).over(w), F.lit(1e-4))).withColumn("e", F.exp(-(F.col("d") - F.min("d").over(w)) / F.col("m")))
    return d.select("query", "bank", "rank", "d", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def weighted_future(weights: DataFrame, futures: DataFrame) -> DataFrame:
    """(query, h, forecast, variance) from (bank, h, level)."""
    j = weights.join(futures, "bank")
    m = j.groupBy("query", "h").agg(F.sum(F.col("weight") * F.col("level")).alias("forecast"), F.sum(F.col("weight") * F.col("level") * F.col("level")).alias("square"))
    return m.select("query", "h", "forecast", F.greatest(F.lit(0.0), F.col("square") - F.col("forecast") ** 2).alias("variance"))


def reliability(weights: DataFrame, future: DataFrame, k: int) -> DataFrame:
    """(query, reliability): min(1/sum w2 / k, 1) x exp(-d1/median d1) x 1/(1 + sqrt(mean variance))."""
    s = weights.groupBy("query").agg((1.0 / F.sum(F.col("weight") ** 2)).alias("support"), F.min("d").alias("d"))
    scale = s.agg(F.greatest(F.percentile("d", 0.5), F.lit(1e-4)).alias("scale"))
    v = future.groupBy("query").agg(F.avg("variance").alias("v"))
    return s.join(v, "query").join(F.broadcast(scale)).select("query", (F.least(F.col("support") / k, F.lit(1.0)) * F.exp(-F.col("d") / F.col("scale")) / (1 + F.sqrt("v"))).alias("reliability"))


def choose_alpha(cells: DataFrame, steps: int = 21, tolerance: float = 0.0) -> DataFrame:
    """(alpha, mse, mae): the least MSE of (1-alpha) base + alpha memory with MAE <= base + tolerance; first alpha on ties, 0 if none is allowed."""
    grid = [i / (steps - 1) for i in range(steps)]
    e = [(1 - a) * F.col("base") + a * F.col("memory") - F.col("y") for a in grid]
    row = cells.agg(*[F.avg(x * x).alias(f"s{i}") for i, x in enumerate(e)], *[F.avg(F.abs(x)).alias(f"a{i}") for i, x in enumerate(e)])
    g = row.select("a0", F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"s{i}").alias("mse"), F.col(f"a{i}").alias("mae")) for i, a in enumerate(grid)])))
    return g.where(F.col("mae") <= F.col("a0") + tolerance + 1e-12).orderBy(F.round("mse", 9), "alpha").limit(1).select("alpha", "mse", "mae")


def choose_selective_alpha(cells: DataFrame, thresholds: list[float], steps: int = 21, tolerance: float = 0.0) -> tuple[float, float, float]:
    """(threshold, alpha, coverage): memory is used only where reliability reaches the threshold; MSE ties within 1e-12 go to lower coverage. The grid, at most 22 x 21 rows of sums, is folded on the driver."""
    grid = [i / (steps - 1) for i in range(steps)]
    aggs = []
    for j, t in enumerate(thresholds):
        use = (F.col("reliability") >= t).cast("double")
        aggs.append(F.avg(use).alias(f"c{j}"))
        for i, a in enumerate(grid):
            e = F.col("base") + use * a * (F.col("memory") - F.col("base")) - F.col("y")
            aggs += [F.avg(e * e).alias(f"s{j}_{i}"), F.avg(F.abs(e)).alias(f"a{j}_{i}")]
    r = cells.agg(*aggs).first()
    best = (r["s0_0"], 0.0, float("inf"), 0.0)
    for j, t in enumerate(thresholds):
        for i, a in enumerate(grid):
            if r[f"a{j}_{i}"] > r["a0_0"] + tolerance:
                continue
            s, c = r[f"s{j}_{i}"], r[f"c{j}"] if a else 0.0
            if s < best[0] - 1e-12 or (abs(s - best[0]) <= 1e-12 and c < best[3]):
                best = (s, a, t, c)
    return best[2], best[1], best[3]


def rerank(neighbours: DataFrame, symbolic: DataFrame, beta: float, k: int) -> DataFrame:
    """(query, bank, rank, score): embedding score plus beta x symbolic score of the same pair, best k."""
    j = neighbours.join(symbolic.select("query", "bank", F.col("score").alias("sym")), ["query", "bank"], "left").withColumn("total", F.col("score") + beta * F.coalesce("sym", F.lit(0.0)))
    w = W.partitionBy("query").orderBy(F.desc(F.round("total", 9)), "bank")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "bank", "rank", F.col("total").alias("score"))


def farthest_centres(keys: DataFrame, k: int, n: int, first: int = 0) -> DataFrame:
    """(centre, v): greedy k-centre from the row of id order ``first``; each round is one pass that keeps the least distance so far."""
    rows = keys.select("id", "v").cache()
    chosen = [rows.orderBy("id").offset(first).limit(1).first()]
    for _ in range(k - 1):
        d = F.least(*[sum([(F.get("v", F.lit(i)) - F.lit(float(c.v[i]))) ** 2 for i in range(1, n)], (F.get("v", F.lit(0)) - F.lit(float(c.v[0]))) ** 2) for c in chosen], F.lit(float("inf")))
        top = rows.agg(F.max_by(F.struct("id", "v"), F.struct(F.round(d, 9).alias("d"), (-F.col("id")).alias("o"))).alias("m"), F.max(F.round(d, 9)).alias("far")).first()
        if not top or not top.far:
            break
        chosen.append(top.m)
    return keys.sparkSession.createDataFrame([(i, list(map(float, c.v))) for i, c in enumerate(chosen)], "centre int, v array<double>")


def prototype_memory(keys: DataFrame, futures: DataFrame, centres: DataFrame, n: int, shrink: float = 0.0) -> DataFrame:
    """(centre, h, level): mean future of the keys nearest to each centre, shrunk to the overall mean; a centre without keys takes that mean."""
    own = nearest(keys.select(F.col("id").alias("query"), "v"), centres.select(F.col("centre").alias("bank"), "v"), 1, n, "euclidean").select(F.col("query").alias("id"), F.col("bank").alias("centre"))
    mean = futures.groupBy("h").agg(F.avg("level").alias("mean"))
    per = own.join(futures, "id").groupBy("centre", "h").agg(F.avg("level").alias("own"), F.count("*").alias("c"))
    grid = centres.select("centre").join(F.broadcast(mean)).join(per, ["centre", "h"], "left")
    return grid.select("centre", "h", F.coalesce((F.col("own") * F.col("c") + F.col("mean") * shrink) / (F.col("c") + shrink), F.col("mean")).alias("level"))


def anomaly_weight(rows: DataFrame, grid: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 1.0), tolerance: float = 0.05) -> DataFrame:
    """(weight, q95): the largest weight w with which the 95 % quantile of base + w x spread x evidence over normal rows rises by at most ``tolerance`` of the 5 to 95 % spread of base.

    ``rows``: (base, evidence) of normal validation windows.
    """
    grid = tuple(sorted({0.0, *grid}))
    spread = rows.agg(F.percentile("base", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).select(F.col("q")[1].alias("top"), F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-6)).alias("spread"))
    row = rows.join(F.broadcast(spread)).groupBy("top", "spread").agg(*[F.percentile(F.col("base") + w * F.col("spread") * F.col("evidence"), 0.95).alias(f"q{i}") for i, w in enumerate(grid)])
    g = row.select("top", "spread", F.inline(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"q{i}").alias("q95")) for i, w in enumerate(grid)])))
    return g.where(F.col("q95") <= F.col("top") + tolerance * F.col("spread") + 1e-12).orderBy(F.desc("weight")).limit(1).select("weight", "q95")


def clipped_evidence(train: DataFrame, rows: DataFrame, cols: tuple[str, ...], clip: float = 25.0) -> DataFrame:
    """``rows`` with evidence: mean clipped squared z over ``cols``, scaled by the training 5 to 95 % range and cut to 0..1."""
    stats = train.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.greatest(F.stddev_pop(c), F.lit(1e-5)).alias(f"{c}_s") for c in cols])
    z2 = [F.least(((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")) ** 2, F.lit(clip)) for c in cols]
    raw = sum(z2[1:], z2[0]) / len(cols)
    scored = lambda d: d.join(F.broadcast(stats)).withColumn("_e", raw)
    q = scored(train).agg(F.percentile("_e", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    scaled = (F.col("_e") - F.col("_q")[0]) / F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-6))
    return scored(rows).join(F.broadcast(q)).select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("evidence"))


def ridge(rows: DataFrame, x: list[str], y: list[str], alpha: float, by: str = "channel") -> DataFrame:
    """(by, target, term, coef): ridge regression in closed form, the intercept not penalised.

    Sums of products are aggregated with partial sums; only one small matrix a group reaches Python.
    """
    cols = [*x, *y]
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"m_{c}") for c in cols], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for i, a in enumerate(x) for b in [*x[i:], *y]])
    key = next(f for f in rows.schema if f.name == by).dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = r["n"]
        mean = {c: r[f"m_{c}"] / n for c in cols}
        prod = lambda a, b: (r[f"p_{a}__{b}"] if f"p_{a}__{b}" in r else r[f"p_{b}__{a}"]) - n * mean[a] * mean[b]
        a = np.array([[prod(p, q) for q in x] for p in x]) + alpha * np.eye(len(x))
        b = np.array([[prod(p, q) for q in y] for p in x])
        coef = np.linalg.lstsq(a, b, rcond=None)[0]
        out = [(r[by], t, p, float(coef[i, j])) for j, t in enumerate(y) for i, p in enumerate(x)]
        out += [(r[by], t, "intercept", float(mean[t] - sum(mean[p] * coef[i, j] for i, p in enumerate(x)))) for j, t in enumerate(y)]
        return pd.DataFrame(out, columns=[by, "target", "term", "coef"])

    return sums.groupBy(by).applyInPandas(solve, f"{by} {key}, target string, term string, coef double")
