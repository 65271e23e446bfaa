"""Whole read-outs made of the operators: features over channels and scales, anomaly and forecast evidence, states, volumes under surfaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics as M
from . import mining as G
from . import novelty as N
from . import retrieval as T
from . import windows as X
from .ordering import fixed

#: Miner registry: what fit and match mean for each method.
METHODS = ("fastshapelets", "bossst")
#: Samples that one task of a k-means step reads.
FIT_ROWS = 50_000


def flat_code(word_len: int, alphabet: int) -> int:
    """The SAX word of the zero vector: zero goes up at a middle edge."""
    return sum((alphabet // 2) * alphabet**i for i in range(word_len))


def features(points: DataFrame, window: int, method: str = "fastshapelets", word_len: int = 4, alphabet: int = 4, top_k: int = 10, n_candidates: int = 50, n_projections: int = 10, mask_size: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(features, dictionary) of one channel's (series, t, value, label), or its packed series: presence, frequency, distance and location of each mined word in each series.

    A channel without usable words gives an empty dictionary and no rows.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "fastshapelets":
        words, z = X.sax_words(points, window, word_len, alphabet, carry=("label",)).drop("word").cache(), G.z_windows(points, window)
        top, queries, dist = G.mined(words, z, window, word_len, flat_code(word_len, alphabet), G.projection_masks(word_len, mask_size, n_projections, seed), n_candidates, top_k, alphabet)
        top = top.cache()
        return G.match(words, z, top, queries, window, distances=dist), top
    coefs = X.fourier_windows(points, window, word_len, carry=("label",))
    words, zero = X.fitted_sfa_words(coefs, word_len, alphabet, carry=("label",), keep=not X.packed(points))
    top = G.boss_words(words, zero, top_k)
    digits = top.select("code", *[(F.floor(F.col("code") / alphabet ** (word_len - 1 - i)) % alphabet).cast("int").alias(f"r{i}") for i in range(word_len)])
    return G.boss_match(words, digits, word_len, alphabet), top


def multiscale(points: DataFrame, windows: tuple[int, ...], **settings) -> DataFrame:
    """Features of several window lengths with a column scale."""
    return reduce(DataFrame.unionByName, [features(points, w, **settings)[0].withColumn("scale", F.lit(w)) for w in windows])


def pattern_tokens(feats: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(series, token, kind, value): K word tokens of three kinds each, in dictionary order."""
    d = feats.join(F.broadcast(dictionary.select("code", "rank")), "code")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("value")) for k in ("presence", "frequency", "distance")])
    return d.select("series", (F.col("rank") - 1).alias("token"), F.inline(kinds))


def payload(scores: DataFrame, explained: DataFrame, top: int = 3) -> DataFrame:
    """(series, json): the highest points of each series with their explanations as one nested document."""
    w = W.partitionBy("series").orderBy(F.desc("score"), "t")
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).join(explained.withColumnRenamed("at", "t"), ["series", "t"], "left")
    cells = F.array_sort(F.collect_list(F.struct("r", "t", F.round("score", 4).alias("score"), "word", "train_count", "nearest")))
    return best.groupBy("series").agg(F.to_json(F.struct(F.first("series").alias("series"), cells.alias("points"))).alias("json"))


def anomaly_readout(base: DataFrame, symbolic: DataFrame, held: DataFrame, lam: float = 0.5) -> DataFrame:
    """(stream, best_f1, ap, n_entities) for base, symbolic, z fusion and calibrated fusion.

    ``base`` and ``symbolic``: (series, t, label, score); ``held``: (series, t) of held-out normal points, by
    which both are scaled and calibrated. The test points are the others.
    """
    both = fixed(base.select("series", "t", "label", F.col("score").alias("b")).join(symbolic.select("series", "t", F.col("score").alias("s")), ["series", "t"]))
    ref, new = fixed(both.join(held, ["series", "t"], "left_semi")), both.join(held, ["series", "t"], "left_anti")
    q = fixed(N.tail_surprisal(fixed(N.tail_surprisal(new, ref, "b", "b", "qb")), ref, "s", "s", "qs"))
    kb, ks = N.robust(ref, "b").select(F.col("loc").alias("lb"), F.col("scale").alias("cb")), N.robust(ref, "s").select(F.col("loc").alias("ls"), F.col("scale").alias("cs"))
    d = q.join(F.broadcast(kb.join(ks)))
    zb, zs = (F.col("b") - F.col("lb")) / F.col("cb"), (F.col("s") - F.col("ls")) / F.col("cs")
    streams = F.array(*[F.struct(F.lit(n).alias("stream"), F.round(x, 9).alias("score")) for n, x in (("base", F.col("b")), ("symbolic", F.col("s")), ("fusion_z", zb + lam * zs), ("fusion_calibrated", F.col("qb") + F.col("qs")))])
    long = d.select("series", "label", F.inline(streams))
    per = M.best_f1_exact(long, ("stream", "series")).join(M.average_precision(long, ("stream", "series")), ["stream", "series"])
    return per.groupBy("stream").agg(F.avg("best_f1").alias("best_f1"), F.avg("ap").alias("ap"), F.count("*").alias("n_entities"))


def forecast_evidence(queries: DataFrame, bank: DataFrame, futures: DataFrame, cells: DataFrame, k: int, n: int, by: str | None = None) -> DataFrame:
    """(alpha, mse, mae) chosen for base and retrieved futures: ``queries`` (query, v), ``bank`` (bank, v), ``futures`` (bank, h, level), ``cells`` (query, h, y, base)."""
    memory = T.weighted_future(T.softmax_weights(T.nearest(queries, bank, k, n, by=by)), futures)
    return T.choose_alpha(cells.join(memory.select("query", "h", F.col("forecast").alias("memory")), ["query", "h"]))


def future_states(futures: DataFrame, horizon: int, k: int = 8, seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """((sample, state), (state, h, level)): k-means of standardised futures (sample, h, level), the best of several seeds by cost; centres in original units."""
    wide = fixed(futures.groupBy("sample").pivot("h", list(range(horizon))).agg(F.first("level")))
    # every step of a fit sends the driver one result a task, so tasks are counted by rows and the plan, whose metrics go along, is cut;
    # seeds and sums go by part and order, which are made of the samples here and not of the session's settings
    wide = fixed(wide.repartition(-(-max(1, wide.count()) // FIT_ROWS), "sample").sortWithinPartitions("sample"))
    stats = wide.agg(*[F.avg(str(h)).alias(f"m{h}") for h in range(horizon)], *[F.greatest(F.stddev_pop(str(h)), F.lit(1e-6)).alias(f"s{h}") for h in range(horizon)])
    z = wide.join(F.broadcast(stats)).select("sample", *[((F.col(str(h)) - F.col(f"m{h}")) / F.col(f"s{h}")).alias(f"z{h}") for h in range(horizon)])
    x = VectorAssembler(inputCols=[f"z{h}" for h in range(horizon)], outputCol="x").transform(z).cache()
    models = [KMeans(featuresCol="x", k=k, seed=s).fit(x) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    states = best.transform(x).select("sample", F.col("prediction").alias("state"))
    return states, futures.join(states, "sample").groupBy("state", "h").agg(F.avg("level").alias("level"))


def soft_labels(y: np.ndarray, width: int) -> np.ndarray:
    """Labels with ramps of half a ``width`` on both sides of each segment: the root of 1 - distance / width, overlaps added up to 1."""
    out = y.astype(float)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], y, [0]])))
    for first, after in zip(edges[::2], edges[1::2], strict=True):
        right = np.arange(after - 1, min(after - 1 + width // 2, len(y)))
        left = np.arange(max(first - width // 2, 0), first)
        out[right] += np.sqrt(1 - (right - (after - 1)) / max(width, 1))
        out[left] += np.sqrt(1 - (first - left) / max(width, 1))
    return np.minimum(out, 1.0)


def range_curve(y: np.ndarray, score: np.ndarray, width: int, n_thresholds: int) -> tuple[float, float]:
    """Areas under the range-aware ROC and precision-recall curves of one buffer width.

    At a threshold the true positives are the soft labels of the points at or above it; recall is over the mean
    of the hard and the soft label mass, at most 1, times the share of soft segments with a point found (the
    existence ratio). Thresholds are the scores at ``n_thresholds`` even places of their descending order.
    """
    soft = soft_labels(y, width)
    order = np.argsort(-score, kind="stable")
    ranked = score[order]
    at = np.linspace(0, len(score) - 1, n_thresholds).astype(int)
    last = np.searchsorted(-ranked, -ranked[at], side="right")  # points at or above each threshold
    tp = np.cumsum(soft[order])[last - 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (soft > 0).astype(int), [0]])))
    tops = np.sort([score[a:b].max() for a, b in zip(edges[::2], edges[1::2], strict=True)])
    found = (len(tops) - np.searchsorted(tops, ranked[at], side="left")) / len(tops)
    positives = (y.sum() + soft.sum()) / 2
    recall = np.minimum(tp / positives, 1.0) * found
    false = (last - tp) / (len(y) - positives)
    tpr, fpr = np.concatenate([[0], recall, [1]]), np.concatenate([[0], false, [1]])
    precision = np.concatenate([[1], tp / last])
    roc = float(((fpr[1:] - fpr[:-1]) * (tpr[1:] + tpr[:-1]) / 2).sum())
    return roc, float(((tpr[1:-1] - tpr[:-2]) * precision[1:]).sum())


def vus(scores: DataFrame, width: int, by: str = "series", n_thresholds: int = 250) -> DataFrame:
    """(by, vus_roc, vus_pr): volumes under the range-aware ROC and precision-recall surfaces over buffers of 0 to ``width`` points.

    ``range_curve`` says what one buffer gives; a volume is the mean over buffers. An entity whose labels are all
    alike has no volume and no row. One entity is one group: its points are ordered once a buffer.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, s = pdf["label"].to_numpy(int), pdf["score"].to_numpy(float)
        if y.min() == y.max():
            return pd.DataFrame({by: [], "vus_roc": [], "vus_pr": []})
        areas = np.array([range_curve(y, s, w, n_thresholds) for w in range(min(width, len(y) - 1) + 1)])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "vus_roc": [areas[:, 0].mean()], "vus_pr": [areas[:, 1].mean()]})

    key = next(f for f in scores.schema if f.name == by).dataType.simpleString()
    return scores.select(by, "t", "label", "score").groupBy(by).applyInPandas(one, f"{by} {key}, vus_roc double, vus_pr double")


def centroid_signals(rows: DataFrame, centres: DataFrame, length: int, in_channels: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(series, y, state, predicted, probability, loss, conf, entropy, statistics) of packed ``rows`` (series, label, fold, values).

    Logits are minus the squared distances to the ``centres`` (fold, classes: array of (k, c)) of the row's fold, a bounded
    table; the loss is 1 for a wrong class, conf minus the largest probability. Series of other lengths are cut or
    end in missing points, which add no distance. ``in_channels`` shapes a batch for ``statistics_of``.
    """
    of = {r.fold: ([c.k for c in r.classes], np.array([c.c for c in r.classes])) for r in centres.collect()}  # folds x classes x length numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fold, own in b.groupby("fold"):
                ks, c = of[fold]
                x = np.full((len(own), length), np.nan)
                for i, v in enumerate(own["values"]):
                    x[i, : min(length, len(v))] = v[:length]
                gap = x[:, None, :] - c[None, :, :]
                logit = -np.where(np.isnan(gap), 0.0, gap * gap).sum(2)
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                predicted = np.array(ks)[logit.argmax(1)]
                yield pd.DataFrame({
                    "series": own["series"], "y": own["label"], "state": list(x), "predicted": predicted, "probability": p.max(1), "loss": (predicted != own["label"].to_numpy()).astype(float),
                    "conf": -p.max(1), "entropy": -(p * np.log(p + 1e-12)).sum(1), "statistics": list(X.statistics_of(in_channels(x))),
                })

    d = rows.where(F.size("values") > 0).select("series", "label", "fold", "values")
    return d.mapInPandas(run, "series long, y int, state array<double>, predicted int, probability double, loss double, conf double, entropy double, statistics array<double>")
