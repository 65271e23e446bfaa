"""Novelty of words against a normal vocabulary, point scores, normalisation, fusion, explanations, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.symbols import mindist_cell
from .ordering import quantile_row
from .windows import over_blocks

FLAT_CODE = -1
NEAR_WORDS = 2048


def flat_coded(words: DataFrame) -> DataFrame:
    return words.withColumn("code", F.when(F.col("flat"), F.lit(FLAT_CODE).cast("long")).otherwise(F.col("code"))).withColumn("word", F.when(F.col("flat"), "<flat>").otherwise(F.col("word")))


def vocabulary(words: DataFrame, n: int) -> DataFrame:
    """(code, word, s0.., cnt): the normal words with their counts; flat windows are one word of their own."""
    return flat_coded(words).groupBy("code", "word", *[f"s{i}" for i in range(n)]).agg(F.count("*").alias("cnt"))


def word_distance(a: list[Column], b: list[Column], alphabet: int, kind: str = "sax") -> Column:
    """SAX: root mean square of the cells of MINDIST; SFA: mean symbol difference / (alphabet - 1)."""
    n = F.lit(float(len(a)))
    if kind == "sax":
        cells = [mindist_cell(x, y, alphabet) for x, y in zip(a, b, strict=True)]
        return F.sqrt(sum([c * c for c in cells[1:]], cells[0] * cells[0]) / n)
    gaps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return sum(gaps[1:], gaps[0]) / (n * F.lit(float(max(1, alphabet - 1))))


def nearest_words(words: DataFrame, vocab: DataFrame, n: int, alphabet: int = 4, kind: str = "sax", near: int = NEAR_WORDS) -> DataFrame:
    """(code, nearest, distance) of each distinct unseen word: the nearest of the ``near`` most frequent normal words, more frequent then lower code on ties.

    Only distinct unseen words meet the broadcast index, whose size is fixed.
    """
    order = [F.desc("cnt"), F.col("code")]
    index = vocab.where(F.col("code") != FLAT_CODE).orderBy(*order).limit(near).select(F.row_number().over(W.orderBy(*order)).alias("rank"), F.col("word").alias("nearest"), *[F.col(f"s{i}").alias(f"v{i}") for i in range(n)])
    new = flat_coded(words).select("code", *[f"s{i}" for i in range(n)]).where(F.col("code") != FLAT_CODE).distinct().join(vocab.select("code"), "code", "left_anti")
    d = word_distance([F.col(f"s{i}") for i in range(n)], [F.col(f"v{i}") for i in range(n)], alphabet, kind)
    best = new.join(F.broadcast(index)).groupBy("code").agg(F.min(F.struct(F.round(d, 9).alias("d"), "rank", "nearest")).alias("b"))
    return best.select("code", "b.nearest", F.col("b.d").alias("distance"))


def window_novelty(words: DataFrame, vocab: DataFrame, n: int, alphabet: int = 4, kind: str = "sax", weight: float = 4.0) -> DataFrame:
    """(series, t, word, cnt, nearest, distance, novelty): -ln((cnt+1)/(N+V+1)) plus weight x distance where the word is unseen."""
    w = flat_coded(words).select("series", "t", "word", "code")
    size = vocab.agg((F.sum("cnt") + F.count("*") + 1).alias("denom"))
    d = w.join(vocab.select("code", "cnt"), "code", "left").join(nearest_words(words, vocab, n, alphabet, kind), "code", "left").join(F.broadcast(size))
    cnt, dist = F.coalesce("cnt", F.lit(0)), F.coalesce("distance", F.lit(0.0))
    return d.select("series", "t", "word", cnt.alias("cnt"), "nearest", dist.alias("distance"), (-F.log((cnt + 1.0) / F.col("denom")) + weight * dist).alias("novelty"))


def point_novelty(points: DataFrame, nov: DataFrame, window: int, block: int | None = None) -> DataFrame:
    """``points`` with raw: the largest novelty of the windows that cover each point, 0 where none does. With ``block``, series are cut in blocks of so many points, whatever their length."""
    w = W.partitionBy("series").orderBy("t").rowsBetween(-(window - 1), 0)
    d = points.join(nov.select("series", "t", "novelty"), ["series", "t"], "left")
    raw = lambda x: x.select(*points.columns, F.coalesce(F.max("novelty").over(w), F.lit(0.0)).alias("raw"))
    return over_blocks(d, window, block, raw, back=True).select(*points.columns, "raw") if block else raw(d)


def normaliser(held: DataFrame, by: tuple[str, ...] = (), floor: float = 0.5) -> DataFrame:
    """(by, loc, scale): median and interquartile range, at least ``floor``, of held-out normal scores."""
    quarters = [0.25, 0.5, 0.75]
    q = held.groupBy(*by).agg(F.percentile("raw", F.array(*[F.lit(x) for x in quarters])).alias("q")) if by else quantile_row(held, "raw", quarters)
    return q.select(*by, F.col("q")[1].alias("loc"), F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(floor)).alias("scale"))


def reduced_channels(z: DataFrame, channels: int) -> DataFrame:
    """(series, t, score): mean of the ceil(sqrt(channels)) largest z of each point over channels."""
    k = int(-(-(channels**0.5) // 1))
    w = W.partitionBy("series", "t").orderBy(F.desc("z"), "channel")
    return z.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("series", "t").agg(F.avg("z").alias("score"))


def robust(values: DataFrame, col: str) -> DataFrame:
    """One row (loc, scale): median and IQR; a zero IQR falls back to the sd, then to 1."""
    r = quantile_row(values, col, [0.25, 0.5, 0.75]).join(F.broadcast(values.agg(F.stddev_pop(col).alias("sd"))))
    iqr = F.col("q")[2] - F.col("q")[0]
    return r.select(F.col("q")[1].alias("loc"), F.when(iqr > 1e-12, iqr).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("scale"))


def tail_surprisal(queries: DataFrame, reference: DataFrame, col: str, ref: str, out: str) -> DataFrame:
    """``queries`` with ``out``: -ln((1 + #{ref >= x})/(n + 1)) + ln(1 + max(0, x - max ref)/IQR).

    The counts come from one running sum over distinct values, in ranges, so that neither side is compared
    with the other: values are binned by a range partitioning of the distinct values, and a bin starts with
    the total of the bins above it.
    """
    values = queries.select(F.col(col).alias("v"), F.lit(0).alias("r")).union(reference.select(F.col(ref).alias("v"), F.lit(1).alias("r"))).groupBy("v").agg(F.sum("r").cast("long").alias("r"))
    cuts = values.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    binned = values.join(F.broadcast(cuts)).select("v", "r", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("bin"))
    totals = binned.groupBy("bin").agg(F.sum("r").alias("n"))
    base = totals.select("bin", (F.sum("n").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    ge = binned.join(F.broadcast(base), "bin").select("v", (F.col("base") + F.sum("r").over(W.partitionBy("bin").orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, 0))).alias("ge"))
    one = robust(reference, ref).join(reference.agg(F.count(ref).alias("n"), F.max(ref).alias("top")))
    d = queries.join(ge, queries[col] == ge["v"], "left").drop("v").join(F.broadcast(one))
    s = -F.log((1.0 + F.col("ge")) / (F.col("n") + 1.0)) + F.log1p(F.greatest(F.lit(0.0), F.col(col) - F.col("top")) / F.col("scale"))
    return d.select(*queries.columns, s.alias(out))


def autocorrelation(points: DataFrame, max_lag: int) -> DataFrame:
    """(series, lag, acf) up to min(max_lag, n/2 - 1): sums of lagged products over the sum of squares, not corrected for overlap. Lags are frames of the ordered series, in one pass."""
    w = W.partitionBy("series").orderBy("t")
    d = points.withColumn("x", F.col("value") - F.avg("value").over(W.partitionBy("series"))).select("series", "t", "x")
    prods = d.select("series", "x", *[(F.col("x") * F.lead("x", k).over(w)).alias(f"p{k}") for k in range(1, max_lag + 1)])
    g = prods.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("ss"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, max_lag + 1)])
    each = F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(F.col(f"p{k}"), F.lit(0.0)) / F.col("ss")).alias("acf")) for k in range(1, max_lag + 1)])
    return g.where("ss > 1e-12").select("series", "n", F.inline(each)).where(F.col("lag") < F.floor(F.col("n") / 2)).select("series", "lag", "acf")


def periods(acf: DataFrame, least: float = 0.3) -> DataFrame:
    """(series, period): the first peak after the first negative autocorrelation, if it is ``least`` or more."""
    w = W.partitionBy("series").orderBy("lag")
    d = acf.withColumn("prev", F.lag("acf").over(w)).withColumn("next", F.lead("acf").over(w)).withColumn("neg", F.max((F.col("acf") < 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    peak = d.where("neg = 1 and acf > 0 and acf >= prev and acf >= next").groupBy("series").agg(F.min(F.struct("lag", "acf")).alias("p"))
    return peak.where(F.col("p.acf") >= least).select("series", F.col("p.lag").alias("period"))


def top_events(scores: DataFrame, n: int, separation: int) -> DataFrame:
    """(series, rank, t, score): greedy peaks at least ``separation`` apart. Each round takes one argmax a series, so a series is never gathered."""
    rest, out = scores.select("series", "t", "score"), None
    for k in range(1, n + 1):
        top = rest.groupBy("series").agg(F.min(F.struct((-F.col("score")).alias("m"), F.col("t").alias("at"))).alias("b")).select("series", F.lit(k).alias("rank"), F.col("b.at").alias("at"), (-F.col("b.m")).alias("top"))
        out = top if out is None else out.union(top)
        rest = rest.join(top.select("series", "at"), "series").where(F.abs(F.col("t") - F.col("at")) >= separation).drop("at")
    return out.select("series", "rank", F.col("at").alias("t"), F.col("top").alias("score"))


def explain_points(at: DataFrame, nov: DataFrame, window: int) -> DataFrame:
    """For each (series, at) the covering window of largest novelty, first on ties: start, end, word, count, nearest, distance, novelty. Starts are generated, so the range join is an equality join."""
    starts = at.select("series", F.col("t").alias("at"), F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("t") - (window - 1)), F.col("t"))).alias("t"))
    d = starts.join(nov, ["series", "t"])
    b = d.groupBy("series", "at").agg(F.min(F.struct((-F.col("novelty")).alias("m"), F.col("t").alias("start"), "word", "cnt", "nearest", "distance")).alias("b"))
    return b.select("series", "at", "b.start", (F.col("b.start") + window).alias("end"), "b.word", F.col("b.cnt").alias("train_count"), "b.nearest", "b.distance", (-F.col("b.m")).alias("novelty"))


def choose_window(setting: int | str, period: int | None, low: int = 8, high: int = 128, fallback: int = 24) -> int:
    """A fixed window, or 'auto': the training period within bounds, else the fallback."""
    if setting != "auto":
        return int(setting)
    return fallback if period is None else int(min(high, max(low, period)))

