"""Series views of the test tables, windows over long series, splits, folds and blocks.

A series is long: (series, t, value, ...), one row a point; windows are frames over it and are never stored.
Where a table holds whole short series, such as vectors, they may stay packed: (series, values, ...), one row a
series with its points in order from t = 0. Words and windows are then arithmetic on places of that array, without
a sort or a shuffle of points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.symbols import FLAT, breakpoints, code, fourier_rows, hash_order, paa_weights, symbol, word
from .ordering import close_quantiles, fixed, quantile_row

#: Packed series that one task takes.
PACKED_ROWS = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, t, value, label): events by user in time order; label 1 is an error event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("t"), "value", (F.col("event_type") == "error").cast("int").alias("label"))


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, t, value, label): embeddings as series of 64 points with a class."""
    e = read(spark, sf_dir, "embeddings")
    e = e.select(F.col("vec_id").alias("series"), "label", F.posexplode("embedding").alias("t", "value"))
    return e.select("series", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"), "label")


def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, label, values): embeddings as packed series of 64 points with a class."""
    e = read(spark, sf_dir, "embeddings")
    return dealt(e.select(F.col("vec_id").alias("series"), "label", F.col("embedding").cast("array<double>").alias("values")))


def packed(points: DataFrame) -> bool:
    return "values" in points.columns


def dealt(series: DataFrame) -> DataFrame:
    """Packed series dealt by series to tasks counted by rows and kept: what is grouped by series later is where it belongs, and a task is as large on a large table as on a small one."""
    return series.repartition(-(-max(1, series.count()) // PACKED_ROWS), "series").cache()


def packed_windows(points: DataFrame, window: int, step: int, carry: tuple[str, ...]) -> DataFrame:
    """(series, t, carry, x0..x(w-1), mean, sd) of every whole window of packed series; one with a null is not whole."""
    starts = F.when(F.size("values") >= window, F.sequence(F.lit(0), F.size("values") - window, F.lit(step)))
    d = points.select("series", *carry, "values", F.explode(starts).alias("t"))
    d = d.select("series", F.col("t").cast("long").alias("t"), *carry, *[F.get("values", F.col("t") + i).alias(f"x{i}") for i in range(window)])
    x = [F.col(f"x{i}") for i in range(window)]
    d = d.where(" and ".join(f"x{i} is not null" for i in range(window)))
    d = d.withColumn("mean", sum(x[1:], x[0]) / F.lit(float(window)))
    gap = [(v - F.col("mean")) * (v - F.col("mean")) for v in x]
    return d.withColumn("sd", F.sqrt(sum(gap[1:], gap[0]) / F.lit(float(window))))


def made(df: DataFrame, keep: tuple[str, ...], cols: dict[str, Column]) -> DataFrame:
    """``keep`` and ``cols`` of ``df``, through a generator of one row: a later condition on ``cols`` is asked of the result and not written out over its whole arithmetic."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, t, value): order totals by priority and day, with a row for every day."""
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("channel"), "o_totalprice")
    sums = o.groupBy("channel", "day").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    ends = o.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("a", F.explode(F.sequence("a", "b")).alias("day")).select("day", F.datediff("day", "a").cast("long").alias("t"))
    spine = days.join(F.broadcast(o.select("channel").distinct()))
    return spine.join(sums, ["channel", "day"], "left").select("channel", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def sliding(points: DataFrame, window: int, keys: tuple[str, ...] = ("series",), step: int = 1) -> tuple[DataFrame, W]:
    """``points`` with n, mean and sd of the window that starts at each t, and the ordered window spec; short windows are left out by ``complete``."""
    spec = W.partitionBy(*keys).orderBy("t")
    frame = spec.rowsBetween(0, window - 1)
    out = points.select("*", F.count("value").over(frame).alias("n"), F.avg("value").over(frame).alias("mean"), F.stddev_pop("value").over(frame).alias("sd"))
    return out, spec


def over_blocks(points: DataFrame, window: int, block: int, make: Callable[[DataFrame], DataFrame], back: bool = False) -> DataFrame:
    """What ``make`` gives for series of any length, from blocks of ``block`` points instead of whole series.

    Each block gets copies of the window - 1 points after it (before it if ``back``), so every window of its own
    points is whole inside it. ``make`` takes and returns rows with series and t and looks no further than that;
    its ``series`` stands for one block. What it gives for copied points is dropped.
    """
    own = F.floor(F.col("t") / block)
    inside = F.col("t") % block
    other = F.when(inside >= block - (window - 1), own + 1) if back else F.when(inside < window - 1, own - 1)
    if block < window:
        raise ValueError("a block must hold a window")
    d = points.withColumn("_block", F.explode(F.array_compact(F.array(own, other)))).withColumn("series", F.struct("series", "_block")).drop("_block")
    out = make(d)
    out = out.where(F.floor(F.col("t") / block) == F.col("series")["_block"])
    return out.withColumn("series", F.col("series")["series"])


def complete(df: DataFrame, window: int, step: int = 1) -> DataFrame:
    return df.where((F.col("n") == window) & (F.col("t") % step == 0))


def segment_means(value: str, window: int, segments: int, spec: W) -> list[Column]:
    """PAA of the window that starts at each row: frame averages where segments are whole, weighted leads otherwise."""
    if window % segments == 0:
        k = window // segments
        return [F.avg(value).over(spec.rowsBetween(j * k, (j + 1) * k - 1)) for j in range(segments)]
    out = []
    for share in paa_weights(window, segments):
        terms = [F.lead(value, i).over(spec) * F.lit(wt) if i else F.col(value) * F.lit(wt) for i, wt in share]
        out.append(sum(terms[1:], terms[0]))
    return out


def packed_means(window: int, segments: int) -> list[Column]:
    """PAA of packed windows x0..x(w-1)."""
    if window % segments == 0:
        k = window // segments
        return [sum([F.col(f"x{i}") for i in range(j * k + 1, (j + 1) * k)], F.col(f"x{j * k}")) / F.lit(float(k)) for j in range(segments)]
    terms = [[F.col(f"x{i}") * F.lit(wt) for i, wt in share] for share in paa_weights(window, segments)]
    return [sum(t[1:], t[0]) for t in terms]


def sax_words(points: DataFrame, window: int = 24, word_len: int = 8, alphabet: int = 4, step: int = 1, keys: tuple[str, ...] = ("series",), flat_std: float = FLAT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each window's keys, t, flat, s0..s(L-1), word and code. Flat windows are all middle symbols.

    The PAA of a z-normalised window is (segment mean - window mean) / sd, so no window is materialised:
    one sort by (keys, t), then moving averages. ``points`` may be packed if the series is their only key.
    """
    if packed(points):
        df = packed_windows(points, window, step, carry)
        df = df.select(*keys, "t", "mean", "sd", *carry, *[m.alias(f"m{j}") for j, m in enumerate(packed_means(window, word_len))])
    else:
        df, spec = sliding(points, window, keys)
        seg = [m.alias(f"m{j}") for j, m in enumerate(segment_means("value", window, word_len, spec))]
        df = complete(df.select(*keys, "t", "n", "mean", "sd", *carry, *seg), window, step)
    edges = breakpoints(alphabet)
    flat = F.col("sd") < flat_std
    cols = {"flat": flat} | {f"s{j}": symbol(F.when(flat, F.lit(0.0)).otherwise((F.col(f"m{j}") - F.col("mean")) / F.col("sd")), edges) for j in range(word_len)}
    df = made(df, (*keys, "t", *carry), cols) if packed(points) else df.select(*keys, "t", *carry, *[c.alias(n) for n, c in cols.items()])
    s = [F.col(f"s{j}") for j in range(word_len)]
    return df.withColumn("word", word(s)).withColumn("code", code(s, alphabet))


def fourier_windows(points: DataFrame, window: int = 8, n: int = 4, step: int = 1, keys: tuple[str, ...] = ("series",), znorm: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each window's keys, t, flat and first Fourier coefficients c0..c(n-1) after z-normalisation (or centring only). ``points`` may be packed."""
    if packed(points):
        df = packed_windows(points, window, step, carry)
    else:
        df, spec = sliding(points, window, keys)
        leads = [F.lead("value", i).over(spec).alias(f"x{i}") if i else F.col("value").alias("x0") for i in range(window)]
        df = complete(df.select(*keys, "t", "n", "mean", "sd", *carry, *leads), window, step)
    flat = F.col("sd") < FLAT
    rows = fourier_rows(window, n)
    z = [(F.col(f"x{i}") - F.col("mean")) / (F.col("sd") if znorm else F.lit(1.0)) for i in range(window)]
    dot = lambda r: sum([z[i] * F.lit(r[i]) for i in range(1, window)], z[0] * F.lit(r[0]))
    cols = {"flat": flat} | {f"c{k}": F.when(flat & F.lit(znorm), F.lit(0.0)).otherwise(dot(r)) for k, r in enumerate(rows)}
    return made(df, (*keys, "t", *carry), cols) if packed(points) else df.select(*keys, "t", *carry, *[c.alias(n) for n, c in cols.items()])


def sfa_edges(coefs: DataFrame, n: int = 4, alphabet: int = 4) -> DataFrame:
    """(position, q, edge): multiple coefficient binning, exact quantiles i/alphabet of each coefficient over all windows."""
    at = [i / alphabet for i in range(1, alphabet)]
    return close_quantiles(coefs, [f"c{k}" for k in range(n)], at).select(F.col("k").alias("position"), F.col("i").alias("q"), F.col("value").alias("edge"))


def sfa_words(coefs: DataFrame, edges: DataFrame, n: int = 4, alphabet: int = 4, keys: tuple[str, ...] = ("series",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of Fourier windows under fitted edges; the edges are (alphabet - 1) x n numbers, one broadcast row."""
    row = edges.groupBy().agg(*[F.max(F.when((F.col("position") == k) & (F.col("q") == q), F.col("edge"))).alias(f"e{k}_{q}") for k in range(n) for q in range(alphabet - 1)])
    df = coefs.join(F.broadcast(row))
    df = df.select(*keys, "t", *carry, "flat", *[symbol(F.col(f"c{k}"), [F.col(f"e{k}_{q}") for q in range(alphabet - 1)]).alias(f"s{k}") for k in range(n)])
    s = [F.col(f"s{k}") for k in range(n)]
    return df.withColumn("word", word(s)).withColumn("code", code(s, alphabet))


def sfa_zero_code(edges: DataFrame, alphabet: int = 4) -> int:
    """The code of the zero vector, to which windows without variance map, under fitted edges: one number."""
    up = edges.groupBy("position").agg(F.count_if(F.col("edge") <= 0).alias("s"))
    return sum(s * alphabet ** (n - 1 - k) for k, s, n in up.join(edges.agg((F.max("position") + 1).alias("n"))).select("position", "s", "n").collect())


def fitted_sfa_words(coefs: DataFrame, n: int = 4, alphabet: int = 4, keys: tuple[str, ...] = ("series",), carry: tuple[str, ...] = (), keep: bool = True) -> tuple[DataFrame, int]:
    """(words, zero code) under edges fitted on the same windows: edges and words are made once, whoever reads them, and so are coefficients unless, as those of packed series, they are cheaper made than kept."""
    coefs = coefs.cache() if keep else coefs
    edges = fixed(sfa_edges(coefs, n, alphabet))  # n x (alphabet - 1) numbers
    return sfa_words(coefs, edges, n, alphabet, keys, carry).cache(), sfa_zero_code(edges, alphabet)


def whole_paa(points: DataFrame, length: int, segments: int, keys: tuple[str, ...] = ("series",), name: str = "value") -> DataFrame:
    """(keys, segment, level): PAA of whole series of ``length`` points by a join with the weights, a table of about length + segments rows."""
    spark = points.sparkSession
    rows = [(i, j, wt) for j, share in enumerate(paa_weights(length, segments)) for i, wt in share]
    weights = spark.createDataFrame(rows, "t long, segment int, weight double")
    return points.join(F.broadcast(weights), "t").groupBy(*keys, "segment").agg(F.sum(F.col(name) * F.col("weight")).alias("level"))


def context_key(points: DataFrame, length: int, segments: int = 24, alphabet: int = 4, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, segment, symbol): SAX symbols of the whole context in order."""
    stats = points.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    level = whole_paa(points, length, segments, keys).join(stats, list(keys))
    z = F.when(F.col("sd") < FLAT, F.lit(0.0)).otherwise((F.col("level") - F.col("mean")) / F.col("sd"))
    return level.select(*keys, "segment", symbol(z, breakpoints(alphabet)).alias("symbol"))


def state_key(points: DataFrame, length: int, recent: int = 24, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, last, mean, sd, change, recent_shift, slope) of whole contexts; slope on t from -1 to 1."""
    x = (F.col("t") * 2.0 / (length - 1)) - 1.0
    d = points.withColumn("x", x)
    return d.groupBy(*keys).agg(
        F.max_by("value", "t").alias("last"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), (F.max_by("value", "t") - F.min_by("value", "t")).alias("change"),
        (F.avg(F.when(F.col("t") >= length - recent, F.col("value"))) - F.avg("value")).alias("recent_shift"), (F.avg(F.col("x") * F.col("value")) / F.avg(F.col("x") * F.col("x"))).alias("slope"),
    )


#: Names of ``summary_statistics`` in order.
STATISTICS = ("mean", "sd", "least", "most", "last", "slope", "mean_step", "late_shift")


def statistics_of(x: np.ndarray) -> np.ndarray:
    """``summary_statistics`` of a batch of packed series of one length: (rows, channels, points) to (rows, channels x 8)."""
    x = np.nan_to_num(x)
    n = x.shape[2]
    t, mean = np.arange(n) - (n - 1) / 2.0, x.mean(2)
    each = [mean, x.std(2), x.min(2), x.max(2), x[:, :, -1], x @ t / (t @ t), np.abs(np.diff(x)).mean(2), x[:, :, n - n // 4 :].mean(2) - mean]
    return np.stack(each, 2).reshape(len(x), -1)


def summary_statistics(points: DataFrame, length: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Mean, sd, min, max, last, least-squares slope, mean absolute step and last-quarter shift; NaN counts as 0."""
    v = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    d = points.withColumn("value", v)
    d = d.withColumn("step", F.abs(F.col("value") - F.lag("value").over(W.partitionBy(*keys).orderBy("t")))).withColumn("x", F.col("t") - (length - 1) / 2.0)
    return d.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", "t").alias("last"),
        (F.sum(F.col("x") * F.col("value")) / F.sum(F.col("x") * F.col("x"))).alias("slope"), F.avg("step").alias("mean_step"), (F.avg(F.when(F.col("t") >= length - length // 4, F.col("value"))) - F.avg("value")).alias("late_shift"),
    )


def volatility(points: DataFrame, length: int, sample: tuple[str, ...] = (), channel: str = "channel") -> DataFrame:
    """Standard deviation of the last quarter, averaged over channels."""
    late = points.where(F.col("t") >= length - max(1, length // 4)).groupBy(*sample, channel).agg(F.stddev_pop("value").alias("sd"))
    return late.groupBy(*sample).agg(F.avg("sd").alias("volatility"))


def tile_starts(lengths: DataFrame, window: int, stride: int) -> DataFrame:
    """(series, start): tiling starts, one more window at the end if the stride misses it, and one left-padded window (start below 0) for a short series."""
    n = F.col("length")
    starts = F.when(n < window, F.array((n - window).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), n - window, F.lit(stride).cast("long")), F.array(n - window))))
    return lengths.select("series", "length", F.explode(starts).alias("start"))


def tiled_windows(points: DataFrame, window: int, stride: int) -> DataFrame:
    """(series, start, i, t, value, label): tiled windows point by point; padding repeats the first value and has label -1."""
    lengths = points.groupBy("series").agg(F.count("*").alias("length"))
    cells = tile_starts(lengths, window, stride).select("series", "start", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("i"))
    cells = cells.withColumn("t", F.greatest(F.col("start") + F.col("i"), F.lit(0)))
    return cells.join(points, ["series", "t"]).select("series", "start", "i", "t", "value", F.when(F.col("start") + F.col("i") < 0, -1).otherwise(F.col("label")).alias("label"))


def assemble(cells: DataFrame, lengths: DataFrame, score: str = "score") -> DataFrame:
    """(series, t, score): window scores back on points; the later window overwrites, padding is dropped, uncovered points are 0."""
    real = cells.where(F.col("start") + F.col("i") >= 0).groupBy("series", "t").agg(F.max_by(score, "start").alias("score"))
    grid = lengths.select("series", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("t"))
    return grid.join(real, ["series", "t"], "left").select("series", "t", F.coalesce("score", F.lit(0.0)).alias("score"))


def even_subset(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows evenly spaced by rank, ends included, halves to even."""
    ranked = rows.withColumn("rank", F.row_number().over(W.orderBy(order)) - 1)
    n = rows.agg(F.count("*").alias("n"))
    want = n.select(F.explode(F.when(F.col("n") <= most, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(max(1, most - 1)))).cast("long")))).alias("rank")).distinct()
    return ranked.join(want, "rank").drop("rank")


def future_direction(points: DataFrame, context: int, horizon: int, keys: tuple[str, ...] = ("channel",), recent: int = 24) -> DataFrame:
    """(keys, t, delta, direction): change of the mean from the end of a context to its future in units of the context's sd, cut at pooled tertiles."""
    spec = W.partitionBy(*keys).orderBy("t")
    now, late, future = spec.rowsBetween(0, context - 1), spec.rowsBetween(context - min(recent, context), context - 1), spec.rowsBetween(context, context + horizon - 1)
    d = points.select(*keys, "t", F.count("value").over(future).alias("n"), ((F.avg("value").over(future) - F.avg("value").over(late)) / (F.stddev_pop("value").over(now) + 1e-8)).alias("delta")).where(F.col("n") == horizon).drop("n")
    cut = quantile_row(d, "delta", [1 / 3, 2 / 3], "cut")
    return d.join(F.broadcast(cut)).select(*keys, "t", "delta", symbol(F.col("delta"), [F.col("cut")[0], F.col("cut")[1]]).alias("direction"))


def resolve_window(window: float, length: int, least: int = 4) -> int:
    """A window of at most 1 is a share of the length; the result lies between ``least`` and the length."""
    w = round(window * length) if isinstance(window, float) and window <= 1 else int(window)
    return int(min(length, max(least, w)))


def stratified_split(rows: DataFrame, key: str, label: str, share: float, seed: int = 0) -> DataFrame:
    """``rows`` with split = 'val' for round(share x class size) rows of each class in hash order, 'train' for the rest."""
    w = W.partitionBy(label)
    d = rows.withColumn("_r", F.row_number().over(w.orderBy(hash_order(key, seed), key))).withColumn("_n", F.count("*").over(w))
    return d.withColumn("split", F.when(F.col("_r") <= F.bround(F.col("_n") * F.lit(share)), "val").otherwise("train")).drop("_r", "_n")


def stratified_sample(rows: DataFrame, key: str, label: str, most: int, seed: int = 0) -> DataFrame:
    """At most about ``most`` rows: max(1, round(most x class share)) of each class in hash order; all if there are no more."""
    w = W.partitionBy(label)
    d = rows.withColumn("_r", F.row_number().over(w.orderBy(hash_order(key, seed), key))).withColumn("_c", F.count("*").over(w))
    total = rows.agg(F.count("*").alias("_n"))
    d = d.join(F.broadcast(total))
    return d.where((F.col("_n") <= most) | (F.col("_r") <= F.greatest(F.lit(1), F.bround(F.lit(float(most)) * F.col("_c") / F.col("_n"))))).drop("_r", "_c", "_n")


def oof_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """``rows`` with fold from 0: each class in hash order is cut in min(folds, smallest class) consecutive parts."""
    least = rows.groupBy(label).count().agg(F.min("count").alias("_m"))
    w = W.partitionBy(label)
    d = rows.withColumn("_r", F.row_number().over(w.orderBy(hash_order(key, seed), key)) - 1).withColumn("_n", F.count("*").over(w)).join(F.broadcast(least))
    k = F.least(F.col("_m"), F.lit(folds))
    big, size = F.col("_n") % k, F.floor(F.col("_n") / k)
    fold = F.when(F.col("_r") < big * (size + 1), F.floor(F.col("_r") / (size + 1))).otherwise(big + F.floor((F.col("_r") - big * (size + 1)) / size))
    return d.withColumn("fold", fold.cast("int")).drop("_r", "_n", "_m")


def time_blocks(n_rows: int, horizon: int, holdout: float = 0.2, shadow: float = 0.1) -> dict[str, tuple[int, int]]:
    """Row ranges train, shadow and residual in time order, each ``horizon`` rows apart; the last is the holdout."""
    residual = n_rows - round(n_rows * holdout)
    left = residual - horizon
    start = left - round(n_rows * shadow)
    return {"train": (0, max(0, start - horizon)), "shadow": (max(0, start), max(0, left)), "residual": (residual, n_rows)}


def model_input(points: DataFrame, length: int, seq_len: int, policy: str = "truncate") -> DataFrame:
    """(series, i, value, mask) of fixed length: zeros on the left for short series; long ones truncated to their end or resampled linearly; NaN is 0."""
    v = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    d = points.select("series", "t", v.alias("value"))
    if length > seq_len and policy == "resample":
        at = F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda i: i * F.lit((length - 1) / (seq_len - 1)))
        grid = d.select("series").distinct().select("series", F.posexplode(at).alias("i", "p")).withColumn("lo", F.floor("p")).withColumn("hi", F.least(F.col("lo") + 1, F.lit(length - 1)))
        lo, hi = d.select("series", F.col("t").alias("lo"), F.col("value").alias("a")), d.select("series", F.col("t").alias("hi"), F.col("value").alias("b"))
        return grid.join(lo, ["series", "lo"]).join(hi, ["series", "hi"]).select("series", "i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.col("lo"))).alias("value"), F.lit(1).alias("mask"))
    shift = seq_len - length
    real = d.where(F.col("t") + shift >= 0).select("series", (F.col("t") + shift).cast("int").alias("i"), "value", F.lit(1).alias("mask"))
    if shift <= 0:
        return real
    pad = d.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(shift - 1))).alias("i"), F.lit(0.0).alias("value"), F.lit(0).alias("mask"))
    return real.unionByName(pad)
