"""Rules from symbolic events: n-gram tokens, contrast rules, continuation rules, residual rules, class priors.

Events are (sample, token), distinct; rules are small tables that samples meet in a join on the token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import quantile_row


def ordered_words(symbols: DataFrame, sample: str = "sample", channel: str = "channel") -> DataFrame:
    """(sample, channel, word array): the ordered symbols of each context from (sample, channel, segment, symbol)."""
    g = symbols.groupBy(sample, channel).agg(F.array_sort(F.collect_list(F.struct("segment", "symbol"))).alias("x"))
    return g.select(sample, channel, F.transform("x", lambda e: e["symbol"].cast("string")).alias("w"))


def token(channel: str | Column, place: Column, gram: Column) -> Column:
    return F.concat(F.lit("ch="), (F.col(channel) if isinstance(channel, str) else channel).cast("string"), F.lit("|loc="), place, F.lit("|sax="), F.array_join(gram, "."))


def three_grams(words: DataFrame, n: int = 3, sample: str = "sample", channel: str = "channel") -> DataFrame:
    """(sample, token): n-grams that end at n, at half the length plus n, and at the end, cut to the length; equal places merge."""
    size = F.size("w")
    ends = F.array(F.least(F.lit(n), size), F.least(F.floor(size / 2).cast("int") + n, size), size)
    d = words.select(sample, channel, "w", F.posexplode(ends).alias("k", "end"))
    place = F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), F.col("k") + 1)
    return d.select(sample, token(channel, place, F.slice("w", F.greatest(F.lit(1), F.col("end") - n + 1), F.least(F.lit(n), F.col("end")))).alias("token")).distinct()


def all_grams(words: DataFrame, n: int = 3, sample: str = "sample", channel: str = "channel") -> DataFrame:
    """(sample, token): n-grams at every offset from the end, 'recent' if the offset is less than n, else 'context'."""
    d = words.where(F.size("w") >= n).select(sample, channel, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("start"))
    offset = F.size("w") - n - F.col("start")
    return d.select(sample, token(channel, F.when(offset < n, "recent").otherwise("context"), F.slice("w", F.col("start") + 1, n)).alias("token")).distinct()


def activation_thresholds(features: DataFrame, q: float = 0.75) -> DataFrame:
    """(code, threshold): quantile of presence + frequency - distance of standardised training features by word."""
    return features.groupBy("code").agg(F.percentile(F.col("presence") + F.col("frequency") - F.col("distance"), q).alias("threshold"))


def miner_events(features: DataFrame, thresholds: DataFrame, top: int = 2, sample: str = "series") -> DataFrame:
    """(sample, token): of the ``top`` words of largest activation in a sample, those at or above their threshold."""
    a = features.withColumn("a", F.col("presence") + F.col("frequency") - F.col("distance"))
    w = W.partitionBy(sample).orderBy(F.desc(F.round("a", 9)), "code")
    a = a.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).join(thresholds, "code").where("a >= threshold")
    return a.select(sample, F.concat(F.lit("miner_word="), F.col("code").cast("string"), F.lit("|active")).alias("token"))


def contrast_rules(events: DataFrame, targets: DataFrame, support: int = 4, confidence: float = 0.55, growth: float = 1.25, shrink: float = 8.0, sample: str = "sample") -> DataFrame:
    """(token, support, confidence, growth, score) of tokens that favour target 1: growth = ((pos+.5)/(P+1)) / ((neg+.5)/(N+1))."""
    total = targets.agg(F.sum("y").alias("P"), F.sum(1 - F.col("y")).alias("N"))
    g = events.join(targets, sample).groupBy("token").agg(F.sum("y").alias("pos"), F.count("*").alias("support")).join(F.broadcast(total))
    gr = ((F.col("pos") + 0.5) / (F.col("P") + 1)) / ((F.col("support") - F.col("pos") + 0.5) / (F.col("N") + 1))
    r = g.select("token", "support", (F.col("pos") / F.col("support")).alias("confidence"), gr.alias("growth"))
    r = r.where((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("growth") >= growth))
    return r.withColumn("score", F.col("confidence") * F.log("growth") * F.col("support") / (F.col("support") + shrink))


def rule_scores(samples: DataFrame, events: DataFrame, rules: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, score): the best matched rule's score, 0 without a match."""
    hit = events.join(F.broadcast(rules.select("token", F.col("score").alias("s"))), "token").groupBy(sample).agg(F.max("s").alias("s"))
    return samples.select(sample).join(hit, sample, "left").select(sample, F.coalesce("s", F.lit(0.0)).alias("score"))


def continuation_rules(events: DataFrame, states: DataFrame, support: int = 8, confidence: float = 0.2, lift: float = 1.05, sample: str = "sample") -> DataFrame:
    """(token, state, support, confidence, lift): how much likelier a future state is after a token than by itself."""
    n = states.agg(F.count("*").alias("n"))
    prior = states.groupBy("state").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("state", (F.col("c") / F.col("n")).alias("prior"))
    d = events.join(states, sample).groupBy("token", "state").agg(F.count("*").alias("hits"))
    d = d.withColumn("support", F.sum("hits").over(W.partitionBy("token"))).join(F.broadcast(prior), "state")
    d = d.select("token", "state", "support", (F.col("hits") / F.col("support")).alias("confidence"), (F.col("hits") / F.col("support") / F.col("prior")).alias("lift"))
    return d.where((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def rule_forecast(samples: DataFrame, events: DataFrame, rules: DataFrame, centres: DataFrame, shrink: float = 12.0, top: int = 8, sample: str = "sample") -> DataFrame:
    """(sample, h, forecast, reliability): centres (state, h, level) weighted by the scores of the ``top`` matched rules; reliability is the best score, at most 1."""
    r = rules.withColumn("score", F.col("confidence") * F.log(F.greatest("lift", F.lit(1.0))) * F.col("support") / (F.col("support") + shrink)).where("score > 0")
    w = W.partitionBy(sample).orderBy(F.desc(F.round("score", 9)), "token", "state")
    m = events.join(F.broadcast(r.select("token", "state", "score")), "token").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    f = m.join(F.broadcast(centres), "state").groupBy(sample, "h").agg((F.sum(F.col("score") * F.col("level")) / F.sum("score")).alias("forecast"), F.least(F.max("score"), F.lit(1.0)).alias("reliability"))
    return f


def residual_rules(events: DataFrame, residuals: DataFrame, support: int = 32, shrink: float = 24.0, sample: str = "sample") -> DataFrame:
    """(token, h, residual, support, score): mean residual of each token less the global mean; effect is its RMS over the RMS of all residuals."""
    base = residuals.groupBy("h").agg(F.avg("residual").alias("base"))
    rms = residuals.join(F.broadcast(base), "h").agg(F.sqrt(F.avg((F.col("residual") - F.col("base")) ** 2)).alias("rms"))
    m = events.join(residuals, sample).groupBy("token", "h").agg(F.avg("residual").alias("residual"), F.count("*").alias("support")).where(F.col("support") >= support).join(F.broadcast(base), "h")
    e = m.groupBy("token").agg(F.sqrt(F.avg((F.col("residual") - F.col("base")) ** 2)).alias("own"), F.max("support").alias("n")).join(F.broadcast(rms))
    e = e.select("token", (F.col("own") / F.greatest("rms", F.lit(1e-12)) * F.col("n") / (F.col("n") + shrink)).alias("score"))
    return m.join(e, "token").select("token", "h", "residual", "support", "score")


def residual_reference(events: DataFrame, rules: DataFrame, top: int = 8, descending_tokens: bool = True, sample: str = "sample") -> DataFrame:
    """(sample, h, correction): residuals of the ``top`` matched rules weighted by score; ties by token, descending for horizons and ascending for classes."""
    heads = rules.select("token", "score").distinct()
    w = W.partitionBy(sample).orderBy(F.desc(F.round("score", 9)), F.desc("token") if descending_tokens else F.asc("token"))
    m = events.join(F.broadcast(heads), "token").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select(sample, "token")
    return m.join(rules, "token").groupBy(sample, "h").agg((F.sum(F.col("score") * F.col("residual")) / F.sum("score")).alias("correction"))


def class_prior_rules(events: DataFrame, targets: DataFrame, classes: list, support: int = 4, shrink: float = 8.0, sample: str = "sample") -> DataFrame:
    """(token, label, shift, support, strength): ln((count+1)/(support+C)) - ln((class count+1)/(rows+C)) for every class; strength is the RMS of the shifts, shrunk."""
    k = len(classes)
    n = targets.agg(F.count("*").alias("n"))
    prior = targets.groupBy("label").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("label", F.log((F.col("c") + 1.0) / (F.col("n") + k)).alias("lp"))
    counts = events.join(targets, sample).groupBy("token").agg(F.count("*").alias("support"), *[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)]).where(F.col("support") >= support)
    long = counts.select("token", "support", F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"c{i}").alias("count")) for i, c in enumerate(classes)])))
    s = long.join(F.broadcast(prior), "label").withColumn("shift", F.log((F.col("count") + 1.0) / (F.col("support") + k)) - F.col("lp"))
    rms = F.sqrt(F.avg(F.col("shift") * F.col("shift")).over(W.partitionBy("token")))
    return s.select("token", "label", "shift", "support", (rms * F.col("support") / (F.col("support") + shrink)).alias("strength"))


def log_residual(p: Column, y: Column, classes: int, smoothing: float = 0.05, clip: float = 4.0) -> Column:
    """ln of the smoothed target less ln of the probability, clipped; y is 1 for the true class."""
    q = y * (1 - smoothing) + smoothing / classes
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), F.log(q) - F.log(p + 1e-12)))


def choose_weight(cells: DataFrame, weights: tuple[float, ...], tolerance: float = 0.01) -> DataFrame:
    """(weight, mse, mae, allowed, chosen) of base + weight x correction from (y, base, correction): least MSE with MAE <= base x (1 + tolerance), strictly below the base; ties to the smaller weight.

    One aggregation with a pair of sums a weight, so cells are read once and never multiplied by the grid.
    """
    e = [F.col("base") + F.lit(w) * F.col("correction") - F.col("y") for w in weights]
    row = cells.agg(*[F.avg(x * x).alias(f"s{i}") for i, x in enumerate(e)], *[F.avg(F.abs(x)).alias(f"a{i}") for i, x in enumerate(e)], F.avg((F.col("base") - F.col("y")) ** 2).alias("s"), F.avg(F.abs(F.col("base") - F.col("y"))).alias("a"))
    grid = row.select("s", "a", F.inline(F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"s{i}").alias("mse"), F.col(f"a{i}").alias("mae")) for i, w in enumerate(weights)])))
    grid = grid.withColumn("allowed", (F.col("mae") <= F.col("a") * (1 + tolerance)) & ((F.col("mse") < F.col("s")) | (F.col("weight") == 0)))
    w = W.orderBy(F.when(F.col("allowed"), 0).otherwise(1), F.round("mse", 9), "weight")
    return grid.withColumn("chosen", F.col("allowed") & (F.row_number().over(w) == 1)).select("weight", "mse", "mae", "allowed", "chosen")


def blocked(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Events without some tokens, for counterfactuals."""
    return events.join(F.broadcast(tokens.select("token")), "token", "left_anti")


def match_regions(tokens: DataFrame, length: int) -> DataFrame:
    """``tokens`` with channel, place and the coarse span [start, end) of the context that a token speaks of: thirds by place."""
    place = F.regexp_extract("token", r"loc=(\w+)", 1)
    third = F.when(place == "early", 0).when(place == "middle", 1).when(place.isin("late", "recent"), 2)
    d = tokens.withColumn("channel", F.regexp_extract("token", r"ch=([^|]*)", 1)).withColumn("place", place)
    return d.withColumn("start", F.coalesce(F.floor(third * length / 3), F.lit(0)).cast("long")).withColumn("end", F.coalesce(F.floor((third + 1) * length / 3), F.lit(length)).cast("long"))


def behaviour_targets(rows: DataFrame, col: str, q: float) -> DataFrame:
    """``rows`` with y: 1 where ``col`` reaches its quantile q."""
    cut = quantile_row(rows, col, [q], "_cut")
    return rows.join(F.broadcast(cut)).withColumn("y", (F.col(col) >= F.col("_cut")[0]).cast("int")).drop("_cut")
