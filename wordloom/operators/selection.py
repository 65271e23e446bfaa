"""Rules that correct a frozen model, chosen on validation rows beside controls, and what their removal changes.

A variant is a value of ``mode``: ``own`` takes all events, ``sax`` none of the miner's, ``permuted`` all events with
targets dealt to other samples, ``global`` no event at all. Modes are keys, so all variants are fitted, matched and
scored in the same shuffles. Corrections are long: (mode, sample, h, correction), h a class or a step ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.symbols import hash_order
from .ordering import places
from .rules import token


def behaviour_events(words: DataFrame, active: DataFrame, n: int = 3) -> DataFrame:
    """(sample, token, mined) from (sample, channel, w) and the active miner words (sample, channel, code).

    Grams end at n, at half the length plus n and at the end; only the last is ``recent``. Each active word is a token
    of its channel, and one more joined with the channel's recent gram. Words shorter than n give what they have.
    """
    size = F.size("w")
    gram = lambda end: F.slice("w", F.greatest(F.lit(1), end - n + 1), F.least(F.lit(n), end))
    ends = F.array_distinct(F.transform(F.array(F.lit(n), F.floor(size / 2).cast("int") + n, size), lambda e: F.least(e, size)))
    d = words.where(size > 0).select("sample", "channel", "w", F.explode(ends).alias("end"))
    sax = d.select("sample", token("channel", F.when(F.col("end") == size, "recent").otherwise("context"), gram(F.col("end"))).alias("token"), F.lit(False).alias("mined"))
    word = F.concat(F.lit("ch="), F.col("channel").cast("string"), F.lit("|miner_word="), F.col("code").cast("string"), F.lit("|active"))
    a = active.join(words, ["sample", "channel"]).where(size > 0).select("sample", word.alias("word"), token("channel", F.lit("recent"), gram(size)).alias("recent"))
    mined = a.select("sample", F.explode(F.array("word", F.concat("recent", F.lit("&"), "word"))).alias("token"), F.lit(True).alias("mined"))
    return sax.unionByName(mined).distinct()


def event_modes(events: DataFrame) -> DataFrame:
    """(mode, sample, token): events under each variant that has them."""
    modes = F.when(F.col("mined"), F.array(F.lit("own"), F.lit("permuted"))).otherwise(F.array(F.lit("own"), F.lit("permuted"), F.lit("sax")))
    return events.select(F.explode(modes).alias("mode"), "sample", "token")


def value_modes(values: DataFrame) -> DataFrame:
    """``values`` by sample under each variant; ``permuted`` deals each sample's rows to the sample that has its place in a hash order of ids."""
    ids = values.select("sample").distinct().withColumn("_hash", hash_order("sample"))
    to = places(ids, ["sample"]).select(F.col("sample").alias("_to"), "place").join(places(ids, ["_hash", "sample"]).select("sample", "place"), "place").select("sample", "_to")
    plain = values.withColumn("mode", F.explode(F.array(F.lit("own"), F.lit("sax"))))
    return plain.unionByName(values.join(to, "sample").withColumn("sample", F.col("_to")).drop("_to").withColumn("mode", F.lit("permuted")))


def value_rules(events: DataFrame, values: DataFrame, support: int = 8, shrink: float = 12.0) -> DataFrame:
    """(mode, token, v, support, strength) from (mode, sample, token) and dense (mode, sample, h, value).

    v is the token's mean (h, value) in order of h; strength is the RMS of its distance from the mean of all over the
    RMS distance of single rows, times support / (support + shrink).
    """
    base = values.groupBy("mode", "h").agg(F.avg("value").alias("base"))
    scale = values.join(base, ["mode", "h"]).groupBy("mode").agg(F.greatest(F.sqrt(F.avg((F.col("value") - F.col("base")) ** 2)), F.lit(1e-6)).alias("scale"))
    m = events.join(values, ["mode", "sample"]).groupBy("mode", "token", "h").agg(F.avg("value").alias("value"), F.count("*").alias("support"))
    m = m.where(F.col("support") >= support).join(base, ["mode", "h"])
    r = m.groupBy("mode", "token").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("v"), F.sqrt(F.avg((F.col("value") - F.col("base")) ** 2)).alias("own"), F.max("support").alias("support"))
    return r.join(scale, "mode").select("mode", "token", "v", "support", (F.col("own") / F.col("scale") * F.col("support") / (F.col("support") + shrink)).alias("strength"))


def prior_rules(events: DataFrame, targets: DataFrame, classes: DataFrame, support: int = 4, shrink: float = 8.0) -> DataFrame:
    """(mode, token, v, support, strength) from (mode, sample, token), (mode, sample, label) and the class list (h).

    v holds, for every class, ln((count + 1) / (support + K)) less the log of its share with one added to each count.
    """
    k = classes.agg(F.count("*").alias("k"))
    n = targets.groupBy("mode").agg(F.count("*").alias("n"))
    prior = n.join(classes).join(targets.groupBy("mode", F.col("label").alias("h")).agg(F.count("*").alias("c")), ["mode", "h"], "left").join(k)
    prior = prior.select("mode", "h", "k", F.log((F.coalesce("c", F.lit(0)) + 1.0) / (F.col("n") + F.col("k"))).alias("lp"))
    c = events.join(targets, ["mode", "sample"]).groupBy("mode", "token", F.col("label").alias("h")).agg(F.count("*").alias("count"))
    s = c.groupBy("mode", "token").agg(F.sum("count").alias("support")).where(F.col("support") >= support)
    d = s.join(prior, "mode").join(c, ["mode", "token", "h"], "left")
    d = d.withColumn("value", F.log((F.coalesce("count", F.lit(0)) + 1.0) / (F.col("support") + F.col("k"))) - F.col("lp"))
    r = d.groupBy("mode", "token").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("v"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"), F.max("support").alias("support"))
    return r.select("mode", "token", "v", "support", (F.col("rms") * F.col("support") / (F.col("support") + shrink)).alias("strength"))


def references(events: DataFrame, rules: DataFrame, top: int = 8, descending_tokens: bool = False) -> DataFrame:
    """(mode, sample, h, correction): the values of the ``top`` matched rules weighted by strength; ties by token. Samples without a match have no row."""
    w = W.partitionBy("mode", "sample").orderBy(F.desc(F.round("strength", 9)), F.desc("token") if descending_tokens else F.asc("token"))
    m = events.join(rules, ["mode", "token"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    m = m.select("mode", "sample", "strength", F.inline("v"))
    return m.groupBy("mode", "sample", "h").agg((F.sum(F.col("strength") * F.col("value")) / F.greatest(F.sum("strength"), F.lit(1e-12))).alias("correction"))


def correction_cells(logits: DataFrame, found: DataFrame, everywhere: DataFrame) -> DataFrame:
    """(mode, sample, y, h, logit, correction, covered): logits (sample, y, h, logit) under each variant, 0 where nothing matched; ``everywhere`` (h, correction) is the ``global`` one."""
    d = logits.withColumn("mode", F.explode(F.array(F.lit("own"), F.lit("sax"), F.lit("permuted")))).join(found, ["mode", "sample", "h"], "left")
    d = d.withColumn("covered", F.col("correction").isNotNull()).withColumn("correction", F.coalesce("correction", F.lit(0.0)))
    return d.unionByName(logits.join(everywhere, "h").withColumn("mode", F.lit("global")).withColumn("covered", F.lit(False)))


def _scored(x: Column, alpha: Column) -> Column:
    """(nll, right) of one sample's classes in order under logit + alpha x correction; the first of equal maxima is predicted."""
    s = F.transform(x, lambda e: e["logit"] + alpha * e["correction"])
    top = F.array_max(s)
    p = F.aggregate(F.transform(s, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    own = F.array_position(F.transform(x, lambda e: e["hit"]), True)
    mine = F.when(own > 0, F.exp(F.element_at(s, F.greatest(own, F.lit(1)).cast("int")) - top) / p).otherwise(0.0)
    return F.struct((-F.log(mine + 1e-12)).alias("nll"), (F.array_position(s, top) == own).cast("double").alias("right"))


def _by_sample(cells: DataFrame) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("h", "logit", "correction", (F.col("h") == F.col("y")).alias("hit"))))  # one entry a class
    return cells.groupBy("mode", "sample").agg(x.alias("x"), F.max("covered").alias("covered"))


def guidance_grid(cells: DataFrame, alphas: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.5)) -> DataFrame:
    """(mode, alpha, nll, accuracy, allowed, chosen): least NLL among the alphas whose accuracy is not below that of alpha 0; ties to the smaller alpha. All alphas and modes are sums of one aggregation."""
    alphas = tuple(sorted({0.0, *alphas}))
    d = _by_sample(cells).select("mode", *[_scored(F.col("x"), F.lit(a)).alias(f"s{i}") for i, a in enumerate(alphas)])
    d = d.groupBy("mode").agg(*[F.struct(F.avg(f"s{i}.nll").alias("nll"), F.avg(f"s{i}.right").alias("accuracy")).alias(f"s{i}") for i in range(len(alphas))])
    g = d.select("mode", F.col("s0.accuracy").alias("_base"), F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"s{i}.nll").alias("nll"), F.col(f"s{i}.accuracy").alias("accuracy")) for i, a in enumerate(alphas)])))
    g = g.withColumn("allowed", F.col("accuracy") + 1e-12 >= F.col("_base"))
    w = W.partitionBy("mode").orderBy(F.desc("allowed"), F.round("nll", 9), "alpha")
    return g.withColumn("chosen", F.row_number().over(w) == 1).drop("_base")


def guidance_report(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """(mode, alpha, nll, accuracy, coverage, change) of test cells under each variant's chosen alpha; change is the mean absolute move of a logit."""
    d = _by_sample(cells).join(grid.where("chosen").select("mode", "alpha"), "mode").withColumn("s", _scored(F.col("x"), F.col("alpha")))
    moved = F.aggregate(F.transform("x", lambda e: F.abs(F.col("alpha") * e["correction"])), F.lit(0.0), lambda a, v: a + v)
    return d.groupBy("mode", "alpha").agg(F.avg("s.nll").alias("nll"), F.avg("s.right").alias("accuracy"), F.avg(F.col("covered").cast("double")).alias("coverage"), (F.sum(moved) / F.sum(F.size("x"))).alias("change"))


def removals(events: DataFrame, rules: DataFrame, centres: DataFrame, top: int = 8) -> DataFrame:
    """(variant, sample, h, forecast, reliability) of rules (token, state, score): ``all`` of them, without the antecedent of
    the ``best`` matched rule, and without that of a ``random`` one of the ``top`` matched rules.

    One order a sample serves all three: a rule's rank after a removal is its rank less the removed ones before it.
    A sample whose every match is removed has no row there.
    """
    w = W.partitionBy("sample").orderBy(F.desc(F.round("score", 9)), "token", "state")
    m = events.join(rules.where("score > 0").select("token", "state", "score"), "token").withColumn("r", F.row_number().over(w))
    n = F.least(F.count("*").over(W.partitionBy("sample")), F.lit(top))
    m = m.withColumn("pick", F.pmod(hash_order("sample"), n) + 1)
    one = lambda at: F.max(F.when(F.col("r") == at, F.col("token"))).over(W.partitionBy("sample"))
    m = m.withColumn("best", one(F.lit(1))).withColumn("random", one(F.col("pick")))
    before = w.rowsBetween(W.unboundedPreceding, 0)
    for name in ("best", "random"):
        m = m.withColumn(f"{name}_rank", F.when(F.col("token") != F.col(name), F.col("r") - F.sum((F.col("token") == F.col(name)).cast("int")).over(before)))
    v = F.array(F.struct(F.lit("all").alias("variant"), F.col("r").cast("long").alias("rank")), *[F.struct(F.lit(x).alias("variant"), F.col(f"{x}_rank").alias("rank")) for x in ("best", "random")])
    m = m.select("sample", "state", "score", F.inline(v)).where(F.col("rank") <= top)
    return m.join(centres, "state").groupBy("variant", "sample", "h").agg((F.sum(F.col("score") * F.col("level")) / F.sum("score")).alias("forecast"), F.least(F.max("score"), F.lit(1.0)).alias("reliability"))


def removal_effect(forecasts: DataFrame, base: DataFrame, weight: float | Column) -> DataFrame:
    """(best_change, random_change, ratio, matched): mean absolute change of base + weight x reliability x (forecast - base) over all (sample, h, base) when rules are removed, and the samples that matched any."""
    move = lambda v: F.coalesce(F.max(F.when(F.col("variant") == v, F.col("reliability") * (F.col("forecast") - F.col("base")))), F.lit(0.0))
    d = base.join(forecasts, ["sample", "h"], "left").groupBy("sample", "h").agg(move("all").alias("a"), move("best").alias("b"), move("random").alias("c"), F.max((F.col("variant") == "all").cast("int")).alias("m"))
    weight = F.lit(float(weight)) if isinstance(weight, float | int) else weight
    r = d.agg((weight * F.avg(F.abs(F.col("a") - F.col("b")))).alias("best_change"), (weight * F.avg(F.abs(F.col("a") - F.col("c")))).alias("random_change"), F.countDistinct(F.when(F.col("m") == 1, F.col("sample"))).alias("matched"))
    return r.select("best_change", "random_change", (F.col("best_change") / F.greatest("random_change", F.lit(1e-12))).alias("ratio"), "matched")
