"""Word mining: rarity, bags, collisions, information gain, shapelets by SAX and by SFA, matching, features.

Words come as (series, t, label, word, code, flat, s0..). Series are fitted together; with ``by``, such as
("channel",), each value of these columns is fitted on its own, all in the same jobs: its series (whose ids
must differ between channels), its vocabulary, candidates, splits and dictionary.
"""

from __future__ import annotations

import itertools
import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.symbols import FLAT, code
from .windows import packed, packed_windows


#: Bytes of a dictionary that may be broadcast; a larger one is shuffled.
MOST_BROADCAST = 64 << 20


def beside(df: DataFrame, totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with what ``totals`` says of each value of ``by``; without ``by`` it is one row."""
    return df.join(totals, list(by)) if by else df.join(F.broadcast(totals))


def few(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= MOST_BROADCAST else df


def ranked(df: DataFrame, order: list[Column], most: int, by: tuple[str, ...]) -> DataFrame:
    """The first ``most`` rows (of each ``by``) with their rank; a partition holds one vocabulary at most."""
    if not by:
        df = df.orderBy(*order).limit(most)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def rarity_table(words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, code, rarity): minus the log of the share of training windows with this word."""
    n = words.groupBy(*by).agg(F.count("*").alias("n"))
    return beside(words.groupBy(*by, "code").count(), n, by).select(*by, "code", (-F.log(F.col("count") / F.col("n"))).alias("rarity"))


def rarity(words: DataFrame, table: DataFrame, n_train: Column | int, by: tuple[str, ...] = ()) -> DataFrame:
    """(series, rarity, location): the rarest window of each series, first on ties; a word unseen in training counts 1/(n+1). ``n_train`` may be a column of ``words``."""
    floor = F.log(F.lit(1.0) + n_train)
    r = words.join(table, [*by, "code"], "left").select("series", "t", F.coalesce("rarity", floor).alias("r"))
    best = r.groupBy("series").agg(F.min(F.struct((-F.col("r")).alias("m"), F.col("t").alias("t"))).alias("b"))
    return best.select("series", (-F.col("b.m")).alias("rarity"), F.col("b.t").alias("location"))


def reduced(words: DataFrame) -> DataFrame:
    """Numerosity reduction: a window goes if the window before it has the same word."""
    w = W.partitionBy("series").orderBy("t")
    return words.withColumn("_before", F.lag("code").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("code"))).drop("_before")


def projection_masks(word_len: int, mask_size: int, n: int, seed: int = 0) -> list[tuple[int, ...]]:
    """Positions kept in each random projection, drawn on the driver."""
    rng = random.Random(seed)
    keep = word_len - min(mask_size, word_len - 1)
    every = list(itertools.combinations(range(word_len), keep))
    return [every[rng.randrange(len(every))] for _ in range(n)]


def collisions(words: DataFrame, masks: list[tuple[int, ...]], word_len: int, alphabet: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, code, label, n): for each word and class, the number of distinct series that hold a word equal to it under a mask, summed over masks."""
    s = [F.col(f"s{j}") for j in range(word_len)]
    # a mask drawn several times is counted once and taken as often
    times = Counter(masks)
    often = F.element_at(F.array(*[F.lit(n) for n in times.values()]), F.col("mask") + 1)
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), code([s[j] for j in m], alphabet).alias("key")) for k, m in enumerate(times)])
    own = words.select(*by, "series", "label", "code", *[f"s{j}" for j in range(word_len)]).distinct()
    per = own.select(*by, "series", "label", F.inline(keys)).distinct().groupBy(*by, "mask", "key", "label").agg(F.count("*").alias("n"))
    vocabulary = own.select(*by, "code", *[f"s{j}" for j in range(word_len)]).distinct().select(*by, "code", F.inline(keys))
    return vocabulary.join(per, [*by, "mask", "key"]).groupBy(*by, "code", "label").agg(F.sum(F.col("n") * often).alias("n"))


def candidate_scores(coll: DataFrame, classes: DataFrame, n_masks: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, code, score, dominant): largest p_c less the mean of the other classes' p, p the share of series and masks that collide; for two classes the absolute difference. ``classes``: (by, label, n)."""
    grid = beside(coll.select(*by, "code").distinct(), classes, by)
    p = grid.join(coll.withColumnRenamed("n", "c"), [*by, "code", "label"], "left").withColumn("p", F.coalesce("c", F.lit(0)) / (F.lit(float(n_masks)) * F.col("n")))
    w = W.partitionBy(*by, "code")
    p = p.withColumn("k", F.count("*").over(w)).withColumn("others", (F.sum("p").over(w) - F.col("p")) / F.greatest(F.lit(1), F.col("k") - 1))
    best = p.groupBy(*by, "code").agg(F.max(F.col("p") - F.col("others")).alias("score"), F.min(F.struct((-F.round("p", 9)).alias("m"), "label"))["label"].alias("dominant"))
    return best


def eligible(words: DataFrame, flat_code: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, code, support): words with a window that is not flat and other than the flat word, with the share of series that hold them."""
    n = words.groupBy(*by).agg(F.count_distinct("series").alias("n"))
    d = words.groupBy(*by, "code").agg(F.count_distinct("series").alias("c"), F.max(~F.col("flat")).alias("shaped"))
    return beside(d.where(F.col("shaped") & (F.col("code") != flat_code)), n, by).select(*by, "code", (F.col("c") / F.col("n")).alias("support"))


def motifs(words: DataFrame, coll: DataFrame, flat_code: int, n_masks: int, top_k: int) -> DataFrame:
    """(rank, code, support, p): without classes, words by collision share, then support, then code."""
    n = words.agg(F.count_distinct("series").alias("n"))
    total = coll.groupBy("code").agg(F.sum("n").alias("c")).join(F.broadcast(n)).select("code", (F.col("c") / (F.lit(float(n_masks)) * F.col("n"))).alias("p"))
    d = eligible(words, flat_code).join(total, "code").orderBy(F.desc(F.round("p", 9)), F.desc(F.round("support", 9)), "code").limit(top_k)
    w = W.orderBy(F.desc(F.round("p", 9)), F.desc(F.round("support", 9)), "code")
    return d.select(F.row_number().over(w).alias("rank"), "code", "support", "p")


def best_splits(values: DataFrame, feature: str | tuple[str, ...] = "feature") -> DataFrame:
    """(feature, ig, threshold, gap) of the best threshold of each feature from rows (feature, value, label, n).

    Classes stay rows, however many there are: what a class adds to a side's entropy is n log n, and only the
    classes of the rows at a value change there, so the sums of both sides are running sums of these changes.
    Rows are merged by value first; the gain is taken between distinct values, the first best one wins, and a
    feature of one value has gain 0 at that value. ``n`` lets one row stand for many, such as absent words.
    ``feature`` may be several columns.
    """
    key = [feature] if isinstance(feature, str) else list(feature)
    nlogn = lambda x: F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0)
    rows = values.groupBy(*key, "label", "value").agg(F.sum("n").alias("n"))
    up, whole = W.partitionBy(*key, "label").orderBy("value").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*key, "label")
    rows = rows.select(*key, "value", "n", F.sum("n").over(up).alias("l"), F.sum("n").over(whole).alias("t"))
    before, left, right, wider = F.col("l") - F.col("n"), F.col("l"), F.col("t") - F.col("l"), F.col("t") - F.col("l") + F.col("n")
    v = rows.groupBy(*key, "value").agg(F.sum("n").alias("n"), F.sum(nlogn(left) - nlogn(before)).alias("dl"), F.sum(nlogn(right) - nlogn(wider)).alias("dr"))
    order = W.partitionBy(*key).orderBy("value")
    up, whole = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*key)
    # over all values the left side grows to the total and the right side falls from it to 0
    v = v.select(*key, "value", F.lead("value").over(order).alias("next"), F.sum("dl").over(up).alias("al"), F.sum("dr").over(up).alias("ar"), F.sum("dl").over(whole).alias("at"), F.sum("n").over(up).alias("nl"), F.sum("n").over(whole).alias("nt"), F.sum(F.col("n") * F.col("value")).over(up).alias("sl"), F.sum(F.col("n") * F.col("value")).over(whole).alias("st"))
    nr = F.col("nt") - F.col("nl")
    total, lower, upper = nlogn(F.col("nt")) - F.col("at"), nlogn(F.col("nl")) - F.col("al"), nlogn(nr) - (F.col("at") + F.col("ar"))
    ig = (total - lower - upper) / F.col("nt")
    v = v.select(*key, "value", "next", F.when(F.col("next").isNull(), F.lit(-1.0)).otherwise(F.round(ig, 12) + 0.0).alias("ig"), F.when(F.col("next").isNotNull(), (F.col("st") - F.col("sl")) / nr - F.col("sl") / F.col("nl")).alias("gap"))
    best = v.groupBy(*key).agg(F.min(F.struct((-F.col("ig")).alias("m"), "value", "next", "gap")).alias("b"))
    none = F.col("b.next").isNull()
    return best.select(*key, F.when(none, 0.0).otherwise(-F.col("b.m")).alias("ig"), F.when(none, F.col("b.value")).otherwise((F.col("b.value") + F.col("b.next")) / 2).alias("threshold"), F.when(none, 0.0).otherwise(F.col("b.gap")).alias("gap"))


def z_windows(points: DataFrame, window: int, carry: tuple[str, ...] = ("label",)) -> DataFrame:
    """(series, t, carry, flat, z0..z(w-1)): z-normalised windows as flat columns; ``points`` may be packed."""
    if packed(points):
        x = packed_windows(points, window, 1, carry)
    else:
        spec = W.partitionBy("series").orderBy("t")
        frame = spec.rowsBetween(0, window - 1)
        x = points.select("series", "t", *carry, F.count("value").over(frame).alias("n"), F.avg("value").over(frame).alias("mean"), F.stddev_pop("value").over(frame).alias("sd"), *[(F.lead("value", i).over(spec) if i else F.col("value")).alias(f"x{i}") for i in range(window)])
        x = x.where(F.col("n") == window)
    flat = F.col("sd") < FLAT
    return x.select("series", "t", *carry, flat.alias("flat"), *[F.when(flat, 0.0).otherwise((F.col(f"x{i}") - F.col("mean")) / F.col("sd")).alias(f"z{i}") for i in range(window)])


def first_at(rank: Column, t: Column) -> Column:
    """A whole ``rank`` below 2**32 and a place below 2**31 as one long, whose minimum is the first place of least rank; the minimum of a struct would sort all rows."""
    return F.shiftleft(rank.cast("long"), 31).bitwiseOR(t.cast("long"))


def place_of(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit((1 << 31) - 1))


def min_distances(windows: DataFrame, queries: DataFrame, window: int, carry: tuple[str, ...] = ("label",), by: tuple[str, ...] = ()) -> DataFrame:
    """(series, carry, by, query, distance, location, spread): least length-normalised distance of each query to each series.

    ``queries``: (by, query, q0..q(w-1)), z-normalised and a dictionary, so they are broadcast (with ``by`` up to a
    counted size). The distance
    is unrolled arithmetic that stays in generated code, with a partial minimum before the shuffle, in numbers
    alone, so that rows are hashed and never sorted. Locations are the first of least distance to nine decimals.
    Flat windows, which all are as far, count only where all windows are flat, with spread 0.
    """
    d2 = sum([(F.col(f"z{i}") - F.col(f"q{i}")) * (F.col(f"z{i}") - F.col(f"q{i}")) for i in range(1, window)], (F.col("z0") - F.col("q0")) * (F.col("z0") - F.col("q0")))
    both = windows.join(few(queries, 8 * window + 64), list(by)) if by else windows.join(F.broadcast(queries))
    carry = (*carry, *[c for c in by if c not in carry])
    d, shaped = F.col("d"), lambda x: F.when(~F.col("flat"), x)
    # d is at most 2; a window with a value that is not a number comes last
    nano = F.when(F.isnan("d"), F.lit((1 << 32) - 1)).otherwise(F.floor(d * 1e9 + 0.5))
    each = both.select("series", *carry, "query", "t", "flat", F.sqrt(d2 / F.lit(float(window))).alias("d"))
    g = each.groupBy("series", *carry, "query").agg(F.min(shaped(d)).alias("a"), F.min(shaped(first_at(nano, F.col("t")))).alias("at"), F.max(shaped(d)).alias("most"), F.min("d").alias("f"), F.min("t").alias("t"))
    return g.select("series", *carry, "query", F.coalesce("a", "f").alias("distance"), F.coalesce(place_of("at"), "t").alias("location"), F.when(F.col("a").isNull(), 0.0).otherwise(F.col("most") - F.col("a")).alias("spread"))


def representatives(words: DataFrame, windows: DataFrame, candidates: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query, q0..): the first non-flat window of each candidate in a series of its dominant class, else in any; candidates (by, code, dominant)."""
    pref = F.when(F.col("label") == F.col("dominant"), 0).otherwise(1)
    shaped = words.where(~F.col("flat")).join(few(candidates, 64) if by else F.broadcast(candidates), [*by, "code"])
    at = shaped.groupBy(*by, "code").agg(F.min(F.struct(pref.alias("p"), "series", "t")).alias("m")).select(*by, F.col("code").alias("query"), "m.series", "m.t")
    at = at.cache()
    few_series = few(at.select("series").distinct(), 64) if by else F.broadcast(at.select("series").distinct())
    # the half join goes below the windows, which are made for these series alone
    return windows.join(few_series, "series", "left_semi").join(at if by else F.broadcast(at), [*by, "series", "t"]).select(*by, "query", *[F.col(f"z{i}").alias(f"q{i}") for i in range(window)])


def mined(words: DataFrame, windows: DataFrame, window: int, word_len: int, flat_code: int, masks: list[tuple[int, ...]], n_candidates: int = 50, top_k: int = 10, alphabet: int = 4, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary: by, rank, code, ig, threshold, gap, dominant, support; its queries; distances of all candidates): symbolic filter, then verification of raw windows by information gain. ``words`` are read several times and should be cached or cheap."""
    labels = words.select(*by, "series", "label").distinct().groupBy(*by, "label").agg(F.count("*").alias("n"))
    scores = candidate_scores(collisions(words, masks, word_len, alphabet, by), labels, len(masks), by)
    cand = ranked(scores.join(eligible(words, flat_code, by), [*by, "code"]), [F.desc(F.round("score", 9)), F.col("code")], n_candidates, by).drop("rank").cache()
    queries = representatives(words, windows, cand.select(*by, "code", "dominant"), window, by).cache()
    dist = min_distances(windows, queries, window, ("label",), by).cache()
    splits = best_splits(dist.select(*by, F.col("query").alias("code"), F.round("distance", 9).alias("value"), "label", F.lit(1).alias("n")), (*by, "code"))
    order = [F.desc("ig"), F.desc(F.round(F.abs("gap"), 9)), F.desc(F.round("score", 9)), F.col("code")]
    top = ranked(splits.join(cand, [*by, "code"]), order, top_k, by).select(*by, "rank", "code", "ig", "threshold", "gap", "dominant", "support")
    return top, queries, dist


def shapelets(words: DataFrame, windows: DataFrame, window: int, word_len: int, flat_code: int, masks: list[tuple[int, ...]], n_candidates: int = 50, top_k: int = 10, alphabet: int = 4, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The dictionary and the queries of ``mined``."""
    return mined(words, windows, window, word_len, flat_code, masks, n_candidates, top_k, alphabet, by)[:2]


def match(words: DataFrame, windows: DataFrame, dictionary: DataFrame, queries: DataFrame, window: int, by: tuple[str, ...] = (), distances: DataFrame | None = None) -> DataFrame:
    """(series, by, code, presence, frequency, distance, location, informative) of each dictionary word in each series; frequency is over all windows. ``distances`` of these series, if they were taken before, are not taken again."""
    codes = dictionary.select(*by, "code")
    keys = codes.withColumnRenamed("code", "query")
    if distances is None:
        distances = min_distances(windows, queries.join(keys if by else F.broadcast(keys), [*by, "query"]), window, (), by)
    else:
        distances = distances.drop("label").join(few(keys, 64) if by else F.broadcast(keys), [*by, "query"], "left_semi")
    n = words.groupBy("series").agg(F.count("*").alias("n"))
    hits = words.join(few(codes, 64) if by else F.broadcast(codes), [*by, "code"]).groupBy("series", "code").agg(F.count("*").alias("c"))
    d = distances.withColumnRenamed("query", "code").join(n, "series").join(hits, ["series", "code"], "left")
    c = F.coalesce("c", F.lit(0))
    return d.select("series", *by, "code", (c > 0).cast("int").alias("presence"), (c / F.col("n")).alias("frequency"), "distance", "location", (F.col("spread") > 1e-4).alias("informative"))


def standardised(features: DataFrame, cols: tuple[str, ...], by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Each column by its mean and sd over all rows of ``by``; an sd below 1e-6 counts as 1."""
    stats = features.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])
    d = features.join(F.broadcast(stats), list(by))
    rest = [c for c in features.columns if c not in cols]
    return d.select(*rest, *[((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") < 1e-6, 1.0).otherwise(F.col(f"{c}_s"))).alias(c) for c in cols])


def boss_words(words: DataFrame, flat_code: int, top_k: int = 10, min_support: float = 0.02) -> DataFrame:
    """(rank, code, ig, dominant, support): SFA words by information gain of their reduced relative frequency.

    A series without the word has frequency 0; it enters as one row a class, not as a dense grid. If no word
    has the support, the most supported ones are taken.
    """
    bag = reduced(words).groupBy("series", "label", "code").agg(F.count("*").alias("c"))
    total = bag.groupBy("series").agg(F.sum("c").alias("total"))
    freq = bag.join(total, "series").select("series", "label", "code", (F.col("c") / F.col("total")).alias("value"))
    n = words.select("series", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    ok = eligible(words, flat_code)
    wide = ok.where(F.col("support") >= min_support)
    ok = wide if wide.limit(1).count() else ok.orderBy(F.desc("support"), "code").limit(top_k)
    f = freq.join(ok, "code").cache()
    have = f.groupBy("code", "label").agg(F.count("*").alias("have"), F.sum("value").alias("mass"))
    grid = ok.join(F.broadcast(n)).join(have, ["code", "label"], "left").select("code", "label", "support", "n", F.coalesce("have", F.lit(0)).alias("have"), (F.coalesce("mass", F.lit(0.0)) / F.col("n")).alias("mean"))
    zero = grid.where("n > have").select(F.col("code").alias("feature"), F.lit(0.0).alias("value"), "label", (F.col("n") - F.col("have")).alias("n"))
    rows = f.select(F.col("code").alias("feature"), F.round("value", 12).alias("value"), "label", F.lit(1).cast("long").alias("n")).unionByName(zero)
    dominant = grid.groupBy("code", "support").agg(F.min(F.struct((-F.round("mean", 12)).alias("m"), "label"))["label"].alias("dominant"))
    s = best_splits(rows).withColumnRenamed("feature", "code").join(dominant, "code")
    order = [F.desc("ig"), F.desc(F.round(F.abs("gap"), 9)), F.col("code")]
    return s.orderBy(*order).limit(top_k).select(F.row_number().over(W.orderBy(*order)).alias("rank"), "code", "ig", "gap", "dominant", "support")


def boss_match(words: DataFrame, dictionary: DataFrame, n: int, alphabet: int = 4) -> DataFrame:
    """(series, code, presence, frequency, distance, location): mean symbol difference / (alphabet - 1), least over non-flat windows; ``dictionary``: (code, r0..r(n-1)), broadcast."""
    gap = sum([F.abs(F.col(f"s{i}") - F.col(f"r{i}")) for i in range(1, n)], F.abs(F.col("s0") - F.col("r0")))
    share, shaped = (lambda c: F.col(c) / F.lit(float(n * (alphabet - 1)))), lambda x: F.when(~F.col("flat"), x)
    each = words.select("series", "t", "flat", F.col("code").alias("own"), *[f"s{i}" for i in range(n)]).join(F.broadcast(dictionary)).select("series", "code", "t", "flat", (F.col("own") == F.col("code")).cast("int").alias("same"), gap.alias("gap"))
    g = each.groupBy("series", "code").agg(F.max("same").alias("presence"), F.avg("same").alias("frequency"), F.min(shaped(F.col("gap"))).alias("a"), F.min(shaped(first_at(F.col("gap"), F.col("t")))).alias("at"), F.max(shaped(F.col("gap"))).alias("most"), F.min("gap").alias("f"), F.min("t").alias("t"))
    return g.select("series", "code", "presence", "frequency", F.coalesce(share("a"), share("f")).alias("distance"), F.coalesce(place_of("at"), "t").alias("location"), F.coalesce(F.col("most") > F.col("a"), F.lit(False)).alias("informative"))


def with_locations(features: DataFrame, length: int) -> DataFrame:
    """``features`` with place: location / (length - 1) where the match is informative, else 0."""
    return features.withColumn("place", F.when(F.col("informative"), F.col("location") / F.lit(float(length - 1))).otherwise(0.0))


def word_tendencies(presence: DataFrame) -> DataFrame:
    """(code, label, n): in how many series of each class a word is present."""
    return presence.where("presence = 1").groupBy("code", "label").agg(F.count("*").alias("n"))
