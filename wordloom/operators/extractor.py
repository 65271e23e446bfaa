"""Symbolic features of many channels at once: one job mines, matches and standardises all of them.

Points are (series, channel, t, value, label), or packed (series, channel, values, label). A channel is a key of every grouping, never a loop: candidates,
splits and dictionaries are made by channel in the same shuffles. Every channel's block has the same width:
3 K + 1 features, K the most words of any channel; a channel with fewer words (a dead sensor has none) is
padded with zeros and ``<none>``, so nothing is invented for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import hash_order
from . import mining as G
from . import windows as X
from .ordering import fixed

KINDS = ("presence", "frequency", "distance")
NONE = "<none>"


@dataclass
class Extractor:
    """A fitted extractor; tables of its dictionary and numbers of bounded size.

    ``dictionary``: (channel, rank, code, ig, threshold, gap, dominant, support); ``queries``: the raw window of
    each word; ``rarities``: (channel, code, rarity); ``totals``: (channel, n_train), one row a channel;
    ``width``: K; ``mean`` and ``sd``: of the 3 K + 1 features over all series and channels of the fit.
    """

    window: int
    word_len: int
    alphabet: int
    step: int
    dictionary: DataFrame
    queries: DataFrame
    rarities: DataFrame
    totals: DataFrame
    width: int
    mean: list[float]
    sd: list[float]

    @property
    def dim(self) -> int:
        return 3 * self.width + 1


BY = ("channel",)


def keyed(points: DataFrame) -> DataFrame:
    """Points, or packed series, whose series are told apart by channel."""
    label = [F.col("label")] if "label" in points.columns else [F.lit(0).alias("label")]
    if X.packed(points):
        return X.dealt(points.select(F.struct("channel", "series").alias("series"), "channel", "values", *label))
    return points.select(F.struct("channel", "series").alias("series"), "channel", "t", "value", *label)


def pieces(points: DataFrame, window: int, word_len: int, alphabet: int, step: int) -> tuple[DataFrame, DataFrame]:
    """(words, z-normalised windows) of keyed points."""
    words = X.sax_words(points, window, word_len, alphabet, step, carry=("channel", "label")).drop("word").cache()
    z = G.z_windows(points, window, carry=("channel", "label"))
    return words, z.where(F.col("t") % step == 0) if step > 1 else z


def subset(points: DataFrame, most: int, seed: int) -> DataFrame:
    """The points of ``most`` series drawn by hash, the same in every channel."""
    return points.join(points.select("series").distinct().orderBy(hash_order("series", seed), "series").limit(most), "series", "left_semi")


def fit(points: DataFrame, window: int, word_len: int = 8, alphabet: int = 4, top_k: int = 10, n_candidates: int = 50, n_projections: int = 10, mask_size: int = 1, step: int = 1, seed: int = 0, max_fit_series: int | None = None) -> Extractor:
    """Dictionaries of all channels and the scales of their features.

    Labels may be shared by the channels of a series or differ; without a label column all series are of one
    class. ``max_fit_series`` bounds the series that words are mined from; scales are over all given points.
    Raises ValueError if no channel has a word.
    """
    p = keyed(points)
    words, z = pieces(keyed(subset(points, max_fit_series, seed)) if max_fit_series else p, window, word_len, alphabet, step)
    flat = sum((alphabet // 2) * alphabet**i for i in range(word_len))
    top, queries = G.shapelets(words, z, window, word_len, flat, G.projection_masks(word_len, mask_size, n_projections, seed), n_candidates, top_k, alphabet, BY)
    top, queries = fixed(top), fixed(queries)
    width = top.agg(F.max("rank")).first()[0]
    if width is None:
        raise ValueError("no words on any channel: every channel looks constant; check the input or take a shorter window")
    totals = words.groupBy("channel").agg(F.count("*").alias("n_train"))
    e = Extractor(window, word_len, alphabet, step, top, queries, fixed(G.rarity_table(words, BY)), fixed(totals), width, [], [])
    own = raw(e, points).cache()  # what ``transform`` of the same points starts from
    stats = own.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("j").collect()  # 3 K + 1 rows
    e.mean, e.sd = [r.m for r in stats], [r.s if r.s >= 1e-6 else 1.0 for r in stats]
    return e


def padded(entries: Column, width: int, value: str, default: Column) -> Column:
    """An array of ``width`` values of a map from rank, the default where it has none."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.coalesce(entries[k][value], default))


def raw(e: Extractor, points: DataFrame) -> DataFrame:
    """(series, channel, features, location, presence, distance, informative, rarity_location), features not yet standardised; one row for each series and channel of at least a window."""
    words, z = pieces(keyed(points), e.window, e.word_len, e.alphabet, e.step)
    found = G.match(words, z, e.dictionary, e.queries, e.window, BY).join(e.dictionary.select("channel", "code", "rank"), ["channel", "code"])
    found = found.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct(*KINDS, "location", "informative")))).alias("m"))  # at most K
    rare = G.rarity(words.join(e.totals, "channel", "left"), e.rarities, F.coalesce("n_train", F.lit(0)), BY).withColumnRenamed("location", "rarity_location")
    d = rare.join(found, "series", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,struct<presence:int,frequency:double,distance:double,location:bigint,informative:boolean>>")))
    k = F.sequence(F.lit(1), F.lit(e.width))
    block = F.flatten(F.transform(k, lambda i: F.array(*[F.coalesce(F.col("m")[i][kind].cast("double"), F.lit(0.0)) for kind in KINDS])))
    return d.select(F.col("series.series").alias("series"), F.col("series.channel").alias("channel"), F.concat(block, F.array("rarity")).alias("features"), padded(F.col("m"), e.width, "location", F.lit(0).cast("long")).alias("location"), padded(F.col("m"), e.width, "presence", F.lit(0)).alias("presence"), padded(F.col("m"), e.width, "distance", F.lit(0.0)).alias("distance"), padded(F.col("m"), e.width, "informative", F.lit(False)).alias("informative"), "rarity_location")


def transform(e: Extractor, points: DataFrame) -> DataFrame:
    """As ``raw`` with standardised features, in the scales of the fit."""
    scale = F.zip_with(F.array(*[F.lit(float(m)) for m in e.mean]), F.array(*[F.lit(float(s)) for s in e.sd]), lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    return raw(e, points).withColumn("features", F.zip_with("features", scale, lambda x, s: (x - s["m"]) / s["s"]))


def words(e: Extractor) -> DataFrame:
    """(channel, slot, word, info_gain, dominant, support): each channel's words, padded to K with ``<none>``."""
    letters = F.concat(*[F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(F.col("code") / e.alphabet ** (e.word_len - 1 - i)) % e.alphabet + 1).cast("int"), F.lit(1)) for i in range(e.word_len)])
    d = e.dictionary.select("channel", (F.col("rank") - 1).alias("slot"), letters.alias("word"), "ig", "dominant", F.col("support").alias("s"))
    slots = e.totals.select("channel", F.explode(F.sequence(F.lit(0), F.lit(e.width - 1))).alias("slot"))
    return slots.join(d, ["channel", "slot"], "left").select("channel", "slot", F.coalesce("word", F.lit(NONE)).alias("word"), F.coalesce("ig", F.lit(0.0)).alias("info_gain"), "dominant", F.coalesce("s", F.lit(0.0)).alias("support"))


def feature_names(e: Extractor) -> DataFrame:
    """(channel, j, slot, kind, word) of every feature; the last of a channel is its rarity, without slot and word."""
    w = words(e)
    kinds = w.select("channel", F.posexplode(F.array(*[F.lit(k) for k in KINDS])).alias("p", "kind"), "slot", "word")
    kinds = kinds.select("channel", (3 * F.col("slot") + F.col("p")).alias("j"), "slot", "kind", "word")
    return kinds.unionByName(e.totals.select("channel", F.lit(3 * e.width).alias("j"), F.lit(None).cast("int").alias("slot"), F.lit("rarity").alias("kind"), F.lit(None).cast("string").alias("word")))
