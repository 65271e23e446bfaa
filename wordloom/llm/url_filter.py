"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path prefix. A URL's canonical keys are every suffix of its host, label by
label, joined with each prefix of its path whose length some listed entry has. A key that the Bloom filter
passes is joined with the list, which removes false positives; the longest entry that fits wins.

The filter's size is a parameter and does not grow with the list beyond it: a longer list only lets more
keys through to the join. Nulls and strings without ``://`` have an empty host and path and fit no entry.
Repeated rows each get their verdict; ids may repeat or be null. An empty list fits nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, materialise

WORDS_PER_BLOCK = 8


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def block_and_bits(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and the one bit that it sets in each of the block's eight words."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    salts = np.arange(1, 2 * WORDS_PER_BLOCK, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = ((h & np.uint64(0xFFFFFFFF))[:, None] * salts[None, :]) >> np.uint64(58)
    return block.astype(np.int64), np.uint64(1) << bit


def build_filter(keys: DataFrame, key: str, bits_per_key: int = 16, max_bytes: int = 1 << 25) -> np.ndarray:
    """A blocked Bloom filter (blocks x 8 uint64) over the distinct values of ``key``.

    Executors set bits, an aggregation ORs each block, and at most ``max_bytes`` come to the driver however
    long the list is.
    """
    n = keys.count()
    n_blocks = int(min(max(1, -(-n * bits_per_key // (64 * WORDS_PER_BLOCK))), max_bytes // (8 * WORDS_PER_BLOCK)))

    def set_bits(batches):
        for pdf in batches:
            block, bits = block_and_bits(pdf["h"].to_numpy(np.int64), n_blocks)
            own = np.unique(block)
            out = np.zeros((len(own), WORDS_PER_BLOCK), np.uint64)
            np.bitwise_or.at(out, np.searchsorted(own, block), bits)
            yield pd.DataFrame({"block": own} | {f"w{i}": out[:, i].view(np.int64) for i in range(WORDS_PER_BLOCK)})

    words = [f"w{i}" for i in range(WORDS_PER_BLOCK)]
    set_ = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).mapInPandas(set_bits, "block long, " + ", ".join(f"{w} long" for w in words))
    rows = set_.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).toPandas()
    table = np.zeros((n_blocks, WORDS_PER_BLOCK), np.uint64)
    if len(rows):
        table[rows["block"].to_numpy()] = rows[words].to_numpy(np.int64).view(np.uint64)
    return table


def passes(hashes: Column, table: np.ndarray) -> Column:
    """True where the filter may hold the hash; null is false."""

    @F.pandas_udf(T.BooleanType())
    def test(h: pd.Series) -> pd.Series:
        block, bits = block_and_bits(h.fillna(0).to_numpy(np.int64), len(table))
        return pd.Series(((table[block] & bits) == bits).all(axis=1) & h.notna().to_numpy())

    return test(hashes)


def filter_urls(urls: DataFrame, listed: DataFrame, url: str = "url", row_id: str = "page_id", listed_verdict: str = "verdict", default: str = "allow", broadcast_rows: int = 100_000, most_lengths: int = 64) -> DataFrame:
    """Verdict of each row of ``urls`` by ``listed`` (host, path, verdict).

    Returns ``row_id``, host, path, rule (the entry that fits, longest first, ties by the smaller text) and
    verdict (the entry's, or ``default`` where none is listed). The list is broadcast only up to
    ``broadcast_rows`` entries; a longer one is joined by shuffling the few keys that the filter passes.
    Host and path are shuffled to make them distinct, and again for the last join where the table of hits is too
    large for Spark to broadcast by itself. Up to ``most_lengths`` different path lengths of the
    list are part of the plan; more of them are joined with the URLs, so none is left out.
    """
    entries = listed.select(F.concat("host", "path").alias("rule"), F.col(listed_verdict).alias("says"), F.length("path").alias("len")).where("rule is not null")
    entries = entries.groupBy("rule").agg(F.min("says").alias("says"), F.min("len").alias("len"))
    table = build_filter(entries, "rule")
    every = entries.select("len").distinct()
    lengths = sorted(r[0] for r in every.limit(most_lengths + 1).collect())
    base = urls.select(F.col(row_id).alias("id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    # a row of its own per URL, so repeated or null ids stay apart
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 20)), "."))
    cut = lambda prefixes: F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, p)))))
    hosts = base.select("host", "path").where("host <> ''").distinct()
    if len(lengths) > most_lengths:
        hosts = hosts.join(F.broadcast(every), F.col("len") <= F.length("path"))
        found = hosts.withColumn("key", F.explode(cut(F.array(F.expr("substring(path, 1, len)"))))).drop("len")
    else:
        prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array(F.lit(None).cast("string"))
        found = hosts.withColumn("key", F.explode(cut(prefixes)))
    found = found.where(passes(F.xxhash64("key"), table))
    small = entries.limit(broadcast_rows + 1).count() <= broadcast_rows
    exact = found.join(F.broadcast(entries) if small else entries, found["key"] == entries["rule"])
    best = exact.groupBy("host", "path").agg(F.min(F.struct(-F.length("rule"), "rule", "says")).alias("best"))
    best = materialise(best.select("host", "path", "best.rule", "best.says"), "urls")
    return base.join(best, ["host", "path"], "left").select(F.col("id").alias(row_id), "host", "path", "rule", F.coalesce("says", F.lit(default)).alias("verdict"))
