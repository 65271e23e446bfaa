"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides hash every ``gram``-word gram and select the least hash of each window of ``window`` words, the last
of equal ones; a (hash, place) that several windows select in a row is kept once. Equal windows select the same
gram, so every shared span of at least ``window`` words has a kept hash in common. Kept hashes are joined, and
each meeting is extended to the left and right word by word: it is a hit if ``window`` words are equal. An item
with fewer words is one window of its own length.

Documents are read in one pass for all item lengths: windows are made by zipping shifted slices of the array of
word hashes, in segments of bounded length. Up to ``broadcast_windows`` different benchmark hashes are broadcast
and documents are not shuffled; beyond, the kept hashes and places of the documents are shuffled to them, and
only documents that met one give the words round their places. Surroundings that many items share are one row;
items come back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT = 2048


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased; null has none."""
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.coalesce(F.array_remove(F.split(plain, NOT_WORD), ""), F.array().cast("array<string>"))


def fingerprints(df: DataFrame, keep: list[str], lengths: list[int], gram: int, window: int) -> DataFrame:
    """``keep``, n, f, at, and the words round it from ``base`` on: the kept gram hashes of the windows of each of ``lengths`` words.

    df has ``words``, an array; lengths are ``window`` at most; ``at`` is the place of the gram's first word.
    Tagged with their place, the hashes of one row serve its window and the one before, so a row is kept exactly
    where the selection changes. A segment brings its own words only, so that very long texts stay linear. The
    outer forms of explode keep Spark from testing the arrays, and so making them, a second time.
    """
    most, least = max(lengths), min(lengths)
    tags = (1 << (window + 1).bit_length()) - 1  # the same on both sides
    segments = F.when(F.col("size") >= least, F.sequence(F.lit(0), F.col("size") - least, F.lit(SEGMENT)))
    df = df.select(*keep, "words", F.size("words").alias("size"))
    df = df.select(*keep, "words", "size", F.explode_outer(segments).alias("seg")).withColumn("base", F.greatest(F.lit(0), F.col("seg") - most))
    df = df.select(*keep, "size", "seg", "base", F.slice("words", F.col("base") + 1, F.lit(SEGMENT + 3 * most)).alias("words"))
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    sizes = sorted({min(gram, n) for n in lengths})
    shift = lambda k, i: F.slice("h", i + 1, F.greatest(F.lit(0), F.size("h") - k + 1)).alias(f"h{i}")
    # before the first gram stands a zero
    hashes = lambda k: F.transform(F.arrays_zip(*[shift(k, i) for i in range(k)]), lambda x: F.xxhash64(x))
    df = df.select(*keep, "size", "seg", "base", "words", *[F.concat(F.array(F.lit(0).cast("long")), hashes(k)).alias(f"g{k}") for k in sizes])
    starts = F.least(F.lit(SEGMENT), F.col("size") - least + 1 - F.col("seg"))
    columns = [(k, j) for k in sizes for j in range(max(n - k for n in lengths if min(gram, n) == k) + 2)]
    zipped = F.arrays_zip(*[F.slice(f"g{k}", F.col("seg") - F.col("base") + 1 + j, starts).alias(f"g{k}_{j}") for k, j in columns])
    df = df.select(*keep, "size", "seg", "base", "words", F.posexplode_outer(zipped).alias("i", "x"))
    start, found = F.col("seg") + F.col("i"), []
    for n in lengths:
        k = min(gram, n)
        tagged = [F.col(f"x.g{k}_{j}").bitwiseAND(F.lit(~tags)).bitwiseOR(F.lit(tags - 1 - j)) for j in range(n - k + 2)]
        before, m = (F.least(*c) if len(c) > 1 else c[0] for c in (tagged[:-1], tagged[1:]))
        place = start + (tags - 2 - m.bitwiseAND(F.lit(tags))).cast("int")
        new = (start + n <= F.col("size")) & ((start == 0) | (m != before))
        found.append((new, F.lit(n).alias("n"), m.bitwiseAND(F.lit(~tags)).alias("f"), place.alias("at")))
    if len(found) == 1:
        new, *columns = found[0]
        return df.where(new).select(*keep, *columns, "base", "words")
    # no lambda here: the words must stay inside generated code, where rows of one text share them
    each = F.array(*[F.when(new, F.struct(*columns)) for new, *columns in found])
    return df.select(*keep, "base", "words", F.explode_outer(each).alias("y")).where("y is not null").select(*keep, "y.n", "y.f", "y.at", "base", "words")


def surroundings(df: DataFrame, keep: list[str], gram: int) -> DataFrame:
    """``keep``, n, f, at, and the words round the gram as far as a window can reach, ``before`` of them before it."""
    at = F.col("at") - F.col("base")
    before = F.least(at, F.col("n") - F.least(F.lit(gram), F.col("n")))
    return df.select(*keep, "n", "f", "at", before.alias("before"), F.slice("words", at - before + 1, before + F.col("n")).alias("around"))


def sides(left: str, right: str) -> tuple[Column, Column]:
    """Of surroundings: the words before the gram, nearest first, and those from it on."""
    return F.reverse(F.slice("around", F.lit(1), F.col("before"))).alias(left), F.slice("around", F.col("before") + 1, F.col("n")).alias(right)


def equal_start(a: str, b: str, most: int) -> Column:
    """How many first words of two arrays are equal, up to ``most``."""
    out = None
    for i in range(most):
        differ = ~F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
        out = F.when(differ, i) if out is None else out.when(differ, i)
    return F.lit(0) if out is None else out.otherwise(most)


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10, gram: int = 5, broadcast_windows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, start, end, cid) of the spans of words that windows of an item cover, and (cid, item_id).

    ``th`` is the hash of the text, which keeps different rows of one id apart; ``cid`` is a place of an item with
    its surroundings.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = materialise(items, "items")
    lengths = sorted({r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()})
    if not lengths:
        spark = docs.sparkSession
        return spark.createDataFrame([], "doc_id long, th long, start int, end int, cid long"), spark.createDataFrame([], "cid long, item_id long")
    own = None
    for n in lengths:
        part = fingerprints(items.where(F.size("words") == n) if n < window else items.where(F.size("words") >= n), ["item_id"], [n], gram, window)
        own = part if own is None else own.union(part)
    own = materialise(surroundings(own, ["item_id"], gram).select("item_id", "n", "f", *sides("left", "right")), "bench-places")
    key = ["n", "f", "left", "right"]
    places = materialise(own.select(*key).distinct().withColumn("cid", F.monotonically_increasing_id()), "bench-different")
    members = own.join(places, key).select("cid", "item_id").distinct()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), words(F.col(text)).alias("words"))
    theirs, hashes = fingerprints(d, ["doc_id", "th"], lengths, gram, window), places.select("n", "f").distinct()
    small = places.count() <= broadcast_windows
    if small:
        met = theirs.join(F.broadcast(hashes), ["n", "f"], "left_semi")
    else:
        met = materialise(theirs.drop("words", "base").distinct().join(hashes, ["n", "f"], "left_semi"), "bench-met").alias("m")
        same = F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.th") == F.col("d.th"))
        met = d.alias("d").join(met, same).select("m.doc_id", "m.th", "words", F.lit(0).alias("base"), "n", "f", "at")
    # written here, which also keeps the generated code of the scan short enough for the JVM to compile
    near = materialise(surroundings(met, ["doc_id", "th"], gram), "bench-near").select("doc_id", "th", "n", "f", "at", *sides("dl", "dr"))
    got = near.join(F.broadcast(places) if small else places, ["n", "f"])
    got = got.select("doc_id", "th", "n", "at", "cid", equal_start("left", "dl", max(n - min(gram, n) for n in lengths)).alias("l"), equal_start("right", "dr", max(lengths)).alias("r"))
    # the gram itself is equal, and with it at least one window
    hits = got.where((F.col("r") >= F.least(F.lit(gram), "n")) & (F.col("l") + F.col("r") >= F.col("n")))
    hits = hits.select("doc_id", "th", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"), "cid")
    return materialise(hits.distinct(), "bench-hits"), materialise(members, "bench-members")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10, gram: int = 5, keep: tuple[str, ...] = (), broadcast_windows: int = 200_000) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and ``keep``.

    A word is hit if it is inside any occurrence of a window of any item. Null and empty texts have no words
    and no hits; items of null id are left out; a benchmark without words hits nothing. Rows that share an
    id are judged by their own texts; equal rows agree.
    """
    hits, members = find_hits(docs, benchmark, doc_id, text, window, gram, broadcast_windows)
    key = ["doc_id", "th"]
    end = F.col("end")
    w = W.partitionBy(*key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select(*key, "start", "end").distinct().withColumn("before", F.coalesce(F.max(end).over(w), F.lit(0)))
    covered = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    found = hits.select(*key, "cid").distinct().join(members, "cid").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    found = found.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    side = covered.join(found, [covered[k].eqNullSafe(found[k]) for k in key]).select(covered["doc_id"].alias("_d"), covered["th"].alias("_t"), "n_hit", "n_items", "items")
    side = materialise(side, "contaminated")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), F.size(words(F.col(text))).cast("long").alias("n_words"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    out = rows.join(side, rows["doc_id"].eqNullSafe(side["_d"]) & (rows["th"] == side["_t"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("doc_id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)]
    )
