"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Shards own many points of a ring. A document starts at the first point clockwise from the hash of its id and
takes the first shard on its walk that is not full. Documents come in the order of a second hash, so this is
well defined: who is turned away by a full shard depends on no order of rows or tasks.

It needs no sequential pass. While no shard fills up, everyone goes to the first open shard of their walk;
so all that is needed is the moment at which the next shard fills, at most once a shard. That moment is found
by counting arrivals in 1,024 bins of the order, then in 1,024 bins of the bin that holds it, until few
documents are left. With all moments known each row finds its shard by itself: the first on its walk that
is not full at the row's own moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, materialise
from .order import indexed

#: Bits of a hash, of a place on the ring and of one bin.
BITS, RING_BITS, BIN_BITS = 60, 14, 10
#: Documents that may be put in order in one task.
FEW = 1 << 14


def draw(seed: int, what: str, *parts: Column) -> Column:
    """A whole number of 60 bits from the parts alone."""
    text = F.concat_ws(":", F.lit(f"{what}{seed}"), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def place(point: Column) -> Column:
    return F.shiftright(point, BITS - RING_BITS)


def ring(spark: SparkSession, shards: int, points: int, seed: int) -> DataFrame:
    """(place, walk): the shards in the order in which a walk from a place of the ring meets them.

    2 ** 14 rows of at most ``shards`` numbers, however large the input. Shard s has the same points whatever
    ``shards`` is, so one more shard moves only what its own points take and what bounded loads pass on.
    """
    p = spark.range(shards * points).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("k"))
    p = p.agg(F.array_sort(F.collect_list(F.struct(draw(seed, "point", F.col("shard"), F.col("k")).alias("at"), "shard"))).alias("all"))
    first = p.select("all", F.lit(0).alias("j"), F.lit(None).cast("struct<at:bigint,shard:int>").alias("x"))  # past the last point the walk begins anew
    arcs = p.select("all", F.posexplode("all").alias("j", "x")).unionByName(first)
    until = F.when(F.col("x").isNull(), F.lit((1 << RING_BITS) - 1)).otherwise(place(F.col("x.at")))
    since = F.when(F.col("x").isNull(), place(F.element_at("all", -1)["at"]) + 1).when(F.col("j") == 0, 0).otherwise(place(F.element_at("all", F.greatest(F.col("j"), F.lit(1)))["at"]) + 1)
    walk = F.array_distinct(F.transform(F.concat(F.slice("all", F.col("j") + 1, F.size("all")), F.slice("all", F.lit(1), F.col("j"))), lambda v: v["shard"]))
    arcs = arcs.select(since.alias("since"), until.alias("until"), walk.alias("walk")).where("since <= until")
    return arcs.select(F.explode(F.sequence("since", "until")).alias("place"), "walk")


def open_shard(walk: Column, full: dict[int, tuple[int, int]]) -> Column:
    """The first shard on a walk whose moment, if it has one, is not over for the row (``order``, ``row``)."""
    if not full:
        return F.element_at(walk, 1)
    def still(s: Column) -> Column:
        ok = F.lit(True)
        for shard, (order, row) in full.items():
            ok = F.when(s == shard, (F.col("order") < order) | ((F.col("order") == order) & (F.col("row") <= row))).otherwise(ok)
        return ok

    return F.element_at(F.filter(walk, still), 1)


def next_full(rest: DataFrame, room: dict[int, int], rows: int) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """The moment at which the first of the open shards fills up, and how many each has taken by then.

    ``rest``: (shard, order, row) of the documents still to come, ``room`` what each open shard still takes.
    """
    taken = dict.fromkeys(room, 0)
    digits = [F.shiftright(F.col(c), BITS - BIN_BITS * (k + 1)).bitwiseAND((1 << BIN_BITS) - 1) for c in ("order", "row") for k in range(BITS // BIN_BITS)]
    for digit in digits:
        if rows <= FEW:
            break
        left = F.element_at(F.create_map(*[F.lit(v) for s in room for v in (s, room[s] - taken[s])]), F.col("shard"))
        bins = rest.groupBy("shard", digit.alias("bin")).count()  # at most shards x 1,024 rows
        sums = bins.withColumn("upto", F.sum("count").over(W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
        at = sums.agg(F.min(F.when(F.col("upto") >= left, F.col("bin"))).alias("at"))
        got = sums.crossJoin(F.broadcast(at)).groupBy("shard", "at").agg(F.sum(F.when(F.col("bin") < F.col("at"), F.col("count"))).alias("before"), F.sum(F.when(F.col("bin") == F.col("at"), F.col("count"))).alias("here")).collect()
        for r in got:
            taken[r["shard"]] += r["before"] or 0
        rest, rows = rest.where(digit == got[0]["at"]), sum(r["here"] or 0 for r in got)
    left = F.element_at(F.create_map(*[F.lit(v) for s in room for v in (s, room[s] - taken[s])]), F.col("shard"))
    placed = rest.withColumn("nth", F.row_number().over(W.partitionBy("shard").orderBy("order", "row")))
    m = placed.where(F.col("nth") == left).agg(F.min(F.struct("order", "row", "shard")).alias("m")).first()["m"]
    for r in rest.where((F.col("order") < m["order"]) | ((F.col("order") == m["order"]) & (F.col("row") <= m["row"]))).groupBy("shard").count().collect():
        taken[r["shard"]] += r["count"]
    return {m["shard"]: (m["order"], m["row"])}, taken


def shard_documents(docs: DataFrame, shards: int = 8, points: int = 256, slack: float = 0.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, home, shard, slot.

    A shard takes its share of all rows, ``(1 + slack)`` times as many if ``slack`` is above 0, rounded up;
    without slack the shares are whole numbers that sum to the rows, so that counts are at most one apart.
    ``home`` is the first shard on the document's walk. ``slot`` counts a shard's documents from 0 without
    gaps. ``size`` is the text's UTF-8 bytes plus 1 (1 for null, whose checksum is null). Nothing is split by
    text: equal texts of different ids may part. Rows of null id start at one place of the ring, in an order
    drawn from their texts. Rows that repeat an id start at the same place and are turned away one by one, so
    an id that holds a third of all rows fills several shards. Equal rows are interchangeable. With fewer rows
    than shards some shards stay empty; no rows give no rows. Other columns of any name are ignored. The
    result is written to the shared folder and what was needed on the way is deleted.
    """
    spark, scratch = docs.sparkSession, None
    scratch = Scratch(spark, "shards")
    octets = F.col(text).cast("binary")
    d = docs.select(F.col(doc_id).alias("id"), (F.coalesce(F.octet_length(octets), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(octets).alias("text_crc32"))
    d = d.select("*", draw(seed, "key", F.col("id")).alias("key"), draw(seed, "order", F.col("id"), F.col("size"), F.col("text_crc32")).alias("order"))
    # sorted, so that later readings for the tail of the order skip row groups
    d = scratch.table(d.sortWithinPartitions("order").withColumn("row", F.monotonically_increasing_id()))
    walks = scratch.table(ring(spark, shards, points, seed))
    n = d.count()
    base, more = divmod(n, shards)
    room = {s: base + (s < more) if slack <= 0 else -(-int(n * (1 + slack) * 1000) // (1000 * shards)) for s in range(shards)}
    full: dict[int, tuple[int, int]] = {}
    last, coming = (-1, -1), n
    while n and len(full) < shards - 1:
        for s in [s for s in room if s not in full and room[s] <= 0]:
            full[s] = last
        still = {s: r for s, r in room.items() if s not in full}
        if len(still) <= 1 or not coming:
            break
        to = walks.select("place", F.element_at(F.filter("walk", lambda s: s.isin(list(still))), 1).alias("shard"))  # noqa: B023
        rest = d.where((F.col("order") > last[0]) | ((F.col("order") == last[0]) & (F.col("row") > last[1])))
        rest = rest.join(F.broadcast(to), place(F.col("key")) == F.col("place")).select("shard", "order", "row")
        if slack > 0:  # there may be no next one
            counts = {r["shard"]: r["count"] for r in rest.groupBy("shard").count().collect()}
            if all(counts.get(s, 0) < r for s, r in still.items()):
                break
        now, taken = next_full(rest, still, coming)
        for s, k in taken.items():
            room[s] -= k
        coming -= sum(taken.values())
        full |= now
        last = next(iter(now.values()))
    out = d.join(F.broadcast(walks), place(F.col("key")) == F.col("place"))
    out = out.select("id", "size", "text_crc32", "order", "row", F.element_at("walk", 1).alias("home"), open_shard(F.col("walk"), full).alias("shard"))
    out = indexed(out, "shard", ["order", "row"], scratch)
    out = materialise(out.select(F.col("id").alias(doc_id), "size", "text_crc32", "home", "shard", F.col("index").alias("slot")), "shards-placed")
    scratch.drop()
    return out
