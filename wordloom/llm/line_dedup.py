"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. Its tokens are ordered by rarity; two lines of Jaccard 0.8 or
more share a token in short prefixes of that order, at positions and with sizes that bound what they can
have in common. Candidates that pass these filters, a parity test and, if they are long, a test of how many
prefix tokens they share (exact bounds as well) are verified on their words, and a line that an earlier one
resembles is removed. Two lines that share neighbouring tokens are paired through the first of them.

Rarity comes from counts of all words in 2**18 hash buckets, kept in four bits each: a table of fixed size
that is part of the plan; any order that is the same for all lines keeps the join exact. Lines of equal text
are one class, represented by its first line. Before the full join, a few tokens of each prefix, those of least hash
and thus mostly the same ones in near copies, propose their earliest line to all others, so a large group of
near copies is settled by rows in proportion to its size and does not meet itself pair by pair. Lines that were near
the earliest one but not alike get a second proposal, of the earliest lines of a fixed number of parts of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_RE, Scratch, materialise

BUCKET_BITS = 18
#: Tokens of a line by which its earliest likeness is sought before the full join.
PROPOSING = 4
#: Parts of a token's lines of which each proposes its earliest one to lines that the first proposal did not settle.
PARTS = 16
#: Tokens from which on a line has the second half of its parity bits.
LONG = 80
#: Parity bits in which a pair may differ, from which on the shared prefix tokens are counted too.
WEAK_BITS = 40
_31 = (1 << 31) - 1


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line, h): every line that has a word; h is the hash of its text."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return d.where(F.ltrim("line", F.lit(" \t\x0b\x0c\r")) != "").withColumn("h", F.xxhash64("line"))


def split_words(line: Column) -> Column:
    """The lower-cased words of a line, and empty strings at its ends and between spaces; lines of plain spaces take the short way."""
    low, other = F.lower(line), F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.split(low, SPACE_RE)).otherwise(F.split(low, " "))


def tokens(line: Column) -> Column:
    """The distinct lower-cased words of a line."""
    return F.array_remove(F.array_distinct(split_words(line)), "")


def rarity(lines: DataFrame, scratch: Scratch) -> Column:
    """Sixteen levels of each bucket's count of words, sixteen buckets a long, as one constant array.

    A level is a binary order of magnitude, from an eighth of the mean bucket's count up. It is stored with
    its upper bit turned, so that levels compare rightly as the four upper bits of a signed long.
    """
    each = lines.select(F.explode(split_words(F.col("line"))).alias("t"))
    counts = scratch.table(each.groupBy(F.shiftrightunsigned(F.xxhash64("t"), 64 - BUCKET_BITS).cast("int").alias("b")).count())
    least = max(0, ((counts.agg(F.sum("count")).first()[0] or 0) >> BUCKET_BITS).bit_length() - 4)
    level = F.least(F.lit(15), F.greatest(F.lit(0), F.floor(F.log2("count")) - least)).cast("long").bitwiseXOR(F.lit(8).cast("long"))
    nibble = F.call_function("shiftleft", level, F.col("b").bitwiseAND(F.lit(15)) * 4)
    levels = ["0"] * (1 << BUCKET_BITS - 4)
    for at, x in counts.groupBy(F.shiftright("b", 4)).agg(F.bit_or(nibble)).collect():
        levels[at] = str(x)
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>")


def enough(common: Column, both: Column, t: int) -> Column:
    """Whether sets with ``both`` tokens together can have Jaccard of t hundredths or more with at most ``common`` common ones."""
    return common * (100 + t) >= both * t


def may_differ(bits: Column | int, both: Column, t: int) -> Column:
    """Whether sets with ``both`` tokens together can have such a Jaccard and differ in ``bits`` tokens or more."""
    return both * (100 - t) >= bits * (100 + t)


def beyond_prefix(size: Column, t: int) -> Column:
    """Tokens of a line after its probing prefix."""
    return F.ceil(size * t / F.lit(100.0) - 1e-9) - 1


def repeated_lines(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, Column]:
    """(h, first) of lines whose text occurs more than once, how many, and a line's place in the order (doc_id, line_no).

    A place is one long where ids are whole numbers that leave 22 bits for the line number, which the same
    pass finds out, else a struct.
    """
    lines, wide = lines_of(docs), F.struct("doc_id", "line_no")

    def twice(h: Column, place: Column) -> DataFrame:
        return scratch.table(lines.groupBy(h.alias("h")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1 or h is null").select("h", "first"))

    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        id_, place = F.col("doc_id").cast("long"), F.shiftleft(F.col("doc_id").cast("long"), 22).bitwiseOR(F.col("line_no").cast("long"))
        fits = id_.between(-(1 << 40), (1 << 40) - 1) & (F.col("line_no") < 1 << 22)
        repeated = twice(F.when(fits, F.col("h")), place)  # lines that do not fit meet in the group of null
        n, far = repeated.agg(F.count("*"), F.count_if(F.col("h").isNull())).first()
        if not far:
            return repeated, n, place
    repeated = twice(F.col("h"), wide)
    return repeated, repeated.count(), wide


def signatures(lines: DataFrame, levels: Column, t: int, place: Column) -> DataFrame:
    """(h, place, size, parity bits, probing prefix) of each line, of which 32 bits a token."""
    shift = F.call_function
    y = F.array_remove(F.array_distinct(F.transform(split_words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # rarity on top, the hash below it: a line's tokens from the rarest to the most frequent
    level = lambda y: shift("shiftrightunsigned", F.get(levels, F.shiftrightunsigned(y, 68 - BUCKET_BITS).cast("int")), F.shiftrightunsigned(y, 62 - BUCKET_BITS).bitwiseAND(F.lit(60)).cast("int"))
    rank = lambda y: F.shiftleft(level(y), 60).bitwiseOR(F.shiftrightunsigned(y, 4))
    rows = lines.select("h", place.alias("place"), F.sort_array(F.transform(y, rank)).alias("x"))
    # 128 parity bits in two longs, the second for longer lines only: two sets differ in at least as many tokens as their bits differ
    one, size = F.lit(1).cast("long"), F.size("x")
    bit = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    parity = F.aggregate("x", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(shift("shiftleft", one, bit(x))))
    half = F.aggregate("x", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(shift("shiftleft", F.shiftright(x, 6).bitwiseAND(one), bit(x))))
    prefix = F.transform(F.slice("x", F.lit(1), (size - beyond_prefix(size, t)).cast("int")), lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int"))
    return rows.select("h", "place", size.alias("size"), parity.alias("sig"), F.when(size >= LONG, half).otherwise(F.lit(0).cast("long")).alias("sig2"), prefix.alias("prefix"))


def changed_lines(docs: DataFrame, t: int, broadcast_lines: int) -> tuple[DataFrame, Column]:
    """(h, first, gone) of lines whose text is repeated or resembles an earlier line, and a line's place; docs has doc_id and text."""
    scratch = Scratch(docs.sparkSession, "lines")
    repeated, n_repeated, place = repeated_lines(docs, scratch)
    lines = lines_of(docs).withColumn("place", place)
    few = n_repeated <= broadcast_lines
    if few:  # only the first line of each class goes on
        lines = lines.join(F.broadcast(repeated), "h", "left").where(F.col("first").isNull() | (F.col("first") == F.col("place")))
    sigs = signatures(lines, rarity(lines, scratch), t, F.col("place"))
    if not few:  # lines of equal text are merged when they are short rows
        sigs = sigs.groupBy("h").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("size", "sig", "sig2", "prefix")])
    sigs = scratch.table(sigs)
    whole = sigs.schema["place"].dataType == T.LongType()

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_lines else df

    def alike(size: Column, o_size: Column, sig: Column, o_sig: Column, sig2: Column, o_sig2: Column) -> Column:
        """The size and parity filters."""
        d, d2 = sig.bitwiseXOR(o_sig), sig2.bitwiseXOR(o_sig2)
        differ = F.when(F.least(size, o_size) >= LONG, F.bit_count(d.bitwiseXOR(d2)) + F.bit_count(d2)).otherwise(F.bit_count(d))
        return (size * 100 >= o_size * t) & (o_size * 100 >= size * t) & may_differ(differ, size + o_size, t)

    def words_of_lines(pairs: DataFrame) -> DataFrame:
        """(place, w): the words of all lines of ``pairs``."""
        wanted = scratch.table(pairs.select("place").union(pairs.select("o")).distinct())
        if few := wanted.count() <= broadcast_lines:  # then only the documents of these lines are split
            ids = wanted.select((F.shiftright("place", 22) if whole else F.col("place.doc_id")).alias("doc_id")).distinct()
            some = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        words = lines_of(some if few else docs).select(place.alias("place"), "line").join(F.broadcast(wanted) if few else wanted, "place", "left_semi")
        return scratch.table(words.select("place", tokens(F.col("line")).alias("w")))

    def similar(pairs: DataFrame, words: DataFrame) -> DataFrame:
        """The places of pairs whose word sets really are that similar."""
        p = pairs.join(words, "place").select("place", "o", F.col("w").alias("a")).join(words.select(F.col("place").alias("o"), F.col("w").alias("b")), "o")
        common = F.size(F.array_intersect("a", "b"))
        return scratch.table(p.where(common * 100 >= (F.size("a") + F.size("b") - common) * t).select("place").distinct())

    def earliest(dealt: DataFrame, *by: str) -> DataFrame:
        """The earliest line of each value of ``by`` and how many lines there are."""
        return dealt.groupBy(*by).agg(F.min("place").alias("o"), F.min_by("size", "place").alias("o_size"), F.min_by("sig", "place").alias("o_sig"), F.min_by("sig2", "place").alias("o_sig2"), F.count("size").alias("n"))

    def proposed(dealt: DataFrame, first: DataFrame) -> DataFrame:
        """Pairs of a line and an earlier one of the same token that pass the filters."""
        near = dealt.join(first, "token").where((F.col("o") < F.col("place")) & alike(*[F.col(c) for c in ("size", "o_size", "sig", "o_sig", "sig2", "o_sig2")]))
        return near.select("place", "o").distinct()

    # a few tokens are enough to propose: what this round leaves, the next one meets in full
    columns = ["place", "size", "sig", "sig2", "token"]
    dealt = sigs.select("place", "size", "sig", "sig2", F.explode(F.slice(F.sort_array("prefix"), 1, PROPOSING)).alias("token"))
    # none of these is ever null; said here, it is below the exchange, which aggregation and join then share
    dealt = dealt.where(" and ".join(f"{c} is not null" for c in columns)).repartition("token")
    near = scratch.table(proposed(dealt, earliest(dealt, "token").where("n > 1").drop("n")))
    words = words_of_lines(near)
    found = similar(near, words)
    # lines that were near one and not alike belong to looser groups, whose lines would meet each other pair by pair:
    # they get the earliest line of each of several parts of a group, out of those whose words are at hand
    close = sigs.join(small(words.select("place")), "place", "left_semi").select("place", "size", "sig", "sig2", F.explode(F.slice(F.sort_array("prefix"), 1, PROPOSING)).alias("token"))
    heads = earliest(close.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(PARTS))), "token", "part").drop("part", "n")
    again = scratch.table(proposed(close.join(small(found), "place", "left_anti"), heads).join(near, ["place", "o"], "left_anti"))
    found = scratch.table(found.union(similar(again, words)))
    # size and position in one long, with a mark for those that are settled
    meta = F.shiftleft(F.col("size").cast("long"), 31).bitwiseOR(F.col("pos").cast("long")).bitwiseOR(F.when(F.col("gone"), F.lit(1 << 62)).otherwise(F.lit(0)))
    flagged = sigs.join(small(found).withColumn("gone", F.lit(True)), "place", "left").select("place", "size", "sig", "sig2", F.coalesce("gone", F.lit(False)).alias("gone"), "prefix", F.posexplode("prefix").alias("pos", "token"))
    flagged = flagged.select("token", F.get("prefix", F.col("pos") - 1).alias("last"), "place", meta.alias("meta"), "sig", "sig2")
    # one frame joined with itself, and no condition of one side alone, so that both sides read one exchange
    get = lambda side, c: F.col(f"{side}.{c}")
    size, o_size = (F.shiftrightunsigned(get(s, "meta"), 31).bitwiseAND(F.lit(_31)) for s in "ab")
    pos, o_pos = (get(s, "meta").bitwiseAND(F.lit(_31)) for s in "ab")
    open_ = get("a", "meta") < (1 << 62)
    # whichever of the two is smaller is met through its shorter, indexing prefix; long pairs through all tokens, which are counted
    indexed = lambda size, pos: size * (2 * t) <= (size - pos) * (100 + t)
    weak = lambda size, o_size: may_differ(WEAK_BITS, size + o_size, t)
    repeats = F.coalesce(get("a", "last") == get("b", "last"), F.lit(False))
    through = weak(size, o_size) | (~repeats & F.when(o_size <= size, indexed(o_size, o_pos)).otherwise(indexed(size, pos)))
    room = enough(1 + F.least(size - pos - 1, o_size - o_pos - 1) + F.least(pos, o_pos), size + o_size, t)
    # what is cheap and rare first: most pairs of a token end at their order or at the parity test
    like = alike(size, o_size, get("a", "sig"), get("b", "sig"), get("a", "sig2"), get("b", "sig2"))
    pair = flagged.alias("a").join(flagged.alias("b"), get("a", "token") == get("b", "token")).where((get("b", "place") < get("a", "place")) & F.when(open_, like).otherwise(False) & through & room)
    pair = pair.select(get("a", "place"), get("b", "place").alias("o"), size.alias("size"), o_size.alias("o_size")).groupBy("place", "o").agg(F.first("size").alias("n"), F.first("o_size").alias("m"), F.count("*").alias("shared"))
    # what two lines have in common is in both prefixes or after the prefix that ends first
    n, m = F.col("n"), F.col("m")
    pair = pair.where(~weak(n, m) | enough(F.col("shared") + F.greatest(beyond_prefix(n, t), beyond_prefix(m, t)), n + m, t))
    pair = scratch.table(pair.select("place", "o"))
    later = found.union(similar(pair, words_of_lines(pair))).distinct()
    gone = sigs.select("h", "place").join(small(later), "place", "left_semi").select("h", F.col("place").alias("first"), F.lit(True).alias("gone"))
    # of a class that is both, one row: the one that says so
    out = gone.union(repeated.select("h", "first", F.lit(False))).groupBy("h").agg(F.min("first").alias("first"), F.max("gone").alias("gone"))
    out = materialise(out, "lines-changed")
    scratch.drop()
    return out, place


def judged(docs: DataFrame, doc_id: str, text: str, t: int, broadcast_lines: int, how: str) -> DataFrame:
    """(doc_id, line_no, removed) of every line (``how`` is left) or of lines of changed classes (inner)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    changed, place = changed_lines(docs, t, broadcast_lines)
    side = F.broadcast(changed) if changed.count() <= broadcast_lines else changed
    lines = lines_of(docs).select("h", "doc_id", "line_no").join(side, "h", how)
    return lines.select("doc_id", "line_no", F.coalesce(F.col("gone") | (F.col("first") < place), F.lit(False)).alias("removed"))


def later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: int = 80, broadcast_lines: int = 1_000_000) -> DataFrame:
    """(doc_id, line_no, removed) of every line that has a word.

    A line is removed if an earlier one, by (doc_id, line number), has Jaccard of ``t`` hundredths or more
    with it on sets of lower-cased words; lines without words are never removed and not returned. An earlier
    line counts whether or not it is removed itself. Rows that share an id and a line number are equally
    early and judged together; a null id comes first; ids of any type that can be ordered will do. Null
    texts have no lines, and other columns of ``docs`` are not looked at. Places and hashes of lines are
    broadcast only up to ``broadcast_lines`` of them, and joined by shuffling beyond.
    """
    return judged(docs, doc_id, text, t, broadcast_lines, "left")


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: int = 80, broadcast_lines: int = 1_000_000) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) of every row: its lines that have a word, and the numbers of those removed, from 0.

    Rows that share an id share the numbers removed, as far as they have such lines.
    """
    removed = judged(docs, doc_id, text, t, broadcast_lines, "inner").where("removed").groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    own = F.transform(F.split(F.col(text), "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = docs.select(F.col(doc_id).alias("doc_id"), own.alias("own")).join(removed, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    out = out.withColumn("gone", F.filter(F.coalesce("gone", F.array().cast("array<int>")), lambda i: F.coalesce(F.get("own", i), F.lit(False))))
    n_lines = F.when(F.col("own").isNull(), 0).otherwise(F.size(F.filter("own", lambda x: x)))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed_lines"))


def drop_later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: int = 80, broadcast_lines: int = 1_000_000) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; all rows and other columns, whatever their names, stay; a text without any line left is empty.

    The numbers of the removed lines are broadcast up to ``broadcast_lines`` of them; beyond, the texts are shuffled to them.
    """
    gone = judged(docs, doc_id, text, t, broadcast_lines, "inner").where("removed").groupBy(F.col("doc_id").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    gone = materialise(gone, "line-gone")
    some = gone.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0] <= broadcast_lines
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    d = rows.join(F.broadcast(gone) if some else gone, F.col("_row")[doc_id].eqNullSafe(F.col("_key")), "left")
    lines = F.split(F.col("_row")[text], "\n")
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull()), "\n")
    return d.select(*[F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col("_row")[text]).alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
