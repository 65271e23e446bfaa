"""Merkle manifest of a dataset, with a proof for every document by coordinate look-ups.

A document is a leaf: the SHA-256 of its columns, each with its length. The leaves of a source, in the order
of their ids, are the first level of a tree with ``fan`` children a node; the roots of the sources are the
first level of one more tree, whose root stands for the dataset.

A node's coordinates are (tree, level, place). From its index and the size of its tree a leaf knows the
coordinates of all siblings on its way up; they are exploded, joined with the written nodes, put in order and
folded. ``DEPTH`` levels are made in one step: a step reads blocks of at most ``fan ** DEPTH`` nodes and
leaves one node of each, so there are few steps (four for 3 ** 24 leaves), and a look-up never leaves its
block. What lies above a block is looked up once for the block and handed down, so no node is asked for by
more than the leaves of one block, and no key of any join is shared by more rows than that. Digests travel as
32 bytes, and a leaf's siblings are put together where its block's upper part arrives, so finished proofs are
never shuffled.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise
from .order import indexed

FAN = 3
DEPTH = 4
STEPS = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def joined(hashes: Column) -> Column:
    """Digests of 32 bytes as hex text, concatenated."""
    return F.array_join(F.transform(hashes, as_text), "")


def as_text(digest32: Column) -> Column:
    return F.lower(F.hex(digest32))


@dataclass
class Tier:
    """``depth`` levels of all trees: the nodes they start from (g, n, i, hash and more) and, by blocks, every node in them."""

    base: DataFrame
    blocks: DataFrame
    fan: int
    depth: int

    @property
    def width(self) -> int:
        return self.fan**self.depth

    def nodes(self) -> DataFrame:
        """(g, level, i, hash) of the levels below the next tier."""
        n = self.blocks.select("g", "b", F.posexplode("levels").alias("level", "hashes")).where(F.col("level") < self.depth)
        n = n.select("g", "b", "level", F.posexplode("hashes").alias("j", "hash"))
        per_block = functools.reduce(lambda c, k: c.when(F.col("level") == k, F.lit(self.fan ** (self.depth - k))), range(1, self.depth), F.when(F.col("level") == 0, F.lit(self.width)))
        return n.select("g", "level", (F.col("b") * per_block + F.col("j")).alias("i"), "hash")

    def above(self) -> DataFrame:
        """(g, n, i, hash) that the next tier starts from: one node for each block."""
        return self.blocks.select("g", F.ceil(F.col("n") / self.width).alias("n"), F.col("b").alias("i"), F.element_at(F.element_at("levels", -1), 1).alias("hash"))


def climb(base: DataFrame, scratch: Scratch, fan: int = FAN, depth: int = DEPTH) -> list[Tier]:
    """Tiers until every tree has one node. ``base``: (g, n, i, hash), n the nodes of tree g, i from 0 to n - 1."""
    tiers, width = [], fan**depth

    def parents(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / fan).cast("int")), lambda j: F.unhex(digest(joined(F.slice(hashes, j * fan + 1, fan)))))

    while True:
        b = base.groupBy("g", "n", F.floor(F.col("i") / width).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("x"))  # at most `width`
        first = F.array(F.transform("x", lambda x: x["hash"]))
        grow = lambda acc, k: F.when(F.col("n") > F.pow(F.lit(fan), k), F.concat(acc, F.array(parents(F.element_at(acc, -1))))).otherwise(acc)
        blocks = scratch.table(b.select("g", "n", "b", F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), first, grow).alias("levels")))
        tiers.append(Tier(base, blocks, fan, depth))
        base = tiers[-1].above()
        if (blocks.agg(F.max("n")).first()[0] or 0) <= width:
            return tiers


def steps_of(tier: Tier) -> DataFrame:
    """(b, steps) added to each node a tier starts from: its block, and for each level the siblings to the left and to the right, concatenated."""
    fan, levels, i = tier.fan, range(tier.depth), F.col("i")
    own = [F.floor(i / fan**k) for k in levels]
    coords = []
    for k in levels:
        run = F.floor(i / fan ** (k + 1)) * fan
        for o in range(fan):
            coords.append(F.when((run + o != own[k]) & (run + o < F.ceil(F.col("n") / fan**k)), F.struct(F.lit(k).alias("level"), (run + o).alias("at"))))
    asked = tier.base.select("g", "i", F.explode(F.array_compact(F.array(*coords))).alias("c")).select("g", "i", "c.level", "c.at")
    found = asked.join(tier.nodes().withColumnRenamed("i", "at"), ["g", "level", "at"])
    block = F.floor(i / tier.width).alias("b")
    found = found.select("g", block, "i", F.struct("level", "at", "hash").alias("sibling"))
    rest = [c for c in tier.base.columns if c not in ("g", "i")]
    rows = tier.base.select("g", block, "i", F.struct(*rest).alias("rest"))
    # one exchange by blocks, on which grouping and the join with the blocks' upper parts both stand
    both = found.unionByName(rows, allowMissingColumns=True).repartition("g", "b")
    rows = both.groupBy("g", "b", "i").agg(F.array_sort(F.collect_list("sibling")).alias("siblings"), F.first("rest", ignorenulls=True).alias("rest"))  # at most (fan - 1) * depth
    rows = rows.select("g", "b", "i", "siblings", "rest.*")

    def side(k: int, left: bool) -> Column:
        return joined(F.transform(F.filter("siblings", lambda x: (x["level"] == k) & ((x["at"] < own[k]) if left else (x["at"] > own[k]))), lambda x: x["hash"]))

    steps = F.array_compact(F.array(*[F.when(F.col("n") > fan**k, F.struct(side(k, True).alias("left"), side(k, False).alias("right"))) for k in levels]))
    return rows.select("g", "b", "i", *rest, steps.alias("steps"))


def proofs(tiers: list[Tier], above: DataFrame) -> DataFrame:
    """The nodes that the first tier starts from with steps and subroot. ``above``: (g, upper, subroot), what stands over each tree."""
    above = above.select("g", F.lit(0).cast("long").alias("b"), "upper", "subroot")
    for tier in reversed(tiers):
        own = steps_of(tier).join(above, ["g", "b"]).withColumn("steps", F.concat("steps", "upper")).drop("b", "upper")
        above = own.select("g", F.col("i").alias("b"), F.col("steps").alias("upper"), "subroot")
    return own


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings over it give."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", source: str = "source", changed: dict[str, Column] | None = None, with_steps: bool = True, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, steps.

    ``steps`` are the siblings to the left and to the right, concatenated, level by level up to the root;
    ``proof_sha256`` is the digest of all of them in that order. ``changed`` gives, for some columns, the
    values of a copy whose leaves are to be checked against the manifest: ``folded_root`` is what the copy's
    leaf and the original siblings give, ``verified`` whether it is the root. Ids ascend with null first; rows
    that share source and id are ordered by their leaf, and equal rows stand side by side, each a leaf of its
    own. Null source is a source of its own and comes first. A source of one document has its leaf as subroot;
    a dataset of one document has its leaf as root. No rows give no rows. Other columns of any name are
    ignored. The result is written to the shared folder and what was needed on the way is deleted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    leaf = F.unhex(digest(*[encoded(F.col(c)) for c in columns]))
    copy = F.unhex(digest(*[encoded((changed or {}).get(c, F.col(c))) for c in columns]))
    key = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))  # null first
    leaves = scratch.table(docs.select(F.col(doc_id).alias("id"), key.alias("key"), leaf.alias("leaf"), copy.alias("copy")))
    rows = indexed(leaves, "key", ["id", "leaf"], scratch)
    rows = scratch.table(rows.select(F.col("group_no").alias("g"), F.col("group_size").alias("n"), F.col("index").alias("i"), F.col("leaf").alias("hash"), "id", "copy"))
    tiers = climb(rows, scratch, fan, depth)
    roots = tiers[-1].above().select("g", F.col("hash").alias("subroot"))
    sources = roots.agg(F.count("*")).first()[0]
    top = climb(roots.select(F.lit(0).cast("long").alias("g"), F.lit(sources).cast("long").alias("n"), F.col("g").alias("i"), F.col("subroot").alias("hash")), scratch, fan, depth)
    last = top[-1].above().select(as_text(F.col("hash"))).first()
    root = F.lit(last[0] if last else None).cast("string")
    over = proofs(top, spark.range(1).select(F.col("id").alias("g"), F.array().cast(STEPS).alias("upper"), F.lit(None).cast("binary").alias("subroot")))
    over = over.select(F.col("i").alias("g"), F.col("steps").alias("upper"), F.col("hash").alias("subroot"))
    out = proofs(tiers, over).select(F.col("id").alias(doc_id), as_text(F.col("hash")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"), "steps", fold(as_text(F.col("copy")), F.col("steps")).alias("folded_root"))
    proof = digest(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))
    out = out.select(doc_id, "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["steps"] if with_steps else []))
    out = materialise(out, "merkle-proofs")
    scratch.drop()
    return out
