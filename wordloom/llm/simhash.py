"""SimHash near-dedup: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints are 64-bit majorities over 3-word shingles. Distinct fingerprints are dealt into cells by the
bit counts of their two halves, cells into tiles of bounded size, and only tile pairs whose bit counts can
lie within the radius are compared; inside a pair the same test on the four quarters skips runs again. The
test is a bound (bit counts differ by no more than bits do), so no link is lost. A tile pair returns a
spanning forest of its links, never all of them, so a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, materialise, small_batches

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Rows of a tile at most, about: what one task compares is two of these.
TILE_ROWS = 32_768


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word n-grams, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        set_ += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(set_ * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; null and wordless texts have 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(x) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def quarter_counts(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)], axis=1).astype(np.int16)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with a[i] and b[j] at ``radius`` bits or fewer, by an exact scan of runs of equal quarter counts."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = lambda x: quarter_counts(x) @ np.array([17**3, 17**2, 17, 1], np.int64)
    ka, kb = key(a), key(b)
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    (ca, sa), (cb, sb) = np.unique(ka[oa], return_index=True), np.unique(kb[ob], return_index=True)
    ea, eb = np.append(sa[1:], len(a)), np.append(sb[1:], len(b))
    split = lambda c: np.stack([c // 17**3, c // 17**2 % 17, c // 17 % 17, c % 17], axis=1).astype(np.int16)
    va, vb, sorted_a, sorted_b = split(ca), split(cb), a[oa], b[ob]
    left, right = [], []
    for i in range(len(ca)):
        near = np.flatnonzero(np.abs(vb - va[i]).sum(axis=1) <= radius)
        if not len(near):
            continue
        at = np.concatenate([np.arange(s, e) for s, e in zip(sb[near].tolist(), eb[near].tolist(), strict=True)])
        theirs = sorted_b[at]
        step = max(1, (1 << 20) // len(at))
        for lo in range(int(sa[i]), int(ea[i]), step):
            own = sorted_a[lo : min(lo + step, int(ea[i]))]
            x, y = np.nonzero(np.bitwise_count(own[:, None] ^ theirs[None, :]) <= radius)
            if len(x):
                left.append(oa[lo + x])
                right.append(ob[at[y]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def spanning_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between tiles ``a`` and ``b`` (the same array: inside it), as two arrays of fingerprints.

    Rows of ``a`` go in blocks, and each block's links are folded into one union-find before the next, so
    what is held stays bounded by a block even where every pair links.
    """
    both = np.unique(np.concatenate([a, b]))
    parent, out = list(range(len(both))), []
    for lo in range(0, len(a), 2048):
        block = a[lo : lo + 2048]
        i, j = near_pairs(block, b, radius)
        x, y = np.searchsorted(both, block[i]), np.searchsorted(both, b[j])
        parent, used = forest(len(both), x, y, parent)
        out.append(np.stack([x[used], y[used]], axis=1))
    got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return both[got[:, 0]], both[got[:, 1]]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b) fingerprints whose links connect what all links connect, from one column ``fp``.

    Only the row counts of at most 33 x 33 cells come to the driver. Cells are merged into wider ones while
    a tile stays small, and split by hash where one cell is larger than a tile.
    """
    spark = distinct.sparkSession
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = distinct.select("fp", half(32).cast("int").alias("p"), half(0).cast("int").alias("q"))
    counts = {(r.p, r.q): r["count"] for r in cells.groupBy("p", "q").count().collect()}
    width = next(w for w in (33, 8, 4, 2, 1) if w == 1 or max(merged(counts, w).values(), default=0) <= tile_rows)
    tiles = {c: -(-n // tile_rows) for c, n in merged(counts, width).items()}
    gap = lambda x, y: max(0, (abs(x - y) - 1) * width + 1) if x != y else 0
    pairs, k = [], 0
    for c in sorted(tiles):
        for d in sorted(x for x in tiles if x >= c and gap(c[0], x[0]) + gap(c[1], x[1]) <= radius):
            for i in range(tiles[c]):
                for j in range(i if c == d else 0, tiles[d]):
                    pairs += [(*c, i, k, 0)] + ([(*d, j, k, 1)] if (c, i) != (d, j) else [])
                    k += 1
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    of = spark.createDataFrame(pd.DataFrame(pairs, columns=["p", "q", "tile", "pair", "side"]), "p int, q int, tile int, pair int, side int")
    n_tiles = spark.createDataFrame([(*c, n) for c, n in tiles.items()], "p int, q int, n int")
    dealt = cells.select("fp", F.floor(F.col("p") / width).cast("int").alias("p"), F.floor(F.col("q") / width).cast("int").alias("q"))
    dealt = dealt.join(F.broadcast(n_tiles), ["p", "q"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.join(F.broadcast(of) if len(pairs) <= 200_000 else of, ["p", "q", "tile"]).select("fp", "side", "pair")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, side = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy()
        own, other = fp[side == 0], fp[side == 1]
        x, y = spanning_links(own, other if len(other) else own, radius)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return dealt.groupBy("pair").applyInPandas(compare, "a long, b long")


def merged(counts: dict, width: int) -> dict:
    out: dict = {}
    for (p, q), n in counts.items():
        out[p // width, q // width] = out.get((p // width, q // width), 0) + n
    return out


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked through fingerprints at ``radius`` bits or fewer.

    Whole texts; A-Z lower-cased; words split at ASCII white space; a text of one or two words is one shingle;
    null, empty and wordless texts have fingerprint zero and are linked like any other. Equal fingerprints are
    one class with the smallest doc_id; only classes are compared. Rows with a null id keep a null component.
    """
    fp = materialise(fingerprints(docs, doc_id, text), "simhash")
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = link_fingerprints(classes.select("fp"), radius)
    comp = components(links)
    named = comp.join(classes, comp["node"] == classes["fp"]).groupBy("component").agg(F.min("first").alias("component_id"))
    groups = comp.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    classes = classes.join(groups, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    out = fp.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
