"""What several operators of this subpackage share: shared-folder writes, byte-level word hashing, components.

Nothing here keeps state on a machine: intermediate tables go to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that one numpy step works on, unless one text alone is longer.
CHUNK_BYTES = 1 << 20
#: Bytes from which a word is hashed on its own.
LONG_SPAN = 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wordloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Tables of one job, in a folder of their own under the shared one, until ``drop`` deletes them all."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again: cuts lineage and survives lost executors."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files of what is now written
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Only when nothing that is still to run reads a table of this job."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table of the shared folder that stays, for results that are read later."""
    return Scratch(df.sparkSession, what).table(df)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers: texts may be long."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)


def doc_crc(doc_id: Column | str) -> Column:
    """crc32 of the id written as text."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as (first row, byte offsets with one more than rows, bytes). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    octets = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, offsets[first : last + 1] - offsets[first], octets[offsets[first] : offsets[last]]
        first = last


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each word; no word spans two rows. ``is_word``: 256 flags."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    return runs_of(is_word[data], offsets)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each run of bytes that are ``inside``; no run spans two rows."""
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: differences of one running polynomial, all at once, and XXH64 for long spans.

    A polynomial modulo 2**64 has equal values for long words that alternate in certain ways, whatever its base,
    so spans of over ``LONG_SPAN`` bytes are hashed by a function without that structure.
    """
    POWERS.need(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=run[1:])
    out = mix((run[ends] - run[starts]) * POWERS.down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def word_table(not_words: tuple[int, ...] = SPACE_BYTES) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(not_words)] = False
    return table


class HashIndex:
    """Positions of uint64 keys by open addressing; built and searched in numpy."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        pending, home, step = np.arange(len(keys)), self._home(keys), 0
        while len(pending):
            at = (home[pending] + step) & self.mask
            free = self.slots[at] < 0
            tried, place = pending[free], at[free]
            self.slots[place] = tried
            pending = np.concatenate([pending[~free], tried[self.slots[place] != tried]])
            step += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at = self._home(keys)
        got = self.slots[at]
        same = (self.keys[got] == keys) & (got >= 0)
        out[same] = got[same]
        left = np.flatnonzero(~same & (got >= 0))
        step = 1
        while len(left):
            got = self.slots[(at[left] + step) & self.mask]
            same = (got >= 0) & (self.keys[got] == keys[left])
            out[left[same]] = got[same]
            left = left[~same & (got >= 0)]
            step += 1
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: list[int] | None = None) -> tuple[list[int], np.ndarray]:
    """Union-find over 0..n-1; returns parents and which of the pairs joined two trees (a spanning forest)."""
    parent = list(range(n)) if parent is None else parent
    used = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used[k] = True
    return parent, used


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs); component: the smallest node reachable.

    Alternating large-star and small-star steps: each node's links go to its smallest neighbour, so stars
    stay small and the number of rounds grows with the logarithm of the longest path. Each round is cut by
    checkpoint(). A node of great degree is one key of an aggregation with partial sums and of a join that
    adaptive execution may split. Self links and repeated links are allowed; nulls are dropped; no rows
    give no rows.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.col("v") % 1000003)).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
