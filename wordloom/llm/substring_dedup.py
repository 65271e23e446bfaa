"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every document of smaller id. It is indexed in blocks of ``window`` words: a window's anchor
is the least hash of the ``gram``-word grams in it, equal windows have equal anchors, and only windows whose
anchor occurs in two different texts are indexed, each by 128 bits of hash with its first place (document,
word). A document is then parsed greedily: from its first window that the index holds, the factor runs along
the reference while the next windows point to the next words of it; where it stops, the windows across the
factor's edge have places of their own and start the next factor, so a span copied from two references is
found whole. Factors are at least ``window`` words by construction; their words are the duplicate spans, and
nothing else is removed.

Exact copies are one class, parsed once. Anchors, windows and spans are shuffled by hash and combined before
the shuffle; texts are shuffled only if a Bloom filter of bounded size says that their document is affected.
A gram that a third of all documents share is one key of aggregations with partial sums; windows that occur
``HOT`` times or more meet their index entries by a broadcast of checked size, all others by shuffling.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, Scratch, hash_spans, materialise, mix, small_batches, text_chunks, word_table, words_of
from .url_filter import build_filter, passes

WINDOW = 50
GRAM = 8
#: Occurrences from which on a window is not shuffled to its index entry, and most such windows that are broadcast.
HOT, HOT_WINDOWS = 4096, 200_000
NOTHING = hashlib.sha256(b"").hexdigest()
_SPACES = word_table()
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each run of n values, by doubling."""
    step = 1
    while step * 2 <= n:
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    rest = n - step
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    POWERS.need(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * POWERS.up[: len(h)], out=run[1:])
    return mix((run[n:] - run[:-n]) * POWERS.down[: len(h) - n + 1])


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window of one text's word hashes."""
    return sliding_least(run_hashes(h, gram), window - gram + 1)


def texts_with_words(column: pa.Array):
    """(row, word hashes, bytes, word starts, word ends) of each row."""
    for first, offsets, data in text_chunks(column):
        starts, ends, rows = words_of(data, offsets, _SPACES)
        h = hash_spans(data, starts, ends)
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            a, b = cuts[i], cuts[i + 1]
            yield first + i, h[a:b], data, starts[a:b], ends[a:b], (offsets[i], offsets[i + 1])


def joined(data: np.ndarray, span: tuple[int, int]) -> bytes:
    return b" ".join(bytes(data[span[0] : span[1]]).split())


def covered(parsed: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    """Which of n words the factors cover."""
    step = np.zeros(n + 1, np.int64)
    for start, words, _, _ in parsed:
        step[start] += 1
        step[start + words] -= 1
    return np.cumsum(step[:n]) > 0


def factors(starts: list[int], refs: list[tuple[int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, reference document, its word) from sorted window starts and their places.

    A factor runs on while the next window continues the same reference; the next factor starts with the
    first window that does not, so windows across the edge of a factor have been looked up themselves.
    """
    out: list[list[int]] = []
    for s, (doc, at) in zip(starts, refs, strict=True):
        if out:
            last = out[-1]
            if last[2] == doc and s - last[0] == at - last[3] and s == last[0] + last[1] - window + 1:
                last[1] += 1
                continue
        out.append([s, window, doc, at])
    return [tuple(x) for x in out]


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(every row: doc_id, n_words, sha, first; affected texts: doc_id, sha, starts, factors).

    ``sha`` is the hash of the words joined by one space and names a class of equal texts, ``first`` the
    smallest id of it. ``starts`` are the words at which windows start that also start in a document of
    smaller id than ``first``.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sketch(batches):
        for b in batches:
            n, sha, found = np.zeros(b.num_rows, np.int64), [""] * b.num_rows, [None] * b.num_rows
            for row, h, data, _, _, span in texts_with_words(b.column(1)):
                n[row], sha[row] = len(h), hashlib.sha256(joined(data, span)).hexdigest()
                found[row] = np.unique(anchors(h, window, gram)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_words", "sha", "anchors"])

    rows = materialise(d.mapInArrow(sketch, "doc_id long, n_words long, sha string, anchors array<long>"), "sketch")
    firsts = materialise(rows.groupBy("sha").agg(F.min("doc_id").alias("first")), "classes")
    # the smallest row of each class stands for it
    of = rows.where(F.size("anchors") > 0).join(firsts.where("first is not null").withColumnRenamed("first", "doc_id"), ["sha", "doc_id"])
    each = of.select("doc_id", "sha", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor")
    scratch = Scratch(docs.sparkSession, "anchors")
    wanted = scratch.table(each.join(shared, "anchor").groupBy("doc_id", "sha").agg(F.collect_set("anchor").alias("anchors")))
    near = d.where(passes(F.xxhash64("doc_id"), build_filter(wanted.select("doc_id"), "doc_id"))).join(wanted, "doc_id")

    def windows(batches):
        for b in batches:
            keys, sets = b.column(2).to_pylist(), b.column(3)
            row_at, starts, hashes, others = [], [], [], []
            for row, h, data, _, _, span in texts_with_words(b.column(1)):
                if hashlib.sha256(joined(data, span)).hexdigest() != keys[row]:
                    continue
                own = np.asarray(sets[row].values, np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(anchors(h, window, gram), own))
                row_at.append(row)
                starts.append(at.astype(np.int32))
                hashes.append(run_hashes(h, window)[at].view(np.int64))
                others.append(run_hashes(mix(h ^ _SECOND), window)[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row_at, pa.int64())), b.column(2).take(pa.array(row_at, pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64()))], names=["doc_id", "sha", "at", "h", "g"])

    w = materialise(near.select("doc_id", "text", "sha", "anchors").mapInArrow(windows, "doc_id long, sha string, at array<int>, h array<long>, g array<long>"), "windows")
    scratch.drop()
    w = w.select("doc_id", "sha", F.explode(F.arrays_zip("at", "h", "g")).alias("x")).select("doc_id", "sha", "x.at", "x.h", "x.g")
    index = w.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("ref"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("ref.doc_id < last").select("h", "g", "ref", "n")
    index = materialise(index, "index")
    hot = index.where(F.col("n") >= HOT).select("h", "g", "ref")
    if hot.count() <= HOT_WINDOWS:
        cold = w.join(F.broadcast(hot.select("h", "g")), ["h", "g"], "left_anti").join(index.where(F.col("n") < HOT).select("h", "g", "ref"), ["h", "g"])
        hits = cold.unionByName(w.join(F.broadcast(hot), ["h", "g"]))
    else:
        hits = w.join(index.drop("n"), ["h", "g"])
    hits = hits.where(F.col("ref.doc_id") < F.col("doc_id"))
    hits = hits.groupBy("doc_id", "sha").agg(F.sort_array(F.collect_set(F.struct("at", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.at").alias("ref_at")))).alias("hits"))
    return rows.select("doc_id", "n_words", "sha").join(firsts, "sha"), materialise(hits, "hits")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, factors) of every row.

    A word goes if a window of ``window`` words that covers it also starts in a document of smaller id,
    judged on the input. ``kept_text`` is null where nothing goes (the text stays as it is), else the kept
    words joined by one space; ``factors`` lists (start, words, reference id, reference word) of the parse,
    one factor with the class's first id for an exact copy. Null and wordless texts have no words. Rows of
    the same id are never references of each other. A null id is later than any other and no reference.
    """
    rows, hits = find_spans(docs, doc_id, text, window, gram)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    near = d.where(passes(F.xxhash64("doc_id"), build_filter(hits.select("doc_id"), "doc_id"))).join(hits, "doc_id")
    kind = "array<struct<start:int,words:int,ref_doc:long,ref_start:int>>"

    def cut(batches):
        for b in batches:
            keys, found = b.column(2).to_pylist(), b.column(3)
            out = {k: [] for k in ("doc_id", "sha", "n_removed", "kept_sha256", "kept_text", "factors")}
            for row, h, data, starts, ends, span in texts_with_words(b.column(1)):
                if hashlib.sha256(joined(data, span)).hexdigest() != keys[row]:
                    continue
                own = found[row].values
                at, ref_doc, ref_at = (np.asarray(own.field(k)) for k in range(3))
                parsed = factors(at.tolist(), list(zip(ref_doc.tolist(), ref_at.tolist(), strict=True)), window)
                gone = covered(parsed, len(h))
                kept = b" ".join(bytes(data[s:e]) for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
                out["doc_id"].append(b.column(0)[row].as_py())
                out["sha"].append(keys[row])
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append(kept.decode("utf-8", "replace"))
                out["factors"].append([{"start": s, "words": n, "ref_doc": r, "ref_start": p} for s, n, r, p in parsed])
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    part = near.select("doc_id", "text", "sha", "hits").mapInArrow(cut, f"doc_id long, sha string, n_removed long, kept_sha256 string, kept_text string, factors {kind}")
    part = part.dropDuplicates(["doc_id", "sha"]).select(F.col("doc_id").alias("d"), F.col("sha").alias("k"), "n_removed", "kept_sha256", "kept_text", "factors")
    out = rows.join(part, (rows["doc_id"] == part["d"]) & (rows["sha"] == part["k"]), "left")
    copy = (F.col("n_words") >= window) & F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("words"), F.col("first").alias("ref_doc"), F.lit(0).alias("ref_start")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(copy, whole).otherwise(F.coalesce("factors", F.array().cast(kind))).alias("factors"),
    )
