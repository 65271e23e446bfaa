"""Language ID by prediction by partial matching.

Each language has a byte context tree of orders 0 to 4 with method-C escapes: in context s of n bytes seen
with d distinct successors, a seen byte of count c has probability c/(n+d), and d/(n+d) is left for the next
shorter context, down to a uniform order -1. Statistics are frozen after training, so the code length of a
byte depends only on the bytes before it; the trees become tables from byte n-grams to the code lengths of
all languages at once, and a text's exact code length is a sum of table look-ups, made in numpy.

The model is fitted on a bounded sample of labelled rows (``rows_per_lang``), every one of them with its whole
text. Tasks count the n-grams of the sampled texts, so texts never reach the driver; what it takes is one row
per different n-gram of five bytes and language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashIndex, small_batches, text_chunks

ORDER = 4
PAD = 0x0A
#: Bytes of text that are coded at a time, unless one text alone is longer; the arrays of a step hold about a hundred bytes for each.
STEP_BYTES = 1 << 18
UNKNOWN = "und"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def padded_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the number made of it and the four before it in its own text, newlines before the start; A-Z count as a-z."""
    data = LOWER[data]
    rows = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    at = np.arange(len(data)) + ORDER * rows
    wide = np.full(len(data) + ORDER * (len(offsets) - 1), PAD, np.uint64)
    wide[at] = data
    key = wide.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= wide[:-k] << np.uint64(8 * k)
    return key[at]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order and the sum of n of each."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


class Trees:
    """Frozen code lengths in bits of every seen n-gram and context, for all languages, from each language's (keys, counts)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        self.grams, self.contexts = [], []
        n_lang, shorter_keys, shorter = len(self.langs), None, None
        for order in range(ORDER + 1):
            cut = np.uint64((1 << 8 * (order + 1)) - 1)
            seen = [summed(counts[x][0] & cut, counts[x][1]) for x in self.langs]
            keys = np.arange(256, dtype=np.uint64) if order == 0 else np.unique(np.concatenate([k for k, _ in seen] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(8))
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            bits = np.repeat(np.full((1, n_lang), 8.0), 256, axis=0) if order == 0 else shorter[np.searchsorted(shorter_keys, keys & (cut >> np.uint64(8)))]
            escape = np.zeros((len(contexts), n_lang))
            for i, (k, c) in enumerate(seen):
                at = np.searchsorted(contexts, k >> np.uint64(8))
                total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = kinds > 0
                escape[known, i] = -np.log2(kinds[known] / (total + kinds)[known])
                column = bits[:, i] + escape[of, i]
                column[np.searchsorted(keys, k)] = -np.log2(c / (total + kinds)[at])
                bits[:, i] = column
            self.grams.append((keys, bits.astype(np.float32)))
            self.contexts.append((contexts, escape.astype(np.float32)))
            shorter_keys, shorter = keys, bits

    def index(self) -> None:
        if not hasattr(self, "found"):
            self.found = [HashIndex(k) for k, _ in self.grams]
            self.found_contexts = [HashIndex(k) for k, _ in self.contexts]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        self.index()
        total = np.zeros((len(data), len(self.langs)), np.float32)
        keys = padded_keys(data, offsets)
        left = np.arange(len(data))
        for order in range(ORDER, -1, -1):
            k = keys[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            row = self.found[order].find(k)
            hit = row >= 0
            total[left[hit]] += self.grams[order][1][row[hit]]
            left, k = left[~hit], k[~hit]
            if not len(left):
                break
            row = self.found_contexts[order].find(k >> np.uint64(8))
            known = row >= 0
            total[left[known]] += self.contexts[order][1][row[known]]
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            for i in range(len(self.langs)):
                out[full, i] = np.add.reduceat(total[:, i], offsets[:-1][full], dtype=np.float64)
        return out


def sample(docs: DataFrame, learn: Column, rows_per_lang: int, short: int, seed: int) -> DataFrame:
    """(lang, text) of at most ``rows_per_lang`` rows a language, whole: rows of lowest hash.

    Rows of over ``short`` characters follow after all others, so that they are taken only where a language has too
    few of those; none is cut. Counts by language set a hash threshold first, so that only about twice the rows
    wanted are ranked, whatever share of the table one language holds. Rows that repeat an id share a hash and are
    ranked by their text.
    """
    d = docs.select(F.col("doc_id"), "text", "lang", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).alias("u"), (F.length("text") > short).alias("long"))
    d = d.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = d.groupBy("lang", "long").count()
    share = counts.select("lang", "long", (F.lit(float(1 << 53)) * F.least(F.lit(1.0), 2.0 * rows_per_lang / F.col("count") + 1e-9)).alias("below"))
    some = d.join(F.broadcast(share), ["lang", "long"]).where("u < below")
    w = W.partitionBy("lang").orderBy("long", "u", F.xxhash64("text"))
    return some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows_per_lang).select("lang", "text")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, key, n): how often each n-gram of five bytes ends a place in the texts of a language."""

    def run(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for first, offsets, data in text_chunks(b.column(1)):
                rows, keys = np.repeat(langs[first : first + len(offsets) - 1], np.diff(offsets)), padded_keys(data, offsets)
                for lang in sorted(set(rows)):
                    k, n = np.unique(keys[rows == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

    return texts.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, rows_per_lang: int = 400, short: int = 4000, seed: int = 11) -> Trees:
    """Context trees from the whole texts of at most ``rows_per_lang`` labelled rows a language that ``learn`` admits; none admitted: no languages."""
    small_batches(docs.sparkSession)
    counts = gram_counts(sample(docs, learn, rows_per_lang, short, seed))
    got = counts.toArrow()
    lang = got["lang"].combine_chunks().dictionary_encode()
    code, key, n = lang.indices.to_numpy(), got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy()
    return Trees({x: summed(key[code == i], n[code == i]) for i, x in enumerate(lang.dictionary.to_pylist())})


def predict(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text, as ``predict_rows`` finds them."""
    return predict_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model).select("doc_id", "lang_pred", F.col("lang_score").alias("score"))


def predict_rows(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score of every row's whole text.

    The language of the shortest code; score is its share of 2**-bits over all languages. Null, empty and
    letterless texts, and all texts if nothing was learned, are ``und`` with score 0. Ties go to the language
    that sorts first; repeated rows are each predicted. Input columns lang_pred and lang_score are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    letters = np.zeros(256, bool)
    letters[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

    def run(batches):
        trees = shared.value
        for b in batches:
            pred, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            for first, offsets, data in text_chunks(b.column(text), STEP_BYTES) if trees.langs else ():
                bits = trees.code_lengths(data, offsets)
                best = bits.argmin(axis=1)
                share = 1.0 / np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0)).sum(axis=1)
                some = np.concatenate([[0], np.cumsum(letters[data])])
                has = some[offsets[1:]] > some[offsets[:-1]]
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
                for i in np.flatnonzero(has):
                    pred[first + i], score[first + i] = trees.langs[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "lang_score"])

    docs = docs.drop("lang_pred", "lang_score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
