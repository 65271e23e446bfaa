"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

If two words differ by one inserted, deleted or replaced code point, one half of the shorter is untouched: the
first stands at the start of the other word or the second at its end. The words of one length are dealt into
shards of bounded size; a shard's automaton holds the two segments of each of its words. All words of the same
length or one more are scanned, in blocks of bounded size; a segment counts where its offset fits, and every
pair so met is verified. A segment that very many words of a shard share leads to them through the halves
of what is left of them, so no scan walks a long list.

All letters here are below U+0100, so a word is one byte a code point in Latin-1, whose order is that of the
code points.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise, runs_of, small_batches, text_chunks

#: Words of a shard or block, words that share a segment before their rests are halved, pairs verified in one step.
SHARD_WORDS, HOT, PAIRS = 100_000, 256, 1 << 20
#: Bytes of text in one step of counting, and distinct words that a task keeps before it hands them on.
STEP_BYTES, KEEP = 8 << 20, 400_000


def letter_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which UTF-8 writes as C3 and one more byte."""
    lead = data == 0xC3
    inside = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | lead
    inside[1:] |= lead[:-1]
    return inside


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters of some texts with A-Z lower-cased, as an Arrow binary array, and the text of each."""
    inside = letter_mask(data)
    starts, ends, rows = runs_of(inside, offsets) if len(data) else (np.zeros(0, np.int64),) * 3
    body = data[inside]
    body = np.where((body >= 0x41) & (body <= 0x5A), body + np.uint8(32), body)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)]), rows


def altered(run: bytes, h: int) -> bytes:
    """The run without its code point ``h`` % length."""
    text = run.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


class Prefixed:
    """crc32 of ``prefix + run`` for many runs at once: of the run, of the prefix followed by zeros, and of zeros alone."""

    def __init__(self, prefixes: list[bytes]) -> None:
        self.first, self.by_length = [zlib.crc32(p) for p in prefixes], {}

    def shifted(self, length: int) -> np.ndarray:
        if length not in self.by_length:
            zeros = bytes(length)
            base = zlib.crc32(zeros)
            self.by_length = self.by_length if len(self.by_length) < 64 else {}
            self.by_length[length] = np.array([zlib.crc32(zeros, c) ^ base for c in self.first], np.uint32)
        return self.by_length[length]


def count_step(ids: list[bytes], offsets: np.ndarray, data: np.ndarray, every: int) -> tuple[list[bytes], np.ndarray]:
    """Words and their numbers in some texts, with every ``every``-th (by crc32 of id and run) run of a text altered."""
    words, rows = runs(data, offsets)
    if not len(words):
        return [], np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, counts = np.unique(rows * len(distinct) + codes, return_counts=True)
    row, code = np.divmod(pairs, len(distinct))
    crc, length = np.array([zlib.crc32(w) for w in distinct], np.uint32), np.array([len(w) for w in distinct])
    h, of = np.zeros(len(pairs), np.uint32), length[code]
    prefixed = Prefixed([i + b":" for i in ids])
    for n in np.unique(of).tolist():
        these = np.flatnonzero(of == n)
        h[these] = prefixed.shifted(n)[row[these]] ^ crc[code[these]]
    hit = h % every == 0
    total = np.bincount(code[~hit], counts[~hit], len(distinct)).astype(np.int64)
    more: dict[bytes, int] = defaultdict(int)
    for c, x, k in zip(code[hit].tolist(), h[hit].tolist(), counts[hit].tolist(), strict=True):
        more[altered(distinct[c], x)] += k
    some = np.flatnonzero(total)
    return [distinct[c] for c in some.tolist()] + list(more), np.concatenate([total[some], np.array(list(more.values()), np.int64)])


def counter(every: int, least_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (word, n); a word comes from a task once for each time that it hands on what it keeps."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for b in batches:
            ids = [(x or "").encode() for x in b.column(0).to_pylist()]
            for first, offsets, data in text_chunks(b.column(1), STEP_BYTES):
                words, counts = count_step(ids[first : first + len(offsets) - 1], offsets, data, every)
                texts = [w.decode() for w in words]
                long = [k for k, w in enumerate(texts) if len(w) >= least_length]
                kept.append(pa.table({"word": pa.array([texts[k] for k in long], pa.string()), "n": counts[long]}))
                if sum(len(t) for t in kept) > 2 * KEEP:
                    kept = [merged(kept)]
                    if len(kept[0]) > KEEP:
                        yield from kept.pop().to_batches()
        if kept:
            yield from merged(kept).to_batches()

    return count


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) over whole texts: runs of letters, A-Z lower-cased, of ``least_length`` code points and ``least`` occurrences.

    Where ``every`` divides the crc32 of ``<id>:<run>``, the run's code point crc32 % length is deleted first.
    Null texts have no words, a null id counts as empty, rows that repeat an id count as often as they stand.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(counter(every, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Rests:
    """Words of one length by what is left of them beside a shared segment; long lists are halved again.

    A rest within one edit of another agrees with it in one of its halves, at the start or at the end.
    """

    def __init__(self, rests: np.ndarray, ids: np.ndarray) -> None:
        self.rests, self.ids, self.half = rests, ids, rests.shape[1] // 2
        self.leaf, self.first, self.last = len(ids) <= HOT or rests.shape[1] < 2, None, None

    def _split(self, key: np.ndarray, rest: np.ndarray) -> dict[bytes, "Rests"]:
        by = defaultdict(list)
        for k, row in enumerate(key):
            by[row.tobytes()].append(k)
        return {b: Rests(rest[at], self.ids[at]) for b, at in by.items()}

    def find(self, rest: bytes) -> list[np.ndarray]:
        """Ids of the words whose rest may be within one edit of ``rest``, which is as long or one longer."""
        if self.leaf:
            return [self.ids]
        if self.first is None:
            self.first = self._split(self.rests[:, : self.half], self.rests[:, self.half :])
            self.last = self._split(self.rests[:, self.half :], self.rests[:, : self.half])
        tail = self.rests.shape[1] - self.half
        out = []
        if (x := self.first.get(rest[: self.half])) is not None:
            out += x.find(rest[self.half :])
        if (x := self.last.get(rest[len(rest) - tail :])) is not None:
            out += x.find(rest[: len(rest) - tail])
        return out


class Shard:
    """The automaton of one shard: both segments of every word, words of one length as rows of bytes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.length = words, words.shape[1]
        self.half = self.length // 2
        self.sides = []  # for each segment: its words in order, where each segment's words begin, rests of the hot ones
        self.machine = ahocorasick.Automaton()
        names: dict[str, list[int]] = {}
        for side, (seg, rest) in enumerate(((words[:, : self.half], words[:, self.half :]), (words[:, self.half :], words[:, : self.half]))):
            keys, which = np.unique(np.ascontiguousarray(seg).view(f"S{seg.shape[1]}").ravel(), return_inverse=True)
            order = np.argsort(which, kind="stable")
            begin = np.searchsorted(which[order], np.arange(len(keys) + 1))
            hot = {k: Rests(rest[order[begin[k] : begin[k + 1]]], order[begin[k] : begin[k + 1]]) for k in np.flatnonzero(np.diff(begin) > HOT).tolist()}
            self.sides.append((order, begin, hot))
            for k, x in enumerate(keys.tolist()):
                names.setdefault(x.decode("latin-1"), [-1, -1])[side] = k
        for name, both in names.items():
            self.machine.add_word(name, (len(name), *both))
        self.machine.make_automaton()

    def meetings(self, scanned: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(words of the shard, scanned words, side) whose segment stands where it must; ``scanned``: rows of bytes, as long or one longer."""
        width = scanned.shape[1]
        text = np.full((len(scanned), width + 1), 32, np.uint8)  # a blank after each word, which no segment holds
        text[:, :width] = scanned
        hits = [(end, *value) for end, value in self.machine.iter(text.tobytes().decode("latin-1"))]
        if not hits:
            return
        end, length, *sides = np.array(hits, np.int64).T
        word, after = np.divmod(end + 1, width + 1)
        for side, segment in enumerate(sides):
            fits = (segment >= 0) & (length == (self.half, self.length - self.half)[side]) & (after == (self.half, width)[side])
            yield from self._pairs(segment[fits], word[fits], side, scanned)

    def _pairs(self, segment: np.ndarray, word: np.ndarray, side: int, scanned: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        order, begin, hot = self.sides[side]
        if hot:
            is_hot = np.isin(segment, np.fromiter(hot, np.int64))
            mine, theirs, n = [], [], 0
            for s, w in zip(segment[is_hot].tolist(), word[is_hot].tolist(), strict=True):
                rest = scanned[w, self.half :] if side == 0 else scanned[w, : scanned.shape[1] - (self.length - self.half)]
                if found := hot[s].find(rest.tobytes()):
                    ids = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
                    mine.append(ids)
                    theirs.append(np.full(len(ids), w))
                    n += len(ids)
                if n > PAIRS:
                    yield np.concatenate(mine), np.concatenate(theirs), side
                    mine, theirs, n = [], [], 0
            if mine:
                yield np.concatenate(mine), np.concatenate(theirs), side
            segment, word = segment[~is_hot], word[~is_hot]
        sizes = begin[segment + 1] - begin[segment]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, sizes.sum() + PAIRS, PAIRS)) + 1 if len(sizes) else []
        since = 0
        for until in cuts:
            s, k = segment[since:until], sizes[since:until]
            if len(s):
                inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield order[np.repeat(begin[s], k) + inner], np.repeat(word[since:until], k), side
            since = until


def near(a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    """Which rows of ``a`` and ``b``, whose first (side 0) or second (side 1) halves agree, differ by exactly one edit and were not met on side 0 as well."""
    length, half = a.shape[1], a.shape[1] // 2
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    same, shifted = a == b[:, :-1], a == b[:, 1:]
    ahead = np.logical_and.accumulate(same, axis=1).sum(1)
    behind = np.logical_and.accumulate(shifted[:, ::-1], axis=1).sum(1)
    ok = ahead + behind >= length
    return ok if side == 0 else ok & (ahead < half)


def rows_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def best_near(names: np.ndarray, me: np.ndarray, other: np.ndarray, other_n: np.ndarray, other_rank: np.ndarray, other_names: np.ndarray) -> pd.DataFrame:
    """For each word its number of near words and the one of largest n (ties: smallest word)."""
    order = np.lexsort((other_rank[other], -other_n[other], me))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]]) if len(me) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(me)])
    return pd.DataFrame({"word": names[me[first]], "n_near": counts, "near_n": other_n[other[first]], "near": other_names[other[first]]})


def match(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The near words between a shard and a block, reduced to one row for each of their words."""
    empty = pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "near_n": pd.Series(dtype="int64"), "near": pd.Series(dtype=str)})
    if not len(shard) or not len(block):
        return empty
    same = bool(block["same"].iloc[0])
    shard = shard.sort_values("word", kind="stable", ignore_index=True)
    block = shard if same else block.sort_values("word", kind="stable", ignore_index=True)
    a, b = rows_of(shard["word"].tolist()), rows_of(block["word"].tolist())
    machine, mine, theirs = Shard(a), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (4 << 20) // (b.shape[1] + 1) // 8)
    for since in range(0, len(b), step):
        part = b[since : since + step]
        for x, y, side in machine.meetings(part):
            ok = near(a[x], part[y], side)
            if same:
                ok &= x < y + since
            mine.append(x[ok])
            theirs.append(y[ok] + since)
    x, y = np.concatenate(mine), np.concatenate(theirs)
    names, others = shard["word"].to_numpy(), block["word"].to_numpy()
    n, m = shard["n"].to_numpy(np.int64), block["n"].to_numpy(np.int64)
    rank, other_rank = np.arange(len(names)), np.arange(len(others))  # words are in code-point order
    if same:
        return best_near(names, np.concatenate([x, y]), np.concatenate([y, x]), n, rank, names)
    return pd.concat([best_near(names, x, y, m, other_rank, others), best_near(others, y, x, n, rank, names)])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, near_n, near) of the words that have near words. ``words``: (word, n), distinct words of letters below U+0100.

    Words of a length are dealt by hash into ceil(their number / ``shard_words``) shards. A shard meets every
    block of its own length (each pair of shards once) and of the next length.
    """
    w = words.select("word", "n", F.char_length("word").alias("len"))
    sizes = w.groupBy("len").agg(F.ceil(F.count("*") / shard_words).cast("int").alias("parts"))  # one row a length
    nxt = sizes.select((F.col("len") - 1).alias("len"), F.col("parts").alias("next"))
    prev = sizes.select((F.col("len") + 1).alias("len"), F.col("parts").alias("prev"))
    w = w.join(sizes.join(nxt, "len", "left").join(prev, "len", "left"), "len")
    w = w.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    key = lambda of, shard, longer, block: F.struct(of.cast("int").alias("len"), shard.cast("int").alias("shard"), longer.cast("int").alias("longer"), block.cast("int").alias("block"))
    keys = ("len", "shard", "longer", "block")
    own = F.sequence(F.lit(0), F.col("parts") - 1)
    zero, one = F.lit(0), F.lit(1)
    up = F.transform(F.filter(own, lambda b: b >= F.col("part")), lambda b: key(F.col("len"), F.col("part"), zero, b))
    up = F.concat(up, F.when(F.col("next").isNull(), F.array().cast(up_type())).otherwise(F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda b: key(F.col("len"), F.col("part"), one, b))))
    down = F.transform(F.filter(own, lambda s: s <= F.col("part")), lambda s: key(F.col("len"), s, zero, F.col("part")))
    down = F.concat(down, F.when(F.col("prev").isNull(), F.array().cast(up_type())).otherwise(F.transform(F.sequence(F.lit(0), F.col("prev") - 1), lambda s: key(F.col("len") - 1, s, one, F.col("part")))))
    left = w.select(F.explode(up).alias("k"), "word", "n").select("k.*", "word", "n")
    right = w.select(F.explode(down).alias("k"), F.col("word").alias("w"), F.col("n").alias("m"))
    right = right.select(*[F.col(f"k.{c}").alias(f"to_{c}") for c in keys], F.col("w").alias("word"), F.col("m").alias("n"), ((F.col("k.longer") == 0) & (F.col("k.shard") == F.col("k.block"))).alias("same"))
    met = left.groupBy(*keys).cogroup(right.groupBy(*[f"to_{c}" for c in keys])).applyInPandas(lambda a, b: match(a, b), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct(-F.col("near_n"), "near"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.col1")).alias("near_n"), F.col("b.near").alias("near"))


def up_type() -> str:
    return "array<struct<len:int,shard:int,longer:int,block:int>>"


def follow(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``root`` added to (word, form, ...): the last of the chain of forms; each round halves what is left of all chains.

    Forms grow at least twofold in n along a chain, so chains are short and have no cycle.
    """
    now = scratch.table(forms.withColumn("root", F.coalesce("form", "word")))
    while True:
        to = now.select(F.col("word").alias("root"), F.col("root").alias("_next")).where("root <> _next")
        step = now.join(to, "root", "left")
        after = scratch.table(step.withColumn("_moved", F.col("_next").isNotNull()).withColumn("root", F.coalesce("_next", "root")).drop("_next"))
        if not after.where("_moved").limit(1).count():
            return now
        now = after.drop("_moved")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97, least_length: int = 5, least: int = 3, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words as in ``count_words``. Near words differ by exactly one inserted, deleted or replaced code point;
    ``form`` is the near word of largest n (ties: the smallest by code points) if that is at least twice the
    word's n, else null; ``root`` is the last of the chain of forms, the word itself if it has none. No words
    (no rows, only nulls, no letters) give no rows. Other columns of any name are ignored. The result is
    written to the shared folder and what was needed on the way is deleted.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.table(count_words(docs, doc_id, text, every, least_length, least))
    near = near_words(words, shard_words)
    is_form = F.col("near_n") >= 2 * F.col("n")
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    out = materialise(follow(forms, scratch).select("word", "form", "root", "n", "n_near", "form_n"), "variants-grouped")
    scratch.drop()
    return out
