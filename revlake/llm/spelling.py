"""Spelling variants: words one inserted, deleted or replaced letter apart, by two-dimensional range reporting.

A word with prefix ``p`` and suffix ``s`` is a point of the grid (rank in forward order, rank in reverse order) that lies in the
interval of ``p`` on one axis and of ``s`` on the other.  For each edit position of a word the words that agree before
and behind it are the points of such a rectangle; a wavelet tree over the reverse ranks in forward order reports them.

*Shards.*  One tree over a whole vocabulary would fill one task.  Two words that differ at a place in the range [lo, hi) of a
word of ``m`` letters agree on the first ``lo`` letters and on the last ``m - hi``, so those name the shard; at first the two
ranges are the halves of the word.  A shard with more words than one task should hold is dealt again by both halves of its
range, until it fits: at a single position what agrees is all but two letters, so every shard ends bounded.  A pair has one
position (of an insertion beside an equal letter the leftmost), so no pair is found twice and nothing is deduplicated.

Letters are code points up to U+00FF, a byte each in a shard.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import arrow_rows, bounded_batches, chunks, stage, texts_of
from revlake.llm.hashing import LOWER, crc32_spans, joined, pieces

#: Letters of a word, at least.
LEAST_LETTERS = 6
#: Words of a shard, at most; and rows of whole shards that a task reports on together.
SHARD, PACK = 1 << 17, 1 << 16
#: Bytes of a text that are read at a time; a longer one is cut between words.
PIECE = 1 << 22
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _count(counter: Counter, ids: list, texts: list[bytes], least: int, drop: int) -> None:
    """Add the words of texts, A-Z lower-cased, as Latin-1 bytes."""
    before = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
    buf, at = joined([t.translate(LOWER) for t in texts])
    lead = buf == 0xC3  # U+00C0 to U+00FF are this byte and one more
    tail = np.concatenate([[False], lead[:-1]])
    inside = np.concatenate([[False], _ALPHA[buf] | lead | tail, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    leads = np.concatenate([[0], np.cumsum(lead)])
    size = end - start - (leads[end] - leads[start])
    kept = size >= least
    start, end, size = start[kept], end[kept], size[kept]
    # words apart by spaces, a byte a letter
    cover = np.zeros(len(buf) + 1, np.int8)
    cover[start] = 1
    cover[end] -= 1
    flat = np.where(np.cumsum(cover[:-1], dtype=np.int8) > 0, buf + (tail * np.uint8(0x40)), np.uint8(0x20))[~lead]
    counter.update(flat.tobytes().split())
    if drop and len(start):
        h = crc32_spans(buf, start, end, before[np.searchsorted(at, start, side="right") - 1]).astype(np.int64)
        for k in np.flatnonzero(h % drop == 0).tolist():
            word = buf[start[k] : end[k]].tobytes().decode().encode("latin-1")
            i = int(h[k] % size[k])
            counter[word] -= 1
            if len(word) > least:
                counter[word[:i] + word[i + 1 :]] += 1


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, drop: int = 0) -> DataFrame:
    """``word, n``: the words ``[A-Za-z\\u00C0-\\u00FF]+`` of at least ``least`` letters, A-Z lower-cased, and their occurrences.

    With ``drop`` an occurrence loses a letter where ``drop`` divides the CRC-32 ``h`` of ``<doc_id>:<word>``: the one at
    ``h % length``.  A row without an id has nothing before the colon.  Counts are combined in the task before they are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    bounded_batches(docs.sparkSession)

    def rows_of(counter: Counter) -> pa.RecordBatch:
        held = [(w.decode("latin-1"), n) for w, n in counter.items() if n]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], names=["word", "n"])

    def run(batches):
        counter: Counter = Counter()
        for batch in batches:
            for part in arrow_rows([batch]):
                cut = [(i, p) for i, t in zip(part.column(0).to_pylist(), texts_of(part), strict=True) for p in pieces(t, _GAP, PIECE)]
                for a, b in chunks([p for _, p in cut]):
                    _count(counter, [i for i, _ in cut[a:b]], [p for _, p in cut[a:b]], least, drop)
                    if len(counter) > COUNTED:
                        yield rows_of(counter)
                        counter.clear()
        yield rows_of(counter)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


class WaveletTree:
    """The numbers ``0 <= x < len(numbers)`` at their places, bit by bit from the highest (as a wavelet matrix)."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(1, int(len(numbers) - 1).bit_length())
        self.ones: list[np.ndarray] = []
        x = np.asarray(numbers)
        for shift in range(self.bits - 1, -1, -1):
            bit = (x >> shift & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            x = np.concatenate([x[~bit], x[bit]])

    def report(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many rectangles, places [a, b) by numbers [low, high): the rectangle and the number of each point in one."""
        which = np.flatnonzero((a < b) & (low < high))
        a, b, low, high = a[which], b[which], low[which], high[which]
        base = np.zeros(len(which), np.int64)
        for k, ones in enumerate(self.ones):
            half = 1 << (self.bits - 1 - k)
            zeros = len(ones) - 1 - ones[-1]
            oa, ob = ones[a], ones[b]
            parts = []
            for one, x, y, at in ((False, a - oa, b - ob, base), (True, zeros + oa, zeros + ob, base + half)):
                ok = (x < y) & (at < high) & (at + half > low)
                parts.append((which[ok], x[ok], y[ok], low[ok], high[ok], at[ok]))
            which, a, b, low, high, base = (np.concatenate(p) for p in zip(*parts, strict=True))
        return which, base


class _Axis:
    """Words in sorted order: each word's rank, and the run of words that share its first letters."""

    def __init__(self, words: np.ndarray, width: int):
        self.order = np.argsort(words, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        table = words[self.order].view(np.uint8).reshape(len(words), width)
        apart = table[1:] != table[:-1]
        self.shared = np.concatenate([[-1], np.where(apart.any(axis=1), apart.argmax(axis=1), width)])

    def run(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each rank, the interval [first, last) of ranks with the same ``depth`` first letters."""
        first = np.flatnonzero(self.shared < depth)
        if not len(first) or first[0]:
            first = np.concatenate([[0], first])
        edge = np.concatenate([first, [len(self.shared)]])
        n = np.diff(edge)
        return np.repeat(edge[:-1], n), np.repeat(edge[1:], n)


def near_words(words: list[bytes], m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word), each in both directions, of distinct words of ``m`` or ``m + 1`` letters whose edit is at a place
    in [lo, hi) of a word of ``m`` letters."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < 2 or not (size == m).any():
        return none
    forward = _Axis(np.array(words, f"S{m + 1}"), m + 1)
    reverse = _Axis(np.array([w[::-1] for w in words], f"S{m + 1}"), m + 1)
    grids = {}
    for n in (m, m + 1):  # the points of the words of each length
        f, r = size[forward.order] == n, size[reverse.order] == n
        place = np.concatenate([[0], np.cumsum(r)])
        if f.any():
            grids[n] = WaveletTree(place[reverse.rank[forward.order[f]]]), np.concatenate([[0], np.cumsum(f)]), place, reverse.order[r]
    asks = np.flatnonzero(size == m)
    fr, rr = forward.rank[asks], reverse.rank[asks]
    out = [none]
    for i in range(lo, min(hi, m + 1)):
        first, last = (x[fr] for x in forward.run(i))
        for n, behind in ((m, m - i - 1), (m + 1, m - i)):
            if n not in grids or behind < 0:
                continue
            tree, fcount, rcount, named = grids[n]
            low, high = (x[rr] for x in reverse.run(behind))
            which, at = tree.report(fcount[first], fcount[last], rcount[low], rcount[high])
            a, b = asks[which], named[at]
            if n == m:
                out.append((a[a != b], b[a != b]))
            elif i:  # an equal letter before: the insertion is one place further left
                new = np.fromiter((words[y][i] != words[x][i - 1] for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
                out += [(a[new], b[new]), (b[new], a[new])]
            else:
                out += [(a, b), (b, a)]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _shards(rows: DataFrame) -> DataFrame:
    """Rows with ``m, lo, hi`` and the key of their shard."""
    behind = F.greatest(F.lit(0), F.col("m") - F.col("hi"))
    suffix = F.when(behind > 0, F.expr("right(word, greatest(0, m - hi))")).otherwise("")
    return rows.withColumn("shard", F.xxhash64("m", "lo", "hi", F.expr("left(word, lo)"), suffix))


def _dealt(vocabulary: DataFrame, least: int, most: int) -> DataFrame:
    """``word, n, m, lo, hi, shard``: every word in the shards of its own length and of the one below, none above ``most`` words."""
    size = F.length("word")
    based = vocabulary.withColumn("m", F.explode(F.when(size > least, F.array(size, size - 1)).otherwise(F.array(size))))
    half = F.floor(F.col("m") / 2).cast("int")
    ranges = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    open_ = _shards(based.withColumn("r", F.explode(ranges)).select("word", "n", "m", "r.lo", "r.hi"))
    done = None
    while True:
        large = open_.groupBy("shard").count().where((F.col("count") > most)).select("shard")
        large = stage(large, "shards")
        # a shard above `most` rows: at most rows / most of them
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        wide = F.col("hi") - F.col("lo") > 1
        fits = open_.join(large, "shard", "left_anti").unionByName(open_.join(large, "shard", "left_semi").where(~wide))
        done = fits if done is None else done.unionByName(fits)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        again = open_.join(large, "shard", "left_semi").where(wide).withColumn("r", F.explode(halves)).select("word", "n", "m", "r.lo", "r.hi")
        done, open_ = stage(done, "fitting"), stage(_shards(again), "large")


def near_counts(vocabulary: DataFrame, least: int = LEAST_LETTERS, most: int = SHARD) -> DataFrame:
    """``word, n_near, best``: how many words are near each word that has any, and the one of them with the largest ``n``
    (ties: the smallest), as ``struct<less long, near string>`` with ``less = -n``.  ``vocabulary`` is ``word, n``, words once."""

    def best(rows: list[tuple[str, int, int, int, int]]) -> pa.RecordBatch:
        groups: dict[tuple[int, int, int], list[tuple[bytes, int]]] = {}
        for word, n, m, lo, hi in rows:
            groups.setdefault((m, lo, hi), []).append((word.encode("latin-1"), n))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for (m, lo, hi), held in groups.items():
            held.sort()
            words, n = [w for w, _ in held], np.array([k for _, k in held])
            a, b = near_words(words, m, lo, hi)
            order = np.lexsort((b, -n[b], a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
            count = np.diff(np.concatenate([first, [len(a)]]))
            for k, c in zip(first.tolist(), count.tolist(), strict=True):
                for x, y in zip(out, (words[a[k]].decode("latin-1"), c, -int(n[b[k]]), words[b[k]].decode("latin-1")), strict=True):
                    x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "less", "near"])

    def run(batches):
        kept: list[tuple] = []
        last = None
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(kept) >= PACK and shard != last:
                    yield best(kept)
                    kept = []
                kept.append(tuple(row))
                last = shard
        if kept:
            yield best(kept)

    dealt = _dealt(vocabulary, least, most).select("shard", "word", "n", "m", "lo", "hi").repartition("shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(run, "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` (forms not null): the end of each chain of forms, by doubling; chains have no circles."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = stage(now.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = LEAST_LETTERS, often: int = 5, ratio: int = 5, drop: int = 0, most: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of at least ``often`` occurrences with its accepted spelling.

    A word's form is its near word of largest ``n`` (ties: the smallest) if that has ``ratio`` times the word's ``n`` or more.
    ``root`` is the last form of the chain, the word itself if it has none; a chain ends because ``n`` grows along it.
    Null and empty texts hold no words, repeated rows count each, very long texts are read in pieces and very long words
    like others, an empty table gives no rows, and other columns are ignored.
    """
    words = stage(word_counts(docs, least, drop).where(F.col("n") >= often), "words")
    near = near_counts(words, least, most)
    best_n = -F.col("best.less")
    takes = best_n >= ratio * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, best_n).alias("form_n"))
    known = stage(known, "forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
