"""Importance resampling towards a target's distribution of hashed word n-grams, by an external sort-count.

1. *Streams.*  A document becomes the packed ``uint16`` buckets of its features, written once to the shared folder.  The binary
   column of an Arrow batch is that stream together with the documents' offsets, so later passes read it without unpacking.
2. *Counts.*  A task sorts the stream of a batch, run-length encodes it and merges the runs; one row a bucket and task
   is shuffled.  The table of gains has ``buckets`` rows, which bounds what is collected and broadcast.
3. *Gathering.*  The streams are read again, each bucket is replaced by its gain, and ``np.add.reduceat`` sums them by document.
4. *Drawing.*  Gumbel noise from a hash of the id makes the highest scores a weighted draw without replacement.  Documents
   are range-partitioned by score; a rank is the count of the partitions before plus the place in its own, so no task sees all rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import arrow_rows, bounded_batches, chunks, map_arrow, stage, texts_of
from revlake.llm.hashing import LOWER, crc32_spans, joined, pieces

#: Buckets fit 16 bits.
MOST_BUCKETS = 1 << 16
#: Bytes of a text that are hashed at a time; a longer one is cut between words.
PIECE = 1 << 22
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], _WORD[buf], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def features(texts: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``n`` words as ``uint16``, document after document, each document's first place (one more: the
    end) and its number of words."""
    owner, parts, context = [], [], []
    for i, t in enumerate(texts):
        before = b""
        for p in pieces(t.translate(LOWER), _GAP, PIECE):
            p = before + b" " + p if before else p
            parts.append(p)
            owner.append(i)
            context.append(before.count(b" ") + 1 if before else 0)
            if n > 1:
                start, end = _spans(np.frombuffer(p, np.uint8))
                before = b" ".join(p[a:b] for a, b in zip(start[1 - n :].tolist(), end[1 - n :].tolist(), strict=True))
    words = np.zeros(len(texts), np.int64)
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in chunks(parts):
        buf, at = joined(parts[a:b])
        start, end = _spans(buf)
        first = np.searchsorted(start, at)
        part = np.repeat(np.arange(b - a), np.diff(first))
        place = np.arange(len(start)) - first[part]
        known = np.array(context[a:b], np.int64)[part]  # words that the piece before has counted
        doc = np.array(owner[a:b], np.int64)[part]
        np.add.at(words, doc[place >= known], 1)
        state, live = None, np.arange(len(start))
        for k in range(n):
            if k:
                live = live[(live + k < len(start))]
                live = live[part[live + k] == part[live]]
                at_, to = np.zeros(len(live), np.int64), np.ones(len(live), np.int64)
                state = crc32_spans(np.frombuffer(b" ", np.uint8), at_, to, full[live])
            state = crc32_spans(buf, start[live + k], end[live + k], state)
            full = np.zeros(len(start), np.uint32)
            full[live] = state
            new = place[live] + k >= known[live]
            got.append((doc[live[new]], (state[new] % np.uint32(buckets)).astype(np.uint16)))
    doc = np.concatenate([d for d, _ in got]) if got else np.zeros(0, np.int64)
    stream = np.concatenate([s for _, s in got]) if got else np.zeros(0, np.uint16)
    if len(got) > 1:
        order = np.argsort(doc, kind="stable")
        doc, stream = doc[order], stream[order]
    return stream, np.searchsorted(doc, np.arange(len(texts) + 1)), words


def _binary(stream: np.ndarray, offset: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offset) - 1, [None, pa.py_buffer((offset * 2).astype(np.int64)), pa.py_buffer(stream.astype("<u2"))]).cast(pa.binary())


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed buckets of a batch and where its documents begin in them (one more: the end)."""
    column = column.cast(pa.large_binary())
    _, offset, data = column.buffers()
    at = np.frombuffer(offset, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    return np.frombuffer(data, "<u2")[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint16), at - at[0]


def streams(docs: DataFrame, n: int = 1, buckets: int = 10_000, columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` of ``docs`` with ``n_words`` and ``stream``, the packed buckets of the row's ``text``; staged."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError("buckets must fit 16 bits")
    rows = docs.select(*columns, F.col("text").cast("string").alias("text"))
    out = rows.select(*columns, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("stream")).schema

    def f(batch):
        stream, at, words = features(texts_of(batch), n, buckets)
        return {c: batch.column(i) for i, c in enumerate(columns)} | {"n_words": words, "stream": _binary(stream, at)}

    return stage(map_arrow(rows, f, out), "streams")


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in the streams of a table: sorted and run-length encoded batch by batch in every task."""
    bounded_batches(packed.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in arrow_rows([batch], 4096):
                s = np.sort(_stream(part.column(0))[0])
                edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                total[s[edge]] += np.diff(np.concatenate([edge, [len(s)]]))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(p_target / p_source))`` of each bucket, with one added to every count."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(y + 1) * float(s + b)) / (float(x + 1) * float(t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """``packed`` with ``n_features`` and ``weight``, the sum of the gains of its features, instead of the stream."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    columns = [c for c in packed.columns if c != "stream"]
    out = packed.select(*columns, F.lit(0).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight")).schema

    def f(batch):
        stream, at = _stream(batch.column(len(columns)))
        n = np.diff(at)
        weight = np.zeros(len(n), np.int64)
        if len(stream):
            weight[n > 0] = np.add.reduceat(shared.value[stream], at[:-1][n > 0])
        return {c: batch.column(i) for i, c in enumerate(columns)} | {"n_features": n, "weight": weight}

    return map_arrow(packed.select(*columns, "stream"), f, out)


def noise(doc_id: str, seed: int):
    """Gumbel noise in thousandths, fixed by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, takes_part: str, order: list, name: str = "place") -> DataFrame:
    """``rows`` staged with ``name``: 1, 2, 3, ... in ``order`` over the rows for which the column ``takes_part`` holds, else null."""
    spark = rows.sparkSession
    keys = [F.col(takes_part).desc(), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in dealt.where(takes_part).groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        before.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    out = dealt.join(F.broadcast(offsets), part == F.col("_part"), "left")
    return out.withColumn(name, F.when(F.col(takes_part), F.col("_before") + row + 1)).drop("_at", "_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; drawn rows have a rank.

    ``percent`` of the rows with at least ``least_words`` words are drawn, highest scores first, ties to the smaller id.
    Null and empty texts have no features and weight 0.  A row without an id counts in the corpus but cannot be drawn: its
    score is null.  Repeated rows have equal scores and ranks next to each other.  Very long texts are hashed in pieces that share the words
    at a cut; an empty table gives no rows, an empty target only adds one to each bucket; other columns are ignored.
    """
    source = streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, buckets, ("doc_id",))
    gain = gains(bucket_counts(source, buckets), bucket_counts(streams(target, n, buckets), buckets))
    rows = weighted(source, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    rows = stage(rows.withColumn("_fit", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)), "scored")
    most = percent * rows.where("_fit").count() // 100
    placed = ranked(rows, "_fit", [F.col("score").desc(), F.col("doc_id")])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= most, F.col("place")).alias("rank"))
