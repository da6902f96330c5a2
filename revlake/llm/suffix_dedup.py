"""Repeated-passage removal by bucket-pointer refinement.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else.  Sorting every suffix of
the corpus is not needed to decide this, only the buckets of equal ``length``-byte strings:

1. *Buckets across documents.*  Each ``length``-byte string is represented by the least (hashed) q-gram in it, its
   anchor.  Equal strings have equal anchors at equal offsets, so strings fall in buckets by anchor q-gram.
   Neighbouring strings share an anchor: one row ``(bucket, document, first string, count)`` stands for about
   ``(length - q) / 2`` strings and carries a hash of the bytes they cover (its context).  A context that a document
   holds several times (periodic text) is decided and merged within the document, before anything is shuffled.
2. *Buckets without work.*  A q-gram seen once cannot repeat; rows whose context hash occurs twice repeat as a
   whole.  Both need only counts, combined before the shuffle.
3. *Refinement.*  What is left are buckets with several different contexts, one of each.  Whole buckets meet in a
   task, and bucket-pointer refinement sorts their positions: the first buckets hold positions with equal q-grams
   at one place of one anchor; a round sorts the positions of depth ``h`` by their own bucket pointer and the pointer
   at the later offset ``h``, which gives the pointers of depth ``2 h`` that the next round reuses.  A position alone
   in its bucket is done, and so is one whose run of undecided neighbours cannot hold a whole string any more.
   Positions that share a bucket at depth ``length`` start the same string.
4. A bucket with more contexts than one task should hold is not gathered: the strings of its rows are counted by
   128-bit hashes in Spark instead, with the same result.

Rows are decided on the input, matches never cross documents, and overlaps count.  A row is told apart by its id and a
hash of its text: repeated rows are copies of each other, different texts under one id are different documents, and so
are rows without an id.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake.llm.common import FEW, fresh, map_arrow, stage, texts_of
from revlake.llm.hashing import U, mix, prefix_sums, span_hashes

#: Bytes of the q-gram that names the initial bucket.
Q = 24
#: Strings handled at a time, so that a very long document needs no larger buffers.
SEGMENT = 1 << 19


def anchor_rows(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """``start, count, anchor, bucket, c1, c2`` of the runs of strings that share an anchor."""
    parts = [_segment(text, s, min(len(text) - length + 1, s + SEGMENT), length) for s in range(0, len(text) - length + 1, SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(6))


def _segment(text: bytes, first: int, last: int, length: int) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(text, np.uint8)[first : last - 1 + length]
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - Q + 1)
    grams = span_hashes(sums, at, at + Q)
    # hash above, position below: ties go to the leftmost, whatever stands around
    key = (grams & ~U(0xFFFFFFFF)) | at.astype(U)
    w = length - Q + 1
    n = last - first
    pad = -len(key) % w
    blocks = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    count = np.diff(np.concatenate([start, [n]]))
    a = anchor[start]
    # the place of the anchor is part of a context, so equal contexts hold equal strings of this bucket
    c = span_hashes(sums, start, start + count - 1 + length)
    salt = (a - start).astype(U)
    with np.errstate(over="ignore"):
        c1, c2 = mix(c + salt * U(0x9E3779B97F4A7C15)), _second(buf, start, start + count - 1 + length) ^ mix(salt)
    return start + first, count, a - start, grams[a].view(np.int64), c1.view(np.int64), c2.view(np.int64)


def _second(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of the same spans, with other byte values, for 128 bits together."""
    return span_hashes(prefix_sums(buf ^ np.uint8(0x5A)), start, end)


def refine(bucket: np.ndarray, data: list[bytes], anchor: np.ndarray, count: np.ndarray, length: int) -> list[np.ndarray]:
    """For each row, which of its strings another row of its bucket holds as well (rows are different contexts).

    ``data`` are the covered bytes, ``anchor`` the anchor's place in them; string ``i`` of a row starts at its byte
    ``i``, and there are ``len(data) - length + 1 = count`` of them.
    """
    size = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(data)), size)
    place = np.arange(len(flat)) - begin[row]
    room = (size[row] - place).astype(np.int32)
    place -= anchor[row]
    place -= place.min()
    _, root = np.unique(bucket, return_inverse=True)
    wide = int(place.max()).bit_length()
    depth = min(length, (63 - wide - int(root.max()).bit_length()) // 8)
    gram = np.zeros(len(flat), np.int64)
    for k in range(depth):
        gram[: len(flat) - k] = gram[: len(flat) - k] << 8 | flat[k:]
    key = (root[row] << wide | place) << 8 * depth | gram
    del row, place, gram
    pointer = np.full(len(flat), -1, np.int32)
    at = np.flatnonzero(room >= depth)
    pointer[at] = _pointers(key[at])
    del key
    while depth < length:
        _drop_short_runs(pointer, length - depth + 1)
        step = min(depth, length - depth)
        at = np.flatnonzero(pointer >= 0)
        at = at[room[at] >= depth + step]
        at = at[pointer[at + step] >= 0]
        refined = _pointers(pointer[at].astype(np.int64) << 32 | pointer[at + step])
        pointer[:] = -1
        pointer[at] = refined
        depth += step
    return [pointer[b : b + c] >= 0 for b, c in zip(begin.tolist(), np.asarray(count).tolist(), strict=True)]


def _pointers(key: np.ndarray) -> np.ndarray:
    """The bucket of each key in sorted order; -1 for a key that is alone."""
    order = np.argsort(key)
    key = key[order]
    edge = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=edge[1:-1])
    ids = np.cumsum(edge[:-1], dtype=np.int32)
    ids[edge[:-1] & edge[1:]] = -1
    out = np.empty(len(key), np.int32)
    out[order] = ids
    return out


def _drop_short_runs(pointer: np.ndarray, need: int) -> None:
    """End positions whose run of undecided neighbours is shorter than a string still takes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (pointer >= 0).astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    short = last - first < need
    drop = np.zeros(len(pointer) + 1, np.int8)
    drop[first[short]] = 1
    drop[last[short]] -= 1
    pointer[np.cumsum(drop[:-1], dtype=np.int8) > 0] = -1


def _runs(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte spans [from, to) that the flagged strings cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(start + a), int(start + b - 1 + length)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, tag, text``: what tells a row apart, see above."""
    text = F.col(text_col)
    return docs.select(*(x.alias(k) for x, k in zip(_key(id_col, text_col), ("doc", "tag"), strict=True)), text.alias("text"))


def _key(id_col: str, text_col: str) -> tuple:
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(1), text_col)), F.xxhash64(text_col)


def _distinct(rows: tuple[np.ndarray, ...], length: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, list[tuple[int, int]]]:
    """A document's different contexts, how often it holds each, and the merged spans of those it holds twice."""
    start, count, c1, c2 = rows[0], rows[1], rows[4], rows[5]
    if len(np.unique(c1)) == len(c1):
        return rows, np.ones(len(c1), np.int64), []
    _, first, which, n = np.unique(np.stack([c1, c2], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    twice = n[which.ravel()] > 1
    spans = merged(list(zip(start[twice].tolist(), (start[twice] + count[twice] - 1 + length).tolist(), strict=True)))
    return tuple(x[first] for x in rows), n, spans


def repeated_spans(docs: DataFrame, length: int = 400, gather: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, tag, spans``: for each row with repeated strings, the byte spans they cover (``array<struct<a,b>>``).

    ``doc`` and ``tag`` are the row's key (``_key``).  ``gather`` bounds the different contexts of one bucket that are
    refined in a task; buckets above it are counted by hashes.
    """
    base = _keyed(docs, id_col, text_col)
    fields = ("start", "count", "anchor", "bucket", "c1", "c2")

    def anchors(batch):
        got = {k: [] for k in ("doc", "tag", *fields, "n")}
        for doc, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), strict=True):
            if len(t) < length:
                continue
            rows, n, spans = _distinct(anchor_rows(t, length), length)
            if spans:  # n = 0 marks a span [start, count)
                a, b = np.array(spans).T
                none = np.zeros(len(spans), np.int64)
                rows, n = [np.concatenate([x, y]) for x, y in zip(rows, (a, b, none, none, none, none), strict=True)], np.concatenate([n, none])
            for k, x in zip(("doc", "tag", *fields, "n"), (np.full(len(n), doc, np.int64), np.full(len(n), tag, np.int64), *rows, n), strict=True):
                got[k].append(x)
        return {k: np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in got.items()}

    made = stage(map_arrow(base, anchors, "doc long, tag long, start int, count int, anchor int, bucket long, c1 long, c2 long, n int"), "anchors")
    within = made.where("n = 0").select("doc", "tag", F.col("start").alias("a"), F.col("count").alias("b"))
    rows = made.where("n > 0")
    repeats = rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("c1").alias("c_lo"), F.max("c1").alias("c_hi"), F.min("c2").alias("d_lo"), F.max("c2").alias("d_hi")).where("n > 1")
    # a table of its own, so that the join below can split a bucket that holds very many rows
    repeats = stage(repeats.select("bucket", ((F.col("c_lo") != F.col("c_hi")) | (F.col("d_lo") != F.col("d_hi"))).alias("mixed")), "buckets")
    live = stage(rows.join(repeats, "bucket"), "repeated")
    span = ("doc", "tag", F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + length).alias("b"))
    whole = live.where("not mixed and n = 1").select(*span)

    # one row for each different context of a mixed bucket; those that occur twice are decided, and stay as partners
    kinds = stage(
        live.where("mixed").groupBy("bucket", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "tag", "start", "count", "anchor")).alias("r")),
        "contexts",
    )
    again = _held_again(live.where("mixed and n = 1"), kinds.where("n > 1")).select(*span)
    width = kinds.groupBy("bucket").agg(F.count("*").alias("width"), F.sum((F.col("n") == 1).cast("long")).alias("open")).where("open > 0")
    width = stage(width, "widths")
    wanted = kinds.join(width.select("bucket", (F.col("width") > gather).alias("wide")), "bucket").select("bucket", "n", "wide", "r.*")
    held = stage(_contexts(base, wanted, length), "bytes")
    tight = _refined(held.where("not wide"), length)
    return _gathered(within.union(whole).union(again).union(tight).union(_hashed(held.where("wide"), length)))


#: A context that so many rows hold is never met by a shuffle.
COMMON = 64


def _held_again(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """The rows whose context is in ``twice``.

    Contexts held more than ``most`` times are at most ``sum(n) / most <= FEW``, so they are broadcast whatever the size
    of the corpus; what then meets by a shuffle has at most ``most`` rows a key.
    """
    key = ["bucket", "c1", "c2"]
    total = twice.agg(F.sum("n")).first()[0] or 0
    most = max(COMMON, -(-total // FEW))
    common = F.broadcast(twice.where(F.col("n") > most).select(key))
    rare = rows.join(common, key, "left_anti").join(twice.where(F.col("n") <= most).select(key), key)
    return rows.join(common, key, "left_semi").unionByName(rare)


def _contexts(base: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` with the bytes its rows cover, read from their documents."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("bucket", "n", "wide", "start", "count", "anchor")).alias("rows"))  # bounded by the document's length
    schema = "doc long, tag long, start int, count int, anchor int, bucket long, n long, wide boolean, data binary"

    def cut(batch):
        out = {k: [] for k in ("doc", "tag", "start", "count", "anchor", "bucket", "n", "wide", "data")}
        for doc, tag, t, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), batch.column(3).to_pylist(), strict=True):
            for r in rows:
                out["doc"].append(doc)
                out["tag"].append(tag)
                out["data"].append(t[r["start"] : r["start"] + r["count"] - 1 + length])
                for k in ("start", "count", "anchor", "bucket", "n", "wide"):
                    out[k].append(r[k])
        return out

    joined = base.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "rows")
    return map_arrow(joined, cut, schema)


#: What a task refines at a time: whole buckets up to about so many bytes and rows.
PACK_BYTES, PACK_ROWS = 3 << 19, 4096


def _refined(held: DataFrame, length: int) -> DataFrame:
    """Spans of the rows refined in tasks: whole buckets, sorted together, a few MB of them at a time."""
    import pyarrow as pa

    out = T._parse_datatype_string("doc long, tag long, a int, b int")

    def run(batches):
        kept: list[tuple] = []
        bytes_ = 0

        def done(rows):
            doc, tag, start, count, anchor, bucket, n, data = zip(*rows, strict=True)
            flags = refine(np.array(bucket), data, np.array(anchor), np.array(count), length)
            spans = [(doc[i], tag[i], a, b) for i, f in enumerate(flags) if n[i] == 1 and f.any() for a, b in _runs(f, start[i], length)]
            cols = list(zip(*spans, strict=True)) if spans else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=out.names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept and (bytes_ > PACK_BYTES or len(kept) >= PACK_ROWS) and kept[-1][5] != r[5]:
                    yield done(kept)
                    kept, bytes_ = [], 0
                kept.append(r)
                bytes_ += len(r[7])
        if kept:
            yield done(kept)

    rows = held.select("doc", "tag", "start", "count", "anchor", "bucket", "n", "data").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, out)


def _hashed(held: DataFrame, length: int) -> DataFrame:
    """Spans of the rows of wide buckets: their strings counted by 128-bit hashes, no bucket gathered."""

    def windows(batch):
        out = {k: [] for k in ("doc", "tag", "at", "h1", "h2")}
        for doc, tag, start, count, anchor, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            buf = np.frombuffer(data, np.uint8)
            i = np.arange(count)
            salt = mix((anchor - i).astype(U))
            out["doc"].append(np.full(count, doc, np.int64))
            out["tag"].append(np.full(count, tag, np.int64))
            out["at"].append(start + i)
            out["h1"].append((span_hashes(prefix_sums(buf), i, i + length) ^ salt).view(np.int64))
            out["h2"].append(_second(buf, i, i + length).view(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()}

    strings = map_arrow(held.select("doc", "tag", "start", "count", "anchor", "data"), windows, "doc long, tag long, at int, h1 long, h2 long")
    twice = stage(strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "strings")
    return strings.join(twice, ["h1", "h2"]).select("doc", "tag", F.col("at").alias("a"), (F.col("at") + length).cast("int").alias("b"))


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # bounded by the document's length


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def with_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` (all columns) with a last column of the spans, null where a row has none."""
    spans = repeated_spans(docs, length, id_col=id_col, text_col=text_col, **more)
    doc, tag = fresh(docs, "_doc"), fresh(docs, "_tag")
    found = spans.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(fresh(docs, "repeated_spans")))
    return docs.withColumns(dict(zip((doc, tag), _key(id_col, text_col), strict=True))).join(found, [doc, tag], "left").drop(doc, tag)


def whole_words(text: bytes, a: int, b: int) -> int:
    """Words ``[^\\x20\\x09-\\x0D]+`` of ``text`` that lie within [a, b)."""
    inside = lambda i: 0 <= i < len(text) and text[i : i + 1].strip()
    return len(text[a:b].split()) - bool(inside(a - 1) and inside(a)) - bool(inside(b) and inside(b - 1))


def removed_report(docs: DataFrame, length: int = 400, **more) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept`` (the bytes that are left).

    Null text is empty; texts under ``length`` bytes and empty tables lose nothing; equal texts of ``length`` bytes
    or more are removed whole, repeated rows and rows without an id included; very long texts are handled in
    segments; other columns are ignored.
    """

    def digest(batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept")}
        for t, s in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
            m = merged([(x["a"], x["b"]) for x in s or ()])
            out["n_bytes"].append(len(t))
            out["n_removed"].append(sum(b - a for a, b in m))
            out["n_spans"].append(len(m))
            kept = kept_bytes(t, m)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["n_kept"].append(len(kept))
        return {"doc_id": batch.column(0), **out}

    rows = with_spans(docs.select("doc_id", "text"), length, **more).select("doc_id", "text", "repeated_spans")
    return map_arrow(rows, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long")


def without_repeats(docs: DataFrame, length: int = 400, words: int = 0, **more) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and ``n_chars`` counted anew, same columns.

    A passage is a longest run of bytes that repeated strings cover; only runs that hold ``words`` whole words or more
    are cut.  A character goes when all its bytes are covered, so the text stays valid UTF-8.  Null texts stay null, a
    text that is repeated as a whole becomes empty, and no row is dropped.
    """
    fields = docs.schema
    names = fields.names

    def cut(batch):
        texts = []
        for t, s in zip(texts_of(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            m = []
            for a, b in merged([(x["a"], x["b"]) for x in s or ()]):
                if words and whole_words(t, a, b) < words:
                    continue
                while a < b and t[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(t) and t[b] & 0xC0 == 0x80:
                    b -= 1
                m.append((a, b))
            texts.append(kept_bytes(t, m).decode() if m else t.decode())
        was = batch.column(batch.schema.get_field_index("text")).is_valid().to_pylist()
        texts = [t if ok else None for t, ok in zip(texts, was, strict=True)]
        out = {n: batch.column(i) for i, n in enumerate(names)} | {"text": texts}
        if "n_chars" in names:
            kept = batch.column(names.index("n_chars")).to_pylist()
            out["n_chars"] = [len(t) if t is not None else k for t, k in zip(texts, kept, strict=True)]
        return out

    return map_arrow(with_spans(docs, length, **more), cut, fields)
