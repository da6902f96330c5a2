"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by the vocabulary's pattern; each distinct match is encoded once and remembered.  Matches to encode
are put in buckets by length as padded matrices of token ids.  In each round every row merges its leftmost pair of
minimum rank; ranks of pairs come from an open-addressing hash table, and only the two pairs beside a merge are looked
up anew.  Finished rows leave the matrix and its width shrinks.  A match too long for a matrix is merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import map_arrow, texts_of
from revlake.llm.hashing import U, mix

#: Longer matches are merged with a heap.
WIDEST = 1024
#: Distinct matches a worker remembers.
REMEMBERED = 250_000
_NONE = np.int32(2**31 - 1)
_CACHES: dict[tuple[str, str], "ByteBpe"] = {}


class PairTable:
    """(left, right) -> id of their merge, which is its rank too; vectorised linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in pairs], U)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask = U(size - 1)
        self.keys, self.values = np.full(size, ~U(0)), np.full(size, _NONE, np.int32)
        at = mix(keys) & self.mask
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] == ~U(0)]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + U(1)) & self.mask

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(U) << U(32) | b.astype(U)
        at = mix(key) & self.mask
        out = np.where((self.keys[at] == key), self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != ~U(0)))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + U(1)) & self.mask
            found = self.keys[at[open_]] == key[open_]
            out[open_[found]] = self.values[at[open_[found]]]
            open_ = open_[~found & (self.keys[at[open_]] != ~U(0))]
        return out


class ByteBpe:
    """A vocabulary of ranks and its splitting pattern; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBpe":
        """The vocabulary of a rank file, kept by the worker."""
        if (path, pattern) not in _CACHES:
            with open(path, "rb") as f:
                _CACHES[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        return _CACHES[path, pattern]

    def encode(self, texts: list[str]) -> list[list[tuple[str, tuple[int, ...]]]]:
        """For each text and each of its matches the ids, also as decimal text."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        new = [m for m in distinct if m not in self.known]
        full = len(self.known) + len(new) > REMEMBERED
        for m, ids in zip(new, self.encode_pieces([m.encode() for m in new]), strict=True):
            self.known[m] = (",".join(map(str, ids)), ids)
        out = [list(map(self.known.__getitem__, ms)) for ms in split]
        if full:  # what was learnt first is mostly what is frequent; it stays
            for m in new:
                del self.known[m]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = (self.ranks[p],)
            elif len(p) > WIDEST:
                out[i] = self._heap(p)
            elif p:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        size = np.array([len(p) for p in pieces])
        ids = self.single[raw]
        rows = np.arange(len(pieces))
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        ranks[np.arange(width - 1) >= size[:, None] - 1] = _NONE
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            low = ranks[line, best] if ranks.shape[1] else np.full(len(rows), _NONE)
            done = low == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = tuple(ids[k, : size[k]].tolist())
                going = ~done
                rows, ids, ranks, size, best, low = rows[going], ids[going], ranks[going], size[going], best[going], low[going]
                if not len(rows):
                    return out
                wide = int(size.max())
                ids, ranks = ids[:, :wide], ranks[:, : wide - 1]
                line = np.arange(len(rows))
            # close the gap behind the merge; the last column only repeats what is cut off by the size
            cols = np.arange(ids.shape[1])
            ids[line, best] = low
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > best[:, None]), ids.shape[1] - 1), axis=1)
            cols = np.arange(ranks.shape[1])
            moved = np.minimum(cols + (cols >= best[:, None]), ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            size = size - 1
            ranks[cols >= size[:, None] - 1] = _NONE
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < size - 1))
                ranks[ok, at[ok]] = self.pairs.get(ids[ok, at[ok]], ids[ok, at[ok] + 1])

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[j] is None or len(parts[i]) + len(parts[j]) != size or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(whole := parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(whole)))
        return tuple(self.ranks[p] for p in parts if p is not None)


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, unless ``ids`` is off, ``ids array<int>``.

    Every row is encoded whole and its ids are decoded again.  Null and empty texts have no ids (the digests are
    those of nothing); equal texts and repeated rows give equal rows; a match too long for the padded matrices is merged
    by a heap in the same order of ranks, ties leftmost first; an empty table gives no rows; other columns are ignored.
    """

    def f(batch):
        bpe = ByteBpe.load(path, pattern)
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
        texts = [t.decode() for t in texts_of(batch)]
        for lo in range(0, len(texts), 64):
            for parts in bpe.encode(texts[lo : lo + 64]):
                flat = list(chain.from_iterable([p[1] for p in parts]))
                out["n_tokens"].append(len(flat))
                out["ids_sha256"].append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(flat)).hexdigest())
                if ids:
                    out["ids"].append(flat)
        return {"doc_id": batch.column(0), **out}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, schema)


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, bytes``; null ids give null, an id outside the vocabulary is an error."""

    def f(batch):
        bpe = ByteBpe.load(path, pattern)
        return {"doc_id": batch.column(0), "bytes": [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]}

    return map_arrow(rows.select("doc_id", "ids"), f, "doc_id long, bytes binary")
