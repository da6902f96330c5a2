"""BPE encoding and decoding with a tokenizer file's merges, long unsplit text by tree concatenation.

A text is split at special tokens and by the pattern; each distinct match is encoded once and remembered.  A match longer than
a leaf is halved until its parts are leaves, all leaves are encoded side by side, and neighbours are joined level by level.

*A join is exact.*  A sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is: the first
merge that crossed a border in the whole would be the first to cross it in the pair as well.  So the last tokens of the left
half and the first ones of the right half are encoded again as one window; when the window's encoding begins with the token
the left half has there and ends with the token the right half has there, both borders are pairs that stood before, and
the parts outside stay as they are.  Until both sides agree the window doubles, at most to the whole.

*Side by side* means in one array: in each round every match merges all places of its pair of least rank, leftmost first
where they overlap.  This equals one merge at a time because a merge is listed after those that make its parts, so a
merge never makes a pair of lower rank; the file is checked for that.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import map_arrow, texts_of

#: Bytes of a leaf.
LEAF = 256
#: Tokens of a window on each side, at first.
WINDOW = 4
#: Bytes that are encoded side by side.
TOGETHER = 1 << 18
#: Distinct matches a worker remembers.
REMEMBERED = 250_000
_NONE = np.int32(2**31 - 1)
_CACHES: dict[tuple[str, str], "TreeBpe"] = {}


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeBpe:
    """The byte-level BPE model of a tokenizer file; ``pattern`` is what its splitter uses."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        byte = byte_characters()
        self.bytes_of = {i: bytes(map(byte.__getitem__, t)) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = np.array([i for _, i in sorted((byte[t], i) for t, i in vocab.items() if len(t) == 1)], np.int32)
        if len(self.single) != 256:
            raise ValueError("every single byte must be a token")
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or any(len(x) > 1 and x not in made for x in (a, b)):
                raise ValueError("a merge must be listed after the merges that make its parts")
            made[a + b] = rank
        used: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            used.setdefault(a, rank)
            used.setdefault(b, rank)
        if any(used.get(t, rank + 1) <= rank for t, rank in made.items()):
            raise ValueError("a token must not be made anew after a merge that uses it")
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.rank = np.argsort(key).astype(np.int32)
        self.key = np.concatenate([key[self.rank], [np.iinfo(np.int64).max]])
        self.rank = np.concatenate([self.rank, [_NONE]])
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.known: dict[str, tuple[str, tuple[int, ...], bytes]] = {}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.pattern, self.compile = pattern, regex.compile
        self.split = regex.compile(pattern).findall
        self.classed = regex.compile(r"[\p{L}\p{N}]").match
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.seen: set[str] = set(map(chr, range(128)))
        self.unknown: set[str] = set()

    @classmethod
    def load(cls, path: str, pattern: str) -> "TreeBpe":
        """The model of a file, kept by the worker."""
        if (path, pattern) not in _CACHES:
            _CACHES[path, pattern] = cls(path, pattern)
        return _CACHES[path, pattern]

    def _meet(self, text: str) -> None:
        """Characters that are letters or digits in a newer Unicode than the file's splitter knows count as other signs."""
        new = set(text) - self.seen
        if not new:
            return
        self.seen |= new
        # between two letters (or digits) such a character is a part of its own
        late = {c for c in new if self.classed(c) and min(len(self.splitter.pre_tokenize_str(x + c + x)) for x in "a1") > 1}
        if late:
            self.unknown |= late
            out = "[" + "".join(f"\\U{ord(c):08x}" for c in sorted(self.unknown)) + "]"
            told = self.pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{out}]")
            told = told.replace(r" ?\p{L}", rf" ?[\p{{L}}--{out}]").replace(r" ?\p{N}", rf" ?[\p{{N}}--{out}]")
            self.split = self.compile("(?V1)" + told).findall

    def encode(self, texts: list[str]) -> list[list[tuple[str, tuple[int, ...], bytes]]]:
        """For each text and each of its matches the ids as decimal text, the ids, and the bytes they decode to."""
        split: list[list[str]] = []
        for t in texts:
            self._meet(t)
            split.append([m for i, part in enumerate(self.specials(t)) for m in ([part] if i % 2 else self.split(part))])
        new = [m for m in set().union(*split) if m not in self.known]
        full = len(self.known) + len(new) > REMEMBERED
        plain = [m for m in new if m not in self.special]
        ids_of = dict(zip(plain, self.encode_pieces([m.encode() for m in plain]), strict=True)) | {m: (i,) for m, i in self.special.items()}
        for m in new:
            self.known[m] = (",".join(map(str, ids_of[m])), ids_of[m], self.decode(ids_of[m]))
        out = [list(map(self.known.__getitem__, ms)) for ms in split]
        if full:  # what was learnt first is mostly what is frequent; it stays
            for m in new:
                del self.known[m]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of whole matches, long ones by tree concatenation."""
        leaves: list[bytes] = []
        trees: list[range] = []
        for p in pieces:
            parts = [p]
            while len(parts[0]) > LEAF:
                parts = [x for q in parts for x in (q[: (len(q) + 1) // 2], q[(len(q) + 1) // 2 :])]
            trees.append(range(len(leaves), len(leaves) + len(parts)))
            leaves += parts
        coded = self.side_by_side(leaves)
        level = [[coded[i] for i in tree] for tree in trees]
        while any(len(x) > 1 for x in level):
            joined = iter(self._joined([(x[i], x[i + 1]) for x in level for i in range(0, len(x) - 1, 2)]))
            level = [[next(joined) for _ in range(len(x) // 2)] + x[len(x) // 2 * 2 :] for x in level]
        return [tuple(x[0].tolist()) for x in level]

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The encoding of the bytes of each pair of encodings."""
        out: list[np.ndarray] = [self.single[:0]] * len(pairs)
        open_, k = list(range(len(pairs))), WINDOW
        while open_:
            windows = [self.decode(np.concatenate([pairs[i][0][-k:], pairs[i][1][:k]]).tolist()) for i in open_]
            again = []
            for i, mid in zip(open_, self.side_by_side(windows), strict=True):
                left, right = pairs[i]
                if (k >= len(left) or mid[0] == left[-k]) and (k >= len(right) or mid[-1] == right[k - 1]):
                    out[i] = np.concatenate([left[:-k], mid, right[k:]])
                else:
                    again.append(i)
            open_, k = again, 2 * k
        return out

    def side_by_side(self, parts: list[bytes]) -> list[np.ndarray]:
        """The encoding of each part by itself."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(parts):
            hi, held = lo, 0
            while hi < len(parts) and (hi == lo or held + len(parts[hi]) <= TOGETHER):
                held += len(parts[hi])
                hi += 1
            out += self._merged(parts[lo:hi])
            lo = hi
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def _merged(self, parts: list[bytes]) -> list[np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = self.single[np.frombuffer(b"".join(parts), np.uint8)]
        owner = np.repeat(np.arange(len(parts)), size)
        rank = np.full(len(ids), _NONE, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, np.diff(np.concatenate([first, [len(ids)]])))
            if (over := least == _NONE).any():
                done.append((owner[over], ids[over]))
                going = ~over
                owner, ids, rank, least = owner[going], ids[going], rank[going], least[going]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            # of places that overlap, as in x x x, every second one from the left
            start = np.concatenate([[True], np.diff(at) > 1])
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1
            owner, ids, rank = owner[stay], ids[stay], rank[stay]
            rank[at] = _NONE
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(ids)]
                i = i[owner[i] == owner[i + 1]]
                rank[i] = self._ranks(ids[i], ids[i + 1])
        owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([x for _, x in done]) if done else self.single[:0]
        order = np.argsort(owner, kind="stable")
        return np.split(flat[order], np.cumsum(np.bincount(owner, minlength=len(parts)))[:-1]) if len(parts) else []


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, unless ``ids`` is off, ``ids array<int>``.

    Every row is encoded whole and its ids are decoded again.  Special tokens that stand in a text get their id.  Null and empty
    texts have no ids (the digests are those of nothing); equal texts and repeated rows give equal rows; unsplit text of
    any length is encoded by tree concatenation; an empty table gives no rows; other columns are ignored.
    """

    def f(batch):
        bpe = TreeBpe.load(path, pattern)
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
        texts = [t.decode() for t in texts_of(batch)]
        for lo in range(0, len(texts), 64):
            for parts in bpe.encode(texts[lo : lo + 64]):
                out["n_tokens"].append(sum([len(p[1]) for p in parts]))
                out["ids_sha256"].append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                if ids:
                    out["ids"].append(list(chain.from_iterable([p[1] for p in parts])))
        return {"doc_id": batch.column(0), **out}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, schema)


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, text``; bytes that are no UTF-8 become U+FFFD, null ids give null, an unknown id is an error."""

    def f(batch):
        bpe = TreeBpe.load(path, pattern)
        return {"doc_id": batch.column(0), "text": [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]}

    return map_arrow(rows.select("doc_id", "ids"), f, "doc_id long, text string")
