"""Vectorised hashing of byte spans: one pass of numpy over many texts, no Python per word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte value.
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C13)  # odd, 3 mod 8
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                p = np.full(size, b, U)
                p[0] = 1
                _POWERS[i] = np.cumprod(p, dtype=U)
    return _POWERS[0], _POWERS[1]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of T[buf[j]] * P**j, mod 2**64."""
    up, _ = _powers(len(buf))
    out = np.zeros(len(buf) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[buf] * up[: len(buf)], dtype=U, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) for many spans; equal bytes hash alike wherever they stand."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each text, and where the texts begin (one more entry: the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8), at


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's first word (one more: the end).

    A text above 8 MB is cut at white space, so the buffers stay bounded.
    """
    parts, owner = [], []
    for i, t in enumerate(texts):
        while len(t) > (8 << 20) and (cut := max(t.rfind(bytes([c]), 0, 8 << 20) for c in (32, 9, 10, 11, 12, 13))) > 0:
            parts.append(t[:cut])
            owner.append(i)
            t = t[cut:]
        parts.append(t)
        owner.append(i)
    out, count = [], np.zeros(len(texts), np.int64)
    from revlake.llm.common import chunks

    for a, b in chunks(parts):
        buf, at = joined([p.translate(LOWER) for p in parts[a:b]] if lower else parts[a:b])
        start, end = word_spans(buf)
        out.append(span_hashes(prefix_sums(buf), start, end))
        edges = np.searchsorted(start, at)
        np.add.at(count, owner[a:b], np.diff(edges))
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(count)])


def pieces(text: bytes, gap, size: int) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes; all but the first begin with a match of ``gap``, so no word is cut."""
    at = 0
    while len(text) - at > size:
        cut = gap.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.concatenate([[True], _SPACE[buf], [True]])
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[::2], change[1::2]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


_CRC, _ONES = _crc_table(), np.uint32(0xFFFFFFFF)
#: Bytes of a span that are taken column by column; the rest of a longer one goes through zlib.
_WIDE = 64


def crc32_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of bytes [start, end) for many spans, each continued from its entry of ``before`` if given."""
    size = end - start
    order = np.argsort(np.uint8(_WIDE + 1) - np.minimum(size, _WIDE + 1).astype(np.uint8), kind="stable")
    state = (np.zeros(len(start), np.uint32) if before is None else before[order].astype(np.uint32)) ^ _ONES
    at, n = start[order], size[order]
    more = np.cumsum(np.bincount(np.minimum(n, _WIDE + 1), minlength=_WIDE + 2)[::-1])[::-1]  # more[k]: spans of k bytes or more
    for k in range(_WIDE):
        m = int(more[k + 1])
        if not m:
            break
        s = state[:m]
        state[:m] = _CRC[(s ^ buf[at[:m] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    state ^= _ONES
    for i in range(int(more[_WIDE + 1])):
        state[i] = zlib.crc32(buf[at[i] + _WIDE : at[i] + n[i]].tobytes(), int(state[i]))
    out = np.empty(len(start), np.uint32)
    out[order] = state
    return out
