"""GIF media columns: a codec for GIF89a streams and frame rows with colour histograms.

``decode`` reads any GIF87a/89a stream: LZW code streams of any code size, global and local palettes, interlacing,
disposal, transparency and delays; every frame comes with its palette numbers and with the canvas it leaves on screen.
``encode_bytes`` stores arbitrary bytes losslessly as 8-bit samples of a grey palette, as timed frames of at most
``FRAME_ROWS`` rows of 64 samples.  Only the encoder walks an LZW dictionary: what a code stands for is a stretch of what
was decoded before, one sample longer than the code that made the entry, so numpy expands the code streams of many
images together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import chunks, map_arrow, texts_of

WIDTH = 64
FRAME_ROWS = 4096
_GREY = bytes(v for v in range(256) for _ in range(3))


@dataclass
class Frame:
    """``index``: palette numbers of the frame's own rectangle; ``canvas``: RGBA of the whole screen after it."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    index: np.ndarray
    canvas: np.ndarray


#: Codes read at a time after a clear code; a table is full after fewer.
_PLAN = 5200


@cache
def _widths(size: int, n: int = _PLAN) -> np.ndarray:
    """Bits of each of the first ``n`` codes after a clear code: the width follows from the entries known by then."""
    # the reader adds an entry with each code but the first
    known = (1 << size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.floor(np.log2(known + 0.5)).astype(np.int64) + 1)


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """A GIF code stream (no sub-blocks) of samples below ``1 << size``."""
    clear, stop = 1 << size, (1 << size) + 1
    codes, widths = [np.array([clear])], [np.array([size + 1])]
    samples = iter(data)
    prefix = next(samples, None)
    if prefix is None:
        codes.append(np.array([stop]))
        widths.append(np.array([size + 1]))
    else:
        prefix <<= 8  # codes are held shifted, so that a key is one "or"
    while prefix is not None:
        table: dict[int, int] = {}
        get = table.get
        listed: list[int] = []
        put = listed.append
        free, full = stop + 1 << 8, 4095 << 8
        for c in samples:
            key = prefix | c
            longer = get(key)
            if longer is None:
                put(prefix)
                prefix = c << 8
                if free == full:  # start over with this sample
                    break
                table[key] = free
                free += 256
            else:
                prefix = longer
        else:
            put(prefix)
            prefix = None
        codes.append(np.array(listed, np.int64) >> 8)
        codes.append(np.array([clear if prefix is not None else stop]))
        widths.append(_widths(size)[: len(listed) + 1])
    return _pack(np.concatenate(codes), np.concatenate(widths))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _code_runs(stream: bytes, size: int) -> list[np.ndarray]:
    """The codes of a stream, a run for each clear code; the stop code and what follows it are left out."""
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int32)
    windows = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    clear, stop = 1 << size, (1 << size) + 1
    edge = np.concatenate([[0], np.cumsum(_widths(size))])
    runs, at, total = [], 0, 8 * len(stream)
    while at + size + 1 <= total:
        parts, marks = [], np.zeros(0, np.int64)
        first, count = 0, 0  # of the run's codes
        while not len(marks):
            steps = edge if not first else 12 * np.arange(_PLAN + 1)  # a full table: 12 bits each
            usable = int(np.searchsorted(steps, total - at, side="right")) - 1
            if usable <= 0:
                at = total
                break
            begin = at + steps[:usable]
            got = windows[begin >> 3] >> (begin & 7) & (1 << np.diff(steps[: usable + 1])) - 1
            marks = np.flatnonzero((got == clear) | (got == stop))
            count = int(marks[0]) if len(marks) else usable
            parts.append(got[:count])
            at += int(steps[count + 1] if len(marks) else steps[usable])
            first += count
        if first:
            runs.append(np.concatenate(parts))
        if len(marks) and got[marks[0]] == stop:
            break
    return runs


def lzw_decode(stream: bytes, size: int, want: int) -> bytes:
    """The samples of a GIF code stream; a stream that ends early is filled up with 0."""
    return _expand([(stream, size, want)])[0]


def _expand(images: list[tuple[bytes, int, int]]) -> list[bytes]:
    """The samples of ``(stream, code size, samples wanted)`` images, all at once.

    Within a run, code ``k`` is a sample or names the entry that code ``j < k`` made: the samples of ``j`` and one more,
    which follow each other in the output from where ``j`` begins.  Lengths and sources are then found by doubling.
    """
    runs: list[np.ndarray] = []
    parents, counts = [], []
    base = 0
    for stream, size, _ in images:
        mine = _code_runs(stream, size)
        counts.append(sum(map(len, mine)))
        for r in mine:
            own = np.arange(len(r))
            maker = r - (1 << size) - 2
            if maker[0] >= 0 or (maker >= own).any():
                raise ValueError("a GIF code stream holds an unknown code")
            parents.append(np.where(r < 1 << size, own, maker) + base)
            base += len(r)
        runs += mine
    if not base:
        return [bytes(want) for _, _, want in images]
    code, parent = np.concatenate(runs), np.concatenate(parents).astype(np.int32)
    hop, more = parent, (parent != np.arange(base, dtype=np.int32)).astype(np.int32)
    literal = more == 0
    while True:
        more += more[hop]
        further = hop[hop]
        if (further == hop).all():
            break
        hop = further
    length = more + 1
    start = np.cumsum(length, dtype=np.int64)
    end_of, start = start, start - length
    # a sample that is no code of its own is the one so much further back
    back = np.repeat(np.where(literal, 0, start - start[parent]), length)
    source = np.arange(len(back)) - back
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(back), np.uint8)
    value[start[literal]] = code[literal]
    out, ends, at = value[source].tobytes(), np.concatenate([[0], end_of]), 0
    got = []
    for (_, _, want), n in zip(images, counts, strict=True):
        a, b = int(ends[at]), int(ends[at + n])
        got.append(out[a : min(b, a + want)].ljust(want, b"\0"))
        at += n
    return got


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _sub_blocks(gif: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while gif[at]:
        parts.append(gif[at + 1 : at + 1 + gif[at]])
        at += 1 + gif[at]
    return b"".join(parts), at + 1


def encode_bytes(data: bytes, delay_ms: int = 100) -> bytes:
    """Any bytes, padded with 0 to a positive multiple of 64, as a GIF of grey samples."""
    data = data + bytes(-len(data) % WIDTH if data else WIDTH)
    rows = len(data) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = data[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_ms // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class _Image:
    """A frame as it is written: where it goes, how it is shown, and its code stream."""

    box: tuple[int, int, int, int]
    interlaced: bool
    colours: np.ndarray | None
    control: tuple[int, int, int | None]
    size: int
    stream: bytes


def decode(gif: bytes) -> list[Frame]:
    """The frames of a GIF.  Malformed streams are a ``ValueError``."""
    screen, images = _parsed(gif)
    return list(_shown(screen, images, _expand([(x.stream, x.size, x.box[2] * x.box[3]) for x in images])))


def decode_all(gifs: list[bytes]) -> Iterable[list[Frame]]:
    """The frames of many GIFs, whose code streams are expanded together, about 256 KB of them at a time."""
    for a, b in chunks(gifs, 1 << 18):
        parsed = [_parsed(g) for g in gifs[a:b]]
        samples = iter(_expand([(x.stream, x.size, x.box[2] * x.box[3]) for _, images in parsed for x in images]))
        for screen, images in parsed:
            yield list(_shown(screen, images, [next(samples) for _ in images]))


def _parsed(gif: bytes) -> tuple[tuple[int, int], list[_Image]]:
    try:
        return _parse(gif)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF stream ends early") from e


def _parse(gif: bytes) -> tuple[tuple[int, int], list[_Image]]:
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF stream")
    wide, high, flags = struct.unpack_from("<HHB", gif, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        palette = np.frombuffer(gif[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    images: list[_Image] = []
    disposal, delay, clear_colour = 0, 0, None
    while gif[at] != 0x3B:
        if gif[at] == 0x21:
            label = gif[at + 1]
            body, at = _sub_blocks(gif, at + 2)
            if label == 0xF9:
                packed, delay, number = struct.unpack("<BHB", body[:4])
                disposal, clear_colour = packed >> 2 & 7, number if packed & 1 else None
            continue
        if gif[at] != 0x2C:
            raise ValueError("an unknown block in a GIF stream")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        colours = palette
        if flags & 0x80:
            n = 3 * (2 << (flags & 7))
            colours = np.frombuffer(gif[at : at + n], np.uint8).reshape(-1, 3)
            at += n
        size = gif[at]
        if not 1 <= size <= 8:
            raise ValueError("a GIF code size out of range")
        body, at = _sub_blocks(gif, at + 1)
        images.append(_Image((left, top, w, h), bool(flags & 0x40), colours, (disposal, delay, clear_colour), size, body))
        disposal, delay, clear_colour = 0, 0, None
    return (wide, high), images


def _shown(size: tuple[int, int], images: list[_Image], samples: list[bytes]) -> Iterable[Frame]:
    """The frames in turn: palette applied, transparent samples left out, and the screen disposed of as asked."""
    wide, high = size
    screen = np.zeros((high, wide, 4), np.uint8)
    for image, data in zip(images, samples, strict=True):
        left, top, w, h = image.box
        disposal, delay, clear_colour = image.control
        index = np.frombuffer(data, np.uint8).reshape(h, w)
        if image.interlaced:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            index = index[np.argsort(order)]
        before = screen.copy() if disposal == 3 else None
        ys, xs = max(0, min(h, high - top)), max(0, min(w, wide - left))
        part = index[:ys, :xs]
        table = np.zeros((256, 4), np.uint8)
        if image.colours is not None:
            table[: len(image.colours), :3] = image.colours
        table[:, 3] = 255
        area = screen[top : top + ys, left : left + xs]
        colours = table.view("<u4").ravel()[part].view(np.uint8).reshape(*part.shape, 4)
        if clear_colour is None:
            area[:] = colours
        else:
            ink = part != clear_colour
            area[ink] = colours[ink]
        shown = screen.copy()
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            screen = before
        yield Frame(left, top, w, h, delay * 10, disposal, clear_colour, index, shown)


@cache
def _boxes(bins: int) -> np.ndarray:
    return (np.arange(256) * bins >> 8).astype(np.int32)


def histogram(canvas: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of a canvas' colours in ``bins**3`` boxes, transparent pixels left out."""
    flat, box = canvas.reshape(-1, 4), _boxes(bins)
    if not (flat[:, 3] == 255).all():
        flat = flat[flat[:, 3] > 0]
    return np.bincount((box[flat[:, 0]] * bins + box[flat[:, 1]]) * bins + box[flat[:, 2]], minlength=bins**3)


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", bins: int = 4) -> DataFrame:
    """One row per frame: ``id, frame, at_ms, delay_ms, left, top, width, height, disposal, pixels, histogram``.

    ``pixels`` are the frame's palette numbers, ``histogram`` counts the colours of the screen after it.  Null media have
    no frames; a malformed stream gives one row whose ``error`` tells why.
    """
    names = ("frame", "at_ms", "delay_ms", "left", "top", "width", "height", "disposal", "pixels", "histogram", "error")

    def f(batch):
        out: dict[str, list] = {k: [] for k in ("id", *names)}
        for key, gif in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if gif is None:
                continue
            try:
                shown, error = decode(gif), None
            except ValueError as e:
                shown, error = [], str(e)
            at = 0
            rows = [(k, x.delay_ms, x.left, x.top, x.width, x.height, x.disposal, x.index.tobytes(), histogram(x.canvas, bins).tolist(), None) for k, x in enumerate(shown)]
            for k, delay, *rest in rows or ([(None,) * 9 + (error,)] if error else []):
                for name, v in zip(("id", *names), (key, k, None if k is None else at, delay, *rest), strict=True):
                    out[name].append(v)
                at += delay or 0
        return out

    schema = "id long, frame int, at_ms int, delay_ms int, left int, top int, width int, height int, disposal int, pixels binary, histogram array<long>, error string"
    return map_arrow(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col)), f, schema)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text (null: empty) as a GIF; other columns are ignored."""

    def f(batch):
        texts = texts_of(batch)
        return {"doc_id": batch.column(0), "n_bytes": list(map(len, texts)), "media": [encode_bytes(t) for t in texts]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), f, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """``doc_id, media, n_bytes`` to the digests of what the stored bytes hold.

    ``feature`` is taken from the frames as they are shown, after palette, transparency and disposal: how many, the play
    time, and the boxes ``red.green.blue=pixels`` of a colour histogram of four steps a channel, summed over the frames.
    """

    def f(batch):
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        gifs = batch.column(1).to_pylist()
        for gif, shown in zip(gifs, decode_all(gifs), strict=True):
            payload = b"".join(x.index.tobytes() for x in shown)
            colours = sum(histogram(x.canvas) for x in shown)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(gif))
            out["media_sha256"].append(hashlib.sha256(gif).hexdigest())
            out["feature"].append(f"{len(shown)}:{sum(x.delay_ms for x in shown)}:" + ",".join(f"{i >> 4}.{i >> 2 & 3}.{i & 3}={colours[i]}" for i in np.flatnonzero(colours).tolist()))
        return {"doc_id": batch.column(0), "n_bytes": batch.column(2), **out}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(media.select("doc_id", "media", "n_bytes"), f, schema)
