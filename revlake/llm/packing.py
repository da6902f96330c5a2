"""Best-fit sequence packing by a grouping genetic algorithm, run as islands with elite migration.

Documents are tokenised once into pieces of at most ``capacity`` tokens; only the pieces' lengths take part in the
packing.  Full pieces fill a sequence each.  The others are dealt by a hash of their row key into lots of about
``lot`` pieces, which spread over the cluster.  On every lot ``islands`` populations evolve apart, each in its own task.
A child takes whole well-filled bins of one parent into the other, bins that then hold a document twice are dissolved,
and the displaced documents are placed again by best fit, longest first.  Between epochs each island sends its best
packing to the next one of the ring; after the last epoch the lot keeps the best of all islands.

A lot's free room is lost only where it is spread over bins, so among packings of equally many bins those are fitter
that gather it in one.  This emptiest bin of each lot is opened again, and the pieces of all of them are packed by the same
algorithm, level by level, until one lot is left: what no lot could fill alone is filled together.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import chunks, map_arrow, stage, texts_of
from revlake.llm.hashing import LOWER, U, joined, mix, word_spans

_CACHES: dict[str, "_Words"] = {}
#: Words whose ids a worker remembers, and those it remembers without the signs behind them.
REMEMBERED, CORES = 400_000, 250_000
#: Signs that end a word without being part of it; one between other signs or before an apostrophe stays where it is.
_TAIL = b".,!?;:%&$*"
#: Longer words are looked up as bytes.
_SHORT = 16


class _Words:
    """Ids of the words between ASCII white space, from a table of numpy arrays, by the tokenizer on a miss.

    A word of up to 16 bytes is two 64-bit numbers and its length, so the table compares whole words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # special tokens are cut out of a text before it is lower-cased; what looks like one afterwards is ordinary text
        self.special = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")").split
        self.tokenizer.encode_special_tokens = True
        self.cores: dict[bytes, bytes] = {}
        self.long: dict[bytes, int] = {}
        size = 1 << (2 * REMEMBERED - 1).bit_length()
        self.mask = U(size - 1)
        self.head, self.rest, self.size, self.entry = np.zeros(size, U), np.zeros(size, U), np.zeros(size, np.uint8), np.full(size, -1, np.int32)
        self.used = self.listed = 0
        self.offset, self.count = np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int32)
        self.pool, self.filled = np.zeros(1 << 22, np.uint32), 0
        # a sign that is one token of its own parts the words of one call
        self.mark = next(m for m in ("|", "~", "^") if len(self._encode(m)) == 1)
        self.mark_id = self._encode(self.mark)[0]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, many to a call."""
        mark = self.mark.encode()
        out: list[np.ndarray] = [self.pool[:0]] * len(words)
        plain = [i for i, w in enumerate(words) if mark not in w]
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            ids = self._encode("".join(f"{words[i].decode()} {self.mark} " for i in part))
            cut = np.flatnonzero(ids == self.mark_id).tolist()
            at = 0
            for i, end in zip(part, cut, strict=True):
                out[i] = ids[at:end]
                at = end + 1
        for i, w in enumerate(words):
            if mark in w:
                out[i] = self._encode(w.decode())
        return out

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of new words.  Signs at the end of a word whose last character is surely a letter or digit are a match of their
        own for the tokenizer, so the word before them is shared by all its endings."""
        parts = []
        for w in words:
            core = w.rstrip(_TAIL)
            last = core[-1:]
            sure = core and core != w and (last.isalnum() or (len(core) > 1 and core[-2] == 0xC3 and last not in (b"\x97", b"\xb7")))
            parts.append((core, w[len(core) :]) if sure else (w, b""))
        cores = self.cores
        new = list({x for p in parts for x in p if x and x not in cores})
        full = len(cores) + len(new) > CORES
        cores.update(zip(new, (x.tobytes() for x in self._encoded(new)), strict=True))
        out = [np.frombuffer(cores[core] + cores[tail] if tail else cores[core], np.uint32) for core, tail in parts]
        if full:
            for x in new:
                del cores[x]
        return out

    def _add(self, ids: list[np.ndarray]) -> int:
        """Entries for lists of ids; the number of the first."""
        first, flat = self.used, np.concatenate(ids) if ids else self.pool[:0]
        n = np.array([len(x) for x in ids], np.int32)
        while self.used + len(ids) > len(self.offset):
            self.offset, self.count = np.concatenate([self.offset, self.offset]), np.concatenate([self.count, self.count])
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.offset[first : first + len(ids)] = self.filled + np.cumsum(n) - n
        self.count[first : first + len(ids)] = n
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.used, self.filled = first + len(ids), self.filled + len(flat)
        return first

    def _find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Entries of words, -1 where there is none; ``at`` is left where each search ended."""
        out = np.full(len(a), -1, np.int32)
        open_ = np.arange(len(a))
        while len(open_):
            s = at[open_]
            e = self.entry[s]
            same = (self.head[s] == a[open_]) & (self.rest[s] == b[open_]) & (self.size[s] == n[open_]) & (e >= 0)
            out[open_[same]] = e[same]
            open_ = open_[(e >= 0) & ~same]
            at[open_] = (at[open_] + U(1)) & self.mask
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        parts = [self.cut(t) if any(x in t for x in self.special) else [t] for t in texts]
        plain = iter(self._plain([x for p in parts for x in p[::2]]))
        return [b"".join(self.special[x] if i % 2 else next(plain) for i, x in enumerate(p)) for p in parts]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        used, filled = self.used, self.filled
        keep = self.listed < REMEMBERED
        buf, edges = joined([t.translate(LOWER) for t in texts])
        start, end = word_spans(buf)
        n = end - start
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(_SHORT, np.uint8)]), 8)
        low = lambda x, k: x & np.where(k >= 8, ~U(0), (U(1) << (np.clip(k, 0, 7).astype(U) * U(8))) - U(1))
        a = low(windows[start].view("<u8").ravel(), n)
        b = low(windows[np.minimum(start + 8, len(buf))].view("<u8").ravel(), n - 8)
        entry = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(n <= _SHORT)
        with np.errstate(over="ignore"):
            key = mix(a + mix(b + n.astype(U)))
        sa, sb, sn, at = a[short], b[short], n[short].astype(np.uint8), key[short] & self.mask
        entry[short] = self._find(sa, sb, sn, at)
        raw = buf.tobytes()
        todo = short[entry[short] < 0]
        while len(todo):
            _, one, which = np.unique(key[todo], return_index=True, return_inverse=True)
            pick = todo[one]
            first = self._add(self._learn([raw[x:y] for x, y in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]))
            got = pick[which]
            same = (a[got] == a[todo]) & (b[got] == b[todo]) & (n[got] == n[todo])  # else two words of one key
            entry[todo[same]] = first + which[same]
            if keep:
                some = pick[: REMEMBERED - self.listed]  # the table never fills up
                self.listed += len(some)
                self._insert(a[some], b[some], n[some].astype(np.uint8), key[some] & self.mask, first + np.arange(len(some), dtype=np.int32))
            todo = todo[~same]
        long = np.flatnonzero(n > _SHORT)
        if len(long):
            ws = [raw[x:y] for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(ws) if w not in self.long]
            first = self._add(self._learn(new))
            self.long.update(zip(new, range(first, first + len(new)), strict=True))
            entry[long] = [self.long[w] for w in ws]
            if not keep:
                for w in new:
                    del self.long[w]
        count = self.count[entry].astype(np.int64)
        total = np.cumsum(count)
        place = np.repeat(self.offset[entry] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        flat = self.pool[place].astype("<u4")
        if not keep:  # what was learnt first is mostly what is frequent; it stays
            self.used, self.filled = used, filled
        cut = np.concatenate([[0], total])[np.searchsorted(start, edges)]
        return [flat[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _insert(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, at: np.ndarray, entry: np.ndarray) -> None:
        left = np.arange(len(a))
        while len(left):
            free = left[self.entry[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            s = at[put]
            self.head[s], self.rest[s], self.size[s], self.entry[s] = a[put], b[put], n[put], entry[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + U(1)) & self.mask


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit bytes, by a tokenizer that lower-cases, its special tokens included.

    The tokenizer drops white space and never joins across it, so ids of the words between ASCII white space, in
    turn, are the ids of the text; each distinct word is encoded once.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CACHES:
        _CACHES[path] = _Words(path)
    return [ids for x, y in chunks(texts) for ids in _CACHES[path].ids(texts[x:y])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and ``ids`` if wanted: each document's ids and the end id, cut only above ``capacity``."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids)

    def cut(batch):
        out = {k: [] for k in names}
        tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for doc, held in zip(batch.column(0).to_pylist(), token_ids(texts_of(batch), tokenizer), strict=True):
            held += tail
            for k, at in enumerate(range(0, len(held), step)):
                part = held[at : at + step]
                for name, x in zip(names, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                    out[name].append(x)
        return out

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(base, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


class Packing:
    """Bins of item numbers with their free room; best fit keeps the bins sorted by room."""

    __slots__ = ("bins", "room")

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    def cost(self, capacity: int) -> float:
        """Fewer bins first; among as many, those whose free room lies in few bins."""
        return len(self.bins) + 1 - sum(((capacity - r) / capacity) ** 2 for r in self.room) / max(1, len(self.bins))

    def ideal(self) -> bool:
        """All free room is in one bin."""
        return sum(self.room) == max(self.room, default=0)


def best_fit(bins: list[list[int]], room: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Place ``items`` in turn into the bin with the least sufficient room, else into a new bin."""
    bins, room = list(bins), list(room)
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, b = free.pop(at)
            bins[b] = [*bins[b], i]
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[b] = r - s
        if r > s:
            insort(free, (r - s, b))
    return Packing(bins, room)


#: Share of the bins with room that a crossover dissolves besides those it must, and how far it departs from longest-first.
OPENED, SHAKEN = 0.5, 0.05


def _cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng) -> Packing:
    """Inject well-filled bins of ``b`` into ``a``, dissolve bins they collide with, best-fit the displaced items."""
    order = np.argsort(b.room, kind="stable")
    full = order[: max(1, len(order) // 2)]
    lo = int(rng.integers(0, len(full)))
    taken = full[lo : lo + max(1, int(rng.integers(1, max(2, len(full) // 4))))]
    inside = {i for k in taken for i in b.bins[k]}
    bins, room, loose = [b.bins[k] for k in taken], [b.room[k] for k in taken], []
    opened = rng.random(len(a.room)) < OPENED  # of the bins with room
    for items, r, o in zip(a.bins, a.room, opened, strict=True):
        if inside.isdisjoint(items) and not (r and o):
            bins.append(items)
            room.append(r)
        else:
            loose += [i for i in items if i not in inside]
    shaken = 1 + SHAKEN * rng.random(len(loose))
    order = sorted(zip((-sizes[i] * x for i, x in zip(loose, shaken, strict=True)), loose, strict=True))
    return best_fit(bins, room, [i for _, i in order], sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]], population: int, generations: int) -> Packing:
    """One island's epoch; ``elites`` are packings (a bin number for each item) that it starts from."""
    rng = np.random.default_rng(seed)
    pop = []
    for bin_of in elites:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(bin_of):
            bins.setdefault(k, []).append(i)
        pop.append(Packing(list(bins.values()), [capacity - sum(sizes[i] for i in x) for x in bins.values()]))
    if not pop:
        pop.append(best_fit([], [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity))
    while len(pop) < population and not any(p.ideal() for p in pop):
        noise = rng.random(len(sizes)) * 0.15 + 1
        pop.append(best_fit([], [], sorted(range(len(sizes)), key=lambda i: -sizes[i] * noise[i]), sizes, capacity))
    pop.sort(key=lambda p: p.cost(capacity))
    for _ in range(generations):
        if pop[0].ideal() or len(pop) < 2:
            break
        i, j = rng.choice(len(pop), 2, replace=False)
        child = _cross(pop[min(i, j)], pop[max(i, j)], sizes, capacity, rng)
        if child.cost(capacity) < pop[-1].cost(capacity):
            pop[-1] = child
            pop.sort(key=lambda p: p.cost(capacity))
    return pop[0]


def _bin_of(p: Packing, n: int) -> list[int]:
    """A bin number for each item; bin 0 is the emptiest."""
    out = [0] * n
    for k, b in enumerate(sorted(range(len(p.bins)), key=lambda b: -p.room[b])):
        for i in p.bins[b]:
            out[i] = k
    return out


def _evolved(rows: DataFrame, lots: int, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """``key, length, lot, bin`` of ``key, length``: the best packing of each lot after all epochs."""
    dealt = rows.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(lots)).alias("lot"))
    # about `lot` rows each, sorted so that every island sees the same item numbers
    held = dealt.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("items"))
    state = held.select("lot", "items", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.array().cast("array<array<int>>").alias("elites"))
    schema = "lot long, items array<struct<key:long,length:int>>, island int, elites array<array<int>>, cost double"
    for epoch in range(epochs):

        def grow(batches, epoch=epoch):
            for batch in batches:
                best, cost, ids = [], [], batch.column(2).to_pylist()
                for n, (items, elites) in enumerate(zip(batch.column(1), batch.column(3).to_pylist(), strict=True)):
                    sizes = items.values.field("length").to_pylist()
                    seed = (batch.column(0)[n].as_py() * islands + ids[n]) * epochs + epoch
                    found = evolve(sizes, capacity, seed, elites or [], population, generations)
                    best.append([_bin_of(found, len(sizes))])
                    cost.append(found.cost(capacity))
                cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(best, pa.list_(pa.list_(pa.int32()))), pa.array(cost)]
                yield pa.RecordBatch.from_arrays(cols, names=["lot", "items", "island", "elites", "cost"])

        grown = stage(state.repartition(max(1, min(lots * islands, 4096)), "lot", "island").mapInArrow(grow, schema), "epoch")
        if epoch + 1 < epochs:
            sent = grown.select("lot", F.explode(F.array("island", ((F.col("island") + 1) % islands).cast("int"))).alias("island"), F.explode("elites").alias("e"))
            sent = sent.groupBy("lot", "island").agg(F.collect_list("e").alias("elites"))  # its own and one migrant
            state = grown.select("lot", "items", "island").join(sent, ["lot", "island"]).select("lot", "items", "island", "elites")
    best = grown.groupBy("lot").agg(F.min_by(F.struct("items", F.element_at("elites", 1).alias("bins")), F.struct("cost", "island")).alias("b"))
    flat = best.select("lot", F.explode(F.arrays_zip(F.col("b.items").alias("items"), F.col("b.bins").alias("bins"))).alias("x"))
    return flat.select(F.col("x.items.key").alias("key"), F.col("x.items.length").alias("length"), "lot", F.col("x.bins").alias("bin"))


def pack(lengths: DataFrame, capacity: int = 2048, lot: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 24) -> DataFrame:
    """``key, length`` to ``key, sequence_id, offset``; keys are unique and not null, every length is 1 to ``capacity``.

    Equal rows, ties and any skew of the content are harmless: a lot is dealt by hash and holds lengths only.
    """
    from pyspark.sql import Window

    rows = lengths.select("key", F.col("length").cast("int").alias("length"))
    full = rows.where(F.col("length") == capacity)
    todo = rows.where(F.col("length") < capacity)
    before = Window.partitionBy("lot", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # full pieces are numbered below zero, apart from the lots
    out = full.select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level = 0
    while True:
        lots = max(1, -(-todo.count() // lot))
        flat = stage(_evolved(todo, lots, capacity, islands, epochs, population, generations), "packed")
        kept = flat if lots == 1 else flat.where("bin > 0")
        number = F.lit(level << 56) + F.col("lot") * (1 << 24) + F.col("bin")
        out = out.union(kept.select("key", number.alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset")))
        if lots == 1:
            return out
        todo, level = flat.where("bin = 0").select("key", "length"), level + 1


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, **more) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are the end id alone; longer documents than ``capacity`` are cut, the last piece may be
    shorter; an empty table gives no rows; other columns are ignored.  Ids may be null or repeated: every input row is
    packed on its own.
    """
    # the key is written with the pieces, so all that read them see the same
    cut = stage(pieces(docs, tokenizer, capacity, ids=False).withColumn("key", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack(cut.select("key", "length"), capacity, **more), "key").drop("key")
