"""MinHash near-duplicate detection with tensored banding.

A document draws ``2 * tables * rows`` minhashes: two collections of ``tables`` short keys, each short key made of
``rows`` minhashes.  Table keys are all pairs (one short key of each collection), so ``tables**2`` tables of
``2 * rows`` hashes come from about the square root of the minhashes that independent bands would draw.  A pair of
similarity s shares a table with probability ``(1 - (1 - s**rows)**tables)**2``; with the defaults that is above
0.99995 at s = 0.85, and links are only needed along some path to join a component.

Pairs of keys are formed only of short keys that at least two texts hold: a short key held once can join no
table, so this loses nothing.  Every candidate is verified on the full shingle sets.  Groups never expand into all
pairs: classes are first tested against one or two pivots of their tables and components merge; what is left in
different components is compared pair by pair only where an exact bound on the sets' difference allows a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import discard, few, map_arrow, stage, texts_of
from revlake.llm.components import components
from revlake.llm.hashing import U, mix, words

_RNG = np.random.default_rng(7)
_ODD = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)
_NONE = np.zeros(0, U)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct word shingles of each text as sorted 64-bit hashes; a shorter text is one shingle, none if wordless."""
    h, at = words(texts)
    with np.errstate(over="ignore"):
        x = h
        for j in range(1, size):
            x = mix(x[: max(0, len(h) - j)] * U(0x9E3779B97F4A7C15) + h[j:]) if len(h) > j else _NONE
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(x[a : b - size + 1]))
            elif b > a:
                y = np.full(1, b - a, U)
                for z in h[a:b]:
                    y = mix(y * U(0xC2B2AE3D27D4EB4F) + z)
                out.append(y)
            else:
                out.append(_NONE)
    return out


def _signatures(texts: list[bytes], size: int, tables: int, rows: int) -> dict:
    sets = shingle_sets(texts, size)
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    short = np.zeros((len(sets), 2 * tables), U)
    sig = np.zeros((len(sets), 2), U)
    with np.errstate(over="ignore"):
        for lo in range(0, len(full), 64):
            ids = full[lo : lo + 64]
            flat, starts = np.concatenate([sets[i] for i in ids]), np.concatenate([[0], np.cumsum(n[ids])[:-1]])
            for k in range(2 * tables):
                key = np.full(len(ids), k, U)
                for r in range(rows):
                    key = mix(key + np.minimum.reduceat(flat * _ODD[k * rows + r], starts))
                # the lowest bit tells the collection
                short[ids, k] = (key & ~U(1)) | U(k >= tables)
            for j, c in enumerate((0x165667B19E3779F9, 0x27D4EB2F165667C5)):
                sig[ids, j] = np.add.reduceat(mix(flat ^ U(c)), starts)
    flat = pa.array(short.view(np.int64).ravel())
    step = np.where(n > 0, 2 * tables, 0)
    if not n.all():
        flat = pa.array(short[n > 0].view(np.int64).ravel())
    offsets = pa.array(np.concatenate([[0], np.cumsum(step)]).astype(np.int32))
    return {"n_shingles": n, "s1": sig[:, 0].view(np.int64), "s2": sig[:, 1].view(np.int64), "keys": pa.ListArray.from_arrays(offsets, flat)}


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs ``(u, v)`` whose full sets satisfy ``100 * intersection >= percent * union``."""

    def f(batch):
        sets: dict[bytes, np.ndarray] = {}
        tu, tv = texts_of(batch, "tu"), texts_of(batch, "tv")
        need = list({*tu, *tv})
        sets = dict(zip(need, shingle_sets(need, size), strict=True))
        linked = []
        for a, b in zip(tu, tv, strict=True):
            x, y = sets[a], sets[b]
            both = len(x) + len(y) - len(np.union1d(x, y))
            linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return {"u": batch.column(0), "v": batch.column(1), "linked": linked}

    held = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("rep").alias("v"), F.col("text").alias("tv")), "v")
    return map_arrow(held.select("u", "v", "tu", "tv"), f, "u long, v long, linked boolean").where("linked").select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, tables: int = 12, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  Texts with equal sets form a class whose
    least id stands for it; classes are linked when their sets verify; a component is named by its least id.

    Edge cases: null or wordless text has no shingles and stays alone; fewer words than ``shingle`` make one
    shingle; equal rows share a component and are both ``kept``; a null id never names a component, and a class of
    null ids only has a null component and is kept; an empty table gives no rows; other columns are ignored.  An id
    is taken to name one text.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batch):
        return {"doc_id": batch.column(0), **_signatures(texts_of(batch), shingle, tables, rows)}

    signed = stage(map_arrow(base, sign, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "signed")
    classes = stage(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "keys")).alias("c"))
        .select("s1", "s2", F.col("c.doc_id").alias("rep"), F.col("c.keys").alias("keys")),
        "classes",
    )
    members = _tables(classes, tables)
    labels = _merge(base, members, shingle, percent)
    named = classes.select("s1", "s2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("comp", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    # a wordless document carries signature 0, 0, which no class has
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _tables(classes: DataFrame, tables: int) -> DataFrame:
    """``(t, rep)``: the tables that hold at least two classes; of tables with equal members one is kept."""
    short = classes.select("rep", F.explode("keys").alias("key"))
    live = short.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    halves = short.join(live, "key").groupBy("rep").agg(F.collect_list("key").alias("k"))  # at most 2 * tables each
    halves = halves.select("rep", F.filter("k", lambda x: x.bitwiseAND(1) == 0).alias("a"), F.filter("k", lambda x: x.bitwiseAND(1) == 1).alias("b"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    every = stage(halves.where("size(a) > 0 and size(b) > 0").select("rep", F.explode(pairs).alias("t")), "tensored")
    kind = every.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").bitwiseAND((1 << 31) - 1)).alias("s"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND((1 << 31) - 1)).alias("s2"), F.min("rep").alias("h"), F.max("rep").alias("g")).where("n > 1")
    chosen = kind.groupBy("n", "s", "s2", "h", "g").agg(F.min("t").alias("t")).select("t")
    out = stage(every.join(chosen, "t"), "tables")
    discard(every)
    return out


def _merge(base: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """``(node, comp)`` of every class that some verified link reaches."""
    # only texts that meet others in a table are moved; where their ids are few, the others stay in place
    wanted = stage(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    texts = stage(base.join(few(wanted), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"]), "texts")
    links = labels = None
    for step in range(3):
        held = members.withColumn("comp", F.col("rep")) if labels is None else members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        # at first each class is tested against one pivot of its tables only; that merges most of a group
        pivot = F.min(F.struct((F.lit(0) if step == 0 else F.xxhash64("rep")).alias("o"), "rep", "comp"))
        table = held.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("head"), pivot.alias("p")).where("lo < hi").select("t", "head", "p")
        if step < 2:
            open_ = stage(held.join(table, "t"), "open")
            pairs = open_.where("p.comp <> comp").select(F.col("rep").alias("u"), F.col("p.rep").alias("v")).groupBy("u").agg(F.min("v").alias("v"))
            pairs = stage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
            discard(members)
            members = open_.select("t", "rep")
            members._staged = open_._staged
        else:
            open_ = stage(held.join(table, "t").select("rep", "comp", "head").distinct(), "open")
            pairs = _remaining(open_, texts, size, percent)
        if pairs.isEmpty():
            break
        found = stage(_verified(pairs, texts, size, percent), "links")
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = stage(components(links), "labels")
    return labels if labels is not None else members.select(F.col("rep").alias("node"), F.col("rep").alias("comp")).limit(0)


def _remaining(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of different components that may still be linked, of ``(rep, comp, head)`` of open tables.

    Classes that tables connect form a family with a pivot p.  Let d(x) be the size of the symmetric difference of x
    and p, and u(x) the number of shingles that x alone holds, 0 for p itself.  These all count towards d(x), so
    ``|x ^ y| >= u(x) + u(y) + |(d(x) - u(x)) - (d(y) - u(y))|``, which is d(y) if x is p, and a pair whose bound
    exceeds what the similarity allows for its sizes is no link.  The bound needs one comparison per class and drops
    nearly every pair of copies that were changed too much, so a large group does not expand into all its pairs.
    """
    family = components(open_.select(F.col("rep").alias("u"), F.col("head").alias("v"))).select(F.col("node").alias("rep"), F.col("comp").alias("family"))
    classes = open_.select("rep", "comp").distinct().join(family, "rep")

    def facts(batch):
        own, pivot = texts_of(batch, "tx"), texts_of(batch, "tp")
        need = list({*own, *pivot})
        sets = dict(zip(need, shingle_sets(need, size), strict=True))
        n = [len(sets[t]) for t in own]
        d = [len(np.setxor1d(sets[x], sets[p], assume_unique=True)) for x, p in zip(own, pivot, strict=True)]
        flat = np.concatenate([sets[t] for t in own])
        held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.view(np.int64)))
        return {"rep": batch.column(0), "comp": batch.column(1), "family": batch.column(2), "n": n, "d": d, "shingles": held}

    joined = classes.join(texts.select("rep", F.col("text").alias("tx")), "rep").join(texts.select(F.col("rep").alias("family"), F.col("text").alias("tp")), "family")
    known = stage(map_arrow(joined.select("rep", "comp", "family", "tx", "tp"), facts, "rep long, comp long, family long, n int, d int, shingles array<long>"), "facts")
    alone = known.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("holders"), F.min("rep").alias("rep")).where("holders = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    # sizes of linked sets differ by less than a factor, so they lie in the same or neighbouring bands
    band = F.floor(F.log(F.col("n")) / float(1.001 * np.log(100 / percent))).cast("int")
    # what the pivot alone holds does not count towards d(pivot) = 0
    own = F.when(F.col("rep") == F.col("family"), 0).otherwise(F.coalesce("alone", F.lit(0)))
    sized = stage(known.drop("shingles").join(alone, "rep", "left").select("rep", "comp", "family", "n", (F.col("d") - own).alias("e"), own.alias("alone"), band.alias("band")), "sized")
    discard(known)
    largest = sized.groupBy("family", "comp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    sized = sized.join(largest, "family")
    x = sized.where("comp <> largest").select(*[F.col(c).alias("x_" + c) for c in ("rep", "comp", "family", "n", "e", "alone")], F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("x_band"))
    least = F.col("alone") + F.col("x_alone") + F.abs(F.col("e") - F.col("x_e"))
    may = (
        (F.col("comp") != F.col("x_comp"))
        & ((F.col("comp") == F.col("largest")) | (F.col("rep") < F.col("x_rep")))
        & (least * (100 + percent) <= (F.col("n") + F.col("x_n")) * (100 - percent))
        & (F.least("n", "x_n") * 100 >= F.greatest("n", "x_n") * percent)
    )
    pairs = x.join(sized, (F.col("family") == F.col("x_family")) & (F.col("band") == F.col("x_band")) & may)
    return stage(pairs.select(F.greatest("rep", "x_rep").alias("u"), F.least("rep", "x_rep").alias("v")).distinct(), "pairs")
