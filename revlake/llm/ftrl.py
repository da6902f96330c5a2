"""Logistic regression over hashed word n-grams, trained by FTRL-proximal, scored as sparse dot products.

Tokens are runs of letters, of digits or of other signs.  Features are hashed n-grams and skip-grams of the lower-cased
tokens; an n-gram whose second token repeats the first is hashed as a back-reference (so is a repeated token a few places
back), and a token's shape (capitals, signs, length) counts as a word of its own.  All hashing is vectorised over a block
of texts.

Training runs on the driver over a bounded sample of labelled rows (a documented parameter); scoring broadcasts the
non-zero weights, at most ``2**bits`` of them whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake.llm.common import chunks, give_back, labelled_sample, map_arrow, texts_of
from revlake.llm.hashing import LOWER, U, joined, mix, prefix_sums, span_hashes

_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


@dataclass(frozen=True)
class Features:
    """Which n-grams count: n-grams up to ``order``, skip-grams with up to ``skip`` tokens left out."""

    order: int = 2
    skip: int = 0
    shapes: bool = False
    bits: int = 20
    #: scale each text's values to unit length; else every feature present counts 1
    unit: bool = True


def features(texts: list[bytes], spec: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct feature numbers and their values (sub-linear counts, at unit length)."""
    out = []
    for a, b in chunks(texts):
        out += _block(texts[a:b], spec)
    return out


def _block(texts: list[bytes], spec: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, at = joined(texts)
    kind = np.concatenate([[0], _KIND[raw], [0]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    kinds = kind[1:][edge]
    start, end = edge[:-1][kinds[:-1] > 0], edge[1:][kinds[:-1] > 0]
    kinds = kinds[:-1][kinds[:-1] > 0]
    token = span_hashes(prefix_sums(np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)), start, end)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    cols: list[tuple[np.ndarray, np.ndarray]] = [(doc, token)]
    with np.errstate(over="ignore"):
        for gap in range(1, max(spec.skip + 2, spec.order)):
            if len(token) <= gap:
                break
            left, right = token[:-gap], token[gap:]
            same = doc[:-gap] == doc[gap:]
            second = np.where(left == right, U(1), right)
            first_ = np.where(left == right, U(2), left)
            cols.append((doc[gap:][same], mix(first_ * U(2 * gap + 1) + second)[same]))
        if spec.order > 2 and len(token) > 2:
            same = doc[:-2] == doc[2:]
            cols.append((doc[2:][same], mix(mix(token[:-2] * U(11) + token[1:-1]) * U(13) + token[2:])[same]))
        if spec.shapes and len(token):
            capitals = np.concatenate([[0], np.cumsum(_CAPITAL[raw])])
            high = capitals[end] - capitals[start]
            shape = kinds.astype(U) * U(64) + np.minimum(end - start, 4).astype(U) * U(8) + np.where(high > 1, U(2), (high > 0).astype(U))
            shape = mix(shape + U(0x51ED2701))
            cols.append((doc, shape))
            same = doc[:-1] == doc[1:]
            cols.append((doc[1:][same], mix(shape[:-1] * U(5) + shape[1:])[same]))
    docs, keys = np.concatenate([c[0] for c in cols]), np.concatenate([c[1] for c in cols])
    keys = docs.astype(U) << U(32) | keys >> U(64 - spec.bits)
    keys, counts = np.unique(keys, return_counts=True)
    values = np.log1p(counts)
    edges = np.searchsorted(keys, np.arange(len(texts) + 1).astype(U) << U(32))
    index = (keys & U((1 << spec.bits) - 1)).astype(np.int64)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        v = values[a:b]
        out.append((index[a:b], (v / math.sqrt(float(v @ v)) if spec.unit else np.ones(b - a)) if b > a else v))
    return out


@dataclass(frozen=True)
class Model:
    """Non-zero weights by feature number, and the bias."""

    spec: Features
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.spec.bits)
        w[self.index] = self.weight
        return w


def train(rows: Iterable[tuple[int, bytes, object]], spec: Features, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4) -> Model:
    """FTRL-proximal with per-coordinate rates: a coordinate with large past gradients moves less, and L1 keeps it at
    exactly zero until its evidence exceeds ``l1``.  Rows are taken in order of their ids, shuffled alike at every run;
    of a row only its feature numbers are kept."""
    size = 1 << spec.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    data = []
    for part in batched(rows, 256):
        # one array for many rows: what is freed later goes back to the system
        found = features([t for _, t, _ in part], spec)
        index = np.concatenate([i for i, _ in found]).astype(np.int32)
        value = np.concatenate([x for _, x in found]).astype(np.float32) if spec.unit else None
        edge = np.cumsum([0, *(len(i) for i, _ in found)])
        data += [(doc, int(label), index, value, lo, hi) for (doc, _, label), lo, hi in zip(part, edge[:-1], edge[1:], strict=True)]
    data.sort(key=lambda r: r[:2])
    labels = [r[1] for r in data]
    rng = np.random.default_rng(0)
    # the bias starts at the log-odds of the labels
    share = (sum(labels) + 1) / (len(labels) + 2)
    start = math.log(share / (1 - share))
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            _, _, index, value, lo, hi = data[k]
            i, x = np.append(index[lo:hi], size), np.append(value[lo:hi] if spec.unit else np.ones(hi - lo), 0.3)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, start + float(w @ x)))))
            g = (p - labels[k]) * x
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(w[:size])
    return Model(spec, index, w[index], start + float(w[size] * 0.3))


def scores(texts: list[bytes], dense: np.ndarray, bias: float, spec: Features) -> np.ndarray:
    margin = np.array([float(dense[i] @ x) for i, x in features(texts, spec)]) + bias
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str, fold, spec: Features, limit: int, **more) -> Model:
    """A model of ``labels.label`` from at most ``limit`` labelled documents for which ``fold`` holds.

    Several labels of one id are averaged; ids without text or label are left out.  With no usable row the model is
    constant (0.5).
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    model = train(labelled_sample(docs, known, fold, limit), spec, **more)
    give_back()
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts get the bias alone.

    A text's score depends on nothing but the text, so equal texts and repeated rows tie; a very long text is one block
    of its own; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.spec, model.index, model.weight, model.bias))
    kept: dict = {}

    def f(batch):
        spec, index, weight, bias = shared.value
        if "w" not in kept:
            kept["w"] = Model(spec, index, weight, bias).dense()
        return {"doc_id": batch.column(0), "score": scores(texts_of(batch), kept["w"], bias, spec)}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), f, "doc_id long, score double")


def score_column(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """``docs`` with all its columns and the score beside them, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.spec, model.index, model.weight, model.bias))
    fields, kept = docs.schema, {}

    def f(batch):
        spec, index, weight, bias = shared.value
        if "w" not in kept:
            kept["w"] = Model(spec, index, weight, bias).dense()
        cols = {n: batch.column(i) for i, n in enumerate(fields.names)}
        return {**cols, name: scores(texts_of(batch, text_col), kept["w"], bias, spec)}

    return map_arrow(docs, f, T.StructType([*fields.fields, T.StructField(name, T.DoubleType())]))
