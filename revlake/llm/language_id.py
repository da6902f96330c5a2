"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed byte 2- and 3-grams (A-Z lower-cased) at unit length.  Each language has several
centroids, found by spherical k-means over its training rows, and a text goes to the language of the centroid with the
highest cosine.  A text further from every centroid than ``reject`` allows is marked as rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import chunks, give_back, labelled_sample, map_arrow, texts_of
from revlake.llm.hashing import LOWER, joined

DIMS = 4096
#: Labelled rows the centroids are fitted on, at most.
SAMPLE = 4000
#: Centroids per language.
CENTROIDS = 3
#: Cosine below which a text is rejected.
REJECT = 0.2
#: Bytes of a text that are counted at a time.
PIECE = 1 << 20
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """A character of a letter category; number signs such as U+00BD or U+2170 are none."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def counts(texts: list[bytes]) -> np.ndarray:
    """Rows of hashed n-gram counts of whole texts."""
    out = np.zeros((len(texts), DIMS), np.float32)
    # a long text is counted in pieces that overlap by two bytes, so that no n-gram is lost or counted twice
    parts = [(i, t[max(0, k - 2) : k + PIECE], k > 0, k + PIECE < len(t)) for i, t in enumerate(texts) for k in range(0, max(len(t), 1), PIECE)]
    for a, b in chunks([p[1] for p in parts]):
        buf, at = joined([p[1].translate(LOWER) for p in parts[a:b]])
        x = buf.astype(np.uint32)
        where = np.repeat(np.arange(b - a), np.diff(at))
        pair, triple = x[:-1] << 8 | x[1:], (x[:-2] << 16 | x[1:-1] << 8 | x[2:])
        pos = np.arange(len(buf))
        later = np.array([p[2] for p in parts[a:b]])
        end = at[1:] - np.array([p[3] for p in parts[a:b]])
        for code, n in ((pair, 2), (triple, 3)):
            # inside the text (the space after it counts as its end), and not counted by the piece before
            ok = (pos[: len(code)] + n <= end[where[: len(code)]]) & ~(later[where[: len(code)]] & (pos[: len(code)] - at[where[: len(code)]] + n <= 2))
            h = (code * np.uint32(2654435761 + 2 * n)) >> np.uint32(20)
            got = np.bincount((where[: len(code)][ok] * DIMS + h[ok]), minlength=(b - a) * DIMS).reshape(b - a, DIMS)
            for k in range(b - a):
                out[parts[a + k][0]] += got[k]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    matrix: np.ndarray
    langs: list[str]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        best = np.zeros(len(texts))
        names = ["und"] * len(texts)
        if not len(self.matrix):
            return names, best
        idf, matrix = self.idf.astype(np.float64), self.matrix.astype(np.float64)
        for lo in range(0, len(texts), 128):
            part = texts[lo : lo + 128]
            for k, (t, n) in enumerate(zip(part, counts(part), strict=True)):
                if has_letter(t.decode()):
                    # a row by itself, so that equal texts score equally in any company
                    v = np.log1p(n.astype(np.float64)) * idf
                    cosine = (matrix * v).sum(axis=1) / max(float(np.sqrt((v * v).sum())), 1e-12)
                    place = int(cosine.argmax())
                    names[lo + k] = self.langs[place]
                    best[lo + k] = min(1.0, max(0.0, float(cosine[place])))
        return names, best


def fit(docs: DataFrame, fold, limit: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids of the ``lang`` values of at most ``limit`` rows with text for which ``fold`` holds."""
    rows = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("label")), fold, limit)
    seen = sorted(((doc, str(name), np.log1p(v)) for part in batched(rows, 128) for (doc, _, name), v in zip(part, counts([t for _, t, _ in part]), strict=True)), key=lambda r: r[:2])
    tf = np.vstack([v for _, _, v in seen]) if seen else np.zeros((0, DIMS), np.float32)
    lang = np.array([name for _, name, _ in seen])
    idf = np.log((1 + len(seen)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(tf * idf)
    matrix, names = [], []
    rng = np.random.default_rng(0)
    for name in sorted(set(lang)):
        own = x[lang == name]
        centre = own[rng.choice(len(own), min(centroids, len(own)), replace=False)]
        for _ in range(12):
            place = (own @ centre.T).argmax(axis=1)
            centre = _unit(np.vstack([own[place == k].mean(axis=0) if (place == k).any() else centre[k] for k in range(len(centre))]))
        matrix.append(centre)
        names += [str(name)] * len(centre)
    give_back()
    return Centroids(idf, np.vstack(matrix).astype(np.float32) if matrix else np.zeros((0, DIMS), np.float32), names)


def predicted(docs: DataFrame, model: Centroids, reject: float = REJECT) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``: the score is the best cosine, from 0 to 1.

    Null, empty and letterless texts are ``und`` with score 0 and rejected; so is every text when no training row
    exists: with nothing learned there is no language to name.  Ties go to the centroid listed first (languages in order
    of name).  Very long texts are counted in pieces, equal texts and repeated rows are predicted alike whatever stands beside them, an empty table gives no rows, and
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.matrix, model.langs))

    def f(batch):
        names, best = Centroids(*shared.value).predict(texts_of(batch))
        return {"doc_id": batch.column(0), "lang_pred": names, "score": best, "rejected": best < reject}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, lang_pred string, score double, rejected boolean")
