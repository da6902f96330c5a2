"""Token counts by trie-shared dynamic programming.

A text's pre-tokens are its words between ASCII white space, each led by the word mark of the vocabulary.  A unigram
model splits a pre-token into the pieces with the highest total score.  The distinct pre-tokens of a block are put in a
trie; the forward score of a prefix (best score and its number of pieces) is computed once, when its node is made, and
serves all pre-tokens that share it.  A terminal stores the pre-token's count, so a document is a sum of look-ups.

The public vocabularies are not unigram models, so scores come from a rule: piece number r of the vocabulary's order
has the log-probability of Zipf's law, ``-ln(r + 1) - ln(H)``.  A character without a piece costs ``unknown`` and counts
as many tokens as it has bytes (byte fallback).  Ties go to fewer pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import map_arrow, texts_of

MARK = "▁"
#: Nodes of a worker's trie before it starts a new one, and terminals it remembers.
NODES, TERMINALS = 150_000, 250_000
#: Longer pre-tokens are counted without entering the trie.
LONGEST = 256
_MODELS: dict[str, "Unigram"] = {}


class Unigram:
    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
        self.scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        # pieces by their characters from the last to the first; under "" the score of a whole piece
        self.ends: dict = {}
        for p, s in self.scores.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = s
        self.root: list = [{}, 0.0, 0]
        self.nodes = 0
        self.known: dict[bytes, int] = {}

    @classmethod
    def load(cls, path: str) -> "Unigram":
        if path not in _MODELS:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _MODELS[path] = cls([p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))])
        return _MODELS[path]

    def step(self, word: str, d: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score of ``word[: d + 1]`` from those of its prefixes."""
        top, n = best[d] + self.unknown, count[d] + len(word[d].encode())
        node, j = self.ends, d
        while j >= 0 and (node := node.get(word[j])) is not None:
            if (s := node.get("")) is not None:
                s += best[j]
                if s > top or s == top and count[j] < n - 1:
                    top, n = s, count[j] + 1
            j -= 1
        return top, n

    def insert(self, word: str) -> int:
        """The word's count, from the trie; nodes are made for prefixes not met before."""
        best, count, node = [0.0], [0], self.root
        share = len(word) <= LONGEST
        for d, c in enumerate(word):
            child = node[0].get(c) if share else None
            if child is None:
                child = [{}, *self.step(word, d, best, count)]
                if share:
                    node[0][c] = child
                    self.nodes += 1
            node = child
            best.append(node[1])
            count.append(node[2])
        return count[-1]

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        full = len(known) + len(new) > TERMINALS
        for w in new:
            if self.nodes > NODES:
                self.root, self.nodes = [{}, 0.0, 0], 0
            known[w] = self.insert(MARK + w.decode())
        out = [sum(map(known.__getitem__, ws)) for ws in split]
        if full:
            for w in new:
                del known[w]
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row, without a shuffle.

    Null, empty and blank texts count 0; equal texts and repeated rows count alike; a very long text is split like any
    other, and a word above ``LONGEST`` characters is counted by the same steps without entering the trie; an empty table
    gives no rows; other columns are ignored.
    """

    def f(batch):
        model = Unigram.load(path)
        texts = texts_of(batch)
        return {"doc_id": batch.column(0), "n_words": [len(t.split()) for t in texts], "n_tokens": model.counts(texts)}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), f, "doc_id long, n_words long, n_tokens long")
