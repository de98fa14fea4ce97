"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of word beginnings and one of continuations. Every node has
a failure link, the node that is reached by giving off the longest tokens the match
so far allows, and the number of tokens given off; so a word's greedy longest-match
length is found in one pass, and no piece is ever built. A task counts each distinct
word of a chunk once.

Text is lower-cased (A-Z). Words are runs of letters, digits and everything that
isn't ASCII; every other character but white space and control characters is a token
of its own; a word that can't be matched whole is one unknown token.

Edge cases: null and empty texts have no tokens; texts and words of any length are read
whole; a longest match is unique, so there are no ties; repeated rows give a row each; null
ids are kept; extra columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
CACHED = 1 << 19


class Automaton:
    """Tries with failure links; ``begin`` and ``more`` are the tokens that begin and continue a word."""

    def __init__(self, begin: list[str], more: list[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        token = {}
        for root, pieces in ((0, begin), (1, more)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                    at = self.child[at][c]
                if at > 1:
                    token[at] = True
        n = len(self.child)
        self.link, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for parent in queue:
            for c, v in self.child[parent].items():
                queue.append(v)
                if v in token:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                z, popped = self.link[parent], self.popped[parent]
                while z >= 0 and c not in self.child[z]:
                    popped += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.child[z][c], popped

    def count(self, word: str) -> int:
        """The tokens of a word, or -1 if it can't be matched."""
        child, link, popped = self.child, self.link, self.popped
        at, n = 0, 0
        for c in word:
            while c not in child[at]:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
            at = child[at][c]
        while at != 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return n


def pieces(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Beginnings and continuations of words of a sentence-piece file, without A-Z, which no lower-cased text has."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    names = [p for p in names if not any("A" <= c <= "Z" for c in p)]
    return [p[1:] for p in names if p.startswith(MARK) and len(p) > 1], [p for p in names if MARK not in p]


@functools.cache
def automaton(path: str = VOCABULARY) -> Automaton:
    return Automaton(*pieces(path))


_single = ~K.WORD & (np.arange(256) > 0x20) & (np.arange(256) != 0x7F)


def _count(path: str):
    known: dict[int, int] = {}

    def run(batches):
        machine = automaton(path)
        for rows, data, offsets in K.chunks(batches):
            w = K.words(data, offsets, K.WORD)
            distinct, first, at = np.unique(K.xxh64(w.data, w.starts, w.lens), return_index=True, return_inverse=True)
            if len(known) > CACHED:
                known.clear()
            sizes = np.empty(len(distinct), np.int64)
            for i, (h, j) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
                n = known.get(h)
                if n is None:
                    n = known[h] = machine.count(w.text(j, j + 1))
                sizes[i] = n
            n = sizes[at]
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])  # noqa: E731, B023
            single = np.diff(np.concatenate([[0], np.cumsum(_single[data])])[offsets])
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(sums(np.maximum(n, 1)) + single), pa.array(sums(n < 0))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long, n_unknown long")
