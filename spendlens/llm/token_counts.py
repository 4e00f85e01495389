"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match segmentation (the longest piece that starts a word, then
the longest continuations) usually goes back over characters when a match
ends early. Here each node of the vocabulary's trie has a failure link and
the number of pieces that are certain once the node has no further edge, so
every character is read once and only counts are kept, never pieces.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import Memo, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class LongestMatch:
    """``first``: pieces that start a word; ``more``: those that continue one."""

    def __init__(self, first: list[str], more: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: of a continuation
        self.ends: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for p in pieces:
                if p:
                    self._add(root, p)
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        self._link()
        self.memo = Memo(lambda words: [self.count(w) for w in words])

    def _add(self, root: int, piece: str) -> None:
        node = root
        for c in piece:
            nxt = self.edges[node].get(c)
            if nxt is None:
                nxt = self.edges[node][c] = len(self.edges)
                self.edges.append({})
                self.ends.append(False)
            node = nxt
        self.ends[node] = True

    def _link(self) -> None:
        """By depth. A node that ends a piece: that piece is popped, and what
        follows starts a continuation. Another one: what its parent would pop,
        then on from there with this edge, popping as long as there is none.
        Where that fails no segmentation exists (-1)."""
        level = [(0, c, v) for c, v in self.edges[0].items()] + [(1, c, v) for c, v in self.edges[1].items()]
        while level:
            below = []
            for parent, c, v in level:
                if self.ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    at, n = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.edges[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.popped[v] = self.edges[at][c], n
                below += [(v, d, w) for d, w in self.edges[v].items()]
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be segmented."""
        node, n = 0, 0
        edges, fail, popped = self.edges, self.fail, self.popped
        for c in word:
            while c not in edges[node]:
                if fail[node] < 0:
                    return 0
                n += popped[node]
                node = fail[node]
            node = edges[node][c]
        while node != 1:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n


def pieces(path: str) -> tuple[list[str], list[str]]:
    """Of a SentencePiece model: pieces that start a word (written with a
    space mark), and the others."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal = [p.piece for p in model.pieces if p.type == 1]
    return [p[1:] for p in normal if p[0] == "▁" and "▁" not in p[1:]], [p for p in normal if "▁" not in p]


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*pieces(path))


def _run(path: str):
    def run(batches):
        match = automaton(path)
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for lo, hi in chunks(texts):
                for counts in match.memo.values([WORD.findall(t) for t in texts[lo:hi]]):
                    unknown = counts.count(0)
                    rows.append((len(counts), sum(counts) + unknown, unknown))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_tokens, n_unknown), one per row of ``docs``.

    Words are runs of characters other than space and U+0009-U+000D. A word
    that the pieces of the model at ``path`` can't segment is one unknown
    token. Null, empty and blank texts have none. Whole texts are read; null
    ids and repeated rows are kept, other columns ignored, an empty table
    gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(path), "doc_id long, n_words long, n_tokens long, n_unknown long")
