"""SentencePiece encoding and decoding (BPE models with byte fallback).

Encoding keeps a table with the last token of every prefix of a word. The
tokens that end at a position come from an Aho-Corasick automaton over the
vocabulary. Of those, exactly one may follow the last token of the prefix
before it: the pair must stay apart when the two are merged as one text (a
merge across a boundary of a whole text would also happen in that pair).
The ids are then read backwards from the table. Words are independent: no
piece has a space mark after another character or holds a line feed (this is
checked when a model is loaded), so texts are cut there and the ids of
frequent words are kept in a bounded memo.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import Memo, chunks

#: Fixed values of the model format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "
#: Words of the texts, a space as the mark.
WORD = re.compile(r"\n| *[^ \n]+| +")
#: Pairs of tokens are forgotten beyond this count.
PAIRS = 2_000_000


class PieceBpe:
    """A model file's encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and plain pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normalizer and a space before each text are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_id = [0] * 256
        self.byte_of = {}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        self.eos = self.pieces.index("</s>")
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses the border of a word")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self._merged(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.memo = Memo(lambda words: [self._word(w) for w in words])

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first and the
        leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.apart[key] = self._merged(a + b) == [a, b]
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text without regard to anything around it (spaces as marks)."""
        n = len(word)
        last, length = [-1] * (n + 1), [1] * (n + 1)  # -1: a character outside the vocabulary
        done, apart, size = 0, self.apart, len(self.pieces)
        for end, (token, k) in self.automaton.iter(word):
            i = end + 1
            if done == i:
                continue
            before = i - k
            left = last[before]
            if before and left >= 0:
                known = apart.get(left * size + token)
                if known is None:
                    known = self._may_follow(left, token)
                if not known:
                    continue
            last[i], length[i], done = token, k, i
        out, i = [], n
        while i:
            if last[i] >= 0:
                out.append(last[i])
            else:
                out.extend(self.byte_id[b] for b in reversed(word[i - 1].encode()))
            i -= length[i]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.word_ids(word.replace(" ", MARK))
        return np.array(ids, np.int32).tobytes(), self._plain(ids)

    def _plain(self, ids) -> str:
        """Decoded text, the first space kept. Bytes that are no UTF-8 give
        one U+FFFD each."""
        out, run = [], bytearray()

        def flush():
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]

        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            if self.kind[i] == NORMAL:
                out.append(self.pieces[i].replace(MARK, " "))
            elif self.kind[i] == UNKNOWN:
                out.append(UNKNOWN_TEXT)
        flush()
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of any ids; the space before a text goes."""
        ids = list(ids)
        text = self._plain(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return text[1:] if first is not None and self.kind[first] == NORMAL and self.pieces[first].startswith(MARK) else text

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers with an end id, their decoded text) of each text."""
        end = np.array([self.eos], np.int32).tobytes()
        words = [WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        # The first word begins with the space before the text.
        return [(b"".join([f[0] for f in found]) + end, "".join([f[1] for f in found])[1:]) for found in self.memo.values(words)]


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def _run(path: str):
    def run(batches):
        bpe = model(path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                done = bpe.encode(texts[lo:hi])
                ends = np.cumsum([0] + [len(d[0]) // 4 for d in done])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join([d[0] for d in done]), np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists, pa.array([d[1] for d in done], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded), one per row of ``docs``: the ids with an
    end id, and what they decode to.

    Null and empty text: the end id alone, decoded to the empty text. Rows
    keep a null id, repeated rows stay, other columns are ignored, an empty
    table gives no rows. Long texts are cut at spaces, never shortened; a
    very long word is encoded by the same table without the memo."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(path), "doc_id long, ids array<int>, decoded string")
