"""Secrets in texts: patterns, and values that are costly to guess.

Patterns give the base spans. Beyond those, the value that follows a
credential word is segmented at minimum cost into dictionary words, dates,
repeats, sequences, keyboard walks and single characters; what is left is the
logarithm of the guesses that an informed attacker needs. Values that cost
GUESSES or more are spans of the kind ``guess``, whatever their length.

The cost is the least over all segmentations: walks, sequences and repeats
may begin and end anywhere inside a longer run. A start inside a run is left
out only where an earlier start of that run is better for every end.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import held, text_chunks

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 12
#: 18 characters with the first four, and 16: only whole runs can match, so a least count in the pattern is the same as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A name that ends with a credential word, and its value: up to the matching quote, or without quotes up to a space or separator.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client|secret)[_-]?(?:key|secret))["']?[ \t]*(?::=|=>|==?|:)[ \t]*"""
    r"""(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|["']?([^\s"'<>,;]+))""",
    re.I | re.A,
)
#: Binary logarithm of the guesses from which a value is a secret.
GUESSES = 33.0
#: Binary logarithms: of one more segment, of dates (150 years of days), a walk's or sequence's start, each further key.
SEGMENT, DATE, YEAR, START, TURN = 1.0, 15.8, 7.2, 6.0, 0.8
#: Rows of a keyboard, without and with shift.
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", 'QWERTYUIOP{}|', 'ASDFGHJKL:"', "ZXCVBNM<>?")
LONGEST_WORD, LONGEST_DATE, SHORTEST_RUN = 24, 10, 3
DATE_FORM = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
YEAR_FORM = re.compile(r"(?:19|20)\d\d")


def _neighbours() -> set[tuple[str, str]]:
    """Characters of keys side by side; shift makes no difference."""
    at = {c: (r, i) for rows in (KEYS, SHIFTED) for r, row in enumerate(rows) for i, c in enumerate(row)}
    return {(a, b) for a, (r, i) in at.items() for b, (s, j) in at.items() if (r, i) != (s, j) and abs(r - s) <= 1 and -1 <= j - i <= 1}


def run_bits(size: int, turn: float) -> float:
    """A run of ``size`` characters, ``turn`` for each after the first."""
    return SEGMENT + START + math.log2(size) + turn * (size - 1)


class GuessCost:
    """``words``: the dictionary, most frequent first."""

    def __init__(self, words: list[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            if len(w) >= 3:
                self.rank.setdefault(w.lower(), len(self.rank) + 1)
        self.near = _neighbours()

    def _class_bits(self, value: str) -> float:
        size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
        return math.log2(size + 33 * any(not c.isalnum() for c in value) + 100 * any(ord(c) > 127 for c in value) or 1)

    def _runs(self, value: str, same) -> list[int]:
        """For each place where the run that it belongs to ends."""
        ends = [len(value)] * len(value)
        for i in range(len(value) - 2, -1, -1):
            ends[i] = ends[i + 1] if same(i) else i + 1
        return ends

    def __call__(self, value: str, enough: float = math.inf) -> float:
        """Binary logarithm of the guesses: the least sum over all
        segmentations, or ``enough`` if that is not more."""
        n, low, each = len(value), value.lower(), self._class_bits(value)
        walk = self._runs(low, lambda i: (value[i], value[i + 1]) in self.near)
        up = self._runs(low, lambda i: ord(low[i + 1]) - ord(low[i]) == 1)
        down = self._runs(low, lambda i: ord(low[i]) - ord(low[i + 1]) == 1)
        same = self._runs(low, lambda i: low[i] == low[i + 1])
        best = [math.inf] * n + [math.inf]
        best[0] = 0.0
        free = [math.inf] * (n + 1)  # as best, but ending in single characters
        units: dict[tuple[int, int], list] = {}
        kinds = [(ends, turn, []) for ends, turn in ((walk, TURN), (up, 0.0), (down, 0.0), (same, 0.0))]
        for i in range(n):
            here = min(best[i], free[i])
            best[i] = here
            if here >= enough:  # no way on from here costs less
                continue
            step = min(here + SEGMENT, free[i]) + each
            free[i + 1] = min(free[i + 1], step)
            for ends, turn, starts in kinds:
                if starts and starts[0][2] <= i:
                    starts.clear()
                # For ends at i + 3 and beyond, a start at s is at most
                # log2((i - s + 3) / 3) + turn * (i - s) worse than one at i.
                if ends[i] - i < SHORTEST_RUN or any(at + math.log2((i - s + SHORTEST_RUN) / SHORTEST_RUN) + turn * (i - s) <= here for s, at, _ in starts):
                    continue
                starts.append((i, here, ends[i]))
                for to in range(i + SHORTEST_RUN, ends[i] + 1):
                    best[to] = min(best[to], here + run_bits(to - i, turn))
            if value[i].isdigit():
                for to in range(i + 4, min(i + LONGEST_DATE, n) + 1):
                    if DATE_FORM.fullmatch(value, i, to):
                        best[to] = min(best[to], here + SEGMENT + DATE)
                if YEAR_FORM.match(value, i):
                    best[i + 4] = min(best[i + 4], here + SEGMENT + YEAR)
            for k in range(3, min(LONGEST_WORD, n - i) + 1):
                rank = self.rank.get(low[i : i + k])
                if rank:
                    part = value[i : i + k]
                    case = 0.0 if part.islower() else 1.0 if part.istitle() or part.isupper() else float(k)
                    best[i + k] = min(best[i + k], here + SEGMENT + math.log2(rank + 1) + case)
            # A unit that comes twice or more: the unit once, and how often.
            for k in range(2, min(LONGEST_WORD, (n - i) // 2) + 1):
                if value[i : i + k] != value[i + k : i + 2 * k]:
                    continue
                starts = units.setdefault((k, i % k), [])
                # As for runs: an earlier start of the same repeats, two units or more from here.
                if any(to >= i + 2 * k and at + math.log2((i - s + 2 * k) / (2 * k)) <= here for s, at, to in starts[-3:]):
                    continue
                to = i + k
                while value[to : to + k] == value[i : i + k]:
                    to += k
                    best[to] = min(best[to], here + SEGMENT + k * each + math.log2((to - i) // k))
                starts.append((i, here, to))
        return min(best[n], free[n], enough)


def guess_cost(path: str) -> GuessCost:
    """The words of a tokenizer's vocabulary (entries that end a word), in its order."""
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [w.removesuffix("</w>") for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    return GuessCost([w for w in words if w.isalpha()])


def find(text: str, cost: GuessCost) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
        at = 0
        while m := CONTEXT.search(text, at):
            lo, hi = m.span(m.lastindex)
            # The quote may be the closing one of an earlier text: names within the value count too.
            at = hi if m.lastindex == 3 else lo
            if not any(a <= lo and hi <= b for _, a, b in out) and cost(text[lo:hi], GUESSES) >= GUESSES:
                out.append(("guess", lo, hi))
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def hidden(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, lo, hi = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < hi:
            hi = max(hi, spans[i][2])
            i += 1
        out += [text[at:lo], f"[{kind}]"]
        at = hi
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans(words_path: str):
    def run(batches):
        cost = held(guess_cost, words_path)
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t, cost)] if t else [] for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, SPANS)], ["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, words_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans array<struct<kind, start, end>>), one per row of
    ``docs``; ``words_path``: a tokenizer's file whose vocabulary is the
    dictionary. Null and empty text: no spans. Whole texts are read; null
    ids and repeated rows are kept, other columns ignored, an empty table
    gives no rows. Equal starts are ordered by kind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_spans(words_path), "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def _hidden(words_path: str):
    def run(batches):
        cost = held(guess_cost, words_path)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            for lo, hi, texts in text_chunks(batch.column(i)):
                clean = [hidden(t, find(t, cost)) if t else t for t in texts.to_pylist()]
                yield batch.slice(lo, hi - lo).set_column(i, "text", pa.array(clean, batch.schema.field(i).type))

    return run


def without_secrets(docs: DataFrame, words_path: str) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced by their kind in brackets."""
    return docs.mapInArrow(_hidden(words_path), docs.schema)
