"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A document is
parsed from left to right into the longest phrases that occur in that text.
The language that needs the fewest phrases, normalised by the logarithm of
its text's length (the cost of naming a phrase), wins. A letter that a
language's text doesn't hold is a phrase of its own, at a cost that is the
same in all languages.

Whole documents are parsed, in blocks of BLOCK symbols that advance one
symbol at a time together, as one table lookup a language. A block's parse
starts at its first symbol, as if a phrase began there; where the phrase
before really ends, further inside, a second parse runs until it meets a
phrase start of the first. From there on both agree, so counts are those of
one parse of the whole text.

The driver builds the automata from the sample and broadcasts them: as tables
by state and letter up to DENSE entries in all, other languages' as hash
tables (some 60 bytes a letter of their text, whatever the alphabet).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import hash_sample, let_go, text_chunks

#: The sample to learn from: labelled documents a language, taken whole.
SAMPLE_DOCUMENTS = 16
BLOCK = 256
#: Bytes of text that are parsed together.
CHUNK = 1 << 19
#: Entries of dense tables that a worker may hold, four bytes each; other languages have hash tables.
DENSE = 16 << 20
#: Bits for a letter that a language's text doesn't hold.
LITERAL = 24.0
UNDETERMINED = "und"
GAP = 1

Sample = tuple[tuple[str, str], ...]


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learned from; those without an id aren't held out, nor learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = SAMPLE_DOCUMENTS) -> Sample:
    """(language, text) to learn from: of each language the ``documents``
    labelled rows with the smallest hash of their id, whole texts."""
    own = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    own = hash_sample(own, lang_col, id_col, 4 * documents).where(F.col(text_col).isNotNull())
    first = Window.partitionBy("lang").orderBy("h", "text")
    rows = (
        own.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
        .withColumn("k", F.row_number().over(first)).where(F.col("k") <= documents)
        .orderBy("lang", "k").select("lang", "text").collect()
    )
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append(r.text)
    joined = {k: " ".join(v) for k, v in texts.items()}
    return tuple(sorted((k, v) for k, v in joined.items() if any(map(str.isalpha, v))))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is its start."""
    size = 2 * len(symbols) + 2
    link, length = [-1] * size, [0] * size
    steps: list[dict[int, int]] = [{}]
    last = 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length[new] = length[last] + 1
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length[copy], link[copy] = length[p] + 1, link[q]
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


#: Flags of a step, above the next state: a phrase begins with the symbol; it is one that the text doesn't hold.
_NEW, _LITERAL, _STATE = 1 << 30, 1 << 29, (1 << 29) - 1


class Dense:
    """Steps as a table (state, symbol), for small alphabets. A step that
    isn't there is that from state 0, where a phrase begins."""

    def __init__(self, steps: list[dict[int, int]], symbols: int):
        known = sorted(steps[0])
        self.local = np.zeros(symbols, np.int32)
        self.local[known] = np.arange(1, len(known) + 1)
        self.width, self.states = len(known) + 1, len(steps)
        self.at = np.array([state * self.width + self.local[c] for state, to in enumerate(steps) for c in to], np.int32)
        self.to = np.array([v for to in steps for v in to.values()], np.int32)
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # only the steps that are there are sent

    def _filled(self) -> np.ndarray:
        table = np.full(self.states * self.width, -1, np.int32)
        table[self.at] = self.to
        table = table.reshape(self.states, self.width)
        again = table[0] | _NEW
        again[0] = _NEW | _LITERAL
        table[0] = -1
        for state in range(0, self.states, 4096):
            part = table[state : state + 4096]
            np.copyto(part, again[None, :], where=part < 0)
        return table.ravel()

    def __call__(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = self._filled()
        return self.table[states * self.width + symbols]


class Hashed:
    """The same as a hash table with linear probing, for large alphabets."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, steps: list[dict[int, int]], symbols: int):
        self.local = np.arange(symbols, dtype=np.int32)
        self.first = np.full(symbols, _NEW | _LITERAL, np.int32)
        self.first[list(steps[0])] = np.array(list(steps[0].values()), np.int32) | _NEW
        keys = np.array([(state << 21) | c for state, to in enumerate(steps) for c in to if state], np.int64)
        values = np.array([v for state, to in enumerate(steps) for v in to.values() if state], np.int32)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = self.keys[slot] < 0
            _, one = np.unique(slot, return_index=True)  # the first to come takes a free slot
            takes = np.zeros(len(left), bool)
            takes[one] = True
            takes &= free
            self.keys[slot[takes]], self.values[slot[takes]] = keys[left[takes]], values[left[takes]]
            left = left[~takes]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._FACTOR) >> self.shift).astype(np.int64)

    def __call__(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = (states.astype(np.int64) << 21) | symbols
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.first[symbols])
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Languages:
    def __init__(self, sampled: Sample):
        self.names = [k for k, _ in sampled]
        lower = [self._letters(t) for _, t in sampled]
        letters = sorted(set().union(*lower) - {" "}) if lower else []
        self.code = {c: i + 2 for i, c in enumerate(letters)} | {" ": GAP}
        # A letter that no language has is symbol 0: a phrase of its own in each.
        self.symbol = np.full(0x110000, GAP, np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                self.symbol[cp] = self.code.get(low if len(low) == 1 else c, 0)
        self.tables, room = [], DENSE
        for t in lower:
            steps = suffix_automaton([self.code[c] for c in t])
            size = len(steps) * (len(steps[0]) + 1)
            self.tables.append((Dense if size <= room else Hashed)(steps, len(letters) + 2))
            room -= size if size <= room else 0
        self.cost = [math.log2(len(t) + 2) for t in lower]

    @staticmethod
    def _letters(text: str) -> str:
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        return " ".join("".join(c if c.isalpha() else " " for c in low).split())

    def symbols(self, text: str) -> np.ndarray:
        """Lower-case letters, and one gap for each run of anything else."""
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        return s[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases, and letters not held, by (text, language), and each
        text's number of letters."""
        rows = [self.symbols(t) for t in texts]
        size = np.array([len(r) for r in rows], np.int64)
        letters = np.array([int((r != GAP).sum()) for r in rows], np.int64)
        s = np.concatenate([*rows, np.zeros(1, np.int32)])
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(rows)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        limit = np.cumsum(size)[owner]
        start = (np.cumsum(size) - size)[owner] + nth * BLOCK
        stop = np.minimum(start + BLOCK, limit)
        follows = np.flatnonzero(nth > 0)
        # Longest blocks first: after t symbols the first active[t] are going on.
        order = np.argsort(start - stop, kind="stable")
        place = np.minimum(start[order][None, :] + np.arange(BLOCK)[:, None], len(s) - 1)
        active = np.searchsorted((start - stop)[order], -np.arange(BLOCK), side="left")
        real = np.arange(BLOCK)[:, None] < (stop - start)[order][None, :]
        out = np.zeros((2, len(texts), len(self.names)), np.int64)
        for k, table in enumerate(self.tables):
            own = table.local[s]
            leave, marks = self._blocks(table, own, place, active, real, order, stop, limit)
            counts = self._met(table, own, marks, leave, follows, start, stop, limit)
            for j in (0, 1):
                out[j, :, k] = np.bincount(owner, weights=counts[:, j], minlength=len(texts))
        return out[0], out[1], letters

    @staticmethod
    def _blocks(table, own, place, active, real, order, stop, limit) -> tuple[np.ndarray, np.ndarray]:
        """Each block's parse from its first symbol on: where the first
        phrase beyond the block begins, and a mark for each symbol with which
        a phrase begins (2; 3 if it isn't held)."""
        grid = own[place]
        state, flags = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape, np.int8)
        for t in range(BLOCK):
            n = active[t]
            if not n:
                break
            to = table(state[:n], grid[t, :n])
            flags[t, :n] = to >> 29
            state[:n] = to & _STATE
        marks = np.zeros(len(own), np.int8)
        marks[place[real]] = flags[real]
        leave, now = stop.copy(), np.zeros_like(state)
        now[order] = state
        lanes = np.flatnonzero(stop < limit)
        while len(lanes):
            to = table(now[lanes], own[leave[lanes]])
            goes = (to & _NEW) == 0
            lanes, to = lanes[goes], to[goes]
            now[lanes] = to & _STATE
            leave[lanes] += 1
            lanes = lanes[leave[lanes] < limit[lanes]]
        return leave, marks

    @staticmethod
    def _met(table, own, marks, first_leave, follows, start, stop, limit) -> np.ndarray:
        """(phrases, letters not held) that begin in each block, by one parse
        of the whole text: from where the block before really ends, up to a
        mark, then as marked."""
        upto = [np.concatenate((np.zeros(1, np.int32), np.cumsum(marks == kind, dtype=np.int32))) for kind in (2, 3)]
        enter, leave, counts = start.copy(), first_leave.copy(), np.zeros((len(start), 2), np.int64)
        todo = np.arange(len(start))
        while len(todo):
            at, end, last = enter[todo], stop[todo], limit[todo]
            got, state, met = np.zeros((len(todo), 2), np.int64), np.zeros(len(todo), np.int32), np.zeros(len(todo), bool)
            lanes = np.flatnonzero(at < last)
            while len(lanes):
                p = at[lanes]
                to = table(state[lanes], own[p])
                begins = (to & _NEW) != 0
                inside = p < end[lanes]
                meets = begins & inside & (marks[p] > 0)
                met[lanes[meets]] = True
                counted = begins & inside & ~meets
                got[lanes[counted], ((to[counted] & _LITERAL) != 0).astype(np.int64)] += 1
                goes = ~meets & (inside | ~begins)
                lanes, to = lanes[goes], to[goes]
                state[lanes] = to & _STATE
                at[lanes] += 1
                lanes = lanes[at[lanes] < last[lanes]]
            for j in (0, 1):
                got[met, j] += upto[j][end[met]] - upto[j][at[met]]
            counts[todo] = got
            leave[todo] = np.where(met, first_leave[todo], at)
            moved = follows[enter[follows] != leave[follows - 1]]
            enter[moved] = leave[moved - 1]
            todo = moved
        return counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score: by how much, as a share, the second language
        needs more phrases than the first; 0 for equal, 1 with no second."""
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        count, literal, letters = self.phrases(texts)
        bits = count * np.array(self.cost) + literal * LITERAL
        best = bits.argmin(axis=1)
        score = np.ones(len(texts))
        if len(self.names) > 1:
            two = np.partition(bits, 1, axis=1)[:, :2]
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        names = [self.names[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters > 0, np.clip(score, 0, 1), 0.0)


def _run(spark: SparkSession, sampled: Sample, keep_text: bool = False):
    # Bounded by the sample: at most 4 * DENSE bytes, and the hash tables.
    shared = spark.sparkContext.broadcast(Languages(sampled))

    def run(batches):
        let_go()
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            cols = [i for i in range(batch.num_columns) if keep_text or i != at]
            names = [batch.schema.names[i] for i in cols]
            for lo, hi, texts in text_chunks(batch.column(at), CHUNK):
                found, scores = model.predict([x or "" for x in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in cols), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return run


def identified(docs: DataFrame, sampled: Sample | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``.

    Learns from ``sampled``, or else from a sample of ``docs``. Whole texts
    are read. Null text, and text without a letter: ``und`` and score 0; so
    is every text if there is nothing to learn from. Of languages that need
    equally many phrases the first by name wins. Repeated rows stay, null ids
    are kept, other columns are ignored, an empty table gives no rows."""
    sampled = sample(docs, id_col, text_col, lang_col) if sampled is None else sampled
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(docs.sparkSession, sampled), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, sampled: Sample | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    own = docs.drop("lang_pred", "score")
    run = _run(own.sparkSession, sample(own) if sampled is None else sampled, keep_text=True)
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema)
