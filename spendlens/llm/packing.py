"""Packing of token sequences: shortest pack first over the length histogram.

Documents are tokenized once, cut into pieces of at most ``limit`` tokens,
and only the pieces' lengths are counted. The packing runs over that
histogram (at most ``limit`` entries): lengths from the longest to the
shortest, each placed into the pack with the most room left, or into a new
one. It keeps patterns with counts, not packs: each length splits at most one
pattern in two or adds one, so there are at most ``limit`` patterns of at
most ``limit`` pieces. Patterns then hold rank ranges of each length, and
the pieces find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import BROADCAST_ROWS, Memo, held, saved, text_chunks

LIMIT = 1024
END_ID = 0
#: White space to Python, but not to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: No token crosses the borders of these parts, and none depends on its neighbours.
PART = re.compile(r" ?\S+|\s+(?!\S)|\s+")
PLAIN = re.compile("[ -\u02ff]+")
INNER = re.compile(r" ?\S+")


class Tokens:
    """Ids of texts, little-endian unsigned 32-bit."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self._ids)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # At one place the tokenizer takes the longest of its added tokens.
        self.names = {t.content for t in added if t.content}
        longest_first = map(re.escape, sorted(self.names, key=len, reverse=True))
        self.added = re.compile(f"({'|'.join(longest_first)})") if self.names else None
        # Those that take in white space, need word borders or match changed text are left to the tokenizer, with the whole text.
        self.apart = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)

        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.ranked = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Parts of Latin letters and the like take the faster encoder of the
        same vocabulary, if its ranks are given; both agree on the classes of
        those characters."""
        if not self.ranked:
            return self._tokenized(texts)
        encode = self.ranked.encode_ordinary
        mixed = self._mixed(texts)
        out = [array("I", encode(t)).tobytes() if PLAIN.fullmatch(t) and t not in mixed else None for t in texts]
        other = iter(self._tokenized([t for t, ids in zip(texts, out) if ids is None]))
        return [next(other) if ids is None else ids for ids in out]

    def _tokenized(self, texts: list[str]) -> list[bytes]:
        """Parts without inner white space are encoded as lines of one text:
        a line feed before a letter, mark or space is a token of its own."""
        mixed = self._mixed(texts)
        plain = [t for t in texts if self.line is not None and INNER.fullmatch(t) and t not in mixed]
        done = {}
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode("\n".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) == len(some) - 1:
                data, to = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                done.update(zip(some, (data[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], to))))
        rest = [t for t in texts if t not in done]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            done.update(zip(some, (np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        return [done[t] for t in texts]

    def _has_added(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def _mixed(self, parts: list[str]) -> set[str]:
        """Parts that may hold added tokens besides those with odd white space."""
        return self.names if self.apart else {t for t in parts if self._has_added(t)}

    def _parts(self, text: str) -> list[str]:
        """Added tokens are parts of their own; the texts between them are
        split as if each were alone, as the tokenizer does."""
        if ODD_SPACE.search(text):
            return [text]
        if not self._has_added(text):
            return PART.findall(text)
        if not self.apart:
            return [text]
        pieces = self.added.split(text)
        return [p for i, t in enumerate(pieces) for p in ([t] if i % 2 else PART.findall(t))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(b"".join, self.memo.values(list(map(self._parts, texts)))))


def tokens(path: str, ranks: str | None) -> Tokens:
    return held(Tokens, path, ranks)


def _cut(path: str, ranks: str | None, limit: int):
    def run(batches):
        ids_of, end = tokens(path, ranks), np.array([END_ID], np.uint32).tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, texts in text_chunks(batch.column(1)):
                rows = []
                for doc, ids in zip(doc_ids[lo:hi], ids_of([t or "" for t in texts.to_pylist()])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, limit):
                        piece = ids[4 * start : 4 * (start + limit)]
                        k = len(piece) // 4
                        rows.append((doc, start, k, zlib.crc32(piece), total, part, seen[k]))
                        seen[k] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], PIECE)

    return run


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, piece lengths) of each packing pattern."""
    # By room left, the patterns that have it: [count, (length, the pattern before it)].
    room: list[list[list]] = [[] for _ in range(limit + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = next((r for r in range(limit, length - 1, -1) if room[r]), None)
            if most is None:
                room[limit - length].append([left, (length, None)])
                break
            pack = room[most][-1]
            take = min(left, pack[0])
            room[most - length].append([take, (length, pack[1])])
            pack[0] -= take
            if not pack[0]:
                room[most].remove(pack)
            left -= take
    out = []
    for packs in room:
        for count, node in packs:
            lengths = []
            while node:
                lengths.append(node[0])
                node = node[1]
            out.append((count, tuple(reversed(lengths))))
    return out


def slots(packed: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each place in a pattern the ranks of its length that go there:
    from ``rank`` on, into sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in packed:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), cols.T.copy()))


def _place(at: dict[str, np.ndarray]):
    key = at["length"] << 48 | at["rank"]

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t.column("length").to_numpy(), t.column("rank").to_numpy()
            slot = np.searchsorted(key, length << 48 | rank, side="right") - 1
            sequence = at["sequence"][slot] + rank - at["rank"][slot]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(at["offset"][slot])],
                [*PIECE[:5], "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, path: str, ranks: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset), one per piece. A sequence's pieces lie without gaps from offset 0.

    ``path``: the tokenizer's file; ``ranks``: its vocabulary as ranks, only
    for speed. Texts of the file's added tokens within a document become those
    tokens. A document's ids end with END_ID. Null and empty text: that id alone.
    Null ids are kept, repeated rows are packed each, other columns are
    ignored, an empty table gives no rows. A document longer than ``limit``
    is cut every ``limit`` ids; only its last piece shares a sequence."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = saved(rows.mapInArrow(_cut(path, ranks, limit), ", ".join(f"{c} long" for c in PIECE)))
    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("k")))
    histogram = {r.length: r.k for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    if counts.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    ranked = pieces.join(first, ["part", "length"]).select(*PIECE[:5], (F.col("first") + F.col("nth")).alias("rank"))
    out = ", ".join(f"{c} long" for c in [*PIECE[:5], "sequence_id", "offset"])
    return ranked.mapInArrow(_place(slots(patterns(histogram, limit))), out)
