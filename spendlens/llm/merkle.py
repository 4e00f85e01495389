"""A Merkle manifest of a data set, with a witness for every row.

Rows are leaves. The leaves of a group (a language), in the order of a key,
form a tree of runs of ARITY nodes; the groups' roots form one more tree in
the same way. A row's witness lists, level by level up to the manifest's
root, its place in the run and the digests of the run's other nodes.

Leaves are appended in their order (``Open``). Every subtree that is still
open keeps its members' witnesses as far as they are known; when a run is
complete, each member of it gets that level's step. Blocks of ARITY**LEVELS
leaves, aligned to the tree, are built by tasks side by side. The blocks'
roots are appended to the next tier in the same way, until each tree has
one root; then the tiers pass their witnesses down, as a header before the
nodes of each block. So a task holds one block, whatever the groups' sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stored
from spendlens.operators.joins import broadcast_if_small, join_nullsafe
from spendlens.operators.ordering import global_row_number

ARITY, LEVELS = 8, 4
STEPS = "array<struct<place: int, siblings: string>>"
_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.large_string())]))
DIGEST = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record_digest(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` if null, else its UTF-8 byte
    count, ``:`` and the value as text, one after the other."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Open:
    """Nodes appended from the left, of which ``levels`` levels are built."""

    def __init__(self, levels: int):
        self.levels = levels
        self.runs: list[list[tuple[str, list]]] = [[] for _ in range(levels + 1)]

    def append(self, node: str) -> list[tuple[int, str]]:
        """The node's witness, which later appends extend."""
        witness: list[tuple[int, str]] = []
        self._place(0, node, [witness])
        return witness

    def _place(self, level: int, node: str, members: list) -> None:
        self.runs[level].append((node, members))
        if level < self.levels and len(self.runs[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        nodes = [node for node, _ in run]
        below = []
        for i, (_, members) in enumerate(run):
            step = (i, "".join(nodes[:i] + nodes[i + 1 :]))
            for witness in members:
                witness.append(step)
            below += members
        self._place(level + 1, digest("".join(nodes)), below)

    def closed(self) -> str:
        """The root, after the last append; runs that are not full end as they are."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        return self.runs[self.levels][0][0]


def levels_of(n: int, limit: int) -> int:
    """Levels that a block builds in a tree of ``n`` nodes: up to the root, or ``limit``."""
    levels = 0
    while levels < limit and ARITY**levels < n:
        levels += 1
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block), which follow each other."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                key, start = keys[start], i
    if held:
        yield pa.Table.from_batches(held)


def _roots(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: one row a block, its root as a node of the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in _blocks(batches):
            n = rows.column("n")[0].as_py()
            tree = Open(levels_of(n, levels))
            for node in rows.column("digest").to_pylist():
                tree.append(node)
            found.append((rows.column("tree")[0].as_py(), rows.column("block")[0].as_py(), -(-n // ARITY**levels), tree.closed()))
            if len(found) == 4096:
                yield _as_nodes(found)
                found = []
        if found:
            yield _as_nodes(found)

    return run


def _as_nodes(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["tree", "pos", "n", "digest"])


def _witnessed(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: the nodes with their witnesses up to the manifest's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            head, rows = rows.slice(0, 1), rows.slice(1)
            if not len(rows):
                continue
            above = [(s["place"], s["siblings"]) for s in head.column("witness")[0].as_py()]
            tree = Open(levels_of(rows.column("n")[0].as_py(), levels))
            own = [tree.append(node) for node in rows.column("digest").to_pylist()]
            tree.closed()
            steps = [[{"place": p, "siblings": s} for p, s in witness + above] for witness in own]
            out = rows.drop_columns(["block", "witness", "subroot", "root"])
            out = out.append_column("witness", pa.array(steps, _STEPS))
            for name in ("subroot", "root"):
                out = out.append_column(name, pa.array([head.column(name)[0].as_py()] * len(rows), pa.string()))
            yield from out.combine_chunks().to_batches()

    return run


def _together(nodes: DataFrame) -> DataFrame:
    """Each block's rows in one task, in their order, headers (pos -1) first."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _tiers(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tiers of nodes (tree, pos, n, digest) from the leaves up, and by tier
    the roots of the trees that end there."""
    size = ARITY**levels
    tiers, roots = [nodes], []
    while True:
        rows = tiers[-1].select("tree", "pos", "n", "digest", F.floor(F.col("pos") / size).alias("block"))
        above = stored(_together(rows).mapInArrow(_roots(levels), "tree long, pos long, n long, digest string"))
        roots.append(above.where("n = 1"))
        more = above.where("n > 1")
        if more.isEmpty():
            return tiers, roots
        tiers.append(more)


def _down(nodes: DataFrame, headers: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with witness, subroot and root. ``headers`` (tree, block,
    witness, subroot, root): what lies above each block."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels))
    both = rows.unionByName(headers.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return _together(both).mapInArrow(_witnessed(levels), f"{kept}, witness {STEPS}, subroot string, root string")


def _all_down(tiers: list[DataFrame], ends: list[DataFrame], levels: int) -> DataFrame:
    """The leaves with their witnesses. ``ends``: by tier, headers of the trees that end there."""
    passed = None
    for nodes, end in zip(reversed(tiers), reversed(ends)):
        headers = end if passed is None else end.unionByName(stored(passed.select("tree", F.col("pos").alias("block"), "witness", "subroot", "root")))
        passed = _down(nodes, headers, levels)
    return passed


def manifest(rows: DataFrame, leaf: Column, group: str, key: str, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, witness, and the columns of ``carry``) of
    each row. ``leaf``: the row's digest; ``witness``: steps (place, siblings)
    from the leaf up, siblings as one text of 64 characters each.

    Per value of ``group`` (null is a value, first) leaves ascend by ``key``
    (null last), equal keys by leaf; equal rows are leaves each. A lone leaf
    is its group's root, a lone group's root the manifest's. An empty table
    has no rows. Other columns of ``rows`` play no part, whatever their
    names; ``carry`` may not use the names of the result."""
    carry = carry or {}
    taken = {"tree", "pos", "n", "digest", "block", "witness", "subroot", "root", "leaf", "_key", "_group", "_row"} & set(carry)
    if taken:
        raise ValueError(f"names of the result: {sorted(taken)}")
    leaves = rows.select(F.col(f"`{group}`").cast("string").alias("_group"), F.col(f"`{key}`").alias("_key"), leaf.alias("digest"), *[c.alias(k) for k, c in carry.items()])
    numbered = global_row_number(leaves, [F.col("_group").asc_nulls_first(), F.col("_key").asc_nulls_last(), F.col("digest")], "_row")
    groups = numbered.groupBy("_group").agg((F.min("_row")).alias("first"), F.count("*").alias("n"))
    trees = stored(global_row_number(groups, ["first"], "tree").withColumn("tree", F.col("tree") - 1))
    placed = join_nullsafe(numbered, broadcast_if_small(trees), ["_group"], "left").withColumn("pos", F.col("_row") - F.col("first")).drop("_group", "_row", "first")
    nodes = stored(placed.withColumn("tree", F.col("tree").cast("long")))

    tiers, roots = _tiers(nodes, levels)
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    n_trees = trees.count()
    tops = stored(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "digest"))
    top_tiers, top_roots = _tiers(tops, levels)
    none = F.array().cast(STEPS)
    head = [r.select("tree", F.lit(0).cast("long").alias("block"), none.alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")) for r in top_roots]
    above = stored(_all_down(top_tiers, head, levels).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("block"), "witness", F.col("digest").alias("subroot"), "root"))
    ends = [above.join(r.select("tree"), "tree", "left_semi") for r in roots]
    found = _all_down(tiers, ends, levels)
    return found.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "witness", *carry)


def folded(leaf: Column, witness: str) -> Column:
    """The root that follows from ``leaf`` and the column ``witness``."""

    def step(node: Column, s: Column) -> Column:
        left = s["place"] * DIGEST
        return F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), left), node, F.substr(s["siblings"], left + 1)), 256)

    return F.aggregate(witness, leaf, step)


def proof(witness: str) -> Column:
    """All siblings of the column ``witness``, level by level, as one text."""
    return F.array_join(F.transform(witness, lambda s: s["siblings"]), "")
