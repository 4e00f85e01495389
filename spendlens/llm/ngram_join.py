"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct five-word shingles. Two documents link when
their sets' Jaccard similarity reaches 0.75 (exactly, in integers).

1. Shingles that many documents share are found with lossy counting over all
   documents. They only set the order of a set's elements: rare (by hash)
   first, then shared ones, the most frequent last. Any order gives the same
   result.
2. Two linked sets share an element among the first floor(n / 4) + 1 of
   each, and at least l among the first floor(n / 4) + l. l grows with n.
   Documents with the same prefix and size are one group; only groups are
   posted under their prefix elements.
3. Elements of one group only drop out, then groups with too few shared
   elements left for any partner. Elements of the same groups (a passage
   that the same texts share) become one, that with the first of them. The
   rest is expanded to classes (documents with equal sets) and verified.

Only components are asked for, so a pair whose ends are already connected is
not made. First every class meets one partner, the best of one member of each
of its elements. That member has the element at the earliest place, so the
fewest elements of its own before it, and is nearest to all others: a group
of thousands of copies of one text needs as many pairs as it has members.
Classes of elements that still lie in two components or more meet a partner
once again, and at last all remaining pairs across components are made.
Pairs must share a prefix element at places that allow a link: all elements
before a pair's first shared one are unshared, so that place bounds the
partner's size. Pairs that share one of the last elements before it are made
there, not again. Bitmaps of the sets, as wide as the sets are large (a lower
bound of the symmetric difference), come before the sets. Step tables are
deleted once the next one is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import BROADCAST_ROWS, U, discard, free_shuffles, let_go, mix, shingle_sets, shingles, stored, text_bytes, text_chunks

WIDTH = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Shared shingles whose order is known, at most (16 bytes each are sent to all tasks).
ORDERED = 1 << 17
#: Lossy counting: shingles a window, and what each window takes off a count.
WINDOW, LOSS = 1 << 21, 3
#: Bits of a set's bitmap: a power of two, so many an element at least, and at least LEAST_BITS.
BITS, LEAST_BITS = 3, 512
#: Pairs of sets whose bitmaps are compared at once.
COMPARED = 512
#: Prefix elements that a task groups at once, about.
BUCKET = 1_000_000
#: Linked sets of n elements or more share 1 + n / EXTRA elements of their prefixes.
EXTRA = 8
#: A round's partners are chosen by the place of the shared element in steps of
#: this many 256ths of their size, then by hash.
STEPS = (1, 8)
#: A pair is not made at an element if it shares one of so many before it.
EARLIER = 4
#: An element is left out if its classes share the last one before it of one of so many kinds (a power of two).
KINDS = 16


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _frequent(batches):
    """(shingle, count) of each window's shingles seen more than LOSS times."""
    let_go()
    held, size = [], 0

    def counted():
        key, n = np.unique(np.concatenate(held), return_counts=True)
        many = n > LOSS
        return pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(n[many] - LOSS)], ["token", "n"])

    for batch in batches:
        for _, _, texts in text_chunks(_column(batch, "text")):
            h, _ = shingles(text_bytes(texts), WIDTH)
            held.append(h)
            size += len(h)
            if size >= WINDOW:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ORDERED frequent shingles of all documents, ascending, and
    the binary logarithm of their counts (lossy, never above the true one)."""
    counted = docs.select("text").mapInArrow(_frequent, "token long, n long")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(ORDERED).toArrow()
    key = top.column("token").to_numpy().astype(np.int64).view(U)
    level = np.log2(top.column("n").to_numpy().astype(float) + LOSS).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    order = np.argsort(key)
    return key[order], level[order]


def _found(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values, at


def _sums(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of ``count`` values from each ``first``."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[first + count] - total[first]


def _bitmaps(h: np.ndarray, own: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set (of ``n`` elements) the parity of its elements that fall
    on each bit: two sets' maps, the wider one folded, differ in no more bits
    than the sets in elements."""
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(BITS * n, 1))).astype(np.int64))
    first = np.cumsum(width) - width
    bits = np.zeros(width.sum(), np.uint8)
    where, times = np.unique(first[own] + (h & (width[own] - 1).astype(U)).astype(np.int64), return_counts=True)
    bits[where] = times & 1
    maps = np.packbits(bits).tobytes()
    return [maps[a : a + k] for a, k in zip((first // 8).tolist(), (width // 8).tolist())]


def _prefixes(hot: np.ndarray, level: np.ndarray):
    def run(batches):
        let_go()
        for batch in batches:
            ids = _column(batch, "doc_id")
            for lo, hi, texts in text_chunks(_column(batch, "text")):
                h, own = shingle_sets(text_bytes(texts), WIDTH)
                n = np.bincount(own, minlength=hi - lo)
                first = np.cumsum(n) - n
                same, at = _found(hot, h)
                rank = np.where(same, level[at] + 1, 0) if len(hot) else np.zeros(len(h), np.int64)
                maps = _bitmaps(h, own, n)
                class_1, class_2 = _sums(mix(h + U(11)), first, n), _sums(mix(h ^ U(0x5DEECE66D)), first, n)
                h = h[np.argsort(own * 128 + rank, kind="stable")]
                need = np.where(n > 0, np.minimum(n, n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1 + n // EXTRA), 0)
                group = mix(_sums(mix(h + U(7)), first, need) + n.astype(U) * U(0x9E3779B97F4A7C15)) & ~U(1)
                prefix = [h[a : a + k].tobytes() for a, k in zip(first.tolist(), need.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(group.view(np.int64)),
                     pa.array(class_1.view(np.int64)), pa.array(class_2.view(np.int64)), pa.array(maps, pa.binary()), pa.array(prefix, pa.binary())],
                    ["doc_id", "n", "gid", "c1", "c2", "bitmap", "prefix"],
                )

    return run


def _posted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, group, place) of a batch, each group once. The group's lowest
    bit, 0 by itself, is 1 for elements past the first floor(n / 4) + 1. The
    place in the set is in 256ths of n, rounded down (below 96)."""
    gid = _column(batch, "gid").to_numpy()
    _, one = np.unique(gid, return_index=True)
    prefix = _column(batch, "prefix").take(pa.array(one)).to_pylist()
    count = np.array([len(p) // 8 for p in prefix], np.int64)
    n = _column(batch, "n").to_numpy()[one]
    plain = n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    part = (place * 256 // np.repeat(np.maximum(n, 1), count)).astype(np.uint8)
    return np.frombuffer(b"".join(prefix), U), np.repeat(gid[one], count) | (place >= np.repeat(plain, count)), part


def _blocks(hot: np.ndarray, level: np.ndarray, buckets: int):
    """Prefix elements in blocks by bucket: rare ones by their hash, frequent
    ones by their group (buckets below 0), so no bucket gets a hot element."""
    prefixes = _prefixes(hot, level)

    def run(batches):
        for batch in prefixes(batches):
            token, gid, place = _posted(batch.filter(pc.is_valid(_column(batch, "doc_id"))))
            same, at = _found(hot, token)
            bucket = np.where(same, -1 - ((gid.view(U) >> U(1)) % U(buckets)).astype(np.int64), ((token >> U(32)) % U(buckets)).astype(np.int64))
            rank = np.where(same, level[at] + 1, 0) if len(hot) else np.zeros(len(token), np.int64)
            token = (rank.astype(U) << U(57)) | (token >> U(7))  # numbers in the order of the sets; two that become equal only make more pairs
            order = np.argsort(bucket, kind="stable")
            token, gid, place, bucket = token[order], gid[order], place[order], bucket[order]
            has, at = np.unique(bucket, return_index=True)
            to = np.append(at[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [pa.array(has), pa.array([token[a:b].tobytes() for a, b in zip(at, to)], pa.binary()),
                 pa.array([gid[a:b].tobytes() for a, b in zip(at, to)], pa.binary()),
                 pa.array([place[a:b].tobytes() for a, b in zip(at, to)], pa.binary())],
                ["bucket", "tokens", "gids", "places"],
            )

    return run


def _meta(hot: np.ndarray, level: np.ndarray):
    prefixes = _prefixes(hot, level)
    return lambda batches: (b.select(["doc_id", "n", "gid", "c1", "c2", "bitmap"]) for b in prefixes(batches))


def _again(sorted_values: np.ndarray) -> np.ndarray:
    """Which values stand beside their like."""
    same = np.zeros(len(sorted_values) + 1, bool)
    same[1:-1] = sorted_values[1:] == sorted_values[:-1]
    return same[1:] | same[:-1]


def _shared_of_bucket(t: pa.Table) -> pa.Table:
    """(element, group, place) once each; of rare elements only those that
    two groups or more have. ``alike`` is the same for rare elements of the
    same groups."""
    token = np.frombuffer(b"".join(t.column("tokens").to_pylist()), U)
    gid = np.frombuffer(b"".join(t.column("gids").to_pylist()), np.int64)
    place = np.frombuffer(b"".join(t.column("places").to_pylist()), np.uint8)
    rare = not len(t) or t.column("bucket")[0].as_py() >= 0
    if rare:  # most elements are in one group: a sort by them alone comes first
        order = np.argsort(token)
        token, gid, place = token[order], gid[order], place[order]
        keep = _again(token)
        token, gid, place = token[keep], gid[keep], place[keep]
    order = np.lexsort((gid, token))
    token, gid, place = token[order], gid[order], place[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
    token, gid, place = token[new], gid[new], place[new]
    keep = _again(token) if rare else np.ones(len(token), bool)
    token, gid, place = token[keep], gid[keep], place[keep]
    early, gid, alike = (gid & 1) == 0, gid & ~1, token
    if rare:
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(token)))
        alike = np.repeat(mix(_sums(mix(gid.view(U)), first, count)), count)
    return pa.table({"token": token.view(np.int64), "alike": alike.view(np.int64), "gid": gid, "early": pa.array(early), "place": place.astype(np.int64)})


def _sets(batches):
    """For rows (id, to, text): id, to and the set of the text, if it is the
    set of class ``id`` (a repeated document id brings other texts too)."""
    for batch in batches:
        ids, to = _column(batch, "id"), _column(batch, "to")
        for lo, hi, texts in text_chunks(_column(batch, "text")):
            h, own = shingle_sets(text_bytes(texts), WIDTH)
            n = np.bincount(own, minlength=hi - lo)
            first = np.cumsum(n) - n
            cid = _sums(mix(h + U(11)), first, n)  # as in _prefixes
            elements = [h[a : a + k].tobytes() for a, k in zip(first.tolist(), n.tolist())]
            mine = pa.array(cid.view(np.int64) == ids.slice(lo, hi - lo).to_numpy())
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), to.slice(lo, hi - lo), pa.array(elements, pa.binary())], ["id", "to", "elements"]).filter(mine)


def _needed(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The least intersection of two linked sets of these sizes."""
    top, low = NUMERATOR * (n1 + n2), NUMERATOR + DENOMINATOR
    return (top + low - 1) // low


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with ``words`` words."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def _apart(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """In how many bits the maps of each pair differ."""
    out = np.zeros(len(one), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(one, two)], np.int64).reshape(-1, 2)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(axis=1))
        for lo in range(0, len(at), COMPARED):
            some = at[lo : lo + COMPARED]
            x, y = (np.frombuffer(b"".join(maps[i] for i in some), U).reshape(len(some), -1) for maps in (one, two))
            words = size.min() // 8
            out[some] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(axis=1, dtype=np.int64)
    return out


def _maps_allow(batches):
    for batch in batches:
        a, b, n1, n2 = (_column(batch, c) for c in ("a", "b", "n1", "n2"))
        size1, size2 = n1.to_numpy(), n2.to_numpy()
        apart = _apart(_column(batch, "m1").to_pylist(), _column(batch, "m2").to_pylist())
        ok = apart <= size1 + size2 - 2 * _needed(size1, size2)
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok))


def _linked(batches):
    for batch in batches:
        a, b = _column(batch, "a"), _column(batch, "b")
        ok = []
        for x, y in zip(_column(batch, "s1"), _column(batch, "s2")):
            s1, s2 = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = len(np.intersect1d(s1, s2, assume_unique=True))
            ok.append(DENOMINATOR * both >= NUMERATOR * (len(s1) + len(s2) - both))
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids that link. Only the classes of pairs
    that the bitmaps allow get their sets, from their texts: the set of
    each a goes to where the set of its b is."""
    maps = classes.select("cid", "n", "bitmap")
    near = stored(
        pairs.join(maps.toDF("a", "n1", "m1"), "a").join(maps.toDF("b", "n2", "m2"), "b")
        .select("a", "b", "n1", "n2", "m1", "m2").mapInArrow(_maps_allow, "a long, b long")
    )
    first = classes.select("cid", F.col("first_id").alias("doc_id"))
    send = stored(near.join(first.withColumnRenamed("cid", "a"), "a").select("doc_id", F.col("a").alias("id"), F.col("b").alias("to")))
    hold = stored(near.select("b").distinct().join(first.withColumnRenamed("cid", "b"), "b").select("doc_id", F.col("b").alias("id"), F.col("b").alias("to")))

    def sets(wanted: DataFrame) -> DataFrame:
        small = wanted.count() <= BROADCAST_ROWS
        return docs.join(F.broadcast(wanted) if small else wanted, "doc_id").select("id", "to", "text").mapInArrow(_sets, "id long, to long, elements binary")

    one, two = sets(send).toDF("a", "b", "s1"), sets(hold).select(F.col("id").alias("b"), F.col("elements").alias("s2"))
    links = stored(one.join(two, "b").select("a", "b", "s1", "s2").mapInArrow(_linked, "a long, b long"))
    discard(near, send, hold)
    free_shuffles(docs.sparkSession)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over ``edges`` (a, b), for each
    id that has an edge. Every step takes the smallest label among the
    neighbours, then that label's own label, until nothing changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = (
            both.join(label.toDF("b", "theirs"), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
            .join(label.toDF("a", "comp"), "a")
            .select(F.col("a").alias("id"), F.least("theirs", "comp").alias("near"), F.col("comp").alias("was"))
        )
        far = label.toDF("near", "far")
        new = stored(near.join(far, "near", "left").select("id", F.least("near", "far").alias("comp"), (F.least("near", "far") != F.col("was")).alias("moved")))
        discard(label)
        label = new
        if new.where("moved").isEmpty():
            discard(both)
            return label
        label = label.drop("moved")
        label.stored_at = new.stored_at


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between classes join their components; ``label`` and ``links`` go."""
    comp = lambda c: label.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}"))
    edges = links.join(comp("a"), "a").join(comp("b"), "b").where("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    merged = components(edges)
    new = stored(label.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp")))
    discard(merged, label, links)
    return new


# A posting is (token, cid, p, k): p packs the class's size, the place of the
# element and whether it is an early one; k: for how many elements it stands.
_SIZE, _PLACE = 12, 4


def _packed(n: str, place: str, early: Column) -> Column:
    both = F.shiftleft(F.col(n), _SIZE).bitwiseOR(F.shiftleft(F.col(place), _PLACE))
    return both.bitwiseOR(early.cast("long"))


def _unpacked(what: str) -> Column:
    p = F.col("p")
    return {
        "n": F.shiftright(p, _SIZE),
        "place": F.shiftright(p, _PLACE).bitwiseAND(255),
        "early": p.bitwiseAND(1) != 0,
    }[what]


def _best_partners(rows: DataFrame, turn: int) -> DataFrame:
    """For each class (``rows``: postings with comp) the class of another
    component with which it shares the most prefix elements, among one class
    of each element and size band (sizes in a band are within a factor of
    4/3). That one has the element at the least place, in the turn's steps,
    then the least hash."""
    n = _unpacked("n")
    rows = rows.withColumn("band", F.floor(F.log(n) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int"))
    place = F.floor(_unpacked("place") / STEPS[turn]).cast("int").alias("place")
    # cid is a hash itself; the second turn takes it from the other end
    rank = F.struct(place, (F.bitwise_not("cid") if turn else F.col("cid")).alias("h"), "comp")
    first = (
        rows.groupBy("token", "band").agg(F.min(rank).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("top")).where("low < top")
        .select("token", "band", (F.bitwise_not("p.h") if turn else F.col("p.h")).alias("b"), F.col("p.comp").alias("comp_b"))
    )
    shared = rows.join(first, ["token", "band"]).where("comp <> comp_b").groupBy("cid", "b").agg(F.sum("k").alias("k"), F.min(n).alias("n"))
    if turn == 0:  # over all elements, so the number shared tells
        shared = shared.where(f"k > floor(n * {NUMERATOR} / {DENOMINATOR}) div {EXTRA}")
    return shared.groupBy(F.col("cid").alias("a")).agg(F.max(F.struct("k", "b")).alias("p")).select("a", F.col("p.b").alias("b"))


def _spans(rows: DataFrame, *more: Column) -> DataFrame:
    """Of each element with classes of two components or more: the least size
    and the largest reach, and ``more``."""
    each = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("reach").alias("far"), *more)
    return each.where("lo < hi").drop("lo", "hi")


def _first_shared(rows: DataFrame) -> DataFrame:
    """``_spans`` without elements that are no pair's first shared one: all
    their classes have one earlier element in common. Looked at is, of each
    kind of elements (by their lowest bits), the last that a class has before."""
    before = Window.partitionBy("cid").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [F.max(F.when(F.col("token").bitwiseAND(KINDS - 1) == i, F.col("token"))).over(before) for i in range(KINDS)]
    last = rows.withColumns({f"last_{i}": F.coalesce(kind, "token") for i, kind in enumerate(kinds)})
    ends = [f(f"last_{i}").alias(f"{name}_{i}") for i in range(KINDS) for f, name in ((F.min, "from"), (F.max, "to"))]
    common = " or ".join(f"from_{i} = to_{i} and to_{i} < token" for i in range(KINDS))
    return _spans(last, *ends).where(f"not ({common})").select("token", "least", "far")


def _pairs_left(rows: DataFrame) -> DataFrame:
    """All pairs across components (``rows``: token, cid, n, reach, comp) that
    can link by sizes and places, once each. If the first element that two
    sets share is at place i of n, they share at most n - i, so the partner
    has at most (4 n - 7 i) / 3 elements (its ``reach``). An element whose
    classes are all connected makes no pair, nor one whose classes share
    another before it. ``token`` ascends with the places of every set, so the
    reach gets no larger: a pair that shares ``earlier`` elements, the last
    ones before, is made at one of those, and every pair at the first that it
    shares."""
    rows = rows.join(_first_shared(rows), "token").where("reach >= least and n <= far").select("token", "cid", "n", "reach", "comp")
    before = Window.partitionBy("cid").orderBy("token").rowsBetween(-EARLIER, -1)
    rows = stored(rows.withColumn("earlier", F.collect_list("token").over(before)))
    other = rows.groupBy("token", F.col("comp").alias("comp_b")).agg(
        F.min("n").alias("least"), F.max("reach").alias("far"), F.when(F.count("*") == 1, F.min("earlier")).alias("only")
    )
    members = rows.toDF(*[f"{c}_b" if c != "token" else c for c in rows.columns])
    new = "(only is null or not arrays_overlap(earlier, only))"  # a component of one class here
    pairs = stored(
        rows.join(other, "token").where(f"comp < comp_b and reach >= least and n <= far and {new}").drop("least", "far", "only")
        .join(members, ["token", "comp_b"]).where("n_b <= reach and n <= reach_b and not arrays_overlap(earlier, earlier_b)")
        .select(F.col("cid").alias("a"), F.col("cid_b").alias("b")).distinct()
    )
    discard(rows)
    return pairs


def _connected(posted: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, comp) of the classes that have postings."""
    label = stored(posted.select("cid").distinct().select("cid", F.col("cid").alias("comp")))

    def linked(pairs: DataFrame) -> DataFrame:
        links = verified(pairs, known, docs)
        if links.isEmpty():
            discard(links)
            return label
        return _relabelled(label, links)

    label = linked(_best_partners(posted.withColumn("comp", F.col("cid")), 0))
    # Elements that are still in two components or more.
    n, place = _unpacked("n"), _unpacked("place")
    reach = F.floor(((NUMERATOR + DENOMINATOR) * (256 - place) - 256 * NUMERATOR) * n / (256 * NUMERATOR))
    rows = posted.join(label, "cid").withColumns({"n": n, "reach": reach})
    apart = rows.join(_spans(rows), "token").where("reach >= least and n <= far")
    apart = stored(apart.select("token", "cid", "n", "reach", "p", "k"))
    discard(posted)
    if not apart.isEmpty():
        label = linked(_best_partners(apart.join(label, "cid"), 1))
        pairs = _pairs_left(apart.where(_unpacked("early")).join(label, "cid").select("token", "cid", "n", "reach", "comp"))
        label = linked(pairs)
        discard(pairs)
    discard(apart)
    return label


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``.

    Words are runs of characters other than space and U+0009-U+000D, with
    A-Z as a-z. A document of fewer than five words has its whole word
    sequence as its only shingle. Null, empty or blank text: n_shingles 0,
    linked with nothing. Null id: counted, linked with nothing, component
    null. Every row is a document of its own: repeated rows are in one
    class, and an id that is repeated with another text is linked only as
    that text is. Other columns are ignored. An empty table gives no rows.
    Shingles and classes are compared by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot, level = frequent_shingles(docs)
    each = stored(docs.mapInArrow(_meta(hot, level), "doc_id long, n long, gid long, c1 long, c2 long, bitmap binary"))
    full = each.where("n > 0 and doc_id is not null")
    classes = stored(
        full.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("first_id"), F.min("gid").alias("gid"), F.first("bitmap").alias("bitmap"))
        .withColumn("cid", F.col("c1"))
    )
    postings = (full.agg(F.sum("n")).first()[0] or 0) * (1 - NUMERATOR / DENOMINATOR + 1 / EXTRA)
    buckets = int(postings // BUCKET) + 12
    # The prefixes are made again from the texts: that costs less than to store them.
    elements = (
        docs.mapInArrow(_blocks(hot, level, buckets), "bucket long, tokens binary, gids binary, places binary")
        .groupBy("bucket").applyInArrow(_shared_of_bucket, "token long, alike long, gid long, early boolean, place long")
    )
    # All members of a group have one size.
    sizes = classes.groupBy("gid").agg(F.first("n").alias("n"), F.count("*").alias("many"))
    # Elements of the same groups are one posting, with the place of the first; that of a whole prefix comes before all elements.
    merged = elements.join(sizes, "gid").groupBy("gid", "n", "alike").agg(
        F.min("token").alias("token"), F.max("early").alias("early"), F.min("place").alias("place"), F.count("*").alias("k")
    )
    whole = F.shiftrightunsigned("gid", 1).bitwiseOR(F.lit(-1 << 63))
    groups = sizes.where("many > 1").select("gid", whole.alias("token"), F.lit(True).alias("early"), F.lit(0).cast("long").alias("place"), F.col("n").alias("k"))
    # A group can only link if enough of its elements are left.
    left = F.sum("k").over(Window.partitionBy("gid"))
    enough = merged.withColumn("left", left).where(f"left > floor(n * {NUMERATOR} / {DENOMINATOR}) div {EXTRA}")
    members = classes.select("gid", "cid", "n")
    posted = stored(
        enough.select("gid", "token", "early", "place", "k").unionByName(groups)
        .join(members, "gid").select("token", "cid", _packed("n", "place", F.col("early")).alias("p"), "k")
    )
    known = stored(classes.join(posted.select("cid").distinct(), "cid", "left_semi"))
    free_shuffles(docs.sparkSession)
    label = _connected(posted, known, docs)
    discard(known)
    comps = label.join(classes, "cid").groupBy("comp").agg(F.min("first_id").alias("component_id"))
    found = classes.join(label.join(comps, "comp").select("cid", "component_id"), "cid", "left").select(
        "n", "c1", "c2", F.coalesce("component_id", "first_id").alias("component_id")
    )
    return each.join(found, ["n", "c1", "c2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
