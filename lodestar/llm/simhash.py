"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints are linked if at most three bits differ. Half of three is
one and a half, so the odd bit is taken out first: the bits are cut into three
blocks, and if fingerprints differ at all, at least one difference lies in some
block; without that block they differ in two bits at most. For each block left
out, every fingerprint emits all variants of the other bits within half the
radius left, which is one (132 variants in all). Two linked fingerprints then
share a variant. Variants are shuffled, and colliding fingerprints verified.

At scale: only distinct fingerprints are hashed, so a group of exact copies is one
fingerprint however large it is. In a group that shares a variant no pairs are
emitted: a task links its members by a search that leaves out what is linked, and
emits a tree. A group of more than ``hot`` fingerprints is not held at all: its
members go through full-width balls (see ``_hot_links``), whose groups can't
exceed a ball of radius two. Components are found by alternating stars.

Defined cases: a null or empty text has fingerprint zero, and links like any
other; fewer than three words are one shingle; a component's id is its smallest
non-null doc_id; repeated rows are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import similar
from lodestar.llm.common import arrow_texts, fresh, row_key, small_batches, small_side, text_or_empty, written
from lodestar.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints that share a variant are compared in one task up to so many.
HOT = 2000
#: (first bit, bits) of the blocks that are left out in turn.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in arrow_texts(batch, 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """For each variant the bits that stay, and what is flipped (with the left-out block's number in its place)."""
    keep, flip = [], []
    for number, (first, bits) in enumerate(BLOCKS, 1):
        block = ((1 << bits) - 1) << first
        rest = ~block & (1 << 64) - 1
        for x in [0, *(1 << b for b in range(64) if not block >> b & 1)]:
            keep.append(rest)
            flip.append(x | number << first)
    return np.array(keep, dtype=np.uint64), np.array(flip, dtype=np.uint64)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): all variants of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, flip = _flips()
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(own), 2000):
                part = own[a : a + 2000]
                keys = (part[:, None] & keep) ^ flip
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(flip)).view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _tree(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked among distinct fingerprints: a search from each, over those not yet reached."""
    left, reached = [], []
    rest = members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= RADIUS
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), here))
                reached.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(reached)) if left else (none, none)


def _links(keyed: DataFrame, hot: int) -> DataFrame:
    """(u, v) linked; a row (u, null) for each member of a group of more than ``hot``."""
    ordered = keyed.repartition("key").sortWithinPartitions("key", "fp")

    def rows(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), other], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last key seen, whose group may go on: its members so far, or crowded and then none.
        last, held, crowded = None, np.empty(0, np.uint64), False
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            head = int(np.searchsorted(keys, last, side="right")) if last is not None else 0
            if crowded and head:
                yield rows(fps[:head].copy(), None)
            elif head:
                held = np.concatenate([held, fps[:head]])
            if head < len(keys):  # a new key begins: the held group is whole
                if not crowded:
                    yield from _groups(held, np.array([0, len(held)]), rows, hot)
                starts = head + np.concatenate([[0], np.nonzero(np.diff(keys[head:]))[0] + 1])
                yield from _groups(fps, starts, rows, hot)
                last, held, crowded = keys[-1], fps[starts[-1] :].copy(), False
            if not crowded and len(held) > hot:
                yield rows(held, None)
                held, crowded = held[:0], True
        if not crowded:
            yield from _groups(held, np.array([0, len(held)]), rows, hot)

    return ordered.mapInArrow(run, "u long, v long")


def _groups(fps: np.ndarray, starts: np.ndarray, rows, hot: int) -> Iterator[pa.RecordBatch]:
    """The links within the groups between neighbouring starts."""
    sizes = np.diff(starts)
    pairs = starts[:-1][sizes == 2]
    a, b = fps[pairs], fps[pairs + 1]
    near = np.bitwise_count(a ^ b) <= RADIUS
    us, vs = [a[near]], [b[near]]
    for k in np.nonzero(sizes > 2)[0].tolist():
        members = fps[starts[k] : starts[k + 1]]
        if len(members) > hot:
            yield rows(members.copy(), None)
            continue
        u, v = _tree(members)
        us.append(u)
        vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    if len(u):
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        yield rows(both[:, 0].copy(), both[:, 1].copy())


def _hot_links(fps: DataFrame) -> DataFrame:
    """Links among fingerprints by whole 64-bit balls, without comparing pairs.

    Three differing bits mean one fingerprint has an even number of set bits and
    one an odd number, and two of the three bits lie in the same half. So even
    ones emit their ball of radius one and all flips of two bits of one half, odd
    ones their ball of radius one. Members that reach a variant by r and s flips
    differ in r + s bits at most: whoever came by two flips is linked to all that
    came by at most one. A variant's group is at most a ball of radius two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = [0, *(1 << b for b in range(64))]
        two = [1 << a | 1 << b for half in (0, 32) for a in range(half, half + 32) for b in range(half, a)]
        odd = np.array(one, dtype=np.uint64)
        even = np.array(one + two, dtype=np.uint64)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for flips, part in ((odd, own[np.bitwise_count(own) % 2 == 1]), (even, own[np.bitwise_count(own) % 2 == 0])):
                steps = np.bitwise_count(flips).astype(np.int32)
                for a in range(0, len(part), 200):
                    some = part[a : a + 200]
                    yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64)), pa.array(np.tile(steps, len(some)))], names=["key", "fp", "steps"])

    balls = fps.select("fp").mapInArrow(run, "key long, fp long, steps int")
    centre = F.min(F.when(F.col("steps") <= 1, F.col("fp"))).over(Window.partitionBy("key"))
    return balls.withColumn("centre", centre).where(F.col("centre").isNotNull() & (F.col("centre") != F.col("fp"))).select(F.col("centre").alias("u"), F.col("fp").alias("v")).distinct()


def linked_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints that are connected."""
    found = written(_links(variants(fps), hot))
    links = found.where("v is not null")
    crowded = written(found.where("v is null").select(F.col("u").alias("fp")).distinct())
    return links if crowded.isEmpty() else links.union(_hot_links(crowded))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    own = written(fingerprints(docs))
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    stars = components(linked_fingerprints(nodes, hot))
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    placed = member.join(nodes.select("fp", "least"), "fp")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = placed.join(smallest, "root").select("fp", "component_id")
    copies = nodes.where("n > 1").join(groups.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    known = groups.union(copies)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(known, "fp", "left").select("doc_id", digits.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def proposed_pairs(texts: DataFrame, shingle: int, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: pairs that connect the texts (row, text) whose fingerprints are linked.

    Of the texts of one fingerprint the smallest row stands for it in the links.
    """
    own = written(fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), shingle).select(F.col("doc_id").alias("row"), "fp"))
    nodes = written(own.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    alike = own.join(nodes.where("n > 1"), "fp").where("row <> first").select("first", "row")
    links = linked_fingerprints(nodes, hot)
    one, two = nodes.select(F.col("fp").alias("u"), "first"), nodes.select(F.col("fp").alias("v"), F.col("first").alias("row"))
    across = links.join(one, "u").join(two, "v").select("first", "row")
    return alike.union(across).select(F.least("first", "row").alias("a"), F.greatest("first", "row").alias("b")).distinct()


#: Ids to drop are broadcast up to so many (8 bytes each); beyond, the join is a shuffle.
BROADCAST_IDS = 400_000


def drop_near_duplicates(docs: DataFrame, hot: int = HOT, similarity: float | None = None, shingle: int = similar.SHINGLE) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id (null last; then the smallest key); of equal rows one stays.

    Groups are those of ``near_duplicates``. With ``similarity``, links are pairs whose
    sets of shingles are verified to be so similar: fingerprints of these shingles propose
    pairs by ball hashing, and as three bits don't reach every such pair, the search of
    ``similar.similar_documents`` adds what they leave. Rows are named by ``row_key``, so
    a doc_id on rows with different texts, or none, is judged text by text.
    """
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, row_key())
    alone = keyed.select(F.col(row).alias("doc_id"), "text")
    groups = near_duplicates(alone, hot) if similarity is None else similar.similar_documents(alone, shingle, similarity, lambda texts: proposed_pairs(texts, shingle, hot))
    judged = written(groups.select(F.col("doc_id").alias(row), "component_id"))
    members = judged.join(judged.where(F.col(row) != F.col("component_id")).select("component_id").distinct(), "component_id").distinct()
    named = written(members.join(keyed.select(row, "doc_id").distinct(), row))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", row)).alias("first"))
    gone = written(named.join(first, "component_id").where(F.col(row) != F.col("first")[row]).select(row))
    kept = keyed.join(small_side(gone, BROADCAST_IDS), row, "left_anti")
    repeated = written(judged.groupBy(row).count().where("count > 1").select(row))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = small_side(repeated, BROADCAST_IDS)
    return kept.join(again, row, "left_anti").select(*docs.columns).union(kept.join(again, row, "left_semi").dropDuplicates([row]).select(*docs.columns))
