"""Groups of documents whose sets of word shingles are similar, found without loss.

Two sets of m and n shingles with a Jaccard similarity of t or more share, in any one
order of all shingles, a shingle within the first n - ceil(t n) + 1 of each (prefix
filter). The order is learned from all documents: shingles by which more than
``CROWDED`` meet come last, by their count, the others by their hash; what that brings
forward is counted again. So passages that many documents hold are met only by
documents that hold little else. Any order is without loss. Candidates are verified by
exact similarity of the sets.

At scale: only distinct word sequences are treated. A document sends about a fifth
of its shingles. Those that meet by a shingle are first compared with one neighbour
each, in an order that differs from shingle to shingle; what that links is connected,
and only members of still different components are then compared in groups of three
or more. So a large group of near copies doesn't give all its pairs. Nor does a large
group of texts that share less than that: a task first tells only which members may be
similar to another, by short sketches; these meet again with sketches as wide as their
sets ask for, once for all the shingles that they share in a row, and what is left are
pairs that are similar or hardly not.

Defined cases: texts are compared in lower case (A-Z), words cut at ASCII white
space; fewer words than a shingle are one shingle; null or empty texts are equal; a
group's id is its smallest non-null doc_id; repeated rows are kept; an empty table
gives an empty table. Shingles and word sequences are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_texts, small_batches, small_side, text_or_empty, written
from lodestar.llm.components import components
from lodestar.llm.substring import Words, mixed

SHINGLE = 5
SIMILARITY = 0.8
#: Documents that may meet by a shingle before it comes last, how often that is counted, and how many such shingles are told to all tasks (16 bytes each).
CROWDED = 12
ROUNDS = 2
MOST_FREQUENT = 500_000
#: Bits of a first sketch; of a second one for each shingle, and at most (powers of two).
SKETCH = 256
WIDE, WIDEST = 2, 4096
#: By how many of the keys before a key it is seen that two texts have met already.
LAST = 4
BROADCAST_IDS = 400_000


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the distinct hashes of its shingles, signed longs in order."""
    normal = [b" ".join(t.encode().lower().split()) for t in texts]
    out = [np.array([xxhash.xxh3_64_intdigest(t)] if t else [], dtype=np.uint64).view(np.int64) for t in normal]
    long = [i for i, t in enumerate(normal) if t and t.count(b" ") >= shingle - 1]
    if long:
        words = Words([normal[i] for i in long])
        h = mixed(words.hashes(), shingle).view(np.int64)
        ends = np.cumsum(words.lens)
        for i, a, b in zip(long, (ends - words.lens).tolist(), (ends - shingle + 1).tolist()):
            out[i] = np.unique(h[a:b])
    return out


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set by which any similar set meets it, rare ones first. ``frequent`` is sorted."""
    if len(frequent) and len(own):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        own = own[np.lexsort((own, np.where(frequent[at] == own, counts[at], 0)))]
    return own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


def sketch(own: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parities of the shingles by hash, ``bits`` of them, a power of two: two sketches differ in no more bits than the sets differ in shingles."""
    return np.packbits(np.bincount((own & (bits - 1)), minlength=bits).astype(np.uint8) & 1).tobytes()


def wide(n: int) -> int:
    """Bits of the second sketch of a set of n shingles."""
    return min(WIDEST, max(SKETCH, 1 << (WIDE * n - 1).bit_length())) if n else SKETCH


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, shingles)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            sets = shingle_sets(arrow_texts(batch, 1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])

    return texts.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def _crowded(keyed: DataFrame, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What was known to be frequent, and the shingles by which too many documents meet, sorted, with their counts."""
    counts = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED))
    least = CROWDED
    while counts.where(F.col("n") > least).count() > MOST_FREQUENT:
        least *= 2
    found = counts.where(F.col("n") > least).toArrow()  # MOST_FREQUENT at most
    h, c = (np.concatenate([x, found.column(i).to_numpy()]) for i, x in enumerate(before))
    h, first = np.unique(h, return_index=True)
    return h, c[first]


def _prefixes(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """(key, row, n, pos, sketch): the shingles of each prefix, the size of the set and the place in its order; the set's sketch with the first of them."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            keys, sizes, marks = [], [], []
            for own in shingle_sets(arrow_texts(batch, 1), shingle):
                keys.append(prefix(own, *shared.value, similarity) if len(own) else own)
                sizes.append(len(own))
                marks.append(sketch(own))
            each = [len(k) for k in keys]
            columns = [np.concatenate(keys), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each), np.repeat(np.array(sizes, np.int32), each), np.concatenate([np.arange(e, dtype=np.int32) for e in each])]
            told = [x for m, e in zip(marks, each) if e for x in (m, *[None] * (e - 1))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(told, pa.binary())], names=["key", "row", "n", "pos", "sketch"])

    return texts.select("row", "text").mapInArrow(run, "key long, row long, n int, pos int, sketch binary")


def _possible(n, pos, m, at, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one is at these places can be similar."""
    left = 1 + np.minimum(n - pos - 1, m - at - 1)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (left >= similarity / (1 + similarity) * (n + m) - 1e-9)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups, binary ones as objects; the first column is the group's key."""
    held = None
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if cut:
                yield [c[:cut] for c in held]
                held = [c[cut:].copy() for c in held]
    if held is not None and len(held[0]):
        yield held


_FOUND = ["a", "b", "key", "row", "n", "pos", "sketch"]


def _neighbours(keyed: DataFrame, similarity: float) -> DataFrame:
    """(a, b, null..): pairs of neighbours that can be similar; (null, null, key, row, n, pos): members of groups of three or more; and (row, sketch)."""
    ordered = keyed.withColumn("r", F.xxhash64("key", "row")).repartition("key").sortWithinPartitions("key", "r").select("key", "row", "n", "pos", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, row, n, pos, marks in _by_group(batches):
            near = np.nonzero((key[1:] == key[:-1]) & (row[1:] != row[:-1]) & _possible(n[1:], pos[1:], n[:-1], pos[:-1], similarity))[0]
            starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            size = np.diff(np.append(starts, len(key)))
            more = np.repeat(size, size) > 2
            none = pa.nulls(int(more.sum()), pa.int64())
            pairs = [np.minimum(row[near], row[near + 1]), np.maximum(row[near], row[near + 1])]
            columns = [pa.concat_arrays([pa.array(p), none]) for p in pairs]
            columns += [pa.concat_arrays([pa.nulls(len(near), pa.int64()), pa.array(c[more].astype(np.int64))]) for c in (key, row, n, pos)]
            columns.append(pa.nulls(len(columns[0]), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=_FOUND)
            told = np.nonzero(np.array([m is not None for m in marks]))[0]
            blank = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, blank, pa.array(row[told]), blank, blank, pa.array(marks[told], pa.binary())], names=_FOUND)

    return ordered.mapInArrow(run, "a long, b long, key long, row long, n long, pos long, sketch binary")


def _bits(marks: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of ``width`` words; a wider one is folded, which gives the sketch of that width."""
    out = np.empty((len(marks), width), np.uint64)
    for size in {len(m) for m in marks}:
        at = [i for i, m in enumerate(marks) if len(m) == size]
        own = np.frombuffer(b"".join(marks[i] for i in at), np.uint64).reshape(len(at), size // 8 // width, width)
        out[at] = np.bitwise_xor.reduce(own, axis=1)
    return out


def _meetings(comp, n, pos, marks: list[bytes], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of a key's members in order of n: one, and those of other components that can be similar to it; each pair once."""
    names, number = np.unique(comp, return_inverse=True)
    if len(names) == 1:
        return
    large = number == np.bincount(number).argmax()
    widths, folded = np.array([len(m) // 8 for m in marks]), {}
    for i in np.nonzero(~large)[0].tolist():
        # Set sizes are sorted: only those within the bound are looked at.
        lo = int(np.searchsorted(n, math.ceil(similarity * n[i] - 1e-9)))
        hi = int(np.searchsorted(n, n[i] / similarity + 1e-6, side="right"))
        at = np.arange(lo, hi)
        at = at[(number[lo:hi] != number[i]) & (large[lo:hi] | (at > i)) & _possible(n[i], pos[i], n[lo:hi], pos[lo:hi], similarity)]
        if not len(at):
            continue
        # Sketches widen with n, so that of lo is the narrowest; those before it are not looked at with this width.
        width = int(widths[lo])
        if width not in folded:
            first = int(np.searchsorted(widths, width))
            folded[width] = first, _bits(marks[first:], width)
        first, bits = folded[width]
        # Similar sets differ in this share of their shingles at most, and their sketches in no more bits.
        apart = np.bitwise_count(bits[at - first] ^ bits[i - first]).sum(axis=1, dtype=np.int64)
        at = at[apart <= (1 - similarity) / (1 + similarity) * (n[i] + n[at]) + 1e-9]
        if len(at):
            yield i, at


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of one group after the other; the first column is the group's key."""
    for columns in _by_group(batches):
        starts = np.nonzero(np.append(True, columns[0][1:] != columns[0][:-1]))[0].tolist()
        for s, e in zip(starts, [*starts[1:], len(columns[0])]):
            yield [c[s:e] for c in columns]


_MEMBER = ["key", "comp", "row", "n", "pos"]


def _dealt(members: DataFrame, *more: str) -> DataFrame:
    return members.repartition("key").sortWithinPartitions("key", "n").select(*_MEMBER, *more)


def _undecided(members: DataFrame, similarity: float) -> DataFrame:
    """(key, comp, row, n, pos): the members of a key that can be similar to one of another component by size, places and sketches. No pairs are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for *columns, marks in _groups(batches):
            _, comp, _, n, pos = columns
            open_ = np.zeros(len(n), bool)
            for i, at in _meetings(comp, n, pos, marks.tolist(), similarity):
                open_[i] = True
                open_[at] = True
            if open_.any():
                held.append([c[open_].astype(np.int64) for c in columns])
                count += int(open_.sum())
            if count > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=_MEMBER)
                held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=_MEMBER)

    return _dealt(members, "sketch").mapInArrow(run, "key long, comp long, row long, n long, pos long")


def _wide_sketches(sets: DataFrame) -> DataFrame:
    """(row, sketch) of about ``WIDE`` bits a shingle, so that few sets but similar ones differ in as few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(s.values.to_numpy(), wide(len(s.values))) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["row", "sketch"])

    return sets.select("row", "shingles").mapInArrow(run, "row long, sketch binary")


def _apart(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs within a key, of different components, that can be similar. members: key, comp, row, n, pos, sketch.

    Two that share one of the ``LAST`` keys before this one in their orders have met there, and are left out here.
    """
    order = Window.partitionBy("row").orderBy("pos")
    before = F.array(*(F.lag("key", k).over(order) for k in range(1, LAST + 1)))
    ordered = _dealt(members.withColumn("before", before), "sketch", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0
        for _, comp, row, n, pos, marks, before in _groups(batches):
            earlier = [set(x) - {None} for x in (b.tolist() for b in before)]
            for i, at in _meetings(comp, n, pos, marks.tolist(), similarity):
                found = row[[j for j in at.tolist() if earlier[i].isdisjoint(earlier[j])]]
                left.append(np.minimum(found, row[i]))
                right.append(np.maximum(found, row[i]))
                held += len(found)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], names=["a", "b"])
                    left, right, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _needed_sets(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(row, shingles) of some rows, stored."""
    needed = written(rows.select("row").distinct())
    return written(_sets(texts.join(small_side(needed, BROADCAST_IDS), "row", "left_semi"), shingle).dropDuplicates(["row"]))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs that are similar."""
    one = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return met.where(both / (F.size("x") + F.size("y") - both) >= similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id and component_id for every row: documents are linked if their shingle sets have this Jaccard similarity at least.

    ``propose`` gives pairs (a, b) of the distinct texts (row, text) from another
    search. They are verified with the first pairs, and what they link is not
    compared again; the result is the same for any pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            seqs = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.encode().lower().split())) for t in arrow_texts(batch, 2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs)], names=["doc_id", "row", "seq"])

    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    own = written(base.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, seq long"))
    # Of equal word sequences the row with the smallest key stands for all: its key names the sequence.
    nodes = written(own.groupBy("seq").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("n")))
    many = nodes.where("n > 1").select("seq", F.col("row").alias("first"))
    copies = written(own.join(many, "seq").where("row <> first").select("row").distinct())
    texts = base.join(small_side(copies, BROADCAST_IDS), "row", "left_anti").select("row", "text")
    frequent = (np.empty(0, np.int64), np.empty(0, np.int64))
    for _ in range(ROUNDS):
        known = len(frequent[0])
        frequent = _crowded(_prefixes(texts, frequent, shingle, similarity), frequent)
        if len(frequent[0]) == known:
            break
    found = written(_neighbours(_prefixes(texts, frequent, shingle, similarity), similarity))
    near = found.where("a is not null").select("a", "b")
    near = written((near.union(propose(texts)) if propose else near).distinct())
    sets = _needed_sets(near.select(F.explode(F.array("a", "b")).alias("row")), texts, shingle)
    links = written(_verified(near, sets, similarity))
    stars = components(links)
    members = found.where("key is not null").select("key", "row", "n", "pos")
    comps = stars.select(F.col("u").alias("row"), F.col("v").alias("comp"))
    marks = found.where("sketch is not null").select("row", "sketch").dropDuplicates(["row"])
    left = written(_undecided(members.join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row")).join(marks, "row"), similarity))
    if not left.isEmpty():
        sets = _needed_sets(left, texts, shingle)
        apart = written(_apart(left.join(written(_wide_sketches(sets)), "row"), similarity))
        stars = components(links.union(_verified(apart, sets, similarity)))
    member = stars.select(F.col("u").alias("row"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("row"), F.col("v").alias("root")).distinct())
    placed = nodes.join(member, "row", "left").select("seq", "least", F.coalesce("root", "row").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(placed.join(smallest, "root").select("seq", "component_id"), "seq").select("doc_id", "component_id")
