"""Removal of passages that an earlier document has, by repeated-phrase automata.

A window is 13 consecutive words. Documents are dealt by a hash of the text to shards
of about ``shard_bytes``, and three steps follow:

1. Each window is represented by its minimizer, the smallest hash among its nine
   phrases of five words; equal windows have equal minimizers, and neighbouring ones
   mostly share theirs. A minimizer recurs if two documents have it.
2. Recurring passages are confirmed: stretches of text whose windows have a recurring
   minimizer meet by that minimizer, and windows that two documents have are put
   together to passages, each with the smallest doc_id that holds it (its owner). A
   passage goes to every shard in which a later document has it.
3. Each shard compiles Aho-Corasick automata (over word numbers) from its passages, and
   all its documents stream through them. The automata locate every occurrence, word
   by word; those in documents after the owner are removed.

At scale: a shard sends each distinct stretch once, with the smallest and the largest
doc_id that hold it, so that no stretch, however many copies there are, has more rows
than there are shards. Stretches of a minimizer that more than ``hot`` documents share
are cut into windows, which meet by window in the order of their owners and stream
through without being held. An automaton has at most ``AUTOMATON_WORDS`` words; a
shard with more (one very long text) builds several, one after the other. Exact copies
share a shard, which streams their text once; copies that fill more than one shard are
dealt to as many as they fill.

Defined cases: a null text has no words; fewer than 13 words have no window and
lose nothing; a null doc_id counts as larger than all others and of several none
precedes another; rows that repeat a doc_id are one document's occurrences, so they
don't remove each other; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_texts, small_batches, small_side, text_or_empty, written

WINDOW = 13
PHRASE = 5
#: Documents that share a minimizer before its windows are treated one by one.
HOT = 1000
#: Minimizers that a task gathers before it sends them on.
CHUNK = 1_000_000
#: Text to a shard: its documents and passages are held together.
SHARD_BYTES = 512 << 10
#: Words of passages that go into one automaton, and bytes of stretches that are confirmed at a time.
AUTOMATON_WORDS = 1_000_000
CONFIRM_BYTES = 2 << 20
#: Hot minimizers are broadcast up to so many (8 bytes each).
BROADCAST_KEYS = 400_000
NO_ID = (1 << 63) - 1


def mixed(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ values[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


#: An odd random factor for each place in a word; drawn anew, for longer words, from the same seed.
_FACTORS = np.empty(0, np.uint64)


def _factors(n: int) -> np.ndarray:
    global _FACTORS
    if len(_FACTORS) < n:
        _FACTORS = np.random.default_rng(20_240_613).integers(0, 1 << 64, 1 << n.bit_length(), np.uint64) | np.uint64(1)
    return _FACTORS


class Words:
    """The words of several texts, each given as its words joined by single spaces and none empty: where they lie, and their hashes."""

    def __init__(self, texts: list[bytes]):
        self.lens = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
        self.joined = b" ".join(texts) + b" " if texts else b""
        chars = np.frombuffer(self.joined, np.uint8)
        self.ends = np.nonzero(chars == 32)[0]
        self.starts = np.append(0, self.ends[:-1] + 1) if texts else self.ends
        # Where windows begin among all words, and in which text.
        n = np.maximum(self.lens - WINDOW + 1, 0)
        self.of = np.repeat(np.arange(len(texts)), n)
        self.at = np.repeat(np.cumsum(self.lens) - self.lens - np.cumsum(n) + n, n) + np.arange(len(self.of))

    def hashes(self) -> np.ndarray:
        """64-bit, of the words: multilinear in their bytes, then mixed."""
        chars = np.frombuffer(self.joined, np.uint8)
        sizes = self.ends - self.starts + 1
        place = np.arange(len(chars), dtype=np.int32 if len(chars) < 1 << 31 else np.int64) - np.repeat(self.starts, sizes).astype(np.int32 if len(chars) < 1 << 31 else np.int64)
        factors = _factors(int(sizes.max(initial=0)))
        out = np.add.reduceat((chars + np.uint64(1)) * factors[place], self.starts) if len(sizes) else np.empty(0, np.uint64)
        return mixed(out, 1)

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist())]

    def minimizers(self) -> np.ndarray:
        """For each window its minimizer, a signed long."""
        out = mixed(self.hashes(), PHRASE)
        wide, have = WINDOW - PHRASE + 1, 1
        while have < wide and len(out):  # the least of twice as many, and at last of just as many as needed
            step = min(have, wide - have)
            out = np.minimum(out[: len(out) - step], out[step:])
            have += step
        return out.view(np.int64)[self.at]


def _long(texts: list[str]) -> list[tuple[int, bytes]]:
    """Number and words, joined by single spaces, of the texts that have a window."""
    normal = ((i, b" ".join(t.encode().split())) for i, t in enumerate(texts))
    return [(i, t) for i, t in normal if t.count(b" ") >= WINDOW - 1]


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _recurring(docs: DataFrame, chunk: int, hot: int) -> DataFrame:
    """(shard, m): the minimizers of each shard that recur; shard null: m is hot."""
    sent_schema = pa.schema([("m", pa.int64()), ("shard", pa.int64()), ("n", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(ms: list[np.ndarray], shards: list[np.ndarray]) -> pa.RecordBatch:
            m, shard = np.concatenate(ms), np.concatenate(shards)
            order = np.argsort(m)
            m, shard = m[order], shard[order]
            first = np.ones(len(m), bool)
            first[1:] = m[1:] != m[:-1]
            starts = np.nonzero(first)[0]
            n = np.diff(np.append(starts, len(m)))
            within = np.repeat(n, n) > 1  # a second document has it here already
            within[1:] &= first[1:] | (shard[1:] != shard[:-1])
            # A row for each minimizer with its count; and those known to recur here, for their shards, with count 0.
            return _batch((np.append(m[starts], m[within]), np.append(shard[starts], shard[within]), np.append(n, np.zeros(within.sum(), np.int64))), sent_schema)

        ms: list[np.ndarray] = []
        shards: list[np.ndarray] = []
        held = 0
        for batch in small_batches(batches, 1, 1 << 20):
            some = _long(arrow_texts(batch, 1))
            if not some:
                continue
            words = Words([t for _, t in some])
            m, of = words.minimizers(), words.of
            new = np.ones(len(m), bool)  # neighbours share theirs; what a document repeats later may count twice: it is a candidate then
            new[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
            ms.append(m[new])
            shards.append(batch.column(0).to_numpy(zero_copy_only=False)[np.array([i for i, _ in some])[of[new]]])
            held += int(new.sum())
            if held >= chunk:
                yield sent(ms, shards)
                ms, shards, held = [], [], 0
        if held:
            yield sent(ms, shards)

    rows = docs.select("shard", "text").mapInArrow(gather, "m long, shard long, n long")
    # Rows that are settled may go anywhere; the others meet by their minimizer.
    met = rows.repartition(F.when(F.col("n") > 0, F.col("m")).otherwise(F.xxhash64("shard"))).sortWithinPartitions("m")
    schema = pa.schema([("shard", pa.int64()), ("m", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last minimizer: its documents so far, and its only row while there is one.
        last, seen, alone = None, 0, None
        for batch in batches:
            m, shard, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            settled = n == 0
            out = [(shard[settled], m[settled])]
            m, shard, n = m[~settled], shard[~settled], n[~settled]
            if len(m):
                starts = np.nonzero(np.append(True, m[1:] != m[:-1]))[0]
                size = np.diff(np.append(starts, len(m)))
                total = np.add.reduceat(n, starts)
                before = np.zeros(len(starts), np.int64)
                if m[0] == last:
                    before[0] = seen
                    if alone is not None:
                        out.append(([alone], [last]))
                now = total + before
                tell = (np.repeat(now, size) > 1) & (n == 1)
                out.append((shard[tell], m[tell]))
                crowded = m[starts][(now > hot) & (before <= hot)]
                last, seen = m[-1], int(now[-1])
                alone = shard[-1] if seen == 1 else None
                yield _batch(([None] * len(crowded), crowded), schema)
            yield _batch([np.concatenate([np.asarray(o[i], np.int64) for o in out]) for i in (0, 1)], schema)

    return met.mapInArrow(confirm, "shard long, m long")


def _holders(docs: pa.Table) -> dict[str, tuple[int, int]]:
    """The distinct texts, each with the smallest and the largest doc_id that hold it."""
    out: dict[str, tuple[int, int]] = {}
    for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        least, most = out.get(text, (doc, doc))
        out[text] = (min(least, doc), max(most, doc))
    return out


_STRETCH = pa.schema([("hot", pa.bool_()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("shard", pa.int64()), ("words", pa.binary())])


def _stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hot, key, lo, hi, shard, words): distinct stretches of a shard whose windows have a recurring minimizer, with
    the smallest and largest doc_id that hold them; of hot minimizers each window, keyed by itself."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[tuple[bool, int, bytes], list[int]] = {}
        if left.num_rows and right.num_rows:
            shard = key[0].as_py()
            texts = _holders(left)
            some, held_by = _long(list(texts)), list(texts.values())
            ids = [held_by[i] for i, _ in some]
            words = Words([t for _, t in some])
            at, of = words.at, words.of
            m, hot = right.column("m").to_numpy(), right.column("hot").to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(m)
            m, hot = m[order], hot[order]
            own = words.minimizers()
            place = np.minimum(np.searchsorted(m, own), len(m) - 1)
            found = m[place] == own
            cold, crowded = found & ~hot[place], found & hot[place]
            # A stretch ends where the next window is another text's or has another minimizer.
            cut = np.append((own[1:] != own[:-1]) | (of[1:] != of[:-1]), True)
            first = np.nonzero(cold & np.append(True, cut[:-1]))[0]
            lone = np.nonzero(crowded)[0]
            last = at[np.append(np.nonzero(cold & cut)[0], lone)] + WINDOW - 1
            first = np.append(first, lone)
            hots = crowded[first].tolist()
            for is_hot, k, o, text in zip(hots, np.where(crowded, 0, own)[first].tolist(), of[first].tolist(), words.texts(at[first], last)):
                least, most = ids[o]
                known = rows.setdefault((is_hot, k, text), [least, most])
                if least < known[0]:
                    known[0] = least
                if most > known[1]:
                    known[1] = most
        if not rows:
            return _STRETCH.empty_table()
        hots, keys, held = zip(*rows)
        lo, hi = zip(*rows.values())
        keys = [xxhash.xxh3_64_intdigest(t) - (1 << 63) if h else k for h, k, t in zip(hots, keys, held)]
        return pa.table([pa.array(c, f.type) for c, f in zip((hots, keys, lo, hi, [shard] * len(lo), held), _STRETCH)], schema=_STRETCH)

    schema = "hot boolean, key long, lo long, hi long, shard long, words binary"
    return docs.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(run, schema)


_PASSAGE = pa.schema([("shard", pa.int64()), ("owner", pa.int64()), ("words", pa.binary())])


def _confirmed(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, shard: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Passages of the stretches of whole keys: windows that a smaller doc_id has too, neighbours with one owner put together."""
    words = Words(texts)
    at, of = words.at, words.of
    h = mixed(words.hashes(), WINDOW)[at]
    order = np.lexsort((h, key[of]))
    h, by_key, row = h[order], key[of][order], of[order]
    starts = np.nonzero(np.append(True, (h[1:] != h[:-1]) | (by_key[1:] != by_key[:-1])))[0]
    owner = np.empty(len(at), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(lo[row], starts), np.diff(np.append(starts, len(row))))
    needed = owner < hi[of]
    joined = needed[1:] & needed[:-1] & (of[1:] == of[:-1]) & (owner[1:] == owner[:-1])
    first = np.nonzero(needed & np.append(True, ~joined))[0]
    last = np.nonzero(needed & np.append(~joined, True))[0]
    return _batch((shard[of[first]], owner[first], words.texts(at[first], at[last] + WINDOW - 1)), _PASSAGE)


def _passages(stretches: DataFrame) -> DataFrame:
    """(shard, owner, words): recurring passages, for each shard where a later document has them."""
    ordered = stretches.repartition("key").sortWithinPartitions("hot", "key", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        size = 0
        last, owners = None, {}  # of the last hot key: its windows with their owners, which come first

        def settled(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, texts, size
            if not texts:
                return
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = len(texts) if whole else int(np.searchsorted(columns[0], columns[0][-1], side="left"))
            if cut:
                yield _confirmed(*(c[:cut] for c in columns), texts[:cut])
                held, texts = [tuple(c[cut:].copy() for c in columns)], texts[cut:]
            size = sum(map(len, texts))

        for batch in batches:
            n_cold = batch.num_rows - (batch.column(0).true_count or 0)
            cold, crowded = batch.slice(0, n_cold), batch.slice(n_cold)
            if n_cold:
                held.append(tuple(cold.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)))
                own = cold.column(5).to_pylist()
                texts += own
                size += sum(map(len, own))
                if size >= CONFIRM_BYTES:
                    yield from settled(False)
            if crowded.num_rows:
                out = []
                for key, lo, hi, shard, words in zip(*(crowded.column(i).to_pylist() for i in range(1, 6))):
                    if key != last:
                        last, owners = key, {}
                    owner = owners.setdefault(words, lo)
                    if hi > owner:
                        out.append((shard, owner, words))
                yield _batch(list(zip(*out)) or [()] * 3, _PASSAGE)
        yield from settled(True)

    return ordered.mapInArrow(run, "shard long, owner long, words binary")


def _automata(passages: dict[bytes, int], number: defaultdict[bytes, int]):
    """Automata over word numbers, each of a bounded number of words; they give a passage's owner and its length."""
    import ahocorasick

    parts: list[list[tuple[tuple[int, ...], int]]] = [[]]
    held = 0
    for passage, owner in passages.items():
        ids = tuple(map(number.__getitem__, passage.split(b" ")))
        if held + len(ids) > AUTOMATON_WORDS and parts[-1]:
            parts.append([])
            held = 0
        parts[-1].append((ids, owner))
        held += len(ids)
    while parts:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, owner in parts.pop():
            automaton.add_word(ids, (owner, len(ids)))
        automaton.make_automaton()
        yield automaton


def _located(texts: list[list[bytes]], passages: dict[bytes, int]) -> list[list[tuple[int, int, int]]]:
    """For each text (first, last, owner) of every occurrence of a passage."""
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    streams = None
    for automaton in _automata(passages, number):  # the first comes when all words have their numbers
        if streams is None:
            streams = [tuple(map(number.get, words, repeat(0))) for words in texts]
        for found, stream in zip(out, streams):
            if len(stream) >= WINDOW:
                found += [(at - n + 1, at, owner) for at, (owner, n) in automaton.iter(stream)]
    return out


def _cut(words: list[bytes], found: list[tuple[int, int, int]], below: int) -> tuple[int, str]:
    """How many words lie in passages of owners below this one, and the others, joined."""
    marks = np.zeros(len(words) + 1, np.int64)
    for first, last, owner in found:
        if owner < below:
            marks[first] += 1
            marks[last + 1] -= 1
    left = np.nonzero(np.cumsum(marks[:-1]) == 0)[0].tolist()
    return len(words) - len(left), b" ".join([words[i] for i in left] if len(left) < len(words) else words).decode()


def remove_repeats(docs: DataFrame, hot: int = HOT, chunk: int = CHUNK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text")).withColumn("copy", F.xxhash64("text"))
    groups = base.groupBy("copy").agg(F.sum(F.octet_length("text")).alias("n"))
    shards = max(1, -(-(groups.agg(F.sum("n").alias("n")).first()["n"] or 0) // shard_bytes))
    # Copies share a shard, and those that fill more than one are dealt to as many as they fill.
    large = written(groups.where(F.col("n") > shard_bytes).select("copy", F.ceil(F.col("n") / shard_bytes).alias("spread")))
    spread = F.pmod(F.xxhash64("doc_id"), F.coalesce("spread", F.lit(1)))
    dealt = base.join(small_side(large, BROADCAST_KEYS), "copy", "left").select("doc_id", "text", F.pmod(F.xxhash64("copy", spread), F.lit(shards)).cast("long").alias("shard"))
    found = written(_recurring(dealt, chunk, hot))
    crowded = written(found.where("shard is null").select("m").distinct()).withColumn("hot", F.lit(True))
    wanted = found.where("shard is not null").distinct().join(small_side(crowded, BROADCAST_KEYS), "m", "left").select("shard", "m", F.coalesce("hot", F.lit(False)).alias("hot"))
    by_shard = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    passages = _passages(_stretches(by_shard, wanted))

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _holders(left)
        words = [t.encode().split() for t in texts]
        found = _located(words, dict(zip(right.column("words").to_pylist(), right.column("owner").to_pylist())))
        # A text's every window is owned by its first holder or one before: so all later holders lose the same.
        first = {t: (len(w), *_cut(w, f, least)) for (t, (least, _)), w, f in zip(texts.items(), words, found)}
        later = {t: (len(w), *_cut(w, f, NO_ID)) for (t, (least, most)), w, f in zip(texts.items(), words, found) if most > least}
        out = []
        for doc, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist()):
            own = first if doc == texts[text][0] else later
            out.append((None if doc == NO_ID else doc, *own[text]))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return by_shard.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(locate, "doc_id long, n_words long, n_removed long, kept string")


def repeats_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def sha256_of(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
