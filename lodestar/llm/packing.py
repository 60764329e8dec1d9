"""Sequence packing by best-fit decreasing.

Documents are tokenised, documents longer than a window are first cut into full
windows, and what is left of each is put into the open window with the least
room that still holds it. A segment tree indexed by remaining capacity finds
that window.

At scale: pieces are dealt by a hash to buckets of about ``bucket_docs``
documents, each bucket is sorted by Spark (which spills) and packed as a stream,
so that a task holds the open windows of one bucket only, and never a text or
token. The shuffle moves a few dozen bytes a piece.

Defined cases: a null or empty text is the end id alone (one token); a null
doc_id is kept as null; repeated rows are packed as often as they occur; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import small_batches, text_or_empty

WINDOW = 2048
END_ID = 1
#: Entries of a generation of a worker's word cache, about 160 bytes each; fewer take less memory and more time.
CACHE_WORDS = 300_000
#: Documents to a bucket.
BUCKET_DOCS = 4096

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Recent(dict):
    """Values by key, made where missing. The last ``most`` keys and up to as many before them are held; keys of over 64 characters never."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > 64:
            return self.make(key)
        known = self.older.get(key)
        if known is None:
            known = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = known
        return known


def gathered(pool: np.ndarray, size: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked runs of a pool (runs lie behind each other, ``size`` long) in one array, and where each begins, with the end behind."""
    first, own = np.cumsum(size) - size, size[picks]
    ends = np.zeros(len(own) + 1, np.int64)
    np.cumsum(own, out=ends[1:])
    return pool[np.repeat(first[picks] - ends[:-1], own) + np.arange(ends[-1])], ends


class WordTokenizer:
    """Ids of whole texts, exactly as the tokenizer file gives them.

    A file whose chain cuts at white space before anything else that depends on
    neighbours gives a text the ids of its chunks between spaces and newlines, joined. The
    distinct chunks of a batch are looked up once, plain Latin letters apart from the plain
    punctuation behind them, in a cache of the worker; the texts' ids are then gathered.
    Letters go straight to the model, all else through the whole chain. Any other file
    gets each text whole.
    """

    _PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?*$%&#|()]*)$"
    _LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Recent(self._ids, cache_words)
        self.by_chunk = self._cuts_at_spaces()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _cuts_at_spaces(self) -> bool:
        """Whether this file's chain is lower case, split by kind, byte level: only then are chunks and letters alone exact."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        )

    def _ids(self, chunk: str) -> bytes:
        if self._LETTERS.fullmatch(chunk):
            shown = chunk.encode().decode("latin-1").translate(self.alphabet)
            return np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts (null: empty) behind each other, and where each text's begin, with the end behind."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], dtype="<u4"), np.cumsum([0, *map(len, each)])
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = chunks.flatten().dictionary_encode()
        plain = pc.extract_regex(words.dictionary, self._PLAIN)
        heads = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "letters")), words.dictionary).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(plain, "marks"), "").dictionary_encode()
        known = [self.known[k] for part in (heads, tails) for k in part.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        parts = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], axis=1).ravel()
        pool, ends = gathered(np.frombuffer(b"".join(known), dtype="<u4"), size, parts)
        ids, ends = gathered(pool, np.diff(ends[::2]), words.indices.to_numpy())
        places = chunks.offsets.to_numpy()
        return ids, ends[places - places[0]]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


_OPEN: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_at(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    """One tokenizer a worker process."""
    if (path, cache_words) not in _OPEN:
        _OPEN[path, cache_words] = WordTokenizer(path, cache_words)
    return _OPEN[path, cache_words]


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Every document cut into full windows and a rest, with a checksum of each piece's ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_at(tokenizer_path, cache_words), np.array([end_id], dtype="<u4").tobytes()
        for batch in small_batches(batches, 1):
            out: list[tuple] = []
            ids, ends = tokenizer.batch(batch.column(1))
            for doc_id, first, last in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:]):
                view = ids[first:last].tobytes() + end
                n = len(view) // 4
                out += [(doc_id, a, min(window, n - a), zlib.crc32(view[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, PIECES)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over 0..window whose nodes say whether a window below is open."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        node, count = self.base + capacity, self.count
        while node:
            count[node] += 1
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the open window with the least capacity that is at least length."""
        count, node = self.count, self.base + length
        while not count[node]:
            while node & 1:  # a right child: what is larger lies to the right of its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.base
        sequence = self.stacks[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, sequence


def best_fit(lengths, window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) for lengths that come in falling order."""
    packer = BestFit(window)
    return [packer.put(n) for n in lengths]


class BestFit:
    def __init__(self, window: int):
        self.window, self.open, self.used = window, OpenWindows(window), 0

    def put(self, length: int) -> tuple[int, int]:
        found = self.open.tightest(length) if length < self.window else None
        if found is None:
            capacity, sequence = self.window, self.used
            self.used += 1
        else:
            capacity, sequence = found
        if capacity > length:
            self.open.add(capacity - length, sequence)
        return sequence, self.window - capacity


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, bucket_docs: int = BUCKET_DOCS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Place all pieces into sequences of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``assemble`` builds the sequences themselves.
    """
    buckets = max(1, -(-docs.count() // bucket_docs))
    dealt = pieces(docs, tokenizer_path, window, end_id, cache_words).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids_crc32"), F.lit(buckets)))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", F.desc("length"), "doc_id", "start", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, packer = None, BestFit(window)
        for batch in batches:
            sequences, offsets = [], []
            for b, n in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist()):
                if b != bucket:
                    bucket, packer = b, BestFit(window)
                sequence, offset = packer.put(n)
                sequences.append((b << 32) + sequence)
                offsets.append(offset)
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[c.split()[0] for c in PLACED.split(", ")])

    return ordered.mapInArrow(place, PLACED)


def assemble(docs: DataFrame, placed: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """The sequences: sequence_id, n_tokens, ids (padded to the window, except at a power of two).

    Needs distinct, non-null doc_ids. Each piece is checked against its ids_crc32.
    """
    where = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "ids_crc32", "sequence_id", "offset")).alias("placed"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(where, "doc_id")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        for batch in small_batches(batches, 1):
            out = []
            every, ends = tokenizer.batch(batch.column(1))
            for first, last, places in zip(ends[:-1], ends[1:], batch.column(2).to_pylist()):
                ids = np.append(every[first:last], np.uint32(end_id))
                for p in places:
                    own = ids[p["start"] : p["start"] + p["length"]]
                    if zlib.crc32(own.tobytes()) != p["ids_crc32"]:
                        raise ValueError("a document's tokens changed since it was packed")
                    out.append((p["sequence_id"], p["offset"], own.astype(np.int32).tolist()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    parts = rows.mapInArrow(slices, "sequence_id long, offset long, ids array<int>")
    joined = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    whole = (n.bitwiseAND(n - 1) == 0) & (n <= window)
    padded = F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n)))
    return joined.select("sequence_id", n.cast("long").alias("n_tokens"), padded.alias("ids"))
