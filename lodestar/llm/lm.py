"""Likelihood of texts under a subword lattice.

The pieces of an existing subword vocabulary span a lattice over each word (with
the word mark before it). A piece's probability is interpolated: ``VOCABULARY_SHARE``
of it comes from the vocabulary's own score (a rank in the files at hand, read as
Zipf's law: the reciprocal of the rank), the rest from how often the piece occurs in
the training words, cut by the vocabulary. A word's probability is the sum over all its
segmentations, by forward recursion in log space; a text's is the product over its
words and its end.

At scale: each split of the input sends every distinct word once with its count there
(words, not occurrences, are shuffled); at its word, counts meet, the lattice is
evaluated, and count and log probability go back to the splits that asked, by a join. A
split sends a word once, so a common word has one row a split, which is a small part
of a split's rows: no key is hot. What the driver sees is one count for each piece of
the vocabulary, whose size is fixed. Splits join their words with their own documents
in memory-sized groups, each in a partition of its own up to ``PLACED`` groups.

Defined cases: a null or empty text is its end token; a null doc_id
counts as the text '' (crc32 0, so held out); words without a piece for a character
fall back to byte pieces; repeated rows count as often as they occur; an empty
table gives an empty table; further columns are ignored. The input is written first
unless it is said to be a table scan, whose partitions read alike twice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import small_batches, text_or_empty, written

ADD = 0.1
#: Of a piece's probability, the share that its score in the vocabulary gives.
VOCABULARY_SHARE = 0.25
#: Groups up to which each has a partition of its own; more are dealt evenly enough by a hash.
PLACED = 10_000
#: Documents of one split are scored in groups of at most about this many bytes of input.
GROUP_BYTES = 32 << 20
#: Words whose lattices one task evaluates.
WORDS_A_TASK = 100_000
MARK = "▁"


class Vocabulary:
    """Pieces with their ranks, from a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        ids = range(self.size)
        self.bytes = {int(self.model.id_to_piece(i)[3:5], 16): i for i in ids if self.model.is_byte(i)}
        self.pieces = {self.model.id_to_piece(i): i for i in ids if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))}
        self.longest = max(map(len, self.pieces))
        self.end = self.model.eos_id()

    def prior(self) -> np.ndarray:
        """Probabilities by the existing scores: the reciprocal of the rank, which is the negated score."""
        ranks = np.array([max(1.0, -self.model.get_score(i)) if not self.model.is_byte(i) else float(self.size) for i in range(self.size)])
        return (1 / ranks) / (1 / ranks).sum()


def piece_probabilities(vocabulary: Vocabulary, counts: np.ndarray, share: float = VOCABULARY_SHARE) -> np.ndarray:
    """The vocabulary's scores and the training counts of its pieces, interpolated; without counts the scores alone."""
    total = counts.sum()
    return share * vocabulary.prior() + (1 - share) * counts / total if total else vocabulary.prior()


_OPEN: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


class Lattice:
    """The marginal log10 probability of a word over all segmentations."""

    def __init__(self, vocabulary: Vocabulary, probabilities: np.ndarray):
        self.longest = vocabulary.longest
        logs = np.log(probabilities).tolist()
        self.log_p = {piece: logs[i] for piece, i in vocabulary.pieces.items()}
        self.log_byte = {b: logs[i] for b, i in vocabulary.bytes.items()}
        #: Where a byte has no piece.
        self.log_none = math.log(1e-9)

    def log10(self, word: str) -> float:
        """Forward recursion in log space: what reaches a place is summed as exponentials relative to the largest."""
        text, known, exp, log = MARK + word, self.log_p.get, math.exp, math.log
        n, longest = len(text), self.longest
        reached: list[list[float]] = [[] for _ in range(n + 1)]
        reached[0] = [0.0]
        for i in range(n):
            terms = reached[i]
            reached[i] = []
            here = terms[0]
            if len(terms) > 1:
                here = max(terms)
                here += log(sum([exp(t - here) for t in terms]))
            found = known(text[i])
            if found is None:
                found = sum(self.log_byte.get(b, self.log_none) for b in text[i].encode("utf-8", "surrogatepass"))
            reached[i + 1].append(here + found)
            for j in range(i + 2, min(n, i + longest) + 1):
                q = known(text[i:j])
                if q is not None:
                    reached[j].append(here + q)
        top = max(reached[n])
        return (top + log(sum([exp(t - top) for t in reached[n]]))) / math.log(10)


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def held_out(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 10, is 0."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def _split_words(docs: DataFrame) -> DataFrame:
    """(word, batch, n): each split's distinct words with their count in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        seen: dict[int, set] = {}
        for batch in small_batches(batches, 2):
            for group, out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = tokens(text)
                if out:
                    seen.setdefault(group, set()).update(words)
                else:
                    counts.setdefault(group, Counter()).update(words)
        for group in {*counts, *seen}:
            own = counts.get(group, Counter())
            words = [*own, *(seen.get(group, set()) - own.keys())]
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([group] * len(part), pa.int64()), pa.array([own.get(w, 0) for w in part], pa.int64())], names=["word", "batch", "n"])

    return docs.select("batch", "out", "text").mapInArrow(run, "word binary, batch long, n long")


def _piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(piece, n) over the training words, by the vocabulary's own segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(path)
        total = np.zeros(vocabulary.size)
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            cut = vocabulary.model.encode(words, num_threads=1)
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            flat = np.fromiter((i for ids in cut for i in ids), np.int64, int(sizes.sum()))
            total += np.bincount(flat, weights=np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes).astype(float), minlength=vocabulary.size)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["piece", "n"])

    return words.select("word", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _bytes_of(setting: str) -> int:
    """A size as Spark writes it: digits, and a unit that may be missing."""
    number = setting.strip().lower().rstrip("b")
    return int(number[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[number[-1]] if number[-1:] in "kmgt" else int(number)


def _placed(rows: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both tables with batch renamed so that a hash puts each into a partition of its own, and how many partitions."""
    spark = rows.sparkSession
    top = (rows.agg(F.max("batch").alias("n")).first()["n"] or 0) + 1
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), top)
    if top > PLACED:
        return rows, back, width
    numbers = spark.range(32 * width).select("id", F.pmod(F.hash("id"), F.lit(width)).cast("long").alias("batch"))
    place = written(numbers.groupBy("batch").agg(F.min("id").alias("id")).where(F.col("batch") < top))  # a row a group: at most PLACED
    renamed = lambda df: df.join(F.broadcast(place), "batch", "left").withColumn("batch", F.coalesce("id", F.lit(-1) - F.col("batch"))).drop("id")
    return renamed(rows), renamed(back), width


def score_documents(docs: DataFrame, vocabulary_path: str, scan: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. ``scan``: docs is a table as it is read."""
    spark = docs.sparkSession
    if not scan:
        docs = written(docs.select("doc_id", "text"))
    groups = max(1, -(-_bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")) // GROUP_BYTES))
    batch = F.spark_partition_id().cast("long") * groups + F.pmod(F.xxhash64("doc_id"), F.lit(groups))
    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", held_out().alias("out"), batch.alias("batch"))
    seen = written(_split_words(rows))
    words = written(seen.groupBy("word").agg(F.sum("n").alias("c")))
    trained = words.where("c > 0")
    facts = trained.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = docs.select(held_out().alias("out")).where(~F.col("out")).count()
    n, v = (facts["n"] or 0) + ends, facts["v"] + bool(ends)
    vocabulary = vocabulary_at(vocabulary_path)
    counts = np.zeros(vocabulary.size)
    for piece, count in _piece_counts(trained, vocabulary_path).toLocalIterator():  # one row a piece of the vocabulary at most
        counts[piece] += count
    counts[vocabulary.end] += ends
    probabilities = piece_probabilities(vocabulary, counts)
    log_end = math.log10(probabilities[vocabulary.end])
    shared = spark.sparkContext.broadcast(probabilities)  # of the vocabulary's fixed size
    below = math.log10(n + ADD * (v + 1)) if n + v else math.log10(ADD)
    end_base = math.log10(ends + ADD) - below

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary_at(vocabulary_path), shared.value)
        for batch in batches:
            own = [lattice.log10(w.decode()) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], names=["word", "c", "score"])

    tasks = max(1, -(-words.count() // WORDS_A_TASK))
    known = words.repartition(tasks, "word").mapInArrow(evaluate, "word binary, c long, score double")
    back = seen.select("word", "batch").join(known, "word")
    rows, back, width = _placed(rows, back)

    def score(key, left, right):
        counts = right.column("c").to_numpy().astype(float)
        base = dict(zip(words := right.column("word").to_pylist(), (np.log10(counts + ADD) - below).tolist()))
        own = dict(zip(words, right.column("score").to_pylist()))
        unknown = {w for w, c in zip(words, counts) if not c}
        out = []
        for doc_id, text, is_out in zip(*(left.column(x).to_pylist() for x in ("doc_id", "text", "out"))):
            t = tokens(text)
            strange = sum(map(unknown.__contains__, t)) if is_out else 0
            out.append((doc_id, is_out, len(t) + 1, len(t) + bool(ends) - strange, n, math.fsum(map(base.__getitem__, t)) + end_base, math.fsum(map(own.__getitem__, t)) + log_end))
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.repartition(width, "batch").groupBy("batch").cogroup(back.repartition(width, "batch").groupBy("batch")).applyInArrow(score, schema)
