"""Benchmark decontamination with DataFrame functions only.

For each benchmark item, windows of the item's size are taken from the documents:
every place where a document has one of the item's shingles fixes where such a
window lies (a window that is similar to the item shares shingles with it, and all
alignments that shared shingles propose are taken). Windows and items get a SimHash
fingerprint of their shingles. A multi-index finds all fingerprints within the
radius: 64 bits are cut into four blocks, fingerprints within radius 4r + 3 agree in
some block up to r bits, and the items' blocks are entered with all such variants.
Candidates of the window's size are verified by exact weighted Jaccard similarity of
their shingles, repeats counted.

At scale: one pass over the texts meets the items' shingles, which are broadcast only
up to ``BROADCAST_SHINGLES`` rows (else the join is a shuffle that Spark may split).
Only documents with a shared shingle are read again, and only windows are exploded.
Fingerprints are sums over exploded shingles with partial aggregation; distinct ones
meet the index by (size, block, value), never pair by pair, and the index is broadcast
only up to ``BROADCAST_VARIANTS`` entries.

Defined cases: texts are compared in lower case, words cut at ASCII white space; an
item of fewer than five words is one shingle; null or empty texts match nothing; a
document shorter than an item is one window; a null doc_id is reported as null;
equal rows are reported once; empty tables give an empty table.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, small_side, text_or_empty, wide_row_key, written

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, BLOCK = 64, 4, 16
#: Bits by which a block may differ: the radius is 4 * 4 + 3 = 19.
BLOCK_RADIUS = 4
RADIUS = BLOCKS * BLOCK_RADIUS + BLOCKS - 1
BROADCAST_SHINGLES = 1_000_000
BROADCAST_ROWS = 200_000
#: Entries of the index are broadcast up to so many (about 100 bytes each in memory).
BROADCAST_VARIANTS = 500_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles; all of fewer words are one."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, hashed).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, size, k, shingles. item is a number of the row's own."""
    own = benchmark.select("item_id", words_of(text_or_empty()).alias("words")).where(F.size("words") > 0).distinct()
    sized = own.withColumn("size", F.size("words")).withColumn("k", F.least("size", F.lit(SHINGLE)))
    by_k = reduce(lambda rest, k: F.when(F.col("k") == k, shingles_of(F.col("words"), k)).otherwise(rest), range(SHINGLE - 1, 0, -1), shingles_of(F.col("words"), SHINGLE))
    return written(sized.select(F.xxhash64("item_id", F.array_join("words", " ")).alias("item"), "item_id", "size", "k", by_k.alias("shingles")))


def _fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """A fingerprint for each key, of rows (key, h): bit b is set if it is set in over half."""
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    voted = rows.groupBy(*key).agg(F.count("*").alias("n_h"), *sums)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n_h"), F.lit((1 << b) - ((1 << 64) if b == 63 else 0))).otherwise(F.lit(0)) for b in range(BITS)]
    return voted.select(*key, "n_h", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def _block(fp: Column, number: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK * number).bitwiseAND(F.lit((1 << BLOCK) - 1))


def _index(items: DataFrame, radius: int = BLOCK_RADIUS) -> DataFrame:
    """(size, block, value, item, item_fp): each item's blocks with all variants of at most ``radius`` bits."""
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK) - 1)), lambda m: F.bit_count(m) <= radius)
    blocks = items.select("size", "item", F.col("fp").alias("item_fp"), F.posexplode(F.array(*(_block(F.col("fp"), i) for i in range(BLOCKS)))).alias("block", "own"))
    return blocks.select("size", "block", "item", "item_fp", F.explode(F.transform(masks, lambda m: m.cast("long").bitwiseXOR(F.col("own")))).alias("value"))


def variants_a_block(radius: int = BLOCK_RADIUS) -> int:
    return sum(comb(BLOCK, i) for i in range(radius + 1))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start (word), n_words, similarity: the best window of each document and item from ``similarity`` up."""
    items = _items(benchmark)
    known = items.select("item", "size", "k", F.posexplode("shingles").alias("q", "h"))
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # one to five
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", wide_row_key())
    worded = texts.select("row", words_of(F.col("text")).alias("words"))
    met = None
    for k in ks:
        places = worded.where(F.size("words") >= k).select("row", F.size("words").alias("n"), F.posexplode(shingles_of(F.col("words"), k)).alias("p", "h"))
        own = places.join(known, "h").where(F.col("k") == k)
        starts = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("size")))
        some = own.select("row", "size", "k", starts.alias("start"))
        met = some if met is None else met.union(some)
    if met is None:
        return docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).limit(0)
    windows = written(met.distinct())
    rows = written(windows.select("row").distinct())
    again = texts.join(small_side(rows, BROADCAST_ROWS), "row", "left_semi").select("row", "doc_id", words_of(F.col("text")).alias("words"))
    cut = again.join(small_side(windows, BROADCAST_ROWS), "row").select("row", "doc_id", "size", "k", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    by_k = reduce(lambda rest, k: F.when(F.col("k") == k, shingles_of(F.col("words"), k)).otherwise(rest), [k for k in ks if k != ks[-1]], shingles_of(F.col("words"), ks[-1]))
    key = ["row", "size", "k", "start"]
    # Equal rows give equal places, which count once.
    hashed = written(cut.select("doc_id", *key, F.posexplode(by_k).alias("at", "h")).groupBy(*key, "h").agg(F.size(F.collect_set("at")).cast("long").alias("times"), F.first("doc_id").alias("doc_id")))
    window_fps = written(_fingerprints(hashed.select(*key, F.explode(F.array_repeat("h", F.col("times").cast("int"))).alias("h")), key))
    item_rows = items.select("item", "size", "k", F.explode("shingles").alias("h"))
    item_fps = _fingerprints(item_rows, ["item", "size", "k"])
    # Equal fingerprints, as those of copies, probe once.
    probes = window_fps.select("size", "fp").distinct().select("size", "fp", F.posexplode(F.array(*(_block(F.col("fp"), i) for i in range(BLOCKS)))).alias("block", "value"))
    index = _index(item_fps)
    # Spark's own estimate leaves the variants out; their number is known.
    index = F.broadcast(index) if items.count() * BLOCKS * variants_a_block() <= BROADCAST_VARIANTS else index.hint("merge")
    near = probes.join(index, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = written(near.select("size", "fp", "item").distinct())
    pairs = window_fps.join(small_side(near, BROADCAST_ROWS), ["size", "fp"]).select(*key, "n_h", "item")
    item_counts = item_rows.groupBy("item", "h").agg(F.count("*").alias("item_times"))
    totals = items.select("item", "item_id", F.size("shingles").alias("item_n"))
    shared = pairs.join(hashed, key).join(item_counts, ["item", "h"]).groupBy(*key, "n_h", "item").agg(F.sum(F.least("times", "item_times")).alias("both"), F.first("doc_id").alias("doc_id"))
    scored = shared.join(totals, "item").withColumn("similarity", F.col("both") / (F.col("n_h") + F.col("item_n") - F.col("both")))
    best = scored.where(F.col("similarity") >= similarity).groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("similarity", -F.col("start"), F.col("size"))).alias("top"))
    return best.select("doc_id", "item_id", (-F.col("top")["col2"]).alias("start"), F.col("top")["size"].alias("n_words"), F.round(F.col("top")["similarity"], 6).alias("similarity"))


#: Ids of leaking documents are broadcast up to so many (8 bytes each).
BROADCAST_IDS = 400_000


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows in whose text no item is found; rows are named by ``row_key``, so those without doc_id are judged too."""
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, wide_row_key())
    leaking = written(find_leaks(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, similarity).select(F.col("doc_id").alias(row)).distinct())
    return keyed.join(small_side(leaking, BROADCAST_IDS), row, "left_anti").select(*docs.columns)
