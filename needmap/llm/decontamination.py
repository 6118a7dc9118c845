"""Benchmark decontamination by SimHash over item-sized windows; built-in functions only.

A benchmark item of n words is looked for in all windows of n words of a document (a shorter document is one window). Windows
and items get a 64-bit SimHash of their five-word shingles, each counted as often as it stands there. Fingerprints are cut into 20
blocks: two that differ in at most 19 bits agree in one block at least, so the join on blocks finds every pair within that radius,
which a pair of similarity 0.8 exceeds once in some thousand times, a pair that is nearly the same never. Pairs within the radius
are verified by their exact weighted shingle similarity, the sum of the lesser counts over the sum of the greater.

A window that shares no shingle with any item of its size has similarity 0. Only windows around a shared shingle are therefore
fingerprinted; the others could not pass the verification. Items are the small side of the joins; Spark broadcasts them as long as
their size is within its threshold.

Defined cases: words are split at ASCII white space and put in lower case; an item of fewer than five words is one shingle. NULL and
empty texts and items match nothing. Repeated items count once each. Rows of the same ``doc_id`` and text are one document; rows
without ``doc_id`` are matched too, and reported with a NULL id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, fresh, text_of

WIDTH = 5
#: Offsets and sizes of the 20 blocks of a fingerprint: 16 of three bits, 4 of four.
BLOCKS = [(3 * k, 3) for k in range(16)] + [(48 + 4 * k, 4) for k in range(4)]
RADIUS = len(BLOCKS) - 1
_LAST = (1 << 63) - 1
_LANES = 0x0001000100010001


def words(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle(of: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(of, at + j if j else at) for j in range(width)))


def shingles(of: Column, n: Column) -> Column:
    """The shingles of an array of word hashes of ``n`` > 0 words."""
    out = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: shingle(of, i, WIDTH))
    chain = F.when(n >= WIDTH, out)
    for width in range(1, WIDTH):
        chain = chain.when(n == width, F.array(shingle(of, F.lit(0), width)))
    return chain


def with_fingerprint(df: DataFrame, own: str, out: str) -> DataFrame:
    """Adds the SimHash of an array of shingles: bit b is set if more than half of the shingles have it.

    Sixteen sums count four bits each, in lanes of 16 bits of one number.
    """
    (sums,) = fresh(df, "lane_sums")
    shifted = lambda value, by: F.call_function("shiftrightunsigned", value, by)
    zero = F.lit(0).cast("long")
    counted = lambda k: F.aggregate(own, zero, lambda a, h: a + shifted(h, k).bitwiseAND(_LANES))
    # Behind a one-row generator: in a projection the sums would be put into the loop over the bits, and made again for each.
    summed = df.select("*", F.inline(F.array(F.struct(F.transform(F.sequence(F.lit(0), F.lit(15)), counted).alias(sums)))))
    count = lambda b: shifted(F.get(sums, b % 16), b - b % 16).bitwiseAND(0xFFFF)
    bit = lambda b: F.when(count(b) * 2 > F.size(own), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero)
    return summed.withColumn(out, F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda a, b: a.bitwiseOR(bit(b))), zero)).drop(sums)


def with_blocks(df: DataFrame, fingerprint: str) -> DataFrame:
    """One row for each block: its number and its bits."""
    values = F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, at).bitwiseAND((1 << size) - 1).alias("bits")) for k, (at, size) in enumerate(BLOCKS)))
    return df.select("*", F.inline(values))


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, n, own, print): size, shingles and fingerprint of each item with a word."""
    read = benchmark.select(F.col(f"`{item}`").alias("item_id"), words(text_of(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    return with_fingerprint(read.select("item_id", "n", shingles(F.col("w"), F.col("n")).alias("own")), "own", "print").distinct()


def similarity(left: str, right: str) -> Column:
    """Sum of the lesser counts of all shingles over the sum of the greater."""
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    lesser = F.aggregate(F.array_distinct(left), F.lit(0), lambda a, x: a + F.least(count(left, x), count(right, x)))
    return F.transform(F.array(lesser), lambda v: v / (F.size(left) + F.size(right) - v))[0]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc, part, item_id, similarity, start, n): each document and item with a window of at least ``threshold``.

    Of several such windows the most similar one is named, the first of these if they tie; ``start`` counts words from 0. ``doc`` is
    the id (the greatest number for a NULL id), ``part`` a hash of the text.
    """
    items = items_of(benchmark, item, item_text)
    read = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_of(text)).alias("part"), text_of(text).alias("text"))
    hashed = read.select("doc", "part", words(F.col("text")).alias("w"))
    # Positions of shared shingles. Items of five words and more have shingles of five; shorter ones are few, if any.
    hits = None
    for width in sorted(r[0] for r in items.select(F.least("n", F.lit(WIDTH))).distinct().collect()):
        known = items.where(F.least("n", F.lit(WIDTH)) == width).select("n", F.explode("own").alias("h")).distinct()
        # Outer explodes: a filter for a plain one would hash the words a second time.
        positions = F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width))
        at = hashed.select("doc", "part", "w", F.explode_outer(positions).alias("p")).where("p IS NOT NULL")
        found = at.select("doc", "part", "p", shingle(F.col("w"), F.col("p"), width).alias("h")).join(known, "h").select("doc", "part", "p", "n")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = hashed.select("doc", "part", F.lit(0).alias("p"), F.lit(0).alias("n")).where(F.lit(False))
    near = hits.groupBy("doc", "part").agg(F.collect_set(F.struct("n", "p")).alias("hits"))
    # Repeated rows give repeated windows, which the last grouping joins again.
    placed = read.join(near, ["doc", "part"]).select("doc", "part", "hits", words(F.col("text")).alias("w"))
    last = lambda n: F.greatest(F.size("w") - n, F.lit(0))
    starts = lambda x: F.transform(
        F.sequence(F.least(F.greatest(x["p"] - x["n"] + 1, F.lit(0)), last(x["n"])), F.least(x["p"], last(x["n"]))), lambda s: F.struct(x["n"].alias("n"), s.alias("start"))
    )
    window = placed.select("doc", "part", "w", F.explode_outer(F.array_distinct(F.flatten(F.transform("hits", starts)))).alias("at")).where("at IS NOT NULL")
    sliced = window.select("doc", "part", F.col("at.n").alias("n"), F.col("at.start").alias("start"), F.slice("w", F.col("at.start") + 1, F.col("at.n")).alias("part_w"))
    sliced = sliced.select("doc", "part", "n", "start", shingles(F.col("part_w"), F.size("part_w")).alias("seen"))
    printed = with_blocks(with_fingerprint(sliced, "seen", "seen_print"), "seen_print")
    pairs = printed.join(with_blocks(items, "print"), ["n", "block", "bits"])
    differ = F.col("seen_print").bitwiseXOR(F.col("print"))
    agreeing = F.when(F.lit(False), -1)
    for k, (at, size) in enumerate(BLOCKS):
        agreeing = agreeing.when(F.shiftrightunsigned(differ, at).bitwiseAND((1 << size) - 1) == 0, k)
    # A pair meets in every block on which it agrees; it is taken up in the first of these.
    candidates = pairs.where((F.bit_count(differ) <= RADIUS) & (agreeing == F.col("block")))
    sure = candidates.select("doc", "part", "item_id", "n", "start", similarity("seen", "own").alias("similarity")).where(F.col("similarity") >= threshold)
    best = sure.groupBy("doc", "part", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    return best.select("doc", "part", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), "best.n")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that match no item."""
    doc, part = fresh(docs, "doc_of_row", "part_of_row")
    found = matches(docs, benchmark, text, key, threshold=threshold).select(F.col("doc").alias(doc), F.col("part").alias(part)).distinct()
    keyed = docs.withColumns({doc: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)), part: F.xxhash64(text_of(text))})
    return keyed.join(found, [doc, part], "left_anti").select(*(f"`{c}`" for c in docs.columns))
