"""Near-duplicate documents by chosen-path set similarity join on word shingles.

A document is the set of its distinct shingles of five words. Documents with the same set are one from the start. Each set is
embedded as minwise tokens: token i is the least value of hash i over the set, so two sets share a token with the probability of
their Jaccard similarity. A tree branches all documents by one of its tokens, then each node that is still large by the next,
down to small nodes; similar documents take the same path with good probability, and independent trees make it near certain. A pair
of similarity s that parts from others at level d is missed by all 16 trees with probability (1 - s**d)**16: at 0.85 once in 4
million for three levels and 0.6 % for all eight, at 0.80 5 % for eight. Each tree has tokens of its own, so the trees are independent.

Last nodes are compared exhaustively, in two rounds so that a group of copies does not become all its pairs. First every member
is compared with the least member of each node that it is in, the least of these first, and another only if that leaves the two apart;
verified links join members into components. Then all pairs of
members of a node that are not yet in one component are compared. Two sketches let through what can reach the threshold: one bit
of each token (five standard deviations of doubt), and the parity of the set's hashes in 1,024 cells. Cells that differ are at most as many as
hashes that only one set has, so for sets of up to some hundred shingles the parities rule out nothing that could link and little else gets by;
for larger ones, where cells fill, the same five deviations hold. A link counts only after an exact comparison of the full sets. A node
that is still large after ``DEPTH`` levels is one of very similar documents; it is compared whole like the small ones, sketch against sketch,
so comparisons (not pairs of texts) grow with the square of what the first round leaves apart in it. Components are found by alternating stars, so neither links nor documents ever meet in one place.

Defined cases: words are runs of other than ASCII white space, A-Z in lower case. A text of fewer than five words is one shingle;
a NULL or empty text, or one of white space, has an empty set and is linked with nothing. Rows of one ``doc_id`` count as one
document. Rows without ``doc_id`` are linked with nothing, have no component, and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget_powers, lower_ascii, mix, shingle_hashes, slices, word_hashes

TREES = 16
#: A node of more members is branched further, up to DEPTH levels.
LEAF, DEPTH = 16, 8
#: Minwise tokens for paths (DEPTH for each tree), and for signatures (one bit each).
TOKENS, BITS = TREES * DEPTH, 256
#: Cells of the parity sketch.
CELLS = 1024
#: Bytes of text that a worker hashes at a time.
SLICE = 2 << 20
_RANDOM = np.random.default_rng(85)
_FACTORS = _RANDOM.integers(1, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.arange(TOKENS).reshape(TREES, DEPTH).tolist()
_WORDS = [f"s{k}" for k in range(BITS // 64)]
_PARITY = [f"p{k}" for k in range(CELLS // 64)]
_SKETCH = [*_WORDS, *_PARITY]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = shingle_hashes(*word_hashes([lower_ascii((t or "").encode()) for t in texts]), width)
    return [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])] if texts else []


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each cell whether it has an odd number of the hashes, 64 cells a number."""
    cells = (mix(hashes ^ np.uint64(0x5A5A5A5A5A5A5A5A)) % np.uint64(CELLS)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=CELLS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def features(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(doc_id, n, a, b, tokens, s0..., p0...): size, two digests, minwise tokens and sketches of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from described(batches)
        finally:
            forget_powers()  # a worker lives on for other stages

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                sets = shingle_sets(part.column(0).to_pylist(), width)
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                some = np.flatnonzero(sizes)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                least, odd = np.zeros((len(sets), BITS), np.uint64), np.zeros((len(sets), len(_PARITY)), np.int64)
                if len(some):
                    flat = np.concatenate([sets[k] for k in some])
                    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                    a[some] = np.add.reduceat(mix(flat), starts)
                    b[some] = np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    for k in range(BITS):
                        least[some, k] = np.minimum.reduceat(flat * _FACTORS[k], starts)
                    for k in some:
                        odd[k] = parities(sets[k])
                tokens = (mix(least[:, :TOKENS]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                bits = (mix(least + np.uint64(77)) & np.uint64(1)).astype(np.uint8)
                words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                offsets = np.arange(0, (len(sets) + 1) * TOKENS, TOKENS, dtype=np.int32)
                columns = [
                    part.column(1), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.ravel())), *(pa.array(x[:, k].copy()) for x in (words, odd) for k in range(x.shape[1])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "a", "b", "tokens", *_SKETCH])

    schema = "doc_id long, n long, a long, b long, tokens array<int>, " + ", ".join(f"{w} long" for w in _SKETCH)
    return df.select(F.col(f"`{text}`"), F.col(f"`{key}`").cast("long").alias("doc_id")).mapInArrow(run, schema)


def leaves(sets: DataFrame) -> DataFrame:
    """(node, rep, leader): the members of all last nodes of all trees; nodes of one member are left out.

    A row carries what is left of its tree's path, so a further level joins nothing but the sizes of nodes.
    """
    first = [F.struct(F.xxhash64(F.lit(t), F.col("tokens")[o[0]]).alias("node"), F.slice("tokens", o[0] + 2, DEPTH - 1).alias("path")) for t, o in enumerate(_ORDER)]
    level = sets.select("rep", F.inline(F.array(*first)))
    done: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        # Cut off, so that the join below is between two plain exchanges, whose large partitions Spark can split.
        sizes = cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("leader")).where("members > 1"))
        placed = cut(level.join(sizes, "node"))
        done.append(placed.where((F.col("members") <= LEAF) | F.lit(depth == DEPTH)).select("node", "rep", "leader"))
        large = placed.where(F.col("members") > LEAF)
        if depth == DEPTH or large.isEmpty():
            break
        level = large.select("rep", F.xxhash64("node", F.get("path", F.lit(0))).alias("node"), F.slice("path", 2, DEPTH).alias("path"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def may_link(left: str, right: str, percent: int) -> Column:
    """Whether sizes and sketches leave it open that two sets reach the similarity."""

    def differ(words: list[str]) -> Column:
        counts = [F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}"))) for w in words]
        return sum(counts[1:], counts[0])

    agree = (1 + percent / 100) / 2
    off = BITS * (1 - agree) + 5 * (BITS * agree * (1 - agree)) ** 0.5
    smaller, larger = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    # Of sets that link, at most this many hashes are in one of the two only; each changes one cell.
    alone = (smaller + larger) * ((100 - percent) / (100 + percent))
    cells = differ(_PARITY)
    stays = F.pow(F.lit(1 - 2 / CELLS), alone)
    expected, deviation = (1 - stays) * (CELLS / 2), F.sqrt((1 - stays * stays) * (CELLS / 4))
    return (smaller * 100 >= larger * percent) & (differ(_WORDS) <= int(off)) & (cells <= alone + 0.01) & (cells <= expected + deviation * 5 + 1)


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union; ``docs`` is (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from compared(batches)
        finally:
            forget_powers()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                left, right = shingle_sets(part.column(0).to_pylist(), width), shingle_sets(part.column(1).to_pylist(), width)
                same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], dtype=np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.int64) - same
                linked = pa.array((100 * same >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column(2).filter(linked), part.column(3).filter(linked)], names=["u", "v"])

    first = pairs.join(docs.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = first.join(docs.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("text_u", "text_v", "u", "v").mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id: the least id reachable. Alternates large and small stars until nothing changes."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each greater neighbour of u is tied to the least of u and its neighbours.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its lesser neighbours are tied to the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(tied.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            # Each id is now tied to the least of its component and to nothing else.
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = now


def with_components(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``df``; links have 100 * intersection >= percent * union."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = cut(features(docs, "text", "doc_id", width))
    identity = ["n", "a", "b"]
    sets = cut(
        known.where("n > 0 AND doc_id IS NOT NULL").groupBy(*identity)
        .agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), *(F.first(w).alias(w) for w in _SKETCH))
    )
    placed = leaves(sets)
    # Round one: each member and the leaders of its nodes, one for each tree at most.
    led = cut(placed.where("rep <> leader").groupBy("rep").agg(F.collect_set("leader").alias("leaders")))
    left, right = (sets.select(F.col("rep").alias(name), F.struct("n", *_SKETCH).alias(side)) for name, side in (("u", "x"), ("v", "y")))

    def links_of(pairs: DataFrame) -> DataFrame:
        likely = cut(pairs.join(left, "u").join(right, "v").where(may_link("x", "y", percent)).select("u", "v"))
        return cut(verified(likely, docs, percent, width))

    # The least leader first. What it links has a root, and a member and a leader with the same root need no comparison.
    least = links_of(led.select(F.col("rep").alias("u"), F.array_min("leaders").alias("v")))
    rooted = least.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    others = led.join(rooted, "rep", "left").select(
        F.col("rep").alias("u"), F.coalesce("root", "rep").alias("root_u"), F.explode(F.array_remove("leaders", F.array_min("leaders"))).alias("v")
    )
    roots = cut(sets.select("rep").join(rooted, "rep", "left").select(F.col("rep").alias("id"), F.coalesce("root", "rep").alias("root")))
    links = least.unionByName(links_of(cut(others.join(roots, (F.col("v") == F.col("id")) & (F.col("root_u") != F.col("root"))).select("u", "v"))))
    found = cut(components(links))
    # Round two: pairs within a node that round one left in different components.
    member = placed.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = cut(member.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("node"))
    open_nodes = cut(member.join(apart, "node").select("node", "rep", "component").join(sets.select("rep", "n", *_SKETCH), "rep"))
    x, y = open_nodes.alias("x"), open_nodes.alias("y")
    more = cut(
        x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.rep") > F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", percent))
        .select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v")).distinct()
    )
    # Documents are tied to the document that stands for their set; one with several texts ties their sets together.
    ties = known.where("n > 0 AND doc_id IS NOT NULL").join(sets.select(*identity, "rep"), identity).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    if not more.isEmpty():
        links = links.unionByName(verified(more, docs, percent, width))
    found = components(links.unionByName(ties))
    component = F.coalesce("component", "doc_id")
    rows = known.select("doc_id", "n").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``df`` without the later documents of each component; rows without ``doc_id`` stay."""
    gone = with_components(df, text, key, percent, width).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return df.join(gone, key, "left_anti")
