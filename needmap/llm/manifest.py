"""Merkle manifest of a table by time-forward processing: a root, and for each row a proof that it belongs to the root.

Rows are leaves of one tree for each group (a source); leaves ascend by key, and every three consecutive nodes become the digest of
their joined hex digests until one is left. The group's last node, its subroot, is a leaf of the tree of groups, which ends in the root.

Nodes are labelled by level and place. A priority queue ordered by label delivers the digests of children to their parent, which is worked out
when all of them have come and sends its own digest on. Between tasks the queue is a sorted shuffle: a block of ``3 ** HEIGHT``
neighbours is one stretch of it, a task reads stretches in the order of their labels, and a round takes all trees ``HEIGHT`` levels up;
``log(rows) / HEIGHT`` rounds end at the root. Then the sweep is reversed: each block receives the proof of its own top as a
message, ahead of its nodes in the same sorted shuffle, and hands every node the siblings of its level followed by the proof of its parent.
A task holds one block, whatever the size of a group; no digest but the root comes to the driver.

Places come from exact numbering without a global sort in one task: rows are dealt by ranges of (group, key), counted for each range,
and numbered within it from the sum of the ranges before.

Defined cases: each value enters a leaf as its UTF-8 byte count, a colon and the value, NULL as ``-``, so NULL and empty differ. NULL is a
group of its own, the first; a NULL key comes first in its group. Rows with the same key are ordered by their leaf; equal rows are
separate leaves. Texts of any length are hashed whole. All columns given come back; an existing column with the name of a
result is replaced. An empty table gives no rows and has no root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, cut

#: Children of a node, and levels of a block of nodes that one sweep takes.
WIDTH, HEIGHT = 3, 8
STEP = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
#: Rows of a batch that a sweep gives back; a proof has up to about 2 KB.
_BATCH = 2048


def leaf(*values: Column) -> Column:
    """Hex SHA-256 of the values, each as byte count, colon and text, or ``-`` for NULL."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, digest, lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]), 256))


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0) and ``total`` of each row within its tree, in the given order."""
    ranged = cut(cut(df.withColumn("tie", F.monotonically_increasing_id())).repartitionByRange(tree, *order, "tie").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("rows"))
    # One row for each range that a tree lies in.
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        counts.select(tree, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy(tree)).alias("total"))
    )
    local = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order, "tie"))
    return cut(ranged.withColumn("place", local)).join(offsets, [tree, "part"]).withColumn("place", F.col("offset") + F.col("place") - 1).drop("offset", "tie", "part")


# --- sweeps over blocks -----------------------------------------------------------------------------------------


def levels_of(total: int, height: int) -> int:
    """Levels that one round takes a tree of ``total`` nodes up."""
    levels = 0
    while total > 1 and levels < height:
        total, levels = -(-total // WIDTH), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The digest on top of a block, and its runs (level, place of the parent, children) in the order they were worked out."""
    if levels == 0:
        return digests[0], []
    queue = [(1, k // WIDTH, k % WIDTH, d) for k, d in enumerate(digests)]  # label of the receiver, its child's place, message; in order
    runs: list[tuple[int, int, list[str]]] = []
    while queue:
        level, parent, _, digest = heapq.heappop(queue)
        children = [digest]
        while queue and queue[0][0] == level and queue[0][1] == parent:
            children.append(heapq.heappop(queue)[3])
        runs.append((level, parent, children))
        made = hashlib.sha256("".join(children).encode()).hexdigest()
        if level == levels:
            return made, runs
        heapq.heappush(queue, (level + 1, parent // WIDTH, parent % WIDTH, made))
    raise ValueError("a block without nodes")


def backward(digests: list[str], levels: int, suffix: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proof of each node of a block, given the proof of the block's top."""
    _, runs = forward(digests, levels)
    below = {(levels, 0): (None, None)}  # label: (own step, rest), a linked list towards the top
    for level, parent, children in reversed(runs):
        rest = below.pop((level, parent))
        for k in range(len(children)):
            step = ("".join(children[:k]), "".join(children[k + 1 :]))
            below[level - 1, parent * WIDTH + k] = (step, rest)
    out = []
    for k in range(len(digests)):
        steps, link = [], below[0, k]
        while link[0] is not None:
            steps.append(link[0])
            link = link[1]
        out.append(steps + suffix)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks; the first two columns name the block. What is held back is one block at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tree, block = batch.column(0), batch.column(1)
        last = (tree[-1].as_py(), block[-1].as_py())
        start = batch.num_rows - 1
        while start > 0 and block[start - 1].as_py() == last[1] and tree[start - 1].as_py() == last[0]:
            start -= 1
        if start == 0 and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == last:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _blocks(tree: list, block: list) -> Iterator[tuple[int, int]]:
    low = 0
    for k in range(1, len(tree) + 1):
        if k == len(tree) or block[k] != block[low] or tree[k] != tree[low]:
            yield low, k
            low = k


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """One round: (tree, place, total, digest) of the tops of all blocks."""
    size = WIDTH**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            tree, block, total, digest = (stretch.column(c).to_pylist() for c in ("tree", "block", "total", "digest"))
            out: list[tuple] = []
            for low, high in _blocks(tree, block):
                out.append((tree[low], block[low], -(-total[low] // size), forward(digest[low:high], levels_of(total[low], height))[0]))
            if out:
                names, kinds = ["tree", "place", "total", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*out), kinds)], names=names)

    source = nodes.select("tree", F.floor(F.col("place") / size).cast("long").alias("block"), "place", "total", "digest")
    sorted_ = source.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").drop("place")
    return cut(sorted_.mapInArrow(run, "tree string, place long, total long, digest string"))


def _down(nodes: DataFrame, messages: DataFrame, height: int, carried: list[str]) -> DataFrame:
    """(tree, place, carried..., subroot, proof) of all nodes; ``messages`` is (tree, place of the block, subroot, proof)."""
    size = WIDTH**height
    fields = {f.name: f.dataType for f in nodes.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c]) for c in ("tree", "place", *carried)])
    schema = T.StructType([*schema.fields, T.StructField("subroot", T.StringType()), T.StructField("proof", T._parse_datatype_string(STEP))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            tree, block, total, digest, proof, subroot = (stretch.column(c).to_pylist() for c in ("tree", "block", "total", "digest", "proof", "subroot"))
            rows: list[int] = []
            proofs: list[list[tuple[str, str]]] = []
            tops: list[str | None] = []
            for low, high in _blocks(tree, block):  # the message comes first
                suffix = [(s["left"], s["right"]) for s in proof[low]]
                proofs += backward(digest[low + 1 : high], levels_of(total[low + 1], height), suffix)
                rows += range(low + 1, high)
                tops += [subroot[low]] * (high - low - 1)
            kept = stretch.select(["tree", "place", *carried]).take(pa.array(rows, type=pa.int64())).combine_chunks()
            for at in range(0, len(rows), _BATCH):
                some = proofs[at : at + _BATCH]
                offsets = [0]
                for p in some:
                    offsets.append(offsets[-1] + len(p))
                steps = pa.StructArray.from_arrays([pa.array([s[k] for p in some for s in p], type=pa.string()) for k in (0, 1)], fields=list(_STEP))
                lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), steps)
                part = kept.slice(at, _BATCH)
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tops[at : at + _BATCH], type=pa.string()), lists], names=schema.names)

    null = lambda kind: F.lit(None).cast(kind)
    own = nodes.select(
        "tree", F.floor(F.col("place") / size).cast("long").alias("block"), F.lit(1).alias("kind"), "place", "total", "digest", *(f"`{c}`" for c in carried),
        null("string").alias("subroot"), null(STEP).alias("proof"),
    )
    sent = messages.select(
        "tree", F.col("place").alias("block"), F.lit(0).alias("kind"), null("long").alias("place"), null("long").alias("total"), null("string").alias("digest"),
        *(null(fields[c]).alias(c) for c in carried), "subroot", "proof",
    )
    sorted_ = own.union(sent).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "place").drop("kind")
    return sorted_.mapInArrow(run, schema)


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes of each round, from the leaves to one node for each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > 1:
        rounds.append(_up(rounds[-1].select("tree", "place", "total", "digest"), height))
    return rounds


def manifest(
    df: DataFrame, digest: str = "leaf", key: str = "doc_id", group: str = "source", subroot: str = "subroot", root: str = "root", proof: str = "proof", height: int = HEIGHT
) -> DataFrame:
    """All columns of ``df`` with the subroot, the root, and the proof: for each level the joined digests to the left and to the right.

    ``df`` has a leaf digest for each row (see ``leaf``); leave wide columns out, as rows travel through sorted shuffles.
    """
    own = [c for c in df.columns if c.lower() not in (subroot.lower(), root.lower(), proof.lower())]
    carried = [f"column_{k}" for k in range(len(own))]
    name = F.col(f"`{group}`").cast("string")
    thin = df.select(
        F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)).alias("tree"),  # NULL first, then bytewise
        F.col(f"`{key}`").alias("key"), F.col(f"`{digest}`").alias("digest"), *(F.col(f"`{c}`").alias(n) for c, n in zip(own, carried)),
    )
    rounds = _rounds(cut(numbered(thin, "tree", ["key", "digest"]).drop("key")), height)
    tops = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    upper = tops.select(F.lit("").alias("tree"), F.col("tree").alias("column_0"), F.col("subroot").alias("digest"))
    above = _rounds(cut(numbered(upper, "tree", ["column_0"])), height)
    found = above[-1].select("digest").first()
    nothing = F.array().cast(STEP)
    messages = above[-1].select("tree", "place", F.lit(None).cast("string").alias("subroot"), nothing.alias("proof"))
    for k in range(len(above) - 2, -1, -1):
        messages = cut(_down(above[k], messages, height, ["column_0"] if k == 0 else []))
    if len(above) == 1:
        messages = messages.join(above[0].select("tree", "place", "column_0"), ["tree", "place"])
    messages = messages.select(F.col("column_0").alias("tree"), "proof").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("place"), "subroot", "proof")
    for k in range(len(rounds) - 2, -1, -1):
        messages = _down(rounds[k], messages, height, carried if k == 0 else [])
        if k:
            messages = cut(messages)
    if len(rounds) == 1:  # one leaf for each group
        messages = messages.join(rounds[0].select("tree", "place", *carried), ["tree", "place"])
    return messages.select(*(F.col(n).alias(c) for c, n in zip(own, carried)), F.col("subroot").alias(subroot), F.lit(found[0] if found else None).cast("string").alias(root), F.col("proof").alias(proof))


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(**instead: str) -> str:
    values = [f"({instead.get(f, f)})::VARCHAR" for f in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS id
    FROM (
        SELECT doc_id, source, {_leaf_sql()} AS leaf,
               CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql(text="replace(text, chr(10), '')")} ELSE {_leaf_sql()} END AS tampered
        FROM documents
    )
), below AS (
    SELECT tree, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS total FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM below WHERE total > 1 GROUP BY tree, level, place // 3
), tops AS (SELECT tree, h AS subroot FROM below WHERE total = 1
), above AS (
    SELECT 0 AS level, tree AS place, subroot AS h, count(*) OVER () AS total FROM tops
    UNION ALL
    SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM above WHERE total > 1 GROUP BY level, place // 3
), node AS (
    SELECT tree, level, place, h FROM below WHERE total > 1 UNION ALL SELECT -1, level, place, h FROM above WHERE total > 1
), path AS (
    SELECT id, l.tree, level, l.place // (3 ** level)::BIGINT AS place, level AS step FROM leaves l JOIN (SELECT DISTINCT tree, level FROM node) USING (tree)
    UNION ALL
    SELECT id, -1, level, tree // (3 ** level)::BIGINT, 1000 + level FROM leaves CROSS JOIN (SELECT DISTINCT level FROM node WHERE tree = -1)
), steps AS (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY step) AS step, coalesce(string_agg(h, '' ORDER BY n.place) FILTER (n.place < path.place), '') AS l,
           coalesce(string_agg(h, '' ORDER BY n.place) FILTER (n.place > path.place), '') AS r
    FROM path JOIN node n ON n.tree = path.tree AND n.level = path.level AND n.place // 3 = path.place // 3 GROUP BY id, path.tree, path.level, path.step
), fold AS (
    SELECT id, 0 AS step, tampered AS h FROM leaves
    UNION ALL SELECT fold.id, steps.step, sha256(l || h || r) FROM fold JOIN steps ON steps.id = fold.id AND steps.step = fold.step + 1
), ended AS (SELECT id, arg_max(h, step) AS folded_root FROM fold GROUP BY id
), proofs AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY step)) AS p FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, (SELECT h FROM above WHERE total = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM above WHERE total = 1) AS verified
FROM leaves JOIN tops USING (tree) JOIN ended USING (id) LEFT JOIN proofs USING (id)
"""
