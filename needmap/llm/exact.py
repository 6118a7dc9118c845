"""Exact duplicates by distributed radix partitioning on the most significant bytes.

Every text is laid out once as columns of successive bytes: 32 bytes, then four times as many, and so on; the last column takes
the rest of any text. At each level the rows that are still together are split by their next bytes, and only that column is read. A group
of one row is done. A group whose bytes end before the column is full is done as well: its texts are equal, byte by byte. The rest
goes on to the next level. No digest decides anything.

A level moves a row number, a group number and the bytes at hand. Bytes are counted by partial sums before the shuffle, and groups of
one row fall away there, so texts that differ early are never read further. A group is numbered by its least row. No group meets
in one task: the join that hands out the numbers is between a table of groups and plain rows, whose large partitions Spark splits. Both
sides of all joins grow with the table, so they are merged and never broadcast.

Defined cases: a NULL text counts as empty, so NULL and empty texts are one group. Of equal texts the row with the largest key stays; a
NULL key is less than any other, and of rows with the same key exactly one stays. All rows and all other columns come back,
texts of any length and NULLs included; an existing column with the name of a result is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bytes of the first level, how many times wider each level is than the one before, and the number of levels.
FIRST, GROWTH, LEVELS = 32, 4, 14


def level_bounds(first: int = FIRST, growth: int = GROWTH, levels: int = LEVELS) -> list[tuple[int, int]]:
    """(offset, width) of each level's bytes; the last level is as wide as a text can be."""
    bounds, offset = [], 0
    for level in range(levels):
        width = first * growth**level if level < levels - 1 else (1 << 31) - 1
        bounds.append((offset, width))
        offset += width
    return bounds


def with_copies(
    df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "keep_id", size: str = "group_size", kept: str = "kept",
    bounds: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` with the key of the row that stays, the number of equal texts, and whether the row stays."""
    bounds = bounds or level_bounds()
    own = [c for c in df.columns if c.lower() not in (keep.lower(), size.lower(), kept.lower()) or c in (text, key)]
    row, absent, *pieces = fresh(df, "row_number", "absent", *(f"bytes_{k}" for k in range(len(bounds))))
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rest = [F.col(f"`{c}`") for c in own if c != text]
    # Row numbers are stored with the rows, so they are the same for every later reader.
    rows = cut(
        df.select(
            *rest, F.col(f"`{text}`").isNull().alias(absent), F.monotonically_increasing_id().alias(row),
            *(F.substring(raw, offset + 1, width).alias(piece) for piece, (offset, width) in zip(pieces, bounds)),
        )
    )
    equal = _equal_rows(rows, row, key, pieces, bounds)
    best = cut(equal.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("key", "row")).alias("best")))
    found = equal.join(best.hint("merge"), "group").select("row", "size", "best")
    out = rows.join(found.hint("merge"), rows[f"`{row}`"] == found["row"], "left")
    own_key = F.col(f"`{key}`")
    values = [F.when(~F.col(absent), F.concat(*pieces).cast("string")).alias(c) if c == text else F.col(f"`{c}`") for c in own]
    return out.select(
        *values, F.when(F.col("size").isNull(), own_key).otherwise(F.col("best.key")).alias(keep), F.coalesce("size", F.lit(1)).cast("long").alias(size),
        F.coalesce(F.col(f"`{row}`") == F.col("best.row"), F.lit(True)).alias(kept),
    )


def _equal_rows(rows: DataFrame, row: str, key: str, pieces: list[str], bounds: list[tuple[int, int]]) -> DataFrame:
    """(row, key, group) of all rows whose text another row has too."""
    thin = lambda piece: rows.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").alias("key"), F.col(piece).alias("bytes"))
    done: list[DataFrame] = []
    here: DataFrame = thin(pieces[0]).withColumn("group", F.lit(-1).cast("long"))
    for level, (_, width) in enumerate(bounds):
        groups = cut(here.groupBy("group", "bytes").agg(F.count(F.lit(1)).alias("members"), F.min("row").alias("next")).where("members > 1").drop("members"))
        ended = F.octet_length("bytes") < width if level < len(bounds) - 1 else F.lit(True)
        placed = cut(here.join(groups.hint("merge"), ["group", "bytes"]).select("row", "key", F.col("next").alias("group"), ended.alias("ended")))
        done.append(placed.where("ended").drop("ended"))
        together = placed.where("NOT ended").drop("ended")
        if level == len(bounds) - 1 or together.isEmpty():
            break
        here = cut(thin(pieces[level + 1]).drop("key").join(together.hint("merge"), "row"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without the ones whose text a row with a larger key has."""
    keep, size, kept = fresh(df, "keep_id", "group_size", "kept_of_copies")
    return with_copies(df, text, key, keep, size, kept).where(F.col(kept)).select(*(f"`{c}`" for c in df.columns))


def text_digest(text: str) -> Column:
    """The lowercase hex SHA-256 of the text, NULL read as empty."""
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
