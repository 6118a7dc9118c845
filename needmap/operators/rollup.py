"""Grouped reductions to one row per key, and ranks inside a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, key: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """Rows per (key, pair), incomplete pairs left out."""
    complete = [F.col(c).isNotNull() for c in pair]
    return df.where(complete[0] & complete[1]).groupBy(*key, *pair).agg(F.count(F.lit(1)).alias("n"))


def _most_frequent(pair: Sequence[str], count: str):
    """The pair with the highest count, ties to the first in name order, as a struct."""
    order = F.struct((-F.col(count)).alias("least"), *pair)
    return F.min_by(F.struct(*pair), F.when(F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull(), order))


def canonical_pair(df: DataFrame, key: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """Most frequent pair per key. Two partial aggregates; no group is ever sorted in one task."""
    best = pair_counts(df, key, pair).groupBy(*key).agg(_most_frequent(pair, "n").alias("best"))
    return best.select(*key, *[F.col("best")[c].alias(c) for c in pair])


def rollup_directory(
    df: DataFrame, key: Sequence[str], pair: Sequence[str], sets: dict[str, str], means: dict[str, str], count: str
) -> DataFrame:
    """One row per key: row count, sorted distinct lists, means, and the most frequent pair.

    ``sets`` and ``means`` map output to input columns. Rows are first reduced to one for each key and pair, copies combined before the
    shuffle and a key that holds a large share of the table spread by its pairs. The lists of these are then laid side by side, one value of
    each a row, so that distinct values combine a second time before those of a key meet.
    """
    inputs = list(dict.fromkeys(sets.values()))
    sums, counts = [f"sum_{c}" for c in means.values()], [f"n_{c}" for c in means.values()]
    totals = ("n", *sums, *counts)
    by_pair = df.groupBy(*key, *[F.col(c).alias(f"pair_{c}") for c in pair]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(s) for c, s in zip(means.values(), sums)], *[F.count(c).alias(s) for c, s in zip(means.values(), counts)],
        *[F.collect_set(c).alias(f"set_{c}") for c in inputs],
    )
    lists = F.arrays_zip(*[F.col(f"set_{c}") for c in inputs]) if inputs else F.array(F.lit(0))
    aside = by_pair.select(*key, *[F.col(f"pair_{c}").alias(c) for c in pair if c not in key], *totals, F.posexplode_outer(lists).alias("at", "value"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    per_key = aside.groupBy(*key).agg(
        _most_frequent(pair, "n").alias("best"), *[F.collect_set(F.col("value")[f"set_{c}"]).alias(f"set_{c}") for c in inputs],
        *[F.sum(F.when(first, F.col(c))).alias(c) for c in totals],
    )
    return per_key.select(
        *key,
        F.col("n").alias(count),
        *[F.sort_array(f"set_{c}").alias(out) for out, c in sets.items()],
        *[F.try_divide(f"sum_{c}", f"n_{c}").alias(out) for out, c in means.items()],
        *[F.col("best")[c].alias(c) for c in pair],
    )


def one_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One whole row per key: the least row in column order. Keeps a dimension from multiplying facts."""
    rest = [c for c in df.columns if c not in key]
    least = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("row"))
    return least.select(*key, "row.*").select(*df.columns)


def first_nonblank(df: DataFrame, key: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the first value present of every column, rows taken in ``order``."""
    rank = F.struct(*order)
    return df.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])


def rank_in_key(df: DataFrame, key: str, signature: str, count: str, rank: str, prefix: int = 4) -> DataFrame:
    """Group size and ``row_number`` over (key order by signature), without putting a key in one task.

    The signature is a hex digest, so its prefix cuts every key into ordered slices of even size.
    Rows are numbered inside a slice and shifted by the sizes of the slices before it; only the
    slice sizes (at most ``16 ** prefix`` small rows per key) meet in one place.
    """
    # Neither join column can be NULL. Else a not-null filter would be inferred for one side of the join only, and
    # the sides could no longer share the shuffle below them: the input would be read and cleaned twice.
    sliced = df.withColumns(
        {
            "_key": F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")),
            "_slice": F.coalesce(F.substring(signature, 1, prefix), F.lit("")),
        }
    )
    in_slice = Window.partitionBy("_key", "_slice").orderBy(signature)
    numbered = sliced.withColumn("_at", F.row_number().over(in_slice))

    sizes = sliced.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_key",
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("_key")).alias(count),
    )
    ranked = numbered.join(shifts, ["_key", "_slice"], "left")
    return ranked.withColumn(rank, (F.col("_at") + F.col("_shift")).cast("int")).select(*df.columns, count, rank)


def samples_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of every group; each task keeps at most ``n`` per group before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("sample", number).where(F.col("sample") <= n)
