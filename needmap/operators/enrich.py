"""Grain-safe enrichment of facts with rolled-up dimensions, and location provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOCATION_CONFIDENCE, PLACES, Places
from ..functions import blank_to_null, canonical, canonical_in_scope, label_weight, present, salted_key, squeeze
from .rollup import canonical_pair


def enrich_left(facts: DataFrame, dim: DataFrame, key: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """``facts`` LEFT JOIN a one-row-per-key ``dim`` on text keys of the same names.

    Facts without a key match nothing, yet a plain left join would send all of them to one task:
    their first key column is replaced by a salt taken from the ``spread`` columns for the join.
    No side is hinted: Spark broadcasts the dimension only where its measured size allows it, and
    splits a hot key at run time (adaptive skew join) elsewhere.
    """
    missing = F.lit(False)
    for name in key:
        missing = missing | F.col(name).isNull()
    left = facts.withColumn("_join_key", salted_key(F.col(key[0]), *[F.col(c) for c in spread], missing=missing))
    complete = dim
    for name in key:
        complete = complete.where(F.col(name).isNotNull())
    right = complete.select(
        *[F.col(name).alias(f"_dim_{i}") for i, name in enumerate(key)], *[c for c in dim.columns if c not in key]
    )
    on = F.col("_join_key") == F.col("_dim_0")
    for i, name in enumerate(key[1:], start=1):
        on = on & (F.col(name) == F.col(f"_dim_{i}"))
    return left.join(right, on, "left").drop("_join_key", *[f"_dim_{i}" for i in range(len(key))])


def attach_indicators(
    facts: DataFrame, dim: DataFrame, fact_keys: Sequence[str], dim_keys: Sequence[str], spread: Sequence[str]
) -> DataFrame:
    """LEFT JOIN on composite name keys that are called differently on both sides."""
    renamed = dim
    for fact_key, dim_key in zip(fact_keys, dim_keys):
        renamed = renamed.withColumnRenamed(dim_key, fact_key)
    return enrich_left(facts, renamed, fact_keys, spread)


def location_source(inferred: Column, district: Column, city: Column) -> Column:
    """Which input the analysis district comes from."""
    return (
        F.when(inferred, F.lit("pincode_inferred"))
        .when(district, F.lit("source_district"))
        .when(city, F.lit("city_fallback"))
        .otherwise(F.lit("missing_location"))
    )


def location_confidence(source: Column) -> Column:
    return label_weight(source, LOCATION_CONFIDENCE, 0.0)


def infer_location(records: DataFrame, places: Places = PLACES) -> DataFrame:
    """Give facility records a district and its provenance: pincode pair, own district, city, nothing.

    Only facilities go through the join; records of other types, most of the table, pass beside it unchanged with
    a NULL provenance.
    """
    is_facility = F.coalesce(F.col("record_type") == "facility", F.lit(False))
    with_state = F.coalesce(canonical(F.col("state"), places.states), squeeze(F.col("state")))

    directory = (
        records.where(F.col("record_type") == "pincode")
        .select(
            blank_to_null(squeeze(F.col("pincode"))).alias("_pin"),
            with_state.alias("_state"),
            canonical_in_scope(with_state, F.col("district"), places).alias("_district"),
        )
        .where(F.col("_pin").isNotNull() & (F.col("_district") != ""))
    )
    index = canonical_pair(directory, ["_pin"], ["_state", "_district"])

    own_source = F.col("district_source") if "district_source" in records.columns else F.lit(None).cast("string")
    whole = records.withColumn("district_source", own_source)
    keyed = whole.where(is_facility).withColumn("_pin", blank_to_null(squeeze(F.col("pincode"))))
    located = enrich_left(keyed, index, ["_pin"], ["record_id"])

    inferred = F.col("_district").isNotNull()
    own = present(F.col("district"))
    source = location_source(inferred, own, present(F.col("city")))
    kept = F.when(
        ~inferred & own, F.coalesce(blank_to_null(squeeze(F.col("district_source"))), source)
    ).otherwise(source)
    own_district = canonical_in_scope(with_state, F.col("district"), places)
    new = {
        "state": F.when(inferred & (F.col("_state") != ""), F.col("_state")).otherwise(F.col("state")),
        "district": F.when(inferred, F.col("_district")).when(own, own_district).otherwise(F.col("district")),
        "district_source": kept,
    }
    columns = [*records.columns, *(["district_source"] if "district_source" not in records.columns else [])]
    facilities = located.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])
    return facilities.unionByName(whole.where(~is_facility).select(*columns))
