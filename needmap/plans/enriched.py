"""From the three raw tables to one row per facility with match provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    DIRECTORY_COLUMNS, DISTRICT_COLUMNS, EXPECTED_FACILITY_TYPES, EXPECTED_OPERATOR_TYPES, FACILITY_COLUMNS,
    FACILITY_TYPE_RULES, INDICATORS, OPERATOR_TYPE_RULES, PLACES, PROFILE_RATES, Places,
)
from ..functions import (
    blank_to_null, canonical, canonical_in_scope, clean, digits_key, join_clean, json_name, listing_sentence, location_key, name_key,
    normalize_category, parse_double, quality_flags, row_signature, valid_uuid,
)
from ..operators.columns import prune, resolve, resolve_scalar
from ..operators.enrich import attach_indicators, enrich_left, location_confidence, location_source
from ..operators.quality import check_grain
from ..operators.rollup import one_per_key, rank_in_key, rollup_directory
from ..session import cut_lineage

# Columns of the cleaned and of the enriched facilities, in order (fixed values).
FACILITY_FIELDS = (
    "facility_id", "source_unique_id", "source_duplicate_count", "source_duplicate_rank", "source_row_signature",
    "facility_name", "raw_facility_type", "facility_type", "raw_operator_type", "operator_type", "phone", "website",
    "description", "source_state", "source_district", "source_city", "source_pincode", "pincode_key", "latitude",
    "longitude", "source_quality_flags",
)
# Columns in the order in which a facility row is signed (fixed values).
SIGNED_FIELDS = (
    "source_unique_id", "facility_name", "raw_facility_type", "facility_type", "raw_operator_type", "operator_type",
    "phone", "website", "description", "source_state", "source_district", "source_city", "source_pincode",
    "pincode_key", "latitude", "longitude", "source_quality_flags",
)
# Directory list columns: output -> cleaned input column (fixed values).
DIRECTORY_LISTS = {
    "pincode_office_names": "office_name", "pincode_office_types": "office_type",
    "pincode_delivery_values": "delivery", "pincode_circle_names": "circle_name",
    "pincode_region_names": "region_name", "pincode_division_names": "division_name",
}
ENRICHED_FIELDS = (
    *FACILITY_FIELDS[:17], "latitude", "longitude", "pincode_key", "pincode_match_status", "pincode_state",
    "pincode_district", "pincode_office_count", *DIRECTORY_LISTS, "pincode_latitude", "pincode_longitude",
    "analysis_state", "analysis_district", "analysis_location_key", "district_source", "location_confidence",
    "district_match_status", "district_state", "district_name", *INDICATORS, "facility_profile_text",
    "source_quality_flags", "created_at",
)


def facility_flags(df_id: Column, name: Column, pincode: Column, lat: Column, lon: Column, kind: Column, operator: Column) -> dict[str, Column]:
    """First-pass quality rules of a source facility, by flag name."""
    return {
        "invalid_facility_id": ~valid_uuid(df_id),
        "blank_facility_name": name.isNull(),
        "missing_pincode": pincode.isNull(),
        "missing_coordinates": lat.isNull() | lon.isNull(),
        "unexpected_facility_type": kind.isNotNull() & ~F.lower(kind).isin(*EXPECTED_FACILITY_TYPES),
        "unexpected_operator_type": operator.isNotNull() & ~F.lower(operator).isin(*EXPECTED_OPERATOR_TYPES),
    }


def flagged_facilities(df: DataFrame) -> DataFrame:
    """Cleaned source facilities, every row, with its first-pass quality flags."""
    of = FACILITY_COLUMNS
    text = {k: clean(resolve(df, of[k])) for k in ("state", "district", "city", "pincode", "facility_type", "operator_type")}
    scalar = {k: clean(resolve_scalar(df, of[k])) for k in ("id", "phone", "website")}
    staged = df.select(
        scalar["id"].alias("source_unique_id"),
        clean(json_name(resolve(df, of["name"]))).alias("facility_name"),
        text["facility_type"].alias("raw_facility_type"),
        text["operator_type"].alias("raw_operator_type"),
        scalar["phone"].alias("phone"),
        scalar["website"].alias("website"),
        clean(join_clean(" ", resolve(df, of["description"]), resolve(df, of["services"]))).alias("own_description"),
        text["state"].alias("source_state"),
        text["district"].alias("source_district"),
        text["city"].alias("source_city"),
        text["pincode"].alias("source_pincode"),
        digits_key(text["pincode"]).alias("pincode_key"),
        parse_double(resolve(df, of["latitude"])).alias("latitude"),
        parse_double(resolve(df, of["longitude"])).alias("longitude"),
    )
    c = F.col
    staged = staged.withColumns(
        {
            "facility_type": normalize_category(c("raw_facility_type"), FACILITY_TYPE_RULES),
            "operator_type": normalize_category(c("raw_operator_type"), OPERATOR_TYPE_RULES),
        }
    )
    sentence = listing_sentence(
        c("facility_name"), c("facility_type"), c("operator_type"), c("source_city"), c("source_state"), c("source_pincode")
    )
    flags = facility_flags(
        c("source_unique_id"), c("facility_name"), c("source_pincode"), c("latitude"), c("longitude"),
        c("raw_facility_type"), c("raw_operator_type"),
    )
    return staged.select(
        *[n for n in staged.columns if n != "own_description"],
        F.coalesce("own_description", sentence).alias("description"),
        quality_flags(flags).alias("source_quality_flags"),
    )


def admitted(flagged: DataFrame) -> DataFrame:
    """Rows with a uuid and a name."""
    return flagged.where(valid_uuid(F.col("source_unique_id")) & F.col("facility_name").isNotNull())


def clean_facilities(df: DataFrame) -> DataFrame:
    """One row per (uuid, signature), ids made unique where a uuid has several.

    Copies combine before the shuffle. Of different rows with one signature (the separator inside a value) the
    least in column order stays. The signed rows are stored: ranks read them twice, and they are cleaned once.
    """
    base = admitted(flagged_facilities(df)).select(*SIGNED_FIELDS)
    signed = cut_lineage(one_per_key(
        base.withColumn("source_row_signature", row_signature(SIGNED_FIELDS)), ["source_unique_id", "source_row_signature"]
    ))
    ranked = rank_in_key(
        signed, "source_unique_id", "source_row_signature", "source_duplicate_count", "source_duplicate_rank"
    )
    several = F.col("source_duplicate_count") > 1
    number = F.col("source_duplicate_rank").cast("string")
    # padded to three digits; lpad to a fixed width would cut longer numbers
    suffix = F.concat(F.lit(":dup-"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))
    named = ranked.withColumns(
        {
            "facility_id": F.concat(
                F.lit("facility:"), F.col("source_unique_id"), F.when(several, suffix).otherwise(F.lit(""))
            ),
            "source_quality_flags": F.concat_ws(
                "|",
                blank_to_null(F.col("source_quality_flags")),
                F.when(several, F.lit("duplicate_source_unique_id")),
            ),
        }
    )
    return prune(named, FACILITY_FIELDS)


def directory_rows(df: DataFrame) -> DataFrame:
    """Cleaned postal directory rows that have a pincode."""
    of = DIRECTORY_COLUMNS
    fields = ("office_name", "office_type", "delivery", "circle_name", "region_name", "division_name")
    return df.select(
        digits_key(clean(resolve(df, of["pincode"]))).alias("pincode_key"),
        clean(resolve(df, of["state"])).alias("pincode_state"),
        clean(resolve(df, of["district"])).alias("pincode_district"),
        *[clean(resolve(df, of[f])).alias(f) for f in fields],
        parse_double(resolve(df, of["latitude"])).alias("office_latitude"),
        parse_double(resolve(df, of["longitude"])).alias("office_longitude"),
    ).where(F.col("pincode_key").isNotNull())


def pincode_rollup(df: DataFrame) -> DataFrame:
    """One row per pincode: office count, distinct lists, mean position, most frequent (state, district)."""
    rolled = rollup_directory(
        directory_rows(df), ["pincode_key"], ["pincode_state", "pincode_district"], DIRECTORY_LISTS,
        {"pincode_latitude": "office_latitude", "pincode_longitude": "office_longitude"}, "pincode_office_count",
    )
    status = F.when(F.col("pincode_state").isNotNull(), F.lit("matched")).otherwise(F.lit("missing_location"))
    return rolled.withColumn("pincode_match_status", status)


def clean_districts(df: DataFrame) -> DataFrame:
    """District indicators with name keys, one row per key."""
    of = DISTRICT_COLUMNS
    state, district = clean(resolve(df, of["state"])), clean(resolve(df, of["district"]))
    rows = df.select(
        state.alias("district_state"),
        district.alias("district_name"),
        name_key(state).alias("district_state_key"),
        name_key(district).alias("district_name_key"),
        *[parse_double(resolve(df, of[i])).alias(i) for i in INDICATORS],
    ).where(F.col("district_state_key").isNotNull() & F.col("district_name_key").isNotNull())
    return one_per_key(rows, ["district_state_key", "district_name_key"])


def profile_text() -> Column:
    """Description and indicator sentences, absent parts dropped."""

    def rate(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"), F.lit("%."))

    return F.concat_ws(
        " ",
        F.col("description"),
        F.concat(
            F.lit("District health indicators for "), F.col("district_name"), F.lit(", "), F.col("district_state"), F.lit(".")
        ),
        *[rate(label, column) for label, column in PROFILE_RATES.items()],
    )


def build_enriched(
    facilities: DataFrame,
    rollup: DataFrame,
    districts: DataFrame,
    places: Places = PLACES,
    district_aliases: bool = False,
    as_of: Column | None = None,
) -> DataFrame:
    """Facilities with directory and indicator columns; never more or fewer rows than ``facilities``."""
    located = enrich_left(facilities, rollup.drop("pincode_match_status"), ["pincode_key"], ["facility_id"])
    c = F.col
    located = located.withColumn("pincode_state", canonical(c("pincode_state"), places.states))
    inferred = c("pincode_state").isNotNull() & c("pincode_district").isNotNull()
    located = located.withColumns(
        {
            "analysis_state": F.coalesce("pincode_state", canonical(c("source_state"), places.states)),
            "analysis_district": F.coalesce(F.when(inferred, c("pincode_district")), c("source_district"), c("source_city")),
            "district_source": location_source(inferred, c("source_district").isNotNull(), c("source_city").isNotNull()),
            "pincode_match_status": F.when(inferred, F.lit("matched")).otherwise(F.lit("missing")),
        }
    )
    if district_aliases:
        label = canonical_in_scope(c("analysis_state"), c("analysis_district"), places)
        located = located.withColumn("analysis_district", blank_to_null(label))
    located = located.withColumns(
        {
            "state_key": name_key(c("analysis_state")),
            "district_key": name_key(c("analysis_district")),
            "location_confidence": location_confidence(c("district_source")),
        }
    )
    joined = attach_indicators(
        located, districts, ["state_key", "district_key"], ["district_state_key", "district_name_key"], ["facility_id"]
    )
    finished = joined.withColumns(
        {
            "district_match_status": F.when(c("district_name").isNotNull(), F.lit("matched"))
            .when(c("analysis_district").isNotNull(), F.lit("missing_nfhs"))
            .otherwise(F.lit("missing_location")),
            "analysis_location_key": location_key(c("state_key"), c("district_key")),
            "facility_profile_text": profile_text(),
            "created_at": F.current_timestamp() if as_of is None else as_of,
        }
    )
    return prune(finished, ENRICHED_FIELDS)


def enrich_cleaned(facilities: DataFrame, directory: DataFrame, districts: DataFrame, **options) -> DataFrame:
    """Facilities that are cleaned already, with the raw directory and districts.

    Both dimensions are stored first, so the joins know their measured sizes: a dimension below the broadcast threshold goes to the
    facts, which then stay where they are; beyond it the facts are exchanged once for each join key.
    """
    return build_enriched(facilities, cut_lineage(pincode_rollup(directory)), cut_lineage(clean_districts(districts)), **options)


def enrich(facilities: DataFrame, directory: DataFrame, districts: DataFrame, **options) -> DataFrame:
    """The whole chain from the three raw tables."""
    return enrich_cleaned(clean_facilities(facilities), directory, districts, **options)


def check_enriched(facilities: DataFrame, enriched: DataFrame, allowed: Sequence[str] = PLACES.canonical_states) -> dict:
    """Fail unless the row count is unchanged, ids are unique and states canonical."""
    return check_grain(facilities, enriched, "facility_id", "analysis_state", allowed)
