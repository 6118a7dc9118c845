"""The mixed record table: rebuilt from the sources, or projected from enriched facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    DIRECTORY_COLUMNS, DISTRICT_COLUMNS, FACILITY_COLUMNS, FACILITY_TYPE_RULES, INDICATORS, OPERATOR_TYPE_RULES,
    PLACES, RECORD_FIELDS, STRICT_INDICATORS, VALID_FACILITY_TYPES, VALID_OPERATOR_TYPES, Places,
)
from ..functions import (
    blank_to_null, canonical, canonical_in_scope, clean, first_of_list_text, first_quoted, join_clean, json_name, listing_sentence,
    normalize_category, record_hash, stable_uuid, strict_double, valid_uuid,
)
from ..operators.columns import RECORD_SCHEMA, conform, resolve, resolve_scalar, union_records
from ..operators.quality import check_split, rebuild_rule, repair_rule, split
from ..operators.rollup import first_nonblank


# Record schema plus the provenance of the location.
LOCATED_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("district_source", T.StringType())])


def facility_records(df: DataFrame) -> DataFrame:
    """Facility rows with an id derived from their content."""
    of = FACILITY_COLUMNS
    staged = df.select(
        resolve_scalar(df, of["rebuild_id"]).alias("source_id"),
        clean(json_name(resolve(df, of["name"]))).alias("entity_name"),
        *[clean(resolve(df, of[k])).alias(k) for k in ("state", "district", "city", "pincode", "phone")],
        *[strict_double(resolve(df, of[k])).alias(k) for k in ("latitude", "longitude")],
        normalize_category(resolve(df, of["facility_type"]), FACILITY_TYPE_RULES).alias("facility_type"),
        normalize_category(resolve(df, of["operator_type"]), OPERATOR_TYPE_RULES).alias("operator_type"),
        clean(resolve_scalar(df, of["website"])).alias("website"),
    )
    c = F.col
    identity = stable_uuid(
        c("source_id"), c("entity_name"), c("state"), c("city"), c("pincode"),
        c("latitude").cast("string"), c("longitude").cast("string"),
    )
    return conform(
        staged,
        record_id=F.concat(F.lit("facility:"), identity),
        record_type=F.lit("facility"),
        description=listing_sentence(
            c("entity_name"), c("facility_type"), c("operator_type"), c("city"), c("state"), c("pincode")
        ),
    )


def pincode_records(df: DataFrame) -> DataFrame:
    """Postal directory rows."""
    of = DIRECTORY_COLUMNS
    staged = df.select(
        clean(resolve(df, of["office_name"])).alias("entity_name"),
        *[clean(resolve(df, of[k])).alias(k) for k in ("state", "district", "pincode", "office_type", "delivery")],
        *[strict_double(resolve(df, of[k])).alias(k) for k in ("latitude", "longitude")],
        clean(join_clean(" / ", *[resolve(df, of[k]) for k in ("circle_name", "region_name", "division_name")])).alias("description"),
    )
    key = [F.col(c) for c in ("entity_name", "state", "district", "pincode")]
    return conform(staged, record_id=record_hash("pincode", *key), record_type=F.lit("pincode"))


def district_records(df: DataFrame) -> DataFrame:
    """District indicator rows."""
    of = DISTRICT_COLUMNS
    staged = df.select(
        clean(resolve(df, of["district"])).alias("district"),
        clean(resolve(df, of["state"])).alias("state"),
        *[strict_double(resolve(df, of[i])).alias(i) for i in INDICATORS],
    )
    return conform(
        staged,
        record_id=record_hash("district", F.col("state"), F.col("district")),
        record_type=F.lit("district"),
        entity_name=F.col("district"),
        description=F.concat(F.lit("NFHS district indicators for "), F.col("district"), F.lit(", "), F.col("state")),
    )


def rebuild_records(facilities: DataFrame, directory: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of the mixed record table."""
    everything = union_records(facility_records(facilities), pincode_records(directory), district_records(districts))
    return split(everything, rebuild_rule())


def check_rebuild(total: DataFrame, valid: DataFrame, rejected: DataFrame) -> dict:
    return check_split(total, valid, rejected)


def repair_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate, quarantined) rows of a stored record table."""
    return split(records.select(*RECORD_FIELDS), repair_rule())


def _blank_null(value: Column) -> Column:
    return blank_to_null(F.trim(value))


def strict_facility_records(df: DataFrame) -> DataFrame:
    """Facility rows of the fixed source schema that pass the admission rules; ids are the source's own.

    Nursing homes count as hospitals here and types are matched whole, unlike in :func:`facility_records`.
    """
    c = F.col
    kind, operator = F.lower(F.trim("facilityTypeId")), F.lower(F.trim("operatorTypeId"))
    kept = df.where(
        valid_uuid(c("unique_id"))
        & _blank_null(c("name")).isNotNull()
        & F.lower(F.coalesce("facilityTypeId", F.lit(""))).isin(*VALID_FACILITY_TYPES)
        & F.lower(F.coalesce("operatorTypeId", F.lit(""))).isin(*VALID_OPERATOR_TYPES)
    )
    staged = kept.select(
        F.concat(F.lit("facility:"), c("unique_id")).alias("record_id"),
        _blank_null(F.regexp_replace(json_name(c("name")), r"\s+", " ")).alias("entity_name"),
        _blank_null(c("address_stateOrRegion")).alias("state"),
        _blank_null(c("address_city")).alias("city"),
        _blank_null(c("address_zipOrPostcode")).alias("pincode"),
        c("latitude").try_cast("double").alias("latitude"),
        c("longitude").try_cast("double").alias("longitude"),
        F.when(kind == "nursing_home", F.lit("hospital")).when(~kind.isin("null", ""), kind).alias("facility_type"),
        F.when(~operator.isin("null", ""), operator).alias("operator_type"),
        F.coalesce(
            _blank_null(c("officialPhone")), first_quoted(c("phone_numbers")), _blank_null(c("phone_numbers"))
        ).alias("phone"),
        F.coalesce(
            first_quoted(c("officialWebsite")), _blank_null(c("officialWebsite")),
            first_quoted(c("websites")), _blank_null(c("websites")),
        ).alias("website"),
    )
    sentence = listing_sentence(
        c("entity_name"), c("facility_type"), c("operator_type"), c("city"), c("state"), c("pincode")
    )
    return conform(staged, record_type=F.lit("facility"), description=sentence)


def _raw_hash(prefix: str, *values: Column) -> Column:
    text = F.concat_ws("||", *[F.coalesce(v, F.lit("")) for v in values])
    return F.concat(F.lit(f"{prefix}:"), F.sha2(text, 256))


def strict_pincode_records(df: DataFrame) -> DataFrame:
    """Postal directory rows of the fixed source schema. Ids hash the values as they come, blanks and spaces included."""
    c = F.col
    return conform(
        df.select(
            _raw_hash("pincode", c("officename"), c("statename"), c("district"), c("pincode")).alias("record_id"),
            _blank_null(c("officename")).alias("entity_name"), _blank_null(c("statename")).alias("state"),
            *[_blank_null(c(n)).alias(n) for n in ("district", "pincode", "delivery")], _blank_null(c("officetype")).alias("office_type"),
            *[c(n).try_cast("double").alias(n) for n in ("latitude", "longitude")],
            F.concat_ws(" / ", *[_blank_null(c(n)) for n in ("circlename", "regionname", "divisionname")]).alias("description"),
        ),
        record_type=F.lit("pincode"),
    )


def strict_district_records(df: DataFrame) -> DataFrame:
    """District indicator rows of the fixed source schema, with ids like those of :func:`strict_pincode_records`."""
    c = F.col
    return conform(
        df.select(
            _raw_hash("district", c("state_ut"), c("district_name")).alias("record_id"),
            _blank_null(c("district_name")).alias("district"), _blank_null(c("state_ut")).alias("state"),
            F.concat(F.lit("NFHS district indicators for "), c("district_name"), F.lit(", "), c("state_ut")).alias("description"),
            *[c(source).try_cast("double").alias(name) for name, source in STRICT_INDICATORS.items()],
        ),
        record_type=F.lit("district"), entity_name=c("district"),
    )


def strict_records(facilities: DataFrame, directory: DataFrame, districts: DataFrame) -> DataFrame:
    """The mixed record table of the three sources in their fixed schema; unordered, as an export orders it when it writes."""
    return union_records(strict_pincode_records(directory), strict_facility_records(facilities), strict_district_records(districts))


def is_enriched(df: DataFrame) -> bool:
    """Whether a frame has the shape of the enriched facility table."""
    return {"facility_id", "facility_name", "analysis_state", "analysis_district"} <= set(df.columns)


def project_enriched(enriched: DataFrame, places: Places = PLACES) -> DataFrame:
    """Mixed records of an enriched table: its facilities, and one district row per place they name."""
    c = F.col
    state = canonical(c("analysis_state"), places.states)
    district = canonical_in_scope(c("analysis_state"), c("analysis_district"), places)
    base = enriched.select(
        "*", state.alias("_state"), blank_to_null(district).alias("_district")
    )
    facilities = conform(
        base,
        LOCATED_SCHEMA,
        record_id=c("facility_id"), record_type=F.lit("facility"), entity_name=c("facility_name"), state=c("_state"),
        district=c("_district"), city=c("source_city"), pincode=c("source_pincode"),
        website=first_of_list_text(c("website")),
    )
    named = base.where(c("_state").isNotNull() & c("_district").isNotNull()).withColumns(
        {"_state_key": F.lower("_state"), "_district_key": F.lower("_district")}
    )
    firsts = first_nonblank(
        named, ["_state_key", "_district_key"], ["_state", "_district", "analysis_location_key", *INDICATORS], ["facility_id"]
    )
    key = F.coalesce("analysis_location_key", F.concat_ws("|", "_state_key", "_district_key"))
    districts = conform(
        firsts,
        LOCATED_SCHEMA,
        record_id=F.concat(F.lit("district:"), key), record_type=F.lit("district"), entity_name=c("_district"),
        state=c("_state"), district=c("_district"),
        description=F.concat(F.lit("NFHS district indicators for "), c("_district"), F.lit(", "), c("_state")),
    )
    return union_records(districts, facilities)


def replace_universe(records: DataFrame, supplied: DataFrame | None, places: Places = PLACES) -> DataFrame:
    """Use the supplied district rows instead of the derived ones; without any, nothing changes.

    Whether there are any is one number worked out within the plan; no job runs while it is built.
    """
    if supplied is None:
        return records
    districts = supplied.where(F.col("record_type") == "district")
    none_supplied = districts.agg(F.count(F.lit(1))).scalar() == 0
    state = F.coalesce(canonical(F.col("state"), places.states), F.coalesce("state", F.lit("")))
    own = F.when(F.coalesce("district", F.lit("")) != "", F.col("district")).otherwise(F.col("entity_name"))
    named = conform(districts, records.schema, state=state, district=canonical_in_scope(state, own, places))
    return union_records(named, records.where((F.col("record_type") == "facility") | none_supplied))


def records_from(df: DataFrame, supplied: DataFrame | None = None, places: Places = PLACES) -> DataFrame:
    """Records as they are, or projected when the frame is an enriched table."""
    return replace_universe(project_enriched(df, places), supplied, places) if is_enriched(df) else df
