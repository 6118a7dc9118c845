"""Queries a reviewer runs: queue, evidence, search, overview, districts, and the action overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INDICATORS, NEEDS, PRIORITY_BANDS, PRIORITY_DEFAULT, TAXONOMY, Need, Taxonomy
from ..functions import band, coalesce_blank, name_key, optional_eq, pct, present, rank_label, to_long
from .actions import no_actions
from .scoring import simple_risk

QUEUE_LIMIT, QUEUE_MAX = 60, 200
SEARCH_LIMIT, SEARCH_MAX = 25, 100
DISTRICT_LIMIT, DISTRICT_MAX = 50, 200
GAP_SCORES = ("planning_priority_score", "risk_score", "supply_score", "evidence_score", "data_quality_score")
GAP_COUNTS = ("relevant_claims", "strong_claims", "partial_claims", "pincode_inferred_claims", "city_fallback_claims")


def _checked(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1..{most}, got {limit}")
    return limit


def _where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def queue_mode(df: DataFrame, mode: str) -> DataFrame:
    """``decision``: districts with supply; ``missing_info``: districts without any."""
    if mode not in ("decision", "missing_info"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.where(F.col("supply_score") > 0 if mode == "decision" else F.col("supply_score") == 0)


def served_gaps(gaps: DataFrame) -> DataFrame:
    """Gap rows as served: trimmed name, absent scores 0, counts whole."""

    def served(name: str) -> Column:
        if name == "district_name":
            return F.trim(name)
        if name in GAP_SCORES:
            return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0))
        return to_long(F.col(name)) if name in GAP_COUNTS else F.col(name)

    return gaps.select(*[served(c).alias(c) for c in gaps.columns])


def review_queue(
    gaps: DataFrame, need: str, state: str = "all", evidence: str = "all", mode: str = "decision",
    limit: int = QUEUE_LIMIT,
) -> DataFrame:
    """Top districts of a need by priority. Filters reach the scan, the order is a top-k."""
    kept = _where_all(
        queue_mode(gaps.where(F.col("care_need") == need), mode),
        optional_eq(F.col("state"), state),
        optional_eq(F.col("uncertainty_label"), evidence),
    )
    top = kept.orderBy(F.desc("planning_priority_score"), "district_id").limit(_checked(limit, QUEUE_MAX))
    return served_gaps(top)


def queue_states(gaps: DataFrame, need: str, mode: str = "decision") -> DataFrame:
    kept = queue_mode(gaps.where((F.col("care_need") == need) & (F.col("state") != "")), mode)
    return kept.select("state").distinct().orderBy("state")


def facility_evidence(
    claims: DataFrame, enriched: DataFrame, need: str, state: str, district: str, needs: Sequence[Need] = NEEDS
) -> DataFrame:
    """Claims of a district for a need, overlaid with the facility's current name and place, strongest first.

    A need nobody defined falls back to the first one.
    """
    model = next((n for n in needs if n.key == need), needs[0])
    wanted = district.strip().lower()
    here = lambda place, area: (F.col(area) == state) & (F.lower(F.trim(place)) == wanted)
    relevant = claims.where(F.col("capability").isin(*model.capabilities))
    # Either the claim or the facility's current row names the place, in part at least: only these ids need the join.
    named = lambda frame, place, area: frame.where((F.col(area) == state) | (F.lower(F.trim(place)) == wanted)).select("facility_id")
    ids = named(relevant, "district_or_city", "state").unionByName(named(enriched, "analysis_district", "analysis_state"))
    narrowed = relevant.join(ids.distinct(), "facility_id", "left_semi")
    found = overlay_facilities(narrowed, enriched.join(ids.distinct(), "facility_id", "left_semi")).where(here("district_or_city", "state"))
    return found.orderBy(F.desc(rank_label(F.col("confidence"))), "facility_name", "capability", "facility_id")


def overlay_facilities(claims: DataFrame, enriched: DataFrame) -> DataFrame:
    """Claims with the fresher attributes of their facility where it has any."""
    fresh = enriched.select(
        "facility_id",
        F.col("facility_name").alias("_name"), F.col("analysis_state").alias("_state"),
        F.col("analysis_district").alias("_district"), F.col("district_source").alias("_source"),
    )
    over = {"facility_name": "_name", "state": "_state", "district_or_city": "_district", "district_source": "_source"}
    joined = claims.join(fresh, "facility_id", "left")
    return joined.select(
        *[coalesce_blank(F.col(over[c]), F.col(c)).alias(c) if c in over else F.col(c) for c in claims.columns]
    )


def search(df: DataFrame, q: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the text, case ignored; a blank text keeps all."""
    wanted = q.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.lower(F.coalesce(F.col(column), F.lit(""))).contains(wanted)
    return df.where(hit)


def facility_search(
    enriched: DataFrame, q: str = "", state: str = "all", kind: str = "all", limit: int = SEARCH_LIMIT
) -> DataFrame:
    hits = _where_all(
        search(enriched, q, ["facility_name", "source_city", "analysis_state", "analysis_district", "source_pincode"]),
        optional_eq(F.col("analysis_state"), state),
        optional_eq(F.col("facility_type"), kind),
    )
    served = hits.select(
        "facility_id", F.col("facility_name").alias("name"), "facility_type", "operator_type",
        F.col("source_city").alias("city"), F.col("analysis_state").alias("state"),
        F.col("analysis_district").alias("district"), F.col("source_pincode").alias("pincode"), "phone", "website",
        "latitude", "longitude", "description", "pincode_match_status", "district_match_status", "district_source",
        "location_confidence", "source_quality_flags",
    )
    return served.orderBy(F.asc_nulls_last("name"), "facility_id").limit(_checked(limit, SEARCH_MAX))


def record_search(
    records: DataFrame, q: str = "", state: str = "all", kind: str = "all", limit: int = SEARCH_LIMIT
) -> DataFrame:
    """The same search on the mixed record table."""
    hits = _where_all(
        search(of_type(records, "facility"), q, ["entity_name", "city", "state", "pincode"]),
        optional_eq(F.col("state"), state),
        optional_eq(F.col("facility_type"), kind),
    )
    served = hits.select(
        F.col("record_id").alias("facility_id"), F.col("entity_name").alias("name"), "facility_type",
        "operator_type", "city", "state", "pincode", "phone", "website", "latitude", "longitude", "description",
    )
    return served.orderBy(F.asc_nulls_last("name"), "facility_id").limit(_checked(limit, SEARCH_MAX))


def of_type(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("record_type") == kind)


def overview_counts(enriched: DataFrame) -> DataFrame:
    """Facilities, pincode matches, distinct matched districts, distinct states: one pass."""
    location = F.concat(F.col("analysis_state"), F.lit("|"), F.col("analysis_district"))
    return enriched.agg(
        F.count(F.lit(1)).alias("facilities"),
        F.count_if(F.col("pincode_match_status") == "matched").alias("pincodes"),
        F.countDistinct(F.when(F.col("district_match_status") == "matched", location)).alias("districts"),
        F.countDistinct("analysis_state").alias("states"),
    )


def _mean1(name: str) -> Column:
    """Mean to one decimal, computed and rounded half up as a decimal number."""
    return F.round(F.avg(F.col(name).cast("decimal(18,6)")), 1).cast("double").alias(name)


def state_summary(enriched: DataFrame, limit: int = 12) -> DataFrame:
    """Facilities, districts and mean indicators of the states with most facilities."""
    means = [_mean1(c) for c in ("institutional_birth_pct", "stunting_pct", "anaemia_pct")]
    grouped = enriched.where(F.col("analysis_state").isNotNull()).groupBy(F.col("analysis_state").alias("state"))
    counted = grouped.agg(
        F.count(F.lit(1)).alias("facilities"), F.countDistinct("analysis_district").alias("districts"), *means
    )
    return counted.orderBy(F.desc("facilities"), "state").limit(limit)


def type_summary(df: DataFrame, limit: int = 8) -> DataFrame:
    kinds = df.groupBy(F.coalesce("facility_type", F.lit("unknown")).alias("facility_type"))
    return kinds.agg(F.count(F.lit(1)).alias("facilities")).orderBy(F.desc("facilities"), "facility_type").limit(limit)


def district_summary(enriched: DataFrame, state: str = "all", limit: int = DISTRICT_LIMIT) -> DataFrame:
    """Per district its indicators and how many of its facilities matched."""
    kept = _where_all(
        enriched.where(F.col("analysis_district").isNotNull()), optional_eq(F.col("analysis_state"), state)
    )
    grouped = kept.groupBy("analysis_state", "analysis_district").agg(
        F.min("analysis_location_key").alias("district_id"),
        *[F.max(c).alias(c) for c in INDICATORS],
        F.count(F.lit(1)).alias("facilities"),
        F.count_if(F.col("pincode_match_status") == "matched").alias("pincode_matched_facilities"),
        F.count_if(F.col("district_match_status") == "matched").alias("nfhs_matched_facilities"),
    )
    top = grouped.orderBy(F.asc_nulls_last("analysis_state"), "analysis_district").limit(_checked(limit, DISTRICT_MAX))
    return top.select(
        "district_id", F.col("analysis_district").alias("district_name"), F.col("analysis_state").alias("state_ut"),
        *[F.col(c).alias(SERVED_INDICATORS.get(c, c)) for c in INDICATORS],
        "facilities", "pincode_matched_facilities", "nfhs_matched_facilities",
    )


# Served names of the indicators that are not served under their own (fixed values).
SERVED_INDICATORS = {
    "institutional_birth_pct": "institutional_birth_5y_pct",
    "improved_water_pct": "hh_improved_water_pct",
    "improved_sanitation_pct": "hh_use_improved_sanitation_pct",
    "health_insurance_pct": "hh_member_covered_health_insurance_pct",
}


def record_districts(records: DataFrame, state: str = "all", limit: int = DISTRICT_LIMIT) -> DataFrame:
    """District rows of the mixed record table, as served."""
    kept = _where_all(of_type(records, "district"), optional_eq(F.col("state"), state))
    top = kept.orderBy(F.asc_nulls_last("state"), F.asc_nulls_last("entity_name"), "record_id").limit(
        _checked(limit, DISTRICT_MAX)
    )
    return top.select(
        F.col("record_id").alias("district_id"), F.col("entity_name").alias("district_name"),
        F.col("state").alias("state_ut"), *[F.col(c).alias(SERVED_INDICATORS.get(c, c)) for c in INDICATORS],
    )


def record_overview(records: DataFrame) -> DataFrame:
    """Row counts per record type and the number of states with district rows, one pass."""
    kind = F.col("record_type")
    district_state = F.when(kind == "district", F.coalesce("state", F.lit("")))
    return records.agg(
        F.count_if(kind == "facility").alias("facilities"),
        F.count_if(kind == "pincode").alias("pincodes"),
        F.count_if(kind == "district").alias("districts"),
        F.countDistinct(district_state).alias("states"),
    )


def state_overview(records: DataFrame, limit: int = 12) -> DataFrame:
    """District statistics per state with the state's facility count, matched without case."""
    stats = of_type(records, "district").groupBy("state").agg(
        F.count(F.lit(1)).alias("districts"),
        *[_mean1(c) for c in ("institutional_birth_pct", "stunting_pct", "anaemia_pct")],
    )
    facilities = (
        of_type(records, "facility").where(F.col("state").isNotNull())
        .groupBy(F.upper("state").alias("_state")).agg(F.count(F.lit(1)).alias("facilities"))
    )
    named = stats.withColumn("state", F.coalesce("state", F.lit("Unknown")))
    joined = named.join(facilities, F.upper("state") == F.col("_state"), "left").drop("_state")
    filled = joined.withColumn("facilities", F.coalesce("facilities", F.lit(0)))
    return filled.orderBy(F.desc("facilities"), "state").limit(limit)


# ------------------------------------------------------------------ overlay


def _queue_key(state: str, district: str) -> list[Column]:
    return [F.trim(state).alias("_state"), F.trim(district).alias("_district")]


def overlay_queue(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """Queue rows with the planner's actions; an override replaces the shown score, dismissed rows stay."""
    keyed = actions.select("care_need", *_queue_key("state", "district_name"), *no_actions())
    on = ["care_need", "_state", "_district"]
    joined = queue.select("*", *_queue_key("state", "district_name")).join(keyed, on, "left")
    shown = joined.select(
        *queue.columns, *[F.coalesce(F.col(name), default).alias(name) for name, default in no_actions().items()]
    )
    display = F.coalesce(F.col("override_score").cast("double"), F.col("planning_priority_score"))
    return shown.withColumn("display_score", display).withColumns(
        {
            "priority_label": F.when(F.col("supply_score") == 0, F.lit("Info needed")).otherwise(
                band(F.col("display_score"), PRIORITY_BANDS, PRIORITY_DEFAULT)
            ),
            "badges": F.concat_ws(
                "|",
                F.when(F.col("shortlisted"), F.lit("shortlisted")),
                F.when(
                    F.col("verification_requested"),
                    F.when(F.col("supply_score") == 0, F.lit("info requested")).otherwise(F.lit("verify")),
                ),
                F.when(F.col("override_score").isNotNull(), F.lit("override")),
            ),
        }
    )


def overlay_verifications(claims: DataFrame, verifications: DataFrame) -> DataFrame:
    """Claims with the verification state of their (facility, capability)."""
    state = verifications.select("facility_id", "capability", "requested", "reason")
    joined = claims.join(state, ["facility_id", "capability"], "left")
    return joined.withColumns(
        {"requested": F.coalesce("requested", F.lit(False)), "reason": F.coalesce("reason", F.lit(""))}
    ).select(*claims.columns, "requested", "reason")


def queue_stats(overlaid: DataFrame, mode: str = "decision") -> DataFrame:
    """The three counters above the queue, from :func:`overlay_queue` rows."""
    if mode == "missing_info":
        first = F.count(F.lit(1))
        second = F.count_if(F.col("verification_requested"))
        third = F.count_if(F.col("relevant_claims") == 0)
    else:
        first = F.count_if(F.col("planning_priority_score") >= 70)
        second = F.count_if(F.col("uncertainty_label") == "missing")
        third = F.count_if(F.col("relevant_claims") > 0)
    return overlaid.agg(first.alias("high"), second.alias("missing"), third.alias("reviewable"))


# ------------------------------------------------------------------ inspection


def demo_candidates(
    districts: DataFrame, claims: DataFrame, min_claims: int = 0, max_claims: int | None = None, limit: int = 10
) -> DataFrame:
    """Districts at risk with a claim count inside the bounds: highest risk first, then weakest evidence."""
    def keys(state: str, place: str) -> list[Column]:
        return [F.coalesce(name_key(F.col(c)), F.lit("")).alias(k) for c, k in ((state, "_s"), (place, "_p"))]

    counted = (
        claims.select(*keys("state", "district_or_city"), "confidence").groupBy("_s", "_p")
        .agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("confidence") == "strong").alias("strong_claims"))
    )
    joined = districts.select("*", *keys("state", "entity_name")).join(counted, ["_s", "_p"], "left")

    def named(column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit("Unknown")).otherwise(F.col(column))

    rows = joined.select(
        named("state").alias("state"), named("entity_name").alias("district"), simple_risk().alias("risk_score"),
        F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("strong_claims", F.lit(0)).alias("strong_claims"),
        *[pct(F.col(c)).alias(c) for c in ("anaemia_pct", "stunting_pct", "institutional_birth_pct")],
    ).where((F.col("risk_score") > 0) & (F.col("claims") >= min_claims))
    if max_claims is not None:
        rows = rows.where(F.col("claims") <= max_claims)
    return rows.orderBy(F.desc("risk_score"), "strong_claims", "claims", "state", "district").limit(limit)


def with_location(records: DataFrame) -> DataFrame:
    """Facility records that can be placed: a state, and a district or a city."""
    placed = present(F.col("district")) | present(F.col("city"))
    return of_type(records, "facility").where(present(F.col("state")) & placed)


def capability_labels(claims: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Claims with the label a reviewer sees for the capability."""
    label = F.coalesce(*[F.when(F.col("capability") == c.key, F.lit(c.label)) for c in taxonomy.capabilities])
    return claims.withColumn("capability_label", F.coalesce(label, F.col("capability")))
