"""Per-location scores of a need: risk, supply, scarcity, evidence strength, data quality, priority."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    CONFIDENCE_WEIGHT, FACILITY_COUNTS, GAP_FIELDS, NEEDS, PLACES, PRIORITY_BANDS, PRIORITY_DEFAULT, SOURCE_WEIGHT,
    UNKNOWN_SOURCE_WEIGHT, Need, Places,
)
from ..functions import (
    band, canonical, canonical_in_scope, clamp, fmt1, label_weight, name_key, round1, strip, weighted_mean_present,
)

CLAIM_COUNTS = (
    "relevant_claims", "strong_claims", "partial_claims", "weak_claims", "conflicting_claims",
    "pincode_inferred_claims", "city_fallback_claims", "missing_location_claims",
)


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _per_need(needs: Sequence[Need], build) -> Column:
    """One expression chosen by the row's ``care_need``."""
    return F.coalesce(*[F.when(F.col("care_need") == n.key, build(n)) for n in needs])


def _capabilities(needs: Sequence[Need]) -> list[str]:
    return list(dict.fromkeys(c for n in needs for c in n.capabilities))


def place_keys(state: Column, district: Column, places: Places = PLACES) -> tuple[Column, Column, Column]:
    """(state label, state key, district key), blank where unknown."""
    label = F.coalesce(canonical(state, places.states), F.coalesce(state, F.lit("")))
    key = F.coalesce(name_key(label), F.lit(""))
    return label, key, F.coalesce(name_key(canonical_in_scope(label, district, places)), F.lit(""))


def _weights(table: dict[str, str]) -> dict[str, Decimal]:
    return {label: Decimal(weight) for label, weight in table.items()}


def claim_signals(claims: DataFrame, needs: Sequence[Need] = NEEDS, places: Places = PLACES) -> DataFrame:
    """Per (need, location): weighted supply, the same and the claim count per capability, claim counts.

    Weights are decimals, so sums do not depend on how the rows are partitioned. Counts and sums
    combine before the shuffle: a location that holds much of the table costs no more than any other.
    """
    _, state_key, district_key = place_keys(F.col("state"), F.col("district_or_city"), places)
    weight = label_weight(F.col("confidence"), _weights(CONFIDENCE_WEIGHT), Decimal("0.00")) * label_weight(
        F.col("district_source"), _weights(SOURCE_WEIGHT), Decimal(UNKNOWN_SOURCE_WEIGHT)
    )
    wanting = F.filter(
        F.array(*[F.when(F.col("capability").isin(*n.capabilities), F.lit(n.key)) for n in needs]),
        lambda need: need.isNotNull(),
    )
    base = claims.select(
        F.explode(wanting).alias("care_need"),
        state_key.alias("state_key"),
        district_key.alias("district_key"),
        "capability", "confidence", "district_source",
        weight.alias("weight"),
    )

    def number_of(column: str, label: str) -> Column:
        return F.count_if(F.col(column) == label)

    of = {c: F.col("capability") == c for c in _capabilities(needs)}
    return base.groupBy("care_need", "state_key", "district_key").agg(
        F.sum("weight").alias("weighted_supply"),
        *[F.sum(F.when(hit, F.col("weight"))).alias(f"supply_{c}") for c, hit in of.items()],
        *[F.count_if(hit).alias(f"claims_{c}") for c, hit in of.items()],
        F.count(F.lit(1)).alias("relevant_claims"),
        number_of("confidence", "strong").alias("strong_claims"),
        number_of("confidence", "partial").alias("partial_claims"),
        number_of("confidence", "weak").alias("weak_claims"),
        number_of("confidence", "conflicting").alias("conflicting_claims"),
        number_of("district_source", "pincode_inferred").alias("pincode_inferred_claims"),
        number_of("district_source", "city_fallback").alias("city_fallback_claims"),
        number_of("district_source", "missing_location").alias("missing_location_claims"),
    )


def facility_signals(records: DataFrame, places: Places = PLACES) -> DataFrame:
    """Facilities per location, in all and by type."""
    place = F.when(F.coalesce("district", F.lit("")) != "", F.col("district")).otherwise(F.col("city"))
    label, state_key, district_key = place_keys(F.col("state"), place, places)
    kind = F.lower(strip(F.col("facility_type")))
    located = (
        records.where(F.col("record_type") == "facility")
        .select(
            label.alias("label"), canonical_in_scope(label, place, places).alias("place"), kind.alias("kind"),
            state_key.alias("state_key"), district_key.alias("district_key"),
        )
        .where((F.col("label") != "") & (F.col("place") != ""))
    )
    return located.groupBy("state_key", "district_key").agg(
        F.count(F.lit(1)).alias("total_facilities"),
        *[F.count_if(F.col("kind") == label).alias(name) for name, label in FACILITY_COUNTS.items()],
    )


def signals(
    records: DataFrame, claims: DataFrame, needs: Sequence[Need] = NEEDS, places: Places = PLACES
) -> DataFrame:
    """Every district x need with its claim and facility signals, absent ones 0."""
    label, state_key, district_key = place_keys(F.col("state"), F.col("entity_name"), places)
    districts = records.where(F.col("record_type") == "district").select(
        F.coalesce("record_id", F.lit("")).alias("district_id"),
        F.coalesce("entity_name", F.lit("")).alias("district_name"),
        (F.coalesce("state", F.lit("")) != "").alias("has_state"),
        label.alias("state"), state_key.alias("state_key"), district_key.alias("district_key"),
        *dict.fromkeys(name for n in needs for name, _, _ in n.risk),
    )
    expanded = districts.withColumn("care_need", F.explode(F.array(*[F.lit(n.key) for n in needs])))
    at = ["state_key", "district_key"]
    joined = expanded.join(claim_signals(claims, needs, places), ["care_need", *at], "left").join(
        facility_signals(records, places), at, "left"
    )
    counts = [*CLAIM_COUNTS, *[f"claims_{c}" for c in _capabilities(needs)], "total_facilities", *FACILITY_COUNTS]
    sums = ["weighted_supply", *[f"supply_{c}" for c in _capabilities(needs)]]
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
        | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in sums}
    )


def risk(need: Need) -> Column:
    """Mean of the need's indicators (or their gaps to 100), weights of absent ones spread over the rest."""
    return weighted_mean_present(
        [((F.lit(100.0) - F.col(name)) if gap else F.col(name), weight) for name, weight, gap in need.risk]
    )


def presence_floor(need: Need) -> Column:
    """What the mere presence of facilities is worth; 0 without facilities."""
    terms = [
        F.least(F.lit(cap), _sum([F.col(c) for c in columns]) * F.lit(slope)) for cap, slope, columns in need.floor
    ]
    return F.when(F.col("total_facilities") == 0, F.lit(0.0)).otherwise(F.least(F.lit(need.floor_cap), _sum(terms)))


def supply(need: Need) -> Column:
    """Claimed supply, at least the presence floor. Six strong, well-placed, unit-weight claims make 100."""
    claimed = _sum([F.col(f"supply_{c}") * F.lit(w) for c, w in need.supply.items()]) * F.lit(100.0 / 6.0)
    from_claims = F.when(F.col("relevant_claims") > 0, F.least(F.lit(100.0), claimed)).otherwise(F.lit(0.0))
    return F.greatest(from_claims, presence_floor(need))


def scarcity(need: Need, supply_score: Column) -> Column:
    missing_core = _sum([F.lit(0), *[F.when(F.col(f"claims_{c}") == 0, F.lit(1)).otherwise(F.lit(0)) for c in need.core]])
    no_claims = F.when(F.col("relevant_claims") == 0, F.lit(10.0)).otherwise(F.lit(0.0))
    return clamp(F.lit(100.0) - supply_score + missing_core * F.lit(need.missing_core_penalty) + no_claims)


def evidence_strength() -> Column:
    strength = F.least(F.lit(100.0), F.col("weighted_supply") * F.lit(20.0))
    strong_share = F.try_divide(F.col("strong_claims"), F.col("relevant_claims"))
    penalty = F.least(F.lit(20.0), F.col("city_fallback_claims") * F.lit(5.0)) + F.least(
        F.lit(35.0), F.col("missing_location_claims") * F.lit(10.0)
    )
    score = clamp(strength * 0.7 + strong_share * 100.0 * 0.3 - penalty)
    return F.when(F.col("relevant_claims") == 0, F.lit(0.0)).otherwise(score)


def _nothing_known() -> Column:
    return (F.col("relevant_claims") == 0) & (F.col("total_facilities") == 0)


def data_quality() -> Column:
    def lost(condition: Column, points: float) -> Column:
        return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))

    return clamp(
        F.lit(100.0)
        - lost(~F.col("has_state"), 25.0)
        - lost(F.col("district_name") == "", 25.0)
        - lost(_nothing_known(), 20.0)
        - F.least(F.lit(25.0), F.col("city_fallback_claims") * F.lit(5.0))
        - F.least(F.lit(40.0), F.col("missing_location_claims") * F.lit(10.0))
    )


def uncertainty_label(quality: Column) -> Column:
    strong, partial = F.col("strong_claims"), F.col("partial_claims")
    return (
        F.when(_nothing_known(), F.lit("missing"))
        .when(F.col("conflicting_claims") > 0, F.lit("conflicting"))
        .when((quality < 65) | (F.col("city_fallback_claims") > 0) | (F.col("missing_location_claims") > 0), F.lit("weak"))
        .when((strong >= 2) & (strong >= partial), F.lit("strong"))
        .when((strong > 0) | (partial > 0), F.lit("partial"))
        .otherwise(F.lit("weak"))
    )


def priority(risk_score: Column, scarcity_score: Column, evidence_score: Column, quality_score: Column) -> Column:
    return clamp(
        risk_score * 0.50
        + scarcity_score * 0.30
        + (F.lit(100.0) - evidence_score) * 0.15
        + (F.lit(100.0) - quality_score) * 0.05
    )


def explanation() -> Column:
    """Sentence a reviewer reads, from the unrounded score columns."""
    level = band(F.col("priority"), [(low, f"{label} planning priority") for low, label in PRIORITY_BANDS], PRIORITY_DEFAULT)
    claims, facilities = F.col("relevant_claims"), F.col("total_facilities")
    note = (
        F.when(
            (claims == 0) & (facilities > 0),
            F.format_string(
                "No capability-specific claims were found, but %d facilities provide a weak general supply floor.",
                facilities,
            ),
        )
        .when(claims == 0, F.lit("No relevant facility claims were found for this care need."))
        .otherwise(
            F.format_string(
                "Found %d relevant claimed capabilities (%d strong, %d partial).",
                claims, F.col("strong_claims"), F.col("partial_claims"),
            )
        )
    )
    return F.concat(
        level, F.lit(": health-risk signal is "), fmt1(F.col("risk")),
        F.lit("/100, claimed supply signal is "), fmt1(F.col("supply")),
        F.lit("/100, and evidence strength is "), fmt1(F.col("evidence")), F.lit("/100. "),
        note,
        F.lit(" Overall evidence label is "), F.col("uncertainty_label"),
        F.lit("; review cited facility text before making an intervention decision."),
    )


def scores(signal_rows: DataFrame, needs: Sequence[Need] = NEEDS) -> DataFrame:
    """Adds the unrounded scores, the label and the explanation to :func:`signals` rows."""
    rated = signal_rows.withColumns(
        {
            "risk": _per_need(needs, risk),
            "supply": _per_need(needs, supply),
            "evidence": evidence_strength(),
            "quality": data_quality(),
        }
    )
    rated = rated.withColumn("scarcity", _per_need(needs, lambda n: scarcity(n, F.col("supply"))))
    rated = rated.withColumns(
        {
            "priority": priority(F.col("risk"), F.col("scarcity"), F.col("evidence"), F.col("quality")),
            "uncertainty_label": uncertainty_label(F.col("quality")),
        }
    )
    return rated.withColumn("explanation", explanation())


def score_gaps(
    records: DataFrame,
    claims: DataFrame,
    needs: Sequence[Need] = NEEDS,
    places: Places = PLACES,
    as_of: Column | None = None,
) -> DataFrame:
    """Planning-priority row per (district, need); scores to one decimal, as served."""
    rated = scores(signals(records, claims, needs, places), needs)
    served = {
        "planning_priority_score": round1(F.col("priority")),
        "risk_score": round1(F.col("risk")),
        "supply_score": round1(F.col("supply")),
        "evidence_score": round1(F.col("evidence")),
        "data_quality_score": round1(F.col("quality")),
        "updated_at": F.current_timestamp() if as_of is None else as_of,
    }
    plain = ("district_id", "district_name", "state", "care_need")
    row = F.struct(*[served[c].alias(c) if c in served else F.col(c) for c in GAP_FIELDS if c not in plain])
    # The computed columns come out of a one-row generator, so that filters on the served scores are evaluated on them:
    # through a projection the optimizer would push them down by substituting the whole scoring expression. The keys stay
    # outside, and filters on them reach the rows before they are scored.
    return rated.select(*plain, F.inline(F.array(row))).select(*GAP_FIELDS)


def rank_gaps(gaps: DataFrame) -> DataFrame:
    """Within a need by priority, ties by district id."""
    return gaps.orderBy("care_need", F.desc("planning_priority_score"), "district_id")


def simple_risk() -> Column:
    """Anaemia + stunting + births outside institutions, 0 when none is known."""
    births = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("institutional_birth_pct"))
    return _sum([F.coalesce(c, F.lit(0.0)) for c in (F.col("anaemia_pct"), F.col("stunting_pct"), births)])


def evidence_summary(claims: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sentence that counts the claims of a group by strength."""
    counts = claims.groupBy(*group).agg(
        F.count_if(F.col("confidence") == "strong").alias("strong"),
        F.count_if(F.col("confidence") == "partial").alias("partial"),
        F.count_if(F.col("confidence").isin("weak", "missing", "conflicting")).alias("weak"),
    )
    text = F.format_string(
        "Evidence summary: %d strong claims, %d partial claims, and %d weak or missing claims. "
        "Verify weak claims before action.",
        "strong", "partial", "weak",
    )
    return counts.select(*group, text.alias("summary"))
