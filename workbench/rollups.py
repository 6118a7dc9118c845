"""Rollups, ranks and the enriched facility table."""

from __future__ import annotations

from pyspark.sql import functions as F

from needmap import config as cfg
from needmap.operators import quality as Q
from needmap.operators import review as R
from needmap.operators.rollup import canonical_pair, first_nonblank, one_per_key, pair_counts, rank_in_key, rollup_directory
from needmap.plans import enriched as E
from needmap.session import cut_lineage
from needmap.sources.writers import csv_safe

from . import sources as src
from . import sqltext as S
from .registry import query, with_ctes

C = F.col


@query("pair_counts", """
SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""")
def pairs(t):
    return pair_counts(t.lineitem, ["l_partkey"], ["l_returnflag", "l_linestatus"])


@query("canonical_pair_by_key", """
SELECT o_custkey, o_orderstatus, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus, o_orderpriority) AS r
  FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1""")
def canonical(t):
    return canonical_pair(t.orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("directory_rollup", """
WITH p AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag, l_linestatus) AS r FROM p)
SELECT l_suppkey, count(*) AS lines, array_to_string(list_sort(list(DISTINCT lineitem.l_linestatus)), ',') AS statuses,
       array_to_string(list_sort(list(DISTINCT l_linenumber::VARCHAR)), ',') AS numbers,
       sum(l_quantity::BIGINT)::DOUBLE / count(*) AS mean_quantity, any_value(b.l_returnflag) AS l_returnflag, any_value(b.l_linestatus) AS l_linestatus
FROM lineitem JOIN (SELECT l_suppkey, l_returnflag, l_linestatus FROM b WHERE r = 1) AS b USING (l_suppkey) GROUP BY l_suppkey""")
def directory(t):
    lines = t.lineitem.select(
        "l_suppkey", "l_returnflag", "l_linestatus", C("l_linenumber").cast("string").alias("number"), C("l_quantity").cast("long").alias("quantity")
    )
    rolled = rollup_directory(
        lines, ["l_suppkey"], ["l_returnflag", "l_linestatus"], {"statuses": "l_linestatus", "numbers": "number"},
        {"mean_quantity": "quantity"}, "lines",
    )
    return rolled.withColumns({c: F.array_join(c, ",") for c in ("statuses", "numbers")})


@query("one_per_key", """
SELECT p_brand, p_type, p_size, p_name, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_name, p_partkey) AS r FROM part) WHERE r = 1""")
def one_row(t):
    return one_per_key(t.part.select("p_brand", "p_type", "p_size", "p_name", "p_partkey"), ["p_brand", "p_type"])


@query("first_nonblank", """
SELECT user_id, arg_min(a, event_id) FILTER (a IS NOT NULL) AS a, arg_min(b, event_id) FILTER (b IS NOT NULL) AS b
FROM (SELECT *, CASE WHEN event_type <> 'click' THEN value END AS a, CASE WHEN value > 60 THEN event_type END AS b FROM events) GROUP BY user_id""")
def first_values(t):
    rows = t.events.withColumns(
        {"a": F.when(C("event_type") != "click", C("value")), "b": F.when(C("value") > 60, C("event_type"))}
    )
    return first_nonblank(rows, ["user_id"], ["a", "b"], ["event_id"])


@query("dedupe_ranked", """
SELECT *, count(*) OVER (PARTITION BY event_type) AS copies, row_number() OVER (PARTITION BY event_type ORDER BY signature)::INT AS number
FROM (SELECT DISTINCT event_type, user_id, sha256(event_type || '||' || user_id) AS signature FROM events)""")
def dedupe(t):
    from needmap.functions import row_signature

    distinct = t.events.select("event_type", "user_id").distinct()
    signed = distinct.withColumn("signature", row_signature(["event_type", "user_id"]))
    return rank_in_key(signed, "event_type", "signature", "copies", "number")


# ---------------------------------------------------------------- facilities, directory, districts

_UUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
_TYPES = ", ".join(S.quote(x) for x in cfg.EXPECTED_FACILITY_TYPES)
_OPERATORS = ", ".join(S.quote(x) for x in cfg.EXPECTED_OPERATOR_TYPES)

FLAGGED_SQL = f"""
SELECT source_unique_id, facility_name, raw_facility_type, {S.first_rule('lower(raw_facility_type)', cfg.FACILITY_TYPE_RULES)} AS facility_type,
       raw_operator_type, {S.first_rule('lower(raw_operator_type)', cfg.OPERATOR_TYPE_RULES)} AS operator_type,
       NULL::VARCHAR AS phone, NULL::VARCHAR AS website, own_description, source_state, NULL::VARCHAR AS source_district,
       source_city, source_pincode, {S.digits('source_pincode')} AS pincode_key, latitude, longitude
FROM (
  SELECT {S.clean('unique_id')} AS source_unique_id,
         {S.clean("CASE WHEN name LIKE '{%' THEN json_extract_string(name, '$.name') ELSE name END")} AS facility_name,
         {S.clean('facilityTypeId')} AS raw_facility_type, {S.clean('operatorTypeId')} AS raw_operator_type,
         {S.clean('description')} AS own_description, {S.clean('address_stateOrRegion')} AS source_state, {S.clean('address_city')} AS source_city,
         {S.clean('address_zipOrPostcode')} AS source_pincode, {S.number('latitude')} AS latitude, {S.number('longitude')} AS longitude
  FROM fac)"""

DESCRIBED_SQL = f"""
SELECT source_unique_id, facility_name, raw_facility_type, facility_type, raw_operator_type, operator_type, phone, website,
       coalesce(own_description, {S.listing('facility_name', 'facility_type', 'operator_type', 'source_city', 'source_state', 'source_pincode')}) AS description,
       source_state, source_district, source_city, source_pincode, pincode_key, latitude, longitude,
       concat_ws('|', CASE WHEN NOT regexp_matches(source_unique_id, {_UUID}) THEN 'invalid_facility_id' END,
         CASE WHEN facility_name IS NULL THEN 'blank_facility_name' END, CASE WHEN source_pincode IS NULL THEN 'missing_pincode' END,
         CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinates' END,
         CASE WHEN lower(raw_facility_type) NOT IN ({_TYPES}) THEN 'unexpected_facility_type' END,
         CASE WHEN lower(raw_operator_type) NOT IN ({_OPERATORS}) THEN 'unexpected_operator_type' END) AS source_quality_flags
FROM flagged"""

_BASE = (
    "source_unique_id", "facility_name", "raw_facility_type", "facility_type", "raw_operator_type", "operator_type", "phone", "website",
    "description", "source_state", "source_district", "source_city", "source_pincode", "pincode_key", "latitude", "longitude",
    "source_quality_flags",
)
CLEAN_SQL = f"""
SELECT 'facility:' || source_unique_id || CASE WHEN n > 1 THEN ':dup-' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END ELSE '' END AS facility_id,
       * EXCLUDE (n, r, source_quality_flags), n AS source_duplicate_count, r::INT AS source_duplicate_rank,
       concat_ws('|', nullif(source_quality_flags, ''), CASE WHEN n > 1 THEN 'duplicate_source_unique_id' END) AS source_quality_flags
FROM (
  SELECT *, count(*) OVER (PARTITION BY source_unique_id) AS n,
         row_number() OVER (PARTITION BY source_unique_id ORDER BY source_row_signature) AS r
  FROM (SELECT *, sha256(concat_ws('||', {', '.join(f"coalesce({c}::VARCHAR, '')" for c in _BASE)})) AS source_row_signature
        FROM (SELECT DISTINCT * FROM described WHERE regexp_matches(source_unique_id, {_UUID}) AND facility_name IS NOT NULL)))"""

DIRECTORY_ROWS_SQL = f"""
SELECT {S.digits(S.clean('pincode'))} AS pincode_key, {S.clean('statename')} AS pincode_state, {S.clean('district')} AS pincode_district,
       {S.clean('officename')} AS office_name, {S.clean('officetype')} AS office_type, {S.clean('delivery')} AS delivery,
       {S.clean('circlename')} AS circle_name, {S.number('latitude')} AS lat, {S.number('longitude')} AS lon
FROM dir"""

_LISTS = {"pincode_office_names": "office_name", "pincode_office_types": "office_type", "pincode_delivery_values": "delivery", "pincode_circle_names": "circle_name"}
ROLLUP_SQL = f"""
SELECT pincode_key, count(*) AS pincode_office_count,
       {', '.join(f"to_json(coalesce(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), []))::VARCHAR AS {o}" for o, c in _LISTS.items())},
       '[]' AS pincode_region_names, '[]' AS pincode_division_names,
       round(sum(lat::DECIMAL(18,2))::DOUBLE / count(lat), 6) AS pincode_latitude, sum(lon::BIGINT)::DOUBLE / count(lon) AS pincode_longitude,
       any_value(s) AS pincode_state, any_value(d) AS pincode_district,
       CASE WHEN any_value(s) IS NULL THEN 'missing_location' ELSE 'matched' END AS pincode_match_status
FROM dirrows LEFT JOIN (
  SELECT pincode_key, pincode_state AS s, pincode_district AS d,
         row_number() OVER (PARTITION BY pincode_key ORDER BY count(*) DESC, pincode_state, pincode_district) AS r
  FROM dirrows WHERE pincode_state IS NOT NULL AND pincode_district IS NOT NULL GROUP BY pincode_key, pincode_state, pincode_district) AS best USING (pincode_key)
WHERE pincode_key IS NOT NULL AND coalesce(r, 1) = 1 GROUP BY pincode_key"""

CLEAN_DISTRICTS_SQL = f"""
SELECT *, {S.name_key('district_state')} AS district_state_key, {S.name_key('district_name')} AS district_name_key FROM (
  SELECT {S.clean('state_ut')} AS district_state, {S.clean('district_name')} AS district_name, {S.number('households_surveyed')} AS households_surveyed,
         {S.number('institutional_birth_5y_pct')} AS institutional_birth_pct, {S.number('child_u5_who_are_stunted_height_for_age_18_pct')} AS stunting_pct,
         {S.number('all_w15_49_who_are_anaemic_pct')} AS anaemia_pct, {S.number('hh_improved_water_pct')} AS improved_water_pct,
         {S.number('hh_use_improved_sanitation_pct')} AS improved_sanitation_pct, {S.number('hh_member_covered_health_insurance_pct')} AS health_insurance_pct
  FROM dist)"""

_IND = ", ".join(cfg.INDICATORS)
ENRICHED_SQL = f"""
SELECT * EXCLUDE (state_key, district_key, district_state_key, district_name_key, ps, inferred),
       CASE WHEN inferred THEN 'matched' ELSE 'missing' END AS pincode_match_status,
       CASE district_source WHEN 'pincode_inferred' THEN 0.85::DOUBLE WHEN 'source_district' THEN 1.0::DOUBLE WHEN 'city_fallback' THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS location_confidence,
       concat_ws('|', state_key, district_key) AS analysis_location_key,
       CASE WHEN district_name IS NOT NULL THEN 'matched' WHEN analysis_district IS NOT NULL THEN 'missing_nfhs' ELSE 'missing_location' END AS district_match_status,
       concat_ws(' ', description, 'District health indicators for ' || district_name || ', ' || district_state || '.',
         'Institutional birth rate: ' || institutional_birth_pct || '%.', 'Child stunting: ' || stunting_pct || '%.', 'Anaemia: ' || anaemia_pct || '%.',
         'Health insurance coverage: ' || health_insurance_pct || '%.') AS facility_profile_text
FROM (
  SELECT *, {S.name_key(S.clean('analysis_state'))} AS state_key, {S.name_key(S.clean('analysis_district'))} AS district_key FROM (
    SELECT * EXCLUDE (pincode_state), ps AS pincode_state, coalesce(ps, {S.canonical_state('source_state')}) AS analysis_state,
           CASE WHEN inferred THEN pincode_district ELSE coalesce(source_district, source_city) END AS analysis_district,
           CASE WHEN inferred THEN 'pincode_inferred' WHEN source_district IS NOT NULL THEN 'source_district'
                WHEN source_city IS NOT NULL THEN 'city_fallback' ELSE 'missing_location' END AS district_source
    FROM (SELECT *, ps IS NOT NULL AND pincode_district IS NOT NULL AS inferred FROM (
            SELECT *, {S.canonical_state('pincode_state')} AS ps FROM cleaned LEFT JOIN (SELECT * EXCLUDE (pincode_match_status) FROM rolled) USING (pincode_key)))))
LEFT JOIN districts ON state_key = district_state_key AND district_key = district_name_key"""

CTES = dict(
    fac=src.FACILITIES_SQL, dir=src.DIRECTORY_SQL, dist=src.DISTRICTS_SQL, flagged=FLAGGED_SQL, described=DESCRIBED_SQL,
    cleaned=CLEAN_SQL, dirrows=DIRECTORY_ROWS_SQL, rolled=ROLLUP_SQL, districts=CLEAN_DISTRICTS_SQL, enriched=ENRICHED_SQL,
)


def as_of():
    return F.lit("2024-01-01").cast("timestamp")


def enriched_table(t):
    return E.enrich(src.facilities(t), src.directory(t), src.districts(t), as_of=as_of())


def flat(df):
    """Lists as JSON text, the one mean of long decimals rounded: forms both engines print alike."""
    flat = csv_safe(df)
    return flat.withColumn("pincode_latitude", F.round("pincode_latitude", 6)) if "pincode_latitude" in df.columns else flat


@query("clean_facilities", with_ctes("SELECT * FROM cleaned", **{k: CTES[k] for k in ("fac", "flagged", "described", "cleaned")}))
def clean_facilities(t):
    return E.clean_facilities(src.facilities(t))


@query("facility_flags", with_ctes(
    "SELECT source_quality_flags, count(*) AS rows FROM described GROUP BY ALL", **{k: CTES[k] for k in ("fac", "flagged", "described")}))
def facility_flags(t):
    return E.flagged_facilities(src.facilities(t)).groupBy("source_quality_flags").agg(F.count(F.lit(1)).alias("rows"))


@query("pincode_rollup", with_ctes("SELECT * FROM rolled", **{k: CTES[k] for k in ("dir", "dirrows", "rolled")}))
def pincode_rollup(t):
    return flat(E.pincode_rollup(src.directory(t)))


@query("clean_districts", with_ctes("SELECT * FROM districts", **{k: CTES[k] for k in ("dist", "districts")}))
def clean_districts(t):
    return E.clean_districts(src.districts(t))


@query("enriched_facilities", with_ctes("SELECT * FROM enriched", **CTES))
def enriched_facilities(t):
    return flat(enriched_table(t).drop("created_at"))


@query("match_report", with_ctes("""
SELECT 'pincode_match_status' AS field, pincode_match_status AS value, count(*) AS rows FROM enriched GROUP BY ALL
UNION ALL SELECT 'district_match_status', district_match_status, count(*) FROM enriched GROUP BY ALL
UNION ALL SELECT 'district_source', district_source, count(*) FROM enriched GROUP BY ALL""", **CTES))
def match_report(t):
    return Q.match_report(enriched_table(t), ["pincode_match_status", "district_match_status", "district_source"])


@query("duplicates", with_ctes("SELECT source_unique_id, count(*) AS rows FROM cleaned GROUP BY ALL HAVING count(*) > 1", **{k: CTES[k] for k in ("fac", "flagged", "described", "cleaned")}))
def duplicates(t):
    return Q.duplicates(E.clean_facilities(src.facilities(t)), ["source_unique_id"])


@query("noncanonical", with_ctes(f"""
SELECT address_stateOrRegion, count(*) AS rows FROM fac
WHERE address_stateOrRegion NOT IN ({', '.join(S.quote(x) for x in cfg.STATES)}) GROUP BY ALL""", fac=src.FACILITIES_SQL))
def noncanonical(t):
    return Q.noncanonical(src.facilities(t), "address_stateOrRegion")


@query("grain_check", with_ctes("""
SELECT count(*) AS rows, count(*) - count(DISTINCT facility_id) AS duplicates, 0 AS noncanonical, (SELECT count(*) FROM cleaned) AS expected FROM enriched""", **CTES))
def grain_check(t):
    facilities = cut_lineage(E.clean_facilities(src.facilities(t)))  # the check and the enrichment read the same rows
    got = E.check_enriched(facilities, E.enrich_cleaned(facilities, src.directory(t), src.districts(t), as_of=as_of()))
    return t.spark.createDataFrame([got], "rows long, duplicates long, noncanonical long, expected long")


@query("overview", with_ctes("""
SELECT count(*) AS facilities, count(*) FILTER (pincode_match_status = 'matched') AS pincodes,
       count(DISTINCT analysis_state || '|' || analysis_district) FILTER (district_match_status = 'matched') AS districts,
       count(DISTINCT analysis_state) AS states FROM enriched""", **CTES))
def overview(t):
    return R.overview_counts(enriched_table(t))


# Half-up mean of one-decimal indicators in whole tenths
_MEANS = ", ".join(f"((2 * sum(round({c} * 10)::BIGINT) + count({c})) // (2 * count({c})))::DOUBLE / 10.0::DOUBLE AS {c}" for c in ("institutional_birth_pct", "stunting_pct", "anaemia_pct"))


@query("state_summary", with_ctes(f"""
SELECT analysis_state AS state, count(*) AS facilities, count(DISTINCT analysis_district) AS districts, {_MEANS}
FROM enriched WHERE analysis_state IS NOT NULL GROUP BY ALL ORDER BY facilities DESC, state LIMIT 12""", **CTES))
def state_summary(t):
    return R.state_summary(enriched_table(t))


@query("type_summary", with_ctes("""
SELECT coalesce(facility_type, 'unknown') AS facility_type, count(*) AS facilities FROM enriched GROUP BY ALL
ORDER BY facilities DESC, facility_type LIMIT 8""", **CTES))
def type_summary(t):
    return R.type_summary(enriched_table(t))


_SERVED = ", ".join(f"max({c}) AS {R.SERVED_INDICATORS.get(c, c)}" for c in cfg.INDICATORS)


@query("district_summary", with_ctes(f"""
SELECT min(analysis_location_key) AS district_id, analysis_district AS district_name, analysis_state AS state_ut, {_SERVED}, count(*) AS facilities,
       count(*) FILTER (pincode_match_status = 'matched') AS pincode_matched_facilities,
       count(*) FILTER (district_match_status = 'matched') AS nfhs_matched_facilities
FROM enriched WHERE analysis_district IS NOT NULL GROUP BY analysis_state, analysis_district
ORDER BY analysis_state NULLS LAST, analysis_district LIMIT 50""", **CTES))
def district_summary(t):
    return R.district_summary(enriched_table(t))


@query("facility_search", with_ctes("""
SELECT facility_id, facility_name AS name, facility_type, operator_type, source_city AS city, analysis_state AS state, analysis_district AS district,
       source_pincode AS pincode, phone, website, latitude, longitude, description, pincode_match_status, district_match_status, district_source,
       location_confidence, source_quality_flags
FROM enriched WHERE (contains(lower(coalesce(facility_name, '')), 'urgent') OR contains(lower(coalesce(source_city, '')), 'urgent')
  OR contains(lower(coalesce(analysis_state, '')), 'urgent') OR contains(lower(coalesce(analysis_district, '')), 'urgent')
  OR contains(lower(coalesce(source_pincode, '')), 'urgent')) AND analysis_state = 'Odisha'
ORDER BY facility_name NULLS LAST, facility_id LIMIT 25""", **CTES))
def facility_search(t):
    return R.facility_search(enriched_table(t), " Urgent", "Odisha")
