"""Source tables of the planning domain, derived from the given tables: in Spark and as SQL.

* facilities: one row per customer. The id comes from (nation, segment), so ids repeat; customers
  in debt carry an id that is no uuid.
* directory: one row per order. The customer number is the pincode, status and priority are the place.
* districts: one row per (status, priority) with indicators as text, the way the survey prints them.
* documents: facility records with free text, district records per (language, source) and per nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needmap.config import Capability, Taxonomy

from .registry import Tables

# Spelling of a state by nation number (some are unknown to the alias table).
NATION_STATES = (
    "Orissa", "U P", "tamilnadu", "Atlantis", "Kerala", "Jammu and Kashmir", "NCT of Delhi", "Karnataka", "Bihar",
    "maharastra", "West Bengal", "Goa", "pondicherry", "Punjab", "Assam", "Lemuria", "Sikkim", "uttaranchal",
    "Gujarat", "Chattisgarh", "Haryana", "Manipur", "daman & diu", "Ladakh", "Tripura",
)
SEGMENT_TYPES = {
    "MACHINERY": "Nursing Home", "BUILDING": "Diagnostic  Lab", "AUTOMOBILE": "physician",
    "HOUSEHOLD": "nursing_home", "FURNITURE": "Spa",
}
STATUS_STATES = {"F": "ORISSA", "O": "Karnataka", "P": "Atlantis"}
LANG_STATES = {"en": "Kerala", "fr": "Orissa", "de": "Bihar", "es": "Atlantis"}


def pick(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in table.items()])


def pick_sql(value: str, table: dict[str, str]) -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def nation_state(number: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in NATION_STATES]), number.cast("int") + 1)


NATION_STATE_SQL = "[" + ", ".join(f"'{s}'" for s in NATION_STATES) + "][{0} + 1]"


def uuid_of(text: Column) -> Column:
    h = F.md5(text)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid_sql(text: str) -> str:
    h = f"md5({text})"
    return "concat_ws('-', " + ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def facilities(t: Tables) -> DataFrame:
    c = F.col
    return t.customer.select(
        F.when(c("c_acctbal") < 0, c("c_name"))
        .otherwise(uuid_of(F.concat_ws("/", c("c_nationkey").cast("string"), "c_mktsegment")))
        .alias("unique_id"),
        F.when(c("c_nationkey") < 5, F.concat(F.lit('{"name": "'), "c_name", F.lit('"}')))
        .otherwise(F.concat(F.lit("  "), "c_name", F.lit("  Centre ")))
        .alias("name"),
        nation_state(c("c_nationkey")).alias("address_stateOrRegion"),
        F.when(c("c_nationkey") != 7, F.initcap(F.lower("c_mktsegment"))).alias("address_city"),
        F.when(c("c_acctbal") <= 9000, F.concat(F.lit("PIN "), F.lpad(c("c_custkey").cast("string"), 8, "0")))
        .alias("address_zipOrPostcode"),
        F.concat(F.lit("("), c("c_acctbal").cast("string"), F.lit(")")).alias("latitude"),
        F.when(c("c_nationkey") != 9, c("c_nationkey").cast("string")).otherwise(F.lit("n/a")).alias("longitude"),
        pick(c("c_mktsegment"), SEGMENT_TYPES).alias("facilityTypeId"),
        F.when(c("c_nationkey") < 8, F.lit("Govt")).when(c("c_nationkey") < 16, F.lit("private trust"))
        .otherwise(F.lit("null")).alias("operatorTypeId"),
        F.when(c("c_nationkey") == 11, F.concat(F.lit("Open  daily, "), "c_name")).alias("description"),
    )


FACILITIES_SQL = f"""
SELECT CASE WHEN c_acctbal < 0 THEN c_name ELSE {uuid_sql("concat_ws('/', c_nationkey::VARCHAR, c_mktsegment)")} END AS unique_id,
       CASE WHEN c_nationkey < 5 THEN '{{"name": "' || c_name || '"}}' ELSE '  ' || c_name || '  Centre ' END AS name,
       {NATION_STATE_SQL.format('c_nationkey')} AS address_stateOrRegion,
       CASE WHEN c_nationkey <> 7 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS address_city,
       CASE WHEN c_acctbal <= 9000 THEN 'PIN ' || lpad(c_custkey::VARCHAR, 8, '0') END AS address_zipOrPostcode,
       '(' || c_acctbal::VARCHAR || ')' AS latitude,
       CASE WHEN c_nationkey <> 9 THEN c_nationkey::VARCHAR ELSE 'n/a' END AS longitude,
       {pick_sql('c_mktsegment', SEGMENT_TYPES)} AS facilityTypeId,
       CASE WHEN c_nationkey < 8 THEN 'Govt' WHEN c_nationkey < 16 THEN 'private trust' ELSE 'null' END AS operatorTypeId,
       CASE WHEN c_nationkey = 11 THEN 'Open  daily, ' || c_name END AS description
FROM customer"""


def directory(t: Tables) -> DataFrame:
    c = F.col
    return t.orders.select(
        F.lpad(c("o_custkey").cast("string"), 8, "0").alias("pincode"),
        pick(c("o_orderstatus"), STATUS_STATES).alias("statename"),
        F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("district"),
        F.concat(F.lit("Office "), F.year("o_orderdate").cast("string")).alias("officename"),
        c("o_orderstatus").alias("officetype"),
        F.substring("o_orderpriority", 3, 100).alias("delivery"),
        F.lit("Circle").alias("circlename"),
        F.when(c("o_totalprice") < 1000, F.lit("NaN")).otherwise(c("o_totalprice").cast("string")).alias("latitude"),
        F.month("o_orderdate").cast("string").alias("longitude"),
    )


DIRECTORY_SQL = f"""
SELECT lpad(o_custkey::VARCHAR, 8, '0') AS pincode, {pick_sql('o_orderstatus', STATUS_STATES)} AS statename,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS district,
       'Office ' || year(o_orderdate)::VARCHAR AS officename, o_orderstatus AS officetype,
       substr(o_orderpriority, 3) AS delivery, 'Circle' AS circlename,
       CASE WHEN o_totalprice < 1000 THEN 'NaN' ELSE o_totalprice::VARCHAR END AS latitude,
       month(o_orderdate)::VARCHAR AS longitude
FROM orders"""


def districts(t: Tables) -> DataFrame:
    c = F.col
    grouped = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.month("o_orderdate")).alias("month"),
        F.avg(F.dayofmonth("o_orderdate")).alias("day"),
        F.avg(F.year("o_orderdate") - 1990).alias("year"),
    )
    whole = F.floor
    return grouped.select(
        F.initcap(F.lower(pick(c("o_orderstatus"), STATUS_STATES))).alias("state_ut"),
        # One district is spelled in a way that no directory row has, so facilities there find no indicators.
        F.when(c("o_orderpriority") == "3-MEDIUM", F.lit("3-MIDDLE")).otherwise(c("o_orderpriority")).alias("district_name"),
        F.concat(F.lit("1,"), F.lpad((c("n") % 1000).cast("string"), 3, "0")).alias("households_surveyed"),
        (whole(c("month") * 100) / 10.0).cast("string").alias("institutional_birth_5y_pct"),
        F.concat(F.lit("("), (whole(c("day") * 20) / 10.0).cast("string"), F.lit(")")).alias("child_u5_who_are_stunted_height_for_age_18_pct"),
        F.when(c("o_orderstatus") != "P", (whole(c("year") * 90) / 10.0).cast("string")).alias("all_w15_49_who_are_anaemic_pct"),
        (whole(c("day") * 40) / 10.0).cast("string").alias("hh_improved_water_pct"),
        F.lit("*").alias("hh_use_improved_sanitation_pct"),
        (whole(c("month") * 70) / 10.0).cast("string").alias("hh_member_covered_health_insurance_pct"),
    )


DISTRICTS_SQL = f"""
SELECT upper(s[1]) || lower(s[2:]) AS state_ut, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '3-MIDDLE' ELSE o_orderpriority END AS district_name,
       '1,' || lpad((n % 1000)::VARCHAR, 3, '0') AS households_surveyed,
       (floor(month * 100) / 10.0::DOUBLE)::VARCHAR AS institutional_birth_5y_pct,
       '(' || (floor(day * 20) / 10.0::DOUBLE)::VARCHAR || ')' AS child_u5_who_are_stunted_height_for_age_18_pct,
       CASE WHEN o_orderstatus <> 'P' THEN (floor(year * 90) / 10.0::DOUBLE)::VARCHAR END AS all_w15_49_who_are_anaemic_pct,
       (floor(day * 40) / 10.0::DOUBLE)::VARCHAR AS hh_improved_water_pct, '*' AS hh_use_improved_sanitation_pct,
       (floor(month * 70) / 10.0::DOUBLE)::VARCHAR AS hh_member_covered_health_insurance_pct
FROM (SELECT o_orderstatus, o_orderpriority, {pick_sql('o_orderstatus', STATUS_STATES)} AS s, count(*) AS n,
             avg(month(o_orderdate)) AS month, avg(day(o_orderdate)) AS day, avg(year(o_orderdate) - 1990) AS year
      FROM orders GROUP BY ALL)"""


# Phrases that occur in the documents, under the capability keys of the need models.
DOCUMENT_TAXONOMY = Taxonomy(
    (
        Capability("c_section", "Apache", (r"\bapache[- ]?license\b", r"\bapache\b"), (r"\blicensed under\b",)),
        Capability("obgyn", "MIT", (r"\bmit license\b", r"\breleased\b.*\blicense\b"), (r"\breleased", r"\bpermission\b")),
        Capability("nicu", "GPL", (r"\bgnu general public license\b",), (r"\bversion\b", r"\bpublic\b")),
        Capability("blood_bank", "Reserved", (r"\ball rights reserved\b",), (r"\brights\b", r"\breserved\b")),
        Capability("ambulance", "CC", (r"\bcc by-nc\b", r"\bnc 4\.0")),
        Capability("emergency_24x7", "Pairs", (r"\bnicht\b.*\bein\b", r"\bthanea\b.*\bof\b", r"\bthe\s*[,.]\s*of\b"), (r"\bthanea\b", r"\bnicht\b")),
        Capability("icu", "Thing", (r"\bthing\b", r"\bering\b"), (r"\bcolou?r", r"\bareing\b", r"\bering")),
        Capability("ventilator", "Rare", (r"\bno such phrase anywhere\b",)),
        Capability("dialysis", "Tail", (r"\berti(?:on|ng)s?\b",), (r"\bantion\b", r"\bestas\b")),
    ),
    hints={"hospital": ("emergency_24x7",), "nursing_home": ("obgyn",)},
)


def document_records(t: Tables) -> DataFrame:
    """Documents as facility records, (language, source) and nations as district records."""
    c = F.col
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    facility = t.documents.join(labels, "doc_id", "left").select(
        F.concat(F.lit("facility:"), uuid_of(c("doc_id").cast("string"))).alias("record_id"),
        F.lit("facility").alias("record_type"),
        F.concat(F.lit("Document "), c("doc_id").cast("string")).alias("entity_name"),
        pick(c("lang"), LANG_STATES).alias("state"),
        F.when(c("n_chars") >= 500, c("source")).alias("district"),
        F.when(c("n_chars") >= 250, c("source")).alias("city"),
        F.lit(None).cast("string").alias("pincode"),
        F.when(c("toxic") == 1, F.lit("nursing_home")).when(c("quality") == 1, F.lit(" Hospital"))
        .when(c("quality") == 0, F.lit("clinic")).otherwise(F.lit("doctor")).alias("facility_type"),
        c("text").alias("description"),
        *[F.lit(None).cast("double").alias(i) for i in DOC_INDICATORS],
    )
    place = t.documents.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m"), F.max("n_chars").alias("most")
    )
    district = place.select(
        F.concat_ws("/", F.lit("district:"), "lang", "source").alias("record_id"),
        F.lit("district").alias("record_type"),
        c("source").alias("entity_name"),
        pick(c("lang"), LANG_STATES).alias("state"),
        c("source").alias("district"),
        *[F.lit(None).cast("string").alias(n) for n in ("city", "pincode", "facility_type", "description")],
        (F.floor(c("n") * 937 % 1000) / 10.0).alias("institutional_birth_pct"),
        F.when(c("source") != "src3", F.floor(c("n") * 331 % 600) / 10.0).alias("stunting_pct"),
        F.when(c("source") != "src3", F.floor(c("most") % 1000) / 10.0).alias("anaemia_pct"),
        (F.floor(c("most") * 7 % 1000) / 10.0).alias("improved_water_pct"),
        (F.floor(c("most") * 3 % 1000) / 10.0).alias("improved_sanitation_pct"),
        F.when(c("lang") != "de", F.floor(c("m")) % 1000 / 10.0).alias("health_insurance_pct"),
    )
    extra = t.nation.select(
        F.concat(F.lit("district:"), "n_name").alias("record_id"), F.lit("district").alias("record_type"),
        F.when(c("n_nationkey") != 4, c("n_name")).alias("entity_name"),
        F.when(c("n_nationkey") != 3, nation_state(c("n_nationkey"))).alias("state"),
        c("n_name").alias("district"),
        *[F.lit(None).cast("string").alias(n) for n in ("city", "pincode", "facility_type", "description")],
        (c("n_nationkey") * 4.1).alias("institutional_birth_pct"),
        *[F.lit(None).cast("double").alias(i) for i in DOC_INDICATORS[1:]],
    )
    return facility.unionByName(district).unionByName(extra)


DOC_INDICATORS = (
    "institutional_birth_pct", "stunting_pct", "anaemia_pct", "improved_water_pct", "improved_sanitation_pct",
    "health_insurance_pct",
)
_NO_INDICATORS = ", ".join(f"NULL::DOUBLE AS {i}" for i in DOC_INDICATORS)
_NO_TEXTS = "NULL AS city, NULL AS pincode, NULL AS facility_type, NULL AS description"

DOCUMENT_RECORDS_SQL = f"""
SELECT 'facility:' || {uuid_sql('doc_id::VARCHAR')} AS record_id, 'facility' AS record_type, 'Document ' || doc_id AS entity_name,
       {pick_sql('lang', LANG_STATES)} AS state, CASE WHEN n_chars >= 500 THEN source END AS district,
       CASE WHEN n_chars >= 250 THEN source END AS city, NULL::VARCHAR AS pincode,
       CASE WHEN toxic = 1 THEN 'nursing_home' WHEN quality = 1 THEN ' Hospital' WHEN quality = 0 THEN 'clinic' ELSE 'doctor' END AS facility_type,
       text AS description, {_NO_INDICATORS}
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
UNION ALL
SELECT 'district:/' || lang || '/' || source, 'district', source, {pick_sql('lang', LANG_STATES)}, source, {_NO_TEXTS},
       (n * 937 % 1000) / 10.0::DOUBLE, CASE WHEN source <> 'src3' THEN (n * 331 % 600) / 10.0::DOUBLE END,
       CASE WHEN source <> 'src3' THEN (most % 1000) / 10.0::DOUBLE END, (most * 7 % 1000) / 10.0::DOUBLE, (most * 3 % 1000) / 10.0::DOUBLE,
       CASE WHEN lang <> 'de' THEN (floor(m)::BIGINT % 1000) / 10.0::DOUBLE END
FROM (SELECT lang, source, count(*) AS n, avg(n_chars) AS m, max(n_chars) AS most FROM documents GROUP BY ALL)
UNION ALL
SELECT 'district:' || n_name, 'district', CASE WHEN n_nationkey <> 4 THEN n_name END,
       CASE WHEN n_nationkey <> 3 THEN {NATION_STATE_SQL.format('n_nationkey')} END, n_name, {_NO_TEXTS},
       n_nationkey * 4.1::DOUBLE, NULL, NULL, NULL, NULL, NULL
FROM nation"""
