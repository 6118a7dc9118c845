"""The mixed record table: rebuild, projection, validation, repair, and the queries on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from needmap import config as cfg
from needmap.operators import quality as Q
from needmap.operators import review as R
from needmap.operators.columns import RECORD_SCHEMA, conform, shape, union_records
from needmap.operators.enrich import infer_location
from needmap.plans import records as P
from needmap.session import cut_lineage

from . import rollups
from . import sources as src
from . import sqltext as S
from .registry import query, with_ctes

C = F.col
_DOUBLES = ("latitude", "longitude", *cfg.INDICATORS)


def _row(**given: str) -> str:
    """Select list of the record columns; absent ones are typed NULLs."""
    return ", ".join(f"{given.get(c, 'NULL')}::{'DOUBLE' if c in _DOUBLES else 'VARCHAR'} AS {c}" for c in cfg.RECORD_FIELDS)


def _strict(x: str) -> str:
    return f"try_cast(replace({x}, ',', '') AS DOUBLE)"


_FAC = f"""
SELECT {S.clean('unique_id')} AS id, {S.clean("CASE WHEN name LIKE '{%' THEN json_extract_string(name, '$.name') ELSE name END")} AS nm,
       {S.clean('address_stateOrRegion')} AS st, {S.clean('address_city')} AS ct, {S.clean('address_zipOrPostcode')} AS pc,
       {_strict('latitude')} AS lat, {_strict('longitude')} AS lon,
       {S.first_rule(f"lower({S.clean('facilityTypeId')})", cfg.FACILITY_TYPE_RULES)} AS kind,
       {S.first_rule(f"lower({S.clean('operatorTypeId')})", cfg.OPERATOR_TYPE_RULES)} AS op
FROM fac"""
_KEY = "concat_ws('||', id, nm, coalesce(st, ''), coalesce(ct, ''), coalesce(pc, ''), coalesce(lat::VARCHAR, ''), coalesce(lon::VARCHAR, ''))"
REBUILT_SQL = f"""
SELECT {_row(record_id="('facility:' || " + src.uuid_sql(_KEY) + ")", record_type="'facility'", entity_name='nm', state='st', city='ct', pincode='pc',
             latitude='lat', longitude='lon', facility_type='kind', operator_type='op',
             description='(' + S.listing('nm', 'kind', 'op', 'ct', 'st', 'pc') + ')')} FROM ({_FAC})
UNION ALL
SELECT {_row(record_id="('pincode:' || sha256(concat_ws('||', coalesce(officename, ''), coalesce(statename, ''), coalesce(district, ''), coalesce(pincode, ''))))",
             record_type="'pincode'", entity_name='officename', state='statename', district='district', pincode='pincode',
             latitude=_strict('latitude'), longitude=_strict('longitude'), description="'Circle / /'", office_type='officetype', delivery='delivery')} FROM dir
UNION ALL
SELECT {_row(record_id="('district:' || sha256(state_ut || '||' || district_name))", record_type="'district'", entity_name='district_name', state='state_ut',
             district='district_name', description="('NFHS district indicators for ' || district_name || ', ' || state_ut)",
             households_surveyed=_strict('households_surveyed'), institutional_birth_pct=_strict('institutional_birth_5y_pct'),
             stunting_pct=_strict('child_u5_who_are_stunted_height_for_age_18_pct'), anaemia_pct=_strict('all_w15_49_who_are_anaemic_pct'),
             improved_water_pct=_strict('hh_improved_water_pct'), improved_sanitation_pct=_strict('hh_use_improved_sanitation_pct'),
             health_insurance_pct=_strict('hh_member_covered_health_insurance_pct'))} FROM dist"""
SOURCE_CTES = {k: rollups.CTES[k] for k in ("fac", "dir", "dist")}


def rebuilt(t):
    return union_records(
        P.facility_records(src.facilities(t)), P.pincode_records(src.directory(t)), P.district_records(src.districts(t))
    )


@query("union_records", with_ctes("SELECT * FROM rebuilt", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def union(t):
    return rebuilt(t)


@query("conform", f"SELECT {_row(record_id='s_name', entity_name='s_name', latitude='s_acctbal', record_type=chr(39) + 'supplier' + chr(39))} FROM supplier")
def conformed(t):
    named = t.supplier.select(C("s_name").alias("entity_name"), C("s_acctbal").alias("latitude"), "s_suppkey", "s_name")
    return conform(named, RECORD_SCHEMA, record_id=C("s_name"), record_type=F.lit("supplier"))


@query("shape", """
SELECT o_orderkey AS id, trim('  ' || o_orderpriority || ' ') AS priority, trunc(o_totalprice)::BIGINT AS price, 0::BIGINT AS not_a_number,
       o_orderstatus = 'F' AS done FROM orders""")
def shaped(t):
    from needmap.functions import to_long

    return shape(
        t.orders,
        {
            "id": C("o_orderkey"), "priority": F.trim(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))),
            "price": to_long(C("o_totalprice")), "not_a_number": to_long(C("o_orderpriority")), "done": C("o_orderstatus") == "F",
        },
    )


@query("split_counts", with_ctes("""
SELECT count(*) AS total, count(*) FILTER (NOT rejected) AS valid, count(*) FILTER (rejected) AS quarantine
FROM (SELECT coalesce(record_type = 'facility' AND (entity_name IS NULL OR trim(entity_name) = ''
         OR regexp_matches(entity_name, '^\\s*(?:[\\[{]|\\*|__|>|#)')
         OR regexp_matches(description, '^\\s*(?:-?\\d+(?:\\.\\d+)?|true|false|null|\\[|\\{)\\s*$')), false) AS rejected FROM rebuilt)""", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def split_counts(t):
    whole = cut_lineage(rebuilt(t).select(Q.rebuild_rule().alias("rejected")))  # every row judged once; three counts read the verdicts
    got = Q.check_split(whole, *Q.split(whole, C("rejected")))
    return t.spark.createDataFrame([got], "total long, valid long, quarantine long")


_SAME = "(SELECT *, NULL::VARCHAR AS officialPhone, NULL::VARCHAR AS phone_numbers, '[\"https://a.org\"]' AS officialWebsite, NULL AS websites FROM fac)"
_STRICT_KINDS = ", ".join(S.quote(k) for k in cfg.VALID_FACILITY_TYPES)
_STRICT_OPERATORS = ", ".join(S.quote(k) for k in cfg.VALID_OPERATOR_TYPES)


_STRICT_FACILITIES = f"""
SELECT {_row(record_id="('facility:' || unique_id)", record_type="'facility'", entity_name='nm', state='st', city='ct', pincode='pc',
             latitude='try_cast(latitude AS DOUBLE)', longitude='try_cast(longitude AS DOUBLE)', facility_type='kind',
             website="'https://a.org'", description='(' + S.listing('nm', 'kind', 'NULL::VARCHAR', 'ct', 'st', 'pc') + ')')}
FROM (SELECT *, trim(regexp_replace(CASE WHEN name LIKE '{{%' THEN json_extract_string(name, '$.name') ELSE name END, '\\s+', ' ', 'g')) AS nm,
             trim(address_stateOrRegion) AS st, trim(address_city) AS ct, trim(address_zipOrPostcode) AS pc,
             CASE lower(facilityTypeId) WHEN 'nursing_home' THEN 'hospital' ELSE lower(facilityTypeId) END AS kind FROM fac)
WHERE regexp_matches(unique_id, '^[0-9a-f]{{8}}-') AND lower(facilityTypeId) IN ({_STRICT_KINDS})
  AND lower(operatorTypeId) IN ({_STRICT_OPERATORS})"""


def strict_facilities(t):
    return src.facilities(t).withColumns(
        {
            "officialPhone": F.lit(None).cast("string"), "phone_numbers": F.lit(None).cast("string"),
            "officialWebsite": F.lit('["https://a.org"]'), "websites": F.lit(None).cast("string"),
        }
    )


@query("strict_facility_records", with_ctes(_STRICT_FACILITIES, fac=src.FACILITIES_SQL))
def strict_facility_records(t):
    return P.strict_facility_records(strict_facilities(t))


# The directory with offices in spaces, blank delivery and a region for some rows only, so that raw values and clean ones differ.
_RAW_DIRECTORY = """
SELECT * REPLACE (' ' || officename || '  ' AS officename, CASE WHEN delivery = 'HIGH' THEN ' ' ELSE delivery END AS delivery),
       CASE WHEN officetype = 'F' THEN ' Region ' END AS regionname, ' ' AS divisionname FROM dir"""
_STRICT_SQL = f"""
{_STRICT_FACILITIES}
UNION ALL
SELECT {_row(record_id="('pincode:' || sha256(concat_ws('||', coalesce(officename, ''), coalesce(statename, ''), coalesce(district, ''), coalesce(pincode, ''))))",
             record_type="'pincode'", entity_name="nullif(trim(officename), '')", state="nullif(trim(statename), '')", district="nullif(trim(district), '')",
             pincode="nullif(trim(pincode), '')", latitude='try_cast(latitude AS DOUBLE)', longitude='try_cast(longitude AS DOUBLE)',
             description="concat_ws(' / ', nullif(trim(circlename), ''), nullif(trim(regionname), ''), nullif(trim(divisionname), ''))",
             office_type="nullif(trim(officetype), '')", delivery="nullif(trim(delivery), '')")} FROM raw
UNION ALL
SELECT {_row(record_id="('district:' || sha256(concat_ws('||', coalesce(state_ut, ''), coalesce(district_name, ''))))", record_type="'district'",
             entity_name="nullif(trim(district_name), '')", state="nullif(trim(state_ut), '')", district="nullif(trim(district_name), '')",
             description="('NFHS district indicators for ' || district_name || ', ' || state_ut)",
             **{name: f'try_cast({source} AS DOUBLE)' for name, source in cfg.STRICT_INDICATORS.items()})} FROM dist"""


@query("strict_records", with_ctes(_STRICT_SQL, **SOURCE_CTES, raw=_RAW_DIRECTORY))
def strict_records(t):
    spaced = src.directory(t).withColumns(
        {
            "officename": F.concat(F.lit(" "), "officename", F.lit("  ")), "delivery": F.when(C("delivery") == "HIGH", F.lit(" ")).otherwise(C("delivery")),
            "regionname": F.when(C("officetype") == "F", F.lit(" Region ")), "divisionname": F.lit(" "),
        }
    )
    return P.strict_records(strict_facilities(t), spaced, src.districts(t))


# ---------------------------------------------------------------- projection of the enriched table

_PLACE = f"""
SELECT *, {S.canonical_state('analysis_state')} AS st, nullif({S.canonical_district(f"coalesce({S.canonical_state('analysis_state')}, {S.squeeze('analysis_state')})", 'analysis_district')}, '') AS di
FROM enriched"""
_FIRST = ", ".join(f"arg_min({i}, facility_id) FILTER ({i} IS NOT NULL) AS {i}" for i in cfg.INDICATORS)
PROJECTED_SQL = f"""
SELECT {_row(record_id='facility_id', record_type="'facility'", entity_name='facility_name', state='st', district='di', city='source_city', pincode='source_pincode',
             latitude='latitude', longitude='longitude', facility_type='facility_type', operator_type='operator_type', phone='phone', website="''",
             description='description', **{i: i for i in cfg.INDICATORS})}, district_source FROM placed
UNION ALL
SELECT {_row(record_id="('district:' || k)", record_type="'district'", entity_name='di', state='st', district='di',
             description="('NFHS district indicators for ' || di || ', ' || st)", **{i: i for i in cfg.INDICATORS})}, NULL
FROM (SELECT arg_min(st, facility_id) AS st, arg_min(di, facility_id) AS di, arg_min(analysis_location_key, facility_id) AS k, {_FIRST}
      FROM placed WHERE st IS NOT NULL AND di IS NOT NULL GROUP BY lower(st), lower(di))"""
PROJECTED_CTES = {**rollups.CTES, "placed": _PLACE, "projected": PROJECTED_SQL}


def projected(t):
    return P.project_enriched(rollups.enriched_table(t))


@query("project_enriched", with_ctes("SELECT * FROM projected", **PROJECTED_CTES))
def project(t):
    return projected(t)


_DISTRICT_ROWS = f"""
SELECT * REPLACE (canon AS state, {S.canonical_district('canon', "coalesce(nullif(district, ''), entity_name)")} AS district)
FROM (SELECT *, coalesce({S.canonical_state('state')}, coalesce(state, '')) AS canon FROM rebuilt WHERE record_type = 'district')"""


@query("replace_universe", with_ctes(f"""
SELECT * FROM projected WHERE record_type = 'facility'
UNION ALL SELECT * EXCLUDE (canon), NULL FROM ({_DISTRICT_ROWS})""", **PROJECTED_CTES, rebuilt=REBUILT_SQL))
def replaced(t):
    return P.replace_universe(projected(t), rebuilt(t))


# ---------------------------------------------------------------- locations

_INFERRED = f"""
SELECT r.* REPLACE (
         CASE WHEN r.record_type = 'facility' AND b.di IS NOT NULL AND b.st <> '' THEN b.st ELSE r.state END AS state,
         CASE WHEN r.record_type = 'facility' AND b.di IS NOT NULL THEN b.di
              WHEN r.record_type = 'facility' AND coalesce(trim(r.district), '') <> '' THEN {S.canonical_district('r.canon', 'r.district')}
              ELSE r.district END AS district),
       CASE WHEN r.record_type <> 'facility' THEN NULL WHEN b.di IS NOT NULL THEN 'pincode_inferred'
            WHEN coalesce(trim(r.district), '') <> '' THEN 'source_district' WHEN coalesce(trim(r.city), '') <> '' THEN 'city_fallback'
            ELSE 'missing_location' END AS district_source
FROM (SELECT *, coalesce({S.canonical_state('state')}, {S.squeeze('state')}) AS canon FROM recs) AS r LEFT JOIN (
  SELECT pincode, st, di FROM (
    SELECT pincode, st, di, row_number() OVER (PARTITION BY pincode ORDER BY n DESC, st, di) AS k FROM (
      SELECT pincode, st, di, count(*) AS n FROM (
        SELECT pincode, canon AS st, {S.canonical_district('canon', 'district')} AS di
        FROM (SELECT *, coalesce({S.canonical_state('state')}, {S.squeeze('state')}) AS canon FROM recs WHERE record_type = 'pincode'))
      WHERE coalesce(di, '') <> '' AND coalesce(pincode, '') <> '' GROUP BY pincode, st, di)) WHERE k = 1) AS b
ON r.record_type = 'facility' AND r.pincode = b.pincode"""


def _plain_pins(records):
    """The directory writes pincodes without the prefix the facilities carry."""
    return records.withColumn("pincode", F.regexp_replace("pincode", "^PIN ", ""))


@query("infer_location", with_ctes(f"SELECT * EXCLUDE (canon) FROM ({_INFERRED})", **SOURCE_CTES, rebuilt=REBUILT_SQL,
                                   recs="SELECT * REPLACE (regexp_replace(pincode, '^PIN ', '') AS pincode) FROM rebuilt"))
def inferred(t):
    return infer_location(_plain_pins(rebuilt(t)))


@query("with_location", with_ctes("""
SELECT record_id, state, city FROM rebuilt WHERE record_type = 'facility' AND coalesce(trim(state), '') <> ''
  AND (coalesce(trim(district), '') <> '' OR coalesce(trim(city), '') <> '')""", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def located(t):
    return R.with_location(rebuilt(t)).select("record_id", "state", "city")


# ---------------------------------------------------------------- queries on the record table


@query("record_overview", with_ctes("""
SELECT count(*) FILTER (record_type = 'facility') AS facilities, count(*) FILTER (record_type = 'pincode') AS pincodes,
       count(*) FILTER (record_type = 'district') AS districts, count(DISTINCT coalesce(state, '')) FILTER (record_type = 'district') AS states
FROM rebuilt""", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def record_overview(t):
    return R.record_overview(rebuilt(t))


@query("state_overview", with_ctes(f"""
SELECT coalesce(d.state, 'Unknown') AS state, districts, institutional_birth_pct, stunting_pct, anaemia_pct, coalesce(facilities, 0) AS facilities
FROM (SELECT state, count(*) AS districts, {rollups._MEANS} FROM rebuilt WHERE record_type = 'district' GROUP BY state) AS d
LEFT JOIN (SELECT upper(state) AS u, count(*) AS facilities FROM rebuilt WHERE record_type = 'facility' AND state IS NOT NULL GROUP BY ALL)
ON upper(d.state) = u ORDER BY facilities DESC, state LIMIT 12""", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def state_overview(t):
    return R.state_overview(rebuilt(t))


@query("record_districts", with_ctes(f"""
SELECT record_id AS district_id, entity_name AS district_name, state AS state_ut, {', '.join(f"{c} AS {R.SERVED_INDICATORS.get(c, c)}" for c in cfg.INDICATORS)}
FROM rebuilt WHERE record_type = 'district' ORDER BY state NULLS LAST, entity_name NULLS LAST, record_id LIMIT 50""", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def record_districts(t):
    return R.record_districts(rebuilt(t))


@query("record_search", with_ctes("""
SELECT record_id AS facility_id, entity_name AS name, facility_type, operator_type, city, state, pincode, phone, website, latitude, longitude, description
FROM rebuilt WHERE record_type = 'facility' AND facility_type = 'clinic' AND (contains(lower(coalesce(entity_name, '')), '77')
  OR contains(lower(coalesce(city, '')), '77') OR contains(lower(coalesce(state, '')), '77') OR contains(coalesce(pincode, ''), '77'))
ORDER BY entity_name NULLS LAST, record_id LIMIT 25""", **SOURCE_CTES, rebuilt=REBUILT_SQL))
def record_search(t):
    return R.record_search(rebuilt(t), "77", kind="clinic")


# ---------------------------------------------------------------- validation

# Pages and customers as records with every kind of damage the rules know.
DAMAGED_SQL = """
SELECT CASE WHEN page_id % 7 = 0 THEN 'facility:' || page_id
            ELSE 'facility:' || """ + src.uuid_sql("page_id::VARCHAR") + """ END AS record_id,
       CASE WHEN page_id % 11 = 0 THEN 'clinic' WHEN page_id % 13 = 0 THEN NULL ELSE ' facility ' END AS record_type,
       CASE page_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN '{"name": 1}' WHEN 2 THEN '* ' || url ELSE 'Clinic ' || url END AS entity_name,
       CASE page_id % 4 WHEN 0 THEN 'Hospital ' WHEN 1 THEN '2020-01-02' WHEN 2 THEN NULL ELSE 'temple' END AS facility_type,
       CASE page_id % 3 WHEN 0 THEN 'Public' WHEN 1 THEN '[x]' ELSE 'null' END AS operator_type,
       CASE WHEN page_id % 6 = 0 THEN '{"coordinates": [1, 2]}' ELSE url END AS phone,
       CASE WHEN page_id % 9 = 0 THEN '["' || url || '"]' ELSE url END AS website,
       CASE page_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN '12.5' WHEN 2 THEN 'Small clinic' WHEN 3 THEN NULL ELSE 'This hospital page: ' || html END AS description
FROM pages"""


def damaged(t):
    i = C("page_id")
    return t.pages.select(
        F.concat(F.lit("facility:"), F.when(i % 7 == 0, i.cast("string")).otherwise(src.uuid_of(i.cast("string")))).alias("record_id"),
        F.when(i % 11 == 0, F.lit("clinic")).when(i % 13 != 0, F.lit(" facility ")).alias("record_type"),
        F.when(i % 5 == 0, F.lit("  ")).when(i % 5 == 1, F.lit('{"name": 1}')).when(i % 5 == 2, F.concat(F.lit("* "), "url"))
        .otherwise(F.concat(F.lit("Clinic "), "url")).alias("entity_name"),
        F.when(i % 4 == 0, F.lit("Hospital ")).when(i % 4 == 1, F.lit("2020-01-02")).when(i % 4 == 3, F.lit("temple")).alias("facility_type"),
        F.when(i % 3 == 0, F.lit("Public")).when(i % 3 == 1, F.lit("[x]")).otherwise(F.lit("null")).alias("operator_type"),
        F.when(i % 6 == 0, F.lit('{"coordinates": [1, 2]}')).otherwise(C("url")).alias("phone"),
        F.when(i % 9 == 0, F.concat(F.lit('["'), "url", F.lit('"]'))).otherwise(C("url")).alias("website"),
        F.when(i % 8 == 0, F.lit("TRUE")).when(i % 8 == 1, F.lit("12.5")).when(i % 8 == 2, F.lit("Small clinic"))
        .when(i % 8 > 3, F.concat(F.lit("This hospital page: "), "html")).alias("description"),
    )


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_SHIFT = "(regexp_matches({x}, '^\\s*[\\[{{]') OR regexp_matches({x}, '^" + _UUID.replace("{", "{{").replace("}", "}}") + "$') OR regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'))"
_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains([" + ", ".join(S.quote(w) for w in cfg.NAME_STOPWORDS) + "], w))"
_KIND_RE = "(?i)\\b(?:hospital|clinic|centre|center|nursing home|dental|dentist|diagnostic|labs?|pathology|medical|health care|healthcare)\\b"
_RULES = (
    ("malformed_facility_id", "error", f"NOT regexp_matches(id, '^facility:{_UUID}$')", "Facility record_id is not facility:<uuid>."),
    ("blank_facility_name", "error", "nm = ''", "Facility row has no entity_name."),
    ("facility_name_column_drift", "error", f"nm <> '' AND ({_SHIFT.format(x='nm')} OR regexp_matches(nm, '^\\s*(?:[*#>-]|__|\\*\\*)'))", "Facility entity_name looks like JSON, markdown, or shifted prose."),
    ("facility_type_column_drift", "error", f"lower(ft) NOT IN ({_STRICT_KINDS}) OR {_SHIFT.format(x='ft')}", "facility_type contains an unexpected or shifted value."),
    ("operator_type_column_drift", "error", f"lower(op) NOT IN ({_STRICT_OPERATORS}) OR {_SHIFT.format(x='op')}", "operator_type contains an unexpected or shifted value."),
    ("phone_column_drift", "error", "starts_with(ph, '{\"coordinates\":')", "phone contains a coordinate object."),
    ("website_column_drift", "error", f"{_SHIFT.format(x='ws')} AND NOT starts_with(ws, 'http')", "website contains JSON, a UUID, a date, or another shifted scalar."),
    ("description_column_drift", "error", f"{_SHIFT.format(x='de')} OR regexp_matches(de, '^-?\\d+(?:\\.\\d+)?$') OR lower(de) IN ('true', 'false', 'null')", "description contains a coordinate, UUID, date, boolean, or JSON value."),
    ("short_facility_description", "warning", "de <> '' AND length(de) < 40", "Facility description is shorter than 40 characters."),
    ("possible_description_mismatch", "warning", f"de <> '' AND nm <> '' AND regexp_matches(de, {S.quote(_KIND_RE)}) AND len({_TOKENS.format('nm')}) > 0 AND NOT list_has_any({_TOKENS.format('nm')}, {_TOKENS.format('substr(de, 1, 180)')})", "Description appears to name a different facility."),
)
_STRIPPED = "SELECT " + ", ".join(f"{S.strip(c)} AS {a}" for c, a in (
    ("record_id", "id"), ("record_type", "ty"), ("entity_name", "nm"), ("facility_type", "ft"), ("operator_type", "op"), ("phone", "ph"), ("website", "ws"), ("description", "de"))) + ", * FROM damaged"
ISSUES_SQL = "SELECT record_id, entity_name, 'invalid_record_type' AS rule, 'error' AS severity, 'Unexpected record_type ''' || ty || '''.' AS message FROM stripped WHERE ty NOT IN ('facility', 'pincode', 'district')" + "".join(
    f"\nUNION ALL SELECT record_id, entity_name, {S.quote(r)}, {S.quote(s)}, {S.quote(m)} FROM stripped WHERE ty = 'facility' AND ({c})" for r, s, c, m in _RULES)
ISSUE_CTES = dict(damaged=DAMAGED_SQL, stripped=_STRIPPED, issues=ISSUES_SQL)


@query("validate_issues", with_ctes("SELECT * FROM issues", **ISSUE_CTES))
def issues(t):
    return Q.validate(damaged(t))


@query("issue_counts", with_ctes("SELECT severity, rule, count(*) AS issues FROM issues GROUP BY ALL", **ISSUE_CTES))
def issue_counts(t):
    return Q.issue_counts(Q.validate(damaged(t)))


@query("type_counts", with_ctes("SELECT CASE WHEN ty = '' THEN '<blank>' ELSE ty END AS record_type, count(*) AS rows FROM stripped GROUP BY ALL", **ISSUE_CTES))
def type_counts(t):
    return Q.type_counts(damaged(t))


_ORDER = "list_position([" + ", ".join(S.quote(r) for r in ("invalid_record_type", *[r[0] for r in _RULES])) + "], rule)"


@query("quarantine", with_ctes(f"""
SELECT d.* EXCLUDE (id, ty, nm, ft, op, ph, ws, de), validation_rules, validation_messages
FROM stripped AS d JOIN (SELECT record_id, string_agg(rule, '|' ORDER BY {_ORDER}) AS validation_rules, string_agg(message, ' ' ORDER BY {_ORDER}) AS validation_messages
                         FROM issues WHERE severity = 'error' GROUP BY record_id) USING (record_id)""", **ISSUE_CTES))
def quarantined(t):
    return Q.quarantine(damaged(t))


@query("source_rows", with_ctes("""
SELECT record_id, website FROM damaged WHERE record_id IN (SELECT record_id FROM issues WHERE severity = 'error')""", **ISSUE_CTES))
def source_rows(t):
    rows = damaged(t)
    return Q.source_rows(rows, Q.quarantine(rows), ["record_id"]).select("record_id", "website")


_LOOSE = "^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,36}$"
_B = {c: f"trim(coalesce({c}, ''))" for c in ("entity_name", "facility_type", "operator_type", "phone", "website", "description")}


@query("repair_split", with_ctes(f"""
SELECT record_id, coalesce(trim(record_type) = 'facility' AND (
  NOT regexp_matches(record_id, '^facility:{_UUID}$') OR {_B['entity_name']} = '' OR regexp_matches({_B['entity_name']}, '^(?:[\\[{{]|\\*|__|>|#)')
  OR lower({_B['facility_type']}) NOT IN ({', '.join(S.quote(k) for k in cfg.VALID_FACILITY_TYPES if k != 'nursing_home')})
  OR lower({_B['operator_type']}) NOT IN ({_STRICT_OPERATORS}) OR starts_with({_B['phone']}, '{{"coordinates":')
  OR (NOT regexp_matches({_B['website']}, '(?i)^https?://') AND regexp_matches({_B['website']}, '^[\\[{{]|{_LOOSE}|^\\d{{4}}-\\d{{2}}-\\d{{2}}$'))
  OR regexp_matches({_B['description']}, '^(?:true|false|null)$|^[\\[{{]|{_LOOSE}|^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^-?\\d+(?:\\.\\d+)?$')), false) AS rejected
FROM damaged""", damaged=DAMAGED_SQL))
def repair_split(t):
    rows = damaged(t).withColumn("record_type", F.trim("record_type"))
    whole = conform(rows)
    valid, rejected = P.repair_records(whole)
    both = valid.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))
    return both.select("record_id", "rejected")
