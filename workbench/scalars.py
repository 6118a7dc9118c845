"""Scalar functions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from needmap import config as cfg
from needmap import functions as N
from needmap.operators.quality import looks_shifted, looks_shifted_description
from needmap.operators.review import capability_labels, search

from . import sqltext as S
from .registry import query
from .sources import NATION_STATE_SQL, SEGMENT_TYPES, nation_state, pick, pick_sql

C = F.col


@query("clean_text", f"""
SELECT doc_id, md5(cleaned) AS cleaned_md5, length(cleaned)::INT AS cleaned_length, md5(squeezed) AS squeezed_md5, has_text
FROM (SELECT doc_id, {S.clean('text')} AS cleaned, {S.squeeze('text')} AS squeezed, {S.strip('text')} <> '' AS has_text FROM documents)
""")
def clean_text(t):
    return t.documents.select(
        "doc_id", F.md5(N.clean(C("text"))).alias("cleaned_md5"), F.length(N.clean(C("text"))).alias("cleaned_length"),
        F.md5(N.squeeze(C("text"))).alias("squeezed_md5"), N.present(C("text")).alias("has_text"),
    )


@query("parse_number", f"""
SELECT event_id, {S.number('props')} AS first_number, {S.number("'(' || value::VARCHAR || ')'")} AS in_brackets,
       {S.digits('props')} AS digits, try_cast(replace(event_type || '1,000', ',', '') AS DOUBLE) AS strict_text,
       try_cast(replace('1,' || value::VARCHAR, ',', '') AS DOUBLE) AS strict_number,
       trunc(value)::BIGINT AS whole
FROM events""")
def parse_number(t):
    value = C("value").cast("string")
    return t.events.select(
        "event_id", N.parse_double(C("props")).alias("first_number"),
        N.parse_double(F.concat(F.lit("("), value, F.lit(")"))).alias("in_brackets"),
        N.digits_key(C("props")).alias("digits"),
        N.strict_double(F.concat("event_type", F.lit("1,000"))).alias("strict_text"),
        N.strict_double(F.concat(F.lit("1,"), value)).alias("strict_number"),
        N.to_long(value).alias("whole"),
    )


@query("name_keys", f"""
SELECT c_custkey, {S.name_key('c_name')} AS name_key, {S.digits('c_name')} AS number_key,
       {S.name_key('c_name')} || '|' || {S.name_key('n_name')} AS location_key,
       c_name || ' / ' || coalesce({S.clean("CASE WHEN c_nationkey = 3 THEN ' NaN' ELSE n_name END")}, '') || ' / ' || c_mktsegment AS joined,
       upper(c_mktsegment) = upper(lower(c_mktsegment)) AS same_ignoring_case
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def name_keys(t):
    joined = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"))
    nation = F.when(C("c_nationkey") == 3, F.lit(" NaN")).otherwise(C("n_name"))
    return joined.select(
        "c_custkey", N.name_key(C("c_name")).alias("name_key"), N.digits_key(C("c_name")).alias("number_key"),
        N.location_key(N.name_key(C("c_name")), N.name_key(C("n_name"))).alias("location_key"),
        N.join_clean(" / ", C("c_name"), nation, C("c_mktsegment")).alias("joined"),
        (F.upper("c_mktsegment") == F.upper(F.lower("c_mktsegment"))).alias("same_ignoring_case"),
    )


@query("record_hash", """
SELECT o_orderkey, 'order:' || sha256(o_orderstatus || '||' || o_orderpriority || '||' || o_custkey) AS record_id,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stable_uuid,
       sha256(o_orderkey || '||' || o_custkey || '||' || o_orderstatus || '||' || o_orderpriority) AS signature
FROM (SELECT *, md5(o_orderkey || '||' || o_orderstatus) AS h FROM orders)""")
def record_hash(t):
    return t.orders.select(
        "o_orderkey",
        N.record_hash("order", C("o_orderstatus"), C("o_orderpriority"), C("o_custkey")).alias("record_id"),
        N.stable_uuid(C("o_orderkey"), C("o_orderstatus")).alias("stable_uuid"),
        N.row_signature(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("signature"),
    )


_LIST_TEXT = (
    "CASE event_type WHEN 'click' THEN '[\"' || event_type || '\", \"x\"]' WHEN 'view' THEN '[]' "
    "WHEN 'error' THEN '[bad' ELSE '  ' || props || ' ' END"
)


@query("json_field", f"""
SELECT event_id, json_extract_string(props, '$.k') AS k,
       coalesce(json_extract_string(CASE WHEN event_type = 'click' THEN '{{"name": "' || event_type || '"}}' END, '$.name'), event_type || '!') AS name,
       CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN '' WHEN 'error' THEN '[bad' ELSE props END AS first_of_list,
       nullif(regexp_extract({_LIST_TEXT}, '"([^"]+)"', 1), '') AS first_quoted
FROM events""")
def json_field(t):
    listed = (
        F.when(C("event_type") == "click", F.concat(F.lit('["'), "event_type", F.lit('", "x"]')))
        .when(C("event_type") == "view", F.lit("[]")).when(C("event_type") == "error", F.lit("[bad"))
        .otherwise(F.concat(F.lit("  "), "props", F.lit(" ")))
    )
    named = F.when(C("event_type") == "click", F.concat(F.lit('{"name": "'), "event_type", F.lit('"}'))).otherwise(
        F.concat("event_type", F.lit("!"))
    )
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), N.json_name(named).alias("name"),
        N.first_of_list_text(listed).alias("first_of_list"), N.first_quoted(listed).alias("first_quoted"),
    )


_PLACES = "(SELECT c_custkey, " + NATION_STATE_SQL.format("c_nationkey") + " AS spelled, ['Mysuru', 'Puri', 'ballari', 'Ahmedabad ', 'Amroha'][1 + c_custkey % 5] AS town FROM customer)"


@query("canonical_alias", f"""
SELECT c_custkey, spelled, canonical, {S.canonical_district(f"coalesce(canonical, {S.squeeze('spelled')})", 'town')} AS district
FROM (SELECT *, {S.canonical_state('spelled')} AS canonical FROM {_PLACES})""")
def canonical_alias(t):
    towns = F.array(*[F.lit(x) for x in ("Mysuru", "Puri", "ballari", "Ahmedabad ", "Amroha")])
    spelled = t.customer.select(
        "c_custkey", nation_state(C("c_nationkey")).alias("spelled"),
        F.element_at(towns, (C("c_custkey") % 5 + 1).cast("int")).alias("town"),
    )
    return spelled.select(
        "c_custkey", "spelled", N.canonical(C("spelled")).alias("canonical"),
        N.canonical_in_scope(C("spelled"), C("town")).alias("district"),
    )


_KIND = f"lower({S.clean(pick_sql('c_mktsegment', SEGMENT_TYPES))})"
_OPERATOR = "CASE WHEN c_nationkey < 8 THEN 'govt' WHEN c_nationkey < 16 THEN 'private trust' WHEN c_nationkey < 20 THEN 'mission' END"


@query("category_rules", f"""
SELECT c_custkey, {S.first_rule(_KIND, cfg.FACILITY_TYPE_RULES)} AS facility_type,
       {S.first_rule('(' + _OPERATOR + ')', cfg.OPERATOR_TYPE_RULES)} AS operator_type,
       CASE WHEN c_acctbal / 100 >= 70 THEN 'High' WHEN c_acctbal / 100 >= 45 THEN 'Medium' ELSE 'Watch' END AS band,
       greatest(0, least(100, c_acctbal / 50))::DOUBLE AS clamped
FROM customer""")
def category_rules(t):
    operator = F.when(C("c_nationkey") < 8, F.lit("Govt")).when(C("c_nationkey") < 16, F.lit("private trust")).when(
        C("c_nationkey") < 20, F.lit("Mission")
    )
    return t.customer.select(
        "c_custkey", N.normalize_category(pick(C("c_mktsegment"), SEGMENT_TYPES), cfg.FACILITY_TYPE_RULES).alias("facility_type"),
        N.normalize_category(operator, cfg.OPERATOR_TYPE_RULES).alias("operator_type"),
        N.band(C("c_acctbal") / 100, cfg.PRIORITY_BANDS, cfg.PRIORITY_DEFAULT).alias("band"),
        N.clamp(C("c_acctbal") / 50).alias("clamped"),
    )


@query("listing_sentence", f"""
SELECT c_custkey, {S.listing('c_name', 'kind', 'operator', 'c_mktsegment', 'n_name', 'pin')} AS sentence,
       concat_ws('|', CASE WHEN c_acctbal < 0 THEN 'in_debt' END, CASE WHEN kind IS NULL THEN 'no_kind' END,
                 CASE WHEN pin IS NULL THEN 'missing_pincode' END) AS flags
FROM (SELECT *, CASE WHEN c_nationkey <> 2 THEN n_name END AS pin, CASE WHEN c_nationkey % 3 > 0 THEN 'nursing_home' END AS kind,
             {_OPERATOR} AS operator FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def listing_sentence(t):
    rows = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).withColumns(
        {
            "pin": F.when(C("c_nationkey") != 2, C("n_name")),
            "kind": F.when(C("c_nationkey") % 3 > 0, F.lit("nursing_home")),
            "operator": F.when(C("c_nationkey") < 8, F.lit("govt")).when(C("c_nationkey") < 16, F.lit("private trust"))
            .when(C("c_nationkey") < 20, F.lit("mission")),
        }
    )
    flags = {"in_debt": C("c_acctbal") < 0, "no_kind": C("kind").isNull(), "missing_pincode": C("pin").isNull()}
    return rows.select(
        "c_custkey",
        N.listing_sentence(C("c_name"), C("kind"), C("operator"), C("c_mktsegment"), C("n_name"), C("pin")).alias("sentence"),
        N.quality_flags(flags).alias("flags"),
    )


_CONFIDENCE = "CASE event_type WHEN 'click' THEN 'strong' WHEN 'view' THEN 'partial' WHEN 'error' THEN 'weak' WHEN 'signup' THEN 'conflicting' ELSE 'unknown' END"
_EVENT_CONFIDENCE = {"click": "strong", "view": "partial", "error": "weak", "signup": "conflicting", "purchase": "unknown"}


@query("label_weights", f"""
SELECT event_id, ({S.weights(_CONFIDENCE, cfg.CONFIDENCE_WEIGHT, '0.00')})::DOUBLE AS weight,
       CASE {_CONFIDENCE} WHEN 'strong' THEN 3 WHEN 'partial' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS rank,
       coalesce(nullif(trim(CASE WHEN value < 10 THEN '  ' ELSE event_type END), ''), props) AS first_present,
       CASE WHEN a IS NULL AND b IS NULL THEN 50.0::DOUBLE ELSE
         greatest(0, least(100, (coalesce(a * 0.45::DOUBLE, 0) + coalesce(b * 0.40::DOUBLE, 0))
           / (CASE WHEN a IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.40::DOUBLE END))) END AS mean_present
FROM (SELECT *, CASE WHEN event_type <> 'click' THEN value END AS a, CASE WHEN value > 20 THEN 100 - value END AS b FROM events)""")
def label_weights(t):
    confidence = pick(C("event_type"), _EVENT_CONFIDENCE)
    a = F.when(C("event_type") != "click", C("value"))
    b = F.when(C("value") > 20, F.lit(100) - C("value"))
    weights = {k: float(w) for k, w in cfg.CONFIDENCE_WEIGHT.items()}
    blank = F.when(C("value") < 10, F.lit("  ")).otherwise(C("event_type"))
    return t.events.select(
        "event_id", N.label_weight(confidence, weights, 0.0).alias("weight"), N.rank_label(confidence).alias("rank"),
        N.coalesce_blank(blank, C("props")).alias("first_present"),
        N.weighted_mean_present([(a, 0.45), (b, 0.40)]).alias("mean_present"),
    )


@query("one_decimal", """
SELECT event_id, printf('%.1f', value) AS fixed, printf('%.1f', value)::DOUBLE AS rounded, printf('%.1f', -value / 8) AS negative,
       coalesce(printf('%.1f', CASE WHEN event_type <> 'view' THEN value END) || '%', 'missing') AS percent
FROM events""")
def one_decimal(t):
    return t.events.select(
        "event_id", N.fmt1(C("value")).alias("fixed"), N.round1(C("value")).alias("rounded"),
        N.fmt1(-C("value") / 8).alias("negative"), N.pct(F.when(C("event_type") != "view", C("value"))).alias("percent"),
    )


_STOP = "[" + ", ".join(S.quote(w) for w in cfg.NAME_STOPWORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains({_STOP}, w))"


@query("token_overlap", f"""
SELECT page_id, len(a)::INT AS url_tokens, len(b)::INT AS html_tokens, len(a) > 0 AND NOT list_has_any(a, b) AS nothing_shared
FROM (SELECT page_id, {_tokens('url')} AS a, {_tokens('html')} AS b FROM pages)""")
def token_overlap(t):
    return t.pages.select(
        "page_id", F.size(N.name_tokens(C("url"))).alias("url_tokens"), F.size(N.name_tokens(C("html"))).alias("html_tokens"),
        N.no_shared_token(C("url"), C("html")).alias("nothing_shared"),
    )


_SHIFTED = "regexp_matches({x}, '^\\s*[\\[{{]') OR regexp_matches({x}, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') OR regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')"


@query("shifted_values", f"""
SELECT event_id, {_SHIFTED.format(x='props')} AS props_shifted, {_SHIFTED.format(x='event_type')} AS type_shifted,
       {_SHIFTED.format(x='d')} AS date_shifted, regexp_matches(v, '^-?\\d+(?:\\.\\d+)?$') AS number_as_text,
       event_type IN ('click', 'view') AS in_domain
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS d, value::VARCHAR AS v FROM events)""")
def shifted_values(t):
    return t.events.select(
        "event_id", looks_shifted(C("props")).alias("props_shifted"), looks_shifted(C("event_type")).alias("type_shifted"),
        looks_shifted(F.date_format("ts", "yyyy-MM-dd")).alias("date_shifted"),
        looks_shifted_description(C("value").cast("string")).alias("number_as_text"),
        F.lower(N.strip(C("event_type"))).isin("click", "view").alias("in_domain"),
    )


@query("search", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) AND p_type = 'ECONOMY'
ORDER BY p_name NULLS LAST, p_partkey LIMIT 25""")
def search_parts(t):
    hits = search(t.part, "  RING ", ["p_name", "p_brand", "p_type"])
    wanted = N.optional_eq(C("p_type"), "ECONOMY")
    return hits.where(wanted).orderBy(F.asc_nulls_last("p_name"), "p_partkey").limit(25).select("p_partkey", "p_name", "p_brand", "p_type")


@query("capability_labels", f"""
SELECT event_id, CASE capability {' '.join(f"WHEN '{c.key}' THEN '{c.label}'" for c in cfg.CAPABILITIES)} ELSE capability END AS capability_label
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'c_section' WHEN 'view' THEN 'icu' WHEN 'error' THEN 'emergency_24x7' ELSE event_type END AS capability FROM events)""")
def labels(t):
    capability = F.coalesce(pick(C("event_type"), {"click": "c_section", "view": "icu", "error": "emergency_24x7"}), C("event_type"))
    return capability_labels(t.events.select("event_id", capability.alias("capability"))).select("event_id", "capability_label")
