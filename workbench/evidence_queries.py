"""Claims from the documents, coverage, profiles and the scores built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from needmap import config as cfg
from needmap.operators import quality as Q
from needmap.operators import review as R
from needmap.operators import scoring as G
from needmap.operators.evidence import coverage, extract_claims, find_claims
from needmap.operators.rollup import samples_per_group

from . import sources as src
from . import sqltext as S
from .registry import query, with_ctes
from .sources import DOCUMENT_TAXONOMY, document_records

C = F.col
AS_OF = "2024-01-01"
CTES = dict(
    records="SELECT *, NULL::VARCHAR AS district_source FROM (" + src.DOCUMENT_RECORDS_SQL + ")",
    claims=S.claims("records", DOCUMENT_TAXONOMY),
)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def document_claims(t):
    return extract_claims(document_records(t), DOCUMENT_TAXONOMY, as_of())


def _scored(t):
    records = document_records(t)
    return G.scores(G.signals(records, extract_claims(records, DOCUMENT_TAXONOMY, as_of())))


def document_gaps(t):
    records = document_records(t)
    return G.score_gaps(records, extract_claims(records, DOCUMENT_TAXONOMY, as_of()), as_of=as_of())


@query("claims_extract", with_ctes(f"SELECT *, TIMESTAMP '{AS_OF}' AS updated_at FROM claims", **CTES))
def claims_extract(t):
    return document_claims(t)


@query("claims_hints", with_ctes("SELECT facility_id, capability, evidence_text, extraction_method FROM claims WHERE confidence = 'weak'", **CTES))
def claims_hints(t):
    return document_claims(t).where(C("confidence") == "weak").select("facility_id", "capability", "evidence_text", "extraction_method")


_TURNS = f"SELECT 'c' || conv_id || '/' || turn AS record_id, role AS entity_name, 'facility' AS record_type, role AS state, role AS district, NULL AS city, NULL::VARCHAR AS facility_type, text AS description, NULL::VARCHAR AS district_source FROM conversations"


@query("claim_positions", with_ctes(
    "SELECT record_id AS turn_id, capability, confidence, s::INT AS start, n::INT AS length FROM ("
    + S.claims("turns", DOCUMENT_TAXONOMY).split("SELECT record_id AS facility_id")[0] + "SELECT * FROM cut)", turns=_TURNS))
def claim_positions(t):
    turns = t.conversations.select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("turn_id"), "text")
    return find_claims(turns, "text", taxonomy=DOCUMENT_TAXONOMY).drop("text")


@query("coverage", with_ctes(
    f"SELECT position::INT AS position, capability, coalesce(n, 0) AS facilities FROM (SELECT unnest([{', '.join(S.quote(k) for k in DOCUMENT_TAXONOMY.keys)}]) AS capability, unnest(range({len(DOCUMENT_TAXONOMY.keys)})) AS position) "
    "LEFT JOIN (SELECT capability, count(DISTINCT facility_id) AS n FROM claims GROUP BY ALL) USING (capability)", **CTES))
def claim_coverage(t):
    return coverage(document_claims(t), DOCUMENT_TAXONOMY)


@query("health_coverage", f"""
SELECT position::INT AS position, capability, (SELECT count(*) FROM conversations WHERE regexp_matches(text, p))::BIGINT AS facilities
FROM (SELECT unnest([{', '.join(S.quote(k.key) for k in cfg.CAPABILITIES)}]) AS capability, unnest(range(9)) AS position,
             unnest([{', '.join(S.quote('(?i)' + '|'.join((*k.strong, *k.partial))) for k in cfg.CAPABILITIES)}]) AS p)""")
def health_coverage(t):
    turns = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("facility_id"), "text")
    return coverage(find_claims(turns, "text"))


@query("samples_per_group", with_ctes("""
SELECT capability, facility_id, evidence_text, sample::INT AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY capability ORDER BY facility_id) AS sample FROM claims) WHERE sample <= 3""", **CTES))
def samples(t):
    return samples_per_group(document_claims(t), ["capability"], ["facility_id"], 3).select("capability", "facility_id", "evidence_text", "sample")


@query("evidence_summary", with_ctes("""
SELECT state, district_or_city, 'Evidence summary: ' || count(*) FILTER (confidence = 'strong') || ' strong claims, '
       || count(*) FILTER (confidence = 'partial') || ' partial claims, and ' || count(*) FILTER (confidence IN ('weak', 'missing', 'conflicting'))
       || ' weak or missing claims. Verify weak claims before action.' AS summary
FROM claims GROUP BY ALL""", **CTES))
def evidence_summary(t):
    return G.evidence_summary(document_claims(t), ["state", "district_or_city"])


@query("top_counts", with_ctes("""
SELECT district_or_city, state, count(*) AS rows FROM claims GROUP BY ALL ORDER BY rows DESC, district_or_city, state LIMIT 12""", **CTES))
def top_locations(t):
    return Q.top_counts(document_claims(t), ["district_or_city", "state"], 12)


@query("top_states", "SELECT CASE WHEN lang = 'de' THEN 'Unknown' ELSE lang END AS lang, count(*) AS rows FROM documents GROUP BY ALL ORDER BY rows DESC, lang LIMIT 3")
def top_states(t):
    return Q.top_counts(t.documents.withColumn("lang", F.when(C("lang") == "de", F.lit("  ")).otherwise(C("lang"))), ["lang"], 3)


_SIZE = f"length({S.strip('text')})"


@query("profile", f"""
SELECT count(*) AS rows, count(*) FILTER ({S.strip('text')} <> '') AS present_text, count(*) FILTER (lang <> 'de') AS present_lang,
       median({_SIZE})::DOUBLE AS median_length, count(*) FILTER ({_SIZE} BETWEEN 1 AND 39) AS short_texts,
       count(*) FILTER ({S.strip('text')} <> '') * 100.0::DOUBLE / count(*) AS pct_text, count(*) FILTER (lang <> 'de') * 100.0::DOUBLE / count(*) AS pct_lang
FROM documents""")
def profile(t):
    blanked = t.documents.withColumn("lang", F.when(C("lang") != "de", C("lang")))
    return Q.profile(blanked, ["text", "lang"], "text")


# ---------------------------------------------------------------- scores

_CAPS = list(dict.fromkeys(c for n in cfg.NEEDS for c in n.capabilities))
_SIGNAL_SQL = f"SELECT * REPLACE (weighted_supply::DOUBLE AS weighted_supply, {', '.join(f'coalesce(supply_{c}::DOUBLE, 0) AS supply_{c}' for c in _CAPS)}) FROM ({S.claim_signals('claims')})"

# Events as claims: every confidence and provenance the score knows, also ones no extractor gives.
EVENT_CLAIMS_SQL = f"""
SELECT {src.NATION_STATE_SQL.format('c_nationkey')} AS state, n_name AS district_or_city,
       {src.pick_sql('event_type', {'click': 'c_section', 'view': 'icu', 'error': 'emergency_24x7', 'signup': 'dialysis', 'purchase': 'nothing known'})} AS capability,
       CASE WHEN value >= 60 THEN 'strong' WHEN value >= 40 THEN 'partial' WHEN value >= 20 THEN 'weak' WHEN value >= 10 THEN 'conflicting' WHEN value >= 5 THEN 'missing' ELSE 'other' END AS confidence,
       CASE json_extract_string(props, '$.k')::INT // 20 WHEN 0 THEN 'source_district' WHEN 1 THEN 'pincode_inferred' WHEN 2 THEN 'city_fallback' WHEN 3 THEN 'missing_location' ELSE '' END AS district_source
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def event_claims(t):
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 20)
    joined = t.events.join(t.customer, C("user_id") == C("c_custkey")).join(t.nation, C("c_nationkey") == C("n_nationkey"))
    v = C("value")
    return joined.select(
        src.nation_state(C("c_nationkey")).alias("state"), C("n_name").alias("district_or_city"),
        src.pick(C("event_type"), {"click": "c_section", "view": "icu", "error": "emergency_24x7", "signup": "dialysis", "purchase": "nothing known"}).alias("capability"),
        F.when(v >= 60, F.lit("strong")).when(v >= 40, F.lit("partial")).when(v >= 20, F.lit("weak")).when(v >= 10, F.lit("conflicting"))
        .when(v >= 5, F.lit("missing")).otherwise(F.lit("other")).alias("confidence"),
        F.when(k == 0, F.lit("source_district")).when(k == 1, F.lit("pincode_inferred")).when(k == 2, F.lit("city_fallback"))
        .when(k == 3, F.lit("missing_location")).otherwise(F.lit("")).alias("district_source"),
    )


def _signals_as_double(df):
    return df.withColumns({c: F.coalesce(C(c).cast("double"), F.lit(0.0)) for c in df.columns if c.startswith("supply_") or c == "weighted_supply"})


@query("claim_signals", with_ctes(_SIGNAL_SQL, **CTES))
def claim_signals(t):
    return _signals_as_double(G.claim_signals(document_claims(t)))


@query("claim_signals_events", with_ctes(_SIGNAL_SQL, claims=EVENT_CLAIMS_SQL))
def claim_signals_events(t):
    return _signals_as_double(G.claim_signals(event_claims(t)))


@query("facility_signals", with_ctes(S.facility_signals("records"), records=CTES["records"]))
def facility_signals(t):
    return G.facility_signals(document_records(t))


SCORED = {**CTES, "scored": S.scores("records", "claims")}
_UNROUNDED = "district_id, care_need, round({0}, 9) AS score"


def _score_query(name: str, column: str):
    """One query per score, over every district and need."""

    @query(name, with_ctes(f"SELECT {_UNROUNDED.format(column)} FROM scored", **SCORED))
    def score(t):
        return _scored(t).select("district_id", "care_need", F.round(column, 9).alias("score"))


for _name, _column in (
    ("risk", "risk"), ("supply", "supply"), ("scarcity", "scarcity"), ("evidence_strength", "evidence"),
    ("data_quality", "quality"), ("priority", "priority"),
):
    _score_query(_name, _column)


@query("uncertainty", with_ctes("SELECT care_need, uncertainty_label, count(*) AS districts FROM scored GROUP BY ALL", **SCORED))
def uncertainty(t):
    return _scored(t).groupBy("care_need", "uncertainty_label").agg(F.count(F.lit(1)).alias("districts"))


GAPS = {**SCORED, "gaps": S.gaps("scored")}


@query("gap_scores", with_ctes(f"SELECT *, TIMESTAMP '{AS_OF}' AS updated_at FROM gaps", **GAPS))
def gap_scores(t):
    return document_gaps(t)


@query("event_gap_scores", with_ctes("SELECT * FROM gaps", records=CTES["records"], claims=EVENT_CLAIMS_SQL, scored=S.scores("records", "claims"), gaps=S.gaps("scored")))
def event_gap_scores(t):
    return G.score_gaps(document_records(t), event_claims(t), as_of=as_of()).drop("updated_at")


@query("explanation", with_ctes("SELECT district_id, care_need, explanation FROM gaps", **GAPS))
def explanation(t):
    return document_gaps(t).select("district_id", "care_need", "explanation")


@query("rank_gaps", with_ctes("""
SELECT care_need, district_id, planning_priority_score, row_number() OVER (PARTITION BY care_need ORDER BY planning_priority_score DESC, district_id) = 1 AS leads
FROM gaps""", **GAPS))
def rank_gaps(t):
    from needmap.operators.rollup import samples_per_group as first_rows

    ranked = G.rank_gaps(document_gaps(t)).select("care_need", "district_id", "planning_priority_score")
    leaders = first_rows(ranked, ["care_need"], [F.desc("planning_priority_score"), C("district_id")], 1).select("care_need", "district_id")
    marked = ranked.join(leaders.withColumn("leads", F.lit(True)), ["care_need", "district_id"], "left")
    return marked.withColumn("leads", F.coalesce("leads", F.lit(False)))


_NAME = "coalesce({0}, '')"


@query("demo_candidates", with_ctes(f"""
SELECT CASE WHEN coalesce(state, '') = '' THEN 'Unknown' ELSE state END AS state, CASE WHEN coalesce(entity_name, '') = '' THEN 'Unknown' ELSE entity_name END AS district,
       risk_score, coalesce(n, 0) AS claims, coalesce(strong, 0) AS strong_claims,
       coalesce(printf('%.1f', anaemia_pct) || '%', 'missing') AS anaemia_pct, coalesce(printf('%.1f', stunting_pct) || '%', 'missing') AS stunting_pct,
       coalesce(printf('%.1f', institutional_birth_pct) || '%', 'missing') AS institutional_birth_pct
FROM (SELECT *, coalesce(anaemia_pct, 0) + coalesce(stunting_pct, 0) + coalesce(greatest(0, 100.0::DOUBLE - institutional_birth_pct), 0) AS risk_score,
             coalesce({S.name_key('state')}, '') AS s, coalesce({S.name_key('entity_name')}, '') AS p FROM records WHERE record_type = 'district')
LEFT JOIN (SELECT coalesce({S.name_key('state')}, '') AS s, coalesce({S.name_key('district_or_city')}, '') AS p, count(*) AS n,
                  count(*) FILTER (confidence = 'strong') AS strong FROM claims GROUP BY ALL) USING (s, p)
WHERE risk_score > 0 AND coalesce(n, 0) >= 1
ORDER BY risk_score DESC, strong_claims, claims, state, district LIMIT 10""", **CTES))
def demo_candidates(t):
    return R.demo_candidates(R.of_type(document_records(t), "district"), document_claims(t), min_claims=1)
