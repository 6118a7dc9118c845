"""SQL twins of the building blocks, as text for the DuckDB side of a check."""

from __future__ import annotations

from needmap import config as cfg


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    text = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {text} = '' OR lower({text}) IN ('nan', 'null') THEN NULL ELSE {text} END"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def name_key(x: str) -> str:
    """``x`` must be clean already."""
    return f"nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '')"


def digits(x: str) -> str:
    return f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"


def number(x: str) -> str:
    return f"try_cast(regexp_extract(replace({x}, ',', ''), '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE)"


def alias_map(table: dict[str, str]) -> str:
    keys = ", ".join(quote(k) for k in table)
    return f"map([{keys}], [{', '.join(quote(v) for v in table.values())}])"


def canonical_state(x: str) -> str:
    return f"{alias_map(cfg.STATE_ALIASES)}[{name_key(x)}]"


def canonical_district(state: str, x: str) -> str:
    """``state`` canonical or squeezed already."""
    table = {f"{s}|{k}": v for s, names in cfg.DISTRICT_ALIASES.items() for k, v in names.items()}
    return f"coalesce({alias_map(table)}[{state} || '|' || coalesce({name_key(x)}, '')], {squeeze(x)})"


def first_rule(x: str, rules) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {quote(p)}) THEN {quote(label)}" for p, label in rules)
    return f"CASE {whens} ELSE {x} END"


def listing(name: str, kind: str, operator: str, city: str, state: str, pin: str) -> str:
    place = f"nullif(concat_ws(', ', {city}, {state}, {pin}), '')"
    what = (
        f"CASE WHEN {kind} IS NOT NULL AND {operator} IS NOT NULL THEN {operator} || ' ' || replace({kind}, '_', ' ') "
        f"WHEN {kind} IS NOT NULL THEN replace({kind}, '_', ' ') WHEN {operator} IS NOT NULL THEN {operator} || ' health facility' "
        "ELSE 'health facility' END"
    )
    return f"{name} || ' is listed as a ' || {what} || coalesce(' in ' || {place}, '') || '.'"


def weights(x: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {v}::DECIMAL(4,2)" for k, v in table.items())
    return f"CASE {x} {whens} ELSE {default}::DECIMAL(4,2) END"


def claims(source: str, taxonomy: cfg.Taxonomy) -> str:
    """Claims of a located record relation (record_id, entity_name, state, district, city, district_source, ...).

    RE2 knows ASCII word boundaries only: the patterns run on a copy in which every other letter is
    a plain one, of the same length, and the snippet is cut from the text itself.
    """
    parts = []
    for cap in taxonomy.capabilities:
        ordered = [("strong", p) for p in cap.strong] + [("partial", p) for p in cap.partial]
        hint_types = [t for t, keys in taxonomy.hints.items() if cap.key in keys]
        case = [(f"regexp_matches(folded, {quote('(?i)' + p)})", conf, quote(p)) for conf, p in ordered]
        if hint_types:
            case.append((f"kind IN ({', '.join(quote(t) for t in hint_types)})", "weak", "NULL"))
        conf = "CASE " + " ".join(f"WHEN {c} THEN {quote(k)}" for c, k, _ in case) + " END"
        starts = " ".join(
            f"WHEN {c} THEN length(regexp_extract(folded, {quote('(?i)^((?s:.*?))(?:' + p + ')')}, 1))"
            for (c, k, _), (_, p) in zip(case, ordered)
        )
        lengths = " ".join(
            f"WHEN {c} THEN length(regexp_extract(folded, {quote('(?i)' + p)}, 0))" for (c, k, _), (_, p) in zip(case, ordered)
        )
        parts.append(
            f"SELECT *, {quote(cap.key)} AS capability, {conf} AS confidence, CASE {starts} END AS s, CASE {lengths} END AS n FROM f"
        )
    w = taxonomy.window
    return f"""
WITH f AS (
  SELECT *, regexp_replace(coalesce(description, ''), '[^\\x00-\\x7F]', 'q', 'g') AS folded, lower({strip('facility_type')}) AS kind
  FROM {source} WHERE record_type = 'facility' AND coalesce(state, '') <> '' AND (coalesce(district, '') <> '' OR coalesce(city, '') <> '')
),
hit AS ({' UNION ALL '.join(parts)}),
cut AS (
  SELECT *, greatest(s - {w}, 0) AS l, least(s + n + {w}, length(description)) AS r FROM hit WHERE confidence IS NOT NULL
)
SELECT record_id AS facility_id, coalesce(entity_name, '') AS facility_name, state,
       coalesce(nullif(district, ''), city) AS district_or_city,
       coalesce(nullif(district_source, ''), CASE WHEN coalesce(district, '') <> '' THEN 'source_district' ELSE 'city_fallback' END) AS district_source,
       capability, 'claimed' AS claim_status, confidence,
       CASE WHEN confidence = 'weak' THEN 'Facility type is ' || replace(kind, '_', ' ') || '; capability requires verification.'
            ELSE CASE WHEN l > 0 THEN '...' ELSE '' END
                 || regexp_replace({strip('substr(description, l + 1, r - l)')}, '\\s+', ' ', 'g')
                 || CASE WHEN r < length(description) THEN '...' ELSE '' END END AS evidence_text,
       CASE confidence WHEN 'strong' THEN {quote(taxonomy.strong_reason)} WHEN 'weak' THEN {quote(taxonomy.hint_reason)}
            ELSE {quote(taxonomy.partial_reason)} END AS uncertainty_reason,
       CASE confidence WHEN 'weak' THEN {quote(taxonomy.hint_method)} ELSE {quote(taxonomy.method)} END AS extraction_method
FROM cut"""


def _risk(need: cfg.Need) -> str:
    terms = [((f"(100.0::DOUBLE - {i})" if gap else i), w) for i, w, gap in need.risk]
    total = " + ".join(f"coalesce({x} * {w}::DOUBLE, 0)" for x, w in terms)
    weight = " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for x, w in terms)
    return f"CASE WHEN ({weight}) > 0 THEN greatest(0, least(100, ({total}) / ({weight}))) ELSE 50.0::DOUBLE END"


def _floor(need: cfg.Need) -> str:
    terms = " + ".join(f"least({cap}::DOUBLE, ({' + '.join(cols)}) * {slope}::DOUBLE)" for cap, slope, cols in need.floor)
    return f"CASE WHEN total_facilities = 0 THEN 0.0::DOUBLE ELSE least({need.floor_cap}::DOUBLE, {terms}) END"


def _supply(need: cfg.Need) -> str:
    claimed = " + ".join(f"supply_{c} * {w}::DOUBLE" for c, w in need.supply.items())
    return (
        f"greatest(CASE WHEN relevant_claims > 0 THEN least(100.0::DOUBLE, ({claimed}) * (100.0::DOUBLE / 6.0::DOUBLE)) "
        f"ELSE 0.0::DOUBLE END, {_floor(need)})"
    )


def _scarcity(need: cfg.Need) -> str:
    missing = " + ".join(f"CASE WHEN claims_{c} = 0 THEN 1 ELSE 0 END" for c in need.core)
    return (
        f"greatest(0, least(100, 100.0::DOUBLE - supply + ({missing}) * {need.missing_core_penalty}::DOUBLE "
        "+ CASE WHEN relevant_claims = 0 THEN 10.0::DOUBLE ELSE 0 END))"
    )


def per_need(build, needs) -> str:
    return "CASE care_need " + " ".join(f"WHEN {quote(n.key)} THEN {build(n)}" for n in needs) + " END"


def claim_signals(source: str, needs=cfg.NEEDS) -> str:
    caps = list(dict.fromkeys(c for n in needs for c in n.capabilities))
    place = f"coalesce({canonical_state('state')}, coalesce(state, ''))"
    weight = (
        f"({weights('confidence', cfg.CONFIDENCE_WEIGHT, '0.00')}) * "
        f"({weights('district_source', cfg.SOURCE_WEIGHT, cfg.UNKNOWN_SOURCE_WEIGHT)})"
    )
    need_rows = " UNION ALL ".join(
        f"SELECT {quote(n.key)} AS care_need, unnest([{', '.join(quote(c) for c in n.capabilities)}]) AS capability" for n in needs
    )
    return f"""
SELECT care_need, coalesce({name_key('label')}, '') AS state_key,
       coalesce({name_key(canonical_district('label', 'district_or_city'))}, '') AS district_key,
       sum(w) AS weighted_supply, {', '.join(f"sum(w) FILTER (capability = '{c}') AS supply_{c}" for c in caps)},
       {', '.join(f"count(*) FILTER (capability = '{c}') AS claims_{c}" for c in caps)},
       count(*) AS relevant_claims, count(*) FILTER (confidence = 'strong') AS strong_claims,
       count(*) FILTER (confidence = 'partial') AS partial_claims, count(*) FILTER (confidence = 'weak') AS weak_claims,
       count(*) FILTER (confidence = 'conflicting') AS conflicting_claims,
       count(*) FILTER (district_source = 'pincode_inferred') AS pincode_inferred_claims,
       count(*) FILTER (district_source = 'city_fallback') AS city_fallback_claims,
       count(*) FILTER (district_source = 'missing_location') AS missing_location_claims
FROM (SELECT *, {place} AS label, {weight} AS w FROM {source}) JOIN ({need_rows}) USING (capability)
GROUP BY ALL"""


def facility_signals(source: str) -> str:
    kind = f"lower({strip('facility_type')})"
    counts = ", ".join(f"count(*) FILTER ({kind} = '{t}') AS {c}" for c, t in cfg.FACILITY_COUNTS.items())
    return f"""
SELECT coalesce({name_key('label')}, '') AS state_key, coalesce({name_key('place')}, '') AS district_key,
       count(*) AS total_facilities, {counts}
FROM (SELECT *, {canonical_district('label', 'own')} AS place FROM (
        SELECT *, coalesce({canonical_state('state')}, coalesce(state, '')) AS label, coalesce(nullif(district, ''), city) AS own
        FROM {source} WHERE record_type = 'facility'))
WHERE label <> '' AND coalesce(own, '') <> '' AND place <> '' GROUP BY ALL"""


def scores(records: str, claims_rel: str, needs=cfg.NEEDS) -> str:
    """Unrounded scores per (district, need), from relations of records and claims."""
    caps = list(dict.fromkeys(c for n in needs for c in n.capabilities))
    indicators = list(dict.fromkeys(i for n in needs for i, _, _ in n.risk))
    counts = [
        "relevant_claims", "strong_claims", "partial_claims", "weak_claims", "conflicting_claims", "pincode_inferred_claims",
        "city_fallback_claims", "missing_location_claims", *[f"claims_{c}" for c in caps], "total_facilities", *cfg.FACILITY_COUNTS,
    ]
    sums = ["weighted_supply", *[f"supply_{c}" for c in caps]]
    filled = ", ".join([f"coalesce({c}, 0) AS {c}" for c in counts] + [f"coalesce({c}::DOUBLE, 0) AS {c}" for c in sums])
    nothing = "relevant_claims = 0 AND total_facilities = 0"
    return f"""
WITH cs AS ({claim_signals(claims_rel, needs)}),
fs AS ({facility_signals(records)}),
d AS (
  SELECT record_id AS district_id, coalesce(entity_name, '') AS district_name, coalesce(state, '') <> '' AS has_state,
         coalesce({canonical_state('state')}, coalesce(state, '')) AS state, {', '.join(indicators)}
  FROM {records} WHERE record_type = 'district'
),
k AS (
  SELECT d.*, care_need, coalesce({name_key('state')}, '') AS state_key,
         coalesce({name_key(canonical_district('state', 'district_name'))}, '') AS district_key
  FROM d CROSS JOIN (SELECT unnest([{', '.join(quote(n.key) for n in needs)}]) AS care_need)
),
s AS (
  SELECT district_id, district_name, has_state, state, care_need, {', '.join(indicators)}, {filled}
  FROM k LEFT JOIN cs USING (care_need, state_key, district_key) LEFT JOIN fs USING (state_key, district_key)
),
a AS (
  SELECT *, {per_need(_risk, needs)} AS risk, {per_need(_supply, needs)} AS supply,
         CASE WHEN relevant_claims = 0 THEN 0.0::DOUBLE ELSE greatest(0, least(100,
           least(100.0::DOUBLE, weighted_supply * 20.0::DOUBLE) * 0.7::DOUBLE
           + (strong_claims::DOUBLE / relevant_claims) * 100.0::DOUBLE * 0.3::DOUBLE
           - (least(20.0::DOUBLE, city_fallback_claims * 5.0::DOUBLE) + least(35.0::DOUBLE, missing_location_claims * 10.0::DOUBLE)))) END AS evidence,
         greatest(0, least(100, 100.0::DOUBLE - CASE WHEN NOT has_state THEN 25 ELSE 0 END - CASE WHEN district_name = '' THEN 25 ELSE 0 END
           - CASE WHEN {nothing} THEN 20 ELSE 0 END - least(25.0::DOUBLE, city_fallback_claims * 5.0::DOUBLE)
           - least(40.0::DOUBLE, missing_location_claims * 10.0::DOUBLE))) AS quality
  FROM s
),
b AS (SELECT *, {per_need(_scarcity, needs)} AS scarcity FROM a)
SELECT *, greatest(0, least(100, risk * 0.50::DOUBLE + scarcity * 0.30::DOUBLE + (100.0::DOUBLE - evidence) * 0.15::DOUBLE
         + (100.0::DOUBLE - quality) * 0.05::DOUBLE)) AS priority,
       CASE WHEN {nothing} THEN 'missing' WHEN conflicting_claims > 0 THEN 'conflicting'
            WHEN quality < 65 OR city_fallback_claims > 0 OR missing_location_claims > 0 THEN 'weak'
            WHEN strong_claims >= 2 AND strong_claims >= partial_claims THEN 'strong'
            WHEN strong_claims > 0 OR partial_claims > 0 THEN 'partial' ELSE 'weak' END AS uncertainty_label
FROM b"""


def fixed1(x: str) -> str:
    return f"printf('%.1f', {x})"


def gaps(scored: str) -> str:
    """Served gap rows from a relation of unrounded scores."""
    level = "CASE WHEN priority >= 70 THEN 'High planning priority' WHEN priority >= 45 THEN 'Medium planning priority' ELSE 'Watch' END"
    note = (
        "CASE WHEN relevant_claims = 0 AND total_facilities > 0 THEN 'No capability-specific claims were found, but ' || total_facilities "
        "|| ' facilities provide a weak general supply floor.' WHEN relevant_claims = 0 THEN "
        "'No relevant facility claims were found for this care need.' ELSE 'Found ' || relevant_claims || ' relevant claimed capabilities (' "
        "|| strong_claims || ' strong, ' || partial_claims || ' partial).' END"
    )
    served = {"planning_priority_score": "priority", "risk_score": "risk", "supply_score": "supply", "evidence_score": "evidence", "data_quality_score": "quality"}
    rounded = ", ".join(f"{fixed1(x)}::DOUBLE AS {name}" for name, x in served.items())
    return f"""
SELECT district_id, district_name, state, care_need, {rounded}, relevant_claims, strong_claims, partial_claims,
       pincode_inferred_claims, city_fallback_claims, uncertainty_label,
       {level} || ': health-risk signal is ' || {fixed1('risk')} || '/100, claimed supply signal is ' || {fixed1('supply')}
       || '/100, and evidence strength is ' || {fixed1('evidence')} || '/100. ' || {note} || ' Overall evidence label is '
       || uncertainty_label || '; review cited facility text before making an intervention decision.' AS explanation
FROM {scored}"""
