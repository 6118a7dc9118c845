"""The reviewer's queries, and planner actions from the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from needmap import config as cfg
from needmap.operators import actions as A
from needmap.operators import review as R
from needmap.session import shared_folder
from needmap.sources.writers import mirror

from . import rollups
from . import sources as src
from . import sqltext as S
from .evidence_queries import GAPS, document_claims, document_gaps
from .registry import query, with_ctes

C = F.col
NEED = "maternal_emergency"
_SERVED = "* REPLACE (trim(district_name) AS district_name)"


@query("review_queue", with_ctes(f"""
SELECT {_SERVED} FROM gaps WHERE care_need = '{NEED}' AND supply_score > 0 AND state = 'Kerala'
ORDER BY planning_priority_score DESC, district_id LIMIT 60""", **GAPS))
def review_queue(t):
    return R.review_queue(document_gaps(t), NEED, state="Kerala").drop("updated_at")


@query("review_queue_missing", with_ctes(f"""
SELECT {_SERVED} FROM gaps WHERE care_need = 'dialysis_access' AND supply_score = 0 AND uncertainty_label = 'missing'
ORDER BY planning_priority_score DESC, district_id LIMIT 200""", **GAPS))
def review_queue_missing(t):
    return R.review_queue(document_gaps(t), "dialysis_access", evidence="missing", mode="missing_info", limit=200).drop("updated_at")


@query("queue_states", with_ctes(f"SELECT DISTINCT state FROM gaps WHERE care_need = '{NEED}' AND supply_score = 0 AND state <> ''", **GAPS))
def queue_states(t):
    return R.queue_states(document_gaps(t), NEED, "missing_info")


@query("evidence_list", with_ctes("""
SELECT facility_id, facility_name, state, district_or_city, district_source, capability, confidence, evidence_text FROM (
  SELECT c.* REPLACE (coalesce(nullif(trim(CASE WHEN doc.doc_id % 2 = 0 THEN ' ' ELSE doc.source || ' ' || doc.doc_id END), ''), facility_name) AS facility_name,
                      coalesce(nullif(trim(CASE WHEN doc.lang = 'de' THEN 'Kerala' END), ''), state) AS state)
  FROM claims AS c LEFT JOIN documents AS doc ON facility_id = 'facility:' || """ + src.uuid_sql("doc_id::VARCHAR") + """)
WHERE state = 'Kerala' AND lower(trim(district_or_city)) = 'src2' AND capability IN (""" + ", ".join(S.quote(c) for c in cfg.NEEDS[0].capabilities) + ")", **GAPS))
def evidence_list(t):
    fresh = t.documents.select(
        F.concat(F.lit("facility:"), src.uuid_of(C("doc_id").cast("string"))).alias("facility_id"),
        F.when(C("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.concat_ws(" ", "source", "doc_id")).alias("facility_name"),
        F.when(C("lang") == "de", F.lit("Kerala")).alias("analysis_state"),
        F.lit(None).cast("string").alias("analysis_district"), F.lit("").alias("district_source"),
    )
    found = R.facility_evidence(document_claims(t), fresh, NEED, "Kerala", " SRC2 ")
    return found.select("facility_id", "facility_name", "state", "district_or_city", "district_source", "capability", "confidence", "evidence_text")


# ---------------------------------------------------------------- actions: the event log as planner writes

# The district of an event is a document source in Kerala; one need per event type.
_NEEDS = {"click": NEED, "view": NEED, "error": "critical_care", "signup": "critical_care", "purchase": "dialysis_access"}
LOG_SQL = f"""
SELECT {src.pick_sql('event_type', _NEEDS)} AS care_need, 'Kerala' AS state, 'src' || user_id AS district_name,
       'district:/en/src' || user_id AS district_id, value > 20 AS shortlisted, value > 60 AS dismissed, value < 15 AS verification_requested,
       CASE WHEN value < 100 THEN round(value)::DECIMAL(5,2) END AS override_score, event_type || ' ' || value AS override_reason,
       props || event_id AS note_text, 'f' || user_id AS facility_id, event_type AS capability, value > 30 AS requested, props AS reason,
       event_id AS seq, event_id AS id, ts AS updated_at, ts AS created_at FROM events"""


def action_log(t):
    v, user = C("value"), C("user_id").cast("string")
    return t.events.select(
        src.pick(C("event_type"), _NEEDS).alias("care_need"), F.lit("Kerala").alias("state"),
        F.concat(F.lit("src"), user).alias("district_name"), F.concat(F.lit("district:/en/src"), user).alias("district_id"),
        (v > 20).alias("shortlisted"), (v > 60).alias("dismissed"), (v < 15).alias("verification_requested"),
        F.when(v < 100, F.round(v).cast("decimal(5,2)")).alias("override_score"),
        F.concat("event_type", F.lit(" "), v.cast("string")).alias("override_reason"),
        F.concat("props", C("event_id").cast("string")).alias("note_text"), F.concat(F.lit("f"), user).alias("facility_id"),
        C("event_type").alias("capability"), (v > 30).alias("requested"), C("props").alias("reason"),
        C("event_id").alias("seq"), C("event_id").alias("id"), C("ts").alias("updated_at"), C("ts").alias("created_at"),
    )


DECISION = ["care_need", "state", "district_name", "district_id", "shortlisted", "dismissed", "verification_requested", "seq", "updated_at", "created_at"]
OVERRIDE = ["care_need", "state", "district_name", "district_id", "override_score", "override_reason", "seq", "updated_at", "created_at"]
VERIFICATION = ["care_need", "facility_id", "capability", "requested", "reason", "seq", "updated_at", "created_at"]
NOTE = ["care_need", "state", "district_name", "district_id", "note_text", "id", "created_at"]


def _latest_sql(columns: list[str], keys: tuple[str, ...]) -> str:
    k = ", ".join(keys)
    rest = [c for c in columns if c != "created_at"]
    return (
        f"SELECT {', '.join(rest)}, first_at AS created_at FROM (SELECT *, min(created_at) OVER (PARTITION BY {k}) AS first_at, "
        f"row_number() OVER (PARTITION BY {k} ORDER BY updated_at DESC, seq DESC) AS r FROM log) WHERE r = 1"
    )


_D, _F = A.DISTRICT_KEY, A.FACILITY_KEY
_NOTES_SQL = (
    "SELECT care_need, state, district_name, district_id, note_text AS note_latest, created_at FROM (SELECT *, row_number() OVER "
    "(PARTITION BY care_need, state, district_name ORDER BY created_at DESC, id DESC) AS r FROM log) WHERE r = 1"
)
LOG = {
    "log": LOG_SQL, "decisions": _latest_sql(DECISION, _D), "overrides": _latest_sql(OVERRIDE, _D),
    "verifications": _latest_sql(VERIFICATION, _F), "notes": _NOTES_SQL,
}


@query("latest_actions", with_ctes("SELECT * FROM decisions", **LOG))
def latest_actions(t):
    return A.latest_decisions(action_log(t).select(*DECISION))


@query("latest_overrides", with_ctes("SELECT * REPLACE (override_score::DOUBLE AS override_score) FROM overrides", **LOG))
def latest_overrides(t):
    return A.latest_overrides(action_log(t).select(*OVERRIDE)).withColumn("override_score", C("override_score").cast("double"))


@query("latest_verifications", with_ctes("SELECT * FROM verifications", **LOG))
def latest_verifications(t):
    return A.latest_verifications(action_log(t).select(*VERIFICATION))


@query("latest_notes", with_ctes("SELECT * FROM notes", **LOG))
def latest_notes(t):
    return A.latest_notes(action_log(t).select(*NOTE))


@query("load_actions", with_ctes(f"""
SELECT kind, count(*) AS rows FROM (SELECT 'decisions' AS kind, care_need FROM decisions UNION ALL SELECT 'notes', care_need FROM notes
  UNION ALL SELECT 'overrides', care_need FROM overrides UNION ALL SELECT 'verifications', care_need FROM verifications)
WHERE care_need = '{NEED}' GROUP BY ALL""", **LOG))
def load_actions(t):
    log = action_log(t)
    frames = A.load_actions(NEED, log.select(*DECISION), log.select(*NOTE), log.select(*OVERRIDE), log.select(*VERIFICATION))
    counted = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "rows") for kind, f in frames.items()]
    first, *rest = counted
    for frame in rest:
        first = first.unionByName(frame)
    return first


_MERGED = """
SELECT care_need, state, district_name, coalesce(shortlisted, false) AS shortlisted, coalesce(verification_requested, false) AS verification_requested,
       coalesce(dismissed, false) AS dismissed, coalesce(note_latest, '') AS note_latest, override_score::DOUBLE AS override_score, coalesce(override_reason, '') AS override_reason
FROM (SELECT * REPLACE (CASE WHEN care_need = 'critical_care' THEN district_name || ' West' ELSE district_name END AS district_name) FROM decisions) AS a
FULL JOIN (SELECT care_need, state, district_name, note_latest FROM notes) AS n USING (care_need, state, district_name)
FULL JOIN (SELECT care_need, state, district_name, override_score, override_reason FROM overrides) AS o USING (care_need, state, district_name)"""


def merged(t):
    log = action_log(t)
    # Some decisions are about districts that have neither notes nor overrides, and the other way round.
    moved = F.when(C("care_need") == "critical_care", F.concat("district_name", F.lit(" West"))).otherwise(C("district_name"))
    decisions = A.latest_decisions(log.select(*DECISION)).withColumn("district_name", moved)
    return A.merge_actions(decisions, A.latest_notes(log.select(*NOTE)), A.latest_overrides(log.select(*OVERRIDE)))


@query("merged_actions", with_ctes(_MERGED, **LOG))
def merged_actions(t):
    return merged(t).withColumn("override_score", C("override_score").cast("double"))


@query("upsert", with_ctes("""
SELECT care_need, state, district_name, district_id, shortlisted, dismissed, verification_requested, seq, updated_at, first_at AS created_at FROM (
  SELECT *, min(created_at) OVER (PARTITION BY care_need, state, district_name) AS first_at,
         row_number() OVER (PARTITION BY care_need, state, district_name ORDER BY value_part DESC, updated_at DESC, seq DESC) AS r
  FROM (SELECT *, capability <> 'click' AS value_part FROM log)) WHERE r = 1""", **LOG))
def upserted(t):
    log = action_log(t)
    base = A.latest_decisions(log.where(C("capability") == "click").select(*DECISION))
    return A.upsert(base, log.where(C("capability") != "click").select(*base.columns), A.DISTRICT_KEY)


@query("check_actions", with_ctes("""
SELECT seq, concat_ws('|', CASE WHEN care_need = '' THEN 'blank_care_need' END, CASE WHEN override_score < 0 OR override_score > 100 THEN 'score_out_of_range' END,
       CASE WHEN length(trim(override_reason)) > 2000 THEN 'long_override_reason' END) AS broken
FROM (SELECT seq, CASE WHEN capability = 'click' THEN '' ELSE care_need END AS care_need, override_score * 2 AS override_score,
             CASE WHEN capability = 'view' THEN repeat(override_reason, 400) ELSE override_reason END AS override_reason FROM log)""", **LOG))
def check_actions(t):
    log = action_log(t).select(
        *[c for c in OVERRIDE if c not in ("care_need", "override_score", "override_reason")],
        F.when(C("capability") == "click", F.lit("")).otherwise(C("care_need")).alias("care_need"),
        (C("override_score") * 2).alias("override_score"),
        F.when(C("capability") == "view", F.repeat("override_reason", 400)).otherwise(C("override_reason")).alias("override_reason"),
    )
    return A.check_actions(log).select("seq", F.array_join(F.transform("issues", lambda i: i["rule"]), "|").alias("broken"))


_OVERLAID = f"""
SELECT g.* REPLACE (trim(g.district_name) AS district_name), CASE WHEN supply_score = 0 THEN 'Info needed' WHEN display_score >= 70 THEN 'High' WHEN display_score >= 45 THEN 'Medium' ELSE 'Watch' END AS priority_label,
       concat_ws('|', CASE WHEN shortlisted THEN 'shortlisted' END, CASE WHEN verification_requested THEN CASE WHEN supply_score = 0 THEN 'info requested' ELSE 'verify' END END,
                 CASE WHEN override_score IS NOT NULL THEN 'override' END) AS badges
FROM (SELECT g.*, coalesce(shortlisted, false) AS shortlisted, coalesce(verification_requested, false) AS verification_requested, coalesce(dismissed, false) AS dismissed,
             coalesce(note_latest, '') AS note_latest, m.override_score, coalesce(override_reason, '') AS override_reason,
             coalesce(override_score, planning_priority_score) AS display_score
      FROM (SELECT * FROM gaps WHERE care_need = '{NEED}' AND supply_score > 0 ORDER BY planning_priority_score DESC, district_id LIMIT 60) AS g
      LEFT JOIN merged AS m USING (care_need, state, district_name)) AS g"""


def overlaid(t):
    queue = R.review_queue(document_gaps(t), NEED)
    return R.overlay_queue(queue, merged(t))


@query("overlay_queue", with_ctes(_OVERLAID, **GAPS, **LOG, merged=_MERGED))
def overlay_queue(t):
    return overlaid(t).drop("updated_at").withColumn("override_score", C("override_score").cast("double"))


@query("queue_stats", with_ctes("""
SELECT count(*) FILTER (planning_priority_score >= 70) AS high, count(*) FILTER (uncertainty_label = 'missing') AS missing, count(*) FILTER (relevant_claims > 0) AS reviewable FROM o""",
    **GAPS, **LOG, merged=_MERGED, o=_OVERLAID))
def queue_stats(t):
    return R.queue_stats(overlaid(t))


@query("overlay_verifications", with_ctes("""
SELECT c.facility_id, c.capability, coalesce(requested, false) AS requested, coalesce(reason, '') AS reason
FROM (SELECT 'f' || (l_suppkey) AS facility_id, CASE l_returnflag WHEN 'R' THEN 'click' WHEN 'A' THEN 'view' ELSE 'none' END AS capability FROM lineitem) AS c
LEFT JOIN verifications AS v ON c.facility_id = v.facility_id AND c.capability = v.capability""", **LOG))
def overlay_verifications(t):
    claims = t.lineitem.select(
        F.concat(F.lit("f"), C("l_suppkey").cast("string")).alias("facility_id"),
        F.when(C("l_returnflag") == "R", F.lit("click")).when(C("l_returnflag") == "A", F.lit("view")).otherwise(F.lit("none")).alias("capability"),
    )
    return R.overlay_verifications(claims, A.latest_verifications(action_log(t).select(*VERIFICATION)))


@query("mirror_rows", with_ctes(f"SELECT {', '.join(cfg.MIRROR_FIELDS)} FROM enriched", **rollups.CTES))
def mirror_rows(t):
    path = shared_folder(t.spark, f"mirror-{uuid.uuid4().hex}")
    mirror(rollups.enriched_table(t), path)
    return t.spark.read.parquet(path)
