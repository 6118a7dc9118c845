"""Whole jobs and gated writes: each query returns what was stored."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from needmap import config as cfg
from needmap.operators import quality as Q
from needmap.operators.evidence import extract_claims
from needmap.plans import enriched as E
from needmap.plans import gaps as N
from needmap.plans import jobs as J
from needmap.session import shared_folder
from needmap.sources import writers as W
from needmap.sources.readers import read_csv, read_csv_lines

from . import evidence_queries as evidence
from . import records_queries as records
from . import rollups
from . import sources as src
from . import sqltext as S
from .registry import query, with_ctes

C = F.col


def phrase_of(pattern: str) -> str:
    """A text that the pattern matches: optional parts left out, the first of several choices taken."""
    text = pattern.replace(r"\b", "")
    text = re.sub(r"\\s[*+]|\.\*", " ", text)
    text = re.sub(r"\[([^\]])[^\]]*\]\??", r"\1", text)
    while "(" in text:
        text = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)
    text = re.sub(r"(\\?.)[?*]", lambda m: "" if m[1] != "." else "", text)
    return text.replace("\\", "").replace(".", "")


def _table() -> str:
    return f"needmap_{uuid.uuid4().hex}"


def _path(t) -> str:
    return shared_folder(t.spark, _table())


def numbered(rows, file, line):
    """Rows of ordered files with the line each would have if the files were one."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = rows.groupBy(C(file).alias("file")).count().select(C("file").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return rows.join(files, C(file) == C("_of")).withColumn(line, C("_before") + C(line)).drop("_of", "_before")


@query("publish", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS rows FROM orders")
def publish(t):
    name = _table()
    W.publish_candidate(t.orders.where("o_orderkey < 0"), name, apply=True)
    done = W.publish_candidate(t.orders, name, lambda stored: Q.check_grain(t.orders, stored, "o_orderkey"), apply=True)
    return t.spark.table(name).select("o_orderkey", "o_orderstatus", F.lit(done["rows"]).alias("rows"))


@query("build_job", with_ctes("SELECT * FROM enriched", **rollups.CTES))
def build_job(t):
    name = _table()
    J.build_job(src.facilities(t), src.directory(t), src.districts(t), name, apply=True)
    return rollups.flat(t.spark.table(name).drop("created_at"))


_REJECTED = """(record_type = 'facility' AND (entity_name IS NULL OR trim(entity_name) = ''
         OR regexp_matches(entity_name, '^\\s*(?:[\\[{]|\\*|__|>|#)')
         OR regexp_matches(description, '^\\s*(?:-?\\d+(?:\\.\\d+)?|true|false|null|\\[|\\{)\\s*$')))"""


@query("rebuild_job", with_ctes(f"SELECT record_id, record_type, entity_name, coalesce({_REJECTED}, false) AS rejected FROM rebuilt", **records.SOURCE_CTES, rebuilt=records.REBUILT_SQL))
def rebuild_job(t):
    name = _table()
    J.rebuild_job(src.facilities(t), src.directory(t), src.districts(t), name, apply=True)
    stored = {rejected: t.spark.table(name + ("_quarantine" if rejected else "")) for rejected in (False, True)}
    parts = [frame.select("record_id", "record_type", "entity_name", F.lit(rejected).alias("rejected")) for rejected, frame in stored.items()]
    return parts[0].unionByName(parts[1])


_EXPORTED = ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in cfg.RECORD_FIELDS)


@query("export", with_ctes(f"SELECT {_EXPORTED}, (SELECT count(*) FROM issues WHERE severity = 'error') AS errors FROM damaged", **records.SOURCE_CTES, **(records.ISSUE_CTES | {"damaged": records.REBUILT_SQL})))
def export(t):
    path = _path(t)
    W.export_snapshot(records.rebuilt(t), path, validate=False)  # the gate would stop here: its errors are counted instead
    rows = read_csv(t.spark, path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in cfg.RECORD_FIELDS], F.lit(Q.report(rows)["errors"]).cast("long").alias("errors"))


@query("export_order", with_ctes(
    "SELECT row_number() OVER (ORDER BY record_type NULLS FIRST, record_id NULLS FIRST) AS position, record_type, record_id FROM rebuilt",
    **records.SOURCE_CTES, rebuilt=records.REBUILT_SQL))
def export_order(t):
    """Where each record stands in the exported files, read one after the other."""
    path = _path(t)
    W.export_snapshot(records.rebuilt(t), path, validate=False)
    rows = numbered(read_csv_lines(t.spark, path, file="file", line="line"), "file", "line")
    return rows.select((C("line") - 1).alias("position"), "record_type", "record_id")


_PRESENT = lambda c: f"count(*) FILTER (record_type = 'facility' AND {S.strip(f'{c}::VARCHAR')} <> '')"
_LENGTH = f"CASE WHEN record_type = 'facility' THEN coalesce(length({S.strip('description')}), 0) END"
_WANTED = "SELECT * FROM claims WHERE capability IN (" + ", ".join(S.quote(c) for c in cfg.NEEDS[0].capabilities) + ")"
_UNKNOWN = lambda c: f"coalesce(nullif({S.strip(c)}, ''), 'Unknown')"


@query("inspect", with_ctes(
    "SELECT section, item, value::DOUBLE AS value FROM (\n" + "\nUNION ALL ".join([
        "SELECT 'records' AS section, 'rows' AS item, count(*) AS value FROM records",
        *[f"SELECT 'records', '{kind}', count(*) FROM records WHERE record_type = '{kind}'" for kind in ("facility", "district")],
        *[f"SELECT 'present', '{name}', {_PRESENT(c)} FROM records" for name, c in (*((c, c) for c in ("description", "state", "city", "pincode", "district")), ("source_district", "district"))],
        f"SELECT 'text', 'median_length', median({_LENGTH}) FROM records", f"SELECT 'text', 'short', count(*) FILTER ({_LENGTH} BETWEEN 1 AND 39) FROM records",
        *[f"SELECT 'coverage', {S.quote(k)}, count(DISTINCT facility_id) FROM claims WHERE capability = {S.quote(k)}" for k in src.DOCUMENT_TAXONOMY.keys],
        f"(SELECT 'state', {_UNKNOWN('state')} AS i, count(*) AS n FROM wanted GROUP BY ALL ORDER BY n DESC, i LIMIT 12)",
        f"(SELECT 'place', {_UNKNOWN('district_or_city')} || ', ' || {_UNKNOWN('state')} AS i, count(*) AS n FROM wanted GROUP BY ALL ORDER BY n DESC, i LIMIT 12)",
    ]) + ")", **evidence.CTES, wanted=_WANTED))
def inspect(t):
    return N.inspection(src.document_records(t), taxonomy=src.DOCUMENT_TAXONOMY)


@query("line_numbers", with_ctes(
    "SELECT source_line_number, rule, record_id FROM issues JOIN (SELECT record_id AS id, row_number() OVER (ORDER BY record_id) + 1 AS source_line_number FROM damaged) ON id IS NOT DISTINCT FROM record_id",
    **records.ISSUE_CTES))
def line_numbers(t):
    path = _path(t)
    W.write_csv(records.damaged(t).orderBy("record_id"), path)  # a file for each range of ids, so no task has them all
    rows = numbered(read_csv_lines(t.spark, path), "source_file", "source_line_number")
    return Q.validate(rows, columns=("record_id", "source_line_number")).select("source_line_number", "rule", "record_id")


@query("load_prepared", with_ctes("SELECT district_id, care_need, relevant_claims::INT AS relevant_claims, (SELECT count(*) FROM claims) AS claims FROM gaps", **evidence.GAPS))
def load_prepared(t):
    claims, gaps = _path(t), _path(t)
    whole = lambda frame, names: frame.withColumns({n: F.coalesce(n, F.lit("unknown")) for n in names})
    found = whole(evidence.document_claims(t), ["facility_name", "state", "district_or_city", "district_source"])
    done = W.load_prepared(found, whole(evidence.document_gaps(t), ["state", "district_name"]), claims, gaps)
    return W.stored(t.spark, gaps).select("district_id", "care_need", "relevant_claims", F.lit(done["claims"]).cast("long").alias("claims"))


@query("run_all", with_ctes("SELECT district_id, care_need, relevant_claims, strong_claims, uncertainty_label FROM gaps", **evidence.GAPS))
def run_all(t):
    claims, gaps = _path(t), _path(t)
    N.run_all(src.document_records(t), claims, gaps, taxonomy=src.DOCUMENT_TAXONOMY, skip_validation=True)
    return W.stored(t.spark, gaps).select("district_id", "care_need", "relevant_claims", "strong_claims", "uncertainty_label")


@query("report", with_ctes("SELECT rule, severity, count(*) AS issues, (SELECT count(*) FROM damaged) AS rows, min(record_id) AS example FROM issues GROUP BY ALL", **records.ISSUE_CTES))
def report(t):
    got = Q.report(records.damaged(t), examples=100)
    rows = [(e["rule"], e["severity"], got["rules"][e["rule"]], got["rows"], e["record_id"]) for e in got["examples"]]
    return t.spark.createDataFrame(rows, "rule string, severity string, issues long, rows long, example string")


_SPELLINGS = "(SELECT CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN 'Orissa' WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderstatus END AS place FROM orders)"


@query("unknown_states", f"SELECT place, count(*) AS rows FROM {_SPELLINGS} WHERE trim(place) <> '' AND {S.canonical_state('place')} IS NULL GROUP BY ALL")
def unknown_states(t):
    k = C("o_orderkey")
    named = t.orders.select(F.when(k % 7 == 0, F.lit(" ")).when(k % 3 == 0, F.lit("Orissa")).when(k % 5 == 0, C("o_orderpriority")).otherwise(C("o_orderstatus")).alias("place"))
    return Q.unknown_labels(named, "place", cfg.PLACES.states)


# ---------------------------------------------------------------- the shipped taxonomy

# One phrase for each pattern of the taxonomy, in the patterns' order (each is checked to match in the tests).
PHRASES = {
    (k.key, strength, at): phrase
    for k in cfg.CAPABILITIES
    for strength, patterns in (("strong", k.strong), ("partial", k.partial))
    for at, phrase in enumerate(map(phrase_of, patterns))
}
_LIST = tuple(PHRASES.values())
_N = len(_LIST)


def planted(t):
    """Documents with a phrase put before, inside or after the text by number; case and line breaks vary."""
    number = C("doc_id") % _N
    phrase = F.element_at(F.array(*map(F.lit, _LIST)), (number + 1).cast("int"))
    phrase = F.when(C("doc_id") % 2 == 0, F.upper(phrase)).otherwise(phrase)
    glue = F.when(C("doc_id") % 5 == 0, F.lit("\n")).otherwise(F.lit(" "))
    text = (
        F.when(C("doc_id") % 3 == 0, F.concat(phrase, glue, "text")).when(C("doc_id") % 3 == 1, F.concat("text", glue, phrase))
        .otherwise(F.concat(F.substring("text", 1, 40), glue, phrase, glue, F.expr("substring(text, 41)")))
    )
    return t.documents.select(F.concat(F.lit("d"), "doc_id").alias("record_id"), text.alias("description"))


_PLANTED_SQL = f"""
SELECT 'd' || doc_id AS record_id, 'facility' AS record_type, 'x' AS entity_name, 'x' AS state, 'x' AS district, NULL AS city, NULL::VARCHAR AS facility_type, NULL::VARCHAR AS district_source,
       CASE doc_id % 3 WHEN 0 THEN phrase || glue || text WHEN 1 THEN text || glue || phrase ELSE substr(text, 1, 40) || glue || phrase || glue || substr(text, 41) END AS description
FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN chr(10) ELSE ' ' END AS glue,
             CASE WHEN doc_id % 2 = 0 THEN upper(p) ELSE p END AS phrase
      FROM (SELECT doc_id, text, [{', '.join(map(S.quote, _LIST))}][doc_id % {_N} + 1] AS p FROM documents))"""


@query("claims_of_phrases", with_ctes(
    "SELECT facility_id, capability, confidence, evidence_text FROM claims", records=_PLANTED_SQL, claims=S.claims("records", cfg.TAXONOMY)))
def claims_of_phrases(t):
    rows = planted(t).select(
        "record_id", F.lit("facility").alias("record_type"), "description",
        *[F.lit("x").alias(n) for n in ("entity_name", "state", "district")],
        *[F.lit(None).cast("string").alias(n) for n in ("city", "facility_type", "district_source")],
    )
    return extract_claims(rows, cfg.TAXONOMY, evidence.as_of()).select("facility_id", "capability", "confidence", "evidence_text")
