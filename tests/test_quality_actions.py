from datetime import datetime

import pytest
from pyspark.sql import functions as F

from needmap.operators import actions as A
from needmap.operators import quality as Q
from needmap.operators import review as R
from needmap.operators.columns import RECORD_SCHEMA, conform
from needmap.streaming.actions import fold_stream, version_path

GOOD = "facility:11111111-1111-1111-1111-111111111111"
BASE = dict(
    record_id=GOOD, record_type="facility", entity_name="Asha Clinic", facility_type="clinic", operator_type="private",
    description="Asha Clinic is a small private clinic in the old town.",
)


def records(spark, *changes):
    fields = sorted({k for c in changes for k in c} | set(BASE))
    rows = [tuple({**BASE, **c}.get(f) for f in fields) for c in changes]
    return conform(spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)), RECORD_SCHEMA)


@pytest.mark.parametrize(
    "change, rules",
    [
        ({}, []),
        ({"record_type": "clinic", "entity_name": ""}, ["invalid_record_type"]),
        ({"record_id": "facility:  *  __Genomics"}, ["malformed_facility_id"]),
        ({"entity_name": "  "}, ["blank_facility_name"]),
        ({"entity_name": '{"x":1}'}, ["facility_name_column_drift"]),
        ({"facility_type": "temple"}, ["facility_type_column_drift"]),
        ({"operator_type": "2020-01-01"}, ["operator_type_column_drift"]),
        ({"phone": '{"coordinates":[1,2]}'}, ["phone_column_drift"]),
        ({"website": "2020-01-01"}, ["website_column_drift"]), ({"website": "https://a.org"}, []),
        ({"description": "true"}, ["description_column_drift", "short_facility_description"]),
        ({"description": "Small clinic"}, ["possible_description_mismatch", "short_facility_description"]),
        ({"record_type": "pincode", "entity_name": None, "record_id": "x"}, []),
    ],
)
def test_rules(spark, change, rules):
    assert sorted(r["rule"] for r in Q.validate(records(spark, change)).collect()) == rules


def test_report_gate_and_quarantine(spark):
    df = records(spark, {}, {"record_type": "odd"}, {"record_id": "x", "description": "12"}, {"record_type": None})
    result = Q.report(df)
    assert (result["rows"], result["errors"], result["warnings"]) == (4, 4, 1)
    assert {r["record_type"]: r["rows"] for r in result["types"].collect()} == {"<blank>": 1, "facility": 2, "odd": 1}
    assert [e["rule"] for e in result["examples"]] == sorted(result["rules"]) and sum(result["rules"].values()) == 5
    with pytest.raises(Q.GateError):
        Q.gate(result)
    bad = Q.quarantine(df)
    assert bad.count() == 3
    assert bad.where("record_id = 'x'").first()["validation_rules"] == "malformed_facility_id|description_column_drift"
    valid, rejected = Q.split(df, Q.repair_rule())
    assert Q.check_split(df, valid, rejected)["total"] == 4
    assert "Unexpected record_type 'odd'." in [r["message"] for r in Q.validate(df).collect()]


GAPS = [
    ("district:ready", " Ready District ", "Kerala", "maternal_emergency", 71.0, 66.0, 25.0, 40.0, 60.0, 2, 1, 1, 2, 0, "partial", "Evidence exists."),
    ("district:missing", "Missing District", "Kerala", "maternal_emergency", 64.0, 64.0, 0.0, 0.0, 20.0, 0, 0, 0, 0, 0, "missing", "No supply evidence exists."),
]
GAP = (
    "district_id string, district_name string, state string, care_need string, planning_priority_score double, risk_score double, supply_score double, "
    "evidence_score double, data_quality_score double, relevant_claims int, strong_claims int, partial_claims int, pincode_inferred_claims int, city_fallback_claims int, "
    "uncertainty_label string, explanation string"
)


def test_queue_modes(spark):
    gaps = spark.createDataFrame(GAPS, GAP)
    ready = R.review_queue(gaps, "maternal_emergency").collect()
    assert [(r["district_id"], r["district_name"], r["supply_score"]) for r in ready] == [("district:ready", "Ready District", 25.0)]
    assert [r["district_id"] for r in R.review_queue(gaps, "maternal_emergency", mode="missing_info").collect()] == ["district:missing"]
    assert R.review_queue(gaps, "maternal_emergency", evidence="strong").count() == 0
    with pytest.raises(ValueError):
        R.review_queue(gaps, "maternal_emergency", limit=201)
    plan = R.review_queue(gaps, "maternal_emergency")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


T = [datetime(2024, 1, d) for d in range(1, 9)]
LOG = "care_need string, state string, district_name string, district_id string, shortlisted boolean, dismissed boolean, verification_requested boolean, seq long, updated_at timestamp, created_at timestamp"


def write(seq, day, short, name="Pakur"):
    return ("maternal_emergency", "Jharkhand", name, "district:" + name.lower(), short, False, True, seq, T[day], T[day])


def test_fold_and_upsert(spark):
    log = spark.createDataFrame([write(2, 3, True), write(1, 1, False), write(3, 3, False)], LOG)
    last = A.latest_decisions(log).first()
    assert (last["seq"], last["shortlisted"], last["created_at"], last["updated_at"]) == (3, False, T[1], T[3])
    late = spark.createDataFrame([write(9, 0, True), write(1, 5, True, "Dumka")], LOG)
    state = {r["district_name"]: r for r in A.upsert(A.latest_decisions(log), late, A.DISTRICT_KEY).collect()}
    assert state["Pakur"]["seq"] == 9 and state["Pakur"]["created_at"] == T[0] and state["Dumka"]["shortlisted"]


def test_actions_round_trip(spark):
    key = "care_need string, state string, district_name string, district_id string"
    here = ("maternal_emergency", "Jharkhand", "Pakur", "district:pakur")
    notes = spark.createDataFrame([(*here, "old", 1, T[1]), (*here, "Prioritize field team follow-up.", 2, T[1])], key + ", note_text string, id long, created_at timestamp")
    overrides = spark.createDataFrame([(*here, 80.0, "why", 1, T[1], T[1]), (*here, None, "", 2, T[2], T[2])], key + ", override_score double, override_reason string, seq long, updated_at timestamp, created_at timestamp")
    overrides = overrides.withColumn("override_score", F.col("override_score").cast("decimal(5,2)"))
    checks = spark.createDataFrame([("maternal_emergency", "facility:1", "obgyn", True, "Evidence is partial.", 1, T[1], T[1])], "care_need string, facility_id string, capability string, requested boolean, reason string, seq long, updated_at timestamp, created_at timestamp")
    got = A.load_actions("maternal_emergency", spark.createDataFrame([write(1, 1, True)], LOG), notes, overrides, checks)
    assert got["decisions"].count() == 1 and got["notes"].first()["note_latest"] == "Prioritize field team follow-up."
    assert got["verifications"].first()["requested"] and got["overrides"].first()["override_score"] is None
    merged = A.merge_actions(got["decisions"], got["notes"], got["overrides"])
    queue = spark.createDataFrame([("d", "Pakur ", "Jharkhand", *GAPS[0][3:]), ("e", "Other", "Jharkhand", *GAPS[0][3:])], GAP)
    rows = {r["district_id"]: r for r in R.overlay_queue(queue, merged).collect()}
    assert rows["d"]["badges"] == "shortlisted|verify" and rows["d"]["display_score"] == 71.0 and rows["d"]["priority_label"] == "High"
    assert rows["e"]["badges"] == "" and rows["e"]["override_reason"] == ""
    claims = spark.createDataFrame([("facility:1", "obgyn"), ("facility:1", "icu")], "facility_id string, capability string")
    assert {r["capability"]: r["requested"] for r in R.overlay_verifications(claims, got["verifications"]).collect()} == {"obgyn": True, "icu": False}


def test_check_actions(spark):
    log = spark.createDataFrame([("n", "s", "d", "i", 101.0, "x" * 2001), ("n", "s", "", "i", None, "")], "care_need string, state string, district_name string, district_id string, override_score double, override_reason string")
    got = [[i["rule"] for i in r["issues"]] for r in A.check_actions(log).collect()]
    assert got == [["score_out_of_range", "long_override_reason"], ["blank_district_name"]]


def test_stream_keeps_the_folded_state(spark, tmp_path):
    source, state = str(tmp_path / "log"), str(tmp_path / "state")
    spark.createDataFrame([write(1, 1, False), write(2, 2, True)], LOG).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(LOG).parquet(source)

    def run():
        q = fold_stream(stream, state, A.DISTRICT_KEY).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    spark.createDataFrame([write(3, 4, False), write(4, 5, True, "Dumka")], LOG).coalesce(1).write.mode("append").parquet(source)
    run()
    # A late row does not replace a newer one, and the state is that of the whole log.
    spark.createDataFrame([write(5, 0, True), write(6, 3, True, "Dumka")], LOG).coalesce(1).write.mode("append").parquet(source)
    run()
    state_of = lambda df: {r["district_name"]: (r["seq"], r["created_at"]) for r in df.collect()}
    got = state_of(spark.read.parquet(version_path(state, 2)))
    assert {k: v[0] for k, v in got.items()} == {"Pakur": 3, "Dumka": 4}
    assert got == state_of(A.latest_by(spark.read.schema(LOG).parquet(source), A.DISTRICT_KEY))
    import os

    assert not os.path.exists(version_path(state, 0)) and os.path.exists(version_path(state, 1))
