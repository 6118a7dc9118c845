import random
import re

import pytest
from pyspark.sql import functions as F

from needmap.config import CAPABILITIES, TAXONOMY
from needmap.operators.enrich import infer_location
from needmap.operators.evidence import coverage, extract_claims, find_claims, plain_part, whole_words


def brute(text):
    """Every claim of a text by plain search: the first pattern that hits, strong ones first."""
    found = {}
    for cap in CAPABILITIES:
        for confidence, pattern in [("strong", p) for p in cap.strong] + [("partial", p) for p in cap.partial]:
            m = re.search(pattern, text, re.IGNORECASE)
            if m:
                found[cap.key] = (confidence, m.start(), m.end() - m.start())
                break
    return found


WORDS = (
    "nicu NICU \U0001f691 emergency 24x7 24 X 7 24/7 24 hour hospital trauma blood bank\n storage gynaecology obstetrics c-section csection "
    "éicu icu ventilators oxygen renal caesarean 24hour ambulance ambulances delivery room labor labour women's health İcu ſncu Kidney"
).split(" ")


def texts():
    rng = random.Random(11)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return made + ["Has a NICU and blood bank.", "gynaecology and obstetrics", "emergency\n24x7", "24x7 open, emergency", "x" * 300 + " NICU " + "y" * 300, ""]


def test_positions_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "id int, text string")
    got = {}
    for r in find_claims(df, "text").collect():
        got.setdefault(r["id"], {})[r["capability"]] = (r["confidence"], r["start"], r["length"])
    assert got == {i: brute(t) for i, t in enumerate(texts()) if brute(t)}


def test_plain_parts_occur_in_every_match():
    for cap in CAPABILITIES:
        for p in (*cap.strong, *cap.partial):
            for t in texts():
                m = re.search(p, t, re.IGNORECASE)
                folded = t.upper().replace("\u0130", "I").replace("\u212a", "K")
                assert not m or plain_part(p) in folded


RECORD = "record_id string, record_type string, entity_name string, state string, district string, city string, pincode string, facility_type string, description string"


def claims_of(spark, *rows):
    return {r["capability"]: r for r in extract_claims(spark.createDataFrame(list(rows), RECORD)).collect()}


def test_snippet_and_order(spark):
    got = claims_of(spark, ("f", "facility", "N", "Kerala", None, "Town", None, "clinic", "Has a NICU and blood bank."))
    assert set(got) == {"nicu", "blood_bank"} and got["nicu"]["evidence_text"] == "Has a NICU and blood bank."
    assert got["nicu"]["district_source"] == "city_fallback" and got["nicu"]["district_or_city"] == "Town"
    got = claims_of(spark, ("f", "facility", "N", "Kerala", "D", None, None, "clinic", "gynaecology and obstetrics"))
    assert (got["c_section"]["confidence"], got["obgyn"]["confidence"], got["obgyn"]["district_source"]) == ("partial", "strong", "source_district")
    long = "a" * 200 + " NICU " + "b " * 100
    text = claims_of(spark, ("f", "facility", "N", "Kerala", "D", None, None, None, long))["nicu"]["evidence_text"]
    start = long.index("NICU")
    assert text == "..." + " ".join(long[start - 90 : start + 94].split()) + "..."


def test_hints_only_where_nothing_is_claimed(spark):
    got = claims_of(spark, ("f", "facility", "N", "Kerala", "D", None, None, " Hospital ", "trauma care"))
    assert {k: r["confidence"] for k, r in got.items()} == {"emergency_24x7": "partial"}
    got = claims_of(spark, ("f", "facility", "N", "Kerala", "D", None, None, "Nursing_Home", None))
    assert got["obgyn"]["evidence_text"] == "Facility type is nursing home; capability requires verification."
    assert got["obgyn"]["extraction_method"] == "facility_type_hint_v1"


def test_rows_without_a_place_are_skipped(spark):
    assert not claims_of(spark, ("f", "facility", "N", None, "D", None, None, None, "NICU"), ("g", "facility", "N", "S", None, None, None, None, "NICU"), ("h", "district", "N", "S", "D", None, None, None, "NICU"))


def test_coverage_keeps_zeros(spark):
    df = spark.createDataFrame([("a", "nicu"), ("a", "nicu"), ("b", "nicu")], "facility_id string, capability string")
    rows = {r["capability"]: r["facilities"] for r in coverage(df).collect()}
    assert rows["nicu"] == 2 and sum(rows.values()) == 2 and set(rows) == set(TAXONOMY.keys)


def test_infer_location(spark):
    rows = [
        ("p1", "pincode", "o", "orissa", "Cuttack", None, "1", None, None), ("p2", "pincode", "o", "orissa", "Cuttack", None, "1", None, None),
        ("p3", "pincode", "o", "orissa", "Angul", None, "1", None, None),
        ("f1", "facility", "n", "Kerala", "Own", "City", "1", None, None), ("f2", "facility", "n", "karnataka", "mysuru", None, "9", None, None),
        ("f3", "facility", "n", "karnataka", None, "City", None, None, None), ("f4", "facility", "n", "karnataka", " ", "", "", None, None),
    ]
    got = {r["record_id"]: (r["state"], r["district"], r["district_source"]) for r in infer_location(spark.createDataFrame(rows, RECORD)).collect()}
    assert got["f1"] == ("Odisha", "Cuttack", "pincode_inferred") and got["f2"] == ("karnataka", "Mysore", "source_district")
    assert got["f3"] == ("karnataka", None, "city_fallback") and got["f4"][2] == "missing_location"
    assert got["p1"] == ("orissa", "Cuttack", None) and len(got) == 7


def test_whole_words_stand_in_every_match():
    assert whole_words(r"\bblood bank\b") == ("BLOOD", "BANK") and whole_words(r"\blabou?r room\b") == ("ROOM",)
    assert whole_words(r"\bgynaec") == () and whole_words(r"\b24\s*hour\b.*\bemergency\b") == ("EMERGENCY",) and whole_words(r"a (b|c)") == ()
    assert whole_words(r"\bintensive\s+care") == ("INTENSIVE",)
    chance = random.Random(7)
    parts = ["blood", "bank", "24", "hour", "emergency", "care", "unit", "icu", "labor", "room", " ", "  ", "-", ",", "\n", "x", "7", "/", "é", "_"]
    patterns = [p for k in CAPABILITIES for p in (*k.strong, *k.partial)]
    for _ in range(4000):
        text = "".join(chance.choices(parts, k=9))
        words = set(re.split(r"\W+", text.upper()))
        for p in patterns:
            assert not re.search(p, text, re.I) or words.issuperset(whole_words(p)), (p, text)
