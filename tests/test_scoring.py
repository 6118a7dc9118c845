import random

import pytest
from pyspark.sql import functions as F

from needmap.config import CONFIDENCE_WEIGHT, NEEDS, SOURCE_WEIGHT, generic_need
from needmap.operators import scoring as G
from needmap.operators.review import demo_candidates

RECORD = (
    "record_id string, record_type string, entity_name string, state string, district string, city string, facility_type string, "
    "institutional_birth_pct double, stunting_pct double, anaemia_pct double, improved_water_pct double, improved_sanitation_pct double, health_insurance_pct double"
)
CLAIM = "facility_id string, state string, district_or_city string, district_source string, capability string, confidence string"


def district(i, name="D", state="Kerala", values=(80.0, 40.0, 60.0, None, None, None)):
    return (f"district:{i}", "district", name, state, name, None, None, *values)


def facility(i, kind, name="D"):
    return (f"facility:{i}", "facility", "N", "kerala", name, None, kind, *[None] * 6)


def scored(spark, records, claims, needs=NEEDS):
    r, c = spark.createDataFrame(records, RECORD), spark.createDataFrame(claims, CLAIM)
    rows = G.scores(G.signals(r, c, needs), needs).collect()
    return {(x["district_id"], x["care_need"]): x for x in rows}


def test_maternal_without_anything(spark):
    row = scored(spark, [district(1)], [])[("district:1", "maternal_emergency")]
    got = [row[c] for c in ("risk", "supply", "scarcity", "evidence", "quality", "priority")]
    assert got == pytest.approx([41.0, 0.0, 100.0, 0.0, 80.0, 66.5]) and row["uncertainty_label"] == "missing"
    assert row["explanation"].startswith("Medium planning priority: health-risk signal is 41.0/100")


def test_maternal_with_evidence(spark):
    claims = [("f1", "Kerala", "d", "pincode_inferred", "c_section", "strong"), ("f1", "Kerala", "D ", "pincode_inferred", "obgyn", "strong")]
    row = scored(spark, [district(1), facility(1, "Hospital")], claims)[("district:1", "maternal_emergency")]
    got = [row[c] for c in ("supply", "scarcity", "evidence", "quality", "priority")]
    assert got == pytest.approx([34.70833333, 73.29166667, 53.8, 100.0, 49.4175]) and row["uncertainty_label"] == "strong"


def test_dialysis_floor(spark):
    records = [district(1)] + [facility(i, "hospital") for i in range(10)]
    row = scored(spark, records, [])[("district:1", "dialysis_access")]
    assert row["supply"] == pytest.approx(5.5) and "10 facilities provide a weak general supply floor" in row["explanation"]


def clamp(x):
    return max(0.0, min(100.0, x))


def oracle(need, d, claims, kinds):
    """The score definitions, one district at a time."""
    names = ("institutional_birth_pct", "stunting_pct", "anaemia_pct", "improved_water_pct", "improved_sanitation_pct", "health_insurance_pct")
    value = dict(zip(names, d[7:]))
    terms = [((100 - value[i]) if gap else value[i], w) for i, w, gap in need.risk if value[i] is not None]
    risk = clamp(sum(x * w for x, w in terms) / sum(w for _, w in terms)) if terms else 50.0
    mine = [c for c in claims if c[4] in need.supply]
    weight = [float(CONFIDENCE_WEIGHT.get(c[5], 0)) * float(SOURCE_WEIGHT.get(c[3], 0.3)) for c in mine]
    count = {"total_facilities": len(kinds), "hospitals": kinds.count("hospital"), "clinics": kinds.count("clinic"), "doctors": kinds.count("doctor"), "nursing_homes": kinds.count("nursing_home")}
    floor = min(need.floor_cap, sum(min(cap, slope * sum(count[c] for c in cols)) for cap, slope, cols in need.floor)) if kinds else 0.0
    supply = max(floor, min(100.0, sum(w * need.supply[c[4]] for w, c in zip(weight, mine)) * 100 / 6))
    missing_core = sum(all(c[4] != k for c in mine) for k in need.core)
    scarcity = clamp(100 - supply + missing_core * need.missing_core_penalty + (0 if mine else 10))
    city, lost = (sum(c[3] == s for c in mine) for s in ("city_fallback", "missing_location"))
    strong, partial, conflicting = (sum(c[5] == s for c in mine) for s in ("strong", "partial", "conflicting"))
    evidence = clamp(0.7 * min(100, sum(weight) * 20) + 30 * strong / len(mine) - min(20, 5 * city) - min(35, 10 * lost)) if mine else 0.0
    nothing = not mine and not kinds
    quality = clamp(100 - (25 if not d[3] else 0) - (25 if not d[2] else 0) - (20 if nothing else 0) - min(25, 5 * city) - min(40, 10 * lost))
    priority = clamp(0.5 * risk + 0.3 * scarcity + 0.15 * (100 - evidence) + 0.05 * (100 - quality))
    if nothing:
        label = "missing"
    elif conflicting:
        label = "conflicting"
    elif quality < 65 or city or lost:
        label = "weak"
    else:
        label = "strong" if strong >= 2 and strong >= partial else "partial" if strong or partial else "weak"
    return risk, supply, scarcity, evidence, quality, priority, label


def test_random_districts_against_definitions(spark):
    rng = random.Random(3)
    capabilities = sorted({c for n in NEEDS for c in n.supply} | {"other"})
    records, claims, by_place = [], [], {}
    for i in range(60):
        d = district(i, f"Place {i}", "Kerala", tuple(rng.choice([None, round(rng.uniform(0, 100), 1)]) for _ in range(6)))
        mine = [
            (f"f{j}", "KERALA", f"place-{i}", rng.choice([*SOURCE_WEIGHT, "", "odd"]) if i % 2 else "source_district", rng.choice(capabilities),
             rng.choice([*CONFIDENCE_WEIGHT, "odd"]) if i % 3 else rng.choice(["strong", "partial"]))
            for j in range(rng.choice([0, 0, 1, 2, 5, 12]))
        ]
        kinds = [rng.choice(["hospital", "clinic", "doctor", "nursing_home", "spa"]) for _ in range(rng.choice([0, 0, 1, 3, 9]))]
        records += [d] + [facility(f"{i}/{j}", k, f"Place {i}") for j, k in enumerate(kinds)]
        claims += mine
        by_place[d[0]] = (d, mine, kinds)
    got = scored(spark, records, claims)
    assert len(got) == 60 * len(NEEDS)
    for need in NEEDS:
        for key, (d, mine, kinds) in by_place.items():
            row, want = got[(key, need.key)], oracle(need, d, mine, kinds)
            assert [row[c] for c in ("risk", "supply", "scarcity", "evidence", "quality", "priority")] == pytest.approx(list(want[:6])), (key, need.key)
            assert row["uncertainty_label"] == want[6]
            assert all(0 <= row[c] <= 100 for c in ("risk", "supply", "scarcity", "evidence", "quality", "priority"))


def test_unknown_need_has_a_generic_model(spark):
    need = generic_need("eye_care", ("nicu",))
    row = scored(spark, [district(1), facility(1, "spa")], [], (need,))[("district:1", "eye_care")]
    assert row["risk"] == pytest.approx((60 + 40 + 20) / 3) and row["supply"] == 0.5


def test_candidates(spark):
    records = spark.createDataFrame([district(1, "A"), district(2, "B", values=(None,) * 6), district(3, "C", values=(10.0, 1.0, 1.0, None, None, None))], RECORD)
    claims = spark.createDataFrame([("f", "kerala", "c", "", "nicu", "strong")], CLAIM)
    assert [r["district"] for r in demo_candidates(records, claims).collect()] == ["A", "C"]
    assert [r["district"] for r in demo_candidates(records, claims, max_claims=0).collect()] == ["A"]
    assert demo_candidates(records, claims, min_claims=1).first()["anaemia_pct"] == "1.0%"
