from pyspark.sql import functions as F

from needmap.operators import quality as Q
from needmap.operators.rollup import canonical_pair, rank_in_key, rollup_directory
from needmap.plans import enriched as E
from needmap.plans import records as P
from needmap.session import cut_lineage
import pytest

from conftest import A, B, C


def build(raw, partitions=None):
    facilities, directory, districts = raw
    if partitions:
        facilities, directory, districts = (d.repartition(partitions) for d in raw)
    return E.enrich(facilities, directory, districts, as_of=F.lit("2024-01-01").cast("timestamp"))


def test_enriched_rows(raw):
    rows = {r["facility_id"]: r for r in build(raw).collect()}
    assert sorted(rows) == sorted([f"facility:{A}:dup-001", f"facility:{A}:dup-002", f"facility:{B}", f"facility:{C}"])
    matched = next(r for k, r in rows.items() if "dup" in k and r["facility_name"] == "Asha Hospital")
    assert (matched["pincode_match_status"], matched["district_source"], matched["location_confidence"]) == ("matched", "pincode_inferred", 0.85)
    assert matched["pincode_office_names"] == ["BO", "HO", "SO"] and matched["pincode_office_count"] == 3
    assert matched["analysis_location_key"] == "odisha|cuttack" and matched["district_match_status"] == "matched"
    assert matched["improved_sanitation_pct"] == 70.1 and matched["facility_type"] == "hospital"
    assert matched["source_quality_flags"] == "unexpected_facility_type|duplicate_source_unique_id"
    lone, nowhere = rows[f"facility:{B}"], rows[f"facility:{C}"]
    assert (lone["pincode_match_status"], lone["district_source"], lone["location_confidence"]) == ("missing", "city_fallback", 0.45)
    assert (nowhere["district_source"], nowhere["location_confidence"], nowhere["district_match_status"]) == ("missing_location", 0.0, "missing_location")
    assert nowhere["analysis_location_key"] == ""


def test_does_not_depend_on_partitioning(raw):
    assert sorted(map(str, build(raw, 1).collect())) == sorted(map(str, build(raw, 17).collect()))


def test_grain_gate(raw):
    facilities = E.clean_facilities(raw[0])
    enriched = build(raw)
    assert E.check_enriched(facilities, enriched)["rows"] == 4
    with pytest.raises(Q.GateError):
        E.check_enriched(facilities, enriched.unionByName(enriched))
    with pytest.raises(Q.GateError):
        E.check_enriched(facilities, enriched.withColumn("analysis_state", F.lit("Atlantis")))


def test_district_aliases_are_optional(raw):
    facilities, directory, districts = E.clean_facilities(raw[0]), E.pincode_rollup(raw[1]), E.clean_districts(raw[2])
    plain = E.build_enriched(facilities, directory, districts).where(F.col("source_city") == "Mysuru").first()
    aliased = E.build_enriched(facilities, directory, districts, district_aliases=True).where(F.col("source_city") == "Mysuru").first()
    assert plain["district_match_status"] == "missing_nfhs" and aliased["district_match_status"] == "matched"


def test_canonical_pair_ties(spark):
    rows = [("k", "B", "y")] * 2 + [("k", "A", "z")] * 2 + [("k", "A", "a"), ("k", None, "q"), ("k", None, "q"), ("k", None, "q")]
    df = spark.createDataFrame(rows, "k string, s string, d string")
    assert canonical_pair(df, ["k"], ["s", "d"]).collect() == [("k", "A", "z")]
    rolled = rollup_directory(df, ["k"], ["s", "d"], {"names": "d"}, {}, "n").first()
    assert (rolled["n"], rolled["names"], rolled["s"], rolled["d"]) == (8, ["a", "q", "y", "z"], "A", "z")


def test_rank_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    got = rank_in_key(df, "k", "s", "n", "r").where("k = 'hot'").orderBy("s").collect()
    assert [r["r"] for r in got] == list(range(1, len(got) + 1)) and {r["n"] for r in got} == {len(got)}


def test_rebuild_and_projection(raw):
    valid, rejected = P.rebuild_records(*raw)
    total = P.union_records(P.facility_records(raw[0]), P.pincode_records(raw[1]), P.district_records(raw[2]))
    assert P.check_rebuild(total, valid, rejected) == {"total": 14, "valid": 13, "quarantine": 1}
    records = P.records_from(build(raw))
    assert records.groupBy("record_type").count().orderBy("record_type").collect() == [("district", 2), ("facility", 4)]
    assert records.where("record_id = 'district:odisha|cuttack'").first()["anaemia_pct"] == 60.0
    supplied = valid.where("record_type = 'district'")
    replaced = P.records_from(build(raw), supplied)
    assert replaced.where("record_type = 'district'").count() == 3
    assert P.records_from(valid) is valid


def test_signature_and_duplicate_ids_by_hand(spark, raw):
    import hashlib

    rows = {r["facility_name"]: r for r in E.clean_facilities(raw[0]).where(F.col("source_unique_id").startswith("1111")).collect()}
    clinic, hospital = rows["Asha Clinic"], rows["Asha Hospital"]
    digest = lambda *parts: hashlib.sha256("||".join(parts).encode()).hexdigest()
    uid = "11111111-1111-1111-1111-111111111111"
    assert hospital["source_row_signature"] == digest(
        uid, "Asha Hospital", "Nursing Home", hospital["facility_type"], "Private", hospital["operator_type"], "", "", "Has a NICU and blood bank.",
        "Orissa", "", "Cuttack", "753 001", "753001", "18.0", "85.0", "unexpected_facility_type",
    )
    first, second = sorted((clinic, hospital), key=lambda r: r["source_row_signature"])
    assert (first["facility_id"], second["facility_id"]) == (f"facility:{uid}:dup-001", f"facility:{uid}:dup-002")


def test_only_facilities_are_joined_to_places(spark, raw):
    from needmap.operators.enrich import infer_location
    from needmap.session import SETTINGS

    valid, _ = P.rebuild_records(*raw)
    plan = infer_location(valid)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and plan.count("Join LeftOuter") == 1
    # The ranks of a hot key stay spread only if a join on two keys shuffles on both.
    assert SETTINGS["spark.sql.requireAllClusterKeysForCoPartition"] == "true"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_facts_are_exchanged_once_for_each_join_key_at_most(spark, raw):
    facilities, directory, districts = raw
    stored = [cut_lineage(f) for f in (E.clean_facilities(facilities), E.pincode_rollup(directory), E.clean_districts(districts))]
    settings = {"spark.sql.adaptive.enabled": "false"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert exchanges(E.build_enriched(*stored)) == 0  # measured sizes: both dimensions are sent to the facts
        assert exchanges(E.enrich(*raw)) == exchanges(E.clean_facilities(facilities))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert exchanges(E.build_enriched(*stored)) == 4  # facts and dimension, for each of two keys
    finally:
        for name in (*settings, "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


def test_rollup_has_no_repeats_to_remove(spark):
    rows = [("k", f"s{i % 3}", f"d{i % 2}", f"o{i % 5}", None if i % 4 else "t", float(i)) for i in range(60)] + [("k", None, "d0", "o9", None, None), (None, "s", "d", None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, s string, d string, o string, t string, x double")
    rolled = rollup_directory(df, ["k"], ["s", "d"], {"os": "o", "ts": "t", "ss": "s"}, {"mean": "x"}, "rows")
    assert "flatten" not in rolled._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.rows, r.os, r.ts, r.ss, r["mean"], r.s, r.d) for r in rolled.collect()}
    assert got["k"] == (61, ["o0", "o1", "o2", "o3", "o4", "o9"], ["t"], ["s0", "s1", "s2"], 29.5, "s0", "d0")
    assert got[None] == (1, [], [], ["s"], 1.0, "s", "d")


def test_universe_is_replaced_without_a_job_before_an_action(spark, raw):
    records = P.project_enriched(build(raw))
    supplied = P.union_records(P.facility_records(raw[0]), P.district_records(raw[2]))
    spark.sparkContext.setJobGroup("universe", "no job may run")
    try:
        frames = [P.replace_universe(records, supplied.where("record_type <> 'district'")), P.replace_universe(records, supplied), P.replace_universe(records, None)]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("universe")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    key = lambda df: sorted((r.record_type, r.record_id) for r in df.collect())
    assert key(frames[0]) == key(records) == key(frames[2])
    assert [k for k in key(frames[1]) if k[0] == "district"] == [k for k in key(supplied) if k[0] == "district"]


def test_rollup_combines_raw_rows_before_it_makes_more(spark):
    import random

    dice = random.Random(5)
    rows = [(dice.choice(["k", "k", "l", None]), *(dice.choice([None, "b", "a", "c"]) for _ in range(4)), dice.choice([None, 1, 2])) for _ in range(400)] + [("m", *[None] * 5)]
    df = spark.createDataFrame(rows, "k string, s string, d string, x string, y string, v long").repartition(5)
    given = (["k"], ["s", "d"], {"xs": "x", "ys": "y"}, {"mean": "v"}, "rows")
    got = {r["k"]: (r["rows"], r["xs"], r["ys"], r["mean"], r["s"], r["d"]) for r in rollup_directory(df, *given).collect()}
    want = {}
    for key in ("k", "l", "m", None):
        own = [r for r in rows if r[0] == key]
        pairs = [r[1:3] for r in own if None not in r[1:3]]
        best = min(set(pairs), key=lambda p: (-pairs.count(p), p), default=(None, None))
        numbers = [r[5] for r in own if r[5] is not None]
        lists = [sorted({r[at] for r in own} - {None}) for at in (3, 4)]
        want[key] = (len(own), *lists, sum(numbers) / len(numbers) if numbers else None, *best)
    assert got == want
    plan = rollup_directory(df, *given)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
    plain = rollup_directory(df, ["k"], ["s", "d"], {}, {"mean": "v"}, "rows").collect()
    assert {r["k"]: (r["rows"], r["mean"], r["s"], r["d"]) for r in plain} == {k: (v[0], *v[3:]) for k, v in want.items()}


def test_facilities_are_cleaned_once(raw):
    plan = E.clean_facilities(raw[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "address_city" not in plan
