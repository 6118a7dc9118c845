"""The registered queries: contract, plans, and their SQL twins on the smallest tables."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from workbench.check import connect, difference

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
TWINS = (
    "one_decimal", "canonical_pair_by_key", "directory_rollup", "dedupe_ranked", "clean_facilities", "enriched_facilities", "infer_location",
    "validate_issues", "claims_extract", "gap_scores", "review_queue", "overlay_queue", "upsert", "csv_round_trip",
    "repair_split", "merged_actions", "grain_check", "split_counts", "report", "publish", "build_job", "rebuild_job", "claims_of_phrases", "unknown_states",
    "strict_records", "strict_facility_records", "export_order", "inspect", "run_all",
)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract(spark):
    assert set(ORACLE) <= set(QUERIES) and set(TWINS) <= set(ORACLE)
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], SMALL) is None


@pytest.mark.parametrize("name", ["enriched_facilities", "claims_extract", "gap_scores", "overlay_queue", "quarantine"])
def test_plan_stays_on_the_jvm_and_joins_on_keys(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_every_phrase_matches_its_pattern():
    import re

    from needmap.config import CAPABILITIES
    from workbench.job_queries import PHRASES

    patterns = {(k.key, s, n): p for k in CAPABILITIES for s, ps in (("strong", k.strong), ("partial", k.partial)) for n, p in enumerate(ps)}
    assert PHRASES.keys() == patterns.keys()
    assert not [(k, PHRASES[k]) for k, p in patterns.items() if not re.search(p, PHRASES[k], re.I)]


def test_grain_check_cleans_facilities_once(spark, monkeypatch):
    from workbench import rollups

    calls, clean = [], rollups.E.clean_facilities
    monkeypatch.setattr(rollups.E, "clean_facilities", lambda df: calls.append(1) or clean(df))
    assert QUERIES["grain_check"](spark, SMALL).first()["duplicates"] == 0 and len(calls) == 1


def test_split_counts_judges_rows_once(spark, monkeypatch):
    from workbench import records_queries

    plans, split = [], records_queries.Q.split
    monkeypatch.setattr(records_queries.Q, "split", lambda df, rule: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or split(df, rule))
    got = QUERIES["split_counts"](spark, SMALL).first()
    assert got["valid"] + got["quarantine"] == got["total"] > 0
    assert len(plans) == 1 and "Union" not in plans[0]


def test_line_numbers_go_on_over_files(spark, con, monkeypatch):
    from workbench import job_queries

    parts, write = [], job_queries.W.write_csv

    def written(df, path, n=None):
        parts.append(n)
        write(df.repartitionByRange(3, "record_id").sortWithinPartitions("record_id"), path, n)

    monkeypatch.setattr(job_queries.W, "write_csv", written)
    assert difference(spark, con, QUERIES["line_numbers"], ORACLE["line_numbers"], SMALL) is None
    assert set(parts) == {None}
