"""The jobs as they are run: build, check what was stored, publish or stop.

Every job computes its rows once, into a staged table, and checks and publishes from there. Without ``apply`` it stops before
the live table is touched (a dry run). Names are catalog tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PLACES, RECORD_FIELDS
from ..operators.quality import check_grain, check_split, rebuild_rule, repair_rule
from ..sources.writers import publish_candidate, write_table
from .enriched import build_enriched, clean_districts, clean_facilities, pincode_rollup
from .records import district_records, facility_records, pincode_records, union_records


def build_job(facilities: DataFrame, directory: DataFrame, districts: DataFrame, live: str, apply: bool = False, **options) -> dict[str, object]:
    """Enriched facilities: both dimensions and the cleaned facilities are stored first, so that the joins know their sizes."""
    spark = facilities.sparkSession
    parts = {"facilities": clean_facilities(facilities), "directory": pincode_rollup(directory), "districts": clean_districts(districts)}
    for name, frame in parts.items():
        write_table(frame, f"{live}_{name}")
    stored = {name: spark.table(f"{live}_{name}") for name in parts}
    enriched = build_enriched(stored["facilities"], stored["directory"], stored["districts"], **options)
    return publish_candidate(
        enriched, live, lambda rows: check_grain(stored["facilities"], rows, "facility_id", "analysis_state", PLACES.canonical_states), apply
    )


def rebuild_job(facilities: DataFrame, directory: DataFrame, districts: DataFrame, live: str, apply: bool = False) -> dict[str, object]:
    """The mixed record table from the three sources; rejected rows go to ``<live>_quarantine``."""
    rows = union_records(facility_records(facilities), pincode_records(directory), district_records(districts))
    return _split_and_publish(rows, rebuild_rule(), live, apply)


def repair_job(records: DataFrame, live: str, apply: bool = False) -> dict[str, object]:
    """A stored record table without its broken rows; these go to ``<live>_quarantine``."""
    return _split_and_publish(records.select(*RECORD_FIELDS), repair_rule(), live, apply)


def _split_and_publish(rows: DataFrame, invalid: Column, live: str, apply: bool) -> dict[str, object]:
    spark = rows.sparkSession
    verdict = "rejected"
    write_table(rows.withColumn(verdict, F.coalesce(invalid, F.lit(False))), f"{live}_staged")
    staged = spark.table(f"{live}_staged")
    write_table(staged.where(verdict).drop(verdict), f"{live}_quarantine")
    quarantine = spark.table(f"{live}_quarantine")
    counts: dict[str, int] = {}
    done = publish_candidate(
        staged.where(~F.col(verdict)).drop(verdict), live, lambda valid: counts.update(check_split(staged, valid, quarantine)), apply
    )
    return {**done, **counts, "quarantine_table": f"{live}_quarantine"}
