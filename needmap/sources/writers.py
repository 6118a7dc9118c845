"""Tables and CSV files out, and the gated publication of a new table version."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CLAIM_FIELDS, GAP_FIELDS, MIRROR_FIELDS, RECORD_FIELDS
from ..functions import without_nul
from ..operators.quality import GateError, gate, report
from ..operators.review import GAP_COUNTS, GAP_SCORES
from .readers import read_csv

CLAIMS_SCHEMA = T.StructType(
    [T.StructField(c, T.TimestampType() if c == "updated_at" else T.StringType(), False) for c in CLAIM_FIELDS]
)


def _gap_type(name: str) -> T.DataType:
    if name in GAP_SCORES:
        return T.DecimalType(5, 1)
    if name in GAP_COUNTS:
        return T.IntegerType()
    return T.TimestampType() if name == "updated_at" else T.StringType()


GAPS_SCHEMA = T.StructType([T.StructField(c, _gap_type(c), False) for c in GAP_FIELDS])


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Catalog table, or parquet files for a path; overwriting replaces the schema as well."""
    writer = df.write.mode(mode).option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(name) if "/" in name else writer.saveAsTable(name)


def csv_safe(df: DataFrame) -> DataFrame:
    """Arrays as JSON text, everything else untouched."""
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    return df.select(*[F.to_json(c).alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, parts: int | None = None) -> None:
    """CSV with a header. ``parts`` merges the output files; leave it unset for large data."""
    safe = csv_safe(df)
    out = safe if parts is None else safe.coalesce(parts)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_fixed(df: DataFrame, path: str, fields: Sequence[str], parts: int | None = None) -> None:
    """CSV of exactly the listed columns, in order."""
    write_csv(df.select(*fields), path, parts)


def mirror(enriched: DataFrame, target: str, fields: Sequence[str] = MIRROR_FIELDS) -> int:
    """Refresh a served copy: column subset, no NUL characters, sorted by name and id; returns the row count."""
    kinds = {f.name: f.dataType for f in enriched.schema.fields}

    def plain(name: str) -> Column:
        if isinstance(kinds[name], T.StringType):
            return without_nul(F.col(name)).alias(name)
        if isinstance(kinds[name], T.ArrayType) and isinstance(kinds[name].elementType, T.StringType):
            return F.transform(name, without_nul).alias(name)
        return F.col(name)

    write_table(enriched.select(*[plain(c) for c in fields]).orderBy("facility_name", "facility_id"), target)
    return stored(enriched.sparkSession, target).count()


def stored(spark: SparkSession, target: str) -> DataFrame:
    """What a path or a catalog name holds."""
    return spark.read.parquet(target) if "/" in target else spark.table(target)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the declared types; text that is no such value becomes NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def load_prepared(claims: DataFrame, gaps: DataFrame, claims_target: str, gaps_target: str) -> dict[str, int]:
    """Typed tables of both outputs; fails before a target is touched if a required value is missing.

    Each output is computed once: it is written as a candidate beside its target, the stored rows are checked, and the
    stored rows are then put in place.
    """
    loaded = {}
    candidates = []
    for name, df, schema, target, by in (
        ("claims", claims, CLAIMS_SCHEMA, claims_target, ["capability"]),
        ("gaps", gaps, GAPS_SCHEMA, gaps_target, ["care_need"]),
    ):
        candidate = f"{target}_candidate"
        write_table(typed(df, schema), candidate)
        rows = stored(df.sparkSession, candidate)
        missing = [F.count_if(F.col(c).isNull()).alias(c) for c in schema.names]
        counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *missing).first().asDict()
        loaded[name] = counts.pop("_rows")
        bad = {c: n for c, n in counts.items() if n}
        if bad:
            raise GateError(f"{name}: required values are missing: {bad}")
        candidates.append((rows, target, by))
    for rows, target, by in candidates:
        write_table(rows, target, by)
    return loaded


def utc_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def publish_candidate(
    df: DataFrame, live: str, check: Callable[[DataFrame], object] | None = None, apply: bool = False,
    backup: str | None = None,
) -> dict[str, object]:
    """Write ``<live>_candidate``, check what was written, and only with ``apply`` put it in place.

    The check reads the stored candidate, so nothing is computed twice. ``live`` is a view over tables that are never changed: the
    candidate becomes the table of a version, and one statement turns the view to it, so that a reader finds the old rows or the
    new ones at any moment. The former version stays as the backup. A ``live`` that is still a table of its own is renamed once,
    when its first version is published.
    """
    spark = df.sparkSession
    candidate = f"{live}_candidate"
    drop_table(spark, candidate)
    write_table(df, candidate)
    stored = spark.table(candidate)
    if check is not None:
        check(stored)
    result: dict[str, object] = {"candidate": candidate, "rows": stored.count(), "applied": apply, "backup": None}
    if apply:
        version = f"{live}_version_{utc_stamp()}_{uuid.uuid4().hex[:8]}"
        former = live_version(spark, live)
        spark.sql(f"ALTER TABLE {candidate} RENAME TO {version}")
        if former is None and spark.catalog.tableExists(live):
            former = backup or f"{live}_backup_{utc_stamp()}"
            spark.sql(f"ALTER TABLE {live} RENAME TO {former}")
        elif former is not None and backup is not None:
            spark.sql(f"CREATE OR REPLACE VIEW {backup} TBLPROPERTIES ('{_VERSION}' = '{former}') AS SELECT * FROM {former}")
        spark.sql(f"CREATE OR REPLACE VIEW {live} TBLPROPERTIES ('{_VERSION}' = '{version}') AS SELECT * FROM {version}")
        result |= {"candidate": version, "backup": former if backup is None else backup if former else None}
    return result


_VERSION = "needmap.version"


def live_version(spark: SparkSession, live: str) -> str | None:
    """The table that a published name shows, or None if nothing has been published under it."""
    if not spark.catalog.tableExists(live):
        return None
    found = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {live}").collect() if r["key"] == _VERSION]
    return found[0] if found else None


def restore_version(spark: SparkSession, live: str, version: str) -> None:
    """Turns a published name back to an earlier version, in one statement."""
    if not spark.catalog.tableExists(version):
        raise ValueError(f"no table {version}")
    spark.sql(f"CREATE OR REPLACE VIEW {live} TBLPROPERTIES ('{_VERSION}' = '{version}') AS SELECT * FROM {version}")


def load_records(records: DataFrame, live: str, apply: bool = False, warnings_fail: bool = False) -> dict[str, object]:
    """Validated publication of the mixed record table."""
    return publish_candidate(
        records.select(*RECORD_FIELDS), live, lambda stored: gate(report(stored), warnings_fail), apply
    )


def export_snapshot(records: DataFrame, path: str, validate: bool = True, parts: int | None = None) -> dict | None:
    """CSV of the record columns in (type, id) order, then the gate on the rows read back from it."""
    ordered = records.select(*RECORD_FIELDS).orderBy("record_type", "record_id")
    write_csv(ordered, path, parts)
    return gate(report(read_csv(records.sparkSession, path))) if validate else None


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
