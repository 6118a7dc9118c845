"""Keys, ids and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import join_clean

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def valid_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID_PATTERN), F.lit(False))


def record_hash(prefix: str, *values: Column) -> Column:
    """``prefix:`` and the sha256 of the cleaned parts."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(join_clean("||", *values), 256))


def stable_uuid(*values: Column) -> Column:
    """md5 of the cleaned parts, written as a uuid."""
    digest = F.md5(join_clean("||", *values))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")


def row_signature(columns: Sequence[str]) -> Column:
    """sha256 over all columns, NULL as the empty string."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def location_key(state: Column, district: Column) -> Column:
    """Piped key; a missing part is left out."""
    return F.concat_ws("|", state, district)


def salted_key(key: Column, *spread: Column, missing: Column | None = None) -> Column:
    """Join key whose NULLs are spread over many values that no dimension row carries.

    A left join sends every NULL key to one task. The control character cannot occur in a cleaned
    key, so these rows still match nothing, but each lands where the whole hash of ``spread`` puts it.
    """
    bucket = F.xxhash64(*spread).cast("string")
    missing = key.isNull() if missing is None else missing
    return F.when(missing, F.concat(F.lit("\u0000"), bucket)).otherwise(key)
