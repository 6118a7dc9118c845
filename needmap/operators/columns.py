"""Schema reconciliation: find logical fields in tables whose column names vary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import INDICATORS, RECORD_FIELDS

RECORD_SCHEMA = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name in ("latitude", "longitude", *INDICATORS) else T.StringType())
        for name in RECORD_FIELDS
    ]
)


def column_key(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present in the frame, compared on lower-case letters and digits."""
    available: dict[str, str] = {}
    for name in df.columns:
        available.setdefault(column_key(name), name)
    return next((available[column_key(c)] for c in candidates if column_key(c) in available), None)


def to_text(df: DataFrame, name: str, scalar: bool = False) -> Column:
    """Any column as text: lists joined (or their first element), maps and structs as JSON."""
    column = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        items = column.cast("array<string>")
        return F.try_element_at(items, F.lit(1)) if scalar else F.concat_ws("; ", items)
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def resolve(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The logical field as text, a typed NULL when no candidate column exists."""
    name = find_column(df, candidates)
    return F.lit(None).cast("string") if name is None else to_text(df, name)


def resolve_scalar(df: DataFrame, candidates: Sequence[str]) -> Column:
    """Like :func:`resolve`, a list giving its first element."""
    name = find_column(df, candidates)
    return F.lit(None).cast("string") if name is None else to_text(df, name, scalar=True)


def conform(df: DataFrame, schema: T.StructType = RECORD_SCHEMA, **values: Column) -> DataFrame:
    """Project to ``schema``: given expressions first, then own columns, else typed NULLs."""

    def field(f: T.StructField) -> Column:
        if f.name in values:
            source = values[f.name]
        else:
            source = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*[field(f) for f in schema.fields])


def prune(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the listed columns, in order."""
    return df.select(*columns)


def shape(df: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """Served rows: one named expression per output column."""
    return df.select(*[expression.alias(name) for name, expression in spec.items()])


def union_records(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
