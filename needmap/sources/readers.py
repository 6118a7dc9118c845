"""Tables and CSV files in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DISCOVERY_WEIGHTS
from ..operators.columns import column_key
from ..session import cut_lineage


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a parquet path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, breaks: bool = True) -> DataFrame:
    """CSV with a header, all text; quoted line breaks, doubled quotes and a byte-order mark are fine.

    With ``breaks`` a file is one task; bring large data as many files, or as parquet. Without, no value may hold a line break, and a file
    is split.
    """
    reader = spark.read.option("header", True).option("multiLine", breaks).option("escape", '"').option("mode", "FAILFAST")
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def read_csv_lines(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, breaks: bool = True, first: int = 2,
    file: str = "source_file", line: str = "source_line_number",
) -> DataFrame:
    """``read_csv`` with each row's file and its number within the file, counted from ``first`` (the header is line 1).

    Records are counted, so one with line breaks in a value is one line. Rows keep their place within a split of the file; the rows of the splits
    before are summed up, one row for each split. Nothing is sorted, and no split meets another. The rows are stored, so numbers do
    not depend on how the file is cut when it is read again.
    """
    read = read_csv(spark, path, columns, breaks)
    place = {file: F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    rows = cut_lineage(read.select(*read.columns, *[c.alias(n) for n, c in place.items()]))
    splits = rows.groupBy(file, "_split").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_start"))
    before = Window.partitionBy(file).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(splits.select(F.col(file).alias("_file"), F.col("_split").alias("_at"), "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    numbered = rows.join(offsets, (F.col(file) == F.col("_file")) & (F.col("_split") == F.col("_at")))
    return numbered.select(*read.columns, file, (F.col("_row") - F.col("_start") + F.col("_before") + first).alias(line))


def qualified(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def role_score(columns: Sequence[str], role: str) -> int:
    """How much the columns look like the table of a role."""
    known = {column_key(c) for c in columns}
    return sum(weight for names, weight in DISCOVERY_WEIGHTS[role] for name in names if name in known)


def best_table(schemas: Mapping[str, Sequence[str]], role: str) -> str:
    """Highest (score, name); an error if nothing looks like the role."""
    score, name = max(((role_score(columns, role), name) for name, columns in schemas.items()), default=(0, ""))
    if score <= 0:
        raise ValueError(f"no table looks like the {role} table; name it explicitly")
    return name


def discover_tables(spark: SparkSession, schema: str, **given: str) -> dict[str, str]:
    """Table per role, guessed from the column names unless given. Reads metadata only."""
    names = [t.name for t in spark.catalog.listTables(schema) if not t.isTemporary]
    parts = schema.split(".")
    schemas = {n: spark.table(qualified(*parts, n)).columns for n in names}
    return {role: qualified(*parts, given.get(role) or best_table(schemas, role)) for role in DISCOVERY_WEIGHTS}


def first_available(**sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read, its name in the column ``source``."""
    failures = []
    for name, open_source in sources.items():
        try:
            return open_source().withColumn("source", F.lit(name))
        except AnalysisException as failure:
            failures.append(f"{name}: {failure.getCondition()}")
    raise ValueError("no source available: " + "; ".join(failures))
