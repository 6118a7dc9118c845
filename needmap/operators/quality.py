"""Row validation, quarantine, split, profiles and the gates built on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PLACES, RECORD_TYPES, VALID_FACILITY_TYPES, VALID_OPERATOR_TYPES
from ..functions import blank_to_null, canonical, no_shared_token, strip
from ..functions.keys import UUID_PATTERN


class GateError(RuntimeError):
    """A data contract does not hold."""


@dataclass(frozen=True)
class Rule:
    """A row rule. ``broken`` is true on rows that violate it; ``stop`` rules silence the later ones."""

    name: str
    severity: str
    broken: Column
    message: Column | str
    stop: bool = False


# Shapes that give away a value from another column (fixed values).
JSON_START = r"^\s*[\[{]"
DATE = r"^\d{4}-\d{2}-\d{2}$"
NUMBER = r"^-?\d+(?:\.\d+)?$"
MARKDOWN_START = r"^\s*(?:[*#>-]|__|\*\*)"
FACILITY_KIND = (
    r"(?iU)\b(?:hospital|clinic|centre|center|nursing home|dental|dentist|diagnostic|labs?|pathology|medical"
    r"|health care|healthcare)\b"
)
FACILITY_ID = "^facility:" + UUID_PATTERN[1:]


def coordinate_object(value: Column) -> Column:
    text = strip(value)
    return text.startswith('{"coordinates":') | text.startswith("{'coordinates':")


def looks_shifted(value: Column) -> Column:
    """JSON, a uuid or a date where a label or a name should be."""
    text = strip(value)
    return text.rlike(JSON_START) | text.rlike(UUID_PATTERN) | text.rlike(DATE)


def looks_shifted_description(value: Column) -> Column:
    return looks_shifted(value) | strip(value).rlike(NUMBER) | F.lower(strip(value)).isin("true", "false", "null")


def in_domain(value: Column, allowed: Sequence[str]) -> Column:
    return F.lower(strip(value)).isin(*allowed)


def record_rules(opening: int = 180) -> list[Rule]:
    """Rules of the mixed record table.

    A description is expected to name its facility within its first ``opening`` characters; the other rules read it whole.
    """
    kind = strip(F.col("record_type"))
    facility = kind == "facility"
    name, text = strip(F.col("entity_name")), strip(F.col("description"))
    quoted = F.when(kind.contains("'") & ~kind.contains('"'), F.concat(F.lit('"'), kind, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), kind, F.lit("'"))
    )

    def error(rule: str, broken: Column, message: str) -> Rule:
        return Rule(rule, "error", facility & broken, message)

    def warning(rule: str, broken: Column, message: str) -> Rule:
        return Rule(rule, "warning", facility & broken, message)

    return [
        Rule(
            "invalid_record_type", "error", ~kind.isin(*RECORD_TYPES),
            F.concat(F.lit("Unexpected record_type "), quoted, F.lit(".")), stop=True,
        ),
        error(
            "malformed_facility_id", ~strip(F.col("record_id")).rlike(FACILITY_ID),
            "Facility record_id is not facility:<uuid>.",
        ),
        error("blank_facility_name", name == "", "Facility row has no entity_name."),
        error(
            "facility_name_column_drift", (name != "") & (looks_shifted(name) | name.rlike(MARKDOWN_START)),
            "Facility entity_name looks like JSON, markdown, or shifted prose.",
        ),
        error(
            "facility_type_column_drift",
            ~in_domain(F.col("facility_type"), VALID_FACILITY_TYPES) | looks_shifted(F.col("facility_type")),
            "facility_type contains an unexpected or shifted value.",
        ),
        error(
            "operator_type_column_drift",
            ~in_domain(F.col("operator_type"), VALID_OPERATOR_TYPES) | looks_shifted(F.col("operator_type")),
            "operator_type contains an unexpected or shifted value.",
        ),
        error("phone_column_drift", coordinate_object(F.col("phone")), "phone contains a coordinate object."),
        error(
            "website_column_drift",
            looks_shifted(F.col("website")) & ~strip(F.col("website")).startswith("http"),
            "website contains JSON, a UUID, a date, or another shifted scalar.",
        ),
        error(
            "description_column_drift", looks_shifted_description(text),
            "description contains a coordinate, UUID, date, boolean, or JSON value.",
        ),
        warning(
            "short_facility_description", (text != "") & (F.length(text) < 40),
            "Facility description is shorter than 40 characters.",
        ),
        warning(
            "possible_description_mismatch",
            (text != "") & (name != "") & text.rlike(FACILITY_KIND) & no_shared_token(name, F.substring(text, 1, opening)),
            "Description appears to name a different facility.",
        ),
    ]


def rebuild_rule() -> Column:
    """Short form of the error rules, used when records are rebuilt from the sources."""
    return (F.col("record_type") == "facility") & (
        ~F.col("record_id").rlike(FACILITY_ID)
        | F.col("entity_name").isNull()
        | (F.trim("entity_name") == "")
        | F.col("entity_name").rlike(r"^\s*(?:[\[{]|\*|__|>|#)")
        | F.col("description").rlike(r"^\s*(?:-?\d+(?:\.\d+)?|true|false|null|\[|\{)\s*$")
    )


def repair_rule() -> Column:
    """The error rules as one predicate over a stored table."""
    kind, operator = F.lower(F.trim(_text("facility_type"))), F.lower(F.trim(_text("operator_type")))
    name, website, text = F.trim(_text("entity_name")), F.trim(_text("website")), F.trim(_text("description"))
    loose_uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,36}$"
    kinds = [k for k in VALID_FACILITY_TYPES if k != "nursing_home"]
    return (F.col("record_type") == "facility") & (
        ~_text("record_id").rlike(FACILITY_ID)
        | (name == "")
        | name.rlike(r"^(?:[\[{]|\*|__|>|#)")
        | ~kind.isin(*kinds)
        | ~operator.isin(*VALID_OPERATOR_TYPES)
        | F.trim(_text("phone")).startswith('{"coordinates":')
        | (~website.rlike("(?i)^https?://") & website.rlike(r"^[\[{]|" + loose_uuid + "|" + DATE))
        | text.rlike(r"^(?:true|false|null)$|^[\[{]|" + loose_uuid + "|" + DATE + "|" + NUMBER)
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


_ISSUE = "array<struct<rule:string,severity:string,message:string>>"


def check_rows(df: DataFrame, rules: Sequence[Rule], into: str = "issues") -> DataFrame:
    """Adds the array of broken rules to every row; one scan for all rules."""
    stopped = F.lit(False)
    entries = []
    for rule in rules:
        broken = F.coalesce(rule.broken, F.lit(False))
        message = rule.message if isinstance(rule.message, Column) else F.lit(rule.message)
        entry = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), message.alias("message"))
        entries.append(F.when(broken & ~stopped, entry))
        if rule.stop:
            stopped = stopped | broken
    return df.withColumn(into, F.array_compact(F.array(*entries)).cast(_ISSUE))


def validate(
    df: DataFrame, rules: Sequence[Rule] | None = None, columns: Sequence[str] = ("record_id", "entity_name")
) -> DataFrame:
    """One row per (row, broken rule). ``columns`` say which row; of a CSV file, ``read_csv_lines`` has the line number."""
    checked = check_rows(df, record_rules() if rules is None else rules)
    return checked.select(*columns, F.explode("issues").alias("issue")).select(*columns, "issue.*")


def quarantine(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rows with an error, all their errors kept."""
    checked = check_rows(df, record_rules() if rules is None else rules)
    errors = F.filter("issues", lambda i: i["severity"] == "error")
    return (
        checked.withColumn("errors", errors)
        .where(F.size("errors") > 0)
        .select(
            *df.columns,
            F.array_join(F.transform("errors", lambda i: i["rule"]), "|").alias("validation_rules"),
            F.array_join(F.transform("errors", lambda i: i["message"]), " ").alias("validation_messages"),
        )
    )


def split(df: DataFrame, invalid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): complementary, a NULL verdict is valid."""
    verdict = F.coalesce(invalid, F.lit(False))
    return df.where(~verdict), df.where(verdict)


def source_rows(df: DataFrame, rejected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows that have a rejected row with the same key."""
    return df.join(rejected.select(*key).distinct(), list(key), "left_semi")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("issues"))


def type_counts(df: DataFrame) -> DataFrame:
    kind = strip(F.col("record_type"))
    label = F.when(kind == "", F.lit("<blank>")).otherwise(kind)
    return df.groupBy(label.alias("record_type")).agg(F.count(F.lit(1)).alias("rows"))


def report(df: DataFrame, rules: Sequence[Rule] | None = None, examples: int = 10) -> dict:
    """Totals of a validation, in one scan.

    What is collected is one row per rule: its number of issues and, as its example, the broken row that comes first by id and
    name. ``types`` are the rows per record type, a lazy frame, as a drifted table can hold any number of types.
    """
    rules = record_rules() if rules is None else rules
    checked = check_rows(df, rules)
    first_or_none = F.col("pos").isNull() | (F.col("pos") == 0)
    found = (
        checked.select("record_id", "entity_name", F.posexplode_outer("issues").alias("pos", "issue"))
        .groupBy("issue.severity", "issue.rule")
        .agg(
            F.count(F.lit(1)).alias("issues"), F.count_if(first_or_none).alias("rows"),
            F.min(F.struct("record_id", "entity_name", F.col("issue.message").alias("message"))).alias("first"),
        )
        .collect()
    )
    broken = sorted((r for r in found if r["rule"] is not None), key=lambda r: r["rule"])
    totals = {"error": 0, "warning": 0}
    for row in broken:
        totals[row["severity"]] = totals.get(row["severity"], 0) + row["issues"]
    return {
        "rows": sum(r["rows"] for r in found), "types": type_counts(df), "errors": totals["error"], "warnings": totals["warning"],
        "rules": {r["rule"]: r["issues"] for r in broken},
        "examples": [{"rule": r["rule"], "severity": r["severity"], **r["first"].asDict()} for r in broken[:examples]],
    }


def gate(result: dict, warnings_fail: bool = False) -> dict:
    """Stop on errors (and on warnings if asked to)."""
    if result["errors"] or (warnings_fail and result["warnings"]):
        raise GateError(f"validation failed: {result['errors']} errors, {result['warnings']} warnings, {result['rules']}")
    return result


def match_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column, all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def noncanonical(df: DataFrame, column: str, allowed: Sequence[str] = PLACES.canonical_states) -> DataFrame:
    """Values outside the list, with their number of rows."""
    outside = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    return df.where(outside).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def unknown_labels(df: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Values that are no known spelling of any label, with their number of rows; blank ones are left out."""
    unknown = (strip(F.col(column)) != "") & canonical(F.col(column), aliases).isNull()
    return df.where(unknown).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def check_grain(before: DataFrame, after: DataFrame, key: str, label: str | None = None, allowed: Sequence[str] = ()) -> dict:
    """Fail unless ``after`` has the rows of ``before``, unique keys and canonical labels only."""
    groups = after.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(*allowed)) if label else F.lit(0)).alias("bad"),
    )
    got = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicates"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("noncanonical"),
    ).first().asDict()
    got["expected"] = before.count()
    if got["rows"] != got["expected"] or got["duplicates"] or got["noncanonical"]:
        raise GateError(f"grain check failed: {got}")
    return got


def check_split(total: DataFrame, valid: DataFrame, rejected: DataFrame) -> dict:
    """Fail unless the two parts add up to the whole; one job over the three, which are best stored tables."""
    parts = None
    for name, frame in (("total", total), ("valid", valid), ("quarantine", rejected)):
        rows = frame.select(F.lit(name).alias("part"))
        parts = rows if parts is None else parts.unionByName(rows)
    names = ("total", "valid", "quarantine")
    got = parts.agg(*[F.count_if(F.col("part") == n).alias(n) for n in names]).first().asDict()
    if got["valid"] + got["quarantine"] != got["total"]:
        raise GateError(f"split does not add up: {got}")
    return got


def profile(df: DataFrame, columns: Sequence[str], text: str | None = None, short: int = 40) -> DataFrame:
    """Present values per column in numbers and percent; for a text column also median and short lengths.

    The median is exact. Its state is a histogram of lengths, bounded by the longest text and not
    by the number of rows, and it combines before the shuffle.
    """
    size = F.length(strip(F.col(text))) if text else None
    shown = [F.count_if(strip(F.col(c).cast("string")) != "").alias(f"present_{c}") for c in columns]
    lengths = (
        [
            F.percentile(size, 0.5).alias("median_length"),
            F.count_if((size > 0) & (size < short)).alias("short_texts"),
        ]
        if text
        else []
    )
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *shown, *lengths)
    shares = [
        F.coalesce(F.try_divide(F.col(f"present_{c}") * F.lit(100.0), F.col("rows")), F.lit(0.0)).alias(f"pct_{c}")
        for c in columns
    ]
    return counted.select("*", *shares)


def top_counts(df: DataFrame, columns: Sequence[str], n: int, blank: str = "Unknown") -> DataFrame:
    """Most common values, blank ones under one label; ties by value."""
    named = [F.coalesce(blank_to_null(strip(F.col(c))), F.lit(blank)).alias(c) for c in columns]
    counted = df.select(*named).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    return counted.orderBy(F.desc("rows"), *columns).limit(n)
