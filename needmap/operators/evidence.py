"""Capability claims from free text, with the cited snippet.

Everything is one Catalyst expression per capability: its patterns in order, the first hit winning. A text is cut into words once, and
only patterns whose words are among them are run. No UDF, no shuffle, whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLAIM_FIELDS, TAXONOMY, Capability, Taxonomy
from ..functions import blank_to_null, strip

# i: any case, d: only \n ends a line, U: \b, \s and \w cover all of Unicode.
FLAGS = "(?idU)"


_PLAIN_RUN = re.compile(r"\\[A-Za-z]|\[[^\]]*\]|\\.|[A-Za-z0-9 ',-]+|.")


def plain_part(pattern: str) -> str | None:
    """Longest text, in upper case, that every match of the pattern contains; None where that is not plain to see."""
    if re.search(r"[()|{]", pattern):
        return None
    runs, run = [], ""
    tokens = [t for t in _PLAIN_RUN.findall(pattern) if t]
    for i, token in enumerate(tokens):
        following = tokens[i + 1] if i + 1 < len(tokens) else ""
        if re.fullmatch(r"[A-Za-z0-9 ',-]+", token):
            if following[:1] in ("?", "*"):
                runs, run = [*runs, run + token[:-1]], ""
            else:
                run += token
        elif token != r"\b":
            runs, run = [*runs, run], ""
    longest = max([*runs, run], key=len).upper()
    return longest or None


_TOKEN = re.compile(r"\\s\+|\\[A-Za-z]|\[[^\]]*\]|\\.|[A-Za-z0-9 ',-]+|.")


def whole_words(pattern: str) -> tuple[str, ...]:
    """Words, in upper case, that stand as whole words in every match of the pattern; those that are plain to see."""
    if re.search(r"[()|{]", pattern):
        return ()
    tokens, found = _TOKEN.findall(pattern), []
    for i, run in enumerate(tokens):
        if not re.fullmatch(r"[A-Za-z0-9 ',-]+", run):
            continue
        before = tokens[i - 1] if i else ""
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        for word in re.finditer(r"[A-Za-z0-9]+", run):
            begins = word.start() > 0 or before in (r"\b", r"\s+")
            ends = word.end() < len(run) - (after[:1] in ("?", "*")) or (word.end() == len(run) and after in (r"\b", r"\s+"))
            if begins and ends:
                found.append(word[0].upper())
    return tuple(dict.fromkeys(found))


def match_start(text: Column, pattern: Column) -> Column:
    """Characters before the first match. Code points, where ``regexp_instr`` counts UTF-16 units."""
    return F.length(F.split(text, pattern, 2)[0])


def match_length(text: Column, pattern: Column) -> Column:
    return F.length(F.call_function("regexp_extract", text, pattern, F.lit(0)))


def find_capability(
    text: Column, folded: Column, words: Column, capability: Capability, hinted: Column | None = None
) -> Column:
    """(capability, confidence, pattern to cite), NULL without a claim.

    Strong patterns are tried first, then partial ones, then the type hint. A pattern is only run where all its whole words are among
    ``words``, those of the text that any pattern needs; one without such words only where its plain part occurs in the
    folded (upper-case) text. The results are constants; the position is
    worked out only for the one pattern that won.
    """

    def claim(confidence: str, pattern: str | None) -> Column:
        return F.struct(
            F.lit(capability.key).alias("capability"),
            F.lit(confidence).alias("confidence"),
            F.lit(pattern).cast("string").alias("pattern"),
        )

    def hit(pattern: str) -> Column:
        found = text.rlike(FLAGS + pattern)
        needed = whole_words(pattern)
        if needed:
            return reduce(and_, (F.array_contains(words, w) for w in needed)) & found
        plain = plain_part(pattern)
        return found if plain is None else folded.contains(plain) & found

    ordered = [("strong", p) for p in capability.strong] + [("partial", p) for p in capability.partial]
    tried = [F.when(hit(p), claim(confidence, FLAGS + p)) for confidence, p in ordered]
    return F.coalesce(*tried, *([] if hinted is None else [F.when(hinted, claim("weak", None))]))


def snippet(text: Column, start: Column, end: Column, window: int = 90) -> Column:
    """Text around [start, end), blanks collapsed, ``...`` on a side that was cut."""
    left = F.greatest(start - window, F.lit(0))
    right = F.least(end + window, F.length(text))
    middle = F.regexp_replace(strip(F.substring(text, left + 1, right - left)), r"(?U)\s+", " ")
    return F.concat(
        F.when(left > 0, F.lit("...")).otherwise(F.lit("")),
        middle,
        F.when(right < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )


def find_claims(df: DataFrame, text: str, kind: str | None = None, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """One row per (row, claimed capability): the input columns, ``capability``, ``confidence``, ``start``, ``length``.

    The position (in characters of ``text``) is NULL for a type hint.
    """
    # Upper case, and the two letters that only match I and K when case is ignored.
    folded = F.replace(F.upper(F.col(text)), F.lit("\u0130"), F.lit("I"))
    folded = F.replace(folded, F.lit("\u212a"), F.lit("K"))
    # The text is cut into words once; what stays of them is what patterns need, so each pattern looks into a short list.
    needed = sorted({w for k in taxonomy.capabilities for p in (*k.strong, *k.partial) for w in whole_words(p)})
    found_words = F.array_intersect(F.split("_folded", r"(?U)\W+"), F.array(*map(F.lit, needed)).cast("array<string>"))
    with_folded = df.withColumn("_folded", folded).withColumn("_words", found_words)
    label = F.lower(strip(F.col(kind))) if kind else None

    def hinted(key: str) -> Column | None:
        types = [t for t, keys in taxonomy.hints.items() if key in keys]
        return label.isin(types) if label is not None and types else None

    claims = F.array(
        *[find_capability(F.col(text), F.col("_folded"), F.col("_words"), c, hinted(c.key)) for c in taxonomy.capabilities]
    )
    found = with_folded.select(*df.columns, F.inline(F.array_compact(claims)))
    return found.withColumns(
        {"start": match_start(F.col(text), F.col("pattern")), "length": match_length(F.col(text), F.col("pattern"))}
    ).drop("pattern")


def extract_claims(
    records: DataFrame, taxonomy: Taxonomy = TAXONOMY, as_of: Column | None = None
) -> DataFrame:
    """Claims of located facility records, one row per (facility, capability)."""
    district, city = F.coalesce("district", F.lit("")), F.coalesce("city", F.lit(""))
    own_source = F.col("district_source") if "district_source" in records.columns else F.lit(None).cast("string")
    facilities = records.where(
        (F.col("record_type") == "facility") & (F.coalesce("state", F.lit("")) != "") & ((district != "") | (city != ""))
    ).select(
        F.coalesce("record_id", F.lit("")).alias("facility_id"),
        F.coalesce("entity_name", F.lit("")).alias("facility_name"),
        "state",
        F.when(district != "", district).otherwise(city).alias("district_or_city"),
        F.coalesce(blank_to_null(own_source), default_source(district, city)).alias("district_source"),
        "description",
        "facility_type",
    )
    found = find_claims(facilities, "description", "facility_type", taxonomy)
    weak = F.col("confidence") == "weak"
    start, length = F.col("start"), F.col("length")
    hint_text = F.concat(
        F.lit("Facility type is "),
        F.replace(F.lower(strip(F.col("facility_type"))), F.lit("_"), F.lit(" ")),
        F.lit("; capability requires verification."),
    )
    return found.select(
        "facility_id", "facility_name", "state", "district_or_city", "district_source",
        "capability",
        F.lit("claimed").alias("claim_status"),
        "confidence",
        F.when(weak, hint_text)
        .otherwise(snippet(F.col("description"), start, start + length, taxonomy.window))
        .alias("evidence_text"),
        F.when(F.col("confidence") == "strong", F.lit(taxonomy.strong_reason))
        .when(weak, F.lit(taxonomy.hint_reason))
        .otherwise(F.lit(taxonomy.partial_reason))
        .alias("uncertainty_reason"),
        F.when(weak, F.lit(taxonomy.hint_method)).otherwise(F.lit(taxonomy.method)).alias("extraction_method"),
        (F.current_timestamp() if as_of is None else as_of).alias("updated_at"),
    ).select(*CLAIM_FIELDS)


def default_source(district: Column, city: Column) -> Column:
    """Provenance of a record that carries none."""
    return (
        F.when(F.coalesce(district, F.lit("")) != "", F.lit("source_district"))
        .when(F.coalesce(city, F.lit("")) != "", F.lit("city_fallback"))
        .otherwise(F.lit("missing_location"))
    )


def coverage(claims: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Distinct facilities per capability; capabilities nobody claims stay with 0.

    The distinct pairs are formed first, so a capability that most rows claim is still spread.
    """
    listed = F.posexplode(F.array(*[F.lit(k) for k in taxonomy.keys])).alias("position", "capability")
    keys = claims.sparkSession.range(1).select(listed)
    counted = claims.groupBy("capability").agg(F.countDistinct("facility_id").alias("facilities"))
    joined = keys.join(counted, "capability", "left")
    return joined.select("position", "capability", F.coalesce("facilities", F.lit(0)).alias("facilities"))
