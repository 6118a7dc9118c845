"""Planner actions as an append-only log folded to its latest state.

Every write is one more row; the current state of a key is its last row by (time, sequence). The
fold is a ``max_by`` aggregate: it combines before the shuffle, so a key with very many writes is
not gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import Rule, check_rows

DISTRICT_KEY = ("care_need", "state", "district_name")
FACILITY_KEY = ("care_need", "facility_id", "capability")
TEXT_LIMITS = {"note_text": 4000, "reason": 2000, "override_reason": 2000}


def no_actions() -> dict[str, Column]:
    """State of a district nobody acted on."""
    return {
        "shortlisted": F.lit(False), "verification_requested": F.lit(False), "dismissed": F.lit(False),
        "note_latest": F.lit(""), "override_score": F.lit(None).cast("decimal(5,2)"), "override_reason": F.lit(""),
    }


def latest_by(
    log: DataFrame, keys: Sequence[str], ts: str = "updated_at", seq: str = "seq", created: str = "created_at"
) -> DataFrame:
    """Last row per key; ``created`` is the time of the key's first row."""
    payload = [c for c in log.columns if c not in (*keys, created)]
    folded = log.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(ts, seq)).alias("last"),
        F.min(F.coalesce(F.col(created), F.col(ts)) if created in log.columns else F.col(ts)).alias(created),
    )
    return folded.select(*keys, "last.*", created)


def upsert(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], ts: str = "updated_at", seq: str = "seq",
    created: str = "created_at",
) -> DataFrame:
    """Folded state after more writes: a changed key takes the change, whatever the clocks say."""
    both = base.withColumn("_gen", F.lit(0)).unionByName(changes.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    payload = [c for c in base.columns if c not in (*keys, created)]
    folded = both.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct("_gen", ts, seq)).alias("last"),
        F.min(F.coalesce(F.col(created), F.col(ts))).alias(created),
    )
    return folded.select(*keys, "last.*", created).select(*base.columns)


def latest_decisions(log: DataFrame) -> DataFrame:
    return latest_by(log, DISTRICT_KEY)


def latest_overrides(log: DataFrame) -> DataFrame:
    """A NULL score clears an override."""
    return latest_by(log, DISTRICT_KEY)


def latest_verifications(log: DataFrame) -> DataFrame:
    return latest_by(log, FACILITY_KEY)


def latest_notes(notes: DataFrame) -> DataFrame:
    """Newest note per district; equal times by the higher id."""
    newest = F.max_by(F.struct("district_id", "note_text", "created_at"), F.struct("created_at", "id"))
    return notes.groupBy(*DISTRICT_KEY).agg(newest.alias("last")).select(
        *DISTRICT_KEY, "last.district_id", F.col("last.note_text").alias("note_latest"), "last.created_at"
    )


def merge_actions(decisions: DataFrame, notes: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row per district anyone acted on, with defaults for the actions not taken."""
    key = [F.col("care_need"), F.trim("state").alias("state"), F.trim("district_name").alias("district_name")]
    merged = (
        decisions.select(*key, "shortlisted", "verification_requested", "dismissed")
        .join(notes.select(*key, "note_latest"), list(DISTRICT_KEY), "full_outer")
        .join(overrides.select(*key, "override_score", "override_reason"), list(DISTRICT_KEY), "full_outer")
    )
    return merged.select(*DISTRICT_KEY, *[F.coalesce(F.col(n), d).alias(n) for n, d in no_actions().items()])


def load_actions(
    need: str, decisions: DataFrame, notes: DataFrame, overrides: DataFrame, verifications: DataFrame
) -> dict[str, DataFrame]:
    """Latest state of the four logs for one need; the filter is applied before the folds."""

    def of_need(log: DataFrame) -> DataFrame:
        return log.where(F.col("care_need") == need)

    return {
        "decisions": latest_decisions(of_need(decisions)),
        "notes": latest_notes(of_need(notes)),
        "overrides": latest_overrides(of_need(overrides)),
        "verifications": latest_verifications(of_need(verifications)),
    }


def action_rules(columns: Sequence[str]) -> list[Rule]:
    """Rules a logged action must meet, for the columns its log has."""
    required = [
        c for c in ("care_need", "district_id", "district_name", "facility_id", "capability") if c in columns
    ]
    if "state" in columns and "facility_id" not in columns:
        required.append("state")
    flags = [c for c in ("shortlisted", "dismissed", "verification_requested", "requested") if c in columns]
    rules = [Rule(f"blank_{c}", "error", F.coalesce(F.col(c), F.lit("")) == "", f"{c} is required.") for c in required]
    rules += [Rule(f"missing_{c}", "error", F.col(c).isNull(), f"{c} is required.") for c in flags]
    if "override_score" in columns:
        score = F.col("override_score")
        rules.append(Rule("score_out_of_range", "error", (score < 0) | (score > 100), "override_score must be 0 to 100."))
    if "note_text" in columns:
        rules.append(Rule("missing_note_text", "error", F.col("note_text").isNull(), "note_text is required."))
    rules += [
        Rule(f"long_{c}", "error", F.length(F.trim(c)) > most, f"{c} is longer than {most} characters.")
        for c, most in TEXT_LIMITS.items()
        if c in columns
    ]
    return rules


def check_actions(log: DataFrame) -> DataFrame:
    """The log with the array of rules each action breaks."""
    return check_rows(log, action_rules(log.columns))
