"""Incremental processing: what a row needs, given what the ledger says was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(rows: DataFrame, ledger: DataFrame, key: str, *, policy: str | None = None, profile: str | None = None) -> DataFrame:
    """Adds ``action`` to each row, the first of twelve that applies.

    Rows have ``fingerprint`` and ``protected``; the ledger, one row for each key, has
    ``old_fingerprint``, ``research_status``, ``policy_version``, ``profile_id`` and ``qa_status``.
    """
    known = ledger.select(F.col(key), F.lit(True).alias("in_ledger"), *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("old_fingerprint", "research_status", "policy_version", "profile_id", "qa_status")])
    joined = rows.join(known, key, "left")
    differs = lambda c, want: F.lit(want).isNotNull() & (F.coalesce(F.lit(want), F.lit("")) != "") & F.col(c).isNotNull() & (F.col(c) != F.lit(want))
    action = (
        F.when(F.coalesce("protected", F.lit(False)), "skip_protected")
        .when(F.col("in_ledger").isNull(), "research_new")
        .when(F.col("old_fingerprint").isNotNull() & (F.col("old_fingerprint") != F.col("fingerprint")), "research_refresh_catalog_changed")
        .when(F.col("research_status").isin("needs_more_research", "identity_review"), F.concat(F.lit("research_retry_"), F.col("research_status")))
        .when(F.col("qa_status") == "ai_qa_deferred", "research_retry_ai_qa_deferred")
        .when(differs("policy_version", policy), "reassess_policy_changed")
        .when(differs("profile_id", profile), "reassess_calibration_changed")
        .when(F.col("qa_status") == "ai_qa_passed", "skip_completed_unchanged")
        .when(F.col("qa_status") == "legacy_assessed", "reassess_legacy_assessment")
        .when(F.col("research_status") == "ready_for_ai_assessment", "assess_existing_research")
        .otherwise("research_retry_incomplete")
    )
    return joined.select(*rows.columns, action.alias("action"))


def needs(action: Column) -> tuple[Column, Column]:
    """Whether an action asks for research, and for assessment."""
    return action.startswith("research_"), action.startswith("reassess_") | action.startswith("assess_")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those already written, for resuming a run."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
