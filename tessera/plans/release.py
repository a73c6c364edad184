"""Planning and applying releases: upserts, overlays and compare-and-swap deltas.

Nothing is written in place: applying a plan gives the new snapshot, which callers write beside the
old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RejectedDelta(ValueError):
    """A delta that does not fit its base; nothing of it was applied."""


def plan_upserts(desired: DataFrame, current: DataFrame, key: str, fields: list[str], blocked: Column | None = None) -> DataFrame:
    """``status`` of every desired row: ready_create, ready_update, already_current or blocked, with
    the fields that change; rows that only the current side has are ``outside_release``."""
    want = desired.select(key, F.struct(*fields).alias("want"), F.coalesce(blocked if blocked is not None else F.lit(False), F.lit(False)).alias("is_blocked"))
    have = current.select(key, F.struct(*fields).alias("have"))
    joined = want.join(have, key, "full_outer")
    change = F.array_compact(F.array(*[F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"have.{f}")), F.lit(f)) for f in fields]))
    status = (
        F.when(F.col("want").isNull(), "outside_release")
        .when(F.col("is_blocked"), "blocked")
        .when(F.col("have").isNull(), "ready_create")
        .when(F.size(change) == 0, "already_current")
        .otherwise("ready_update")
    )
    return joined.select(key, status.alias("status"), F.when(status == "ready_update", change).otherwise(F.array().cast("array<string>")).alias("changed"))


def check_delta(base: DataFrame, delta: DataFrame, key: str, base_hash: str, expected: str) -> DataFrame:
    """Each delta row against its base: ready, stale (hash differs), missing or duplicate."""
    have = base.select(key, F.col(base_hash).alias("have_hash"))
    counted = delta.groupBy(key).agg(F.count("*").alias("n"), F.min(expected).alias("want_hash"))
    status = F.when(F.col("n") > 1, "duplicate").when(F.col("have_hash").isNull(), "missing").when(F.col("have_hash") != F.col("want_hash"), "stale").otherwise("ready")
    return counted.join(have, key, "left").select(key, status.alias("status"))


def apply_delta(base: DataFrame, delta: DataFrame, key: str, base_hash: str, expected: str) -> DataFrame:
    """The base with the delta's rows in place of its own, or ``RejectedDelta`` if any does not fit."""
    bad = check_delta(base, delta, key, base_hash, expected).where("status <> 'ready'").groupBy("status").count().collect()
    if bad:
        raise RejectedDelta(", ".join(f"{r['status']}: {r['count']}" for r in sorted(bad)))
    return base.join(delta.select(key), key, "left_anti").unionByName(delta.select(*base.columns))


def insert_only(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The base with the new rows added, or ``RejectedDelta`` if one has a key that is taken."""
    for key in keys:
        if new.join(base.select(key), key, "left_semi").limit(1).count() or new.groupBy(key).count().where("count > 1").limit(1).count():
            raise RejectedDelta(f"{key} is taken")
    return base.unionByName(new.select(*base.columns))


def verify(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Readback: rows that are missing or differ after an apply, with the fields; none is the pass."""
    a, b = expected.select(key, F.struct(*fields).alias("left")), actual.select(key, F.struct(*fields).alias("right"))
    joined = a.join(b, key, "left")
    change = F.array_compact(F.array(*[F.when(~F.col(f"left.{f}").eqNullSafe(F.col(f"right.{f}")), F.lit(f)) for f in fields]))
    return joined.select(key, F.col("right").isNull().alias("missing"), change.alias("changed")).where(F.col("missing") | (F.size("changed") > 0))


def patch_plan(current: DataFrame, patches: DataFrame, key: str, fields: list[str], allowed: list[str], snapshot: Column) -> DataFrame:
    """Dry run of patches: ``status``, ``blockers`` and the fields still to change.

    ``patches`` has the key, ``patch`` (a map from field to text) and ``expected`` (the hash of the
    snapshot that it was planned on); ``snapshot`` hashes a current row.  A patch is blocked if its
    target is missing, if it names a field outside ``allowed``, or if the target changed since and it
    still has something to change; else it would_update or is already_current.
    """
    have = current.select(key, snapshot.alias("hash_of_row"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("have"))
    joined = patches.select(key, "patch", "expected").join(have, key, "left")
    touched = F.coalesce(F.map_keys("patch"), F.array().cast("array<string>"))
    change = F.array_compact(F.array(*[F.when(F.array_contains(touched, f) & ~F.col("patch")[f].eqNullSafe(F.col(f"have.{f}")), F.lit(f)) for f in fields]))
    strange = F.transform(F.array_sort(F.array_except(touched, F.array(*[F.lit(f) for f in allowed]))), lambda x: F.concat(F.lit("unexpected_field:"), x))
    missing = F.col("have").isNull()
    stale = ~missing & (F.size(change) > 0) & ~F.col("expected").eqNullSafe(F.col("hash_of_row"))
    blockers = F.concat(F.array_compact(F.array(F.when(missing, F.lit("missing_target")), F.when(stale, F.lit("stale_snapshot")))), strange)
    status = F.when(F.size("blockers") > 0, "blocked").when(F.size("changed") > 0, "would_update").otherwise("already_current")
    return joined.select(key, blockers.alias("blockers"), F.when(missing, F.array().cast("array<string>")).otherwise(change).alias("changed")).withColumn("status", status)
