"""Joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, unused


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each value of ``key``.

    Facts mostly come from an aggregation by the key.  Its partitioning would serve the join as it
    is, and all rows of a key would meet in one task.  The key's hash as a second join column has
    both sides dealt anew, which lets adaptive execution split a partition that is too large.
    ``how`` is inner, left, left_semi or left_anti.  Null keys find nothing.
    """
    (hashed,) = unused(rows, "hash_of_key")
    joined = rows.withColumn(hashed, F.xxhash64(key)).join(facts.withColumn(hashed, F.xxhash64(key)), [hashed, key], how)
    return joined.drop(hashed)


def join_by_work(left: DataFrame, right: DataFrame, on: list[str], *, most: int = 1 << 20) -> DataFrame:
    """Inner join on ``on`` whose tasks are cut by the pairs they make, not by the bytes they read.

    Pairs of a key are as many as the product of its rows on both sides, so a small input can make one
    task's pairs without end.  Of a key with more than ``most`` pairs the longer side is dealt to
    pieces and the shorter one copied to each; there are as many tasks as pairs need.
    """
    n_left, n_right, piece, pieces = unused(left.join(right.limit(0), on), "n_left", "n_right", "piece", "pieces")
    sizes = left.groupBy(*on).agg(F.count("*").alias(n_left)).join(right.groupBy(*on).agg(F.count("*").alias(n_right)).hint("merge"), on)
    sizes = cut_lineage(sizes.withColumn(pieces, F.ceil(F.col(n_left) * F.col(n_right) / most)))
    total = sizes.agg(F.sum(F.col(n_left).cast("double") * F.col(n_right))).first()[0] or 0
    tasks = int(min(4000, max(1, -(-total // most))))

    def dealt(rows: DataFrame, longer: Column) -> DataFrame:
        own, every = F.pmod(F.xxhash64(*rows.columns), F.col(pieces)), F.sequence(F.lit(0).cast("long"), F.col(pieces) - 1)
        numbered = rows.join(sizes.hint("merge"), on).select(*rows.columns, F.explode(F.when(longer, F.array(own)).otherwise(every)).alias(piece))
        return numbered.repartition(tasks, *on, piece)

    split_left = F.col(n_left) >= F.col(n_right)
    return dealt(left, split_left).join(dealt(right, ~split_left).hint("merge"), [*on, piece]).drop(piece)


def any_repeats(rows: DataFrame, row_id: str) -> bool:
    """Whether an id has more than one row."""
    return not rows.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
