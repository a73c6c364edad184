"""Joins that bind records to works: enrichment, cascades, exact bindings, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import any_repeats, join_by_work


def enrich(base: DataFrame, key: str, *details: DataFrame) -> DataFrame:
    """The base with each detail table's columns, left joined; Catalyst picks what to broadcast."""
    return reduce(lambda left, right: left.join(right, key, "left"), details, base)


def enrich_if_same(base: DataFrame, detail: DataFrame, key: str, same: str, columns: list[str]) -> DataFrame:
    """Detail columns only where the detail agrees with the base in ``same``, null included."""
    right = detail.select(F.col(key).alias("key_of_detail"), F.col(same).alias("same_of_detail"), *columns)
    on = (F.col(key) == F.col("key_of_detail")) & F.col(same).eqNullSafe(F.col("same_of_detail"))
    return base.join(right, on, "left").drop("key_of_detail", "same_of_detail")


def orphans(rows: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None) -> DataFrame:
    """Rows whose key the reference lacks; a null key is an orphan."""
    known = reference.select(F.col(reference_key or key).alias("known_key"))
    return rows.join(known, F.col(key) == F.col("known_key"), "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer comparison: ``status`` is same, changed, only_left or only_right."""
    a = left.select(F.col(key), F.struct(*values).alias("left"))
    b = right.select(F.col(key), F.struct(*values).alias("right"))
    status = F.when(F.col("right").isNull(), "only_left").when(F.col("left").isNull(), "only_right").when(F.col("left").eqNullSafe(F.col("right")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), *[F.col(f"left.{v}").alias(f"{v}_left") for v in values], *[F.col(f"right.{v}").alias(f"{v}_right") for v in values])


def matches(records: DataFrame, works: DataFrame, record: str, work: str, tier: str, record_key: Column, work_key: Column, kept: int = 10) -> DataFrame:
    """For each record with a match in this tier: number of works and the first ``kept`` by id.

    Works are counted by key before the join, so a common key costs one row, not one for each pair.
    """
    by_key = works.select(work_key.alias("k"), F.col(work).alias("w")).where("k is not null and k <> ''").distinct()
    # The first works of a key are ranked before they are gathered, so that no row holds all of a common key's.
    first = by_key.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("w"))).where(F.col("place") <= kept)
    first = first.groupBy("k").agg(F.array_sort(F.collect_list("w")).alias("works"))
    by_key = by_key.groupBy("k").agg(F.count("*").alias("n")).join(first, "k")
    keyed = records.select(F.col(record).alias("r"), record_key.alias("k"))
    return keyed.join(by_key, "k").select(F.col("r").alias(record), F.lit(tier).alias("tier"), "n", "works")


def cascade(records: DataFrame, works: DataFrame, record: str, work: str, tiers: list[tuple[str, Column, Column]], kept: int = 10) -> DataFrame:
    """The first tier in which a record has any match decides: ``matched`` on one work, ``ambiguous``
    on several, ``new`` where no tier has one."""
    out = records.select(record)
    for i, (tier, rk, wk) in enumerate(tiers):
        found = matches(records, works, record, work, tier, rk, wk, kept).select(record, F.struct("tier", "n", "works").alias(f"t{i}"))
        out = out.join(found, record, "left")
    first = F.coalesce(*[F.col(f"t{i}") for i in range(len(tiers))])
    status = F.when(first.isNull(), "new").when(first["n"] == 1, "matched").otherwise("ambiguous")
    return out.select(record, status.alias("status"), F.coalesce(first["tier"], F.lit("none")).alias("tier"), F.coalesce(first["n"], F.lit(0)).alias("n_matches"), F.when(first["n"] == 1, first["works"][0]).alias("work"), first["works"].alias("works"))


def any_key_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: Column, right_keys: Column) -> DataFrame:
    """Distinct pairs that share one of their keys (arrays on both sides).

    A pair comes from the first key that it shares, so pairs are made where they meet and only ids that
    have several rows need a look for repeats.
    """
    filled = lambda own: F.array_distinct(F.filter(own, lambda k: F.coalesce(k != "", F.lit(False))))
    a = left.select(F.col(left_id).alias("a"), filled(left_keys).alias("a_keys")).withColumn("k", F.explode("a_keys"))
    b = right.select(F.col(right_id).alias("b"), filled(right_keys).alias("b_keys")).withColumn("k", F.explode("b_keys"))
    pairs = join_by_work(a, b, ["k"]).where(F.get(F.array_intersect("a_keys", "b_keys"), F.lit(0)) == F.col("k")).select(F.col("a").alias(left_id), F.col("b").alias(right_id))
    return pairs.distinct() if any_repeats(left, left_id) or any_repeats(right, right_id) else pairs


def bind_exact(records: DataFrame, works: DataFrame, record: str, first: str, second: str, work: str) -> DataFrame:
    """Bind by two keys that must lead to the same one work.

    ``status``: bound, conflict (they lead to different works), duplicate (a key leads to several),
    partial (one key leads nowhere) or missing.
    """
    sides = []
    for i, key in enumerate((first, second)):
        side = works.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"k{i}")).agg(F.count_distinct(work).alias(f"n{i}"), F.min(work).alias(f"w{i}"))
        sides.append(side)
    out = records.join(sides[0], F.col(first) == F.col("k0"), "left").join(sides[1], F.col(second) == F.col("k1"), "left")
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    status = (
        F.when((n0 == 0) & (n1 == 0), "missing")
        .when((n0 > 1) | (n1 > 1), "duplicate")
        .when((n0 == 0) | (n1 == 0), "partial")
        .when(F.col("w0") != F.col("w1"), "conflict")
        .otherwise("bound")
    )
    return out.select(record, status.alias("status"), F.when(status == "bound", F.col("w0")).alias(work))


def merge_responses(expected: DataFrame, received: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Requests against responses: accepted, missing, unknown or duplicate, payload only if accepted."""
    got = received.groupBy(key).agg(F.count("*").alias("n_received"), F.min(F.struct(*payload)).alias("p"))
    asked = expected.select(key).distinct().withColumn("asked", F.lit(True))
    status = F.when(F.col("asked").isNull(), "unknown").when(F.col("n_received").isNull(), "missing").when(F.col("n_received") > 1, "duplicate").otherwise("accepted")
    joined = asked.join(got, key, "full_outer")
    return joined.select(key, status.alias("status"), F.coalesce("n_received", F.lit(0)).alias("n_received"), *[F.when(status == "accepted", F.col(f"p.{c}")).alias(c) for c in payload])


def token_pairs(rows: DataFrame, row_id: str, tokens: Column, *, least: int = 2, most: int = 12) -> DataFrame:
    """Pairs of rows that share a rare token (in ``least`` to ``most`` rows), with the tokens shared.

    The frequency bound is the definition of rare; it also bounds the pairs of a token.
    """
    each = rows.select(F.col(row_id).alias("id"), F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    rare = each.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df").between(least, most)).select("token")
    kept = each.join(rare, "token")
    pairs = kept.select("token", F.col("id").alias("a")).join(kept.select("token", F.col("id").alias("b")), "token").where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("tokens"), F.count("*").alias("n"))


def zipped(left: DataFrame, right: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Rows of two files at the same place; ``aligned`` says whether their keys agree."""
    a = left.select(F.col(ordinal), F.col(key).alias("left_key"), F.struct(*left.columns).alias("left"))
    b = right.select(F.col(ordinal), F.col(key).alias("right_key"), F.struct(*right.columns).alias("right"))
    return a.join(b, ordinal, "full_outer").withColumn("aligned", F.col("left_key").eqNullSafe(F.col("right_key")))


def with_reasons(rows: DataFrame, reasons: dict[str, Column], name: str = "reasons") -> DataFrame:
    """Names of the conditions that hold, in order, as an array."""
    return rows.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()])))


def asserted(left: DataFrame, right: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """A one-to-one join that says where it is none: ``status`` of each key.

    matched; missing_left or missing_right; repeated (a key twice on a side); identity_differs (a field
    of ``identity`` is not the same on both sides).
    """
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.min(F.struct(*identity)).alias(name))
    both = side(left, "left").join(side(right, "right"), key, "full_outer")
    status = (
        F.when(F.col("n_left").isNull(), "missing_left").when(F.col("n_right").isNull(), "missing_right")
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").when(~F.col("left").eqNullSafe(F.col("right")), "identity_differs").otherwise("matched")
    )
    return both.select(key, status.alias("status"))
