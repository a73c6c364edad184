"""Counts, roll-ups and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str, missing: str = "missing") -> DataFrame:
    """Rows by key, blank and null keys as ``missing``; most first, then by key."""
    bucket = F.coalesce(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")), F.lit(missing))
    return df.groupBy(bucket.alias(key)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def count_sets(df: DataFrame, *sets: list[str], others: str = "all") -> DataFrame:
    """Rows by each set of columns in one pass; columns outside a set show ``others``."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    flagged = grouped.agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"{k}_out") for k in keys])
    return flagged.select(*[F.when(F.col(f"{k}_out") == 1, others).otherwise(F.coalesce(F.col(k).cast("string"), F.lit("missing"))).alias(k) for k in keys], "n")


def histograms(df: DataFrame, entity: str, kind: str, *values: Column) -> DataFrame:
    """For each entity: rows, distinct kinds, and a "kind=n" list by kind; further aggregates as given."""
    by_kind = df.groupBy(entity, F.coalesce(F.col(kind).cast("string"), F.lit("missing")).alias("kind_of")).agg(F.count("*").alias("n_of"), *values)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind_of", "n_of"))), lambda s: F.concat_ws("=", s["kind_of"], s["n_of"].cast("string"))), ",")
    return by_kind.groupBy(entity).agg(F.sum("n_of").alias("n"), F.count("*").alias("kinds"), listed.alias("histogram"))


def ordered_digest(df: DataFrame, key: str, *, by_length: bool = False) -> DataFrame:
    """One row: the number of keys and the MD5 of all of them in order, a line each.

    The digest of an ordered set takes it in one task; it is meant for keys of a release, not rows
    of a corpus (``partition_digests`` does not have that limit).
    """
    text = F.col(key).cast("string")
    lines = F.array_sort(F.collect_list(F.struct(F.char_length(text).alias("length"), text.alias("k")) if by_length else F.struct(text.alias("k"))))
    return df.agg(F.count(text).alias("n"), F.md5(F.array_join(F.transform(lines, lambda s: s["k"]), "\n")).alias("digest"))


def partition_digests(df: DataFrame, key: str, columns: list[str], buckets: int = 1024) -> DataFrame:
    """Rows and an order-free digest of each bucket of keys, for comparing tables of any size."""
    row = F.xxhash64(*columns).cast("decimal(20,0)")
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("digest"))


def weighted_score(df: DataFrame, entity: str, tag: str, count: str, weights: DataFrame, *, full: float = 100.0) -> DataFrame:
    """Sum and maximum of count x weight over an entity's known tags, and the sum as a share of ``full``."""
    scored = df.join(weights, tag).withColumn("score_of", F.col(count) * F.col("weight"))
    total = F.sum("score_of")
    return scored.groupBy(entity).agg(total.alias("score"), F.max("score_of").alias("best"), F.least(F.lit(1.0), total / full).alias("share"))


def shared_tokens(df: DataFrame, family: str, member: str, tokens: Column, least: int = 2) -> DataFrame:
    """Tokens that at least ``least`` members of a family have."""
    each = df.select(family, member, F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    return each.groupBy(family, "token").agg(F.count("*").alias("members")).where(F.col("members") >= least)


def without_shared_token(df: DataFrame, family: str, member: str, tokens: Column, least: int = 2) -> DataFrame:
    """Members of families of two or more that share no token with the others."""
    shared = shared_tokens(df, family, member, tokens, least)
    each = df.select(family, member, F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    linked = each.join(shared.select(family, "token"), [family, "token"], "left_semi").select(family, member).distinct()
    large = df.groupBy(family).agg(F.count_distinct(member).alias("n")).where("n > 1").select(family)
    return df.select(family, member).distinct().join(large, family, "left_semi").join(linked, [family, member], "left_anti")


def worst_of(df: DataFrame, group: str, rank: Column, order: list[Column], *carried: str) -> DataFrame:
    """The row of highest rank in each group, earliest in ``order`` among equals: rank and carried columns of that one row."""
    tie = F.struct(rank.alias("rank"), *[(-c).alias(f"o{i}") for i, c in enumerate(order)])
    best = F.max_by(F.struct(rank.alias("rank"), *carried), tie)
    return df.groupBy(group).agg(best.alias("b"), F.count("*").alias("n")).select(group, "n", "b.*")


def merged_values(df: DataFrame, group: str, field: str, value: str) -> DataFrame:
    """One row for each group and field: the value, or all of them and a conflict where they differ."""
    some = df.where(F.nullif(F.trim(F.col(value).cast("string")), F.lit("")).isNotNull())
    listed = F.array_sort(F.collect_set(F.trim(F.col(value).cast("string"))))
    return some.groupBy(group, field).agg(listed.alias("v")).select(group, field, F.when(F.size("v") == 1, F.col("v")[0]).alias("value"), (F.size("v") > 1).alias("conflict"), F.array_join("v", "|").alias("values"))


def completeness(df: DataFrame, weights: dict[str, float]) -> Column:
    """Sum of the weights of the fields that are filled."""
    return sum((F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))


def conserved(parts: DataFrame, part: str, n: str, universe: int | Column) -> DataFrame:
    """One row: whether the parts add up to the universe."""
    total = F.sum(n)
    return parts.agg(total.alias("total"), F.lit(universe).alias("universe"), (total == F.lit(universe)).alias("conserved"))
