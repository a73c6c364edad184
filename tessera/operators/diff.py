"""Differences of tables and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the ``side`` and how often more."""
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("d")).unionByName(right.select(*columns, F.lit(-1).alias("d")))
    more = both.groupBy(*columns).agg(F.sum("d").alias("d")).where("d <> 0")
    return more.select(*columns, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("n"))


def changed(pairs: DataFrame, fields: list[str], left: str = "left", right: str = "right") -> Column:
    """Names of the fields that differ between two struct columns, in order; null equals null."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields]))


def changed_fields(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys on both sides whose fields differ: ``changed`` in the order of ``fields``."""
    a = before.select(*key, F.struct(*fields).alias("left"))
    b = after.select(*key, F.struct(*fields).alias("right"))
    joined = a.join(b, key)
    return joined.withColumn("changed", changed(joined, fields)).where(F.size("changed") > 0)


def mismatch_counts(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(field, compared, differing) over the keys on both sides; null equals null."""
    joined = before.select(*key, F.struct(*fields).alias("left")).join(after.select(*key, F.struct(*fields).alias("right")), key)
    counts = joined.agg(F.count("*").alias("compared"), *[F.count_if(~F.col(f"left.{f}").eqNullSafe(F.col(f"right.{f}"))).alias(f"differing_{i}") for i, f in enumerate(fields)])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"differing_{i}").alias("differing")) for i, f in enumerate(fields)])
    return counts.select("compared", F.explode(each).alias("x")).select("x.field", "compared", "x.differing")


def immutable_but(before: DataFrame, after: DataFrame, key: list[str], free: list[str]) -> DataFrame:
    """Keys whose columns outside ``free`` changed, or that only one side has: no rows is the pass."""
    held = [c for c in before.columns if c not in key and c not in free]
    a = before.select(*key, F.xxhash64(*held).alias("h"), F.struct(*held).alias("rest"))
    b = after.select(*key, F.xxhash64(*held).alias("g"), F.struct(*held).alias("other"))
    joined = a.join(b, key, "full_outer")
    problem = F.when(F.col("g").isNull(), "removed").when(F.col("h").isNull(), "added").when((F.col("h") != F.col("g")) | ~F.col("rest").eqNullSafe(F.col("other")), "changed")
    return joined.select(*key, problem.alias("problem")).where("problem is not null")


def array_less(items: Column, others: Column, by: str | None = None) -> Column:
    """Items that the others lack, compared whole or by one field."""
    if by is None:
        return F.filter(items, lambda x: ~F.array_contains(others, x))
    keys = F.transform(others, lambda x: x[by])
    return F.filter(items, lambda x: ~F.coalesce(F.array_contains(keys, x[by]), F.lit(False)))


def json_leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of every leaf of a JSON text: the long form that path diffs compare."""
    schema = "array<struct<path:string,value:string>>"

    @F.pandas_udf(schema)
    def leaves(texts):
        import json

        def walk(value, path, out):
            if isinstance(value, dict) and value:
                for k in sorted(value):
                    walk(value[k], f"{path}.{k}", out)
            elif isinstance(value, list) and value:
                for i, x in enumerate(value):
                    walk(x, f"{path}[{i}]", out)
            else:
                out.append({"path": path, "value": json.dumps(value, sort_keys=True)})

        def one(text):
            out: list = []
            try:
                walk(json.loads(text), "$", out)
            except (ValueError, TypeError):
                return None
            return out

        return texts.map(one)

    return df.select(key, F.explode(leaves(F.col(document))).alias("leaf")).select(key, "leaf.path", "leaf.value")


def json_diff(before: DataFrame, after: DataFrame, key: str, document: str) -> DataFrame:
    """Paths whose value differs between two JSON documents of one key."""
    a = json_leaves(before, key, document).withColumnRenamed("value", "value_left")
    b = json_leaves(after, key, document).withColumnRenamed("value", "value_right")
    return a.join(b, [key, "path"], "full_outer").where(~F.col("value_left").eqNullSafe(F.col("value_right")))
