"""Elections, latest and best rows, quotas, waves and pages.

Sorts are stable by contract: callers end every order with a column that tells rows apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut_lineage, unused


def elect(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    (place,) = unused(df, "place_in_group")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) == 1).drop(place)


def latest(df: DataFrame, key: list[str], time: str, sequence: str) -> DataFrame:
    """The last row by time of each key, the later of equal times: an aggregation, not a sort."""
    row = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(time, sequence)).alias("r")).select(*key, "r.*")


def best_unless_blocked(df: DataFrame, key: list[str], priority: list[Column], valid: Column) -> DataFrame:
    """Each key's best valid row, or none with ``blocked`` where an invalid one ranks as high or higher."""
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)])
    row = F.struct(*[c for c in df.columns if c not in key])
    best = df.groupBy(*key).agg(
        F.max_by(F.when(valid, row), F.when(valid, rank)).alias("r"),
        F.max(F.when(valid, rank)).alias("good"),
        F.max(F.when(~valid, rank)).alias("bad"),
    )
    blocked = F.col("bad").isNotNull() & (F.col("good").isNull() | (F.col("bad") >= F.col("good")))
    return best.select(*key, blocked.alias("blocked"), *[F.when(~blocked, F.col(f"r.{c}")).alias(c) for c in df.columns if c not in key])


def quota(df: DataFrame, kind: str, limits: dict[str, int], order: list[Column]) -> DataFrame:
    """Up to a limit of rows of each kind; kinds without a limit are kept whole."""
    (place, limit) = unused(df, "place_in_kind", "limit_of_kind")
    bound = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)]
    numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(kind).orderBy(*order))).withColumn(limit, bound)
    return numbered.where(F.col(limit).isNull() | (F.col(place) <= F.col(limit))).drop(place, limit)


def reserve(df: DataFrame, retry: Column, target: int, reserved: int, order: list[Column]) -> DataFrame:
    """``target`` rows of which up to ``reserved`` are retries; what one side lacks the other fills."""
    is_retry, place, sizes = unused(df, "is_retry", "place_in_side", "size_of_side")
    marked = df.withColumn(is_retry, F.coalesce(retry, F.lit(False)))
    counts = marked.agg(F.count_if(F.col(is_retry)).alias("retries"), F.count_if(~F.col(is_retry)).alias("fresh")).select(F.struct("retries", "fresh").alias(sizes))
    # Each task cuts its rows of a side to the first that can be taken at all before the sides meet.
    numbered = marked.withColumn(place, F.row_number().over(Window.partitionBy(is_retry).orderBy(*order))).where(F.col(place) <= max(target, reserved))
    both = numbered.join(F.broadcast(counts))  # one row
    retries = F.greatest(F.least(F.lit(reserved), F.col(f"{sizes}.retries")), F.least(F.col(f"{sizes}.retries"), F.lit(target) - F.col(f"{sizes}.fresh")))
    keep = F.when(F.col(is_retry), F.col(place) <= retries).otherwise(F.col(place) <= F.lit(target) - retries)
    return both.where(keep).drop(is_retry, place, sizes)


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Rows with their place, from 1, in the whole order.

    Rows are dealt to ranges of the order and numbered within each; only the ranges' sizes are
    summed in one task.
    """
    part, local, before = unused(df, "range_of_row", "place_in_range", "rows_before")
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count("*").alias("size_of_range"))
    sums = sizes.select(part, F.coalesce(F.sum("size_of_range").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    placed = ranged.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return placed.join(F.broadcast(sums), part).withColumn(name, F.col(local) + F.col(before)).drop(part, local, before)  # a row for each range


def waves(df: DataFrame, order: list[str], chunk: int, chunks_per_wave: int) -> DataFrame:
    """Rows with their ``ordinal``, ``wave`` and ``chunk`` in order."""
    rows = numbered(df, order, "ordinal")
    zero = F.col("ordinal") - 1
    return rows.withColumn("wave", (F.floor(zero / (chunk * chunks_per_wave)) + 1).cast("long")).withColumn("chunk", (F.floor(zero / chunk) % chunks_per_wave + 1).cast("long"))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page of ``size`` rows past ``after``."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def page_bounds(limit, offset, *, default: int = 30, most: int = 100, farthest: int = 1_000_000) -> tuple[int, int]:
    """Page size and offset as the list query clamps them."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    size = min(limit, most) if whole(limit) and limit > 0 else default
    return size, min(offset, farthest) if whole(offset) and offset >= 0 else 0


def packed(sizes: DataFrame, family: str, size: str, order: str, capacity: int) -> DataFrame:
    """Whole families in batches: a batch ends before the family that would overfill it.

    Where a batch ends depends on all before it, so the families, a row each, stream through one task
    in order; it remembers only the open batch and its size.  A family over the capacity has a batch
    of its own; a null size counts as nothing.
    """
    rows = sizes.select(F.col(family), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size), F.col(order).alias("order_of_family"))

    def deal(parts):
        batch, room = 1, 0
        for part in parts:
            out = []
            for x in part.column(size).to_pylist():
                if room > 0 and room + x > capacity:
                    batch, room = batch + 1, 0
                room += x
                out.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(family), part.column(size), pa.array(out, pa.int64())], [family, size, "batch"])

    schema = T.StructType([rows.schema[family], rows.schema[size], T.StructField("batch", T.LongType())])
    return rows.repartition(1).sortWithinPartitions("order_of_family", family, size).mapInArrow(deal, schema)


def chunk_ends(rows: DataFrame, chunk: list[str], ordinal: str, row_id: str) -> DataFrame:
    """Each chunk's rows, its first and last ids, and how many rows come in chunks up to and with it."""
    ends = rows.groupBy(*chunk).agg(F.count("*").alias("n"), F.min_by(row_id, ordinal).alias("first_id"), F.max_by(row_id, ordinal).alias("last_id"), F.max(ordinal).alias("upto"))
    return ends.select(*chunk, "n", "first_id", "last_id", "upto")
