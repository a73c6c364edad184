"""The release read model: one row for each work with its enrichments, searched and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import page_bounds


def exploded_groups(groups: DataFrame, members: str = "work_ids") -> DataFrame:
    """Inverted lists (group columns, array of ids) as one row for each id."""
    return groups.select(F.explode(members).alias("work_id"), *[c for c in groups.columns if c != members])


def haystack(*fields: Column) -> Column:
    """Lower-case text of all fields, a line each, for substring search."""
    return F.lower(F.concat_ws("\n", *fields))


def search(works: DataFrame, query: str | None, id_col: str, text: Column) -> DataFrame:
    """Works whose id is the query, or if there are none whose text contains it; all for no query."""
    asked = (query or "").strip()
    if not asked:
        return works
    exact = F.col(id_col).cast("string") == asked
    found = works.where(exact | F.contains(text, F.lit(asked.lower()))).withColumn("is_exact", exact)
    any_exact = found.agg(F.coalesce(F.max("is_exact"), F.lit(False)).alias("any_exact"))
    return found.join(F.broadcast(any_exact)).where(F.col("is_exact") | ~F.col("any_exact")).drop("is_exact", "any_exact")  # one row


def allowed(works: DataFrame, column: str, value: str | None, choices: tuple[str, ...]) -> DataFrame:
    """Filter on one of the choices; any other value is no filter, not an empty result."""
    return works.where(F.col(column) == value) if value in choices else works


def page(works: DataFrame, order: list[Column], limit=None, offset=None) -> DataFrame:
    size, start = page_bounds(limit, offset)
    return works.orderBy(*order).offset(start).limit(size)


def counted_page(works: DataFrame, query: str, id_col: str, fields: list[Column], order: list[Column], limit=None, offset=None) -> DataFrame:
    """A page of the works whose id is the query or one of whose fields contains it in any case, with the ``total`` of all found.

    Percent signs and underscores in the query stand for themselves.
    """
    asked = F.lit(query.strip().lower())
    hit = F.col(id_col).cast("string") == F.lit(query.strip())
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), asked), F.lit(False))
    found = works.where(hit)
    return page(found, order, limit, offset).join(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row
