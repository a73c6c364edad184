"""Creators and credits: a two-sided graph of works and people or organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.operators.skew import join_facts


def attach(credits: DataFrame, edges: DataFrame, *, work: str = "work_id", name: str = "name", role: str = "role", compose: bool = True) -> DataFrame:
    """Credits with ``creator_ids``, the creators bound to (work, name, role) after normalising, in order."""
    norm = lambda c: keys.key("descriptive", F.col(c), compose=compose)
    bound = edges.groupBy(F.col(work).alias("w"), norm(name).alias("n"), norm(role).alias("r")).agg(F.array_sort(F.collect_set("creator_id")).alias("creator_ids"))
    joined = credits.withColumn("n_of", norm(name)).withColumn("r_of", norm(role)).join(bound, (F.col(work) == F.col("w")) & (F.col("n_of") == F.col("n")) & (F.col("r_of") == F.col("r")), "left")
    return joined.select(*credits.columns, F.coalesce("creator_ids", F.array().cast(bound.schema["creator_ids"].dataType)).alias("creator_ids"))


def unbound(credits: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Credits that no edge binds: none is the pass."""
    return attach(credits, edges, **options).where(F.size("creator_ids") == 0)


def works_of(edges: DataFrame, creator: str = "creator_id", work: str = "work_id", role: str = "role", name: str = "name") -> DataFrame:
    """One row for each creator and work, with all roles and names."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return edges.groupBy(creator, work).agg(listed(role).alias("roles"), listed(name).alias("names"))


def work_counts(edges: DataFrame, creator: str = "creator_id", work: str = "work_id") -> DataFrame:
    return edges.groupBy(creator).agg(F.count_distinct(work).alias("works"))


def selected(counts: DataFrame, kind: Column, thresholds: dict[str, int], flagged: Column) -> DataFrame:
    """``decision``: review where flagged, selected at the threshold of its kind, else below."""
    least = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])[kind]
    decision = F.when(F.coalesce(flagged, F.lit(False)), "review").when(F.col("works") >= least, "selected").otherwise("below")
    return counts.withColumn("decision", decision)


def display_order(date: Column, title: Column, id_text: Column, locale: str | None = None) -> list[Column]:
    """A creator's works: latest year first and undated last, then by date, title and number.

    Titles are in the order of the ``locale`` (a collation such as ``zh``), else by code point.
    """
    year = keys.first_year(date)
    title = F.collate(title, locale) if locale else title
    return [year.desc_nulls_last(), date.desc_nulls_last(), title.asc(), id_text.try_cast("decimal(38,0)").asc_nulls_last(), id_text.asc()]


def creator_page(works: DataFrame, creator: str, date: Column, title: Column, id_text: Column, *, year: str | None = None, offset: int = 0, limit: int = 30, locale: str | None = "zh") -> DataFrame:
    """One page of every creator's works, with ``place`` (from 1), ``total``, ``all_total`` and ``years``.

    ``year`` keeps works of that year (``unknown`` for those without); ``total`` counts these, ``all_total``
    all.  ``years`` are all the creator's, latest first, unknown last.  Only a page of each creator is
    sorted, however many works it has.
    """
    found = F.coalesce(keys.first_year(date).cast("string"), F.lit("unknown"))
    fits = (found == year) if year else F.lit(True)
    years = F.array_sort(F.collect_set(found), lambda a, b: F.when(a == b, 0).when(a == "unknown", 1).when(b == "unknown", -1).when(a > b, -1).otherwise(1))
    facts = works.groupBy(creator).agg(F.count(F.when(fits, 1)).alias("total"), F.count("*").alias("all_total"), years.alias("years"))
    place = F.row_number().over(Window.partitionBy(creator).orderBy(*display_order(date, title, id_text, locale)))
    page = works.where(fits).withColumn("place", place).where(F.col("place") <= offset + limit)
    return join_facts(page, facts, creator).where(F.col("place") > offset)


def numbered_references(uses: DataFrame, group: str, url: str, position: str) -> DataFrame:
    """Each group's references in the order in which they first occur: number, url, uses."""
    first = uses.where(keys.blank_to_null(F.col(url)).isNotNull()).groupBy(group, url).agg(F.min(position).alias("first"), F.count("*").alias("uses"))
    ordered = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", url, "uses"))).alias("all"))
    return ordered.select(group, F.posexplode("all").alias("i", "r")).select(group, (F.col("i") + 1).alias("number"), F.col(f"r.{url}").alias(url), "r.uses")
