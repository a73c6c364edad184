"""Invariants of a release as rows: what was expected, what is there, and whether they agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import join_facts

from tessera.functions import text as keys


def _check(name: str, actual: DataFrame, expected) -> DataFrame:
    """``actual`` has one row and column."""
    return actual.select(F.lit(name).alias("check"), F.lit(expected).cast("long").alias("expected"), F.col(actual.columns[0]).cast("long").alias("actual"))


def checks(*parts: DataFrame) -> DataFrame:
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.withColumn("ok", F.col("expected") == F.col("actual"))


def row_count(name: str, df: DataFrame, expected: int) -> DataFrame:
    return _check(name, df.agg(F.count("*")), expected)


def unique(name: str, df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of their key: none expected."""
    return _check(name, df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))), 0)


def referenced(name: str, df: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    known = reference.select(F.col(reference_key).alias("known_key"))
    return _check(name, df.join(known, F.col(key) == F.col("known_key"), "left_anti").agg(F.count("*")), 0)


def holds(name: str, df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition fails or is null: none expected."""
    return _check(name, df.agg(F.count_if(~F.coalesce(condition, F.lit(False)))), 0)


def histogram(df: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """Counts by key against a manifest's, both ways."""
    want = df.sparkSession.createDataFrame([(k, v) for k, v in expected.items()], f"{key} string, expected long")
    have = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("actual"))
    zero = F.lit(0).cast("long")
    joined = want.join(have, key, "full_outer").select(key, F.coalesce("expected", zero).alias("expected"), F.coalesce("actual", zero).alias("actual"))
    return joined.withColumn("ok", F.col("expected") == F.col("actual"))


def known_fields(df: DataFrame, document: Column, allowed: list[str]) -> DataFrame:
    """Adds ``unknown_fields``: top-level keys of a JSON object outside the allowed ones, in order."""
    found = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    return df.withColumn("unknown_fields", F.array_sort(F.array_except(found, F.array(*[F.lit(a) for a in allowed]))))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, rows) of each field, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), keys.blank_to_null(F.col(f)).isNotNull().alias("has")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.field").agg(F.count_if("p.has").alias("filled"), F.count("*").alias("rows"))


def search_coverage(items: DataFrame, key: str, values: Column, haystack: Column) -> DataFrame:
    """Items with values that their search text lacks, and which."""
    missing = F.filter(values, lambda v: ~F.contains(F.lower(haystack), F.lower(v)))
    return items.select(key, F.array_sort(F.array_distinct(missing)).alias("missing")).where(F.size("missing") > 0)


def group_audit(members: DataFrame, group: str, provider: str, identity: str, media: str, grade: str) -> DataFrame:
    """Merged groups of two or more: providers with several identities, mixed media, mixed grades."""
    per = members.groupBy(group, provider).agg(F.count_distinct(identity).alias("n"))
    clash = per.where(F.col(provider).isNotNull() & (F.col("n") > 1)).groupBy(group).agg(F.count("*").alias("provider_conflicts"))
    g = members.groupBy(group).agg(F.count("*").alias("members"), (F.count_distinct(media) > 1).alias("mixed_media"), (F.count_distinct(grade) > 1).alias("mixed_grades")).where("members > 1")
    return g.join(clash, group, "left").withColumn("provider_conflicts", F.coalesce("provider_conflicts", F.lit(0)))


def submission_problems(rows: DataFrame) -> DataFrame:
    """Adds ``problems`` of intake submissions: kind, work, title, description, sources and consent."""
    length = lambda c: F.char_length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    table = {
        "kind": ~F.coalesce(F.col("kind").isin("correction", "new_work"), F.lit(False)),
        "work_id": F.coalesce((F.col("kind") == "correction") & ~F.coalesce(F.col("work_id").rlike("^[0-9]{1,12}$"), F.lit(False)), F.lit(False)),
        "title": ~length("title").between(1, 200),
        "description": ~length("description").between(10, 3000),
        "sources": (F.size(sources) > 3) | F.exists(sources, lambda u: ~F.coalesce(u.rlike(r"^https://[^\s/]+"), F.lit(False))),
        "honeypot": length("website") > 0,
        "consent": ~F.coalesce(F.col("consent"), F.lit(False)),
    }
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in table.items()])))


def reconciled_events(events: DataFrame, current: DataFrame, key: str, time: str, sequence: str, fields: list[str]) -> DataFrame:
    """The latest event of each key against the current state: match, differs or work_missing, with the fields."""
    latest = events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(time, sequence)).alias("want"))
    have = current.select(key, F.struct(*fields).alias("have"))
    change = F.array_compact(F.array(*[F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"have.{f}")), F.lit(f)) for f in fields]))
    joined = latest.join(have, key, "left")
    status = F.when(F.col("have").isNull(), "work_missing").when(F.size(change) == 0, "match").otherwise("differs")
    return joined.select(key, status.alias("status"), F.when(F.col("have").isNotNull(), change).otherwise(F.array().cast("array<string>")).alias("changed"))


def anchors(rows: DataFrame, anchors_of: DataFrame, key: str, title: Column, anchor: str, anchor_title: str, least: int = 5) -> DataFrame:
    """Rows whose title equals an anchor's, or has it within (``least`` characters or more), by the
    longest such anchor.

    Distinct titles are cut into runs of ``least`` characters.  An anchor is looked up by the one of its
    runs that the fewest titles have, and what meets there is compared in full, so anchors of any number
    and length need neither a nested loop nor all substrings, and a title that many rows have is one.
    Runs and rows grow with the input whatever a plan takes their size for, so they are merged, never
    broadcast.
    """

    def runs(text: str) -> Column:
        places = F.sequence(F.lit(1), F.char_length(text) - least + 1)
        return F.when(F.char_length(text) >= least, F.transform(places, lambda s: F.struct(F.substring(F.col(text), s, least).alias("run"), s.alias("at")))).otherwise(F.array().cast("array<struct<run:string,at:int>>"))

    titled = rows.select(F.col(key).alias("k"), title.alias("t")).where("t is not null").distinct()
    texts = titled.select("t").distinct()
    cut = texts.select("t", F.explode(runs("t")).alias("r")).select("t", "r.run", "r.at")
    named = anchors_of.select(F.col(anchor).alias("anchor"), F.col(anchor_title).alias("part")).where("part <> ''").distinct()
    often = cut.groupBy("run").agg(F.count("*").alias("often"))
    asked = join_facts(named.select("anchor", "part", F.explode(runs("part")).alias("r")).select("anchor", "part", "r.run", F.col("r.at").alias("offset")), often.hint("merge"), "run", "left")
    # A run that no title has ends the search for its anchor.
    rarest = asked.groupBy("anchor", "part").agg(F.min_by(F.struct("run", "offset"), F.struct(F.coalesce("often", F.lit(0)), "offset")).alias("r")).select("anchor", "part", "r.run", "r.offset")
    start = F.col("at") - F.col("offset") + 1
    within = cut.join(rarest.hint("merge"), "run").where((start >= 1) & (F.substring(F.col("t"), start, F.char_length("part")) == F.col("part"))).select("t", "anchor", "part").distinct()
    short = texts.join(named.where(F.char_length("part") < least).hint("merge"), F.col("t") == F.col("part")).select("t", "anchor", "part")
    found = F.struct(F.char_length("part").alias("l"), (-F.xxhash64("anchor")).alias("h"), "anchor", (F.col("part") == F.col("t")).alias("equal"))
    by_title = within.unionByName(short).groupBy("t").agg(F.max(found).alias("b"), F.count("*").alias("n"))
    best = join_facts(titled, by_title.hint("merge"), "t").groupBy("k").agg(F.max("b").alias("b"), F.sum("n").alias("n"))
    return best.select(F.col("k").alias(key), "b.anchor", "b.equal", "n")
