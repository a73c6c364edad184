"""Merging the fields of duplicates: key merges, field plans and pair scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as keys


def merged_by_key(items: DataFrame, group: str, key: str, position: str, fields: list[str], lists: list[str] = ()) -> DataFrame:
    """One item for each key: of each field the last filled value, of each list all values.

    An empty value never replaces a filled one.
    """
    last = []
    for f in fields:
        some = keys.blank_to_null(F.col(f)).isNotNull()
        last.append(F.max_by(F.when(some, F.col(f)), F.when(some, F.col(position))).alias(f))
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(c) for c in lists]
    return items.groupBy(group, key).agg(F.min(position).alias("first"), *last, *union)


def field_plan(master: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each field of a pair: same, fill (only the other has it), keep (only the master), conflict or empty."""
    a, b = master.select(key, F.struct(*fields).alias("m")), other.select(key, F.struct(*fields).alias("o"))
    value = lambda side, f: keys.blank_to_null(F.col(f"{side}.{f}"))

    def plan(f: str) -> Column:
        m, o = value("m", f), value("o", f)
        action = F.when(m.isNull() & o.isNull(), "empty").when(m.isNull(), "fill").when(o.isNull(), "keep").when(m == o, "same").otherwise("conflict")
        return F.struct(F.lit(f).alias("field"), action.alias("action"), F.coalesce(m, o).alias("value"))

    each = a.join(b, key).select(key, F.explode(F.array(*[plan(f) for f in fields])).alias("p"))
    return each.select(key, "p.field", "p.action", "p.value")


def collapsed(records: DataFrame, order: str, *key_parts: Column) -> DataFrame:
    """Records of one group key (the first filled part) as their first record and how many there are."""
    key = F.coalesce(*[F.concat(F.lit(f"{i}:"), keys.blank_to_null(k)) for i, k in enumerate(key_parts)])
    row = F.struct(*records.columns)
    return records.groupBy(key.alias("group_key")).agg(F.min_by(row, order).alias("r"), F.count("*").alias("records")).select("group_key", "records", "r.*")


def first_ingested(records: DataFrame, key: str, file: str, index: str) -> DataFrame:
    """The first record of each key over files in path order: an aggregation, no sort of records."""
    row = F.struct(*[c for c in records.columns if c != key])
    return records.groupBy(key).agg(F.min_by(row, F.struct(file, index)).alias("r")).select(key, "r.*")


def pair_score(pairs: DataFrame, *, most_frequency: int = 12) -> DataFrame:
    """Adds ``score``, ``blockers`` and ``verdict`` of cross-language pairs.

    Reads a and b (structs of media, format, year, family, title, titles, source_keys, merged) and
    tokens (array of token, df).
    """
    a, b = F.col("a"), F.col("b")
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    latin = lambda c: F.coalesce(c.rlike("[A-Za-z]"), F.lit(False)) & ~keys.has_cjk(c)
    years = F.abs(a["year"] - b["year"])
    cross = (known(a["family"]) != known(b["family"])) & (known(a["family"]) != "unknown") & (known(b["family"]) != "unknown")
    mixed = (keys.has_cjk(a["title"]) & latin(b["title"])) | (keys.has_cjk(b["title"]) & latin(a["title"]))
    overlap = lambda f: F.coalesce(F.arrays_overlap(F.filter(a[f], lambda x: x != ""), b[f]), F.lit(False))
    token = F.aggregate(F.filter("tokens", lambda t: t["df"] <= most_frequency), F.lit(0), lambda s, t: s + F.when(t["df"] <= 3, 3).when(t["df"] <= 6, 2).otherwise(1))
    date = F.when(years.isNull(), 0).when(years == 0, 2).when(years == 1, 1).otherwise(0)
    parts = [date, F.when(cross, 2).otherwise(0), F.when(mixed, 2).otherwise(0), token, F.when(overlap("titles"), 4).otherwise(0), F.when(overlap("source_keys"), 5).otherwise(0)]
    blockers = F.array_compact(F.array(
        F.when((known(a["media"]) != known(b["media"])) | (known(a["media"]) == "unknown"), "media_mismatch_or_unknown_group"),
        F.when(a["format"].isNotNull() & b["format"].isNotNull() & (a["format"] != b["format"]), "format_conflict"),
        F.when(years > 1, "date_conflict"),
        F.when(~cross, "not_confirmed_cross_source"),
        F.when(F.coalesce(a["merged"], F.lit(False)) | F.coalesce(b["merged"], F.lit(False)), "already_merged_or_deprecated"),
    ))
    scored = pairs.withColumn("score", sum(parts, F.lit(0))).withColumn("blockers", blockers)
    return scored.withColumn("verdict", F.when(F.size("blockers") > 0, "blocked").when(F.col("score") >= 6, "candidate").otherwise("weak"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def series_base(title: Column, suffixes: list[str]) -> Column:
    """A title without its variant suffixes, taken off until none is left; never the whole title."""

    def once(text: Column, at: int = 0) -> Column:
        # Each text is bound before it is used again; written out, the expression would grow threefold a suffix.
        if at == len(suffixes):
            return text
        cut = F.regexp_replace(F.regexp_replace(text, suffixes[at], ""), r"(?u)[\s:：~〜ー—–\-]+$", "")
        return bound(bound(cut, lambda shorter: F.when(shorter != "", shorter).otherwise(text)), lambda left: once(left, at + 1))

    start = F.trim(F.coalesce(title, F.lit("")))
    # Each step takes off a character at least, so there are never more steps than characters.
    first = F.struct(start.alias("text"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        further = bound(once(acc["text"]), lambda shorter: F.struct(shorter.alias("text"), (shorter == acc["text"]).alias("done")))
        return F.when(acc["done"], acc).otherwise(further)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(start)), first, step, lambda acc: acc["text"])


def group_class(members: DataFrame, group: str, *, media: str, year: str, season: str) -> DataFrame:
    """``safe``, ``season_split``, ``media_mismatch`` or ``hold`` for each group of merge candidates."""
    g = members.groupBy(group).agg(F.count("*").alias("members"), F.count_distinct(media).alias("kinds"), F.count_distinct(season).alias("seasons"), (F.max(year) - F.min(year)).alias("span"))
    verdict = F.when(F.col("kinds") > 1, "media_mismatch").when(F.col("seasons") > 1, "season_split").when(F.coalesce("span", F.lit(0)) > 1, "hold").otherwise("safe")
    return g.select(group, "members", verdict.alias("verdict"))


def coverage(raw: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """Each source id: covered, missing (no work), duplicate (several) or extra (no source)."""
    a = raw.select(key).distinct().withColumn("in_source", F.lit(True))
    b = works.groupBy(key).agg(F.count("*").alias("n_works"))
    status = F.when(F.col("in_source").isNull(), "extra").when(F.col("n_works").isNull(), "missing").when(F.col("n_works") > 1, "duplicate").otherwise("covered")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), F.coalesce("n_works", F.lit(0)).alias("n_works"))
