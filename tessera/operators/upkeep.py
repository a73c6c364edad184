"""Elections with scores, overlays by identity, references, subtypes, registries and inventories of repeats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.operators.skew import join_facts
from tessera.session import stored, unused

# Points of a work that is to be kept, and what stores' and publishers' addresses are for.
STATUS_POINTS = {"published": 40, "review": 30, "draft": 20}
SOURCE_POINTS, MOST_KEY_POINTS, RANK_POINTS, EVIDENCE_POINTS = 25, 15, 5, 5
PURPOSES = (
    (r"^store\.steampowered\.com$", r"^/app/\d+(?:/|$)", "购买 / 游玩 · Steam"),
    (r".\.itch\.io$", r"^/[^/]+", "游玩 / 获取 · itch.io"),
    (r"^(?:www\.)?dlsite\.com$", r"/product_id/", "购买 / 获取 · DLsite"),
    (r"^(?:www\.kadokawa\.co\.jp|data\.ichijinsha\.co\.jp|www\.shueisha\.co\.jp)$", r"", "出版方资料 / 获取信息"),
)
OTHER_PURPOSE = "资料来源"


def keep_score(status: Column, has_source: Column, n_keys: Column, rank: Column, has_evidence: Column) -> Column:
    """How much speaks for keeping a work of a duplicate group."""
    points = F.lit(0)
    for name, n in STATUS_POINTS.items():
        points = F.when(status == name, n).otherwise(points)
    ranked = keys.blank_to_null(rank).isNotNull() & (rank != "unknown")
    extra = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return points + extra(has_source, SOURCE_POINTS) + F.least(F.coalesce(n_keys, F.lit(0)), F.lit(MOST_KEY_POINTS)) + extra(ranked, RANK_POINTS) + extra(has_evidence, EVIDENCE_POINTS)


def elect_primary(rows: DataFrame, group: str, row_id: str, richness: Column, ordinal: Column, stable: DataFrame | None = None) -> DataFrame:
    """Each group's primary row: the one that ``stable`` (group, row id) names, if the group has it, else the richest, the first of equals.

    One aggregation with partial results, so a large group's rows meet nowhere.
    """
    of, named = unused(rows, "of_group", "named_row")
    if stable is not None:
        listed = stable.select(F.col(group).alias(of), F.col(row_id).alias(named)).dropDuplicates([of])
        rows = join_facts(rows.withColumn(of, F.col(group)), listed, of, "left")
    else:
        rows = rows.withColumn(of, F.col(group)).withColumn(named, F.lit(None).cast(rows.schema[row_id].dataType))
    own = F.coalesce(F.col(row_id) == F.col(named), F.lit(False))
    best = F.max_by(row_id, F.struct(own, F.coalesce(richness, F.lit(0)), -F.coalesce(ordinal, F.lit((1 << 53) - 1))))
    return rows.groupBy(group).agg(best.alias(row_id), F.max(own).alias("is_stable"), F.count("*").alias("members"))


def overlay_plan(desired: DataFrame, current: DataFrame, key: str, identity: str, fields: list[str]) -> DataFrame:
    """What an overlay would do to each row, by key: ``status``, ``reason`` and the ``changed`` fields.

    alreadyCurrent, wouldUpdate, missingRating (no current row), identityMismatch (the key's row is of
    another identity), or blocked: keys that several current rows have, and current rows outside the
    overlay.  Keys and identities compare trimmed.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    want = desired.select(clean(key).alias("k"), clean(identity).alias("i"), F.struct(*fields).alias("want"))
    have = current.select(clean(key).alias("k"), clean(identity).alias("i_has"), F.struct(*fields).alias("have")).groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("i_has", "have")).alias("h"))
    joined = want.join(have, "k", "full_outer")
    change = F.array_compact(F.array(*[F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"h.have.{f}")), F.lit(f)) for f in fields]))
    said = lambda status, reason=None: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    verdict = (
        F.when(F.col("want").isNull(), said("blocked", "current_database_rating_outside_release"))
        .when(F.col("n").isNull(), said("missingRating", "no_current_public_rating"))
        .when(F.col("n") > 1, said("blocked", "duplicate_current_publication_key"))
        .when(F.col("i") != F.col("h.i_has"), said("identityMismatch", "publication_key_identity_mismatch"))
        .when(F.size(change) == 0, said("alreadyCurrent"))
        .otherwise(said("wouldUpdate"))
    )
    out = joined.withColumn("verdict", verdict)
    none = F.array().cast("array<string>")
    return out.select(F.col("k").alias(key), "verdict.status", "verdict.reason", F.when(F.col("verdict.status") == "wouldUpdate", change).otherwise(none).alias("changed"))


def reference(url: Column) -> Column:
    """A reference's address with its ``purpose``; null for one that is no web address or holds a name or password."""
    text = F.trim(F.coalesce(url, F.lit("")))
    parts = r"(?i)^https?://([^/?#]*)([^?#]*)"
    authority, path = F.regexp_extract(text, parts, 1), F.regexp_extract(text, parts, 2)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    purpose = F.lit(OTHER_PURPOSE)
    for hosts, paths, name in reversed(PURPOSES):
        purpose = F.when(host.rlike(hosts) & path.rlike(paths), name).otherwise(purpose)
    sound = text.rlike(parts) & (host != "") & ~F.contains(authority, F.lit("@")) & ~host.rlike(r"[\s<>^|%]")
    return F.when(sound, F.struct(text.alias("url"), purpose.alias("purpose")))


def media_subtype(kind: Column, described: Column, tags: Column) -> Column:
    """Media type and format of a book or game by its description and tags."""
    text, tagged = F.lower(F.coalesce(described, F.lit(""))), lambda p: F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.rlike(p))
    both = lambda a, b: F.struct(F.lit(a).alias("media_type"), F.lit(b).alias("format"))
    light = text.rlike("轻小说|ライトノベル|light novel") | tagged("轻小说|light novel|ライトノベル")
    novel = text.rlike("小说|novel") | tagged("小说|novel")
    visual = text.rlike("视觉小说|visual novel|ノベル|adv|galgame|gal game") | tagged("视觉小说|visual novel|galgame")
    book = F.when(light, both("light_novel", "light_novel_series")).when(novel, both("novel", "novel_series")).otherwise(both("manga", "manga_series"))
    game = F.when(visual, both("visual_novel", "visual_novel")).otherwise(both("game", "unknown"))
    return F.when(kind == "book", book).when(kind == "game", game).otherwise(F.struct(F.coalesce(kind, F.lit("unknown")).alias("media_type"), F.lit("unknown").alias("format")))


def looked_up(rows: DataFrame, registry: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """Rows with a registry's fields for their code, and ``registered``; a code says nothing by its spelling."""
    own = registry.select(F.col(code).alias("code_of"), F.struct(*fields).alias("entry_of"))
    return rows.join(own, F.col(code) == F.col("code_of"), "left").select(*rows.columns, *[F.col(f"entry_of.{f}").alias(f) for f in fields], F.col("code_of").isNotNull().alias("registered"))


def with_defaults(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Rows whose blank or null values are the defaults of their columns."""
    filled = {c: F.coalesce(keys.blank_to_null(F.col(c)).cast(rows.schema[c].dataType), F.lit(v).cast(rows.schema[c].dataType)) for c, v in defaults.items()}
    return rows.withColumns(filled)


def repeated_values(rows: DataFrame, row_id: str, **named: Column) -> DataFrame:
    """``kind``, ``value``, the row and ``n`` for each row whose value of a kind another row has as well."""
    each = rows.select(F.col(row_id), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), keys.blank_to_null(v).alias("value")) for k, v in named.items()])).alias("v")).where("v.value is not null")
    counts = each.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    return join_facts(each, counts, "v").select("v.kind", "v.value", row_id, "n")


def distinct_duplicates(rows: DataFrame, row_id: str, text: str, series: str, least: int = 80) -> DataFrame:
    """Rows whose normalised long text rows of another series or work share: ``first_id``, ``n`` and ``works``."""
    keyed = rows.select(F.col(row_id), F.concat_ws("|", F.coalesce(F.col(series).cast("string"), F.lit("")), F.col(row_id).cast("string")).alias("work"), keys.key("summary", F.col(text)).alias("k")).where(F.char_length("k") >= least)
    hashed = stored(keyed.select(row_id, "work", F.sha2("k", 256).alias("digest")))  # keys are made once
    groups = hashed.groupBy("digest").agg(F.min(row_id).alias("first_id"), F.count("*").alias("n"), F.count_distinct("work").alias("works")).where("works > 1")
    return join_facts(hashed, groups, "digest").select(row_id, "first_id", "n", "works")


def out_of_order(rows: DataFrame, place: str, value: Column) -> DataFrame:
    """Rows, numbered by ``place`` without gaps, whose value is not above that of the row before."""
    own = rows.select(F.col(place).alias("at"), value.alias("v"))
    before = own.select((F.col("at") + 1).alias("at"), F.col("v").alias("v_before"))
    return own.join(before, "at").where(~F.coalesce(F.col("v") > F.col("v_before"), F.lit(False))).select(F.col("at").alias(place), F.col("v").alias("value"), F.col("v_before").alias("before"))
